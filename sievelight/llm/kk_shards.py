"""Byte-balanced shards by Karmarkar-Karp differencing over groups of equal texts.

1. Rows with equal texts are one indivisible group; its weight is its rows' bytes (text in
   UTF-8 plus 16 a row). Weights are sums by text hash, combined before the shuffle.
2. A group of at least total / ``units`` bytes is a unit by itself, so there are at most
   ``units`` of those however many rows there are; smaller groups share ``units`` packets by
   their hash. A table of up to ``units`` groups thus is differenced nearly group by group.
3. One task differences the units, at most twice ``units`` in number: every unit starts as a
   partition of its weight and empty shards; the two partial partitions of largest spread
   are combined, one ordered downwards and one upwards, until one is left. Walking back
   through the combinations tells each unit its shard.
4. Shards go back to rows by broadcast of the units. Rows are numbered within a shard by
   input split: a split's share of a shard is numbered by itself, after those before it.

Law ``bytes`` holds as far as whole groups allow it: a group of more than its shard's even
share has a shard to itself and the rest is even among the others.

Defined cases: a null text has no bytes and is equal to the empty one; rows with equal or
null doc_id are rows like any other; texts are told apart by a 64-bit hash and their size
(a collision only keeps two texts together); equal weights go by hash, so the result
depends on the rows and the input's splits alone; an empty table has an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small, stored, unused

SHARDS = 40
#: Bound on the groups that count singly, and on the packets of the others.
UNITS = 8192
#: Bytes that a row has beside its text.
ROW_BYTES = 16
#: Rows up to which the table of shares (shards x input splits) is broadcast.
BROADCAST_ROWS = 200_000


def difference(weights: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each weight, by largest differencing."""
    sums = {i: np.concatenate([[w], np.zeros(shards - 1, np.int64)]) for i, w in enumerate(weights)}
    heap = [(-int(w) if shards > 1 else 0, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    made = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        joined = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-joined, kind="stable")
        node = len(weights) + len(made)
        made.append((a, b, order.astype(np.int32)))
        sums[node] = joined[order] - joined[order[-1]]
        heapq.heappush(heap, (-int(sums[node][0]), node))
    shard_of = {heap[0][1]: np.arange(shards)} if heap else {}
    for k in range(len(made) - 1, -1, -1):  # a node's position p holds position order[p] of a and its mirror of b
        a, b, order = made[k]
        place = np.empty(shards, np.int64)
        place[order] = shard_of.pop(len(weights) + k)
        shard_of[a], shard_of[b] = place, place[::-1]
    return np.array([shard_of[i][0] for i in range(len(weights))], np.int64)


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def row_size(text: Column) -> Column:
    return F.octet_length(_text(text)).cast("long") + ROW_BYTES


class Plan:
    """Which shard a text belongs to: the units and their shards, a bounded table."""

    def __init__(self, rows: DataFrame, shards: int, units: int, keep: Scratch):
        """``rows``: group_hash, size of every row; ``keep`` owns the tables of the plan."""
        self.units = units
        groups = keep.keep(rows.groupBy("group_hash", "size").agg((F.count("*") * F.col("size")).alias("bytes")), "shard-groups")
        total = groups.agg(F.sum("bytes")).first()[0] or 0
        alone = F.col("bytes") >= total / units
        parts = groups.select(
            F.when(alone, F.col("group_hash")).otherwise(self.packet(F.col("group_hash"))).alias("unit"), F.when(alone, F.col("size")).alias("unit_size"), "bytes"
        ).groupBy("unit", "unit_size").agg(F.sum("bytes").alias("bytes"))

        def dealt(batches):
            rows = pa.Table.from_batches(batches, schema).sort_by([("bytes", "descending"), ("unit_size", "descending"), ("unit", "ascending")])
            found = difference(rows["bytes"].to_numpy(), shards)
            yield from rows.select(["unit", "unit_size"]).append_column("shard", pa.array(found, pa.int32())).to_batches()

        schema = pa.schema([("unit", pa.int64()), ("unit_size", pa.int64()), ("bytes", pa.int64())])
        self.table = keep.keep(parts.repartition(1).mapInArrow(dealt, "unit long, unit_size long, shard int"), "shard-units")

    def packet(self, group_hash: Column) -> Column:
        return F.pmod(group_hash, F.lit(self.units))

    def place(self, rows: DataFrame, group_hash: str, size: str, name: str) -> DataFrame:
        """``rows`` with their shard as ``name``; nothing is shuffled."""
        a, b, c, d, e = unused(rows.withColumn(name, F.lit(0)), "unit", "unit_size", "own_shard", "packet", "packet_shard")
        single = self.table.filter("unit_size is not null").select(F.col("unit").alias(a), F.col("unit_size").alias(b), F.col("shard").alias(c))
        shared = self.table.filter("unit_size is null").select(F.col("unit").alias(d), F.col("shard").alias(e))
        out = rows.join(F.broadcast(single), (F.col(group_hash) == F.col(a)) & (F.col(size) == F.col(b)), "left")
        out = out.join(F.broadcast(shared), self.packet(F.col(group_hash)) == F.col(d), "left")
        return out.withColumn(name, F.coalesce(c, e)).drop(a, b, c, d, e)


def numbered(rows: DataFrame, split: str, order: list[str], name: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with gapless numbers from 0 within ``shard``. Sorted together are only the
    rows that an input split gives to a shard; the table of such shares sums up the starts."""
    mine, before = Window.partitionBy("shard", split).orderBy(*order), Window.partitionBy("shard").orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    shares = rows.groupBy("shard", split).agg(F.count("*").alias("n"))
    starts = shares.select("shard", split, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    found = rows.withColumn(name, F.row_number().over(mine).cast("long") - 1).join(small(starts, limit), ["shard", split])
    return found.withColumn(name, F.col(name) + F.col("first")).drop("first")


def assign(docs: DataFrame, shards: int = SHARDS, units: int = UNITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``."""
    text = _text(F.col("text"))
    with Scratch(docs.sparkSession) as keep:
        rows = docs.select(
            F.col("doc_id"), row_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group_hash"), F.spark_partition_id().alias("split")
        )
        rows = keep.keep(rows, "shard-rows")  # one pass over the texts; the split numbers are kept
        placed = keep.keep(Plan(rows, shards, units, keep).place(rows, "group_hash", "size", "shard"), "shard-placed")
        slots = numbered(placed, "split", ["doc_id", "text_crc32", "size"], "slot")
        return stored(slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")), "shards")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, units: int = UNITS, files: int = 1) -> None:
    """The rows of ``docs`` as Parquet below ``path``, a folder ``shard=K`` for each shard that
    gets rows, dealt to ``files`` files in each by row, so that a crowded text isn't one task."""
    group, size, salt = unused(docs, "group_hash", "size", "salt")
    with Scratch(docs.sparkSession) as keep:
        rows = docs.withColumns({group: F.xxhash64(_text(F.col("text"))), size: row_size(F.col("text"))})
        plan = Plan(rows.select(F.col(group).alias("group_hash"), F.col(size).alias("size")), shards, units, keep)
        placed = plan.place(rows.drop(*[c for c in docs.columns if c.lower() == "shard"]), group, size, "shard").drop(group, size)
        dealt = placed.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(files)))
        dealt.repartition("shard", salt).drop(salt).write.partitionBy("shard").parquet(path)
