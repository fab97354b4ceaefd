"""Approximate nearest neighbours by a forest of hash prefixes.

Rows are dealt to blocks by a hash of their id. A block holds several trees; a
tree is the sorted array of its vectors' long hash strings (signs against random
hyperplanes). A query descends every tree to its longest matching prefix, then
all trees ascend together, one bit at a time, until their ranges hold enough
candidates; these are scored exactly. Blocks answer separately and their answers
are merged. A task holds one block and at most ``QUERY_GROUP`` blocks of queries,
whatever the table; both blocks are bounded in rows and in bytes.

``share`` is the number of candidates, over all trees and with repeats, as a part
of a block: recall rises with it, and a share of at least the number of trees takes
every row, which makes the answer exact. Exact copies of a vector in a block are one
entry with its smallest ids; ids beyond the wanted neighbours plus the query's own
can't be among the nearest, since ties go to the smaller id.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite
component take no part, nor do rows with null id; of several vector lengths the
most frequent (then the longest) is used and the others take no part; of rows with equal id
the one with the least vector bytes counts; extra columns are ignored; an empty
table gives an empty result; with fewer than k others all are returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Trees of a block, bits of a hash string, rows of a block, queries of a block of queries.
TREES, BITS, BLOCK, QUERY_BLOCK = 24, 32, 16_384, 2048
#: Bytes of a block's vectors, and query blocks that meet a block in one task.
BLOCK_BYTES, QUERY_GROUP = 32 << 20, 16
#: Candidates (with repeats over the trees) as a part of a block.
SHARE = 0.6


def hyperplanes(dim: int, trees: int = TREES, bits: int = BITS, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(trees, bits, dim)).astype(np.float32)


def hash_strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(trees, rows) hash strings, the first plane's sign in the highest bit."""
    trees, bits, dim = planes.shape
    out = np.zeros((trees, len(vectors)), np.uint64)
    for t in range(trees):
        signs = vectors.astype(np.float32) @ planes[t].T > 0
        for b in range(bits):
            out[t] = out[t] << np.uint64(1) | signs[:, b]
    return out


def leveled(vectors: np.ndarray) -> np.ndarray:
    """Vectors as doubles, each scaled by a power of two (so without rounding) to a largest component near one."""
    vectors = vectors.astype(np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0))[1][:, None])


class Block:
    """The forest over one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, planes: np.ndarray, k: int):
        order = np.lexsort((ids,))
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        raw = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1])))[:, 0]
        first = np.ones(len(ids), bool)
        first[1:] = ids[1:] != ids[:-1]
        if not first.all():  # repeated ids: the least vector bytes stay
            keep = sorted(range(len(ids)), key=lambda i: (ids[i], raw[i].tobytes()))
            keep = [i for n, i in enumerate(keep) if n == 0 or ids[i] != ids[keep[n - 1]]]
            ids, vectors, raw = ids[keep], vectors[keep], raw[keep]
        _, lead, group = np.unique(raw, return_index=True, return_inverse=True)
        by_group = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[by_group], np.arange(len(lead)))
        self.members = [ids[m[: k + 1]] for m in np.split(by_group, starts[1:])]
        self.vectors = leveled(vectors[lead])
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.unit = (self.vectors / self.norms[:, None]).astype(np.float32)
        self.bits = planes.shape[1]
        keys = hash_strings(self.unit, planes)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)
        self.planes, self.k = planes, k

    def search(self, ids: np.ndarray, vectors: np.ndarray, share: float) -> tuple[list[int], list[int], list[float]]:
        """(query, neighbour, score) lists: the k nearest found for each query."""
        n, k = len(self.vectors), self.k
        vectors = leveled(vectors)
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        unit = (vectors / norms[:, None]).astype(np.float32)
        asked = hash_strings(unit, self.planes)
        # on average 2(k + 1) entries of each tree, so some tree alone holds more than k others
        wanted = max(2 * (k + 1) * len(self.keys), share * n)
        trees = range(len(self.keys))
        low = np.zeros((len(trees), len(ids)), np.int64)
        high = np.full_like(low, n)
        climbing = np.ones(len(ids), bool)
        for level in range(self.bits, 0, -1):  # ascend from whole strings to one bit
            rest = np.uint64((1 << (self.bits - level)) - 1)
            some = np.nonzero(climbing)[0]
            if not len(some):
                break
            lo = np.stack([np.searchsorted(self.keys[t], asked[t, some] & ~rest, "left") for t in trees])
            hi = np.stack([np.searchsorted(self.keys[t], asked[t, some] | rest, "right") for t in trees])
            enough = (hi - lo).sum(axis=0) >= wanted
            low[:, some[enough]], high[:, some[enough]] = lo[:, enough], hi[:, enough]
            climbing[some[enough]] = False
        out: tuple[list, list, list] = ([], [], [])
        for q in range(len(ids)):
            mask = np.zeros(n, bool)
            for t in trees:
                mask[self.order[t, low[t, q] : high[t, q]]] = True
            found = np.nonzero(mask)[0]
            rough = self.unit[found] @ unit[q]
            if len(found) > k + 1:  # rounding in single precision is far below the margin
                found = found[rough >= np.partition(rough, len(rough) - k - 1)[-k - 1] - 1e-4]
            exact = (self.vectors[found] * vectors[q]).sum(axis=1) / (self.norms[found] * norms[q])
            rows = [(-s, int(i)) for s, f in zip(exact.tolist(), found) for i in self.members[f] if i != ids[q]]
            for s, i in sorted(rows)[:k]:
                out[0].append(int(ids[q]))
                out[1].append(i)
                out[2].append(-s)
        return out


def valid_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vec array<double>) of the rows that take part."""
    vec = F.col(vector_column).cast("array<double>")
    usable = rows.select(F.col(id_column).cast("long").alias("id"), vec.alias("vec")).filter(
        F.col("id").isNotNull()
        & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    sizes = usable.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return usable.filter(F.size("vec") == (sizes.dim if sizes else 0))


def nearest(
    rows: DataFrame, query_filter, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 5, share: float = SHARE, block: int = BLOCK, trees: int = TREES
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row with ``query_filter(id)``."""
    spark = rows.sparkSession
    usable = stored(valid_vectors(rows, id_column, vector_column), "vectors")
    asking = usable.filter(query_filter(F.col("id")))
    n, n_queries = usable.count(), asking.count()
    head = usable.first()
    dim = len(head.vec) if head else 1
    planes = spark.sparkContext.broadcast(hyperplanes(dim, trees))
    most = max(256, BLOCK_BYTES // (8 * dim))
    blocks, query_blocks = max(1, -(-n // min(block, most))), max(1, -(-n_queries // min(QUERY_BLOCK, most)))
    groups = -(-query_blocks // QUERY_GROUP)
    pack_schema = "part int, ids array<long>, vecs array<double>"

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "ids": [pdf["id"].to_numpy()], "vecs": [np.concatenate(pdf["vec"].to_numpy())]})

    # part counts, and so the rows of a part, are set by the block sizes
    members = usable.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("part").applyInPandas(pack, pack_schema)
    queries = asking.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int")).groupBy("part").applyInPandas(pack, pack_schema)
    fan = queries.select("ids", "vecs", (F.col("part") % groups).alias("of"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"))
    every = members.select("ids", "vecs", "part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("of"))
    work = every.groupBy("part", "of").cogroup(fan.groupBy("part", "of"))

    def search(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list] = ([], [], [])
        if len(mine):
            shaped = lambda row: (np.asarray(row.ids), np.asarray(row.vecs).reshape(len(row.ids), -1))
            forest = Block(*shaped(mine.iloc[0]), planes.value, k)
            for row in theirs.itertuples():
                for column, values in zip(out, forest.search(*own_queries(*shaped(row)), share)):
                    column += values
        return pd.DataFrame({"query_id": pd.Series(out[0], dtype="int64"), "vec_id": pd.Series(out[1], dtype="int64"), "score": pd.Series(out[2], dtype="float64")})

    found = work.applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def own_queries(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row for each id: of repeated ids the least vector bytes."""
    keep = sorted(range(len(ids)), key=lambda i: (ids[i], vectors[i].tobytes()))
    keep = [i for n, i in enumerate(keep) if n == 0 or ids[i] != ids[keep[n - 1]]]
    return ids[keep], vectors[keep]
