"""Resumable scoring: finished keys are skipped, and every key is finished exactly once.

The same runner serves batch (rows whose keys aren't in the finished table) and
``availableNow`` streams over a growing folder. What a call adds is one commit in the
table's log (``sources.commit``): a stopped call leaves nothing, a batch that is replayed
after its commit adds nothing, and of two runners that finish a key at the same time the
first to commit keeps it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.leakage import not_done
from ..operators.validate import require_none
from ..sources.commit import FinishedTable, StateTable, get_text, log_entries


def one_each(work: DataFrame, key: str) -> DataFrame:
    """One row for each key: the least of its rows. A row without key is an error."""
    require_none(work.filter(F.col(key).isNull()), "rows without key")
    rest = [c for c in work.columns if c != key]
    if not rest:
        return work.distinct()
    return work.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(*[F.col(key) if c == key else F.col("_row")[c].alias(c) for c in work.columns])


def resume(work: DataFrame, done_path: str, key: str, score: Callable[[DataFrame], DataFrame], batch: str | None = None) -> DataFrame:
    """Score the rows whose keys ``done_path`` lacks, commit them, return the whole table. With
    a ``batch`` id that is committed already nothing is scored."""
    table = FinishedTable(work.sparkSession, done_path, key)
    seen = log_entries(work.sparkSession, done_path)
    if batch is None or not table.has(batch, seen):
        done, todo = table.rows(seen), one_each(work, key)
        table.append(score(todo if done is None else not_done(todo, done, key)), batch, seen)
    return table.rows()


def follow(spark: SparkSession, source: str, schema: T.StructType, done_path: str, checkpoint: str, key: str, score: Callable[[DataFrame], DataFrame]) -> None:
    """Score all JSON-line files that have arrived in ``source`` since the last call. A micro-batch
    is named by the stream's id, which its checkpoint keeps, and its number."""

    def one(rows: DataFrame, number: int) -> None:
        stream = json.loads(get_text(spark, f"{checkpoint}/metadata"))["id"]
        resume(rows, done_path, key, score, f"{stream}:{number}")

    query = spark.readStream.schema(schema).json(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_states(work: DataFrame, table: StateTable, generate: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame], same: list[str], parts: int = 1) -> DataFrame:
    """Bring every row of ``work`` to the table's last state, and return the table.

    Rows that the table lacks are generated and kept as such; rows that wait in the first state
    are scored from what was kept, so a stop in between costs no second generation. Each of
    ``parts`` shares of the keys is committed by itself. Rows of the table that ``work`` doesn't
    have, or that differ from it in the columns ``same`` (provenance), are an error."""
    first, last = table.states
    key, have = table.key, table.rows()
    require_none(have.join(work.select(key), key, "left_anti").select(key), "finished rows of unknown keys")
    own = work.select(key, *[F.col(c).alias(f"_{c}") for c in same])
    differ = reduce(or_, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same], F.lit(False))
    require_none(have.join(own, key).filter(differ).select(key, *same), "finished rows of another provenance")
    share = F.pmod(F.xxhash64(key, F.lit("share")), F.lit(parts))
    for part in range(parts):
        table.put(generate(not_done(one_each(work.filter(share == part), key), table.rows(), key)), first)
        table.put(score(table.rows(first).filter(share == part)), last)
    return table.rows()
