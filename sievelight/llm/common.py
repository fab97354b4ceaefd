"""Shared helpers: durable intermediates, bounded work tables and byte tables."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte translation that lower-cases A-Z and leaves every other byte alone.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the
    context's checkpoint folder. Only a local session without either (a test) gets a
    folder of its own; elsewhere executors would write to disks that others can't read."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sievelight-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {re.sub(r"/(kind=[^/]*/)?[^/]*$", "", f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Owner of stored tables: what ``keep`` stored is deleted when the block ends, whether
    it ended well or not. Results that outlive it are stored outside (:func:`stored`)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def path(self, tag: str) -> str:
        self.paths.append(new_path(self.spark, tag))
        return self.paths[-1]

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        df.write.parquet(path := self.path(tag))
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, tag: str) -> str:
        """A new name in the catalogue; its files lie where ``path`` says."""
        self.tables.append(f"{tag}_{uuid.uuid4().hex}")
        return self.tables[-1]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, limit: int) -> DataFrame:
    """``df`` to be broadcast if it is counted to have at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_counted(rows: DataFrame, found: DataFrame, keys: list[str], weight: str, crowded: int) -> DataFrame:
    """``rows`` joined to ``found``, which has each key once with the number of its rows as
    ``weight``. Keys of at least ``crowded`` rows (so at most rows / crowded of them) are
    broadcast, so that none of them meets in one task; the rest is shuffled."""
    hot = found.filter(F.col(weight) >= crowded)
    apart = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(found.filter(F.col(weight) < crowded), keys)
    return apart.unionByName(rows.join(F.broadcast(hot), keys).select(*apart.columns))


def tidied(run):
    """``run`` for mapInArrow that, once its rows are through, gives freed memory back to the
    system: Python workers are reused, so what one stage held would stay beside the next one's."""

    def task(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return task


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Values that are carried together.
BLOCK = 128


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def carried(values: Column, add) -> Column:
    """For each value what ``add`` makes of those before it (from 0). Blocks of values are
    carried one by one, so a step copies a block and not all that was found so far."""

    def within(start, part):
        first = F.struct(start.alias("now"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, first, lambda acc, x: F.struct(add(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")))

    def whole(v):
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(BLOCK)), lambda i: i <= F.size(v))
        parts = F.transform(starts, lambda i: F.slice(v, i, F.lit(BLOCK)))

        def blocks(p):
            ends = F.transform(p, lambda x: F.aggregate(x, F.lit(0), add))
            return F.flatten(F.transform(F.arrays_zip(p.alias("part"), within(F.lit(0), ends)["out"].alias("start")), lambda z: within(z["start"], z["part"])["out"]))

        return bound(parts, blocks)

    return bound(values, whole)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is right, and quicker, where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def bucket_of_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as remainder 0's text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
