"""Commits in any store that Spark reaches: versions behind one pointer, and numbered logs.

A version is a folder that is written in full and then named by a pointer file, which one
rename puts in place: readers see the old version or the new one, and a writer that stops
before the rename has changed nothing.

A log is a folder of numbered JSON files. Each is written beside its place and renamed to
the next free number, which only one writer can get; the other learns what came before it
and tries again. Entries name the data folders that count; what no entry names isn't there.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validate import DataIntegrityError, repeated, require_none

POINTER, VERSIONS, LOG = "current.json", "versions", "_log"


# --- files --------------------------------------------------------------------------------
def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _file(spark, path)
    fs.delete(where, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds, sorted; none of a missing folder."""
    fs, where = _file(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def put_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> bool:
    """A small file, complete or not there: it is written beside its place, and one rename puts
    it there. Without ``overwrite`` the answer is False if the place is taken."""
    fs, where = _file(spark, path)
    fs.mkdirs(where.getParent())
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    beside, where = fs.makeQualified(beside), fs.makeQualified(where)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if overwrite else kind.NONE
    try:
        context.rename(beside, where, options)
    except Py4JJavaError as failure:
        fs.delete(beside, False)
        if not overwrite and "FileAlreadyExists" in failure.java_exception.getClass().getName():
            return False
        raise
    return True


def get_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, where = _file(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


# --- versions -----------------------------------------------------------------------------
def current(spark: SparkSession, path: str) -> dict | None:
    """What the pointer says: the version's name, and what its writer added."""
    return json.loads(get_text(spark, f"{path}/{POINTER}")) if exists(spark, f"{path}/{POINTER}") else None


def version_folder(spark: SparkSession, path: str) -> str:
    """The folder to read: the committed version, or ``path`` itself where there are no versions."""
    found = current(spark, path)
    return f"{path}/{VERSIONS}/{found['version']}" if found else path


@contextlib.contextmanager
def new_version(spark: SparkSession, path: str, about: dict | None = None) -> Iterator[str]:
    """A folder to write a version into. It counts once the block has ended well; a block that
    fails leaves the version before it as it is, and its own folder is deleted."""
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    folder = f"{path}/{VERSIONS}/{name}"
    try:
        yield folder
        put_text(spark, f"{path}/{POINTER}", json.dumps((about or {}) | {"version": name}, sort_keys=True))
    except BaseException:
        delete(spark, folder)
        raise


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete versions older than the committed one and the ``keep`` - 1 before it, which nobody
    may be reading any more; returns their names. Later ones, being written, stay."""
    found = current(spark, path)
    older = [n for n in names(spark, f"{path}/{VERSIONS}") if found and n < found["version"]]
    gone = older[: max(0, len(older) - (keep - 1))]
    for name in gone:
        delete(spark, f"{path}/{VERSIONS}/{name}")
    return gone


# --- logs ---------------------------------------------------------------------------------
def log_entries(spark: SparkSession, path: str) -> list[dict]:
    """Entries from the last snapshot on, each with its number ``at``."""
    found: list[dict] = []
    for name in reversed([n for n in names(spark, f"{path}/{LOG}") if n.endswith(".json")]):
        found.append(json.loads(get_text(spark, f"{path}/{LOG}/{name}")) | {"at": int(name.removesuffix(".json"))})
        if found[-1].get("snapshot"):
            break
    return found[::-1]


def add_entry(spark: SparkSession, path: str, at: int, entry: dict) -> bool:
    """Whether this writer got number ``at``."""
    return put_text(spark, f"{path}/{LOG}/{at:08d}.json", json.dumps(entry, sort_keys=True), overwrite=False)


def following(entries: list[dict]) -> int:
    return entries[-1]["at"] + 1 if entries else 0


def _numbered(batch: str) -> tuple[str, int]:
    stream, _, n = batch.rpartition(":")
    return (stream, int(n)) if stream and n.isdigit() else (batch, 0)


class FinishedTable:
    """A table of finished rows, one for each key, in batches that are committed exactly once.

    ``append`` takes what a batch adds; a batch id that is committed is not taken again, and
    of keys that two writers finished at once the first commit's rows stay. Parquet files
    lying directly in the folder (a table from before it had a log) count as its beginning.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _folders(self, entries: list[dict]) -> list[str]:
        out = [f"{self.path}/batch={e['data']}" for e in entries]
        own = [n for n in names(self.spark, self.path) if n.endswith(".parquet")]
        return out if any(e.get("snapshot") for e in entries) else [f"{self.path}/{n}" for n in own] + out

    def rows(self, entries: list[dict] | None = None) -> DataFrame | None:
        """All finished rows; None while nothing was ever committed."""
        folders = self._folders(log_entries(self.spark, self.path) if entries is None else entries)
        return self.spark.read.parquet(*folders) if folders else None

    def has(self, batch: str, entries: list[dict] | None = None) -> bool:
        """Whether a batch was committed. Ids of the form ``stream:number`` count upwards within
        their stream, so a snapshot keeps the last number of each; others it keeps as they are."""
        entries = log_entries(self.spark, self.path) if entries is None else entries
        stream, n = _numbered(batch)
        return any(e.get("batch") == batch or e.get("batches", {}).get(stream, -1) >= n for e in entries)

    def _write(self, rows: DataFrame) -> tuple[str, DataFrame]:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/batch={name}")
        return name, self.spark.read.schema(rows.schema).parquet(f"{self.path}/batch={name}")

    def append(self, rows: DataFrame, batch: str | None = None, seen: list[dict] | None = None) -> bool:
        """Commit ``rows``, which were worked out knowing the entries ``seen``; False if ``batch``
        was there already. A null or repeated key is an error and nothing is committed."""
        seen = log_entries(self.spark, self.path) if seen is None else seen
        name, stored = self._write(rows)
        try:
            require_none(stored.filter(F.col(self.key).isNull()), "rows without key")
            require_none(repeated(stored, self.key), "repeated keys")
            while True:
                now = log_entries(self.spark, self.path)
                if batch is not None and self.has(batch, now):
                    delete(self.spark, f"{self.path}/batch={name}")
                    return False
                newer = [e for e in now if e["at"] >= following(seen)]
                theirs = self.rows(newer) if newer and not newer[0].get("snapshot") else self.rows(now) if newer else None
                if theirs is not None and not stored.join(theirs.select(self.key), self.key, "left_semi").isEmpty():
                    left, old = self._write(stored.join(theirs.select(self.key), self.key, "left_anti")), name
                    name, stored = left
                    delete(self.spark, f"{self.path}/batch={old}")
                if add_entry(self.spark, self.path, following(now), {"data": name, "batch": batch}):
                    return True
                seen = now
        except BaseException:
            delete(self.spark, f"{self.path}/batch={name}")
            raise

    def compact(self) -> bool:
        """Rewrite all rows as one folder under a snapshot entry, which later readers start from;
        False if another writer came between. Older folders stay for their readers."""
        entries = log_entries(self.spark, self.path)
        rows = self.rows(entries)
        if rows is None:
            return False
        name, _ = self._write(rows)
        batches: dict[str, int] = {}
        for e in entries:
            for stream, n in [*e.get("batches", {}).items(), *([_numbered(e["batch"])] if e.get("batch") else [])]:
                batches[stream] = max(n, batches.get(stream, -1))
        if add_entry(self.spark, self.path, following(entries), {"data": name, "batches": batches, "snapshot": True}):
            return True
        delete(self.spark, f"{self.path}/batch={name}")
        return False


class StateTable:
    """A keyed table whose rows go through ``states`` one by one.

    A row enters in the first state and moves to the next by a rewrite of its bucket alone.
    Each log entry names the folder of every bucket, so a step is seen in whole or not at all.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, states: tuple[str, ...], state: str = "state", buckets: int = 16):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.states, self.state, self.buckets = states, state, buckets

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def rows(self, state: str | None = None) -> DataFrame:
        """Rows of the table, or those in one state."""
        entries = log_entries(self.spark, self.path)
        found = self._read(sorted(f"{self.path}/{f}" for f in entries[-1]["buckets"].values()) if entries else [])
        return found if state is None else found.filter(F.col(self.state) == state)

    def put(self, rows: DataFrame, state: str) -> None:
        """``rows`` enter, or move to, ``state``. A row that isn't in the state before (or, for the
        first one, is there already), a null or a repeated key is an error, as is another writer
        in between; then nothing changes."""
        entries = log_entries(self.spark, self.path)
        folders = dict(entries[-1]["buckets"]) if entries else {}
        value = lambda f: F.lit(state) if f.name == self.state else F.col(f.name) if f.name in rows.columns else F.lit(None)
        fields = [value(f).cast(f.dataType).alias(f.name) for f in self.schema]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        version = f"data/{uuid.uuid4().hex}"
        try:
            rows.select(*fields, bucket).write.partitionBy("bucket").parquet(f"{self.path}/{version}/new")
            new = self._read([f"{self.path}/{version}/new"]).select(*self.schema.names)
            changed = [n.split("=")[1] for n in names(self.spark, f"{self.path}/{version}/new") if n.startswith("bucket=")]
            if not changed:
                return
            old = self._read([f"{self.path}/{folders[b]}" for b in changed if b in folders])
            require_none(new.filter(F.col(self.key).isNull()), "rows without key")
            require_none(repeated(new, self.key), "repeated keys")
            before = self.states.index(state) - 1
            met = new.select(self.key).join(old.select(self.key, F.col(self.state).alias("was")), self.key, "left")
            wrong = F.col("was").isNotNull() if before < 0 else ~F.col("was").eqNullSafe(F.lit(self.states[before]))
            require_none(met.filter(wrong), f"rows that can't become {state}")
            kept = old.join(new.select(self.key), self.key, "left_anti").unionByName(new)
            kept.select("*", bucket).repartition(len(changed), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{version}/all")
            folders |= {b: f"{version}/all/bucket={b}" for b in changed}
            if not add_entry(self.spark, self.path, following(entries), {"buckets": folders, "snapshot": True}):
                raise DataIntegrityError(f"another writer changed {self.path}")
        except BaseException:
            delete(self.spark, f"{self.path}/{version}")
            raise
        delete(self.spark, f"{self.path}/{version}/new")
