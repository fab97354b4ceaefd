"""Sources and sinks: JSON lines, runs with a sidecar, features, reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validate import SPLITS, DataIntegrityError, differing, record_violations, repeated, require_none, run_violations, sample_rules, violations
from .commit import exists, get_text, new_version, put_text, version_folder
from .shared import held

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType()}


def schema_of(text: str) -> T.StructType:
    """Schema from 'name type, ...'; unlike a DDL parse it needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (part.split() for part in text.split(","))])


RAW_PAIR = schema_of("knowledge string, question string, right_answer string, hallucinated_answer string")
SAMPLE = schema_of(
    "sample_id string, pair_id string, split string, language string, question string, knowledge string, answer string, label int, answer_length_chars int, answer_length_tokens int, match_id string"
)
RECORD = schema_of(
    "sample_id string, split string, detector string, variant string, score double, config_hash string, prompt_version string, pred_label int, latency_s double, n_generations long, n_generated_tokens long, peak_gpu_mem_mb double, extra string"
)
META = schema_of(
    "detector string, variant string, split string, config_hash string, prompt_version string, n_records long, threshold double, threshold_source string, description string, created_utc string, schema_version string, extra string"
)
SCHEMA_VERSION = "1"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed lines are an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_placed(spark: SparkSession, path: str, schema: T.StructType, place: str = "place") -> DataFrame:
    """JSON lines with their position: file, where the block starts that a task read, and the line's
    order within it. Positions compare as the lines stand, however the files are split."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    rows = spark.read.option("mode", "FAILFAST").schema(schema).json(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return rows.select("*", at.alias(place))


def parquet_placed(spark: SparkSession, path: str, place: str = "place") -> DataFrame:
    """Parquet rows with their position: file and row within it."""
    rows = spark.read.parquet(path)
    return rows.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(place))


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines through Spark's commit protocol: readers see all files or none."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def read_checkpoint(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """Rows finished so far; a missing or repeated key is an error, a missing table is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = read_jsonl(spark, path, schema)
    require_none(rows.filter(F.col(key).isNull()), "rows without key")
    require_none(repeated(rows, key), "repeated keys")
    return rows


def write_run(records: DataFrame, meta: dict, path: str, threshold: float | None = None, source: str | None = None) -> None:
    """Apply a run's threshold and commit records and a sidecar of one row together.

    Records are worked out once: they are written into a new version, and what was written is
    counted and checked. Only then does the run's pointer name that version; a failure before
    leaves the run that was there."""
    spark = records.sparkSession
    if threshold is not None:
        if source != "validation":
            raise DataIntegrityError("a threshold must come from validation")
        records = records.withColumn("pred_label", (F.col("score") >= threshold).cast("int"))
    with new_version(spark, path) as folder:
        write_jsonl(records, f"{folder}/records")
        written = read_jsonl(spark, f"{folder}/records", RECORD)
        row = {f.name: None for f in META} | meta | {"n_records": written.count(), "threshold": threshold, "threshold_source": source, "schema_version": SCHEMA_VERSION}
        sidecar = spark.createDataFrame([tuple(row[f.name] for f in META)], META)
        require_none(record_violations(written), "invalid records")
        require_none(run_violations(written, sidecar), "invalid run")
        write_jsonl(sidecar, f"{folder}/meta")


def run_path(folder: str, detector: str, variant: str, split: str) -> str:
    """Where a run lies below ``folder``; an unknown split is an error."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    return f"{folder}/{detector}/{variant}/{split}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, put in place by one rename; there is no moment without the old or the new one."""
    put_text(spark, path, text)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    return get_text(spark, path)


#: Bytes of a file that are read at once.
CHUNK = 1 << 20


def _digest(spark: SparkSession, *paths) -> str:
    """SHA-256 of files one after another, streamed: memory doesn't grow with them."""
    tools = spark._jvm.org.apache.commons.codec.digest.DigestUtils
    found = tools.getSha256Digest()
    for path in paths:
        stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
        try:
            tools.updateDigest(found, stream)
        finally:
            stream.close()
    return bytes(found.digest()).hex()


def _digest_of_lines(spark: SparkSession, *paths) -> str:
    """:func:`_digest` with CRLF read as LF."""
    found, carry = hashlib.sha256(), b""
    for path in paths:
        stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
        try:
            while chunk := bytes(stream.readNBytes(CHUNK)):
                chunk = carry + chunk
                carry = chunk[-1:] if chunk.endswith(b"\r") else b""  # the LF may follow in the next chunk
                found.update(chunk[: len(chunk) - len(carry)].replace(b"\r\n", b"\n"))
        finally:
            stream.close()
    found.update(carry)
    return found.hexdigest()


def _files(spark: SparkSession, path: str) -> list:
    """A file's path, or those of all files below a folder but hidden ones, by path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise FileNotFoundError(path)
    found, listed = [], fs.listFiles(where, True)
    while listed.hasNext():
        found.append(listed.next().getPath())
    return sorted((f for f in found if not f.getName().startswith((".", "_"))), key=lambda f: f.toString())


def file_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes, or over the sorted hashes of a folder's files."""
    found = sorted(_digest(spark, f) for f in _files(spark, path))
    return found[0] if len(found) == 1 else hashlib.sha256("".join(found).encode()).hexdigest()


def unknown_fields(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(field) names that lines of a JSON file have beyond the schema."""
    names = F.explode(F.json_object_keys("value"))
    return spark.read.text(path).filter(F.trim("value") != "").select(names.alias("field")).distinct().filter(~F.col("field").isin(schema.fieldNames()))


def read_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and sidecar of a run's committed version, fully validated; unknown fields are an
    error. A run without versions has both directly in its folder."""
    folder = version_folder(spark, path)
    require_none(unknown_fields(spark, f"{folder}/records", RECORD), "unknown fields in records")
    require_none(unknown_fields(spark, f"{folder}/meta", META), "unknown fields in the sidecar")
    records, meta = read_jsonl(spark, f"{folder}/records", RECORD), read_jsonl(spark, f"{folder}/meta", META)
    require_none(record_violations(records), "invalid records")
    require_none(run_violations(records, meta), "invalid run")
    return records, meta


def find_run(spark: SparkSession, folders: list[str], name: str) -> str:
    """The first of the folders that holds the run."""
    for folder in folders:
        if exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    raise FileNotFoundError(name)


def load_split(spark: SparkSession, path: str, split: str, manifest: DataFrame | None = None, expected_hash: str | None = None) -> DataFrame:
    """Samples of one split (``path/split.jsonl``), checked for their rules, against the file's
    content hash and against the manifest (split, pair_id, stem), which also says both labels."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    file = f"{path}/{split}.jsonl"
    rows = read_jsonl(spark, file, SAMPLE).withColumn("split", F.lit(split))
    rows = held(rows.withColumn("answer_length_chars", F.coalesce("answer_length_chars", F.length("answer"))))  # parsed once for all checks
    require_none(violations(rows, sample_rules()), "invalid samples")
    require_none(repeated(rows, "sample_id"), "repeated ids")
    if expected_hash is not None and content_hash(spark, file) != expected_hash:
        raise DataIntegrityError(f"{file} isn't the file that the manifest names")
    if manifest is not None:
        ids = F.explode(F.array(*[F.concat_ws("_", "stem", F.lit(y)) for y in (0, 1)]))
        listed = manifest.filter(F.col("split") == split).select("pair_id", ids.alias("sample_id"))
        own = rows.select("pair_id", "sample_id")
        require_none(differing(own, listed), "samples and manifest differ")
    return rows


def load_all(spark: SparkSession, path: str, manifest: DataFrame | None = None, hashes: dict[str, str] | None = None) -> DataFrame:
    """All three splits as one table with ``split``."""
    parts = [load_split(spark, path, s, manifest, (hashes or {}).get(s)) for s in SPLITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def load_counted(samples: DataFrame, rows: int, per_class: int) -> DataFrame:
    """Samples with their word lengths; another number of rows, or of either label, is an error."""
    from ..functions.text import word_count

    require_none(repeated(samples, "sample_id"), "repeated ids")
    n = samples.agg(F.count("*").alias("n"), *[F.count_if(F.col("label") == y).alias(f"n{y}") for y in (0, 1)]).first()
    if (n.n, n.n0, n.n1) != (rows, per_class, per_class):
        raise DataIntegrityError(f"{n.n} rows, {n.n0} and {n.n1} of the labels, where {rows} and {per_class} each are expected")
    return samples.withColumns({"answer_length_chars": F.length("answer"), "answer_length_words": word_count(F.col("answer"))})


def load_controlled(subset: DataFrame, test: DataFrame, delta: int = 1) -> DataFrame:
    """A matched subset: each row equal to its one test row, matches complete and within delta."""
    from ..operators.matching import match_violations

    same = ["sample_id", "pair_id", "question", "answer", "label"]
    require_none(repeated(test, "sample_id"), "repeated ids in test")
    require_none(repeated(subset, "sample_id"), "repeated ids")
    require_none(subset.filter("match_id is null or match_id = ''").select("sample_id"), "rows without a match")
    require_none(subset.join(test.select(*same), same, "left_anti").select(*same), "rows that differ from test")
    require_none(match_violations(subset.withColumn("length", F.length("answer")), delta), "broken matches")
    return subset


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature chunks (sample_id, layer, features, label, config_hash, prompt_version) of one
    provenance, in which every chunk has the same layers and all vectors one width."""
    rows = spark.read.parquet(path)
    one = rows.agg(*[F.countDistinct(c).alias(c) for c in ("config_hash", "prompt_version")]).first()
    if one.config_hash > 1 or one.prompt_version > 1:
        raise DataIntegrityError("feature chunks of several configurations")
    keys = [c for c in ("chunk",) if c in rows.columns]
    layers = rows.groupBy(*keys).agg(F.sort_array(F.collect_set("layer")).alias("layers"))
    if layers.select("layers").distinct().limit(2).count() > 1:
        raise DataIntegrityError("feature chunks of different layers")
    if "features" in rows.columns and rows.select(F.size("features")).distinct().limit(2).count() > 1:
        raise DataIntegrityError("feature vectors of different widths")
    return rows


def check_features(features: DataFrame, samples: DataFrame) -> DataFrame:
    """``features`` if their ids and labels are exactly those of ``samples``."""
    own, wanted = features.select("sample_id", F.col("label").cast("int").alias("label")).distinct(), samples.select("sample_id", F.col("label").cast("int").alias("label"))
    require_none(differing(own, wanted), "features and samples differ")
    require_none(features.groupBy("sample_id", "layer").count().filter("count > 1"), "repeated features")
    return features


def append_features(rows: DataFrame, path: str) -> None:
    """Write the chunks that aren't there yet."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select("chunk").distinct(), "chunk", "left_anti")
    rows.write.mode("append").partitionBy("chunk").parquet(path)


#: Endings of files that Spark unpacks as it reads lines.
_PACKED = (".gz", ".bz2", ".zst", ".deflate", ".snappy", ".lz4")


def content_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 over the text of a file, or of a folder's files one after another, with CRLF read as
    LF, streamed. Tasks look for CRs at the ends of lines first; without any the bytes needn't leave the JVM."""
    files = _files(spark, path)
    names = [f.toString() for f in files]
    plain = not any(n.endswith(_PACKED) for n in names)
    if plain and spark.read.option("lineSep", "\n").text(names).filter(F.col("value").endswith("\r")).isEmpty():
        return _digest(spark, *files)
    return _digest_of_lines(spark, *files)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def config_hash(config: dict, leave_out: tuple[str, ...] = ("paths",)) -> str:
    """Twelve hex digits of the SHA-256 of a configuration's canonical JSON, without what differs between machines."""
    text = json.dumps({k: v for k, v in config.items() if k not in leave_out}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def report_json(frames: dict[str, DataFrame]) -> str:
    """Small result frames as one JSON text."""
    return json.dumps({k: [json.loads(r) for r in df.toJSON().collect()] for k, df in frames.items()}, sort_keys=True)
