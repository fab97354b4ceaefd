"""Queries over what loaders, sinks and protocols leave behind: each writes below the shared
folder, stops or repeats where that matters, and returns what is read back."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..operators import drivers, matching, metrics, protocol, records, report, splits
from ..operators.validate import require_none
from ..sources import commit, io
from ..sources.shared import ensure_checkpoint_dir, held
from ..streaming import resume
from . import views
from .detection import AT_A, _YOUDEN, _area, _candidates, _choose
from .registry import Registry
from .tables import WSQL

R = Registry()
q, sql = R.query, views.sql

META = {"detector": "demo", "variant": "v", "config_hash": "c", "prompt_version": "p"}


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _records(samples, score: str, split: str, **costs):
    return protocol.records_of(samples.withColumn("score", F.col(score).cast("double")).withColumns(costs), split, META["detector"], META["variant"], META["config_hash"], META["prompt_version"])


class Stopped(Exception):
    pass


def _stops(rows):
    raise Stopped


# --- runs -----------------------------------------------------------------------------------
@q("a9_a10_v1_run_commit", sql("samples", f"SELECT sample_id, score_a AS score, (score_a >= {AT_A})::INTEGER AS pred_label, 'first' AS version FROM samples WHERE split = 'test' UNION ALL SELECT sample_id, score_b, (score_b >= 4)::INTEGER, 'second' FROM samples WHERE split = 'test'"))
def _(spark, d):
    """A run is written, a second writer stops half way, the first is read; then a second is written and read."""
    test, path = views.samples(spark, d).filter("split = 'test'"), _folder(spark, "run")
    meta = META | {"split": "test"}
    io.write_run(_records(test, "score_a", "test"), meta, path, AT_A, "validation")
    try:
        with commit.new_version(spark, path) as folder:
            io.write_jsonl(_records(test, "score_b", "test"), f"{folder}/records")
            raise Stopped
    except Stopped:
        first = held(io.read_run(spark, path)[0])
    io.write_run(_records(test, "score_b", "test"), meta, path, 4.0, "validation")
    second = io.read_run(spark, path)[0]
    shown = lambda df, name: df.select("sample_id", "score", "pred_label", F.lit(name).alias("version"))
    return shown(first, "first").unionByName(shown(second, "second"))


@q("l15_pair_costs", sql("samples", "SELECT unit, round(t, 6) AS total_runtime_s, round(t / n, 9) AS mean_runtime_s, g AS n_generations FROM (SELECT 'pair' AS unit, sum(c) AS t, count(*)::BIGINT * 10 AS g FROM (SELECT max(score_a) FILTER (label = 0) / 1000 AS c FROM samples WHERE split = 'test' GROUP BY pair_id)), (SELECT count(*) AS n FROM samples WHERE split = 'test')"))
def _(spark, d):
    """Costs that a run's sidecar calls a pair's stand on both its records and count once."""
    test, path = views.samples(spark, d).filter("split = 'test'"), _folder(spark, "costs")
    cost = test.filter("label = 0").select("pair_id", (F.col("score_a") / 1000).alias("latency_s"))
    rows = test.join(cost, "pair_id").withColumns({"n_generations": F.lit(10), "extra": F.to_json(F.struct("pair_id"))})
    io.write_run(_records(rows, "score_a", "test"), META | {"split": "test", "extra": '{"generation_statistics_unit": "pair"}'}, path, AT_A, "validation")
    out = report.evaluate_run(io.read_run(spark, path), test, replicates=0)["efficiency"]
    return out.select("unit", F.round("total_runtime_s", 6).alias("total_runtime_s"), F.round("mean_runtime_s", 9).alias("mean_runtime_s"), F.col("n_generations").cast("long").alias("n_generations"))


# --- resuming -------------------------------------------------------------------------------
@q("l8_a11_exactly_once", sql("plain", "SELECT sample_id, score_a AS score, CASE WHEN o_orderkey % 5 < 2 THEN 'one' WHEN o_orderkey % 5 < 4 THEN 'two' ELSE 'three' END AS by FROM plain"))
def _(spark, d):
    """Batches with repeated rows: one is replayed, one overlaps the one before, one stops and is
    run again, and one runs while another finishes part of its keys."""
    rows, path = held(views.plain_samples(spark, d).select("sample_id", F.col("score_a").alias("score"), (F.col("o_orderkey") % 5).alias("k"))), _folder(spark, "done")
    scored = lambda name: lambda df: df.select("sample_id", "score", F.lit(name).alias("by"))
    twice = rows.unionByName(rows)
    resume.resume(twice.filter("k < 2"), path, "sample_id", scored("one"), "batch:0")
    resume.resume(twice.filter("k < 4"), path, "sample_id", scored("replayed"), "batch:0")
    try:
        resume.resume(rows.filter("k < 4"), path, "sample_id", _stops, "batch:1")
    except Stopped:
        pass

    def meets(df):
        resume.resume(rows.filter("k in (1, 3)"), path, "sample_id", scored("two"))
        return scored("two")(df)

    resume.resume(twice.filter("k < 4"), path, "sample_id", meets, "batch:1")
    commit.FinishedTable(spark, path, "sample_id").compact()
    return resume.resume(rows, path, "sample_id", scored("three"), "batch:2")


@q("r2_two_states", sql("plain", "SELECT sample_id, 'answer ' || o_orderpriority AS text, length('answer ' || o_orderpriority)::DOUBLE AS score, 'scored' AS state FROM plain"))
def _(spark, d):
    """Rows are generated, the run stops before they are scored, and is taken up again."""
    work = held(views.plain_samples(spark, d).select("sample_id", "o_orderpriority", F.lit("c").alias("config_hash")))
    schema = io.schema_of("sample_id string, config_hash string, text string, score double, state string")
    table = commit.StateTable(spark, _folder(spark, "states"), schema, "sample_id", ("generated", "scored"))
    generate = lambda df: df.withColumn("text", F.concat(F.lit("answer "), "o_orderpriority"))
    try:
        resume.run_states(work, table, generate, _stops, ["config_hash"])
    except Stopped:
        pass
    resume.run_states(work, table, _none_left, lambda df: df.withColumn("score", F.length("text").cast("double")), ["config_hash"], parts=2)
    return table.rows().select("sample_id", "text", "score", "state")


def _none_left(rows):
    """Generating again would be an error: everything was generated before the stop."""
    return rows.withColumn("text", F.raise_error(F.lit("generated twice")).cast("string"))


# --- loaders and manifests ------------------------------------------------------------------
def _loadable(spark, d):
    s = views.samples(spark, d)
    answer = F.concat(F.lit("answer "), F.col("o_orderpriority"))
    return s.select(
        F.concat_ws("_", F.concat(F.lit("S"), F.lpad(F.substring("pair_id", 2, 9), 9, "0")), "label").alias("sample_id"), "pair_id", "split", F.lit("en").alias("language"), F.col("sample_id").alias("question"), F.lit("k").alias("knowledge"), answer.alias("answer"), "label", F.length(answer).alias("answer_length_chars"),
    )


@q("a4_a7_a8_load_splits", sql("samples", "SELECT split, label, count(*) AS n, sum(length('answer ' || o_orderpriority))::BIGINT AS chars FROM samples GROUP BY 1, 2"))
def _(spark, d):
    """Splits written as JSON lines and loaded under their manifest and content hashes."""
    rows, path = held(_loadable(spark, d)), _folder(spark, "splits")
    for split in ("train", "validation", "test"):
        io.write_jsonl(rows.filter(F.col("split") == split).drop("split"), f"{path}/{split}.jsonl")
    hashes = {s: io.content_hash(spark, f"{path}/{s}.jsonl") for s in ("train", "validation", "test")}
    found = io.load_all(spark, path, splits.manifest(rows), hashes)
    return found.groupBy("split", "label").agg(F.count("*").alias("n"), F.sum("answer_length_chars").alias("chars"))


@q("h4_v10_reproduce_manifest", sql("samples", """SELECT split, only_in, count(*) AS n FROM (SELECT o.split, 'old' AS only_in FROM splits o JOIN other n USING (pair_id) WHERE o.split <> n.split UNION ALL SELECT n.split, 'new' FROM splits o JOIN other n USING (pair_id) WHERE o.split <> n.split) GROUP BY ALL""",
  "again AS (SELECT pair_id, row_number() OVER (ORDER BY sha256('43:' || pair_id), pair_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT pair_id FROM plain))",
  "other AS (SELECT pair_id, CASE WHEN pos < ceil(0.1 * n)::BIGINT THEN 'test' WHEN pos < ceil(0.1 * n)::BIGINT + ceil(0.1::DOUBLE / 0.9::DOUBLE * (n - ceil(0.1 * n)::BIGINT))::BIGINT THEN 'validation' ELSE 'train' END AS split FROM again)"))
def _(spark, d):
    """The split made again from its seed gives its manifest; from another seed, pairs move between splits."""
    pairs = views.plain_samples(spark, d).filter("label = 0").select("pair_id", F.substring("pair_id", 2, 9).cast("long").alias("pair_no"), F.lit("a").alias("right_answer"), F.lit("b").alias("hallucinated_answer"))
    path = _folder(spark, "manifest")
    protocol.build_manifest(splits.expand_pairs(pairs.join(splits.split_pairs(pairs, "pair_id", 42), "pair_id")), path)
    require_none(protocol.reproduce_manifest(pairs, path, 42), "the split isn't reproduced")
    return protocol.reproduce_manifest(pairs, path, 43).groupBy("split", "only_in").agg(F.count("*").alias("n"))


@q("f13_a15_first_in_file_order", "SELECT norm, doc_id FROM (SELECT trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')) AS norm, doc_id, place FROM (SELECT *, row_number() OVER () AS place FROM documents)) QUALIFY row_number() OVER (PARTITION BY norm ORDER BY place) = 1")
def _(spark, d):
    """The document of each normalised text that stands first in its file."""
    rows = io.parquet_placed(spark, f"{d}/documents.parquet")
    norm = rows.select("doc_id", "place", F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r]+", " ")).alias("norm"))
    return splits.first_of(norm, ["norm"], "place", ["doc_id"]).select("norm", "doc_id")


@q("a13_a14_a19_features", "SELECT layer::INTEGER AS layer, count(*) AS n, round(sum(list_sum(embedding[layer * 16 + 1:layer * 16 + 16]::DOUBLE[])), 6) AS total FROM embeddings, (SELECT unnest(range(4)) AS layer) GROUP BY 1")
def _(spark, d):
    """Feature chunks written in two goes, the second with chunks that are there already, and read under their rules."""
    rows = views.features(spark, d).withColumns({"chunk": (F.col("sample_id") % 3).cast("int"), "config_hash": F.lit("c"), "prompt_version": F.lit("p")})
    path = _folder(spark, "features")
    io.append_features(rows.filter("chunk < 2"), path)
    io.append_features(rows, path)
    found = io.check_features(io.read_features(spark, path), rows.select("sample_id", "label").distinct())
    total = F.round(F.sum(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)), 6)
    return found.groupBy("layer").agg(F.count("*").alias("n"), total.alias("total"))


# --- protocol -------------------------------------------------------------------------------
class Steps:
    """A detector whose epochs score by one column after the other."""

    columns = ("score_b", "score_a", "length")

    def __init__(self, spark):
        self.spark = spark

    def train(self, setting, train, validation, folder):
        for epoch, c in enumerate(self.columns):
            io.write_text(self.spark, f"{folder}/{epoch}.txt", c)
            yield epoch, self.score(setting, f"{folder}/{epoch}.txt", validation), f"{folder}/{epoch}.txt"

    def score(self, setting, checkpoint, rows):
        return rows.select("sample_id", F.col(io.read_text(self.spark, checkpoint)).cast("double").alias("score"))


def _protocol_sql() -> str:
    val, test = "split = 'validation'", "split = 'test'"
    parts = []
    for k, c in enumerate(Steps.columns):
        parts.append(f"SELECT {k} AS epoch, (SELECT auroc FROM ({_area(c, 'samples', val)})) AS area, (WITH cand AS ({_candidates(c, 'samples', val)}) SELECT {_choose(_YOUDEN)}) AS threshold, (SELECT auroc FROM ({_area(c, 'samples', test)})) AS auroc")
    return sql("samples", f"SELECT epoch, threshold, round(auroc, 9) AS test_auroc FROM ({' UNION ALL '.join(parts)}) ORDER BY area DESC, epoch LIMIT 1")


@q("l14_r7_r8_select_then_test_once", _protocol_sql())
def _(spark, d):
    """The epoch and threshold that validation chooses, and what test then says."""
    s, folder = held(views.samples(spark, d)), _folder(spark, "protocol")
    part = lambda name: s.filter(F.col("split") == name)
    chosen = protocol.select_and_freeze(Steps(spark), [{}], part("train"), part("validation"), folder, META)
    out = protocol.test_frozen(Steps(spark), folder, part("test"), part("validation"), replicates=0)
    area = out["metrics"].filter("split = 'test'").select(F.round("auroc", 9).alias("test_auroc"))
    return area.select(F.lit(chosen["step"]["epoch"]).alias("epoch"), F.lit(chosen["cutoff"]["value"]).alias("threshold"), "test_auroc")


@q("r3_v7_entropy_run", sql("generation_groups", "SELECT pair_id || '_' || y AS sample_id, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 9) + 0.0 AS score, 'pair' AS unit FROM (SELECT user_id || '.' || group_no AS pair_id, list_transform(list_distinct(answers), lambda a: len(list_filter(answers, lambda x: x = a)) / len(answers)) AS p FROM generation_groups WHERE complete), (VALUES (0), (1)) s(y)"))
def _(spark, d):
    """Generations through two states to records of both entropy detectors, written as runs and read again."""
    g = views.generation_groups(spark, d).filter("complete").withColumn("pair_id", F.concat_ws(".", "user_id", "group_no"))
    two = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), a.alias("answer")) for y, a in ((0, F.col("candidate")), (1, F.lit("other")))])).alias("e")
    samples = held(g.select("pair_id", two).select(F.concat_ws("_", "pair_id", "e.y").alias("sample_id"), "pair_id", "e.answer"))
    folder = _folder(spark, "entropy")
    records.run_entropy(g.select("pair_id", "answers"), samples, folder, META | {"split": "validation"})
    made, meta = io.read_run(spark, io.run_path(folder, records.GLOBAL, META["variant"], "validation"))
    unit = F.get_json_object(F.lit(meta.first().extra), "$.generation_statistics_unit")
    return made.select("sample_id", F.round("score", 9).alias("score"), unit.alias("unit"))


# --- drivers --------------------------------------------------------------------------------
def _tidy(value: str) -> str:
    return f"nfc_normalize(trim(regexp_replace({value}, '{WSQL}+', ' ', 'g')))"


def _raw(spark, d):
    pairs = views.raw_pairs(spark, d)
    return pairs.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_no"), F.lit("known").alias("knowledge"), "question", F.col("answer").alias("right_answer"), F.when(F.col("conv_id") % 7 == 0, F.lit(" \t")).otherwise(F.concat(F.lit("not "), "answer")).alias("hallucinated_answer"))


@q("r1_prepare_dataset", sql("raw_pairs", f"""SELECT split, label, count(*) AS n, sum(length(answer))::BIGINT AS chars FROM (SELECT split, y::INTEGER AS label, {_tidy("CASE y WHEN 0 THEN answer ELSE 'not ' || answer END")} AS answer FROM placed, (VALUES (0), (1)) v(y)) GROUP BY 1, 2""",
  f"valid AS (SELECT printf('P%05d', conv_id * 1000 + turn) AS pair_id, answer FROM raw_pairs WHERE conv_id % 7 <> 0 AND regexp_matches(question, '[^{WSQL[1:-1]}]') AND regexp_matches(answer, '[^{WSQL[1:-1]}]'))",
  "ranked AS (SELECT *, row_number() OVER (ORDER BY sha256('42:' || pair_id), pair_id) - 1 AS pos, count(*) OVER () AS n FROM valid)",
  "sized AS (SELECT *, ceil(0.1 * n)::BIGINT AS n_test FROM ranked)",
  "placed AS (SELECT *, CASE WHEN pos < n_test THEN 'test' WHEN pos < n_test + ceil(0.1::DOUBLE / 0.9::DOUBLE * (n - n_test))::BIGINT THEN 'validation' ELSE 'train' END AS split FROM sized)"))
def _(spark, d):
    """Raw pairs to cleaned, split, expanded samples that are written with a manifest and loaded again."""
    found = drivers.prepare_dataset(_raw(spark, d), _folder(spark, "dataset"))
    return found.groupBy("split", "label").agg(F.count("*").alias("n"), F.sum(F.length("answer")).alias("chars"))


@q("r5_v9_threshold_artifact", sql("samples", " UNION ALL ".join(f"SELECT '{c}' AS detector, (WITH cand AS ({_candidates(c, 'samples', 'split = ' + chr(39) + 'validation' + chr(39))}) SELECT {_choose(_YOUDEN)}) AS threshold" for c in ("score_a", "score_b"))))
def _(spark, d):
    """Thresholds chosen on validation, written as an artefact and read under its rules."""
    val = views.samples(spark, d).filter("split = 'validation'")
    long = val.select("sample_id", "label", F.explode(F.array(*[F.struct(F.lit(c).alias("detector"), F.col(c).alias("score")) for c in ("score_a", "score_b")])).alias("e")).select("sample_id", "label", "e.*")
    path = f"{_folder(spark, 'thresholds')}/thresholds.json"
    drivers.write_thresholds(held(long), path, "c", "p")
    found = protocol.frozen_thresholds(drivers.read_artifact(spark, path), ["score_a", "score_b"], "c", "p")
    return spark.createDataFrame(sorted(found.items()), "detector string, threshold double")


@q("r9_probe_run")
def _(spark, d):
    """Layer probes fitted on train; the best layer's probabilities as runs; what test says of them."""
    features = held(views.features(spark, d).withColumn("sample_id", F.col("sample_id").cast("string")))
    fifth = F.pmod(F.xxhash64("sample_id"), F.lit(5))
    samples = held(features.select("sample_id", "label").distinct().withColumn("split", F.when(fifth == 0, "test").when(fifth == 1, "validation").otherwise("train")))
    folder = _folder(spark, "probe")
    table = drivers.run_layer_probe(features, samples, folder, META)
    test = io.read_run(spark, io.run_path(folder, META["detector"], META["variant"], "test"))[0]
    rates = metrics.metrics(test.join(samples, "sample_id"), [], "pred_label").select("n", "accuracy", "precision", "recall", "f1")
    return table.filter("is_best").select("layer", F.col("auroc").alias("validation_auroc"), "threshold").join(F.broadcast(rates))


@q("v11_control_gate", sql("text_samples", f"""SELECT gate, round(value, 9) AS value, CASE gate WHEN 'random AUROC' THEN abs(value - 0.5) < 0.05 WHEN 'length AUROC' THEN value > 0.5 ELSE value < 0.65 END AS ok FROM
  (SELECT 'random AUROC' AS gate, (SELECT auroc FROM ({_area('s', 'random')})) AS value UNION ALL SELECT 'length AUROC', (SELECT auroc FROM ({_area('length', 'random')})) UNION ALL SELECT 'controlled length AUROC', (SELECT auroc FROM ({_area('length', 'part')})))""",
  "random AS (SELECT *, ('0x' || substr(sha256('42:' || doc_id || ':0'), 1, 8))::BIGINT::DOUBLE AS s FROM text_samples)",
  "numbered AS (SELECT doc_id, label, length, row_number() OVER (PARTITION BY label, length ORDER BY doc_id::VARCHAR) AS k FROM text_samples)",
  "part AS (SELECT label, length FROM numbered QUALIFY count(*) OVER (PARTITION BY length, k) = 2)"))
def _(spark, d):
    """Gates of a smoke run with the control set of equal lengths: there, length alone must say little."""
    rows = held(views.text_samples(spark, d).select(F.col("doc_id").cast("string").alias("sample_id"), F.col("doc_id").cast("string").alias("pair_id"), "label", "length"))
    named = matching.matched_rows(matching.optimal_matches(rows, 0), rows, 0)
    found = drivers.smoke_gates(rows, named).filter("gate <> 'random pair accuracy'")  # documents have no pairs
    return found.select("gate", F.round("value", 9).alias("value"), "ok")


@q("r12_leakage_audit", sql("docs", """SELECT scope, count(*) AS n, count(DISTINCT pair_id) AS n_pairs FROM (SELECT 'all' AS scope, pair_id FROM docs WHERE split = 'test' UNION ALL SELECT 'without_norm', pair_id FROM docs WHERE split = 'test' AND pair_id NOT IN (SELECT pair_id FROM docs WHERE split = 'test' AND norm IN (SELECT norm FROM docs WHERE split = 'train'))
  UNION ALL SELECT 'without_any', pair_id FROM docs WHERE split = 'test' AND pair_id NOT IN (SELECT pair_id FROM docs WHERE split = 'test' AND norm IN (SELECT norm FROM docs WHERE split = 'train'))) GROUP BY 1"""))
def _(spark, d):
    """How many test rows and pairs are left without texts that stand in train."""
    docs = held(views.documents_split(spark, d).withColumn("score", F.length("norm").cast("double")))
    found = drivers.leakage_audit(docs.filter("split = 'test'"), docs.filter("split = 'train'"), ("norm",))
    return found.select("scope", "n", "n_pairs")


@q("r6_controlled_report", sql("text_samples", """SELECT length AS chars, least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS matches FROM text_samples GROUP BY 1 HAVING count(*) FILTER (label = 0) > 0 AND count(*) FILTER (label = 1) > 0"""))
def _(spark, d):
    """The control set of equal lengths, written with its report, checked and read again."""
    t = views.text_samples(spark, d)
    test = t.select(F.format_string("S%09d_%d", "doc_id", "label").alias("sample_id"), F.col("doc_id").cast("string").alias("pair_id"), "label", F.col("text").alias("answer"), F.length("text").alias("answer_length_chars"))
    rows, _ = drivers.write_controlled_set(held(test), _folder(spark, "controlled"), 0)
    return rows.groupBy(F.length("answer").alias("chars")).agg((F.count("*") / 2).cast("long").alias("matches"))


@q("a17_csv_table", sql("samples", "SELECT split, label, count(*) AS n, round(avg(score_a), 6) AS mean_a FROM samples GROUP BY 1, 2"))
def _(spark, d):
    """A summary written as CSV with a header, and read again."""
    path = _folder(spark, "csv")
    io.write_csv(views.samples(spark, d).groupBy("split", "label").agg(F.count("*").alias("n"), F.round(F.avg("score_a"), 6).alias("mean_a")), path)
    return spark.read.schema("split string, label int, n long, mean_a double").option("header", True).csv(path)


@q("b14_config_hashes", """SELECT s_suppkey, substr(sha256('{"key":' || s_suppkey || ',"model":{"name":"' || s_name || '","nation":' || s_nationkey || '}}'), 1, 12) AS hash FROM supplier""")
def _(spark, d):
    """Hashes of the configurations that the suppliers' rows spell out."""
    row = views.table(spark, d, "supplier")

    @F.pandas_udf("string")
    def hashed(key: pd.Series, name: pd.Series, nation: pd.Series) -> pd.Series:
        return pd.Series([io.config_hash({"model": {"nation": int(n), "name": s}, "key": int(k), "paths": {"here": s}}) for k, s, n in zip(key, name, nation)])

    return row.select("s_suppkey", hashed("s_suppkey", "s_name", "s_nationkey").alias("hash"))


QUERIES, ORACLE_SQL = R.queries, R.sql
