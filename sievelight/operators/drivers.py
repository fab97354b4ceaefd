"""Chains of operators that end in something written: datasets, thresholds, probe runs,
controlled sets with their report, leakage audits, and the gates of a smoke run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, normalized
from ..sources import io
from ..sources.commit import new_version, version_folder
from ..sources.shared import held
from . import leakage, matching, metrics, probe
from .protocol import build_manifest, records_of
from .splits import expand_pairs, split_pairs
from .validate import SPLITS, require_none, valid_raw

TEXTS = ("knowledge", "question", "right_answer", "hallucinated_answer")


def prepare_dataset(raw: DataFrame, folder: str, seed: int = 42, language: str = "en") -> DataFrame:
    """Raw pairs (pair_no and the four texts) to samples: pairs with a blank text go, texts are
    cleaned, pairs are split and expanded; the splits as JSON lines and their manifest are committed
    below ``folder``. Returns the samples as they were written."""
    spark = raw.sparkSession
    tidy = valid_raw(raw, TEXTS).select("pair_no", *[clean(F.col(c)).alias(c) for c in TEXTS])
    pairs = tidy.select(F.format_string("P%05d", "pair_no").alias("pair_id"), F.lit(language).alias("language"), "*")
    samples = held(expand_pairs(pairs.join(split_pairs(pairs, "pair_id", seed), "pair_id")).drop("pair_no"))
    with new_version(spark, f"{folder}/splits") as version:
        for split in SPLITS:
            io.write_jsonl(samples.filter(F.col("split") == split), f"{version}/{split}.jsonl")
    build_manifest(samples, f"{folder}/manifest")
    return io.load_all(spark, version_folder(spark, f"{folder}/splits"), spark.read.parquet(version_folder(spark, f"{folder}/manifest")))


def write_thresholds(scored: DataFrame, path: str, config_hash: str, prompt_version: str) -> dict:
    """Youden thresholds of each ``detector`` of validation rows (detector, sample_id, label, score),
    as the artefact that ``protocol.frozen_thresholds`` reads, written to ``path``."""
    chosen = metrics.select_threshold(metrics.threshold_candidates(metrics.score_groups(scored, ["detector"])), ["detector"])
    rates = metrics.metrics(scored.join(F.broadcast(chosen.select("detector", "threshold")), "detector").withColumn("pred", metrics.predicted(F.col("score"), F.col("threshold"))), ["detector", "threshold"])
    blocks = {r.detector: {"selected_on": "validation", "threshold": r.threshold, "accuracy": r.accuracy, "precision": r.precision, "recall": r.recall, "f1": r.f1} for r in rates.collect()}
    # fixed values: the fields of the artefact
    artifact = {"split": "validation", "test_data_loaded": False, "criterion": "youden", "config_hash": config_hash, "prompt_version": prompt_version, "thresholds": blocks}
    io.write_text(scored.sparkSession, path, json.dumps(artifact, sort_keys=True))
    return artifact


def read_artifact(spark: SparkSession, path: str) -> dict:
    return json.loads(io.read_text(spark, path))


def run_layer_probe(features: DataFrame, samples: DataFrame, folder: str, meta: dict, c: float = 1.0) -> DataFrame:
    """Fit a probe on each layer of the train features, take the layer of best validation AUROC (the
    first on ties) and the threshold of best validation F1 (the highest on ties), and write the
    validation and test runs of its probabilities. Returns (layer, auroc, is_best, threshold).

    ``features`` must have exactly the ids and labels of ``samples`` (sample_id, split, label)."""
    io.check_features(features, samples)
    rows = features.drop("label", "split").join(samples.select("sample_id", "split", "label"), "sample_id")
    _, scored = probe.layer_probes(rows, F.col("split") == "train", c)
    scored = held(scored.select("sample_id", "split", "label", "layer", (1 / (1 + F.exp(-F.col("score")))).alias("score")))
    table = probe.layer_table(scored.filter("split = 'validation'"))
    best = table.filter("is_best").first().layer
    mine = scored.filter(F.col("layer") == best)
    groups = metrics.score_groups(mine.filter("split = 'validation'"), [])
    threshold = metrics.select_threshold(metrics.score_thresholds(groups, []), [], "f1", "highest", "zero").first().threshold
    for split in ("validation", "test"):
        run = records_of(mine.filter(F.col("split") == split), split, meta["detector"], meta["variant"], meta["config_hash"], meta["prompt_version"])
        about = meta | {"split": split, "extra": json.dumps({"layer": best})}
        io.write_run(run, about, io.run_path(folder, meta["detector"], meta["variant"], split), threshold, "validation")
    return table.withColumn("threshold", F.when(F.col("is_best"), F.lit(threshold)))


def write_controlled_set(test: DataFrame, folder: str, delta: int = 1) -> tuple[DataFrame, str]:
    """The length-controlled part of ``test``, committed below ``folder``; what is read back is checked
    and told in a Markdown report beside it. Returns both."""
    spark = test.sparkSession
    made = held(matching.controlled_set(test, delta))
    with new_version(spark, f"{folder}/controlled") as version:
        io.write_jsonl(made, f"{version}/rows.jsonl")
    rows = io.read_jsonl(spark, f"{version_folder(spark, f'{folder}/controlled')}/rows.jsonl", made.schema)
    found = matching.artefact_checks(rows, test, delta, made.count()).collect()  # nine rows
    ends = rows.select("match_id", "label", "sample_id", F.length("answer").alias("length"))
    matches = metrics.pairs(ends, "match_id", "length").select("match_id", F.abs(F.col("factual") - F.col("hallucinated")).cast("int").alias("gap"))
    ids = ends.groupBy("match_id").agg(*[F.max(F.when(F.col("label") == y, F.col("sample_id"))).alias(f"id{y}") for y in (0, 1)])
    words = test.select("sample_id", "label", F.length("answer").alias("length"), F.size(F.split(F.trim("answer"), r"\s+")).alias("words"))
    summary = matching.match_summary(matches.join(ids, "match_id"), words).first().asDict()
    line = lambda k: f"| {k} | {'' if summary[k] is None else f'{summary[k]:.3f}' if isinstance(summary[k], float) else summary[k]} |"
    report = "\n".join(
        ["# Length-controlled set", "", f"Matches within {delta} character(s): as many as possible, then of least total gap.", "", "| | |", "|-|-|", *map(line, sorted(summary)), "", "| check | result | problems |", "|-|-|-|"]
        + [f"| {r.name} | {'pass' if r.ok else 'FAIL'} | {r.n_problems} |" for r in found]
    )
    io.write_text(spark, f"{folder}/report.md", report + "\n")
    require_none(spark.createDataFrame([(r.name,) for r in found if not r.ok], "check string"), "broken controlled set")
    return rows, report


def leakage_audit(scored: DataFrame, train: DataFrame, texts: tuple[str, ...] = ("question", "answer")) -> DataFrame:
    """(scope, n, n_pairs, auroc, pair_accuracy): test scores on all pairs, and without the pairs of
    which a text, normalised, also stands in train: each text by itself and all of them."""
    keys = lambda df: df.withColumns({f"_{c}": normalized(F.col(c)) for c in texts})
    without = {f"without_{c}": [f"_{c}"] for c in texts} | {"without_any": [f"_{c}" for c in texts]}
    rows = held(leakage.scopes(keys(scored), keys(train), without))
    counts = rows.groupBy("scope").agg(F.count("*").alias("n"), F.countDistinct("pair_id").alias("n_pairs"))
    one = lambda y: F.max(F.when(F.col("label") == y, F.col("score")))
    paired = rows.groupBy("scope", "pair_id").agg(one(0).alias("factual"), one(1).alias("hallucinated"), (F.count("*") == 2).alias("complete"))
    accuracy = metrics.pair_accuracy(paired, ["scope"]).select("scope", "pair_accuracy")
    return counts.join(metrics.auroc(rows, ["scope"]), "scope", "left").join(accuracy, "scope", "left")


def smoke_gates(test: DataFrame, controlled: DataFrame, seed: int = 42) -> DataFrame:
    """(gate, value, ok): random scores say nothing about test, length alone says something, and on the
    length-controlled rows (sample_id, match_id) it says little: AUROC below 0.65."""
    from ..functions.text import derived_seed

    rows = held(test.select("sample_id", "pair_id", "label", F.col("length").cast("double").alias("length"), derived_seed(seed, F.col("sample_id"), F.lit(0)).cast("double").alias("random")))
    part = rows.join(controlled.select("sample_id", "match_id"), "sample_id")
    area = lambda df, c, name: metrics.auroc(df, [], c).select(F.lit(name).alias("gate"), F.col("auroc").alias("value"))
    pair = metrics.pair_accuracy(metrics.pairs(rows, "pair_id", "random")).select(F.lit("random pair accuracy").alias("gate"), F.col("pair_accuracy").alias("value"))
    values = area(rows, "random", "random AUROC").unionByName(pair).unionByName(area(rows, "length", "length AUROC")).unionByName(area(part, "length", "controlled length AUROC"))
    v = F.col("value")
    # fixed values: how far each gate may be from what it should be
    ok = F.when(F.col("gate") == "random AUROC", F.abs(v - 0.5) < 0.05).when(F.col("gate") == "random pair accuracy", F.abs(v - 0.5) < 0.06).when(F.col("gate") == "length AUROC", v > 0.5).otherwise(v < 0.65)
    return values.withColumn("ok", F.coalesce(ok, F.lit(False)))

