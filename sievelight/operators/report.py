"""Evaluation of a detector as one set of small frames.

``scored`` frames hold samples of one split with their scores: sample_id, pair_id,
label, length, score, and where known question, answer, pred_label and the costs
latency_s, n_generations, n_generated_tokens, peak_gpu_mem_mb. All sections are
aggregates over validation and test together, each in one pass.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.commit import exists
from ..sources.shared import held
from . import bootstrap, metrics, resampling
from .leakage import align, coverage
from .validate import DataIntegrityError, field_of, latency, require_none, run_violations, score_rules, violations

#: What must agree between the validation and the test run of a detector.
PROVENANCE = ("detector", "variant", "config_hash", "prompt_version")
#: AUROC below which a score seems inverted.
INVERTED = 0.45
SEEDS = {"validation": 42, "test": 43, "length_controlled": 44}


def usable_scores(records: DataFrame) -> DataFrame:
    """Records with latency_s (or the older runtime_sec); repeated ids, scores that aren't finite and labels beyond 0 and 1 are errors."""
    require_none(violations(records, score_rules()), "unusable scores")
    require_none(records.groupBy("sample_id").count().filter("count > 1"), "repeated ids")
    return records.withColumn("latency_s", latency(records)) if "runtime_sec" in records.columns else records


def efficiency(scored: DataFrame, unit: str = "sample") -> DataFrame:
    """One row of test costs. With ``unit='pair'`` a cost stands on both rows of a pair and counts
    once; the mean runtime is then over all rows, else over those that have one."""
    if unit not in ("sample", "pair"):
        raise ValueError("unit must be 'sample' or 'pair'")
    costs = [c for c in ("latency_s", "n_generations", "n_generated_tokens", "peak_gpu_mem_mb")]
    rows = scored.withColumns({c: F.lit(None).cast("double") for c in costs if c not in scored.columns})
    items = rows if unit == "sample" else rows.groupBy("cost_pair" if "cost_pair" in rows.columns else "pair_id").agg(F.min(F.struct(*costs)).alias("c")).select("c.*")
    total = items.agg(F.sum("latency_s").alias("total_runtime_s"), F.count("latency_s").alias("_timed"), F.sum("n_generations").alias("n_generations"), F.sum("n_generated_tokens").alias("n_generated_tokens"), F.max("peak_gpu_mem_mb").alias("peak_gpu_mem_mb"))
    over = F.col("_rows") if unit == "pair" else F.col("_timed")
    return total.join(F.broadcast(scored.agg(F.count("*").alias("_rows")))).select(
        F.lit(unit).alias("unit"), "total_runtime_s", F.try_divide("total_runtime_s", over).alias("mean_runtime_s"), "n_generations", "n_generated_tokens", "peak_gpu_mem_mb"
    )


def evaluate_detector(
    test: DataFrame, validation: DataFrame | None = None, threshold: float | None = None, criterion: str = "youden", controlled: DataFrame | None = None, bins: int = 4, top_k: int = 10,
    replicates: int = 1000, unit: str = "sample", hold=held, draw: str = "tree",
) -> dict[str, DataFrame]:
    """Frames of a detector's report.

    threshold (value, criterion, selected_on), metrics, native_metrics (of records that carry
    their own labels), pair_level, strata, curve, outcomes, worst, intervals, match_level,
    efficiency and warnings; each has a ``split`` where it has several. The threshold is given
    or selected on validation, never on test, and length bins come from validation where there
    is one. ``controlled`` has match_id and is a part of test. ``hold`` stores frames that
    are read several times. ``draw`` is how intervals resample (``resampling``: tree or sequence);
    without ``replicates`` there are none.
    """
    spark = test.sparkSession
    if threshold is None:
        if validation is None:
            raise ValueError("give a threshold, or validation scores to select it on")
        chosen = metrics.select_threshold(metrics.threshold_candidates(metrics.score_groups(validation, [])), [], criterion).first()
        threshold, source = chosen.threshold, (criterion, "validation")
    else:
        source = ("frozen_given", "provided")
    splits = {"validation": validation, "test": test}
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("split", F.lit(s)) for s, df in splits.items() if df is not None])
    every = hold(every.withColumn("pred", metrics.predicted(F.col("score"), F.lit(threshold))))
    own = every.filter("split = 'test'")
    by = ["split"]

    def measured(df: DataFrame, by: list[str], pred: str = "pred") -> DataFrame:
        return metrics.metrics(df, by, pred).join(metrics.auroc(df, by), by)

    one = lambda y: F.max(F.when(F.col("label") == y, F.col("score")))
    rows = lambda y: F.sum((F.col("label") == y).cast("int"))
    whole = ((rows(0) == 1) & (rows(1) == 1) & (F.count("*") == 2)).alias("complete")
    paired = metrics.require_complete(every.groupBy("split", "pair_id").agg(one(0).alias("factual"), one(1).alias("hallucinated"), whole))
    edges = metrics.length_edges(validation if validation is not None else test, bins=bins)
    out = {
        "threshold": spark.createDataFrame([(float(threshold), *source)], "threshold double, criterion string, selected_on string"),
        "metrics": measured(every, by),
        "pair_level": metrics.pair_accuracy(paired, by),
        "strata": metrics.stratified(every, edges, by=by),
        "curve": metrics.threshold_curve(every, by=by),
        "outcomes": metrics.error_lengths(every, by=by),
        "worst": reduce(DataFrame.unionByName, [metrics.worst_errors(every.filter(F.col("split") == s), top_k) for s, df in splits.items() if df is not None]),
        "efficiency": efficiency(own, unit),
    }
    if "pred_label" in every.columns:
        native = every.groupBy("split").agg(F.min(F.col("pred_label").isNotNull().cast("int")).alias("_all")).filter("_all = 1").select("split")
        out["native_metrics"] = measured(every.join(F.broadcast(native), "split"), by, "pred_label")
    sets = [(s, df, "pair_id") for s, df in splits.items() if df is not None]
    if controlled is not None:
        part = controlled.select("sample_id", "match_id").join(own.drop("match_id"), "sample_id", "left")
        require_none(part.filter("score is null").select("sample_id"), "controlled samples without a score")
        out["metrics"] = out["metrics"].unionByName(measured(part.withColumn("split", F.lit("length_controlled")), by))
        matched = metrics.require_complete(metrics.pairs(part, "match_id"), "match")
        out["match_level"] = metrics.pair_accuracy(matched).withColumnsRenamed({"n_pairs": "n_matches", "pair_accuracy": "match_accuracy"})
        sets.append(("length_controlled", part, "match_id"))
    if replicates > 0:
        parts = []
        for name, df, cluster in sets:
            wide = hold(bootstrap.pair_table(df, cluster, ["score"]))
            reps = hold(resampling.replicates(wide, {"score": threshold}, resampling.Draw(wide.count(), replicates, SEEDS[name], draw))).drop("detector")
            parts.append(bootstrap.intervals(reps, bootstrap.ALL_METRICS).select(F.lit(name).alias("split"), "*"))
        out["intervals"] = reduce(DataFrame.unionByName, parts)
    low = out["metrics"].filter((F.col("split") == "test") & (F.col("auroc") < INVERTED)).select(F.format_string("test AUROC %.3f is well below 0.5: the score may be inverted", "auroc").alias("warning"))
    untimed = out["efficiency"].filter("total_runtime_s is null").select(F.lit("no runtimes in the records").alias("warning"))
    out["warnings"] = low.unionByName(untimed)
    return out


def cost_unit(records: DataFrame, extra: str | None) -> tuple[str, str | None]:
    """Whose costs the records carry, as the sidecar's ``extra`` says, and a warning if it can't be
    followed: costs of a pair stand on both its records and count once by the pair their own
    ``extra`` names. A record that names none leaves only counting each."""
    if field_of(json.loads(extra or "{}"), "generation_statistics_unit") != "pair":
        return "sample", None
    if records.filter(F.get_json_object("extra", "$.pair_id").isNull()).isEmpty():
        return "pair", None
    return "sample", "costs of pairs, but records name no pair_id: each record's costs are counted, which overstates them"


def evaluate_run(
    test: tuple[DataFrame, DataFrame], test_samples: DataFrame, validation: tuple[DataFrame, DataFrame] | None = None, validation_samples: DataFrame | None = None, threshold: float | None = None,
    controlled: DataFrame | None = None, controlled_path: str | None = None, **options,
) -> dict[str, DataFrame]:
    """:func:`evaluate_detector` of runs as ``sources.io.read_run`` gives them: (records, sidecar).

    Runs must be valid, of the right split, cover their samples exactly and agree in
    provenance. The threshold is the argument, else the test run's own, else selected on validation.
    The sidecar says whether costs are a pair's. The controlled set is the argument, else what
    lies at ``controlled_path``, checked against test; if nothing lies there a warning says so."""
    spark = test_samples.sparkSession
    scored, source, warned = {}, None, []
    sides = {"test": test[1].first()}
    for split, run, samples in (("test", test, test_samples), ("validation", validation, validation_samples)):
        if run is None:
            continue
        records, side = run[0], run[1].first()
        sides[split] = side
        if side["split"] != split:
            raise DataIntegrityError(f"a {side['split']} run where {split} is expected")
        require_none(run_violations(records, run[1]), f"invalid {split} run")
        require_none(coverage(samples, records), f"{split} samples and records differ")
        keep = [c for c in ("score", "pred_label", "latency_s", "runtime_sec", "n_generations", "n_generated_tokens", "peak_gpu_mem_mb") if c in records.columns]
        rows = records.select("sample_id", *keep, F.get_json_object("extra", "$.pair_id").alias("cost_pair"))
        scored[split] = align(samples, usable_scores(rows), check=False)
    if validation is not None:
        differ = [k for k in PROVENANCE if sides["validation"][k] != sides["test"][k]]
        if differ:
            raise DataIntegrityError("validation and test runs differ in " + ", ".join(differ))
    if threshold is None and sides["test"]["threshold"] is not None:
        threshold, source = sides["test"]["threshold"], ("stored_in_run_meta", sides["test"]["threshold_source"])
    if "unit" not in options:
        options["unit"], said = cost_unit(test[0], sides["test"]["extra"])
        warned += [said] if said else []
    if controlled is None and controlled_path is not None:
        if exists(spark, controlled_path):
            from ..sources.io import SAMPLE, load_controlled, read_jsonl

            controlled = load_controlled(read_jsonl(spark, controlled_path, SAMPLE), test_samples)
        else:
            warned.append("length-controlled set not found: left out")
    out = evaluate_detector(scored["test"], scored.get("validation"), threshold, controlled=controlled, **options)
    if source:
        out["threshold"] = out["threshold"].withColumns({"criterion": F.lit(source[0]), "selected_on": F.lit(source[1])})
    if warned:
        out["warnings"] = spark.createDataFrame([(w,) for w in warned], "warning string").unionByName(out["warnings"])
    return out
