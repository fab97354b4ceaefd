"""Detector records of entropy scores, from generations that a pair's samples share."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank, normalized_answer
from ..sources.io import RECORD
from .equivalence import Predict, clustered
from .semantic import first_fit, scored_candidate
from .validate import DataIntegrityError, record_violations, require_none

if TYPE_CHECKING:
    from ..sources.commit import StateTable

GLOBAL, CANDIDATE = "se_global", "se_candidate"
COSTS = ("latency_s", "n_generations", "n_generated_tokens", "peak_gpu_mem_mb")
#: What a sidecar says of costs that stand on both records of a pair.
PAIR_COSTS = '{"generation_statistics_unit": "pair"}'
#: A sample on its way: its pair's answers, then the clusters.
KEPT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("sample_id", "pair_id", "answer", "config_hash", "prompt_version", "split")]
    + [T.StructField("answers", T.ArrayType(T.StringType())), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    + [T.StructField(n, t) for n, t in (("latency_s", T.DoubleType()), ("n_generations", T.LongType()), ("n_generated_tokens", T.LongType()), ("peak_gpu_mem_mb", T.DoubleType()))]
    + [T.StructField("state", T.StringType())]
)


def candidates(generations: DataFrame, samples: DataFrame, predict: Predict | None = None, probabilities: DataFrame | None = None) -> DataFrame:
    """Samples (sample_id, pair_id, answer) with ``ids``, the clusters of their pair's answers and, last, of their own.

    Without a model answers are equal when their normalised texts are. A pair without
    generations, or with a blank one, and a blank candidate are errors."""
    require_none(samples.select("pair_id").distinct().join(generations.select("pair_id"), "pair_id", "left_anti"), "pairs without generations")
    require_none(generations.filter((F.size("answers") < 1) | F.exists("answers", is_blank)).select("pair_id"), "blank generations")
    require_none(samples.filter(is_blank(F.col("answer"))).select("sample_id"), "blank candidates")
    joined = samples.select("sample_id", "pair_id", "answer").join(generations, "pair_id")
    rows = joined.withColumn("answers", F.concat("answers", F.array("answer")))
    if predict is not None or probabilities is not None:
        return clustered(rows, "sample_id", predict, probabilities)
    each = rows.select("sample_id", F.posexplode("answers").alias("_i", "_t")).select("sample_id", "_i", normalized_answer(F.col("_t")).alias("_t"))
    tidy = each.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_t"))), lambda x: x["_t"]).alias("_tidy"))
    ids = first_fit(F.col("_tidy"), lambda a, b: a == b)
    return rows.join(tidy, "sample_id").withColumn("ids", ids).drop("_tidy")


def _records(rows: DataFrame, detector: str, score: Column, extra: Column, meta: dict[str, str]) -> DataFrame:
    given = meta | {"detector": detector}
    columns = {"score": score, "extra": F.to_json(extra), "sample_id": F.col("sample_id")} | {c: F.col(c) if c in rows.columns else F.lit(None) for c in COSTS}
    return rows.select(*[columns.get(f.name, F.lit(given.get(f.name))).cast(f.dataType).alias(f.name) for f in RECORD])


def entropy_records(rows: DataFrame, meta: dict[str, str], tag: str | None = None) -> DataFrame:
    """Records of both detectors from :func:`candidates` rows: the entropy of the pair's clusters
    and one minus the share of the sample's own. Costs in ``rows`` stand on both rows of a
    pair; ``meta`` has split, variant, config_hash and prompt_version. No label is stored."""
    s = scored_candidate(F.col("ids"))
    shared = [F.col("pair_id"), F.lit("pair").alias("generation_statistics_unit"), s["num_clusters"].alias("num_clusters")] + ([F.lit(tag).alias("tag")] if tag else [])
    made = F.slice("ids", F.lit(1), F.size("ids") - 1)
    whole = _records(rows, GLOBAL, s["global_entropy"], F.struct(*shared, made.alias("cluster_ids")), meta)
    own = F.struct(*shared, s["probability"].alias("candidate_cluster_probability"), s["matched"].alias("candidate_matched"), s["cluster_id"].alias("candidate_cluster_id"), s["global_entropy"].alias("global_entropy"))
    out = whole.unionByName(_records(rows, CANDIDATE, s["score"], own, meta))
    return out


def run_entropy(generations: DataFrame, samples: DataFrame, folder: str, meta: dict[str, str], predict: Predict | None = None, parts: int = 1, buckets: int = 16) -> StateTable:
    """Score pairs' generations (pair_id, answers) for ``samples`` and commit a run of each entropy
    detector below ``folder``; sidecars say that costs are a pair's.

    Samples go through two states in a table beside the runs: their pair's answers are kept, then
    their clusters. A run that stopped takes up what it kept, under the same provenance only."""
    from ..sources.commit import StateTable
    from ..sources.io import run_path, write_run
    from ..streaming.resume import run_states

    spark = samples.sparkSession
    table = StateTable(spark, f"{folder}/states", KEPT, "sample_id", ("generated", "scored"), buckets=buckets)
    costs = [c for c in COSTS if c in generations.columns]
    asked = samples.select("sample_id", "pair_id", "answer", F.lit(meta["config_hash"]).alias("config_hash"), F.lit(meta["prompt_version"]).alias("prompt_version"), F.lit(meta["split"]).alias("split"))
    require_none(samples.select("pair_id").distinct().join(generations.select("pair_id"), "pair_id", "left_anti"), "pairs without generations")
    generate = lambda rows: rows.join(generations.select("pair_id", "answers", *costs), "pair_id")

    def score(rows: DataFrame) -> DataFrame:
        saved = rows.select("pair_id", "answers").dropDuplicates(["pair_id"])
        found = candidates(saved, rows.select("sample_id", "pair_id", "answer"), predict)
        return rows.drop("ids").join(found.select("sample_id", "ids"), "sample_id")

    done = run_states(asked, table, generate, score, ["config_hash", "prompt_version", "split"], parts)
    both = entropy_records(done.drop("config_hash", "prompt_version", "split", "state"), {k: meta[k] for k in ("split", "variant", "config_hash", "prompt_version")})
    require_paired(both, samples)
    for detector in (GLOBAL, CANDIDATE):
        path = run_path(folder, detector, meta["variant"], meta["split"])
        write_run(both.filter(F.col("detector") == detector), meta | {"detector": detector, "extra": PAIR_COSTS}, path)
    return table


def rescored(saved: DataFrame, samples: DataFrame, old: DataFrame, config_hash: str, prompt_version: str, tag: str, predict: Predict | None = None, probabilities: DataFrame | None = None) -> DataFrame:
    """``old`` records of both detectors with scores made anew from saved generations
    (pair_id, answers, config_hash, prompt_version): other fields stay, labels are cleared.

    Saved pairs must be exactly the samples' pairs, made under this configuration, and every
    sample must have a record of each detector."""
    require_none(saved.filter((F.col("config_hash") != config_hash) | (F.col("prompt_version") != prompt_version)).select("pair_id"), "generations of another configuration")
    require_none(saved.select("pair_id").exceptAll(samples.select("pair_id").distinct()), "generations of unknown or repeated pairs")
    meta = {"split": None, "variant": None, "config_hash": config_hash, "prompt_version": prompt_version}
    new = entropy_records(candidates(saved.select("pair_id", "answers"), samples, predict, probabilities), meta, tag).select("sample_id", "detector", F.col("score").alias("_score"), F.col("extra").alias("_extra"))
    require_none(new.join(old, ["sample_id", "detector"], "left_anti").select("sample_id", "detector"), "samples without an old record")
    joined = old.join(new, ["sample_id", "detector"])
    changed = {"score": F.col("_score"), "extra": F.col("_extra"), "pred_label": F.lit(None).cast("int")}
    return joined.select(*[changed.get(f.name, F.col(f.name)).alias(f.name) for f in RECORD])


def checkpoint_violations(records: DataFrame, expected: DataFrame, meta: dict[str, str]) -> DataFrame:
    """(sample_id, rule): records that a resumed run can't take over: of unknown samples, of
    other provenance than ``meta`` (detector, variant, split, config_hash, prompt_version), or invalid."""
    unknown = records.join(expected.select("sample_id"), "sample_id", "left_anti").select("sample_id", F.lit("unexpected").alias("rule"))
    other = F.explode(F.array_compact(F.array(*[F.when(~F.col(k).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in meta.items()])))
    return unknown.unionByName(records.select("sample_id", other.alias("rule"))).unionByName(record_violations(records))


def require_paired(records: DataFrame, samples: DataFrame) -> None:
    """Raise unless each pair's records of a detector are exactly its two samples."""
    own = records.select("detector", "sample_id")
    for detector in sorted(r.detector for r in own.select("detector").distinct().collect()):
        mine, wanted = own.filter(F.col("detector") == detector).select("sample_id"), samples.select("sample_id")
        problems = mine.exceptAll(wanted).unionByName(wanted.exceptAll(mine)).limit(3).collect()
        if problems:
            raise DataIntegrityError(f"{detector}: records and samples differ, e.g. {problems}")
