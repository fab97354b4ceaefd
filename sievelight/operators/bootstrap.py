"""Cluster bootstrap as weights: replicate x cluster multiplicities joined to the rows.

A replicate draws as many clusters as there are, with replacement. Draw i of
replicate r takes cluster number ``hash(seed, r, i) mod clusters``; the generator
is sha256, so any engine can repeat it. Metrics of a replicate are aggregates
weighted by multiplicity; AUROC of the weighted score groups equals AUROC of the
expanded resample. Clusters are first collapsed to what the metrics need.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import held
from .metrics import rates, win
from .splits import numbered


#: Draws that one task makes, about.
DRAWS_PER_TASK = 20_000_000


def draw_ids(spark, clusters: int, replicates: int) -> DataFrame:
    """(id) of every draw: replicate times ``clusters`` plus its number."""
    total = replicates * clusters
    return spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, -(-total // DRAWS_PER_TASK)))


def single_draws(spark, clusters: int, replicates: int, seed: int = 42) -> DataFrame:
    """(rep, cluster_no), a row for each draw."""
    grid = draw_ids(spark, clusters, replicates).select((F.col("id") / clusters).cast("int").alias("rep"), (F.col("id") % clusters).alias("i"))
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("i").cast("string")), 256)
    return grid.select("rep", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % clusters).alias("cluster_no"))


def draws(spark, clusters: int, replicates: int, seed: int = 42) -> DataFrame:
    """(rep, cluster_no, mult) with mult >= 1."""
    return single_draws(spark, clusters, replicates, seed).groupBy("rep", "cluster_no").agg(F.count("*").alias("mult"))


#: Replicate number of the sample itself, whose metrics are the point estimates.
ITSELF = -1


def with_itself(weights: DataFrame, clusters: int) -> DataFrame:
    """``weights`` and the sample itself: every cluster once, as replicate ITSELF."""
    own = weights.sparkSession.range(clusters).select(F.lit(ITSELF).alias("rep"), F.col("id").alias("cluster_no"), F.lit(1).cast("long").alias("mult"))
    return weights.unionByName(own)


def pair_table(scored: DataFrame, cluster: str, scores: list[str]) -> DataFrame:
    """One row for each cluster: number, and both labels' scores for each detector. A cluster
    that hasn't exactly one scored row of each label is an error. Numbers are in the order of the
    clusters' ids and need no global window."""
    rows = lambda y: F.sum((F.col("label") == y).cast("int"))
    whole = (rows(0) == 1) & (rows(1) == 1) & (F.count("*") == 2) & reduce(and_, [F.count(s) == 2 for s in scores])
    fine = F.when(~F.col("_whole"), F.raise_error(F.lit(f"every {cluster} needs exactly one scored row of each label")).cast("boolean")).otherwise(True)
    one = lambda s, y: F.max(F.when(F.col("label") == y, F.col(s))).alias(f"{s}_{y}")
    wide = scored.groupBy(cluster).agg(*[one(s, y) for s in scores for y in (0, 1)], whole.alias("_whole"))
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return numbered(wide.filter(fine).drop("_whole"), [cluster], "cluster_no", parts)


def replicate_metrics(wide: DataFrame, weights: DataFrame, score: str, threshold: float) -> DataFrame:
    """Metrics of each replicate at a fixed threshold: accuracy, precision, recall, f1, pair accuracy, auroc."""
    rows = weights.join(wide.select("cluster_no", F.col(f"{score}_0").alias("s0"), F.col(f"{score}_1").alias("s1")), "cluster_no")
    m = F.col("mult")
    up = lambda c: (F.col(c) >= threshold).cast("int")
    counts = rows.groupBy("rep").agg(
        F.sum(m * up("s1")).alias("tp"), F.sum(m * up("s0")).alias("fp"), F.sum(m * (1 - up("s1"))).alias("fn"), F.sum(m * (1 - up("s0"))).alias("tn"),
        F.try_divide(F.sum(m * win(F.col("s0"), F.col("s1"))), F.sum(m)).alias("pair_accuracy"),
    )
    both = rows.select("rep", "mult", F.explode(F.array(F.struct(F.col("s0").alias("s"), F.lit(0).alias("y")), F.struct(F.col("s1").alias("s"), F.lit(1).alias("y")))).alias("e"))
    groups = both.groupBy("rep", F.col("e.s").alias("score")).agg(F.sum(F.when(F.col("e.y") == 1, m).otherwise(0)).alias("pos"), F.sum(F.when(F.col("e.y") == 0, m).otherwise(0)).alias("neg"))
    w = Window.partitionBy("rep").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)  # a window holds one replicate
    ranked = groups.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    area = ranked.groupBy("rep").agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)), F.sum("pos").cast("double") * F.sum("neg")).alias("auroc")
    )
    return rates(counts, "tp").join(area, "rep").select("rep", "auroc", "accuracy", "precision", "recall", "f1", "pair_accuracy")


METRICS = ("auroc", "accuracy", "f1", "pair_accuracy")
#: Also those of the evaluator's own intervals.
ALL_METRICS = ("auroc", "accuracy", "precision", "recall", "f1", "pair_accuracy")


def _long(reps: DataFrame, values: dict[str, Column]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()]))
    return reps.select("rep", each.alias("e")).select("rep", "e.*")


def _summary(long: DataFrame, level: float, by: list[str] | None = None) -> DataFrame:
    """estimate, low, high, n_reps of each metric: the estimate is the replicate ITSELF, null replicates are skipped."""
    a = (1 - level) / 2
    drawn = F.when(F.col("rep") != ITSELF, F.col("value"))
    return long.groupBy(*(by or []), "metric").agg(
        F.max(F.when(F.col("rep") == ITSELF, F.col("value"))).alias("estimate"), F.percentile(drawn, F.lit(a)).alias("low"), F.percentile(drawn, F.lit(1 - a)).alias("high"),
        F.count(drawn).alias("n_reps"), F.avg(F.when(drawn.isNotNull(), (drawn > 0).cast("double"))).alias("positive"),
    )


def intervals(reps: DataFrame, metrics: tuple[str, ...] = METRICS, level: float = 0.95) -> DataFrame:
    """(metric, estimate, low, high, n_reps): percentile intervals; the estimate is null unless the sample itself is among the replicates."""
    return _summary(_long(reps, {m: F.col(m) for m in metrics}), level).drop("positive")


def paired_difference(a: DataFrame, b: DataFrame, metrics: tuple[str, ...] = METRICS, level: float = 0.95) -> DataFrame:
    """Estimates and intervals of A - B over the same resamples, whether they exclude zero, and how often A is better."""
    both = a.select("rep", *[F.col(m).alias(f"a_{m}") for m in metrics]).join(b.select("rep", *[F.col(m).alias(f"b_{m}") for m in metrics]), "rep")
    out = _summary(_long(both, {m: F.col(f"a_{m}") - F.col(f"b_{m}") for m in metrics}), level).drop("n_reps").withColumnRenamed("positive", "frac_a_better")
    return out.withColumn("ci_excludes_zero", F.coalesce((F.col("low") > 0) | (F.col("high") < 0), F.lit(False)))


def verdict(differences: DataFrame, by: list[str]) -> DataFrame:
    """IMPROVES if the intervals of all compared inputs (rows with low and high) lie above zero,
    WORSE if any lies below, else INCONCLUSIVE; UNAVAILABLE where no row is known."""
    low, high = F.col("low"), F.col("high")
    known = F.count(F.when(low.isNotNull() | high.isNotNull(), 1))
    every, some = F.min(F.coalesce(low > 0, F.lit(False)).cast("int")), F.max(F.coalesce(high < 0, F.lit(False)).cast("int"))
    named = F.when(known == 0, "UNAVAILABLE").when(every == 1, "IMPROVES").when(some == 1, "WORSE").otherwise("INCONCLUSIVE")
    return differences.groupBy(*by).agg(named.alias("verdict"))


def compared(samples: DataFrame, detectors: dict[str, float], reference: str, cluster: str = "pair_id", replicates: int = 1000, seed: int = 42, metrics: tuple[str, ...] = METRICS, hold=held, draw: str = "tree") -> dict[str, DataFrame]:
    """Detectors (score column to threshold) on one set of samples, over the same resamples.

    ``intervals`` has estimate and interval of each detector and metric, ``differences`` those
    of each other detector less the reference, ``verdict`` what they say together for each
    metric. ``draw`` is how clusters are drawn: by a tree or a sequence (``resampling``), or by
    hashes of draws, which SQL can repeat. ``hold`` stores what is read several times."""
    wide = hold(pair_table(samples, cluster, list(detectors)))
    n = wide.count()
    from .resampling import Draw
    from .resampling import replicates as drawn

    every = hold(drawn(wide, detectors, Draw(n, replicates, seed, draw)))
    reps = {d: every.filter(F.col("detector") == d).drop("detector") for d in detectors}
    named = lambda df, d: df.select(F.lit(d).alias("detector"), "*")
    every = reduce(DataFrame.unionByName, [named(intervals(r, metrics), d) for d, r in reps.items()])
    others = [named(paired_difference(r, reps[reference], metrics), d) for d, r in reps.items() if d != reference]
    out = {"intervals": every}
    if others:
        against = [paired_difference(reps[reference], r, metrics).select(F.lit(d).alias("detector"), "metric", "low", "high") for d, r in reps.items() if d != reference]
        out |= {"differences": reduce(DataFrame.unionByName, others), "verdict": verdict(reduce(DataFrame.unionByName, against), ["metric"])}
    return out
