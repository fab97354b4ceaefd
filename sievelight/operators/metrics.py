"""Detection metrics, ROC core, threshold selection and strata.

Label 1 is the positive class, a score at or above the threshold is predicted
positive, and what is undefined is null unless ``undefined='zero'``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import quantiles, running

#: Rows of each class from which a stratum counts as reliable.
RELIABLE = 30


def predicted(score: Column, threshold) -> Column:
    return F.when(score.isNotNull(), (score >= threshold).cast("int"))


def confusion(label: Column, pred: Column) -> list[Column]:
    hit = lambda y, p: F.sum(F.when((label == y) & (pred == p), 1).otherwise(0)).cast("long")
    return [hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn")]


def rates(df: DataFrame, undefined: str = "null") -> DataFrame:
    """Add n, n_pos, n_neg, accuracy, precision, recall, specificity, f1 to tp, fp, fn, tn.

    ``undefined``: 'null' leaves ratios without denominator (and F1 of a null or
    zero pair) null; 'zero' makes them 0; 'tp' gives F1 = 0 where there are errors
    but no hits, and null only where there is neither.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    div = lambda a, b: F.try_divide(a.cast("double"), b)
    fill = (lambda c: F.coalesce(c, F.lit(0.0))) if undefined == "zero" else (lambda c: c)
    out = df.withColumns(
        {
            "n": tp + fp + fn + tn,
            "n_pos": tp + fn,
            "n_neg": fp + tn,
            "accuracy": fill(div(tp + tn, tp + fp + fn + tn)),
            "precision": fill(div(tp, tp + fp)),
            "recall": fill(div(tp, tp + fn)),
            "specificity": fill(div(tn, tn + fp)),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    f1 = div(2 * tp, 2 * tp + fp + fn) if undefined == "tp" else F.try_divide(2 * p * r, p + r)
    return out.withColumn("f1", fill(f1))


def metrics(scored: DataFrame, by: list[str], pred: str = "pred", label: str = "label", undefined: str = "null") -> DataFrame:
    """One row of metrics for each group."""
    return rates(scored.groupBy(*by).agg(*confusion(F.col(label), F.col(pred))), undefined)


def score_groups(scored: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Positives and negatives at each distinct score, with running sums and the next score."""
    groups = scored.groupBy(*by, F.col(score).alias("score")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg"))
    return running(groups, by, "score", ["pos", "neg"])


def auroc_of(groups: DataFrame, by: list[str]) -> DataFrame:
    """AUROC with ties at one half; null if a class is missing."""
    won = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    return groups.groupBy(*by).agg(F.try_divide(won, F.max("all_pos").cast("double") * F.max("all_neg")).alias("auroc"))


def auroc(scored: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    return auroc_of(score_groups(scored, by, score, label), by)


def threshold_candidates(groups: DataFrame) -> DataFrame:
    """Midpoints of neighbouring scores (a lone score stands for itself) with their confusion counts."""
    lone = F.col("next_score").isNull() & (F.col("before_pos") + F.col("before_neg") == 0)
    rows = groups.filter(F.col("next_score").isNotNull() | lone)
    below = lambda c: F.when(lone, F.lit(0)).otherwise(F.col(f"before_{c}") + F.col(c))
    return rows.withColumns(
        {
            "threshold": F.when(lone, F.col("score")).otherwise((F.col("score") + F.col("next_score")) / 2),
            "tp": F.col("all_pos") - below("pos"),
            "fp": F.col("all_neg") - below("neg"),
            "fn": below("pos"),
            "tn": below("neg"),
        }
    )


def score_thresholds(groups: DataFrame, by: list[str]) -> DataFrame:
    """Every score as a threshold, and 0 and 1, with confusion counts."""
    at = groups.select(*by, F.col("score").alias("threshold"), *[(F.col(f"all_{c}") - F.col(f"before_{c}")).alias(n) for c, n in (("pos", "tp"), ("neg", "fp"))], *[F.col(f"before_{c}").alias(n) for c, n in (("pos", "fn"), ("neg", "tn"))])
    fixed = [
        groups.groupBy(*by).agg(
            F.lit(t).alias("threshold"),
            *[F.sum(F.when(F.col("score") >= t, F.col(c)).otherwise(0)).alias(n) for c, n in (("pos", "tp"), ("neg", "fp"))],
            *[F.sum(F.when(F.col("score") < t, F.col(c)).otherwise(0)).alias(n) for c, n in (("pos", "fn"), ("neg", "tn"))],
        )
        for t in (0.0, 1.0)
    ]
    return at.unionByName(fixed[0]).unionByName(fixed[1]).dropDuplicates([*by, "threshold"])


def criterion(name: str) -> Column:
    """Value to maximise; null counts as minus infinity."""
    value = {"youden": F.col("recall") + F.col("specificity") - 1, "f1": F.col("f1"), "accuracy": F.col("accuracy")}[name]
    return F.coalesce(value, F.lit(float("-inf")))


def select_threshold(candidates: DataFrame, by: list[str], name: str = "youden", ties: str = "lowest", undefined: str = "null", single: str = "error") -> DataFrame:
    """The best candidate of each group; equal values go to the lowest or highest threshold.
    A group whose labels are all of one class is an error, or has a null threshold with ``single='null'``."""
    one = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    refuse = F.raise_error(F.lit("labels of a single class: no threshold can be selected")).cast("double") if single == "error" else F.lit(None).cast("double")
    rated = rates(candidates, undefined).withColumn("value", F.when(one, refuse).otherwise(criterion(name)))
    order = -F.col("threshold") if ties == "lowest" else F.col("threshold")
    best = rated.groupBy(*by).agg(F.max(F.struct(F.col("value"), order.alias("order"), F.col("threshold"))).alias("best"))
    return best.select(*by, F.when(F.col("best.value").isNotNull(), F.col("best.threshold")).alias("threshold"), F.col("best.value").alias("value"))


def pairs(scored: DataFrame, key: str, value: str = "score", label: str = "label") -> DataFrame:
    """One row for each key with the factual and the hallucinated value, and whether it is complete."""
    one = lambda y: F.max(F.when(F.col(label) == y, F.col(value)))
    rows = lambda y: F.sum((F.col(label) == y).cast("int"))
    return scored.groupBy(key).agg(one(0).alias("factual"), one(1).alias("hallucinated"), ((rows(0) == 1) & (rows(1) == 1) & (F.count("*") == 2)).alias("complete"))


def win(factual: Column, hallucinated: Column) -> Column:
    return F.when(hallucinated > factual, 1.0).when(hallucinated == factual, 0.5).otherwise(0.0)


def require_complete(paired: DataFrame, what: str = "pair") -> DataFrame:
    """``paired`` as it is; a key without exactly one row of each label is an error where it is read."""
    fine = F.when(~F.col("complete"), F.raise_error(F.lit(f"incomplete {what}")).cast("boolean")).otherwise(True)
    return paired.filter(fine)


def pair_accuracy(paired: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of pairs in which the hallucinated answer scores higher (ties one half)."""
    w = win(F.col("factual"), F.col("hallucinated"))
    whole = paired.filter("complete")
    return whole.groupBy(*(by or [])).agg(F.count("*").alias("n_pairs"), F.avg(w).alias("pair_accuracy"), F.sum((w == 0.5).cast("long")).alias("n_ties"))


def threshold_curve(scored: DataFrame, points: int = 21, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Metrics of each group at evenly spaced quantiles of its scores, equal quantiles once."""
    by = by or []
    grid = quantiles(scored, score, [i / (points - 1) for i in range(points)], by).select(*by, F.explode(F.array_distinct("quantiles")).alias("threshold"))
    # the grid has at most ``points`` rows for each group; every score group meets those of its own
    groups = scored.groupBy(*by, F.col(score).alias("score")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg"))
    above = F.col("score") >= F.col("threshold")
    part = lambda c, test: F.sum(F.when(test, F.col(c)).otherwise(0))
    met = groups.join(F.broadcast(grid), by) if by else groups.join(F.broadcast(grid))
    counts = met.groupBy(*by, "threshold").agg(part("pos", above).alias("tp"), part("neg", above).alias("fp"), part("pos", ~above).alias("fn"), part("neg", ~above).alias("tn"))
    return rates(counts)


def length_edges(df: DataFrame, length: str = "length", bins: int = 5) -> DataFrame:
    """Distinct quantile edges of a length column, as one array. Lengths are whole numbers: the
    buffer has one entry for each distinct length, however many rows."""
    q = F.percentile(F.col(length), F.array(*[F.lit(i / bins) for i in range(bins + 1)]))
    return df.agg(F.array_distinct(q).alias("edges"))


def stratum(length: Column, edges: Column) -> Column:
    """Bin number by the inner edges: a value on an edge goes up, outliers to the end bins."""
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: e <= length))


def stratified(scored: DataFrame, edges: DataFrame, length: str = "length", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Metrics and AUROC of each length bin (of each group), empty bins included.

    ``bin_range`` names a bin by its edges, ``n_min`` is the smaller class and ``reliable``
    whether it suffices; a lone edge is one bin."""
    by = by or []
    marks = edges.first().edges  # one row of at most a few edges
    marks = marks if len(marks) > 1 else [*marks, *marks]
    last = len(marks) - 2
    names = [(i, f"[{a:g}, {b:g}{']' if i == last else ')'}") for i, (a, b) in enumerate(zip(marks[:-1], marks[1:]))]
    rows = scored.withColumn("bin", stratum(F.col(length), F.array(*[F.lit(float(m)) for m in marks])))
    counts = rows.groupBy(*by, "bin").agg(*confusion(F.col("label"), F.col("pred")))
    spine = F.broadcast(scored.sparkSession.createDataFrame(names, "bin int, bin_range string"))
    spine = scored.select(*by).distinct().join(spine) if by else spine
    full = spine.join(counts, [*by, "bin"], "left").na.fill(0, ["tp", "fp", "fn", "tn"])
    least = F.least("n_pos", "n_neg")
    out = rates(full).withColumns({"n_min": least, "reliable": least >= RELIABLE, "frac_hallucinated": F.try_divide(F.col("n_pos").cast("double"), F.col("n"))})
    return out.join(auroc(rows, [*by, "bin"], score), [*by, "bin"], "left")


def error_lengths(scored: DataFrame, length: str = "length", by: list[str] | None = None) -> DataFrame:
    """Count, mean and median length of each outcome; absent outcomes have null statistics."""
    by = by or []
    y, p = F.col("label"), F.col("pred")
    outcome = F.when((y == 1) & (p == 1), "TP").when((y == 0) & (p == 0), "TN").when((y == 0) & (p == 1), "FP").otherwise("FN")
    found = scored.withColumn("outcome", outcome).groupBy(*by, "outcome").agg(F.count("*").alias("n"), F.avg(length).alias("mean"), F.percentile(length, F.lit(0.5)).alias("median"))
    spine = F.broadcast(scored.sparkSession.createDataFrame([(o,) for o in ("TP", "TN", "FP", "FN")], "outcome string"))
    spine = scored.select(*by).distinct().join(spine) if by else spine
    return spine.join(found, [*by, "outcome"], "left").select(*by, "outcome", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean", "median")


def worst_errors(scored: DataFrame, k: int = 10, order: str = "sample_id", max_chars: int | None = None) -> DataFrame:
    """The k false positives of highest and the k false negatives of lowest score, with all
    columns; texts named question and answer are cut to ``max_chars``."""
    cut = {c: F.substring(c, 1, max_chars) for c in ("question", "answer") if max_chars is not None and c in scored.columns}
    scored = scored.withColumns(cut) if cut else scored
    fp = scored.filter("label = 0 and pred = 1").orderBy(F.desc("score"), order).limit(k).withColumn("kind", F.lit("FP"))
    fn = scored.filter("label = 1 and pred = 0").orderBy("score", order).limit(k).withColumn("kind", F.lit("FN"))
    return fp.unionByName(fn)


def log_loss(df: DataFrame, p: str, label: str = "label", name: str = "log_loss") -> DataFrame:
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-15)), F.lit(1e-15))
    y = F.col(label)
    return df.agg((-F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias(name))


def best_by(df: DataFrame, value: str, position: str, by: list[str] | None = None) -> DataFrame:
    """The row of highest value; null and NaN are worst, ties go to the first position."""
    v = F.coalesce(F.when(~F.isnan(F.col(value)), F.col(value)), F.lit(float("-inf")))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(v.desc(), F.col(position).asc())
    return df.withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop("_at")
