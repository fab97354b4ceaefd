"""Statistics as grouped DataFrame aggregates.

Rankings and running sums over raw rows never use one global window: rows are cut
into buckets at approximate quantiles, the bounded table of bucket sums is
accumulated, and windows run inside buckets. The cuts balance the work; results
don't depend on them.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of an ordered column, at least.
BUCKETS = 64


def bucket_count(df: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions, so that they grow with the cluster's data."""
    return max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_bucket(df: DataFrame, order: str, buckets: int | None = None) -> DataFrame:
    """``df`` with ``bucket``, a number that ascends with the numeric column ``order``.
    The cuts are a row of the same plan, so nothing runs before the result is asked for."""
    value, buckets = F.col(order).cast("double"), buckets or bucket_count(df)
    cuts = df.agg(F.array_distinct(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], max(1000, 20 * buckets))).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda c: F.col(order) > c))  # one row of at most ``buckets`` cuts
    return df.join(F.broadcast(cuts)).withColumn("bucket", F.when(F.col("_cuts").isNull(), 0).otherwise(below)).drop("_cuts")


def running(df: DataFrame, by: list[str], order: str, sums: list[str], buckets: int | None = None) -> DataFrame:
    """Add ``before_<c>``, the sum of c over rows of lower ``order``, ``all_<c>``, the whole
    sum, and ``next_<order>``, the next higher value. ``order`` is unique within ``by``."""
    cut = with_bucket(df, order, buckets)
    totals = cut.groupBy(*by, "bucket").agg(*[F.sum(c).alias(f"b_{c}") for c in sums], F.min(order).alias("b_least"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    up, whole = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), w
    totals = totals.select(  # as many rows as buckets for each group
        *[F.col(k).alias(f"k_{k}") for k in by],
        F.col("bucket").alias("k_bucket"),
        *[F.coalesce(F.sum(f"b_{c}").over(up), F.lit(0)).alias(f"lead_{c}") for c in sums],
        *[F.sum(f"b_{c}").over(whole).alias(f"all_{c}") for c in sums],
        F.lead("b_least").over(w.orderBy("bucket")).alias("b_next"),
    )
    same = reduce(lambda a, b: a & b, [cut[k].eqNullSafe(totals[f"k_{k}"]) for k in by], cut["bucket"] == totals["k_bucket"])
    joined = cut.join(totals, same)
    inside = Window.partitionBy(*by, "bucket").orderBy(order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(
        *[cut[c] for c in df.columns],
        *[(F.col(f"lead_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0))).alias(f"before_{c}") for c in sums],
        *[F.col(f"all_{c}") for c in sums],
        F.coalesce(F.lead(order).over(inside), F.col("b_next")).alias(f"next_{order}"),
    )


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, quantiles): exact quantiles of ``value`` at ``shares``, interpolated between neighbours;
    null values don't count, and without values the list is empty. Values are counted and numbered by ranges, so that no buffer holds
    them all; only the values at the wanted places are gathered."""
    by = by or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = running(counts, by, "_v", ["_n"])
    start, n = F.col("before__n"), F.col("_n")

    def at(k: int, share: float):
        place = F.lit(share) * (F.col("all__n") - 1)
        low, high = F.floor(place), F.ceil(place)
        above = F.when(high < start + n, F.col("_v")).otherwise(F.col("next__v"))
        between = F.when((low == high) | (above == F.col("_v")), F.col("_v")).otherwise((high - place) * F.col("_v") + (place - low) * above)
        return F.when((low >= start) & (low < start + n), F.struct(F.lit(k).alias("k"), between.alias("q")))

    found = placed.select(*by, F.explode(F.array_compact(F.array(*[at(k, s) for k, s in enumerate(shares)]))).alias("e"))
    return found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["q"]).alias("quantiles"))


def average_rank(df: DataFrame, value: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Average rank (from 1) of each row's value within its group; ties share."""
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count("*").alias("ties"))
    ranked = running(counts, by, value, ["ties"])
    table = ranked.select(*by, value, (F.col("before_ties") + (F.col("ties") + 1) / 2.0).alias(name))
    return df.join(table, [*by, value])


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, null where a side doesn't vary (``corr`` raises or gives NaN there)."""
    varies = (F.coalesce(F.stddev_pop(x), F.lit(0.0)) > 0) & (F.coalesce(F.stddev_pop(y), F.lit(0.0)) > 0)
    mx, my = F.avg(x), F.avg(y)
    return F.when(varies, F.try_divide(F.avg(x * y) - mx * my, F.stddev_pop(x) * F.stddev_pop(y)))


def spearman(df: DataFrame, x: str, y: str, name: str = "spearman") -> DataFrame:
    ranked = average_rank(average_rank(df, x, name="rank_x"), y, name="rank_y")
    return ranked.agg(guarded_corr(F.col("rank_x"), F.col("rank_y")).alias(name))


def ks_statistic(df: DataFrame, value: str, flag: str, name: str = "ks") -> DataFrame:
    """Largest distance of the two empirical distributions of ``value`` where ``flag`` is 0 and 1."""
    counts = df.groupBy(value).agg(F.sum((F.col(flag) == 0).cast("long")).alias("n0"), F.sum((F.col(flag) == 1).cast("long")).alias("n1"))
    steps = running(counts, [], value, ["n0", "n1"])
    share = lambda c: F.try_divide((F.col(f"before_{c}") + F.col(c)).cast("double"), F.col(f"all_{c}"))
    return steps.agg(F.max(F.abs(share("n0") - share("n1"))).alias(name))


def ks_p_value(n0: int, n1: int, statistic: float) -> float:
    """Exact two-sided p-value by counting lattice paths that stay below the statistic."""
    import numpy as np

    if min(n0, n1) == 0:
        return float("nan")
    least = round(statistic * n0 * n1)
    paths = np.zeros(n1 + 1)
    paths[0] = 1.0
    for i in range(n0 + 1):
        inside = np.abs(i * n1 - np.arange(n1 + 1) * n0) < least
        if i == 0:
            paths = np.where(np.cumprod(inside), 1.0, 0.0)
            continue
        # probability that i steps of one kind and j of the other come in this order
        for j in range(n1 + 1):
            up = paths[j] * i / (i + j)
            left = paths[j - 1] * j / (i + j) if j else 0.0
            paths[j] = up + left if inside[j] else 0.0
    return float(min(1.0, max(0.0, 1.0 - paths[n1])))


def ks_p_value_equal(n: int | None, statistic: float | None) -> float | None:
    """:func:`ks_p_value` of two samples of n rows each, in linear time; null without rows."""
    from math import exp, lgamma

    if not n or statistic is None:
        return None
    least = round(statistic * n)
    if least == 0:
        return 1.0
    share = lambda j: exp(2 * lgamma(n + 1) - lgamma(n - j + 1) - lgamma(n + j + 1))
    return min(1.0, max(0.0, 2 * sum((-1) ** i * share(j) for i, j in enumerate(range(least, n + 1, least)))))


def mcnemar_exact(df: DataFrame, only_a: str, only_b: str, name: str = "p_value") -> DataFrame:
    """Adds the exact McNemar p-value; terms are built up by recurrence, so large counts stay linear."""
    n, low = (F.col(only_a) + F.col(only_b)).cast("int"), F.least(F.col(only_a), F.col(only_b)).cast("int")
    start = F.struct((-n * F.ln(F.lit(2.0))).alias("term"), F.exp(-n * F.ln(F.lit(2.0))).alias("total"))

    def step(acc, k):
        term = acc["term"] + F.ln((n - k + 1).cast("double")) - F.ln(k.cast("double"))
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    ks = F.when(low >= 1, F.sequence(F.lit(1), F.greatest(low, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(ks, start, step, lambda acc: acc["total"])
    return df.withColumn(name, F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail)))
