"""Exploratory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NON_WS, ends_sentence, has_non_ascii, word_count


def length_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, sample sd (0 for one row), min, median, max."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.when(F.count(value) == 1, 0.0)).alias("std"),
        F.min(value).alias("min"), F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("max"),
    )


def describe(df: DataFrame, value: str) -> DataFrame:
    """count, mean, std, min, quartiles, max."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.max(value).alias("max"))


def class_distribution(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Rows of each label in each split and overall (split null), with their share in percent."""
    counts = df.groupingSets([[split, label], [label]], split, label).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(split)))


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of each column, and their share in percent."""
    row = df.agg(F.count("*").alias("_n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    long = row.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in columns])).alias("e"))
    return long.select("e.column", F.coalesce("e.n_missing", F.lit(0)).alias("n_missing"), F.try_divide(100.0 * F.col("e.n_missing"), F.col("_n")).alias("pct_missing"))


def blanks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Texts of each column that are there but have nothing but white space."""
    row = df.agg(*[F.count_if(~F.col(c).rlike(NON_WS)).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_blank")) for c in columns])).alias("e")).select("e.*")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of equal keys with more than one row: how many, and how many rows beyond the first."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(F.sum((F.col("n") > 1).cast("long")).alias("n_groups"), F.sum(F.col("n") - 1).alias("n_extra"))


def formatting_summary(df: DataFrame, text: str, by: str) -> DataFrame:
    """For each label: rows, percent ending a sentence, percent with non-ASCII, mean and median characters and words."""
    t = F.col(text)
    return df.groupBy(by).agg(
        F.count("*").alias("n"), (100 * F.avg(ends_sentence(t).cast("double"))).alias("pct_ends_sentence"), (100 * F.avg(has_non_ascii(t).cast("double"))).alias("pct_non_ascii"),
        F.avg(F.length(t)).alias("mean_chars"), F.percentile(F.length(t), F.lit(0.5)).alias("median_chars"), F.avg(word_count(t)).alias("mean_words"), F.percentile(word_count(t), F.lit(0.5)).alias("median_words"),
    )


def extremes(df: DataFrame, value: str, key: str) -> DataFrame:
    """Ids of the least and the greatest value (ties: the lower id)."""
    return df.agg(F.min(F.struct(value, key))[key].alias("least"), F.min(F.struct((-F.col(value)).alias("v"), F.col(key)))[key].alias("greatest"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows in equal bins; values outside fall into the end bins."""
    b = F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.select(F.greatest(F.least(b, F.lit(bins)), F.lit(1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def ecdf(bins: DataFrame) -> DataFrame:
    """(bin, n) rows with ``ecdf``, the share of all rows up to each bin; there are few bins."""
    up = Window.orderBy("bin")
    return bins.withColumn("ecdf", F.sum("n").over(up).cast("double") / F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def log_histogram(df: DataFrame, value: str, per_decade: int = 4) -> DataFrame:
    """Rows in geometric bins of values >= 1."""
    return df.filter(F.col(value) >= 1).select(F.floor(per_decade * F.log10(F.col(value).cast("double"))).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def first_of_each(df: DataFrame, by: str, order: str, k: int = 5) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_r") <= k).drop("_r")
