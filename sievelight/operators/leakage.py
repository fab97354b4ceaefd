"""Joins and exclusions that audit leakage between splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(expected: DataFrame, found: DataFrame, key: str = "sample_id") -> DataFrame:
    """Ids that are missing from or extra in ``found``, as (id, problem) rows."""
    side = lambda df, own: df.select(key, F.lit(own).alias("_own"), F.lit(not own).alias("_found"))
    both = side(expected, True).unionByName(side(found, False)).groupBy(key).agg(F.max("_own").alias("_own"), F.max("_found").alias("_found"))
    unequal = F.col(key).isNull()  # null equals no id, so it is missing and extra
    missing = F.when(F.col("_own") & (~F.col("_found") | unequal), "missing")
    extra = F.when(F.col("_found") & (~F.col("_own") | unequal), "extra")
    return both.select(key, F.explode(F.array_compact(F.array(missing, extra))).alias("problem"))


def align(samples: DataFrame, scores: DataFrame, key: str = "sample_id", allow_extra: bool = False, check: bool = True) -> DataFrame:
    """Samples with their scores; missing (and, unless allowed, extra) ids are an error."""
    if check:
        problems = coverage(samples, scores, key)
        if allow_extra:
            problems = problems.filter("problem = 'missing'")
        first = problems.orderBy("problem", key).limit(5).collect()
        if first:
            raise ValueError("ids don't match: " + ", ".join(f"{r[key]} {r.problem}" for r in first))
    return samples.join(scores, key)


def with_optional(samples: DataFrame, scores: DataFrame, key: str = "sample_id", score: str = "score") -> DataFrame:
    """Left join with a flag that tells whether a score was there."""
    return samples.join(scores, key, "left").withColumn(f"has_{score}", F.col(score).isNotNull())


def seen_in_train(rows: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """Rows with ``seen`` (key occurs in train) and ``seen_opposite`` (also, or only, with the other label)."""
    labels = train.groupBy(key).agg(F.max((F.col("label") == 0).cast("int")).alias("_t0"), F.max((F.col("label") == 1).cast("int")).alias("_t1"))
    joined = rows.join(labels, key, "left")
    opposite = F.when(F.col("label") == 1, F.col("_t0")).otherwise(F.col("_t1"))
    return joined.withColumns({"seen": F.col("_t0").isNotNull(), "seen_opposite": F.coalesce(opposite == 1, F.lit(False))}).drop("_t0", "_t1")


def exclude_pairs(rows: DataFrame, train: DataFrame, keys: list[str], pair: str = "pair_id") -> DataFrame:
    """Drop whole pairs of which any row shares any of ``keys`` with train; without keys nothing goes."""
    hits = rows.select(pair).limit(0)
    for k in keys:
        found = rows.join(train.select(k).distinct(), k, "left_semi").select(pair)
        hits = hits.unionByName(found)
    return rows.join(hits.distinct(), pair, "left_anti")


def scopes(rows: DataFrame, train: DataFrame, without: dict[str, list[str]], pair: str = "pair_id") -> DataFrame:
    """``rows`` once as scope ``all`` and once for each named list of keys without the pairs that share one with train."""
    out = rows.withColumn("scope", F.lit("all"))
    for name, keys in without.items():
        out = out.unionByName(exclude_pairs(rows, train, keys, pair).withColumn("scope", F.lit(name)))
    return out


def covered_by_all(samples: DataFrame, inputs: list[DataFrame], key: str = "sample_id", least_pairs: int = 0, pair: str = "pair_id") -> DataFrame:
    """Samples that every input covers; fewer than ``least_pairs`` pairs among them are an error."""
    for i in inputs:
        samples = samples.join(i.select(key).distinct(), key, "left_semi")
    if least_pairs:
        found = samples.select(pair).distinct().limit(least_pairs).count()
        if found < least_pairs:
            raise ValueError(f"only {found} pairs are covered by every input, {least_pairs} are needed")
    return samples


def label_mismatches(found: DataFrame, expected: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, problem): ids that are missing or extra, or whose label differs."""
    own = found.select(key, F.col("label").alias("_l")).distinct()
    differ = expected.join(own, key).filter(~F.col("label").eqNullSafe(F.col("_l"))).select(key, F.lit("label").alias("problem"))
    return coverage(expected, found, key).unionByName(differ)


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the finished ones."""
    return work.join(done.select(key).distinct(), key, "left_anti")
