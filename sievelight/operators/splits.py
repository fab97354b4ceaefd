"""Exact splits, folds, reshaping and manifests."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import held

TRAIN, VALIDATION, TEST = "train", "validation", "test"


def hash_order(seed: int, key: Column) -> Column:
    """Order of a shuffle: sha256('seed:key')."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def hashed_rank(keys: DataFrame, key: str, seed: int) -> DataFrame:
    """``keys`` (distinct) with ``pos``, the place (from 0) in hash order.

    Places come in two steps: counts of the 4096 first-three-digit buckets are
    accumulated (a bounded table), then rows are numbered inside their bucket.
    """
    hashed = keys.withColumn("_h", hash_order(seed, F.col(key))).withColumn("_b", F.substring("_h", 1, 3))
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    lead = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lead"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1
    return hashed.join(F.broadcast(lead), "_b").withColumn("pos", (F.col("_lead") + place).cast("long")).drop("_h", "_b", "_lead")


def split_counts(n: int, test: float = 0.1, validation: float = 0.1) -> tuple[int, int]:
    """Test and validation sizes of a two-stage split of n (IEEE doubles, rounded up)."""
    n_test = math.ceil(test * n)
    n_val = math.ceil(validation / (1.0 - test) * (n - n_test)) if test < 1 else 0
    return n_test, n_val


def split_column(pairs: DataFrame, key: str = "pair_id", seed: int = 42, test: float = 0.1, validation: float = 0.1) -> Column:
    """The split of a key of ``pairs`` as a column of the key alone, so that rows needn't be joined
    to get it: counts of the 4096 first-three-digit buckets say in which ones the splits end, and
    only those two are numbered. Equal to places by :func:`hashed_rank`."""
    hashed = pairs.select(key).distinct().withColumn("_h", hash_order(seed, F.col(key))).withColumn("_b", F.substring("_h", 1, 3))
    sizes = sorted((r["_b"], r["_n"]) for r in hashed.groupBy("_b").agg(F.count("*").alias("_n")).collect())  # at most 4096 rows
    n_test, n_val = split_counts(sum(n for _, n in sizes), test, validation)
    at, lead = {}, 0  # end to the bucket that holds it and the place there
    for b, n in sizes:
        at |= {end: (b, end - lead) for end in (n_test, n_test + n_val) if lead <= end < lead + n}
        lead += n
    cuts = {}
    if at:
        place = F.row_number().over(Window.partitionBy("_b").orderBy("_h")) - 1
        inside = hashed.filter(F.col("_b").isin(*{b for b, _ in at.values()})).withColumn("_i", place)
        wanted = reduce(or_, [(F.col("_b") == b) & (F.col("_i") == i) for b, i in set(at.values())])
        cuts = {(r["_b"], r["_i"]): r["_h"] for r in inside.filter(wanted).select("_b", "_i", "_h").collect()}
    below = lambda end: hash_order(seed, F.col(key)) < cuts[at[end]] if end in at else F.lit(True)
    return F.when(below(n_test), TEST).when(below(n_test + n_val), VALIDATION).otherwise(TRAIN)


def split_pairs(pairs: DataFrame, key: str = "pair_id", seed: int = 42, test: float = 0.1, validation: float = 0.1) -> DataFrame:
    """Distinct keys with ``split``: exact counts, whole pairs, reproducible from the key alone."""
    return pairs.select(key).distinct().withColumn("split", split_column(pairs, key, seed, test, validation))


def grouped_folds(df: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``fold``: groups in hash order, dealt to k folds in turn; fewer groups than folds is an error."""
    groups = df.select(group).distinct()
    if groups.limit(k).count() < k:
        raise ValueError(f"need at least {k} groups")
    return df.join(hashed_rank(groups, group, seed).select(group, (F.col("pos") % k).cast("int").alias("fold")), group)


def expand_pairs(pairs: DataFrame, answers: tuple[str, str] = ("right_answer", "hallucinated_answer")) -> DataFrame:
    """Two labelled rows for each pair: the factual (0) and the hallucinated (1) answer.
    ``pair_no`` numbers pairs across splits and makes the sample id."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("label"), F.col(a).alias("answer")) for i, a in enumerate(answers)]))
    keep = [c for c in pairs.columns if c not in answers]
    out = pairs.select(*keep, rows.alias("_r")).select(*keep, F.col("_r.label").alias("label"), F.col("_r.answer").alias("answer"))
    stem = F.format_string("S%06d", F.col("pair_no"))
    return out.withColumns({"sample_id": F.concat_ws("_", stem, F.col("label")), "answer_length_chars": F.length("answer")})


def numbered(df: DataFrame, order: list[str], name: str = "no", buckets: int = 64) -> DataFrame:
    """Consecutive numbers from 0 in the order of ``order`` without one global window:
    rows are range-partitioned once, stored offsets are added per partition."""
    ranged = df.repartitionByRange(buckets, *order).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p").orderBy(*order)
    local = held(ranged.withColumn("_i", F.row_number().over(w) - 1))  # stored: the partition of a row must not change when one is made again
    sizes = local.groupBy("_p").agg(F.count("*").alias("_n"))
    lead = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lead"))
    return local.join(F.broadcast(lead), "_p").withColumn(name, (F.col("_lead") + F.col("_i")).cast("long")).drop("_p", "_i", "_lead")


def first_of(rows: DataFrame, keys: list[str], position: str, keep: list[str]) -> DataFrame:
    """(keys, position, keep) of the first row of each key, in the order of ``position``."""
    first = F.min(F.struct(F.col(position).alias("_at"), *keep)).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, F.col("_first._at").alias(position), *[F.col(f"_first.{c}").alias(c) for c in keep])


def manifest(samples: DataFrame, position: str | None = None) -> DataFrame:
    """Normalised manifest: split, pair_id, stem (sample id without label) and, with a column
    that says where a row stands, ``place``: the pair's first position in its split."""
    stem = F.substring_index("sample_id", "_", 1).alias("stem")
    if position is None:
        return samples.select("split", "pair_id", stem).distinct()
    return samples.groupBy("split", "pair_id", stem).agg(F.min(position).alias("place"))


def manifest_summary(samples: DataFrame) -> DataFrame:
    """Counts and an order-free content hash of each split."""
    row = F.xxhash64("sample_id", "pair_id", "label")
    return samples.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.countDistinct("pair_id").alias("n_pairs"), F.sum((F.col("label") == 1).cast("long")).alias("n_pos"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("content_hash")
    )


def compare_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries that only one manifest has, with the side that has them. Where both have places,
    pairs that stand elsewhere among the members of their split are told as ``order``."""
    keys = ["split", "pair_id", "stem"]
    # one sum over both sides tells which has more of an entry, and how many more
    sides = old.select(*keys, F.lit(1).alias("_side")).unionByName(new.select(*keys, F.lit(-1).alias("_side")))
    more = sides.groupBy(*keys).agg(F.sum("_side").cast("int").alias("_more")).filter("_more <> 0")
    out = more.select(*keys, F.when(F.col("_more") > 0, "old").otherwise("new").alias("only_in"), F.explode(F.array_repeat(F.lit(0), F.abs("_more"))).alias("_copy")).drop("_copy")
    if "place" not in old.columns or "place" not in new.columns:
        return out
    differ = out.select("split").distinct()
    parts = int(old.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def nth(df: DataFrame, name: str) -> DataFrame:
        """Places within the split, from numbers over all splits less the split's first."""
        rows = numbered(df.select(*keys, "place"), ["split", "place", "pair_id", "stem"], "_no", parts)
        first = rows.groupBy("split").agg(F.min("_no").alias("_first"))
        return rows.join(F.broadcast(first), "split").select(*keys, (F.col("_no") - F.col("_first")).alias(name))

    moved = nth(old, "_a").join(nth(new, "_b"), keys).filter("_a <> _b").join(F.broadcast(differ), "split", "left_anti")
    return out.unionByName(moved.select(*keys, F.lit("order").alias("only_in")))


def pair_violations(samples: DataFrame) -> DataFrame:
    """Pairs without exactly one row of each label, with several stems or splits, or ids that end otherwise than their label."""
    stem = F.substring_index("sample_id", "_", 1)
    checks = samples.groupBy("pair_id").agg(
        F.count("*").alias("n"),
        F.sum((F.col("label") == 0).cast("int")).alias("n0"),
        F.sum((F.col("label") == 1).cast("int")).alias("n1"),
        F.countDistinct(stem).alias("stems"),
        F.countDistinct("split").alias("splits"),
        F.sum((F.substring_index("sample_id", "_", -1) != F.col("label").cast("string")).cast("int")).alias("bad_suffix"),
    )
    return checks.filter("n <> 2 or n0 <> 1 or n1 <> 1 or stems <> 1 or splits <> 1 or bad_suffix > 0")


def split_overlap(samples: DataFrame, keys: list[str]) -> DataFrame:
    """For each two splits the number of distinct keys that both hold."""
    per_key = samples.select(*keys, "split").distinct().groupBy(*keys).agg(F.array_sort(F.collect_set("split")).alias("splits"))
    two = F.explode(F.flatten(F.transform("splits", lambda a: F.transform(F.filter("splits", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    return per_key.filter(F.size("splits") > 1).select(two.alias("p")).groupBy(F.col("p.a").alias("split_a"), F.col("p.b").alias("split_b")).agg(F.count("*").alias("n_shared"))
