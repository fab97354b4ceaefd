"""Semantic clusters of generated answers and entropy scores over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, stripped


def _answers(answers: Column) -> Column:
    """Stripped answers, null as empty; a null or empty list is an error."""
    none = answers.isNull() | (F.size(answers) == 0)
    tidy = F.transform(answers, lambda x: stripped(F.coalesce(x, F.lit(""))))
    return F.when(none, F.raise_error(F.lit("no answers to cluster")).cast("array<string>")).otherwise(tidy)


def first_fit(answers: Column, equivalent: Callable[[Column, Column], Column]) -> Column:
    """Cluster numbers by first fit against representatives: an answer joins the first
    cluster whose representative it is equivalent to, else it opens one. A null answer is an empty one."""
    empty = F.struct(F.array().cast("array<string>").alias("reps"), F.array().cast("array<int>").alias("ids"))

    def step(acc, x):
        fits = F.filter(F.transform(acc["reps"], lambda r, i: F.when(equivalent(x, r), i)), lambda i: i.isNotNull())
        opened = F.size(fits) == 0
        return F.struct(
            F.when(opened, F.concat(acc["reps"], F.array(x))).otherwise(acc["reps"]).alias("reps"),
            F.concat(acc["ids"], F.array(F.when(opened, F.size(acc["reps"])).otherwise(F.get(fits, F.lit(0))))).alias("ids"),
        )

    return F.aggregate(_answers(answers), empty, step, lambda acc: acc["ids"])


def first_fit_of(n: Column, linked: Column) -> Column:
    """:func:`first_fit` of n answers by number, equivalent where ``linked`` (array of structs i, j) has them."""
    empty = F.struct(F.array().cast("array<int>").alias("reps"), F.array().cast("array<int>").alias("ids"))

    def step(acc, x):
        joins = lambda r: F.exists(linked, lambda e: (e["i"] == x) & (e["j"] == r))
        fits = F.filter(F.transform(acc["reps"], lambda r, i: F.when(joins(r), i)), lambda i: i.isNotNull())
        opened = F.size(fits) == 0
        return F.struct(
            F.when(opened, F.concat(acc["reps"], F.array(x))).otherwise(acc["reps"]).alias("reps"),
            F.concat(acc["ids"], F.array(F.when(opened, F.size(acc["reps"])).otherwise(F.get(fits, F.lit(0))))).alias("ids"),
        )

    return F.aggregate(F.sequence(F.lit(0), n - 1), empty, step, lambda acc: acc["ids"])


def cluster_shares(ids: Column) -> Column:
    """Share of each cluster number, in order of number."""
    return F.transform(F.array_sort(F.array_distinct(ids)), lambda c: F.size(F.filter(ids, lambda x: x == c)) / F.size(ids))


def entropy(ids: Column) -> Column:
    """Entropy of the clusters in nats."""
    return F.aggregate(cluster_shares(ids), F.lit(0.0), lambda a, p: a - p * F.ln(p))


def normalized_entropy(ids: Column) -> Column:
    """Entropy over ln of the number of clusters; 0 if there is at most one."""
    k = F.size(F.array_distinct(ids))
    return F.when(k <= 1, F.lit(0.0)).otherwise(entropy(ids) / F.ln(F.greatest(k, F.lit(2)).cast("double")))


def scored_candidate(ids: Column) -> dict[str, Column]:
    """What cluster numbers of the generations and, last, the candidate say of it. The
    candidate adds no mass; the score is one minus the share of its cluster."""
    n = F.size(ids) - 1
    own, made = F.element_at(ids, -1), F.slice(ids, F.lit(1), n)
    share = F.try_divide(F.size(F.filter(made, lambda x: x == own)).cast("double"), n)
    return {
        "probability": share, "score": 1 - share, "matched": share > 0, "cluster_id": F.when(share > 0, own),
        "num_clusters": F.size(F.array_distinct(made)), "num_generations": n, "global_entropy": entropy(made),
    }


def candidate_score(answers: Column, candidate: Column, equivalent: Callable[[Column, Column], Column]) -> dict[str, Column]:
    """:func:`scored_candidate` by first fit. No generations or a blank candidate is an error."""
    blank = F.raise_error(F.lit("empty candidate")).cast("string")
    own = F.when(is_blank(candidate), blank).otherwise(candidate)
    none = F.raise_error(F.lit("no generations")).cast("array<string>")
    some = F.when(answers.isNull() | (F.size(answers) == 0), none).otherwise(answers)
    return scored_candidate(first_fit(F.concat(some, F.array(own)), equivalent))


def grouped_generations(rows: DataFrame, prompt: str, order: str, answer: str, k: int = 10) -> DataFrame:
    """The first k answers of each prompt as generations and the next as candidate."""
    listed = rows.groupBy(prompt).agg(F.array_sort(F.collect_list(F.struct(order, answer))).alias("_l"))
    texts = F.transform("_l", lambda x: x[answer])
    return listed.filter(F.size("_l") > k).select(prompt, F.slice(texts, 1, k).alias("answers"), F.get(texts, F.lit(k)).alias("candidate"))


def consecutive_generations(rows: DataFrame, prompt: str, order: str, answer: str, k: int = 10) -> DataFrame:
    """All rows of each prompt, in order, as consecutive groups (``group_no`` from 0) of k
    answers and a candidate. A last group of fewer rows has up to k answers, no candidate
    and is not ``complete``."""
    n = F.row_number().over(Window.partitionBy(prompt).orderBy(order)) - 1
    cut = rows.select(prompt, F.struct(n.alias("n"), F.col(answer).alias("a")).alias("_x")).withColumn("group_no", F.floor(F.col("_x.n") / (k + 1)))
    listed = cut.groupBy(prompt, "group_no").agg(F.array_sort(F.collect_list("_x")).alias("_l"))
    texts = F.transform("_l", lambda x: x["a"])
    return listed.select(prompt, "group_no", F.slice(texts, 1, k).alias("answers"), F.get(texts, F.lit(k)).alias("candidate"), (F.size("_l") > k).alias("complete"))
