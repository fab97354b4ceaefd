"""Equivalence of two answers by rules and, where these leave it open, by entailment.

A model is a callable of two lists, premises and hypotheses, that returns entailment
probabilities. It sees each distinct ordered pair of texts once, in batches, however
many rows share the pair.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import anchored_short_answer, is_blank, normalized_answer, stripped, word_count
from ..sources.shared import held
from ..streaming.resume import resume
from .semantic import first_fit_of

#: Probabilities from which entailment counts, and words of a short answer.
BOTH_WAYS, ONE_WAY, SHORT = 0.85, 0.85, 3

Predict = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


def by_rules(a: Column, b: Column) -> Column:
    """False if a text is blank, true if both are equal but for case or one opens the other
    as a short answer, null where only entailment can tell."""
    # equal but for case: inner white space counts, so normalised texts alone don't decide
    spaces = lambda c: F.regexp_replace(stripped(c), r"(?U)[^\s\x1c-\x1f]+", "x")
    equal = (normalized_answer(a) == normalized_answer(b)) & (spaces(a) == spaces(b))
    return F.when(is_blank(a) | is_blank(b), False).when(equal | anchored_short_answer(a, b) | anchored_short_answer(b, a), True)


def by_entailment(a: Column, b: Column, a_to_b: Column, b_to_a: Column) -> Column:
    """Entailment both ways, or of a short answer by the longer one."""
    wa, wb = word_count(a), word_count(b)
    short = ((wa <= SHORT) & (wb > wa) & (b_to_a >= ONE_WAY)) | ((wb <= SHORT) & (wa > wb) & (a_to_b >= ONE_WAY))
    return ((a_to_b >= BOTH_WAYS) & (b_to_a >= BOTH_WAYS)) | short


def open_pairs(pairs: DataFrame) -> DataFrame:
    """The distinct (premise, hypothesis) that rules leave open among pairs (a, b), both ways."""
    left = pairs.select(F.col("a"), F.col("b"), by_rules(F.col("a"), F.col("b")).alias("_same")).filter("_same is null")
    both = F.explode(F.array(F.struct(F.col("a").alias("premise"), F.col("b").alias("hypothesis")), F.struct(F.col("b").alias("premise"), F.col("a").alias("hypothesis"))))
    return left.select(both.alias("p")).select(stripped(F.col("p.premise")).alias("premise"), stripped(F.col("p.hypothesis")).alias("hypothesis")).distinct()


def entailment(pairs: DataFrame, predict: Predict, batch: int = 64) -> DataFrame:
    """(premise, hypothesis, probability) of distinct pairs; blank texts have probability 0 without the model."""

    def run(frames):
        for pdf in frames:
            values = []
            some = [(p, h) for p, h in zip(pdf["premise"], pdf["hypothesis"]) if p.strip() and h.strip()]
            for i in range(0, len(some), batch):
                part = some[i : i + batch]
                values += [float(v) for v in predict([p for p, _ in part], [h for _, h in part])]
            found = dict(zip(some, values))
            yield pd.DataFrame({"premise": pdf["premise"], "hypothesis": pdf["hypothesis"], "probability": [found.get(k, 0.0) for k in zip(pdf["premise"], pdf["hypothesis"])]})

    return pairs.select("premise", "hypothesis").mapInPandas(run, "premise string, hypothesis string, probability double")


def remembered(pairs: DataFrame, predict: Predict, store: str, revision: str, batch: int = 64) -> DataFrame:
    """:func:`entailment` with a memory over runs: the table of model ``revision`` below ``store``
    is addressed by the texts, the model is asked only for pairs that it lacks, and what it says
    is committed before it is used. Two runs at once keep one answer for a pair."""
    # texts are told apart by their lengths, whatever they hold
    address = F.sha2(F.concat_ws(":", F.length("premise").cast("string"), F.length("hypothesis").cast("string"), "premise", "hypothesis"), 256)
    keyed = pairs.select("premise", "hypothesis", address.alias("pair"))
    ask = lambda rows: entailment(rows, predict, batch).withColumn("pair", address)
    known = resume(keyed, f"{store}/{revision}", "pair", ask)
    return known.join(keyed.select("pair").distinct(), "pair", "left_semi").select("premise", "hypothesis", "probability")


def equivalent(pairs: DataFrame, probabilities: DataFrame) -> DataFrame:
    """``pairs`` (a, b and more) with ``same``; a probability that isn't known counts as 0."""
    rows = pairs.withColumn("_same", by_rules(F.col("a"), F.col("b")))
    known = lambda p, h, n: probabilities.select(F.col("premise").alias(f"_p{n}"), F.col("hypothesis").alias(f"_h{n}"), F.col("probability").alias(n))
    a, b = stripped(F.col("a")), stripped(F.col("b"))
    rows = rows.join(known("a", "b", "_ab"), (a == F.col("_p_ab")) & (b == F.col("_h_ab")), "left").join(known("b", "a", "_ba"), (b == F.col("_p_ba")) & (a == F.col("_h_ba")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    same = F.coalesce(F.col("_same"), by_entailment(a, b, zero("_ab"), zero("_ba")))
    return rows.select(*pairs.columns, same.alias("same"))


def clustered(rows: DataFrame, key: str, predict: Predict | None = None, probabilities: DataFrame | None = None, answers: str = "answers", store: str | None = None, revision: str | None = None) -> DataFrame:
    """``rows`` with ``ids``, first-fit clusters of each row's answers under :func:`equivalent`.

    A row's few answers are compared with those before them; all rows' distinct pairs go to
    the model (or are looked up in ``probabilities``) together, once; with a ``store`` what model
    ``revision`` said in earlier runs is not asked again. Keys are unique."""
    tidy = F.transform(answers, lambda x: F.coalesce(x, F.lit("")))
    before = F.flatten(F.transform(tidy, lambda a, i: F.transform(F.slice(tidy, F.lit(1), i), lambda b, j: F.struct(i.alias("i"), j.alias("j"), a.alias("a"), b.alias("b")))))
    pairs = rows.select(F.col(key).alias("_key"), F.explode(before).alias("p")).select("_key", "p.*")
    if probabilities is None:
        probabilities = held(entailment(open_pairs(pairs), predict)) if store is None else remembered(open_pairs(pairs), predict, store, revision or "unnamed")
    links = equivalent(pairs, probabilities).filter("same").groupBy("_key").agg(F.collect_list(F.struct("i", "j")).alias("_links"))
    none = F.array().cast("array<struct<i:int,j:int>>")
    joined = rows.join(links, rows[key] == links["_key"], "left")
    empty = F.raise_error(F.lit("no answers to cluster")).cast("array<int>")
    ids = F.when(F.size(answers) > 0, first_fit_of(F.size(answers), F.coalesce("_links", none))).otherwise(empty)
    return joined.select(*rows.columns, ids.alias("ids"))
