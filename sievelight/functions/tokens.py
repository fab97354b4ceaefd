"""Token columns: lengths with a cache, answer spans, log-probabilities and pooled states.

A tokenizer is a callable that turns a list of texts into a list of id lists.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import exists
from .text import is_blank, stripped

Tokenizer = Callable[[list[str]], list[Sequence[int]]]

#: The ways in which token states are pooled.
POOLINGS = ("tbg", "last_answer", "mean_answer", "eot")


def token_ids(tokenizer: Tokenizer):
    """Function of a text column: its token ids, in Arrow batches; null text has none."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(text: pd.Series) -> pd.Series:
        return pd.Series([[int(i) for i in x] for x in tokenizer([t or "" for t in text])], dtype=object)

    return ids


def with_token_lengths(samples: DataFrame, tokenizer: Tokenizer, fingerprint: str, cache: str | None = None, text: str = "answer", key: str = "sample_id") -> DataFrame:
    """``samples`` with ``answer_length_tokens``.

    ``cache`` is a folder of (key, length) partitioned by the tokenizer's fingerprint: only keys
    that it lacks under this fingerprint are tokenized, and then added."""
    spark, name = samples.sparkSession, "answer_length_tokens"
    rows = samples.drop(name)
    counted = lambda df: df.select(F.col(key), F.size(token_ids(tokenizer)(F.col(text))).alias(name))
    if cache is None:
        return rows.withColumn(name, F.size(token_ids(tokenizer)(F.col(text))))
    fields = T.StructType([samples.schema[key], T.StructField(name, T.IntegerType()), T.StructField("tokenizer", T.StringType())])
    known = lambda: spark.read.schema(fields).parquet(cache).filter(F.col("tokenizer") == fingerprint).select(key, name)
    new = rows.join(known().select(key), key, "left_anti") if exists(spark, cache) else rows
    counted(new.dropDuplicates([key])).withColumn("tokenizer", F.lit(fingerprint)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    return rows.join(known(), key, "left")


def answer_span(prompt_ids: Column, answer_ids: Column, end_id: int) -> tuple[Column, Column, Column]:
    """Ids of prompt, answer and the end token, and the answer's first and past-the-last place.
    Both parts are tokenized on their own, so the boundary is exact; an empty answer is an error."""
    whole = F.concat(prompt_ids, answer_ids, F.array(F.lit(end_id)))
    checked = F.when(F.size(answer_ids) == 0, F.raise_error(F.lit("empty answer")).cast("array<int>")).otherwise(whole)
    return checked, F.size(prompt_ids), F.size(prompt_ids) + F.size(answer_ids)


def answer_text(answer: Column) -> Column:
    """The stripped answer as it is tokenized; a blank one is an error."""
    return F.when(is_blank(answer), F.raise_error(F.lit("empty answer")).cast("string")).otherwise(stripped(answer))


def target_logprobs(logits: Column, targets: Column) -> Column:
    """Log-softmax of each step's logits (array of arrays) at its target id."""

    def one(row, target):
        top = F.array_max(row)
        total = F.aggregate(row, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return F.get(row, target) - top - F.ln(total)

    return F.zip_with(logits, targets, one)


def resolved(poolings: Sequence[str], layers: Sequence[int] | None, n_layers: int) -> tuple[list[str], list[int]]:
    """Poolings and layer numbers after a check; no layers means all."""
    bad = [p for p in poolings if p not in POOLINGS]
    if bad or not poolings:
        raise ValueError(f"poolings must be some of {POOLINGS}, got {list(poolings)}")
    out = list(range(n_layers)) if layers is None else [int(x) for x in layers]
    if any(not 0 <= x < n_layers for x in out):
        raise ValueError(f"layers must lie in 0 to {n_layers - 1}, got {out}")
    return list(poolings), out


def pooled(states: Column, start: Column, end: Column, pooling: str) -> Column:
    """One vector from a layer's token states (array of arrays): of the token before the answer
    (tbg), its last token, the mean over it, or the token after it (eot)."""
    resolved([pooling], None, 1)
    if pooling == "tbg":
        return F.get(states, start - 1)
    if pooling == "last_answer":
        return F.get(states, end - 1)
    if pooling == "eot":
        return F.get(states, end)
    some = F.slice(states, start + 1, end - start)
    zero = F.transform(F.get(some, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(some, zero, lambda a, x: F.zip_with(a, x, lambda u, v: u + v.cast("double")))
    return F.transform(total, lambda x: x / F.size(some))


def efficiency_fields() -> list[Column]:
    """Costs of a generation's statistics under the names that detector records use."""
    take = lambda old, kind, new: F.col(old).cast(kind).alias(new)
    return [take("wall_time_s", "double", "latency_s"), take("num_sequences", "long", "n_generations"), take("new_tokens_total", "long", "n_generated_tokens"), take("peak_gpu_mem_mb", "double", "peak_gpu_mem_mb")]
