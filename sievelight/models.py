"""The boundary to models: what a caller plugs in, and how it meets DataFrames.

Generators, encoders and trainers are objects that are shipped to tasks and called on
batches; everything before and after them is columns. Tests plug in fakes.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import derived_seed

GENERATION = "mode string, sample_index int, seed long, text string, token_ids array<int>, token_logprobs array<double>, num_tokens int, sum_logprob double, mean_logprob double, truncated boolean"


class Generator(Protocol):
    """Continues prompts: for each a dict with text, token_ids, token_logprobs and truncated."""

    def __call__(self, prompts: Sequence[str], seeds: Sequence[int] | None) -> list[dict]: ...


class Encoder(Protocol):
    """Token states: for each text a list with one vector for each of the asked layers."""

    def __call__(self, texts: Sequence[str], layers: Sequence[int]) -> list[list[Sequence[float]]]: ...


class Backend(Protocol):
    """A trainable detector. ``train`` yields (epoch, validation scores as (sample_id, score), checkpoint
    folder or file); ``score`` gives (sample_id, score) of samples under a checkpoint."""

    def train(self, setting: dict, train: DataFrame, validation: DataFrame, folder: str) -> list[tuple[int, DataFrame, str]]: ...

    def score(self, setting: dict, checkpoint: str, samples: DataFrame) -> DataFrame: ...


def generated(rows: DataFrame, generator: Generator, key: str = "sample_id", prompt: str = "prompt", samples: int = 1, seed: int | None = None, chunk: int = 5) -> DataFrame:
    """(key, generation columns): ``samples`` continuations of every prompt, in chunks.

    Without ``seed`` the mode is greedy; with it each continuation has a seed of its own, made
    from the seed, the key and its index, so any part can be made again alone."""
    mode = "greedy" if seed is None else "sample"
    spread = rows.select(F.col(key), F.col(prompt).alias("_prompt"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_index"))
    spread = spread.withColumn("seed", F.lit(None).cast("long") if seed is None else derived_seed(seed, F.col(key), F.col("sample_index")))

    def run(frames):
        for pdf in frames:
            made = []
            for i in range(0, len(pdf), chunk):
                part = pdf.iloc[i : i + chunk]
                made += generator(part["_prompt"].tolist(), None if seed is None else [int(s) for s in part["seed"]])
            sums = [float(sum(m["token_logprobs"])) for m in made]
            sizes = [len(m["token_ids"]) for m in made]
            yield pd.DataFrame(
                {
                    key: pdf[key].values, "mode": mode, "sample_index": pdf["sample_index"].values, "seed": pdf["seed"].values, "text": [m["text"].strip() for m in made],
                    "token_ids": [list(m["token_ids"]) for m in made], "token_logprobs": [list(map(float, m["token_logprobs"])) for m in made], "num_tokens": sizes,
                    "sum_logprob": sums, "mean_logprob": [s / max(n, 1) for s, n in zip(sums, sizes)], "truncated": [bool(m["truncated"]) for m in made],
                }
            )

    kind = rows.schema[key].dataType.simpleString()
    return spread.mapInPandas(run, f"{key} {kind}, {GENERATION}")


def encoded(rows: DataFrame, encoder: Encoder, layers: Sequence[int], key: str = "sample_id", text: str = "text") -> DataFrame:
    """(key, layer, features): one vector for each text and layer, as probes read them."""

    def run(frames):
        for pdf in frames:
            found = encoder([t or "" for t in pdf[text]], list(layers))
            yield pd.DataFrame([(k, int(n), [float(x) for x in v]) for k, vs in zip(pdf[key], found) for n, v in zip(layers, vs)], columns=[key, "layer", "features"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, layer int, features array<double>")
