"""Linear probes: one for each layer of feature vectors with the choice of the best layer, and over named feature sets."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import held
from .fusion import Logistic, fit_many, standardised
from .metrics import auroc, best_by

#: Groups in which the sums of partitions are added before the driver adds the groups.
LANES = 32
#: Width up to which a fit takes Newton steps, and the moves that a wider one remembers.
NEWTON_WIDTH, MEMORY = 256, 20


@dataclass(frozen=True)
class Probe:
    """Weights on the features as they are (the scale is folded in) and the intercept."""

    coef: np.ndarray
    intercept: float


def layer_sums(rows: DataFrame, own: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """``own(layer, x, y)`` of all batches of (layer, y, x), added up for each layer: in a task,
    then in LANES groups, then on the driver, which gets LANES arrays a layer however many
    partitions there are."""

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            layer, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            widths = np.unique(pc.list_value_length(batch.column(2)).to_numpy())
            if len(widths) > 1:
                raise ValueError(f"features of different widths: {widths.tolist()}")
            x = batch.column(2).flatten().to_numpy().reshape(len(layer), -1)
            for k in np.unique(layer):
                some = layer == k
                sums[int(k)] = sums.get(int(k), 0) + own(int(k), x[some], y[some])
        lane = TaskContext.get().partitionId() % LANES
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([lane] * len(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["layer", "lane", "packed"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v) for v in pdf["packed"])
        return pd.DataFrame({"layer": pdf["layer"][:1], "packed": [total.tobytes()]})

    out: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(partial, "layer int, lane int, packed binary").groupBy("layer", "lane").applyInPandas(add, "layer int, packed binary").collect():
        out[r.layer] = out.get(r.layer, 0) + np.frombuffer(r.packed)
    return out


class Search:
    """The way of one penalised fit to its rest: by Newton steps where the Hessian is given,
    else by limited-memory BFGS; a step that doesn't lower the loss enough is halved."""

    def __init__(self, size: int, rows: float, c: float, tol: float, free_intercept: bool):
        self.rows, self.tol, self.done = rows, tol, False
        self.ridge = np.full(size, 1 / (c * rows))
        if free_intercept:
            self.ridge[0] = 0
        self.look, self.at, self.step = np.zeros(size), None, 1.0
        self.past: deque = deque(maxlen=MEMORY)

    def take(self, sums: np.ndarray) -> None:
        """Take loss, gradient and perhaps Hessian, all summed over the rows, at ``look``."""
        if not np.isfinite(sums).all():
            raise ValueError("features hold values that are not finite")
        size = len(self.look)
        value = sums[0] / self.rows + (self.ridge * self.look**2).sum() / 2
        slope = sums[1 : size + 1] / self.rows + self.ridge * self.look
        if self.at is not None and value > self.value + 1e-4 * self.step * (self.way @ self.slope) + 1e-13 * abs(self.value):
            self.step /= 2
        else:
            if self.at is not None and (self.look - self.at) @ (slope - self.slope) > 0:
                self.past.append((self.look - self.at, slope - self.slope))
            self.at, self.value, self.slope, self.step = self.look, value, slope, 1.0
            self.done = bool(np.abs(slope).max() <= self.tol)
            self.way = -np.linalg.solve(sums[size + 1 :].reshape(size, size) / self.rows + np.diag(self.ridge + 1e-12), slope) if len(sums) > size + 1 else self.descent()
        self.look = self.at + self.step * self.way

    def descent(self) -> np.ndarray:
        """The two-loop recursion over the last MEMORY moves."""
        way, shares = -self.slope, []
        if not self.past:
            return way / max(1.0, float(np.linalg.norm(way)))
        for move, turn in reversed(self.past):
            shares.append((move @ way) / (move @ turn))
            way = way - shares[-1] * turn
        move, turn = self.past[-1]
        way = way * ((move @ turn) / (turn @ turn))
        for (move, turn), share in zip(self.past, reversed(shares)):
            way = way + (share - (turn @ way) / (move @ turn)) * move
        return way


def layer_probes(rows: DataFrame, train: Column, c: float = 1.0, newton_width: int = NEWTON_WIDTH, steps: int = 1000, tol: float = 1e-6, free_intercept: bool = False) -> tuple[dict[int, Probe], DataFrame]:
    """Fit a probe for each layer on the ``train`` rows of (sample_id, label, layer, features),
    standardised there; return the probes and all other rows with their score (the decision).

    Penalty |w|^2 / (2c) beside the summed loss; the intercept is penalised as a weight on a
    feature that is always 1, unless it is to be free; a constant component is only centred. All layers step in one job; a job sends the driver a gradient for each layer and
    lane, and the Hessian only up to ``newton_width`` components. Rows with a null label, layer,
    vector or component take no part in the fit; such a vector's score, and that of a layer
    without training rows, is null. Vectors of different widths are an error, and so is a fit not
    at rest (no component of the mean loss's gradient above ``tol``) after ``steps`` jobs."""
    context = rows.sparkSession.sparkContext
    x = F.col("features").cast("array<double>")
    whole = (F.size("features") > 0) & ~F.exists("features", lambda v: v.isNull())
    learnt = rows.filter(train).filter(whole & F.col("label").isNotNull() & F.col("layer").isNotNull()).select(F.col("layer").cast("int").alias("layer"), F.col("label").cast("double").alias("y"), x.alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    sums = layer_sums(learnt, lambda k, x, y: np.concatenate([[len(y)], x.sum(0)]))
    mean = {k: v[1:] / v[0] for k, v in sums.items()}
    sent = context.broadcast(mean)
    spread = layer_sums(learnt, lambda k, x, y: ((x - sent.value[k]) ** 2).sum(0))
    sd = {k: np.where(v > 0, np.sqrt(v / sums[k][0]), 1.0) for k, v in spread.items()}
    searches = {k: Search(len(mean[k]) + 1, sums[k][0], c, tol, free_intercept) for k in sums}
    for _ in range(steps):
        live = {k: s for k, s in searches.items() if not s.done}
        if not live:
            break
        state = context.broadcast({k: (mean[k], sd[k], s.look) for k, s in live.items()})

        def loss(k, x, y, state=state):
            m, s, w = state.value[k]
            x = (x - m) / s
            z = x @ w[1:] + w[0]
            q = 0.5 * (1 + np.tanh(z / 2))
            parts = [[(np.logaddexp(0, z) - y * z).sum(), (q - y).sum()], x.T @ (q - y)]
            if len(m) <= newton_width:
                one = np.column_stack([np.ones(len(y)), x])
                parts.append(((one * (q * (1 - q))[:, None]).T @ one).ravel())
            return np.concatenate(parts)

        for k, found in layer_sums(learnt.filter(F.col("layer").isin(list(live))), loss).items():
            live[k].take(found)
        state.unpersist()
    learnt.unpersist()
    if open_ := [k for k, s in searches.items() if not s.done]:
        raise RuntimeError(f"not at rest after {steps} steps: layers {sorted(open_)}")
    probes = {k: Probe(s.at[1:] / sd[k], float(s.at[0] - (s.at[1:] / sd[k]) @ mean[k])) for k, s in searches.items()}
    return probes, rows.filter(~train).withColumn("score", decision(context, probes)(F.col("layer").cast("int"), F.when(whole, x)))


def decision(context: SparkContext, probes: dict[int, Probe]):
    """A function of layer and vector columns: the layer's probe on the vector, null where either is missing."""
    sent = context.broadcast(probes)

    @F.pandas_udf("double")
    def score(layer: pd.Series, vector: pd.Series) -> pd.Series:
        one = lambda k, v: np.nan if v is None or k not in sent.value else sent.value[k].intercept + float(v @ sent.value[k].coef)
        return pd.Series([one(k, v) for k, v in zip(layer, vector)], dtype="float64").replace(np.nan, None)

    return score


def feature_models(rows: DataFrame, train: Column, test: Column, sets: dict[str, list[str]], c: float = 1.0, free_intercept: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(feature, label, score) of the ``test`` rows, with their columns ``keep``, for a logistic regression on each named
    set of columns, standardised and fitted on the ``train`` rows; a score of at least 0
    predicts label 1. The intercept is penalised like a weight, unless it is to be free. A feature that doesn't vary in training is only centred.
    Features are worked out once and stored; all sets are fitted together."""
    features = sorted({f for s in sets.values() for f in s})
    rows = held(rows.select("label", *features, *[k for k in keep or [] if k not in features], train.alias("_train"), test.alias("_test")).filter("_train or _test"))
    row = rows.filter("_train").agg(*[g(f).alias(f"{f}__{n}") for f in features for n, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    ready = standardised(rows, {f: (row[f"{f}__m"] or 0.0, row[f"{f}__s"] or 1.0) for f in features})
    models = fit_many(ready.filter("_train"), features, {n: (c, None, None) for n in sets}, free_intercept=free_intercept, sets=sets)
    scores = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), models[n].decision().alias("score")) for n in sets])).alias("e")
    return ready.filter("_test").select("label", *(keep or []), scores).select("e.feature", "label", *(keep or []), "e.score")


def layer_table(scored: DataFrame) -> DataFrame:
    """AUROC of each layer and which is best (the first on ties, null worst)."""
    table = auroc(scored, ["layer"])
    best = best_by(table, "auroc", "layer").select(F.col("layer").alias("best"))
    return table.join(F.broadcast(best)).select("layer", "auroc", (F.col("layer") == F.col("best")).alias("is_best"))
