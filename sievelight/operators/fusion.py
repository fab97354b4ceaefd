"""Late score fusion: transforms, standardisation, and logistic regression by Newton steps.

A step needs only the sums of gradient and Hessian, so the data stay distributed
and the driver solves a system as wide as the feature list. Several models (a grid
of C over folds) are stepped in one job.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed grid of inverse penalties.
C_GRID = (0.01, 0.1, 1.0, 10.0, 100.0)
CLIP = 1e-12


def logit(p: Column) -> Column:
    """ln(p / (1 - p)), clipped; values outside [0, 1] are an error."""
    q = F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))
    return F.when((p < 0) | (p > 1), F.raise_error(F.lit("logit needs values in [0, 1]")).cast("double")).otherwise(F.ln(q / (1 - q)))


def log_length(length: Column) -> Column:
    return F.ln(F.greatest(length, F.lit(1)).cast("double"))


def standardisation(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each feature; a constant feature is an error."""
    row = df.agg(*[f(c).alias(f"{c}__{n}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    out = {c: (row[f"{c}__m"], row[f"{c}__s"]) for c in features}
    constant = [c for c, (_, s) in out.items() if not s]
    if constant:
        raise ValueError(f"constant input: {', '.join(constant)}")
    return out


def standardised(df: DataFrame, fit: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in fit.items()})


@dataclass(frozen=True)
class Logistic:
    """Coefficients on standardised features and the intercept."""

    features: tuple[str, ...]
    coef: tuple[float, ...]
    intercept: float

    def decision(self) -> Column:
        out = F.lit(self.intercept)
        for c, w in zip(self.features, self.coef):
            out = out + F.lit(w) * F.col(c)
        return out

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.decision()))

    def raw_scale(self, fit: dict[str, tuple[float, float]]) -> Logistic:
        """The same decision on features as they were before standardisation."""
        coef = tuple(w / fit[c][1] for c, w in zip(self.features, self.coef))
        return Logistic(self.features, coef, self.intercept - sum(w * fit[c][0] for c, w in zip(self.features, coef)))


def fit_many(
    df: DataFrame, features: list[str], models: dict[str, tuple[float, int | None, int | None]], label: str = "label", fold: str | None = None, group: str | None = None, steps: int = 100, tol: float = 1e-8, vector: str | None = None, free_intercept: bool = True, sets: dict[str, list[str]] | None = None
) -> dict[str, Logistic]:
    """Fit models {name: (C, fold left out or None, group kept or None)}: penalty
    |w|^2 / (2C) beside the summed loss; the intercept is free, or else penalised like a weight
    on a feature that is always 1. ``sets`` names the features of models that don't use all;
    however many models there are, a step reads the rows once. Each partition adds up its
    own gradients and Hessians in numpy; the sums are added per model and place.
    With ``vector``, an array column holds the features in their order. Steps that
    haven't come to rest after ``steps`` are an error."""
    spark, own_features = df.sparkSession, {n: list((sets or {}).get(n, features)) for n in models}
    places = {n: [0, *[1 + features.index(f) for f in own]] for n, own in own_features.items()}  # 0 is the intercept
    weights = {n: np.zeros(len(at)) for n, at in places.items()}
    live = set(models)
    x = F.col(vector).cast("array<double>") if vector else F.array(*[F.col(c).cast("double") for c in features])
    key = lambda c: F.col(c).cast("int") if c else F.lit(-1)
    rows = df.select(F.col(label).cast("double").alias("y"), key(fold).alias("fold"), key(group).alias("grp"), x.alias("x")).persist()
    for _ in range(steps):
        if not live:
            break
        shipped = spark.sparkContext.broadcast({n: (models[n], places[n], weights[n]) for n in sorted(live)})

        def partial(batches, shipped=shipped, width=len(features)):
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                if pc.any(pc.not_equal(pc.fill_null(pc.list_value_length(batch["x"]), -1), width)).as_py():
                    raise ValueError(f"every row needs {width} features")
                x = np.column_stack([np.ones(batch.num_rows), batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)])
                y, folds, groups = (batch[c].to_numpy(zero_copy_only=False) for c in ("y", "fold", "grp"))
                for k, g in {*zip(folds.tolist(), groups.tolist())}:
                    some = (folds == k) & (groups == g)
                    part, said = (x, y) if some.all() else (x[some], y[some])
                    for name, ((_, skip, only), at, w) in shipped.value.items():
                        if k == skip or (only is not None and g != only):
                            continue
                        xs = part if len(at) == part.shape[1] and at == sorted(at) else part[:, at]
                        q = 1 / (1 + np.exp(-np.clip(xs @ w, -500, 500)))
                        own = np.concatenate([xs.T @ (q - said), ((xs * (q * (1 - q))[:, None]).T @ xs).ravel()])
                        sums[name] = sums.get(name, 0) + own
            for name, values in sums.items():
                yield pa.RecordBatch.from_pydict({"model": [name] * len(values), "place": pa.array(np.arange(len(values)), pa.int32()), "value": values})

        added = rows.mapInArrow(partial, "model string, place int, value double").groupBy("model", "place").agg(F.sum("value").alias("value")).collect()
        found: dict[str, np.ndarray] = {n: np.zeros(len(places[n]) * (len(places[n]) + 1)) for n in {r.model for r in added}}
        for r in added:
            found[r.model][r.place] = r.value
        for n, values in found.items():
            w, p = weights[n], len(places[n])
            ridge = np.full(p, 1 / models[n][0])
            if free_intercept:
                ridge[0] = 0
            move = np.linalg.solve(values[p:].reshape(p, p) + np.diag(ridge) + 1e-12 * np.eye(p), values[:p] + ridge * w)
            weights[n] = w - move * min(1.0, 5.0 / max(1e-12, np.abs(move).max()))
            if np.abs(move).max() < tol:
                live.discard(n)
        live &= set(found)
    rows.unpersist()
    if live:
        raise RuntimeError(f"not at rest after {steps} steps: {', '.join(sorted(live))}")
    return {n: Logistic(tuple(own_features[n]), tuple(w[1:].tolist()), float(w[0])) for n, w in weights.items()}


def fit_logistic(df: DataFrame, features: list[str], c: float = 1.0, label: str = "label") -> Logistic:
    return fit_many(df, features, {"m": (c, None, None)}, label)["m"]


@dataclass(frozen=True)
class Fusion:
    scale: dict[str, tuple[float, float]]
    model: Logistic
    c: float
    cv_log_loss: dict[float, float]


def fit_fusion(validation: DataFrame, features: list[str], group: str = "pair_id", folds: int = 5, seed: int = 42) -> tuple[Fusion, DataFrame]:
    """Fusion learnt on validation rows only, and their out-of-fold scores.

    C is the grid's least grouped-fold log-loss (ties: the smaller C). The rows are made once and stored.
    """
    from ..sources.shared import held
    from .splits import grouped_folds

    validation = held(validation)
    scale = standardisation(validation, features)
    rows = held(grouped_folds(standardised(validation, scale), group, folds, seed))
    grid = {f"{c}|{k}": (c, k, None) for c in C_GRID for k in range(folds)} | {f"{c}|all": (c, None, None) for c in C_GRID}
    models = fit_many(rows, features, grid, fold="fold")  # folds and whole data take their steps together
    by_fold = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("fold"))

    def pick(c):
        own = [models[f"{c}|{k}"] for k in range(folds)]
        out = by_fold([m.intercept for m in own])
        for i, f in enumerate(features):
            out = out + by_fold([m.coef[i] for m in own]) * F.col(f)
        return out

    scored = rows.withColumns({f"oof_{i}": pick(c) for i, c in enumerate(C_GRID)})
    p = lambda i: F.greatest(F.least(1 / (1 + F.exp(-F.col(f"oof_{i}"))), F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = scored.agg(*[(-F.avg(F.when(F.col("label") == 1, F.ln(p(i))).otherwise(F.ln(1 - p(i))))).alias(f"l{i}") for i in range(len(C_GRID))]).first()
    losses = {c: loss[f"l{i}"] for i, c in enumerate(C_GRID)}
    best = min(C_GRID, key=lambda c: (losses[c], c))
    model = models[f"{best}|all"]
    keep = [c for c in validation.columns if c not in features]
    return Fusion(scale, model, best, losses), scored.select(*keep, F.col(f"oof_{C_GRID.index(best)}").alias("score"))


def apply_fusion(df: DataFrame, fusion: Fusion, name: str = "score") -> DataFrame:
    return standardised(df, fusion.scale).withColumn(name, fusion.model.decision())


def average_score(df: DataFrame, features: list[str], scale: dict[str, tuple[float, float]], name: str = "score") -> DataFrame:
    """Unfitted mean of the standardised features."""
    return standardised(df, scale).withColumn(name, sum((F.col(c) for c in features), F.lit(0.0)) / len(features))


def amortised(rows: DataFrame, cost: str, pair: str = "pair_id", name: str | None = None) -> DataFrame:
    """Cost of a pair-shared generation split over the pair's rows."""
    sizes = rows.groupBy(pair).agg(F.count("*").alias("_n"))
    return rows.join(sizes, pair).withColumn(name or cost, F.col(cost) / F.col("_n")).drop("_n")


def cost_totals(rows: DataFrame, once_per: str | None = None) -> DataFrame:
    """Summed latency, generations and tokens, and the highest memory; a shared cost counts once."""
    if once_per:  # of a key's rows the least counts, so the result is one whatever the order
        costs = F.struct("latency_s", "n_generations", "n_generated_tokens", "peak_gpu_mem_mb")
        rows = rows.groupBy(once_per).agg(F.min(costs).alias("_c")).select("_c.*")
    return rows.agg(F.sum("latency_s").alias("latency_s"), F.sum("n_generations").alias("n_generations"), F.sum("n_generated_tokens").alias("n_generated_tokens"), F.max("peak_gpu_mem_mb").alias("peak_gpu_mem_mb"))


@dataclass(frozen=True)
class Input:
    """A detector that fusion reads: scores (sample_id, score) of both splits and what made them."""

    name: str
    validation: DataFrame
    test: DataFrame
    provenance: tuple[str, str]
    transform: str = "none"
    threshold: float | None = None  # the run's own, chosen on validation

    def column(self) -> Column:
        return logit(F.col(self.name)) if self.transform == "logit" else F.col(self.name).cast("double")


def designed(samples: DataFrame, inputs: list[Input], split: str, partial: bool = False) -> DataFrame:
    """``samples`` with a column for each input. Ids must match exactly or, with ``partial``,
    samples that some input lacks are left out and only unknown ids are an error."""
    from .leakage import align, coverage
    from .validate import require_none

    out = samples
    for i in inputs:
        scores = (i.validation if split == "validation" else i.test).select("sample_id", F.col("score").alias(i.name))
        if partial:
            require_none(coverage(samples, scores).filter("problem = 'extra'"), f"{i.name}: records that are not in {split}")
            out = out.join(scores, "sample_id")
        else:
            out = align(out, scores)
    return out.withColumns({f"raw_{i.name}": F.col(i.name).cast("double") for i in inputs} | {i.name: i.column() for i in inputs})


@dataclass(frozen=True)
class FusionRun:
    fit: Fusion
    features: tuple[str, ...]
    inputs: tuple[Input, ...]
    validation: DataFrame  # out-of-fold scores
    design: DataFrame  # validation samples with the inputs, and as ``raw_<name>`` before their transform
    test: DataFrame  # samples with the inputs, ``fusion`` and ``average``
    thresholds: DataFrame  # detector, threshold
    coverage: dict[str, int]


def run_fusion(
    inputs: list[Input], validation: DataFrame, test: DataFrame, include_length: bool = False, partial: bool = False, mixed: bool = False, min_pairs: int = 100, criterion: str = "youden"
) -> FusionRun:
    """Fit on validation labels alone and score test by the fit and by the unfitted average.

    At least two inputs with names of their own and one provenance (``mixed`` accepts several).
    With ``partial`` only samples that every input covers are used; at least ``min_pairs``
    validation pairs and one test sample must be left."""
    from .metrics import score_groups, select_threshold, threshold_candidates
    from .validate import DataIntegrityError

    names = [i.name for i in inputs]
    if len(names) < 2 or len(set(names)) != len(names):
        raise ValueError("fusion needs at least two inputs with different names")
    if len({i.provenance for i in inputs}) > 1 and not mixed:
        raise DataIntegrityError("inputs of several configurations: " + "; ".join(f"{i.name} {i.provenance}" for i in inputs))
    ready = {s: designed(df, inputs, s, partial) for s, df in (("validation", validation), ("test", test))}
    if include_length:
        ready = {s: df.withColumn("log_length", log_length(F.col("length"))) for s, df in ready.items()}
        names = [*names, "log_length"]
    used = {s: df.count() for s, df in ready.items()}
    if partial:
        n = ready["validation"].select("pair_id").distinct().count()
        if n < min_pairs:
            raise ValueError(f"only {n} validation pairs are covered by every input, {min_pairs} are needed")
        if not used["test"]:
            raise ValueError("no test sample is covered by every input")
    fit, oof = fit_fusion(ready["validation"], names)
    own = average_score(ready["validation"], names, fit.scale)
    chosen = lambda df, d: select_threshold(threshold_candidates(score_groups(df, [])), [], criterion).select(F.lit(d).alias("detector"), "threshold")
    both = apply_fusion(ready["test"], fit, "fusion").select("sample_id", "fusion").join(average_score(ready["test"], names, fit.scale, "average").select("sample_id", "average"), "sample_id")
    counts = {f"{s}_{k}": v for s, df in (("validation", validation), ("test", test)) for k, v in (("used", used[s]), ("total", df.count()))}
    return FusionRun(fit, tuple(names), tuple(inputs), oof, ready["validation"], ready["test"].join(both, "sample_id"), chosen(oof, "fusion").unionByName(chosen(own, "average")), counts)


def diagnostics(rows: DataFrame, inputs: list[str], raw: dict[str, str] | None = None, length: str = "length") -> DataFrame:
    """(input, auroc, n_distinct, clipped, spearman_length): facts about each input column on
    validation; ``raw`` names the column before the logit whose clipped share is told."""
    from ..functions.stats import spearman
    from .metrics import auroc

    out = None
    for c in inputs:
        p = F.col(raw[c]) if raw and c in raw else None
        clipped = F.avg(((p <= CLIP) | (p >= 1 - CLIP)).cast("double")) if p is not None else F.lit(None).cast("double")
        row = rows.agg(F.lit(c).alias("input"), F.countDistinct(c).alias("n_distinct"), clipped.alias("clipped"))
        row = row.join(F.broadcast(auroc(rows, [], c))).join(F.broadcast(spearman(rows.select(c, length), c, length, "spearman_length")))
        out = row if out is None else out.unionByName(row)
    return out.select("input", "auroc", "n_distinct", "clipped", "spearman_length")


def input_correlations(rows: DataFrame, inputs: list[str]) -> DataFrame:
    """(a, b, pearson) of each two inputs, null where one doesn't vary."""
    from ..functions.stats import guarded_corr

    two = [(a, b) for i, a in enumerate(inputs) for b in inputs[i + 1 :]]
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}~{b}").alias("pearson")) for a, b in two])
    return rows.agg(*[guarded_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}~{b}") for a, b in two]).select(F.explode(each).alias("e")).select("e.*")


@dataclass(frozen=True)
class Analysis:
    """What :func:`analyze` found; frames have ``set`` (test, length_controlled) where they have both."""

    thresholds: DataFrame  # detector, threshold, source
    metrics: DataFrame  # set, detector, metric, estimate, low, high, n_reps
    differences: DataFrame  # set, detector, metric, ...: fusion less the detector
    verdict: str
    overlap: DataFrame
    diagnostics: DataFrame
    correlations: DataFrame
    notes: tuple[str, ...]


def analyze(run: FusionRun, controlled: DataFrame | None = None, replicates: int = 5000, seed: int = 0, draw: str = "tree", level: float = 0.95) -> Analysis:
    """Fusion against each input and against the unfitted average, on test and on its
    length-controlled part (sample_id, match_id), each at its own threshold from validation.

    The verdict is about AUROC on the controlled set: IMPROVES if fusion's interval lies above
    every input's, WORSE if it lies below any, else INCONCLUSIVE. A set is left out, with a note,
    if its pairs aren't whole or some of its samples weren't scored; without a controlled set the
    verdict is UNAVAILABLE."""
    from ..sources.shared import held
    from . import bootstrap, resampling
    from .metrics import predicted, score_groups, select_threshold, threshold_candidates

    names, spark = [i.name for i in run.inputs], run.test.sparkSession
    chosen = {r.detector: (r.threshold, "validation") for r in run.thresholds.collect()}  # a row for each of the two
    for i in run.inputs:
        # thresholds of inputs are on their own scores, before any transform
        own = run.design.select("label", F.col(f"raw_{i.name}").alias("score")) if i.threshold is None else None
        found = i.threshold if own is None else select_threshold(threshold_candidates(score_groups(own, [])), []).first().threshold
        chosen[i.name] = (found, "the run's own" if own is None else "youden on validation")
    at = {d: float(t) for d, (t, _) in chosen.items()}
    test = held(run.test.select("sample_id", "pair_id", "label", "fusion", "average", *[F.col(f"raw_{n}").alias(n) for n in names]))
    sets, notes = {}, []
    if test.groupBy("pair_id").count().filter("count <> 2").isEmpty():
        sets["test"] = (test, "pair_id")
    else:
        notes.append("test left out: the samples that were scored aren't whole pairs")
    if controlled is None:
        notes.append("no length-controlled set")
    else:
        part = controlled.select("sample_id", "match_id")
        missing = part.join(test, "sample_id", "left_anti").count()
        if missing:
            notes.append(f"length-controlled set left out: {missing} of its samples weren't scored by every input")
        else:
            sets["length_controlled"] = (part.join(test, "sample_id"), "match_id")
    measured, differences = [], []
    for name, (rows, cluster) in sets.items():
        wide = held(bootstrap.pair_table(rows, cluster, list(at)))
        reps = held(resampling.replicates(wide, at, resampling.Draw(wide.count(), replicates, seed, draw)))
        of = lambda d: reps.filter(F.col("detector") == d).drop("detector")  # noqa: B023, E731
        named = lambda df, d: df.select(F.lit(name).alias("set"), F.lit(d).alias("detector"), "*")  # noqa: B023, E731
        for d in at:
            measured.append(named(bootstrap.intervals(of(d), bootstrap.ALL_METRICS, level), d))
            if d != "fusion":
                differences.append(named(bootstrap.paired_difference(of("fusion"), of(d), bootstrap.ALL_METRICS, level), d))
    unite = lambda parts: reduce(DataFrame.unionByName, parts) if parts else None
    every = unite(differences)
    said = "UNAVAILABLE"
    if "length_controlled" in sets:
        against = every.filter((F.col("set") == "length_controlled") & (F.col("metric") == "auroc") & F.col("detector").isin(names))
        said = bootstrap.verdict(against, ["metric"]).first().verdict
    right = [F.struct(F.lit(d).alias("detector"), (predicted(F.col(d), F.lit(t)) == F.col("label")).cast("int").alias("correct")) for d, t in at.items()]
    overlap = error_overlap(test.select("sample_id", F.explode(F.array(*right)).alias("e")).select("sample_id", "e.*"))
    logits = {i.name: f"raw_{i.name}" for i in run.inputs if i.transform == "logit"}
    facts = diagnostics(run.design, list(run.features), logits)
    told = spark.createDataFrame([(d, at[d], source) for d, (_, source) in chosen.items()], "detector string, threshold double, source string")
    return Analysis(told, unite(measured), every, said, overlap, facts, input_correlations(run.design, list(run.features)), tuple(notes))


def error_overlap(correct: DataFrame) -> DataFrame:
    """For each two detectors of (sample_id, detector, correct): joint counts and McNemar p."""
    from ..functions.stats import mcnemar_exact

    a = correct.select("sample_id", F.col("detector").alias("a"), F.col("correct").alias("ca"))
    b = correct.select("sample_id", F.col("detector").alias("b"), F.col("correct").alias("cb"))
    n = lambda x, y: F.sum(((F.col("ca") == x) & (F.col("cb") == y)).cast("long"))
    counts = a.join(b, "sample_id").filter("a < b").groupBy("a", "b").agg(n(1, 1).alias("both_right"), n(1, 0).alias("only_a_right"), n(0, 1).alias("only_b_right"), n(0, 0).alias("both_wrong"))
    return mcnemar_exact(counts, "only_a_right", "only_b_right")


def oracle_accuracy(correct: DataFrame) -> DataFrame:
    """Share of samples that at least one detector gets right, and how many all get wrong."""
    best = correct.groupBy("sample_id").agg(F.max("correct").alias("any"))
    return best.agg(F.avg("any").alias("oracle_accuracy"), F.sum((F.col("any") == 0).cast("long")).alias("all_wrong"))


def wrong_samples(correct: DataFrame) -> DataFrame:
    """(sample_id, wrong_by, all_wrong): samples that some detector gets wrong, by which, and whether by all."""
    found = correct.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.when(F.col("correct") == 0, F.col("detector")))).alias("wrong_by"), F.max("correct").alias("_best"))
    return found.filter(F.size("wrong_by") > 0).select("sample_id", "wrong_by", (F.col("_best") == 0).alias("all_wrong"))
