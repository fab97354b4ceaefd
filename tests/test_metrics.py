import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.functions import stats
from sievelight.operators import bootstrap, fusion, metrics, resampling
from sievelight.sources.shared import held


def frame(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, [float(s) for s in scores])), "label int, score double")


@pytest.mark.parametrize(
    "labels, scores, expected",
    [([0, 0, 1, 1], [1, 1, 1, 1], 0.5), ([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9], 1.0), ([0, 0, 1, 1], [0.9, 0.8, 0.2, 0.1], 0.0), ([1, 1], [0.1, 0.2], None), ([0, 1, 0, 1], [1, 1, 2, 3], 0.625)],
)
def test_auroc(spark, labels, scores, expected):
    assert metrics.auroc(frame(spark, labels, scores), []).first()["auroc"] == expected


def test_null_metrics(spark):
    rows = frame(spark, [0, 1, 1], [0, 0, 0]).withColumn("pred", F.lit(0))
    row = metrics.metrics(rows, []).first()
    assert row.precision is None and row.f1 is None and row.recall == 0.0
    assert metrics.metrics(rows, [], undefined="zero").first().f1 == 0.0
    assert metrics.metrics(rows, [], undefined="tp").first().f1 == 0.0


@pytest.mark.parametrize("name", ["youden", "f1", "accuracy"])
def test_threshold_between_classes(spark, name):
    groups = metrics.score_groups(frame(spark, [0, 0, 0, 1, 1, 1], [1, 2, 3, 10, 11, 12]), [])
    assert 3 < metrics.select_threshold(metrics.threshold_candidates(groups), [], name).first().threshold <= 10


def test_score_at_threshold_is_positive(spark):
    rows = frame(spark, [0, 0, 1], [0.1, 0.5, 0.9]).withColumn("pred", metrics.predicted(F.col("score"), F.lit(0.5)))
    assert [r.pred for r in rows.orderBy("score").collect()] == [0, 1, 1]


def test_random_scores_match_brute_force(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 40, 300)
    wins = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert metrics.auroc(frame(spark, y.tolist(), s.tolist()), []).first().auroc == pytest.approx(np.mean(wins))


def test_tied_pairs(spark):
    rows = spark.createDataFrame([(p, y, 1.0) for p in range(50) for y in (0, 1)], "pair_id int, label int, score double")
    row = metrics.pair_accuracy(metrics.pairs(rows, "pair_id")).first()
    assert (row.pair_accuracy, row.n_ties) == (0.5, 50)


def test_edges_and_strata(spark):
    edges = spark.createDataFrame([([0.0, 10.0, 20.0, 30.0],)], "edges array<double>")
    rows = spark.createDataFrame([(-5,), (10,), (15,), (20,), (99,)], "length int").join(edges)
    assert [r.b for r in rows.select(metrics.stratum(F.col("length"), F.col("edges")).alias("b")).collect()] == [0, 1, 1, 2, 2]


@pytest.mark.parametrize("a, b, p", [(5, 5, 1.0), (20, 0, 2 * 0.5**20), (0, 0, 1.0), (10, 47, 7.51304e-07)])
def test_mcnemar(spark, a, b, p):
    row = stats.mcnemar_exact(spark.createDataFrame([(a, b)], "x long, y long"), "x", "y").first()
    assert row.p_value == pytest.approx(p, rel=1e-5)


def test_error_overlap(spark):
    wrong = {"a": {1, 2, 3}, "b": {2, 3, 4, 5, 6}, "c": {3, 9}}
    rows = spark.createDataFrame([(f"s{i:03d}", d, int(i not in w)) for i in range(40) for d, w in wrong.items()], "sample_id string, detector string, correct int")
    got = {(r.a, r.b): r for r in fusion.error_overlap(rows).collect()}
    for (x, y), r in got.items():
        a, b = wrong[x], wrong[y]
        assert (r.both_wrong, r.only_b_right, r.only_a_right) == (len(a & b), len(a - b), len(b - a)) and r.both_right == 40 - len(a | b)
    assert got["a", "b"].p_value == pytest.approx(2 * (1 + 4) / 16)
    assert fusion.oracle_accuracy(rows).first().oracle_accuracy == pytest.approx(39 / 40)
    told = {r.sample_id: (r.wrong_by, r.all_wrong) for r in fusion.wrong_samples(rows).collect()}
    assert told["s003"] == (["a", "b", "c"], True) and told["s009"] == (["c"], False) and len(told) == 7


def test_bootstrap_equals_expanded_resample(spark):
    rng = np.random.default_rng(1)
    rows = [(f"p{i:02d}", y, float(rng.integers(0, 9))) for i in range(20) for y in (0, 1)]
    wide = bootstrap.pair_table(spark.createDataFrame(rows, "pair_id string, label int, s double"), "pair_id", ["s"])
    weights = bootstrap.draws(spark, 20, 5)
    got = {r.rep: r for r in bootstrap.replicate_metrics(wide, weights, "s", 4.0).collect()}
    scores = {p: {} for p, _, _ in rows}
    for p, y, s in rows:
        scores[p][y] = s
    for rep in range(5):
        drawn = [f"p{r.cluster_no:02d}" for r in weights.filter(F.col("rep") == rep).collect() for _ in range(r.mult)]
        pos, neg = [scores[p][1] for p in drawn], [scores[p][0] for p in drawn]
        assert len(drawn) == 20
        assert got[rep].auroc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))
        assert got[rep].accuracy == pytest.approx(np.mean([s >= 4 for s in pos] + [s < 4 for s in neg]))


def test_difference_with_itself_is_zero(spark):
    rows = [(f"p{i:02d}", y, float(i * y)) for i in range(12) for y in (0, 1)]
    wide = bootstrap.pair_table(spark.createDataFrame(rows, "pair_id string, label int, s double"), "pair_id", ["s"])
    reps = bootstrap.replicate_metrics(wide, bootstrap.draws(spark, 12, 10), "s", 4.0)
    reps = reps.filter("rep >= 0")
    for r in bootstrap.paired_difference(reps, reps).collect():
        assert (r.low, r.high, r.frac_a_better, r.ci_excludes_zero) == (0.0, 0.0, 0.0, False)


def test_logit_and_constant(spark):
    rows = spark.createDataFrame([(p,) for p in (0.0, 1e-12, 0.5, 1 - 1e-12, 1.0)], "p double")
    z = [r.z for r in rows.select(fusion.logit(F.col("p")).alias("z")).collect()]
    assert z[0] == z[1] and z[3] == z[4] and z[2] == 0 and all(map(math.isfinite, z))
    with pytest.raises(Exception, match="logit"):
        spark.createDataFrame([(1.3,)], "p double").select(fusion.logit(F.col("p"))).collect()
    with pytest.raises(ValueError, match="constant"):
        fusion.standardisation(rows.withColumn("c", F.lit(1.0)), ["c"])


def test_newton_logistic_has_zero_gradient(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(int)
    rows = spark.createDataFrame([(int(b), float(u), float(v)) for b, (u, v) in zip(y, x)], "label int, u double, v double")
    m = fusion.fit_logistic(rows, ["u", "v"], c=2.0)
    p = 1 / (1 + np.exp(-(x @ np.array(m.coef) + m.intercept)))
    assert np.allclose(x.T @ (p - y) + np.array(m.coef) / 2.0, 0, atol=1e-6) and abs((p - y).sum()) < 1e-6


def test_cost_counts_once_per_pair(spark):
    rows = spark.createDataFrame([(p, 10.0, 10, 100, 2200.0) for p in range(7) for _ in (0, 1)], "pair_id int, latency_s double, n_generations long, n_generated_tokens long, peak_gpu_mem_mb double")
    assert fusion.cost_totals(rows, "pair_id").first().latency_s == 70.0
    assert {r.latency_s for r in fusion.amortised(rows, "latency_s").collect()} == {5.0}


def test_ks(spark):
    rows = spark.createDataFrame([(float(v), y) for y, vs in ((0, [1, 2, 3, 4]), (1, [3, 4, 5, 6])) for v in vs], "v double, y int")
    assert stats.ks_statistic(rows, "v", "y").first().ks == pytest.approx(0.5)
    assert stats.ks_p_value(4, 4, 0.5) == pytest.approx(0.7714285714, rel=1e-6)


def test_average_rank(spark):
    rows = spark.createDataFrame([(v,) for v in (5.0, 1.0, 5.0, 9.0)], "v double")
    assert sorted((r.v, r["rank"]) for r in stats.average_rank(rows, "v").collect()) == [(1.0, 1.0), (5.0, 2.5), (5.0, 2.5), (9.0, 4.0)]


def test_bootstrap_queries_draw_a_thousand_replicates(spark):
    import hashlib

    from sievelight.plans import catalog, detection, views

    d = "/root/testdata/sf0.001"
    test = views.samples(spark, d).filter("split = 'test'").select("pair_id", "label", "score_a", "score_b").collect()
    no = {p: i for i, p in enumerate(sorted({r.pair_id for r in test}))}
    cell = np.zeros((2, len(no), 4))  # detector, pair: tp, fp, fn, tn
    for r in test:
        for k, up in enumerate((r.score_a >= detection.AT_A, r.score_b >= detection.AT_B)):
            cell[k, no[r.pair_id], (0 if up else 2) if r.label else (1 if up else 3)] += 1
    draw = lambda rep, i: int(hashlib.sha256(f"42:{rep}:{i}".encode()).hexdigest()[:8], 16) % len(no)
    sums = np.array([cell[:, [draw(rep, i) for i in range(len(no))]].sum(1) for rep in range(1000)])
    with np.errstate(all="ignore"):
        value = {"precision": sums[..., 0] / (sums[..., 0] + sums[..., 1]), "recall": sums[..., 0] / (sums[..., 0] + sums[..., 2]), "accuracy": (sums[..., 0] + sums[..., 3]) / sums.sum(-1)}
    one = {r.metric: r for r in catalog.QUERIES["k1_k2_k4_bootstrap_ci_1000"](spark, d).collect()}
    two = {r.metric: r for r in catalog.QUERIES["k3_k7_k8_paired_difference_1000"](spark, d).collect()}
    assert set(one) == set(two) == {"auroc", "accuracy", "precision", "recall", "f1", "pair_accuracy"}
    for name, v in value.items():
        assert one[name].n_reps == np.isfinite(v[:, 1]).sum() > 900
        assert [one[name].low, one[name].high] == pytest.approx(np.nanpercentile(v[:, 1], [2.5, 97.5]).tolist(), abs=1e-8)
        assert [two[name].low, two[name].high] == pytest.approx(np.nanpercentile(v[:, 0] - v[:, 1], [2.5, 97.5]).tolist(), abs=1e-8)


def test_hashed_draws_are_made_by_chunks_of_numbers(spark, monkeypatch):
    monkeypatch.setattr(resampling, "HASH_CHUNK", 7)
    monkeypatch.setattr(resampling, "PACKED", 20)
    got, n = {}, 45
    draws = resampling._hashed(spark, resampling.Draw(n, 9, 42, "hash", 16))
    for r in draws.collect():
        for i in np.frombuffer(r["at"], np.uint16):
            got[r.rep, r.block * 16 + int(i)] = got.get((r.rep, r.block * 16 + int(i)), 0) + 1
    assert got == {(r.rep, r.cluster_no): r.mult for r in bootstrap.draws(spark, n, 9, 42).collect()}


@pytest.mark.parametrize("free", [False, True])
def test_feature_models_learn_on_train_only(spark, free):
    from sievelight.operators import probe

    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 160)
    train = np.arange(160) < 100
    u, v = y * 2.0 + rng.normal(size=160), np.where(train, y, 1 - y) * 3.0 + rng.normal(size=160)
    rows = spark.createDataFrame([(int(a), float(b), float(c), 1.0, bool(t)) for a, b, c, t in zip(y, u, v, train)], "label int, u double, v double, k double, train boolean")
    sets = {"u": ["u"], "v": ["v"], "k": ["k"], "all": ["u", "v", "k"]}
    scored = probe.feature_models(rows, F.col("train"), ~F.col("train"), sets, free_intercept=free)
    area = {r.feature: r.auroc for r in metrics.auroc(scored, ["feature"]).collect()}
    assert area["u"] > 0.8 and area["v"] < 0.2 and area["k"] == 0.5
    x = (np.column_stack([u, v]) - np.column_stack([u, v])[train].mean(0)) / np.column_stack([u, v])[train].std(0)
    w = np.zeros(3)
    z = np.column_stack([np.ones(160), x])
    for _ in range(50):  # plain Newton, the intercept free or penalised like a weight
        p = 1 / (1 + np.exp(-z[train] @ w))
        ridge = np.diag([0.0 if free else 1.0, 1, 1])
        w -= np.linalg.solve((z[train].T * (p * (1 - p))) @ z[train] + ridge, z[train].T @ (p - y[train]) + ridge @ w)
    assert np.allclose(sorted(r.score for r in scored.filter("feature = 'all'").collect()), sorted(z[~train] @ w), atol=1e-5)
    slope = z[train].T @ (1 / (1 + np.exp(-z[train] @ w)) - y[train]) + ridge @ w
    assert np.abs(slope).max() < 1e-8 and (free or abs(w[0]) > 0)


@pytest.mark.parametrize("free", [False, True])
def test_layer_probes_rest_where_plain_newton_does(spark, free):
    from sievelight.operators import probe

    rng = np.random.default_rng(11)
    n, width = 120, 12
    y = rng.integers(0, 2, n)
    x = {k: rng.normal(size=(n, width)) * 3 + y[:, None] * (k + 1) / 4 + 5 for k in (0, 1)}
    x[0][:, 3] = 7.0  # constant
    train = np.arange(n) < 90
    rows = [(i, int(y[i]), k, [float(v) for v in x[k][i]], bool(train[i])) for k in x for i in range(n)]
    rows += [(900, None, 0, [1.0] * width, True), (901, 1, 0, None, True), (902, 1, 0, [None] * width, False), (903, 1, 5, [1.0] * width, False), (904, 0, None, [1.0] * width, True)]
    df = spark.createDataFrame(rows, "sample_id int, label int, layer int, features array<double>, train boolean").repartition(5)
    found = {}
    for limit in (256, 0):  # by Newton steps, by limited-memory BFGS
        _, scored = probe.layer_probes(df, F.col("train"), newton_width=limit, free_intercept=free)
        found[limit] = {(r.layer, r.sample_id): r.score for r in scored.collect()}
        assert found[limit][0, 902] is None and found[limit][5, 903] is None
    for k in x:
        sd = x[k][train].std(0)
        z = np.column_stack([np.ones(n), (x[k] - x[k][train].mean(0)) / np.where(sd > 0, sd, 1)])
        w, ridge = np.zeros(width + 1), np.diag([0.0 if free else 1.0] + [1.0] * width)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z[train] @ w))
            w -= np.linalg.solve((z[train].T * (p * (1 - p))) @ z[train] + ridge, z[train].T @ (p - y[train]) + ridge @ w)
        for limit in found:
            assert np.allclose([found[limit][k, i] for i in range(90, n)], (z @ w)[90:], atol=1e-4)
    assert probe.layer_probes(df.filter("layer = 9"), F.col("train"))[1].count() == 0
    with pytest.raises(RuntimeError, match="not at rest"):
        probe.layer_probes(df, F.col("train"), steps=1)
    with pytest.raises(Exception, match="different widths"):
        probe.layer_probes(spark.createDataFrame([(1, 0, 0, [1.0]), (2, 1, 0, [1.0, 2.0])], "sample_id int, label int, layer int, features array<double>").coalesce(1), F.lit(True))


def test_formatting_query_has_fitted_models_and_rates(spark):
    from sievelight.functions import text
    from sievelight.plans import catalog, views

    d = "/root/testdata/sf0.001"
    got = catalog.QUERIES["l13_g3_formatting_features_auroc"](spark, d).collect()
    assert {r.feature for r in got} == {*text.FEATURES, "formatting_plus_length", "surface_features_without_explicit_length"}
    assert all(0 <= r[m] <= 1 for r in got for m in ("auroc", "accuracy", "precision", "recall", "f1"))
    assert views.formatting(spark, d).filter("split = 'test'").count() > 0


@pytest.mark.parametrize("query", ["l13_g3_formatting_features_auroc", "l13_single_features", "r30_matched_formatting"])
def test_features_of_a_text_are_worked_out_once(spark, monkeypatch, query):
    from sievelight.plans import catalog, views

    d, seen, made = "/root/testdata/sf0.001", spark.sparkContext.accumulator(0), views.formatting

    @F.udf("double")
    def told(n):
        seen.add(1)
        return n

    monkeypatch.setattr(views, "formatting", lambda spark, d: made(spark, d).withColumn("char_count", told("char_count")))
    catalog.QUERIES[query](spark, d).collect()
    assert 0 < seen.value <= made(spark, d).count()


def test_single_class_has_no_threshold(spark):
    cand = metrics.threshold_candidates(metrics.score_groups(frame(spark, [1, 1], [1, 2]), []))
    with pytest.raises(Exception, match="single class"):
        metrics.select_threshold(cand, []).collect()
    assert metrics.select_threshold(cand, [], single="null").first().threshold is None


def test_strata_have_their_own_auroc(spark):
    rows = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.9), (1, 1, 0.5), (1, 50, 0.7), (1, 50, 0.2)], "label int, length int, score double").withColumn("pred", metrics.predicted(F.col("score"), F.lit(0.5)))
    edges = spark.createDataFrame([([0.0, 10.0, 20.0, 60.5],)], "edges array<double>")
    got = {r.bin: r for r in metrics.stratified(rows, edges).collect()}
    assert [got[b].bin_range for b in range(3)] == ["[0, 10)", "[10, 20)", "[20, 60.5]"]
    assert (got[0].auroc, got[0].n_min, got[0].frac_hallucinated, got[0].reliable) == (0.5, 1, pytest.approx(1 / 3), False)
    assert (got[1].n, got[1].auroc, got[1].frac_hallucinated) == (0, None, None) and (got[2].auroc, got[2].frac_hallucinated, got[2].recall) == (None, 1.0, 0.5)


@pytest.mark.parametrize("rows, said", [([(0.1, 0.2), (0.01, 0.3)], "IMPROVES"), ([(0.1, 0.2), (-0.1, 0.3)], "INCONCLUSIVE"), ([(0.1, 0.2), (-0.3, -0.1)], "WORSE"), ([(None, None)], "UNAVAILABLE"), ([(0.1, 0.2), (None, None)], "INCONCLUSIVE")])
def test_verdict_looks_at_all_inputs(spark, rows, said):
    df = spark.createDataFrame([("auroc", *r) for r in rows], "metric string, low double, high double")
    assert bootstrap.verdict(df, ["metric"]).first().verdict == said


def test_estimates_and_broken_clusters(spark):
    rows = [(f"p{i:02d}", y, float(i % 5 + 2 * y)) for i in range(15) for y in (0, 1)]
    df = spark.createDataFrame(rows, "pair_id string, label int, s double")
    parts = bootstrap.compared(df.withColumn("t", -F.col("s")), {"s": 4.0, "t": -4.0}, "s", "pair_id", 20)
    est = {(r.detector, r.metric): r for r in parts["intervals"].collect()}
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert est["s", "auroc"].estimate == pytest.approx(area) and est["t", "auroc"].estimate == pytest.approx(1 - area) and est["s", "auroc"].n_reps == 20
    assert {r.metric: r.verdict for r in parts["verdict"].collect()}["auroc"] == "IMPROVES"
    assert [r.estimate for r in parts["differences"].collect() if r.metric == "auroc"] == [pytest.approx(1 - 2 * area)]
    with pytest.raises(Exception, match="exactly one"):
        bootstrap.pair_table(df.filter("not (pair_id = 'p03' and label = 1)"), "pair_id", ["s"]).collect()
    with pytest.raises(Exception, match="exactly one"):
        bootstrap.pair_table(df.withColumn("s", F.when(F.col("pair_id") != "p03", F.col("s"))), "pair_id", ["s"]).collect()


def test_models_on_several_sets_are_fitted_together(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3))
    rows = [(int(a + rng.normal() > 0), int(i % 3), float(a), float(b), float(c)) for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "label int, fold int, a double, b double, c double")
    sets = {"one": ["b"], "turned": ["c", "a"], "all": ["a", "b", "c"]}
    both = fusion.fit_many(df, ["a", "b", "c"], {n: (1.0, 1, None) for n in sets}, fold="fold", sets=sets)
    for n, s in sets.items():
        alone = fusion.fit_many(df.filter("fold <> 1"), s, {"m": (1.0, None, None)})["m"]
        assert both[n].features == tuple(s) and [*both[n].coef, both[n].intercept] == pytest.approx([*alone.coef, alone.intercept], abs=1e-9)
    uneven = spark.createDataFrame([(1, [1.0]), (0, [1.0, 2.0, 3.0])], "label int, v array<double>").coalesce(1)
    with pytest.raises(Exception, match="needs 2 features"):
        fusion.fit_many(uneven, ["a", "b"], {"m": (1.0, None, None)}, vector="v")


def test_fusion_makes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(x):
        seen.add(1)
        return x

    rng = np.random.default_rng(3)
    rows = [(f"p{i}", y, float(rng.normal() + y), float(rng.normal())) for i in range(40) for y in (0, 1)]
    df = spark.createDataFrame(rows, "pair_id string, label int, a double, b double").withColumn("a", told("a"))
    _, oof = fusion.fit_fusion(df, ["a", "b"])
    assert oof.count() == 80 and seen.value == 80


def test_newton_says_when_it_is_not_at_rest(spark):
    rows = spark.createDataFrame([(int(i > 20), float(i)) for i in range(40)], "label int, u double")
    with pytest.raises(RuntimeError, match="not at rest"):
        fusion.fit_many(rows, ["u"], {"m": (100.0, None, None)}, steps=2)


def fusion_world(spark, pairs=60):
    rng = np.random.default_rng(8)
    samples, scores = {}, {}
    for split in ("validation", "test"):
        rows = [(f"{split}{i}_{y}", f"{split}{i}", y, int(rng.integers(3, 60))) for i in range(pairs) for y in (0, 1)]
        samples[split] = spark.createDataFrame(rows, "sample_id string, pair_id string, label int, length int")
        for k, d in (("a", 1.5), ("b", 0.8)):
            scores[k, split] = spark.createDataFrame([(r[0], float(r[2] * d + rng.normal())) for r in rows], "sample_id string, score double")
    inputs = [fusion.Input(k, scores[k, "validation"], scores[k, "test"], ("c", "v1")) for k in "ab"]
    return inputs, samples["validation"], samples["test"]


def test_fusion_run_and_its_rules(spark):
    inputs, validation, test = fusion_world(spark)
    run = fusion.run_fusion(inputs, validation, test, include_length=True)
    area = {d: metrics.auroc(run.test.withColumn("score", F.col(d)), []).first().auroc for d in ("a", "b", "fusion", "average")}
    assert area["fusion"] > area["b"] and run.features == ("a", "b", "log_length") and run.test.count() == 120
    assert {r.detector for r in run.thresholds.collect()} == {"fusion", "average"} and run.coverage == {"validation_used": 120, "validation_total": 120, "test_used": 120, "test_total": 120}
    flipped = fusion.run_fusion(inputs, validation, test.withColumn("label", 1 - F.col("label")), include_length=True)
    assert flipped.fit.model == run.fit.model  # test labels never reach the fit
    one, two = inputs
    for broken in ([one], [one, one]):
        with pytest.raises(ValueError):
            fusion.run_fusion(broken, validation, test)
    other = fusion.Input("b", two.validation, two.test, ("c2", "v1"))
    with pytest.raises(ValueError, match="configurations"):
        fusion.run_fusion([one, other], validation, test)
    part = fusion.Input("b", two.validation.filter("sample_id < 'validation3'"), two.test.filter("sample_id < 'test2'"), ("c", "v1"))
    with pytest.raises(ValueError):
        fusion.run_fusion([one, part], validation, test)
    with pytest.raises(ValueError, match="pairs"):
        fusion.run_fusion([one, part], validation, test, partial=True)
    some = fusion.run_fusion([one, part], validation, test, partial=True, min_pairs=10)
    assert some.coverage["test_used"] == test.filter("sample_id < 'test2'").count() < some.coverage["test_total"]


def test_analysis_compares_fusion_with_every_input(spark):
    inputs, validation, test = fusion_world(spark, 80)
    run = fusion.run_fusion([inputs[0], replace(inputs[1], threshold=0.5)], validation, test)
    control = test.filter("sample_id < 'test5'").select("sample_id", F.concat(F.lit("m"), "pair_id").alias("match_id"))
    found = fusion.analyze(run, control, replicates=100, draw="sequence")
    at = {r.detector: (r.threshold, r.source) for r in found.thresholds.collect()}
    own = metrics.select_threshold(metrics.threshold_candidates(metrics.score_groups(inputs[0].validation.join(validation, "sample_id"), [])), []).first().threshold
    assert at["b"] == (0.5, "the run's own") and at["a"] == (own, "youden on validation") and at["fusion"][1] == "validation" and set(at) == {"a", "b", "fusion", "average"}
    rows = {r.sample_id: r for r in run.test.collect()}
    wide = {}
    for part, ids in (("test", list(rows)), ("length_controlled", [r.sample_id for r in control.collect()])):
        keys = sorted({i.rsplit("_", 1)[0] for i in ids})
        wide[part] = {d: np.array([[rows[f"{k}_{y}"][d] for y in (0, 1)] for k in keys]) for d in at}
        rng = np.random.default_rng(0)
        index = [rng.integers(0, len(keys), len(keys)) for _ in range(100)]
        got = {(r.detector, r.metric): (r.low, r.high) for r in found.metrics.filter(F.col("set") == part).collect()}
        for d, (t, _) in at.items():
            wanted = plain_intervals(wide[part][d], t, index)
            assert all(got[d, m] == pytest.approx(wanted[m], abs=1e-12) for m in wanted)
    area = lambda w: np.mean((w[:, 1][:, None] > w[:, 0][None]) + 0.5 * (w[:, 1][:, None] == w[:, 0][None]))
    gaps = {r.detector: r for r in found.differences.filter("set = 'length_controlled' and metric = 'auroc'").collect()}
    for d in ("a", "b", "average"):
        assert gaps[d].estimate == pytest.approx(area(wide["length_controlled"]["fusion"]) - area(wide["length_controlled"][d]), abs=1e-12)
    lows, highs = [gaps[d].low for d in "ab"], [gaps[d].high for d in "ab"]
    assert found.verdict == ("IMPROVES" if min(lows) > 0 else "WORSE" if min(highs) < 0 else "INCONCLUSIVE") and found.notes == ()
    right = {d: {i: int(r[d] >= t) == r.label for i, r in rows.items()} for d, (t, _) in at.items()}
    for r in found.overlap.collect():
        assert r.both_wrong == sum(not right[r.a][i] and not right[r.b][i] for i in rows) and r.only_a_right == sum(right[r.a][i] and not right[r.b][i] for i in rows)
    assert found.diagnostics.count() == 2 and found.correlations.count() == 1


def test_analysis_says_what_it_leaves_out(spark):
    (one, two), validation, test = fusion_world(spark)
    part = replace(two, test=two.test.filter("sample_id <> 'test3_0'"))
    run = fusion.run_fusion([one, part], validation, test, partial=True, min_pairs=10)
    control = test.filter("sample_id < 'test5'").select("sample_id", F.col("pair_id").alias("match_id"))
    found = fusion.analyze(run, control, replicates=10)
    assert found.verdict == "UNAVAILABLE" and len(found.notes) == 2 and "1 of its samples" in found.notes[1] and found.metrics is None
    half = fusion.analyze(run, control.filter("sample_id like 'test1%'"), replicates=10)
    assert half.verdict in ("IMPROVES", "WORSE", "INCONCLUSIVE") and {r.set for r in half.metrics.select("set").distinct().collect()} == {"length_controlled"}


def plain_intervals(wide, threshold, index):
    """Metrics of resampled pairs, one replicate after the other, and their percentiles."""
    values = {m: [] for m in bootstrap.ALL_METRICS}
    for drawn in index:
        s0, s1 = wide[drawn, 0], wide[drawn, 1]
        y, s = np.repeat([0, 1], len(drawn)), np.concatenate([s0, s1])
        p = s >= threshold
        tp, fp, fn = (p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 1)).sum()
        values["accuracy"].append((p == y).mean())
        values["precision"].append(tp / (tp + fp) if tp + fp else None)
        values["recall"].append(tp / (tp + fn))
        values["f1"].append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else None)
        values["pair_accuracy"].append(((s1 > s0) + 0.5 * (s1 == s0)).mean())
        values["auroc"].append(np.mean((s1[:, None] > s0[None]) + 0.5 * (s1[:, None] == s0[None])))
    return {m: tuple(np.percentile([x for x in v if x is not None], [2.5, 97.5])) for m, v in values.items()}


def pairs_of(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    scores = np.round(rng.normal(size=(n, 2)) + [0, 0.7], 1)
    rows = [(f"p{i:05d}", y, float(scores[i, y])) for i in range(n) for y in (0, 1)]
    return scores, spark.createDataFrame(rows, "pair_id string, label int, s double").withColumn("t", -F.col("s"))


def test_sequence_draws_give_numpys_intervals(spark):
    scores, df = pairs_of(spark, 75)
    rng = np.random.default_rng(3)
    wanted = plain_intervals(scores, 0.4, [rng.integers(0, 75, 75) for _ in range(200)])
    out = bootstrap.compared(df, {"s": 0.4, "t": 0.0}, "s", "pair_id", 200, 3, bootstrap.ALL_METRICS, draw="sequence")
    got = {r.metric: (r.low, r.high) for r in out["intervals"].filter("detector = 's'").collect()}
    assert got.keys() == wanted.keys() and all(got[m] == pytest.approx(wanted[m], abs=1e-12) for m in got)
    once = {r.metric: r.estimate for r in out["intervals"].filter("detector = 's'").collect()}
    assert once["auroc"] == pytest.approx(plain_intervals(scores, 0.4, [np.arange(75)])["auroc"][0])
    assert {r.verdict for r in out["verdict"].filter("metric = 'auroc'").collect()} == {"IMPROVES"}


def test_tree_weights_are_multinomial_and_alike_in_every_task():
    draw = resampling.Draw(45, 4000, 7, block=8)
    whole = np.hstack([w for _, w in draw.weights(list(range(6)))])
    assert whole.shape == (4001, 45) and (whole[0] == 1).all() and (whole.sum(axis=1) == 45).all()
    assert (dict(draw.weights([4]))[4] == whole[:, 32:40]).all() and not (whole == np.hstack([w for _, w in resampling.Draw(45, 4000, 8, block=8).weights(list(range(6)))])).all()
    drawn = whole[1:]
    # drawing with replacement: mean 1, variance 1 - 1/n, covariance -1/n, within a block and over blocks
    assert abs(drawn.mean(axis=0) - 1).max() < 0.08 and abs(drawn.var(axis=0) - (1 - 1 / 45)).max() < 0.12
    cov = np.cov(drawn.T)
    assert abs(cov[np.triu_indices(45, 1)].mean() + 1 / 45) < 0.002 and abs(cov[0, 1:8].mean() - cov[0, 8:].mean()) < 0.03


@pytest.mark.parametrize("block", [8, 512])
def test_tree_replicates_are_resamples(spark, block):
    scores, df = pairs_of(spark, 60, 1)
    wide = held(bootstrap.pair_table(df, "pair_id", ["s", "t"]).repartition(5))
    draw = resampling.Draw(60, 30, 11, block=block)
    got = {(r.detector, r.rep): r for r in resampling.replicates(wide, {"s": 0.4, "t": -0.2}, draw).collect()}
    assert set(got) == {(d, r) for d in "st" for r in range(-1, 30)}
    weights = np.hstack([w for _, w in draw.weights(list(range(-(-60 // block))))])
    for rep in (-1, 0, 17):
        index = np.repeat(np.arange(60), weights[rep + 1])
        for d, values, at in (("s", scores, 0.4), ("t", -scores, -0.2)):
            wanted = plain_intervals(values, at, [index])
            assert {m: got[d, rep][m] for m in wanted} == pytest.approx({m: v[0] for m, v in wanted.items()}, abs=1e-12)


def test_tree_intervals_agree_with_numpys_up_to_sampling(spark):
    scores, df = pairs_of(spark, 300, 2)
    rng = np.random.default_rng(0)
    wanted = plain_intervals(scores, 0.4, [rng.integers(0, 300, 300) for _ in range(1000)])
    out = bootstrap.compared(df, {"s": 0.4}, "s", metrics=bootstrap.ALL_METRICS)
    for r in out["intervals"].collect():
        low, high = wanted[r.metric]
        assert abs(r.low - low) < 0.15 * (high - low) and abs(r.high - high) < 0.15 * (high - low)


def test_hashed_draws_by_blocks_equal_the_join_with_multiplicities(spark, monkeypatch):
    monkeypatch.setattr(resampling, "HASH_BLOCK", 7)
    rows = [(f"p{i:02d}", y, float((i * 7 + 5 * y) % 11), float((i * i + y) % 3)) for i in range(40) for y in (0, 1)]
    wide = bootstrap.pair_table(spark.createDataFrame(rows, "pair_id string, label int, s double, t double"), "pair_id", ["s", "t"]).cache()
    weights = bootstrap.with_itself(bootstrap.draws(spark, 40, 6), 40)
    found = resampling.replicates(wide, {"s": 5.0, "t": 1.0}, resampling.Draw(40, 6, 42, "hash")).collect()
    for name, at in (("s", 5.0), ("t", 1.0)):
        want = {r.rep: r for r in bootstrap.replicate_metrics(wide, weights, name, at).collect()}
        got = {r.rep: r for r in found if r.detector == name}
        assert set(got) == set(want) == set(range(-1, 6))
        for rep, r in want.items():
            assert [got[rep][m] for m in bootstrap.ALL_METRICS] == pytest.approx([r[m] for m in bootstrap.ALL_METRICS])
