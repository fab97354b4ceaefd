import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight import models
from sievelight.functions import tokens
from sievelight.operators import equivalence, protocol, records, report
from sievelight.operators.validate import DataIntegrityError
from sievelight.sources import io

META = {"detector": "probe", "variant": "v", "config_hash": "c", "prompt_version": "v1"}


def samples(spark, split, n=40, seed=0, longer=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        for y in (0, 1):
            size = int(rng.integers(5, 30) + (40 if y == longer else 0))
            rows.append((f"{split}{i:03d}_{y}", f"{split}{i:03d}", y, "q", "x" * size, size, size, size // 4))
    return spark.createDataFrame(rows, "sample_id string, pair_id string, label int, question string, answer string, length int, answer_length_chars int, answer_length_tokens int")


def scored(spark, split, seed=0, d=1.0):
    rng = np.random.default_rng(seed)
    s = samples(spark, split, seed=seed)
    noise = spark.createDataFrame([(r.sample_id, float(d * r.label + rng.normal())) for r in s.orderBy("sample_id").collect()], "sample_id string, score double")
    return s.join(noise, "sample_id")


def test_report_of_a_detector(spark):
    validation, test = scored(spark, "v", 1), scored(spark, "t", 2).withColumns({"latency_s": F.lit(0.5), "n_generations": F.lit(10), "n_generated_tokens": F.lit(100), "peak_gpu_mem_mb": F.lit(2200.0)})
    out = report.evaluate_detector(test, validation, replicates=20)
    at = out["threshold"].first()
    assert (at.criterion, at.selected_on) == ("youden", "validation")
    rows = test.collect()
    pred = [int(r.score >= at.threshold) for r in rows]
    m = {r.split: r for r in out["metrics"].collect()}
    assert m["test"].accuracy == pytest.approx(np.mean([p == r.label for p, r in zip(pred, rows)])) and set(m) == {"validation", "test"}
    pos, neg = [r.score for r in rows if r.label], [r.score for r in rows if not r.label]
    assert m["test"].auroc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))
    assert sum(r.n for r in out["strata"].filter("split = 'test'").collect()) == 80 and out["outcomes"].filter("split = 'test'").agg(F.sum("n")).first()[0] == 80
    i = {(r.split, r.metric): r for r in out["intervals"].collect()}
    assert i["test", "accuracy"].estimate == pytest.approx(m["test"].accuracy) and i["test", "auroc"].low <= i["test", "auroc"].high
    e = out["efficiency"].first()
    assert (e.total_runtime_s, e.mean_runtime_s, e.n_generations, e.n_generated_tokens, e.peak_gpu_mem_mb) == (40.0, 0.5, 800, 8000, 2200.0)
    pair = report.efficiency(test, "pair").first()
    assert (pair.total_runtime_s, pair.mean_runtime_s) == (20.0, 0.25)
    assert out["warnings"].count() == 0 and out["curve"].filter("split = 'test'").count() <= 21 and out["worst"].filter("kind = 'FP'").count() <= 20
    assert out["pair_level"].filter("split = 'test'").first().n_pairs == 40
    # test data can't change the threshold; scores turned round are warned of; missing runtimes too
    turned = report.evaluate_detector(test.withColumn("score", -F.col("score")).drop("latency_s"), validation, replicates=0)
    assert turned["threshold"].first().threshold == at.threshold and turned["warnings"].count() == 2 and "intervals" not in turned
    ctrl = test.select("sample_id", F.concat(F.lit("m"), "pair_id").alias("match_id")).filter("match_id < 'mt020'")
    own = report.evaluate_detector(test, validation, controlled=ctrl, replicates=5)
    assert own["match_level"].first().n_matches == 20 and own["metrics"].filter("split = 'length_controlled'").first().n == 40 and own["intervals"].filter("split = 'length_controlled'").count() == 6
    with pytest.raises(ValueError):
        report.evaluate_detector(test)
    with pytest.raises(Exception, match="incomplete"):
        report.evaluate_detector(test.filter("sample_id <> 't003_1'"), validation, replicates=0)["pair_level"].collect()


def test_length_detector_writes_runs_that_evaluate(spark, tmp_path):
    for longer in (1, 0):
        validation, test = samples(spark, "v", seed=3, longer=longer), samples(spark, "t", seed=4, longer=longer)
        folder = f"{tmp_path}/{longer}"
        model = protocol.run_length_detector(validation, test, folder, "c", "v1")
        assert model.direction == (1 if longer else -1) and model.n_validation == 80
        runs = [io.read_run(spark, io.run_path(folder, "length_only", "chars", s)) for s in ("test", "validation")]
        out = report.evaluate_run(runs[0], test, runs[1], validation, replicates=0)
        assert out["threshold"].first().criterion == "stored_in_run_meta" and out["metrics"].filter("split = 'test'").first().auroc > 0.98
        native = out["native_metrics"].filter("split = 'test'").first()
        assert native.accuracy == out["metrics"].filter("split = 'test'").first().accuracy
    with pytest.raises(DataIntegrityError):
        report.evaluate_run(runs[1], test)
    with pytest.raises(DataIntegrityError):
        report.evaluate_run(runs[0], test.filter("sample_id <> 't000_0'"))
    other = (runs[1][0].withColumn("config_hash", F.lit("other")), runs[1][1].withColumn("config_hash", F.lit("other")))
    with pytest.raises(DataIntegrityError, match="config_hash"):
        report.evaluate_run(runs[0], test, other, validation)
    with pytest.raises(ValueError):
        protocol.fit_length(validation.filter("label = 1"))
    with pytest.raises(Exception, match="missing"):
        protocol.fit_length(validation.withColumn("answer_length_tokens", F.lit(None).cast("int")), "tokens")


def test_costs_of_a_pair_count_once_as_the_run_says(spark, tmp_path):
    test = samples(spark, "t", n=6, seed=4)
    costs = {"latency_s": F.lit(10.0), "n_generations": F.lit(10), "n_generated_tokens": F.lit(100), "peak_gpu_mem_mb": F.lit(2200.0)}
    rows = test.withColumns({"score": F.col("label").cast("double"), "extra": F.to_json(F.struct("pair_id"))} | costs)
    for name, extra, change, unit, total in (
        ("pairs", {"generation_statistics_unit": "pair"}, {}, "pair", 60.0), ("plain", {"generation_statistics_unit": "sample"}, {}, "sample", 120.0), ("none", None, {}, "sample", 120.0),
        ("unnamed", {"generation_statistics_unit": "pair"}, {"extra": F.lit("{}")}, "sample", 120.0),
    ):
        meta = META | {"split": "test", "extra": extra and json.dumps(extra)}
        io.write_run(protocol.records_of(rows.withColumns(change), "test", "probe", "v", "c", "v1"), meta, f"{tmp_path}/{name}", 0.5, "validation")
        out = report.evaluate_run(io.read_run(spark, f"{tmp_path}/{name}"), test, replicates=0)
        cost = out["efficiency"].first()
        assert (cost.unit, cost.total_runtime_s, cost.mean_runtime_s, cost.n_generations) == (unit, total, total / 12, total)
        assert [r.warning for r in out["warnings"].collect() if "overstates" in r.warning] == (["costs of pairs, but records name no pair_id: each record's costs are counted, which overstates them"] if name == "unnamed" else [])


def test_the_controlled_set_is_read_where_it_lies(spark, tmp_path):
    test = samples(spark, "t", n=6, seed=4).withColumns({"split": F.lit("test"), "language": F.lit("en"), "knowledge": F.lit("k")})
    io.write_run(protocol.records_of(test.withColumn("score", F.rand(1)), "test", "probe", "v", "c", "v1"), META | {"split": "test"}, f"{tmp_path}/run", 0.5, "validation")
    run = io.read_run(spark, f"{tmp_path}/run")
    missing = report.evaluate_run(run, test, controlled_path=f"{tmp_path}/none.jsonl", replicates=0)
    assert "match_level" not in missing and any("not found" in r.warning for r in missing["warnings"].collect())
    closest = test.withColumn("answer", F.repeat(F.lit("x"), 9)).withColumn("match_id", F.col("pair_id"))
    same = test.drop("answer").join(closest.select("sample_id", "answer", "match_id"), "sample_id")
    io.write_jsonl(same.select(*[c for c in io.SAMPLE.fieldNames() if c in same.columns]), f"{tmp_path}/control.jsonl")
    found = report.evaluate_run(run, same.drop("match_id"), controlled_path=f"{tmp_path}/control.jsonl", replicates=0)
    assert found["match_level"].first().n_matches == 6


class FakeBackend:
    """Scores rise with the label as much as the setting says; checkpoints are small files."""

    def __init__(self, spark):
        self.spark, self.scored = spark, 0

    def train(self, setting, train, validation, folder):
        self.rows = train.count()
        for epoch in (1, 2):
            path = f"{folder}/{epoch}.bin"
            io.write_text(self.spark, path, f"{setting} {epoch}")
            yield epoch, self.score(setting | {"epoch": epoch}, path, validation), path

    def score(self, setting, checkpoint, rows):
        self.scored += 1
        noise = F.pmod(F.xxhash64("sample_id"), F.lit(1000)) / 1000
        return rows.select("sample_id", (setting["gain"] * F.col("label") * setting.get("epoch", 2) + noise).alias("score"))


def test_select_freeze_and_test_once(spark, tmp_path):
    train, validation, test = (samples(spark, s, seed=i) for i, s in enumerate(("r", "v", "t")))
    backend, folder = FakeBackend(spark), str(tmp_path / "run")
    chosen = protocol.select_and_freeze(backend, [{"gain": 0.0}, {"gain": 0.2}], train, validation, folder, META, train_rows=20)
    assert chosen["setting"] == {"gain": 0.2} and chosen["step"]["epoch"] == 2 and backend.rows == 20 and not chosen["after_test"]
    assert [(h["setting"], h["epoch"]) for h in chosen["steps"]] == [(0, 1), (0, 2), (1, 1), (1, 2)]
    assert chosen["step"]["auroc"] == max(h["auroc"] for h in chosen["steps"])
    protocol.Protocol(spark, folder).require_open()
    with pytest.warns(UserWarning, match="configuration"):
        assert protocol.Protocol(spark, folder).selected("new")["run"] == META
    out = protocol.test_frozen(backend, folder, test, validation, replicates=0)
    assert out["threshold"].first().threshold == chosen["cutoff"]["value"] and out["metrics"].filter("split = 'test'").first().auroc > 0.6
    with pytest.raises(DataIntegrityError, match="has been seen"):
        protocol.select_and_freeze(backend, [{"gain": 0.2}], train, validation, folder, META)
    again = protocol.select_and_freeze(backend, [{"gain": 0.2}], train, validation, folder, META, force=True)
    assert again["after_test"] and protocol.Protocol(spark, folder).selected()["at"] == again["at"] == 2
    io.write_text(spark, again["model"]["place"], "tampered")
    with pytest.raises(DataIntegrityError, match="changed"):
        protocol.Protocol(spark, folder).selected()
    with pytest.raises(FileNotFoundError):
        protocol.Protocol(spark, str(tmp_path / "none")).selected()
    with pytest.raises(ValueError, match="even"):
        protocol.subset_of_pairs(train, 7)
    assert protocol.variant_name("org/model x", knowledge=False, smoke=True) == "model-x_qa_smoke"


class Flaky(FakeBackend):
    """Scores differ whenever they are worked out, and one epoch may lack a sample or be of one class."""

    def __init__(self, spark, log, lacks=None):
        super().__init__(spark)
        self.log, self.lacks = log, lacks

    def score(self, setting, checkpoint, rows):
        log = self.log

        @F.pandas_udf("double")
        def drawn(s):
            with open(log, "a") as f:
                f.write("x\n" * len(s))
            return s.map(lambda _: float(np.random.default_rng().normal()))

        found = rows.select("sample_id", (F.col("label") * 3 + drawn("sample_id")).alias("score"))
        return found.filter(F.col("sample_id") != self.lacks) if setting.get("epoch") == 2 and self.lacks else found


def test_scores_are_worked_out_once(spark, tmp_path):
    validation, test = samples(spark, "v", n=8), samples(spark, "t", n=8, seed=1)
    log, folder = tmp_path / "asked", str(tmp_path / "run")
    backend = Flaky(spark, str(log))
    chosen = protocol.select_and_freeze(backend, [{"gain": 1}], validation, validation, folder, META)
    assert len(log.read_text().split()) == 2 * 16  # two epochs of 16 samples
    run = {r.sample_id: (r.score, r.pred_label) for r in io.read_run(spark, f"{folder}/validation")[0].collect()}
    assert len(run) == 16 and all(p == int(s >= chosen["cutoff"]["value"]) for s, p in run.values())
    protocol.test_frozen(backend, folder, test, validation, replicates=0)["metrics"].collect()
    assert len(log.read_text().split()) == 3 * 16
    with pytest.raises(DataIntegrityError, match="one finite number"):
        protocol.select_and_freeze(Flaky(spark, str(log), "v003_1"), [{"gain": 1}], validation, validation, str(tmp_path / "other"), META)
    with pytest.raises(FileNotFoundError):
        protocol.Protocol(spark, str(tmp_path / "other")).selected()


def test_frozen_thresholds_and_manifests(spark, tmp_path):
    good = {"split": "validation", "test_data_loaded": False, "criterion": "youden", "config_hash": "c", "prompt_version": "v1", "thresholds": {"a": {"selected_on": "validation", "threshold": 1}, "b": {"selected_on": "validation", "value": 0.5}}}
    assert protocol.frozen_thresholds(good, ["a", "b"], "c", "v1") == {"a": 1.0, "b": 0.5}
    for change in ({"split": "test"}, {"test_data_loaded": None}, {"test_data_loaded": 0}, {"config_hash": "d"}, {"thresholds": {"a": {"selected_on": "test", "threshold": 1}}}, {"thresholds": {"a": {"selected_on": "validation", "threshold": float("nan")}}}):
        with pytest.raises(DataIntegrityError):
            protocol.frozen_thresholds(good | change, ["a"], "c", "v1")
    rows = spark.createDataFrame([(f"S{i}_{y}", f"P{i}", "test", y) for i in range(4) for y in (0, 1)], "sample_id string, pair_id string, split string, label int")
    protocol.build_manifest(rows, f"{tmp_path}/m")
    protocol.verify_manifest(rows, f"{tmp_path}/m")
    with pytest.raises(DataIntegrityError):
        protocol.verify_manifest(rows.filter("pair_id <> 'P2'"), f"{tmp_path}/m")
    with pytest.raises(DataIntegrityError):
        protocol.build_manifest(rows.filter("sample_id <> 'S1_0'"), f"{tmp_path}/n")


def test_equivalence_asks_the_model_only_what_rules_leave_open(spark, tmp_path):
    log = tmp_path / "asked"
    known = {("the capital is paris", "paris it is for sure"): 0.9, ("paris it is for sure", "the capital is paris"): 0.9, ("the answer is 42 now", "42"): 0.95, ("one way only here", "another text stands there"): 0.99}

    def predict(premises, hypotheses):
        with open(log, "a") as f:
            f.writelines(f"{p}|{h}\n" for p, h in zip(premises, hypotheses))
        return [known.get(k, 0.0) for k in zip(premises, hypotheses)]

    cases = [("Paris", " paris ", True), ("Paris", "Paris is big", True), ("", "", False), (None, "x", False), ("the capital is paris", "paris it is for sure", True), ("42", "the answer is 42 now", True), ("one way only here", "another text stands there", False), ("Paris", "Paris is not big", False)]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases * 3)], "i int, a string, b string")
    probabilities = equivalence.entailment(equivalence.open_pairs(pairs), predict)
    found = spark.createDataFrame(probabilities.collect(), probabilities.schema)
    got = {r.i: r.same for r in equivalence.equivalent(pairs, found).collect()}
    assert [got[i] for i in range(len(got))] == [w for _, _, w in cases * 3]
    asked = log.read_text().splitlines()
    assert len(asked) == len(set(asked)) == 8
    rows = spark.createDataFrame([("p", ["the capital is paris", "Paris it is for sure", "paris it is for sure", "lyon", None, ""]), ("q", ["x"])], "key string, answers array<string>")
    assert {r.key: r.ids for r in equivalence.clustered(rows, "key", predict).collect()} == {"p": [0, 1, 0, 2, 3, 4], "q": [0]}
    # texts that differ in case are pairs of their own to the model, as it may tell them apart; blank ones equal nothing


def test_the_model_sees_a_pair_once_over_runs(spark, tmp_path):
    log, store = tmp_path / "asked", f"{tmp_path}/memory"

    def predict(premises, hypotheses):
        with open(log, "a") as f:
            f.writelines(f"{p}|{h}\n" for p, h in zip(premises, hypotheses))
        return [0.9 if {p[:3], h[:3]} == {"the"} else 0.1 for p, h in zip(premises, hypotheses)]

    rows = spark.createDataFrame([("p", ["the capital is paris", "the city of paris it is", "lyon lies far off there"]), ("q", ["the capital is paris", "the city of paris it is"])], "key string, answers array<string>")
    for _ in range(2):
        found = equivalence.clustered(rows, "key", predict, store=store, revision="r1")
        assert {r.key: r.ids for r in found.collect()} == {"p": [0, 0, 1], "q": [0, 0]} and found.count() == 2
    asked = log.read_text().splitlines()
    assert len(asked) == len(set(asked)) == 6  # three pairs, both ways, in two runs
    more = rows.unionByName(spark.createDataFrame([("r", ["lyon lies far off there", "rome is another place"])], rows.schema))
    assert equivalence.clustered(more, "key", predict, store=store, revision="r1").count() == 3 and len(log.read_text().splitlines()) == 8
    equivalence.clustered(rows, "key", predict, store=store, revision="r2").collect()  # another model knows nothing yet
    assert len(log.read_text().splitlines()) == 14
    equivalence.clustered(rows, "key", predict).collect()
    assert len(log.read_text().splitlines()) == 20  # without a store once a run, however often it is read


def test_entropy_runs_are_taken_up_where_they_stopped(spark, tmp_path, monkeypatch):
    g = spark.createDataFrame([(f"P{i}", ["Paris", "paris ", "London", "Rome"], 10.0 + i) for i in range(6)], "pair_id string, answers array<string>, latency_s double")
    s = spark.createDataFrame([(f"S{i}_{y}", f"P{i}", a) for i in range(6) for y, a in ((0, "PARIS"), (1, "Berlin"))], "sample_id string, pair_id string, answer string")
    meta, folder = {"split": "test", "variant": "exact", "config_hash": "c", "prompt_version": "v1"}, f"{tmp_path}/runs"
    kept = records.candidates

    def stops(*a, **k):
        raise KeyboardInterrupt

    monkeypatch.setattr(records, "candidates", stops)
    with pytest.raises(KeyboardInterrupt):
        records.run_entropy(g, s, folder, meta)
    monkeypatch.setattr(records, "candidates", kept)
    changed = g.withColumn("answers", F.array(F.lit("other")))  # what was generated before the stop counts
    table = records.run_entropy(changed, s, folder, meta)
    assert table.rows("scored").count() == 12
    rows, side = io.read_run(spark, io.run_path(folder, records.CANDIDATE, "exact", "test"))
    assert {(r.sample_id[-1], r.score) for r in rows.collect()} == {("0", 0.5), ("1", 1.0)} and report.cost_unit(rows, side.first().extra) == ("pair", None)
    with pytest.raises(DataIntegrityError, match="provenance"):
        records.run_entropy(g, s, folder, meta | {"config_hash": "d"})
    with pytest.raises(DataIntegrityError, match="without generations"):
        records.run_entropy(g.filter("pair_id <> 'P1'"), s, f"{tmp_path}/other", meta)


def test_entropy_records_and_rescoring(spark):
    g = spark.createDataFrame([("P1", ["Paris", "paris ", "London", "Rome"], 10.0, 4), ("P2", ["a", "a", "a", "a"], 2.0, 4)], "pair_id string, answers array<string>, latency_s double, n_generations int")
    s = spark.createDataFrame([("S1_0", "P1", "PARIS"), ("S1_1", "P1", "Berlin"), ("S2_0", "P2", "a"), ("S2_1", "P2", "b")], "sample_id string, pair_id string, answer string")
    meta = {"split": "validation", "variant": "exact", "config_hash": "c", "prompt_version": "v1"}
    out = records.entropy_records(records.candidates(g, s), meta)
    score = {(r.detector, r.sample_id): r.score for r in out.collect()}
    h = -(0.5 * np.log(0.5) + 2 * 0.25 * np.log(0.25))
    assert score == pytest.approx({("se_global", "S1_0"): h, ("se_global", "S1_1"): h, ("se_global", "S2_0"): 0, ("se_global", "S2_1"): 0, ("se_candidate", "S1_0"): 0.5, ("se_candidate", "S1_1"): 1, ("se_candidate", "S2_0"): 0, ("se_candidate", "S2_1"): 1})
    assert all(json.loads(r.extra)["pair_id"] in ("P1", "P2") and "label" not in r.extra for r in out.collect()) and {r.latency_s for r in out.collect()} == {10.0, 2.0}
    records.require_paired(out, s)
    saved = g.select("pair_id", F.transform("answers", lambda x: F.lit("a")).alias("answers"), F.lit("c").alias("config_hash"), F.lit("v1").alias("prompt_version"))
    again = records.rescored(saved, s, out, "c", "v1", "tag1")
    assert {r.score for r in again.filter("detector = 'se_global'").collect()} == {0.0} and {r.latency_s for r in again.collect()} == {10.0, 2.0}
    for wrong in (saved.withColumn("config_hash", F.lit("d")), saved.filter("pair_id = 'P1'"), saved.withColumn("answers", F.array(F.lit(" ")))):
        with pytest.raises(DataIntegrityError):
            records.rescored(wrong, s, out, "c", "v1", "t").collect()
    with pytest.raises(DataIntegrityError):
        records.rescored(saved, s, out.filter("sample_id <> 'S2_1'"), "c", "v1", "t").collect()
    bad = records.checkpoint_violations(out.withColumn("variant", F.lit("x y")), s.filter("sample_id <> 'S1_0'"), {"variant": "exact", "split": "validation"})
    assert {r.rule for r in bad.filter("sample_id = 'S1_0'").collect()} == {"unexpected", "variant"}


def test_tokens_spans_poolings_and_cache(spark, tmp_path):
    log = tmp_path / "calls"

    def tokenizer(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[len(w) for w in t.split()] for t in texts]

    rows = spark.createDataFrame([("a", "x yy"), ("b", "z"), ("c", None)], "sample_id string, answer string")
    cache = f"{tmp_path}/cache"
    for fingerprint, calls in (("t1", 3), ("t1", 3), ("t2", 6)):
        got = {r.sample_id: r.answer_length_tokens for r in tokens.with_token_lengths(rows, tokenizer, fingerprint, cache).collect()}
        assert got == {"a": 2, "b": 1, "c": 0} and len(log.read_text().split("\n")) - 1 == calls
    row = spark.createDataFrame([([1, 2], [3, 4, 5], [[0.0, 0.0], [1.0, 3.0], [3.0, 5.0], [5.0, 1.0], [9.0, 9.0], [7.0, 7.0]])], "p array<int>, a array<int>, s array<array<double>>")
    ids, start, end = tokens.answer_span(F.col("p"), F.col("a"), 9)
    pools = [tokens.pooled(F.col("s"), F.lit(1), F.lit(4), p).alias(p) for p in tokens.POOLINGS]
    assert list(row.select(ids.alias("i"), start.alias("x"), end.alias("y"), *pools).first()) == [[1, 2, 3, 4, 5, 9], 2, 5, [0.0, 0.0], [5.0, 1.0], [3.0, 3.0], [9.0, 9.0]]
    with pytest.raises(Exception, match="empty answer"):
        row.select(tokens.answer_span(F.col("p"), F.array().cast("array<int>"), 9)[0]).collect()
    lp = row.select(tokens.target_logprobs(F.col("s"), F.array(*[F.lit(1)] * 6)).alias("l")).first().l
    z = np.array([[0, 0], [1, 3], [3, 5], [5, 1], [9, 9], [7, 7]], float)
    assert lp == pytest.approx((z[:, 1] - np.log(np.exp(z).sum(1))).tolist())
    for wrong in ((["x"], None), ([], None), (["tbg"], [3])):
        with pytest.raises(ValueError):
            tokens.resolved(*wrong, 3)


def test_model_boundary_with_fakes(spark):
    def generator(prompts, seeds):
        assert len(prompts) <= 2
        return [{"text": f" {p}/{None if seeds is None else s % 7} ", "token_ids": [1, 2], "token_logprobs": [-0.5, -1.5], "truncated": False} for p, s in zip(prompts, seeds or prompts)]

    rows = spark.createDataFrame([("a", "p"), ("b", "q")], "sample_id string, prompt string")
    greedy = models.generated(rows, generator, chunk=2).collect()
    assert {(r.sample_id, r["mode"], r.text, r.mean_logprob) for r in greedy} == {("a", "greedy", "p/None", -1.0), ("b", "greedy", "q/None", -1.0)}
    drawn = models.generated(rows, generator, samples=10, seed=42, chunk=2).collect()
    assert len(drawn) == 20 and len({r.seed for r in drawn}) == 20 and {(r.sample_id, r.sample_index): r.seed for r in drawn} == {(r.sample_id, r.sample_index): r.seed for r in models.generated(rows, generator, samples=10, seed=42, chunk=2).collect()}
    states = models.encoded(rows, lambda texts, layers: [[[float(n), float(len(t))] for n in layers] for t in texts], [3, 7], text="prompt").collect()
    assert {(r.sample_id, r.layer, tuple(r.features)) for r in states} == {(k, n, (float(n), 1.0)) for k in "ab" for n in (3, 7)}
