import itertools
import json
import pathlib
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.functions import stats, text
from sievelight.operators import leakage, matching, protocol, semantic, splits, validate
from sievelight.sources import io
from sievelight.sources.commit import version_folder
from sievelight.sources.shared import ensure_checkpoint_dir
from sievelight.streaming import resume

RECORD = ("S000001_1", "test", "length_only", "chars", 0.5, "abc", "p1", 1, 0.5, 10, 100, 2200.0, "{}")


def records(spark, *changes):
    names = io.RECORD.fieldNames()
    rows = [tuple({**dict(zip(names, RECORD)), **c}[n] for n in names) for c in changes or [{}]]
    return spark.createDataFrame(rows, io.RECORD)


BAD = {
    "string": ["", None, " ", "\u00a0"], "pred_label": [2, -1], "score": [None, float("nan"), float("inf"), float("-inf")], "amount": [-0.5, float("nan"), float("inf")], "count": [-1],
}
KINDS = {"latency_s": "amount", "peak_gpu_mem_mb": "amount", "n_generations": "count", "n_generated_tokens": "count", "pred_label": "pred_label", "score": "score"}


def test_every_record_rule_rejects_what_breaks_it(spark):
    cases = [(rule, {rule: v}) for rule in validate.record_rules() for v in BAD[KINDS.get(rule, "string")]]
    cases += [("split", {"split": "dev"}), ("detector", {"detector": "A b"}), ("detector", {"detector": "ab\n"}), ("variant", {"variant": "a b"})]
    rows = records(spark, *[{"sample_id": f"S{i}"} | change for i, (_, change) in enumerate(cases)])
    found = validate.record_violations(rows).groupBy("rule").count().collect()
    assert {r.rule: r["count"] for r in found} == {rule: sum(r == rule for r, _ in cases) for rule in validate.record_rules()}


def test_good_record(spark):
    assert validate.record_violations(records(spark)).count() == 0


def test_run_round_trip(spark, tmp_path):
    rows = records(spark, *[{"sample_id": f"S{i}", "score": s, "pred_label": None} for i, s in enumerate((0.1, 0.5, 0.9))])
    meta = {"detector": "length_only", "variant": "chars", "split": "test", "config_hash": "abc", "prompt_version": "p1"}
    io.write_run(rows, meta, f"{tmp_path}/run", 0.5, "validation")
    back, side = io.read_run(spark, f"{tmp_path}/run")
    assert [r.pred_label for r in back.orderBy("sample_id").collect()] == [0, 1, 1] and side.first().n_records == 3
    assert io.find_run(spark, [f"{tmp_path}/none", str(tmp_path)], "run").endswith("/run")
    with pytest.raises(validate.DataIntegrityError):
        io.write_run(rows, meta, f"{tmp_path}/x", 0.5, "test")
    with pytest.raises(validate.DataIntegrityError):
        io.write_run(rows.unionByName(rows), meta, f"{tmp_path}/x", 0.5, "validation")


def test_jsonl_checkpoint_features_and_hash(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    io.write_jsonl(rows, f"{tmp_path}/j")
    assert io.read_checkpoint(spark, f"{tmp_path}/j", "k", rows.schema).count() == 2
    assert io.read_checkpoint(spark, f"{tmp_path}/none", "k", rows.schema).count() == 0
    io.write_jsonl(rows.unionByName(rows), f"{tmp_path}/dup")
    with pytest.raises(validate.DataIntegrityError):
        io.read_checkpoint(spark, f"{tmp_path}/dup", "k", rows.schema)
    with pytest.raises(FileNotFoundError):
        io.read_jsonl(spark, f"{tmp_path}/missing")
    feats = spark.createDataFrame([(0, "s", 1, "h", "p"), (1, "t", 1, "h", "p")], "chunk int, sample_id string, layer int, config_hash string, prompt_version string")
    io.append_features(feats.filter("chunk = 0"), f"{tmp_path}/f")
    io.append_features(feats, f"{tmp_path}/f")
    assert io.read_features(spark, f"{tmp_path}/f").count() == 2
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\n")
    (tmp_path / "b.txt").write_bytes(b"x\ny\n")
    assert io.content_hash(spark, f"{tmp_path}/a.txt") == io.content_hash(spark, f"{tmp_path}/b.txt")
    assert json.loads(io.report_json({"t": rows}))["t"][0] == {"k": "a", "v": 1}


def test_resume_scores_only_what_is_new(spark, tmp_path):
    seen = []

    def score(df):
        seen.append(df.count())
        return df.withColumn("score", F.length("k"))

    rows = spark.createDataFrame([("a",), ("bb",)], "k string")
    resume.resume(rows, f"{tmp_path}/done", "k", score)
    out = resume.resume(rows.unionByName(spark.createDataFrame([("ccc",)], "k string")), f"{tmp_path}/done", "k", score)
    assert seen == [2, 1] and out.count() == 3
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"k": "dddd"}\n')
    resume.follow(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/done", f"{tmp_path}/cp", "k", score)
    assert spark.read.parquet(f"{tmp_path}/done").count() == 4


def test_text(spark):
    rows = spark.createDataFrame([(" a  b\t", ), ("Café",), ("",), ("Straße ﬁ",)], "t string")
    got = rows.select(text.clean(F.col("t")).alias("c"), text.normalized(F.col("t")).alias("n"), text.word_count(F.col("t")).alias("w")).collect()
    assert [r.c for r in got] == ["a b", "Café", "", "Straße ﬁ"]
    assert got[3].n == "strasse fi" and [r.w for r in got] == [2, 1, 0, 2]


ANCHORS = [
    ("Paris", "Paris is the capital.", True), ("Paris", "Paris is not the capital of France.", False), ("Par", "Paris is the capital.", False), ("a b c d", "a b c d e", False), ("12", "12 people", True), ("", "x", False),
    ("paris", "Paris, no doubt", True), ("paris", "paris never sleeps", True), ("paris", "paris", False), ("paris", "paris can't be", False), ("c++", "c++ rocks", False), ("c++", "c++x rocks", True), ("Paris", "PARIS \u2014 isn't it", False),
    ("Paris", "Paris will  not do", False), ("Paris", "Paris will do", True), ("Paris", "Paris knots", True), ("a b", " a b: not", False), ("\u00c9t\u00e9", "\u00e9t\u00e9 chaud", True), (None, "x y", False), ("x", None, False),
]


def test_anchor_rule(spark):
    rows = spark.createDataFrame([(i, s, w) for i, (s, w, _) in enumerate(ANCHORS)], "i int, s string, l string")
    got = {r.i: r.a for r in rows.select("i", text.anchored_short_answer(F.col("s"), F.col("l")).alias("a")).collect()}
    assert [(ANCHORS[i], got[i]) for i in got if got[i] is not ANCHORS[i][2]] == []


def test_formatting_features_by_hand(spark):
    texts = ["Hello, World! 12\u00b2 (\u00e9)\t\u00aa", "", "   ", "ABC", "\u01c5x\u00a0y?", "a.b.c:", "\u2460\u0663 z"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", *text.formatting_features(F.col("t"))).collect()
    punctuation = text.PUNCTUATION
    for r in got:
        t = texts[r.i]
        n, letters = max(len(t), 1), [c for c in t if c.isalpha()]
        k = max(len(letters), 1)
        want = (
            len(t), len(t.split()), len(t.replace(" ", "")) / max(len(t.split()), 1), sum(c.isupper() for c in letters) / k, sum(c.islower() for c in letters) / k, sum(c.isdigit() for c in t) / n, sum(c in punctuation for c in t) / n,
            sum(c.isspace() for c in t) / n, len(set(t)) / n, t.count(",") / n, t.count(".") / n, t.count("?") / n, t.count("!") / n, (t.count("(") + t.count(")")) / n, sum(not c.isascii() for c in t) / n, float(t[:1].isupper()), float(t[-1:] in punctuation and t != ""),
        )
        assert tuple(r)[1:] == pytest.approx(want), t


def test_prompt_parts_are_stripped_and_required(spark):
    row = spark.createDataFrame([("\tq? ", " k\u00a0", "\n a ")], "q string, k string, a string")
    said = row.select(text.user_message(F.col("q"), F.col("k")).alias("open"), text.user_message(F.col("q")).alias("closed"), *text.classifier_inputs(F.col("a"), F.col("q"), F.col("k")), text.classifier_inputs(F.col("a"))[0]).first()
    assert tuple(said) == ("Knowledge: k\n\nQuestion: q?", "Question: q?", "Question: q?\nAnswer: a", "Knowledge: k", "Answer: a")
    for q, k in ((" ", "k"), ("q", None)):
        with pytest.raises(Exception, match="empty"):
            spark.createDataFrame([(q, k)], "q string, k string").select(text.user_message(F.col("q"), F.col("k"))).collect()
    with pytest.raises(ValueError, match="version"):
        text.generation_prompt(F.lit("m"), version="v0")
    folded = spark.createDataFrame([("Stra\u00dfe \u00c9",), (None,)], "t string").select(text.normalized_answer(F.col("t")).alias("n"), text.unfinished_thinking(F.col("t")).alias("u")).collect()
    assert [(r.n, r.u) for r in folded] == [("strasse \u00e9", False), ("", False)]


@pytest.mark.parametrize("answers, ids", [(["Paris is the capital.", "  PARIS IS THE CAPITAL. ", "London"], [0, 0, 1]), (["x"], [0]), (["b", "a", "b", "c"], [0, 1, 0, 2]), ([None, " ", "x", ""], [0, 0, 1, 0])])
def test_first_fit(spark, answers, ids):
    same = lambda a, b: F.lower(text.collapse(a)) == F.lower(text.collapse(b))
    assert spark.createDataFrame([(answers,)], "a array<string>").select(semantic.first_fit(F.col("a"), same).alias("i")).first().i == ids


@pytest.mark.parametrize("ids, h, norm", [([0, 0, 0, 0], 0.0, 0.0), ([0, 1], np.log(2), 1.0), ([0, 1, 2], np.log(3), 1.0)])
def test_entropy(spark, ids, h, norm):
    row = spark.createDataFrame([(ids,)], "i array<int>").select(semantic.entropy(F.col("i")).alias("h"), semantic.normalized_entropy(F.col("i")).alias("n")).first()
    assert row.h == pytest.approx(h) and row.n == pytest.approx(norm)


@pytest.mark.parametrize("answers, candidate, p, matched", [(["Paris"] * 3 + ["London"], "Paris", 0.75, True), (["Paris", "Paris", "London"], "Berlin", 0.0, False)])
def test_candidate(spark, answers, candidate, p, matched):
    parts = semantic.candidate_score(F.col("a"), F.col("c"), lambda a, b: a == b)
    row = spark.createDataFrame([(answers, candidate)], "a array<string>, c string").select(*[v.alias(k) for k, v in parts.items()]).first()
    assert (row.probability, row.score, row.matched) == (p, 1 - p, matched)


def test_empty_answers_and_candidates_are_errors(spark):
    row = spark.createDataFrame([([], ["a"], " ")], "none array<string>, some array<string>, blank string")
    equal = lambda a, b: a == b
    for wrong in (semantic.first_fit(F.col("none"), equal), semantic.candidate_score(F.col("none"), F.lit("x"), equal)["score"], semantic.candidate_score(F.col("some"), F.col("blank"), equal)["score"]):
        with pytest.raises(Exception, match="no answers|no generations|empty candidate"):
            row.select(wrong).collect()


def test_split_counts_and_folds(spark):
    assert splits.split_counts(10_000) == (1000, 1001) and splits.split_counts(7500) == (750, 750)
    pairs = spark.range(200).select(F.format_string("P%05d", "id").alias("pair_id"))
    split = splits.split_pairs(pairs).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"test": 20, "validation": 20, "train": 160}
    folds = splits.grouped_folds(pairs.unionByName(pairs), "pair_id", 5)
    assert folds.groupBy("pair_id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0 and folds.select("fold").distinct().count() == 5
    with pytest.raises(ValueError):
        splits.grouped_folds(pairs.limit(3), "pair_id", 5)


def test_numbered_and_violations(spark):
    rows = spark.createDataFrame([(f"k{i:03d}",) for i in random.sample(range(300), 300)], "k string")
    assert [r.no for r in splits.numbered(rows, ["k"], buckets=7).orderBy("k").collect()] == list(range(300))
    bad = spark.createDataFrame([("S1_0", "P1", "test", 0), ("S1_1", "P1", "test", 1), ("S2_0", "P2", "test", 0), ("S3_0", "P3", "test", 0), ("S3_1", "P3", "train", 1)], "sample_id string, pair_id string, split string, label int")
    assert {r.pair_id for r in splits.pair_violations(bad).collect()} == {"P2", "P3"}


def test_coverage_and_align(spark):
    a, b = (spark.createDataFrame([(x,) for x in ids], "sample_id string") for ids in ("123", "234"))
    assert {tuple(r) for r in leakage.coverage(b, a).collect()} == {("4", "missing"), ("1", "extra")}
    with pytest.raises(ValueError):
        leakage.align(a, b)


def brute_force(rows, delta):
    zero, one = [[n for _, y, n in rows if y == k] for k in (0, 1)]
    best = (0, 0)
    small, large = (zero, one) if len(zero) <= len(one) else (one, zero)
    for pick in itertools.product([None, *range(len(large))], repeat=len(small)):
        used = [p for p in pick if p is not None]
        if len(set(used)) == len(used):
            gaps = [abs(small[i] - large[p]) for i, p in enumerate(pick) if p is not None]
            if all(g <= delta for g in gaps):
                best = max(best, (len(gaps), -sum(gaps)))
    return best


def test_optimal_and_greedy_matches(spark):
    ensure_checkpoint_dir(spark)
    rng = random.Random(4)
    for _ in range(4):
        rows = [(f"s{i}", rng.randint(0, 1), rng.randint(1, 12)) for i in range(9)]
        df = spark.createDataFrame(rows, "sample_id string, label int, length int")
        m = matching.optimal_matches(df, 2).collect()
        assert (len(m), -sum(r.gap for r in m)) == brute_force(rows, 2)
        assert len({r.id0 for r in m}) == len({r.id1 for r in m}) == len(m)
        edges = sorted((r.gap, r.id0, r.id1) for r in matching.caliper_edges(df, 3).collect())
        assert {(a[0], b[0]) for a in rows for b in rows if a[1] == 0 and b[1] == 1 and abs(a[2] - b[2]) <= 3} == {(i, j) for _, i, j in edges}
        used, greedy = set(), set()
        for g, i, j in edges:
            if i not in used and j not in used:
                used |= {i, j}
                greedy.add((i, j))
        for n in (5, 40):
            a, b = (sorted(rng.randint(1, 15) for _ in range(rng.randint(0, n))) for _ in "ab")
            found = matching.matched_counts(*np.unique(np.array(a, np.int64), return_counts=True), *np.unique(np.array(b, np.int64), return_counts=True), 2)
            full = np.zeros((len(a) + 1, len(b) + 1), int)  # the plain table, all cells
            for i in range(len(a)):
                for j in range(len(b)):
                    g = abs(a[i] - b[j])
                    full[i + 1, j + 1] = max(full[i, j + 1], full[i + 1, j], full[i, j] + 1000 - g if g <= 2 else 0)
            ends = [sorted(set(x)) for x in (a, b)]
            gaps = [g for i, j, n in found for g in [abs(ends[0][i] - ends[1][j])] * n]
            assert 1000 * len(gaps) - sum(gaps) == full[-1, -1] and all(g <= 2 for g in gaps)
        if edges:
            assert {(r.id0, r.id1) for r in matching.greedy_matches(matching.caliper_edges(df, 3)).collect()} == greedy


def plain_nearest(factual, hallucinated):
    free, out = list(hallucinated), []
    for i, n in factual:
        if free:
            at = min(range(len(free)), key=lambda j: (abs(free[j][1] - n), free[j][0]))
            out.append((i, free[at][0], abs(free[at][1] - n)))
            free.pop(at)
    return out


def test_nearest_free_is_the_plain_loop(spark):
    rng = random.Random(6)
    for _ in range(300):
        sides = [[(f"{i:03d}", rng.randint(0, 12)) for i in range(rng.randint(0, 25))] for _ in "ab"]
        assert matching.nearest_free(*sides) == plain_nearest(*sides)
    rows = [(f"a{i:02d}", 0, rng.randint(0, 9)) for i in range(20)] + [(f"b{i:02d}", 1, rng.randint(0, 9)) for i in range(15)] + [("none", 1, None), ("no label", None, 3)]
    got = matching.nearest_greedy(spark.createDataFrame(rows, "sample_id string, label int, length int")).collect()
    assert [tuple(r) for r in got] == plain_nearest([(i, n) for i, y, n in rows if y == 0], [(i, n) for i, y, n in rows if y == 1 and n is not None])
    many = [(f"{i:07d}", rng.randint(0, 3000)) for i in range(200_000)]
    assert len(matching.nearest_free(many, many)) == 200_000


def test_a_crowded_length_is_dealt_to_many_tasks(spark):
    rows = [(f"s{i}", i % 2, 7) for i in range(400)] + [(f"t{i}", i % 2, 5 + i % 7) for i in range(60)] + [("x", 0, None)]
    df = spark.createDataFrame(rows, "sample_id string, label int, length int")
    wanted = {(a[0], b[0], abs(a[2] - b[2])) for a in rows for b in rows if a[1] == 0 and b[1] == 1 and a[2] is not None and abs(a[2] - b[2]) <= 2}
    for per_task in (None, 1000, 1):
        got = [tuple(r) for r in matching.caliper_edges(df, 2, per_task).collect()]
        assert len(got) == len(wanted) and set(got) == wanted
    folded = matching.caliper_lengths(df, 2)
    assert folded.agg(F.sum(F.col("n0") * F.col("n1"))).first()[0] == len(wanted)
    # a million rows of one length: counts are matched, not rows
    assert matching.matched_counts(np.array([7]), np.array([10**6]), np.array([7, 8]), np.array([10**6 - 1, 5]), 1) == [(0, 0, 10**6 - 1), (0, 1, 1)]
    big = spark.range(40_000).select(F.format_string("s%06d", "id").alias("sample_id"), (F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") < 100, 8).otherwise(7).alias("length"))
    found = matching.optimal_matches(big, 1)
    assert found.agg(F.count("*"), F.countDistinct("id0"), F.countDistinct("id1"), F.sum("gap")).first() == (20_000, 20_000, 20_000, 0)


def in_order(edges):
    used, out = set(), set()
    for g, i, j in sorted(edges):
        if i not in used and j not in used:
            used |= {i, j}
            out.add((i, j, g))
    return out


def test_greedy_length_matches_of_crowded_lengths(spark):
    ensure_checkpoint_dir(spark)
    rng = random.Random(5)
    for most, share in ((4, 0.4), (25, 0.7)):
        rows = [(f"s{i}", int(rng.random() < share), rng.randint(1, most)) for i in range(120)]
        rows += [("none", 0, None)]
        df = spark.createDataFrame(rows, "sample_id string, label int, length int")
        got = matching.greedy_length_matches(df, 3).collect()
        edges = [(r.gap, r.id0, r.id1) for r in matching.caliper_edges(df, 3).collect()]
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == in_order(edges)


def test_greedy_query_has_no_most_matches(spark, tmp_path):
    from sievelight.plans import catalog

    n = 1100
    docs = [(i, "x" * 40 if i < 2 * n else "x" * 41, "en", "s") for i in range(2 * n + 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i, *_ in docs], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert catalog.QUERIES["d11_greedy_matches"](spark, str(tmp_path)).count() == n + 1


def test_greedy_matches_equal_the_order_of_edges(spark):
    ensure_checkpoint_dir(spark)
    edges = [(0, f"a{i:02d}", f"b{j:02d}") for i in range(12) for j in range(12)]
    df = spark.createDataFrame(edges, "gap int, id0 string, id1 string")
    assert {tuple(r) for r in matching.greedy_matches(df).collect()} == {(i, j, g) for i, j, g in in_order(edges)}


def test_consecutive_generations_use_all_rows(spark):
    rows = [("hot", i, f"t{i % 3}") for i in range(25)] + [("few", i, "x") for i in range(4)]
    df = spark.createDataFrame(rows, "user string, n int, a string")
    got = {(r["user"], r.group_no): r for r in semantic.consecutive_generations(df, "user", "n", "a").collect()}
    assert set(got) == {("hot", 0), ("hot", 1), ("hot", 2), ("few", 0)}
    assert got["hot", 1].answers == [f"t{i % 3}" for i in range(11, 21)] and got["hot", 1].candidate == "t0" and got["hot", 1].complete
    assert got["few", 0].answers == ["x"] * 4 and got["few", 0].candidate is None and not got["few", 0].complete
    assert sum(len(r.answers) + r.complete for r in got.values()) == len(rows)


@pytest.mark.parametrize("name", ["e23_e24_e25_entropy_all_rows", "l3_first_fit_clusters_all_rows", "l4_l6_candidate_score_all_rows"])
def test_queries_of_all_generations_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from sievelight.plans import catalog

    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    got = catalog.QUERIES[name](spark, d)
    key = lambda r: tuple(r[:2])
    want = sorted(db.execute(catalog.ORACLE_SQL[name]).fetchall(), key=key)
    mine = sorted((tuple(r) for r in got.collect()), key=key)
    assert len(mine) == len(want) and all(list(a[2:]) == pytest.approx(list(b[2:])) if not isinstance(a[2], list) else a == b for a, b in zip(mine, want))


def test_match_summary_has_coverage_classes_and_ks(spark):
    from sievelight.functions import stats

    rows = spark.createDataFrame([("a", 0, 10, 2), ("b", 0, 20, 4), ("c", 1, 11, 3), ("d", 1, 23, 5), ("e", 1, 99, 9)], "sample_id string, label int, length int, words int")
    matches = spark.createDataFrame([("a", "c", 1), ("b", "d", 3)], "id0 string, id1 string, gap int")
    r = matching.match_summary(matches, rows).first()
    assert (r.n_matches, r.total_gap, r.coverage_percent, r.ks_statistic) == (2, 4, 80.0, 0.5)
    assert (r.factual_mean_length, r.factual_std_length, r.hallucinated_median_length, r.hallucinated_max_length, r.factual_mean_words, r.hallucinated_median_words) == (15.0, pytest.approx(50**0.5), 17.0, 23, 3.0, 4.0)
    assert r.ks_p_value == pytest.approx(stats.ks_p_value(2, 2, 0.5))
    for n, k in ((4, 2), (9, 3), (30, 7), (12, 12), (7, 0)):
        assert stats.ks_p_value_equal(n, k / n) == pytest.approx(stats.ks_p_value(n, n, k / n), abs=1e-9)
    none = matching.match_summary(matches.limit(0), rows).first()
    assert (none.n_matches, none.coverage_percent, none.ks_statistic, none.ks_p_value) == (0, 0.0, None, None)


def test_optimal_query_has_a_row_for_each_tolerance(spark):
    from sievelight.plans import catalog

    got = catalog.QUERIES["d10_e20_r20_optimal_matches"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.delta for r in got) == [1, 3, 5, 10, 15] and all(0 <= r.coverage_percent <= 100 for r in got)


def test_excluding_by_no_key_keeps_all(spark):
    rows = spark.createDataFrame([("p1", "x"), ("p2", "y")], "pair_id string, norm string")
    assert leakage.exclude_pairs(rows, rows.limit(0), []).count() == 2
    assert {(r.scope, r.pair_id) for r in leakage.scopes(rows, rows.filter("norm = 'x'"), {"unseen": ["norm"]}).collect()} == {("all", "p1"), ("all", "p2"), ("unseen", "p2")}
    with pytest.raises(ValueError, match="pairs"):
        leakage.covered_by_all(rows.withColumn("sample_id", F.col("norm")), [], least_pairs=3)


def test_positions_are_those_of_a_plain_read(spark, tmp_path):
    rng = random.Random(3)
    lines = [{"pair_id": f"P{rng.randint(0, 400):05d}", "split": "train", "sample_id": f"S{i}_0", "n": i} for i in range(3000)]
    with open(tmp_path / "a.jsonl", "w") as f:
        f.writelines(json.dumps(r) + "\n" + "\n" * (i % 7 == 0) for i, r in enumerate(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = io.read_placed(spark, f"{tmp_path}/a.jsonl", "pair_id string, split string, sample_id string, n int")
        assert rows.select("place.block").distinct().count() > 20
        placed = splits.numbered(rows.repartition(7, "pair_id"), ["place"], "no", 5).select("n", "no").collect()
        assert len(placed) == 3000 and all(r.n == r.no for r in placed)
        first = {}
        for r in lines:
            first.setdefault(r["pair_id"], r["n"])
        got = splits.first_of(rows, ["pair_id"], "place", ["n"])
        assert {r.pair_id: r.n for r in got.collect()} == first
        listed = splits.manifest(rows.withColumn("sample_id", F.concat("pair_id", F.lit("_0"))), "place")
        in_order = [r.pair_id for r in listed.orderBy("place").collect()]
        assert in_order == list(first)
        whole = protocol.subset_of_pairs(rows, 20, position="place")
        assert {r.pair_id for r in whole.collect()} == set(list(first)[:10])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    rows.select("n").write.parquet(f"{tmp_path}/p")
    again = io.parquet_placed(spark, f"{tmp_path}/p").repartition(3)
    assert [r.n for r in again.orderBy("place").collect()] == [r.n for r in spark.read.parquet(f"{tmp_path}/p").collect()]


@pytest.mark.parametrize("spread", [3, 10_000])
def test_quantiles_are_exact(spark, spread):
    rng = np.random.default_rng(5)
    values = np.round(rng.normal(size=501) * spread) / 7
    rows = [(int(i % 3), float(v)) for i, v in enumerate(values)] + [(0, None), (9, 1.5)]
    df, shares = spark.createDataFrame(rows, "g int, v double"), [0, 0.05, 0.25, 0.5, 0.737, 1]
    assert stats.quantiles(df.filter("g < 9"), "v", shares).first().quantiles == pytest.approx(np.quantile(values, shares).tolist(), abs=1e-12)
    got = {r.g: r.quantiles for r in stats.quantiles(df, "v", shares, ["g"]).collect()}
    assert got[9] == [1.5] * 6 and set(got) == {0, 1, 2, 9}
    for g in range(3):
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], shares).tolist(), abs=1e-12)
    exact = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(float(s)) for s in shares])).alias("q")).collect()}
    assert got == exact and [r.quantiles for r in stats.quantiles(df.limit(0), "v", shares).collect()] == [[]]


def write_split(path, split, pairs, start=0, **changes):
    rows = []
    for i in range(start, start + pairs):
        for y in (0, 1):
            answer = "a" * (5 + i % 4 + y)
            rows.append({"sample_id": f"S{i:06d}_{y}", "pair_id": f"P{i:05d}", "split": split, "language": "en", "question": f"q{i}", "knowledge": "k", "answer": answer, "label": y, "answer_length_chars": len(answer)} | changes)
    (path / f"{split}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    return rows


def test_loaders_check_what_they_read(spark, tmp_path):
    at = 0
    for split, n in (("train", 6), ("validation", 4), ("test", 5)):
        write_split(tmp_path, split, n, at)
        at += n
    every = io.load_all(spark, str(tmp_path))
    listed = splits.manifest(every)
    hashes = {s: io.content_hash(spark, f"{tmp_path}/{s}.jsonl") for s in validate.SPLITS}
    assert io.load_all(spark, str(tmp_path), listed, hashes).groupBy("split").count().count() == 3
    for wrong in ({"expected_hash": "0" * 64}, {"manifest": listed.filter("pair_id <> 'P00011'")}):
        with pytest.raises(validate.DataIntegrityError):
            io.load_split(spark, str(tmp_path), "test", **wrong)
    with pytest.raises(ValueError, match="unknown split"):
        io.load_split(spark, str(tmp_path), "dev")
    test = io.load_split(spark, str(tmp_path), "test")
    assert io.load_counted(test, 10, 5).filter("answer_length_words = 1").count() == 10
    with pytest.raises(validate.DataIntegrityError):
        io.load_counted(test, 10, 4)
    controlled = matching.controlled_set(test, 1)
    assert io.load_controlled(controlled, test).count() == controlled.count() > 0
    assert matching.artefact_checks(controlled, test, 1, controlled.count()).filter("not ok").count() == 0
    for broken in (controlled.withColumn("question", F.lit("other")), controlled.unionByName(controlled), controlled.filter("label = 0")):
        with pytest.raises(validate.DataIntegrityError):
            io.load_controlled(broken, test)
    features = test.select("sample_id", "label", F.lit(1).alias("layer"))
    assert io.check_features(features, test).count() == 10
    with pytest.raises(validate.DataIntegrityError):
        io.check_features(features.withColumn("label", F.lit(0)), test)
    write_split(tmp_path, "test", 5, 10, answer_length_chars=99)
    with pytest.raises(validate.DataIntegrityError):
        io.load_split(spark, str(tmp_path), "test")


def test_runs_with_unknown_fields_and_small_files(spark, tmp_path):
    rows = records(spark, *[{"sample_id": f"S{i}", "score": float(i), "pred_label": None} for i in range(3)])
    meta = {"detector": "length_only", "variant": "chars", "split": "test", "config_hash": "abc", "prompt_version": "p1"}
    io.write_run(rows, meta, f"{tmp_path}/run", 0.5, "validation")
    pathlib.Path(f"{version_folder(spark, f'{tmp_path}/run')}/records/extra.json").write_text(json.dumps({"sample_id": "S9", "surprise": 1}) + "\n")
    with pytest.raises(validate.DataIntegrityError, match="unknown fields"):
        io.read_run(spark, f"{tmp_path}/run")
    for text_ in ("one", "two\nlines\n"):
        io.write_text(spark, f"{tmp_path}/t/x.json", text_)
        assert io.read_text(spark, f"{tmp_path}/t/x.json") == text_
    assert io.config_hash({"b": 1, "a": [2], "paths": "x"}) == io.config_hash({"a": [2], "b": 1, "paths": "y"}) != io.config_hash({"a": [2], "b": 2})
    with pytest.raises(ValueError, match="split"):
        io.run_path("out", "d", "v", "dev")


def test_capitals_letter_for_letter(spark):
    rows = spark.createDataFrame([("Straße ﬁn ᾳ é",), ("",), (None,)], "t string")
    assert [r.u for r in rows.select(text.upper_by_letter(F.col("t")).alias("u")).collect()] == ["STRAẞE ﬁN ᾼ É", "", None]


def test_equivalence_query_asks_about_texts_whose_capitals_are_one_letter(spark, tmp_path):
    from sievelight.plans import catalog

    turns = [(179, 2, "user", "Q"), (179, 3, "assistant", "Enberach\u00df.\nEnverge die nicht"), (3499, 0, "user", "Q"), (3499, 1, "assistant", "Ge\u00dfau sch ente")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.same, r.asked) for r in catalog.QUERIES["l5_r27_equivalence"](spark, str(tmp_path)).collect()}
    con = pytest.importorskip("duckdb").connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == {c: (same, asked) for c, _, same, asked in con.sql(catalog.ORACLE_SQL["l5_r27_equivalence"]).fetchall()} == {179: (False, True), 3499: (True, True)}


def test_order_query_takes_first_and_last_id_as_texts(spark, tmp_path):
    from sievelight.plans import catalog

    duckdb = pytest.importorskip("duckdb")
    spark.range(199800, 200200).selectExpr("id AS o_orderkey", "1D AS o_totalprice", "'x' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(199800, 200200).selectExpr("id AS l_orderkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, catalog.QUERIES["h5_order_differences"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(con.sql(catalog.ORACLE_SQL["h5_order_differences"]).fetchall()) and len(got) == 2


def test_manifests_are_compared_in_one_pass_with_repeats_and_places(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "split string, pair_id string, stem string, place long")
    old = rows(("a", "p", "s", 1), ("a", "p", "s", 2), ("a", None, "s", 3), ("b", "q", "t", 1), ("b", "r", "t", 2))
    new = rows(("a", "p", "s", 1), ("a", None, "s", 3), ("a", "n", "n", 4), ("b", "q", "t", 9), ("b", "r", "t", 8))
    found = splits.compare_manifests(old, new)
    assert {tuple(r) for r in found.collect()} == {("a", "p", "s", "old"), ("a", "n", "n", "new"), ("b", "q", "t", "order"), ("b", "r", "t", "order")}
    plain = splits.compare_manifests(old.drop("place"), new.drop("place"))
    assert plain.count() == 2 and plain._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2  # each side once
    assert not any(line.strip(" :+-").startswith("Window") and "split" in line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines())


def leaves(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_coverage_reads_each_side_once(spark):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "sample_id string")
    found = leakage.coverage(rows("a", "a", "b", None), rows("b", "c", "c", None))
    assert sorted(map(tuple, found.collect()), key=str) == [("a", "missing"), ("c", "extra"), (None, "extra"), (None, "missing")]
    assert leaves(found) == 2
    with pytest.raises(ValueError, match="a missing"):
        leakage.align(rows("a", "b"), rows("b"))


def test_a_text_in_several_files_has_one_hash(spark, tmp_path, monkeypatch):
    import hashlib

    (tmp_path / "plain").mkdir()
    (tmp_path / "crlf").mkdir()
    for i, (a, b) in enumerate([(b"a\nb\n", b"a\r\nb\r"), (b"c\rd\n", b"\nc\rd\n"), (b"", b"")]):
        (tmp_path / f"plain/part-{i}.json").write_bytes(a)
        (tmp_path / f"crlf/part-{i}.json").write_bytes(b)
    (tmp_path / "crlf/_SUCCESS").write_bytes(b"")
    wanted = hashlib.sha256(b"a\nb\nc\rd\n").hexdigest()
    assert io.content_hash(spark, f"{tmp_path}/crlf") == wanted
    monkeypatch.setattr(io, "_digest_of_lines", None)  # texts without CRLF don't go through Python
    assert io.content_hash(spark, f"{tmp_path}/plain") == wanted


@pytest.mark.parametrize("n, test, validation", [(1, 0.1, 0.1), (2, 0.1, 0.1), (5000, 0.1, 0.1), (40, 0.0, 0.5), (40, 0.5, 0.5), (40, 1.0, 0.1)])
def test_a_split_is_a_column_of_the_key(spark, n, test, validation):
    from sievelight.operators import splits

    keys = spark.range(n).select(F.format_string("P%05d", "id").alias("k"))
    n_test, n_val = splits.split_counts(n, test, validation)
    where = F.when(F.col("pos") < n_test, "test").when(F.col("pos") < n_test + n_val, "validation").otherwise("train")
    want = {r.k: r.split for r in splits.hashed_rank(keys, "k", 42).select("k", where.alias("split")).collect()}
    twice = keys.unionByName(keys)
    assert {r.k: r.split for r in twice.select("k", splits.split_column(twice, "k", 42, test, validation).alias("split")).collect()} == want
    assert {r.k: r.split for r in splits.split_pairs(twice, "k", 42, test, validation).collect()} == want


def test_few_texts_are_in_python_at_a_time(spark):
    from pyspark.util import PythonEvalType

    assert {f.evalType for f in (text._nfc, text._nfkc_casefold, text._casefold)} == {PythonEvalType.SQL_BATCHED_UDF}
    odd = ["Straße", "ﬁn\u00a0 Ｅnd", "e\u0301É", "plain Text", "", None, "İΣΑΣ", "ß" * 50000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", *[f(F.col("t")).alias(f.__name__) for f in (text.normalized, text.normalized_answer, text.clean)])
    for r in rows.collect():
        t = odd[r.i]
        folded = lambda s: None if s is None else " ".join(s.casefold().split())
        assert r.normalized == folded(None if t is None else unicodedata.normalize("NFKC", t))
        assert r.normalized_answer == folded(t or "")
        assert r.clean == (None if t is None else unicodedata.normalize("NFC", " ".join(t.split())))
