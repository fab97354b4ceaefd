"""Queries for metrics, thresholds, strata, bootstrap, comparison, fusion and probes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import bootstrap, equivalence, fusion, matching, metrics, probe, protocol, report, resampling
from ..sources.shared import ensure_checkpoint_dir, held
from . import views
from .registry import Registry, rounded
from .tables import FEATURE_SQL, WORDS_SQL

R = Registry()
q, sql = R.query, views.sql
S, T = views.samples, views.text_samples

#: Fixed thresholds of queries that aren't about choosing one.
AT_A, AT_B = 150000.0, 4.0

# SQL shared by several checks: rates from tp, fp, fn, tn.
_P = "tp / nullif(tp + fp, 0)"
_RC = "tp / nullif(tp + fn, 0)"
_SP = "tn / nullif(tn + fp, 0)"
_F1 = f"2 * ({_P}) * ({_RC}) / nullif(({_P}) + ({_RC}), 0)"
_RATES = f"""tp, fp, fn, tn, tp + fp + fn + tn AS n, tp + fn AS n_pos, fp + tn AS n_neg, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 9) AS accuracy,
  round({_P}, 9) AS precision, round({_RC}, 9) AS recall, round({_SP}, 9) AS specificity, round({_F1}, 9) AS f1"""
_COUNT = "count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn"
_RATE_NAMES = ("accuracy", "precision", "recall", "specificity", "f1")


def _area(score: str, source: str, where: str = "true") -> str:
    return f"""SELECT sum(pos * (coalesce(below, 0) + neg / 2)) / nullif(sum(pos)::DOUBLE * sum(neg), 0) AS auroc FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
      FROM (SELECT {score} AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {source} WHERE {where} GROUP BY 1))"""


def _candidates(score: str, source: str, where: str) -> str:
    return f"""SELECT CASE WHEN lone THEN s ELSE (s + nxt) / 2 END AS threshold, (CASE WHEN lone THEN allp ELSE allp - cp END)::BIGINT AS tp, (CASE WHEN lone THEN alln ELSE alln - cn END)::BIGINT AS fp, (CASE WHEN lone THEN 0 ELSE cp END)::BIGINT AS fn, (CASE WHEN lone THEN 0 ELSE cn END)::BIGINT AS tn FROM
      (SELECT s, lead(s) OVER (ORDER BY s) AS nxt, sum(pos) OVER (ORDER BY s) AS cp, sum(neg) OVER (ORDER BY s) AS cn, sum(pos) OVER () AS allp, sum(neg) OVER () AS alln, count(*) OVER () = 1 AS lone FROM
      (SELECT {score}::DOUBLE AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {source} WHERE {where} GROUP BY 1)) WHERE nxt IS NOT NULL OR lone"""


_YOUDEN = f"({_RC}) + ({_SP}) - 1"
_ACC = "(tp + tn) / nullif(tp + fp + fn + tn, 0)"


def _choose(value: str, order: str = "threshold") -> str:
    return f"(SELECT threshold FROM (SELECT threshold, coalesce({value}, '-infinity'::DOUBLE) AS value FROM cand ORDER BY value DESC, {order} LIMIT 1))"


def long_scores(s):
    """(sample_id, pair_id, split, label, detector, score) for the two detectors."""
    both = F.explode(F.array(F.struct(F.lit("a").alias("detector"), F.col("score_a").alias("score")), F.struct(F.lit("b").alias("detector"), F.col("score_b").alias("score"))))
    return s.select("sample_id", "pair_id", "split", "label", "length", both.alias("d")).select("sample_id", "pair_id", "split", "label", "length", "d.*")


def _flagship_sql() -> str:
    parts = []
    for name, col in (("a", "score_a"), ("b", "score_b")):
        parts.append(
            f"""SELECT '{name}' AS detector, threshold, {_RATES}, (SELECT round(auroc, 9) FROM ({_area(col, 'samples', "split = 'test'")})) AS auroc,
      (SELECT round(avg(CASE WHEN h > f THEN 1.0 WHEN h = f THEN 0.5 ELSE 0.0 END), 9) FROM (SELECT max({col}) FILTER (label = 1) AS h, max({col}) FILTER (label = 0) AS f FROM samples WHERE split = 'test' GROUP BY pair_id)) AS pair_accuracy
      FROM (SELECT threshold, {_COUNT} FROM (SELECT *, ({col} >= threshold)::INTEGER AS pred FROM samples, (WITH cand AS ({_candidates(col, 'samples', "split = 'validation'")}) SELECT {_choose(_YOUDEN)} AS threshold) t WHERE split = 'test') GROUP BY 1)"""
        )
    return sql("samples", " UNION ALL ".join(parts))


@q("flagship_validation_threshold_test_metrics", _flagship_sql())
def flagship(spark, d):
    """Per detector: threshold chosen on validation, metrics, AUROC and pair accuracy on test."""
    # samples are read once, into pairs that hold both rows' scores; all else reads those
    one = lambda y, c: F.max(F.when(F.col("label") == y, F.col(c)))
    wide = held(S(spark, d).filter("split <> 'train'").groupBy("split", "pair_id").agg(*[one(y, c).alias(f"{c}_{y}") for c in ("score_a", "score_b") for y in (0, 1)]))
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), F.col(f"{c}_0").alias("factual"), F.col(f"{c}_1").alias("hallucinated")) for n, c in (("a", "score_a"), ("b", "score_b"))]))
    pairs = wide.select("split", "pair_id", both.alias("e")).select("split", "pair_id", "e.*")
    rows = F.explode(F.array(F.struct(F.lit(0).alias("label"), F.col("factual").alias("score")), F.struct(F.lit(1).alias("label"), F.col("hallucinated").alias("score"))))
    groups = held(metrics.score_groups(pairs.select("detector", "split", rows.alias("e")).select("detector", "split", "e.*").filter("score is not null"), ["detector", "split"]))
    validation, test = groups.filter("split = 'validation'"), groups.filter("split = 'test'")
    chosen = metrics.select_threshold(metrics.threshold_candidates(validation), ["detector"])
    up = F.col("score") >= F.col("threshold")
    part = lambda c, t: F.sum(F.when(t, F.col(c)).otherwise(0)).cast("long")
    counts = test.join(F.broadcast(chosen), "detector").groupBy("detector", "threshold").agg(part("pos", up).alias("tp"), part("neg", up).alias("fp"), part("pos", ~up).alias("fn"), part("neg", ~up).alias("tn"))
    pairs = pairs.filter("split = 'test'").withColumn("complete", F.col("factual").isNotNull() & F.col("hallucinated").isNotNull())
    out = metrics.rates(counts).join(metrics.auroc_of(test, ["detector"]), "detector").join(metrics.pair_accuracy(pairs, ["detector"]).select("detector", "pair_accuracy"), "detector")
    return out.withColumns(rounded(*_RATE_NAMES, "auroc", "pair_accuracy"))


def _predicted(s, threshold=AT_A, score="score_a"):
    return s.withColumn("pred", metrics.predicted(F.col(score), F.lit(threshold)))


_PRED = f"scored AS (SELECT *, (score_a >= {AT_A})::INTEGER AS pred FROM samples)"


@q("e1_metrics_null", sql("samples", f"SELECT length::INTEGER AS length, {_RATES} FROM (SELECT length, {_COUNT} FROM scored GROUP BY 1)", _PRED))
def _(spark, d):
    return metrics.metrics(_predicted(S(spark, d)), ["length"]).withColumns(rounded(*_RATE_NAMES))


@q("e3_e4_metrics_zero", sql("samples", f"SELECT split, tp, fp, fn, tn, round(coalesce({_P}, 0), 9) AS precision, round(coalesce({_RC}, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1_tp FROM (SELECT split, {_COUNT} FROM scored GROUP BY 1)", "scored AS (SELECT *, (score_a >= 1e9)::INTEGER AS pred FROM samples)"))
def _(spark, d):
    rows = _predicted(S(spark, d), 1e9)
    zero = metrics.metrics(rows, ["split"], undefined="zero").select("split", "tp", "fp", "fn", "tn", "precision", "recall")
    return zero.join(metrics.metrics(rows, ["split"], undefined="tp").select("split", F.col("f1").alias("f1_tp")), "split").withColumns(rounded("precision", "recall", "f1_tp"))


@q("e2_auroc_ties", sql("samples", f"SELECT (SELECT round(auroc, 9) FROM ({_area('score_b', 'samples')})) AS all_rows, (SELECT round(auroc, 9) FROM ({_area('score_b', 'samples', 'label = 1')})) AS one_class"))
def _(spark, d):
    s = S(spark, d)
    both = metrics.auroc(s, [], "score_b").select(F.round("auroc", 9).alias("all_rows"))
    one = metrics.auroc(s.filter("label = 1"), [], "score_b").select(F.round("auroc", 9).alias("one_class"))
    return both.join(F.broadcast(one))


@q("c4_predict", sql("samples", f"SELECT sample_id, (score_b >= {AT_B})::INTEGER AS pred FROM samples"))
def _(spark, d):
    return S(spark, d).select("sample_id", metrics.predicted(F.col("score_b"), F.lit(AT_B)).alias("pred"))


@q("d3_e5_e7_pair_level", sql("samples", "SELECT split, count(*) AS n_pairs, round(avg(w), 9) AS pair_accuracy, count(*) FILTER (w = 0.5) AS n_ties FROM (SELECT pair_id, any_value(split) AS split, CASE WHEN max(score_b) FILTER (label = 1) > max(score_b) FILTER (label = 0) THEN 1.0 WHEN max(score_b) FILTER (label = 1) = max(score_b) FILTER (label = 0) THEN 0.5 ELSE 0.0 END AS w FROM samples GROUP BY 1) GROUP BY 1"))
def _(spark, d):
    s = S(spark, d)
    paired = metrics.pairs(s, "pair_id", "score_b").join(s.select("pair_id", "split").distinct(), "pair_id")
    return metrics.pair_accuracy(paired, ["split"]).withColumns(rounded("pair_accuracy"))


_MATCH = """m AS (SELECT label, doc_id, length, row_number() OVER (PARTITION BY label, length ORDER BY doc_id) AS k FROM text_samples)"""


@q("d4_e6_match_level", sql("text_samples", "SELECT count(*) AS n_pairs, round(avg(CASE WHEN b.doc_id > a.doc_id THEN 1.0 WHEN b.doc_id = a.doc_id THEN 0.5 ELSE 0.0 END), 9) AS pair_accuracy FROM m a JOIN m b ON a.label = 0 AND b.label = 1 AND a.length = b.length AND a.k = b.k", _MATCH))
def _(spark, d):
    w = Window.partitionBy("label", "length").orderBy("doc_id")
    rows = T(spark, d).withColumn("match_id", F.concat_ws("_", F.lit("d0"), "length", F.row_number().over(w)))
    return metrics.pair_accuracy(metrics.pairs(rows, "match_id", "doc_id")).select("n_pairs", F.round("pair_accuracy", 9).alias("pair_accuracy"))


@q("e8_error_lengths", sql("samples", "SELECT o.outcome, coalesce(n, 0) AS n, round(mean, 9) AS mean, median FROM (VALUES ('TP'), ('TN'), ('FP'), ('FN')) o(outcome) LEFT JOIN (SELECT CASE WHEN label = 1 AND pred = 1 THEN 'TP' WHEN label = 0 AND pred = 0 THEN 'TN' WHEN label = 0 THEN 'FP' ELSE 'FN' END AS outcome, count(*) AS n, avg(length) AS mean, median(length)::DOUBLE AS median FROM scored WHERE split = 'test' GROUP BY 1) USING (outcome)", _PRED))
def _(spark, d):
    return metrics.error_lengths(_predicted(S(spark, d)).filter("split = 'test'")).withColumns(rounded("mean"))


@q("g1_worst_errors", sql("samples", "SELECT * FROM (SELECT sample_id, score_a AS score, 'FP' AS kind FROM scored WHERE label = 0 AND pred = 1 ORDER BY score_a DESC, sample_id LIMIT 10) UNION ALL SELECT * FROM (SELECT sample_id, score_a, 'FN' FROM scored WHERE label = 1 AND pred = 0 ORDER BY score_a, sample_id LIMIT 10)", _PRED))
def _(spark, d):
    return metrics.worst_errors(_predicted(S(spark, d)).withColumn("score", F.col("score_a"))).select("sample_id", "score", "kind")


@q("e9_e10_cost_totals", sql("samples", "SELECT 'row' AS unit, sum(score_b) AS latency_s, sum(length)::BIGINT AS n_generations FROM samples UNION ALL SELECT 'pair', sum(x), sum(y)::BIGINT FROM (SELECT max(score_b) AS x, max(length) AS y FROM samples GROUP BY pair_id)"))
def _(spark, d):
    s = S(spark, d)
    named = lambda df: df.select("pair_id", F.col("score_b").alias("latency_s"), F.col("length").alias("n_generations"), F.lit(None).cast("long").alias("n_generated_tokens"), F.lit(None).cast("double").alias("peak_gpu_mem_mb"))
    shared = s.groupBy("pair_id").agg(F.max("score_b").alias("score_b"), F.max("length").alias("length"))
    pair_rows = named(s.select("pair_id").join(shared, "pair_id"))
    row = lambda df, unit, once: fusion.cost_totals(df, once).select(F.lit(unit).alias("unit"), "latency_s", "n_generations")
    return row(named(s), "row", None).unionByName(row(pair_rows, "pair", "pair_id"))


@q("e11_amortised_latency", sql("samples", "SELECT sample_id, score_b / count(*) OVER (PARTITION BY pair_id) AS latency_s FROM samples"))
def _(spark, d):
    return fusion.amortised(S(spark, d).select("sample_id", "pair_id", F.col("score_b").alias("latency_s")), "latency_s").select("sample_id", "latency_s")


@q("e30_e31_log_loss_accuracy", sql("samples", "SELECT round(-avg(label * ln(p) + (1 - label) * ln(1 - p)), 9) AS log_loss, round(avg((label = (score_b >= 4)::INTEGER)::INTEGER), 9) AS accuracy FROM (SELECT label, score_b, greatest(least(1 / (1 + exp(-(score_b - 4))), 1 - 1e-15), 1e-15) AS p FROM samples WHERE split = 'validation')"))
def _(spark, d):
    rows = S(spark, d).filter("split = 'validation'").withColumn("p", 1 / (1 + F.exp(-(F.col("score_b") - 4))))
    accuracy = metrics.metrics(_predicted(rows, AT_B, "score_b"), []).select("accuracy")
    return metrics.log_loss(rows, "p").join(F.broadcast(accuracy)).withColumns(rounded("log_loss", "accuracy"))


_RANKED = "by_rank AS (SELECT score_a, score_b, length, " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r_{c}" for c in ("score_a", "score_b", "length")) + " FROM samples)"


@q("e28_diagnostics", sql("samples", " UNION ALL ".join(f"SELECT '{c}' AS input, (SELECT round(auroc, 9) FROM ({_area(c, 'samples')})) AS auroc, count(DISTINCT {c}) AS n_distinct, {clip} AS clipped, round(corr(r_{c}, r_length), 9) AS spearman_length FROM by_rank" for c, clip in (("score_a", "NULL::DOUBLE"), ("score_b", "avg((score_b / 20 <= 1e-12)::INTEGER)"))), _RANKED))
def _(spark, d):
    rows = S(spark, d).withColumn("raw_b", F.col("score_b") / 20)
    return fusion.diagnostics(rows, ["score_a", "score_b"], {"score_b": "raw_b"}).withColumns(rounded("auroc", "spearman_length"))


@q("e28_input_correlations", sql("samples", "SELECT a, b, round(p, 9) AS pearson FROM (SELECT unnest(['score_a', 'score_a', 'score_b']) AS a, unnest(['score_b', 'length', 'length']) AS b, unnest([corr(score_a, score_b), corr(score_a, length), corr(score_b, length)]) AS p FROM samples)"))
def _(spark, d):
    return fusion.input_correlations(S(spark, d), ["score_a", "score_b", "length"]).withColumns(rounded("pearson"))


# --- thresholds ---------------------------------------------------------------------------
@q("f3_threshold_candidates", sql("samples", f"SELECT threshold, tp, fp, fn, tn FROM ({_candidates('score_b', 'samples', 'true')})"))
def _(spark, d):
    return metrics.threshold_candidates(metrics.score_groups(S(spark, d), [], "score_b")).select("threshold", "tp", "fp", "fn", "tn")


@q("f4_select_threshold", sql("samples", f"SELECT {_choose(_YOUDEN)} AS youden, {_choose(_F1)} AS f1, {_choose(_ACC)} AS accuracy", f"cand AS ({_candidates('score_a', 'samples', 'split = ' + chr(39) + 'validation' + chr(39))})"))
def _(spark, d):
    cand = metrics.threshold_candidates(metrics.score_groups(S(spark, d).filter("split = 'validation'"), [], "score_a"))
    one = [metrics.select_threshold(cand, [], name).select(F.col("threshold").alias(name)) for name in ("youden", "f1", "accuracy")]
    return one[0].join(F.broadcast(one[1])).join(F.broadcast(one[2]))


_ALL_SCORES = "cand AS (SELECT t AS threshold, count(*) FILTER (label = 1 AND score_b >= t) AS tp, count(*) FILTER (label = 0 AND score_b >= t) AS fp, count(*) FILTER (label = 1 AND score_b < t) AS fn, count(*) FILTER (label = 0 AND score_b < t) AS tn FROM (SELECT DISTINCT score_b AS t FROM samples UNION SELECT 0.0 UNION SELECT 1.0), samples GROUP BY 1)"


@q("f5_f6_probe_threshold", sql("samples", f"SELECT {_choose('coalesce(' + _F1 + ', 0)', 'threshold DESC')} AS largest, {_choose('coalesce(' + _F1 + ', 0)')} AS lowest", _ALL_SCORES))
def _(spark, d):
    cand = metrics.score_thresholds(metrics.score_groups(S(spark, d), [], "score_b"), [])
    pick = lambda ties: metrics.select_threshold(cand, [], "f1", ties, "zero").select(F.col("threshold").alias("largest" if ties != "lowest" else "lowest"))
    return pick("largest").join(F.broadcast(pick("lowest")))


@q("f7_threshold_curve", sql("samples", f"SELECT threshold, {_RATES} FROM (SELECT threshold, {_COUNT} FROM (SELECT t.threshold, label, (score_b >= threshold)::INTEGER AS pred FROM samples, (SELECT DISTINCT unnest(quantile_cont(score_b, [i / 20 FOR i IN range(21)])) AS threshold FROM samples) t) GROUP BY 1)".replace("quantile_cont(score_b, [i / 20 FOR i IN range(21)])", "quantile_cont(score_b, [" + ", ".join(str(i / 20) for i in range(21)) + "])")))
def _(spark, d):
    return metrics.threshold_curve(S(spark, d), 21, "score_b").withColumns(rounded(*_RATE_NAMES))


_EDGES = "edges AS (SELECT list_sort(list_distinct(quantile_cont(length, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM text_samples WHERE split = 'validation')"
_TSCORED = "scored AS (SELECT *, (length >= 1000)::INTEGER AS pred, (SELECT len(list_filter(e[2:len(e) - 1], lambda x: x <= length))::INTEGER FROM edges) AS bin FROM text_samples WHERE split = 'test')"


@q("f8_length_edges", sql("text_samples", "SELECT unnest(e) AS edge FROM edges", _EDGES))
def _(spark, d):
    return metrics.length_edges(T(spark, d).filter("split = 'validation'")).select(F.explode("edges").alias("edge"))


_STRATA = f"""SELECT b.bin, '[' || printf('%g', e[b.bin + 1]) || ', ' || printf('%g', e[b.bin + 2]) || CASE WHEN b.bin = len(e) - 2 THEN ']' ELSE ')' END AS bin_range, {_RATES}, least(tp + fn, fp + tn) AS n_min,
  least(tp + fn, fp + tn) >= 30 AS reliable, (tp + fn) / nullif(tp + fp + fn + tn, 0) AS frac_hallucinated, round(auroc, 9) AS auroc
  FROM (SELECT b.bin, {_COUNT} FROM (SELECT unnest(range(greatest(len(e) - 1, 1)))::INTEGER AS bin FROM edges) b LEFT JOIN scored USING (bin) GROUP BY 1) b
  LEFT JOIN (SELECT bin, sum(pos * (coalesce(below, 0) + neg / 2)) / nullif(sum(pos)::DOUBLE * sum(neg), 0) AS auroc FROM (SELECT bin, pos, neg, sum(neg) OVER (PARTITION BY bin ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
    FROM (SELECT bin, length AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY 1, 2)) GROUP BY 1) a ON a.bin = b.bin, edges"""


@q("f9_length_strata", sql("text_samples", _STRATA, _EDGES, _TSCORED))
def _(spark, d):
    t = T(spark, d)
    scored = t.filter("split = 'test'").withColumn("pred", (F.col("length") >= 1000).cast("int"))
    return metrics.stratified(scored, metrics.length_edges(t.filter("split = 'validation'")), score="length").withColumns(rounded(*_RATE_NAMES, "auroc"))


@q("f10_best_row", "SELECT p_brand AS brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def _(spark, d):
    return metrics.best_by(views.table(spark, d, "part"), "p_retailprice", "p_partkey", ["p_brand"]).select(F.col("p_brand").alias("brand"), "p_partkey")


@q("v12_inverted_scores", sql("samples", f"SELECT (SELECT auroc FROM ({_area('-score_b', 'samples')})) < 0.45 AS inverted"))
def _(spark, d):
    from ..operators.validate import inverted_score_warning

    return metrics.auroc(S(spark, d).withColumn("score", -F.col("score_b")), []).select(inverted_score_warning(F.col("auroc")).isNotNull().alias("inverted"))


# --- bootstrap and comparison ---------------------------------------------------------------
#: Replicates of the queries that SQL repeats, and of the whole job.
REPLICATES, FULL_REPLICATES = 50, 1000


def _boot_sql(score: str, at: float, name: str, wide: str = "wide", weights: str = "weights") -> str:
    return f"""{name}_rows AS (SELECT rep, mult, s0, s1 FROM {weights} JOIN (SELECT cluster_no, {score}_0 AS s0, {score}_1 AS s1 FROM {wide}) USING (cluster_no)),
  {name}_counts AS (SELECT rep, sum(mult * (s1 >= {at})::INTEGER) AS tp, sum(mult * (s0 >= {at})::INTEGER) AS fp, sum(mult * (s1 < {at})::INTEGER) AS fn, sum(mult * (s0 < {at})::INTEGER) AS tn,
    sum(mult * CASE WHEN s1 > s0 THEN 1.0 WHEN s1 = s0 THEN 0.5 ELSE 0.0 END) / sum(mult) AS pair_accuracy FROM {name}_rows GROUP BY 1),
  {name}_area AS (SELECT rep, sum(pos * (coalesce(below, 0) + neg / 2)) / (sum(pos)::DOUBLE * sum(neg)) AS auroc FROM (SELECT rep, pos, neg, sum(neg) OVER (PARTITION BY rep ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
    FROM (SELECT rep, s, coalesce(sum(mult) FILTER (y = 1), 0) AS pos, coalesce(sum(mult) FILTER (y = 0), 0) AS neg FROM (SELECT rep, mult, s0 AS s, 0 AS y FROM {name}_rows UNION ALL SELECT rep, mult, s1, 1 FROM {name}_rows) GROUP BY 1, 2)) GROUP BY 1),
  {name} AS (SELECT rep, auroc, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, pair_accuracy FROM {name}_counts JOIN {name}_area USING (rep))"""


def _weights_sql(name: str = "weights", wide: str = "wide", replicates: int = REPLICATES) -> str:
    """Draws, and the sample itself as replicate -1."""
    return f"""{name} AS (SELECT rep, cluster_no, count(*) AS mult FROM (SELECT r.rep, ('0x' || substr(sha256('42:' || r.rep || ':' || i.i), 1, 8))::BIGINT % (SELECT count(*) FROM {wide}) AS cluster_no FROM (SELECT unnest(range({replicates})) AS rep) r, (SELECT unnest(range((SELECT count(*) FROM {wide}))) AS i) i) GROUP BY 1, 2
    UNION ALL SELECT -1, cluster_no, 1 FROM {wide})"""


_WIDE = """wide AS (SELECT row_number() OVER (ORDER BY pair_id) - 1 AS cluster_no, * FROM (SELECT pair_id, max(score_a) FILTER (label = 0) AS score_a_0, max(score_a) FILTER (label = 1) AS score_a_1, max(score_b) FILTER (label = 0) AS score_b_0, max(score_b) FILTER (label = 1) AS score_b_1,
  max(length) FILTER (label = 0) AS length_0, max(length) FILTER (label = 1) AS length_1 FROM samples WHERE split = 'test' GROUP BY 1))"""


def _listed(*metrics: str) -> str:
    return f"unnest([{', '.join(repr(m) for m in metrics)}]) AS metric, unnest([{', '.join(metrics)}]) AS value"


_SUMMED = "round(max(value) FILTER (rep = -1), 9) AS estimate, round(quantile_cont(value, 0.025) FILTER (rep >= 0), 9) AS low, round(quantile_cont(value, 0.975) FILTER (rep >= 0), 9) AS high"


def _diff_sql(a: str, b: str, metrics: tuple[str, ...]) -> str:
    return f"SELECT rep, unnest([{', '.join(repr(m) for m in metrics)}]) AS metric, unnest([{', '.join(f'{a}.{m} - {b}.{m}' for m in metrics)}]) AS value FROM {a} JOIN {b} USING (rep)"


def _wide(spark, d):
    return held(bootstrap.pair_table(S(spark, d).filter("split = 'test'"), "pair_id", ["score_a", "score_b", "length"]))


def _replicates(spark, d, replicates=REPLICATES, scores=("score_a", "score_b")):
    """Replicates by hashed draws of ``scores``, in their order."""
    wide, at = _wide(spark, d), {"score_a": AT_A, "score_b": AT_B}
    reps = held(resampling.replicates(wide, {c: at[c] for c in scores}, resampling.Draw(wide.count(), replicates, 42, "hash")))
    return [reps.filter(F.col("detector") == c).drop("detector") for c in scores]


_BOUNDS = ("estimate", "low", "high")
_SAID = "CASE WHEN low > 0 THEN 'IMPROVES' WHEN high < 0 THEN 'WORSE' ELSE 'INCONCLUSIVE' END"


def _intervals_sql(replicates: int) -> str:
    return sql("samples", f"SELECT metric, {_SUMMED}, count(value) FILTER (rep >= 0) AS n_reps FROM (SELECT rep, {_listed(*bootstrap.ALL_METRICS)} FROM b) GROUP BY 1", _WIDE, _weights_sql(replicates=replicates), _boot_sql("score_b", AT_B, "b"))


def _differences_sql(replicates: int) -> str:
    found = f"SELECT metric, {_SUMMED}, avg((value > 0)::INTEGER) FILTER (rep >= 0) AS frac_a_better FROM ({_diff_sql('a', 'b', bootstrap.ALL_METRICS)}) GROUP BY 1"
    return sql("samples", f"SELECT *, coalesce(low > 0 OR high < 0, false) AS ci_excludes_zero FROM ({found})", _WIDE, _weights_sql(replicates=replicates), _boot_sql("score_a", AT_A, "a"), _boot_sql("score_b", AT_B, "b"))


@q("k1_k2_k4_bootstrap_ci", _intervals_sql(REPLICATES))
def _(spark, d):
    return bootstrap.intervals(_replicates(spark, d, scores=["score_b"])[0], bootstrap.ALL_METRICS).withColumns(rounded(*_BOUNDS))


@q("k3_k7_k8_paired_difference", _differences_sql(REPLICATES))
def _(spark, d):
    return bootstrap.paired_difference(*_replicates(spark, d), bootstrap.ALL_METRICS).withColumns(rounded(*_BOUNDS))


@q("k1_k2_k4_bootstrap_ci_1000", _intervals_sql(FULL_REPLICATES))
def _(spark, d):
    """Intervals of all metrics over as many replicates as the reference draws."""
    return bootstrap.intervals(_replicates(spark, d, FULL_REPLICATES, ["score_b"])[0], bootstrap.ALL_METRICS).withColumns(rounded(*_BOUNDS))


@q("k3_k7_k8_paired_difference_1000", _differences_sql(FULL_REPLICATES))
def _(spark, d):
    """Paired differences of all metrics over as many replicates as the reference draws."""
    return bootstrap.paired_difference(*_replicates(spark, d, FULL_REPLICATES), bootstrap.ALL_METRICS).withColumns(rounded(*_BOUNDS))


def _drawn(spark, d, kind: str, seed: int):
    wide = _wide(spark, d)
    reps = held(resampling.replicates(wide, {"score_a": AT_A, "score_b": AT_B}, resampling.Draw(wide.count(), FULL_REPLICATES, seed, kind)))
    return [reps.filter(F.col("detector") == c).drop("detector") for c in ("score_a", "score_b")]


@q("k1_k4_tree_bootstrap")
def _(spark, d):
    """Intervals of all metrics over 1,000 replicates whose weights are drawn in their own tasks."""
    return bootstrap.intervals(_drawn(spark, d, "tree", 42)[1], bootstrap.ALL_METRICS)


@q("k3_tree_paired_difference")
def _(spark, d):
    return bootstrap.paired_difference(*_drawn(spark, d, "tree", 42), bootstrap.ALL_METRICS)


@q("k1_k4_sequence_bootstrap")
def _(spark, d):
    """Intervals draw for draw as numpy's generator gives them."""
    return bootstrap.intervals(_drawn(spark, d, "sequence", 0)[1], bootstrap.ALL_METRICS)


_THREE = {"score_a": AT_A, "score_b": AT_B, "length": 8.0}
_BOOTS = [_WIDE, _weights_sql(), *[_boot_sql(c, t, c) for c, t in _THREE.items()]]


def _compared(spark, d):
    return bootstrap.compared(S(spark, d).filter("split = 'test'"), _THREE, "score_a", "pair_id", REPLICATES, hold=held, draw="hash")


@q("k8_compare_detectors", sql("samples", " UNION ALL ".join(f"SELECT '{c}' AS detector, metric, {_SUMMED}, count(value) FILTER (rep >= 0) AS n_reps FROM (SELECT rep, {_listed(*bootstrap.METRICS)} FROM {c}) GROUP BY 2" for c in _THREE), *_BOOTS))
def _(spark, d):
    """Three detectors over the same resamples, with estimates."""
    return _compared(spark, d)["intervals"].withColumns(rounded(*_BOUNDS))


@q("k8_differences_to_reference", sql("samples", " UNION ALL ".join(f"SELECT '{c}' AS detector, *, coalesce(low > 0 OR high < 0, false) AS ci_excludes_zero FROM (SELECT metric, {_SUMMED}, avg((value > 0)::INTEGER) FILTER (rep >= 0) AS frac_a_better FROM ({_diff_sql(c, 'score_a', bootstrap.METRICS)}) GROUP BY 1)" for c in ("score_b", "length")), *_BOOTS))
def _(spark, d):
    return _compared(spark, d)["differences"].withColumns(rounded(*_BOUNDS))


@q("k7_verdict", sql("samples", "SELECT metric, CASE WHEN bool_and(low > 0) THEN 'IMPROVES' WHEN bool_or(high < 0) THEN 'WORSE' ELSE 'INCONCLUSIVE' END AS verdict FROM (" + " UNION ALL ".join(f"SELECT metric, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM ({_diff_sql('score_a', c, bootstrap.METRICS)}) WHERE rep >= 0 GROUP BY 1" for c in ("score_b", "length")) + ") GROUP BY 1", *_BOOTS))
def _(spark, d):
    """Does score_a beat every other input, for each metric?"""
    return _compared(spark, d)["verdict"]


_MATCHED = """matched AS (SELECT label, 'd0_' || length || '_' || row_number() OVER (PARTITION BY label, length ORDER BY doc_id) AS match_id, doc_id::DOUBLE AS score FROM text_samples),
  wide AS (SELECT row_number() OVER (ORDER BY match_id) - 1 AS cluster_no, * FROM (SELECT match_id, max(score) FILTER (label = 0) AS score_0, max(score) FILTER (label = 1) AS score_1 FROM matched GROUP BY 1 HAVING count(*) = 2))"""


@q("k6_matched_bootstrap", sql("text_samples", f"SELECT metric, {_SUMMED}, count(value) FILTER (rep >= 0) AS n_reps FROM (SELECT rep, {_listed('auroc', 'accuracy')} FROM m) GROUP BY 1", _MATCHED, _weights_sql(), _boot_sql("score", 500.0, "m")))
def _(spark, d):
    """AUROC and accuracy over resampled length matches."""
    w = Window.partitionBy("label", "length").orderBy("doc_id")
    rows = T(spark, d).withColumn("match_id", F.concat_ws("_", F.lit("d0"), "length", F.row_number().over(w))).withColumn("score", F.col("doc_id").cast("double"))
    whole = rows.groupBy("match_id").count().filter("count = 2")
    wide = held(bootstrap.pair_table(rows.join(whole.select("match_id"), "match_id", "left_semi"), "match_id", ["score"]))
    n = wide.count()
    reps = bootstrap.replicate_metrics(wide, bootstrap.with_itself(bootstrap.draws(spark, n, REPLICATES), n), "score", 500.0)
    return bootstrap.intervals(reps, ("auroc", "accuracy")).withColumns(rounded(*_BOUNDS))


_CORRECT = f"correct AS (SELECT sample_id, unnest(['a', 'b', 'c']) AS detector, unnest([((score_a >= {AT_A})::INTEGER = label)::INTEGER, ((score_b >= {AT_B})::INTEGER = label)::INTEGER, ((length >= 8)::INTEGER = label)::INTEGER]) AS correct FROM samples WHERE split = 'test')"


def _correct(spark, d):
    right = lambda c, t: ((F.col(c) >= t).cast("int") == F.col("label")).cast("int")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), right(c, t).alias("correct")) for n, c, t in (("a", "score_a", AT_A), ("b", "score_b", AT_B), ("c", "length", 8))]))
    return S(spark, d).filter("split = 'test'").select("sample_id", rows.alias("e")).select("sample_id", "e.*")


@q("e26_e27_error_overlap_mcnemar", sql("samples", """SELECT a, b, both_right, only_a_right, only_b_right, both_wrong, round(CASE WHEN only_a_right + only_b_right = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) FROM (SELECT unnest(range(least(only_a_right, only_b_right) + 1)) AS k, only_a_right + only_b_right AS n))) END, 6) AS p_value FROM
  (SELECT x.detector AS a, y.detector AS b, count(*) FILTER (x.correct = 1 AND y.correct = 1) AS both_right, count(*) FILTER (x.correct = 1 AND y.correct = 0) AS only_a_right, count(*) FILTER (x.correct = 0 AND y.correct = 1) AS only_b_right, count(*) FILTER (x.correct = 0 AND y.correct = 0) AS both_wrong FROM correct x JOIN correct y USING (sample_id) WHERE x.detector < y.detector GROUP BY 1, 2)""", _CORRECT))
def _(spark, d):
    return fusion.error_overlap(_correct(spark, d)).withColumns(rounded("p_value", digits=6))


@q("e26_oracle_accuracy", sql("samples", "SELECT round(avg(o), 9) AS oracle_accuracy, count(*) FILTER (o = 0) AS all_wrong FROM (SELECT max(correct) AS o FROM correct GROUP BY sample_id)", _CORRECT))
def _(spark, d):
    return fusion.oracle_accuracy(_correct(spark, d)).withColumns(rounded("oracle_accuracy"))


@q("e26_wrong_samples", sql("samples", "SELECT sample_id, list(detector ORDER BY detector) FILTER (correct = 0) AS wrong_by, max(correct) = 0 AS all_wrong FROM correct GROUP BY 1 HAVING min(correct) = 0", _CORRECT))
def _(spark, d):
    return fusion.wrong_samples(_correct(spark, d))


# --- report ---------------------------------------------------------------------------------
_REPORT_CTES = (
    f"cand AS ({_candidates('score_a', 'samples', 'split = ' + chr(39) + 'validation' + chr(39))})",
    f"t AS (SELECT {_choose(_YOUDEN)} AS threshold)",
    "scored AS (SELECT *, (score_a >= threshold)::INTEGER AS pred FROM samples, t WHERE split <> 'train')",
    "pairs AS (SELECT split, CASE WHEN h > f THEN 1.0 WHEN h = f THEN 0.5 ELSE 0.0 END AS w FROM (SELECT split, pair_id, max(score_a) FILTER (label = 1) AS h, max(score_a) FILTER (label = 0) AS f FROM samples WHERE split <> 'train' GROUP BY 1, 2))",
)
_REPORT_SQL = f"""SELECT 'metrics' AS section, m.split, name, round(value, 9) AS value FROM (SELECT split, unnest(['accuracy', 'precision', 'recall', 'specificity', 'f1']) AS name, unnest([accuracy, precision, recall, specificity, f1]) AS value FROM (SELECT split, {_RATES} FROM (SELECT split, {_COUNT} FROM scored GROUP BY 1))) m
  UNION ALL SELECT 'metrics', 'validation', 'auroc', (SELECT round(auroc, 9) FROM ({_area('score_a', 'samples', "split = 'validation'")}))
  UNION ALL SELECT 'metrics', 'test', 'auroc', (SELECT round(auroc, 9) FROM ({_area('score_a', 'samples', "split = 'test'")}))
  UNION ALL SELECT 'pair_level', split, 'pair_accuracy', round(avg(w), 9) FROM pairs GROUP BY split
  UNION ALL SELECT 'outcomes', split, outcome || '_mean', round(avg(length), 9) FROM (SELECT split, length, CASE WHEN label = 1 AND pred = 1 THEN 'TP' WHEN label = 0 AND pred = 0 THEN 'TN' WHEN label = 0 THEN 'FP' ELSE 'FN' END AS outcome FROM scored) GROUP BY 2, 3
  UNION ALL SELECT 'threshold', 'validation', 'youden', threshold FROM t"""


@q("l15_evaluate_detector", sql("samples", _REPORT_SQL, *_REPORT_CTES))
def _(spark, d):
    """Sections of a detector's report in long form; the threshold is validation's."""
    rows = held(S(spark, d).filter("split <> 'train'").withColumn("score", F.col("score_a")))
    parts = report.evaluate_detector(rows.filter("split = 'test'"), rows.filter("split = 'validation'"), replicates=0, hold=held)
    long = lambda df, section, names: df.select(F.lit(section).alias("section"), "split", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("e")).select("section", "split", "e.*")
    out = long(parts["metrics"], "metrics", (*_RATE_NAMES, "auroc")).unionByName(long(parts["pair_level"], "pair_level", ("pair_accuracy",)))
    outcomes = parts["outcomes"].filter("n > 0").select(F.lit("outcomes").alias("section"), "split", F.concat("outcome", F.lit("_mean")).alias("name"), F.col("mean").alias("value"))
    threshold = parts["threshold"].select(F.lit("threshold").alias("section"), F.col("selected_on").alias("split"), F.col("criterion").alias("name"), F.col("threshold").alias("value"))
    return out.unionByName(outcomes).unionByName(threshold).withColumn("value", F.when(F.col("section") == "threshold", F.col("value")).otherwise(F.round("value", 9)))


# --- detectors, probes and fusion -------------------------------------------------------------
@q("l1_l2_length_only", sql("text_samples", f"""SELECT direction, (SELECT {_choose(_YOUDEN)} FROM (SELECT 1)) AS threshold FROM dir""", f"dir AS (SELECT CASE WHEN auroc >= 0.5 THEN 1 ELSE -1 END::INTEGER AS direction FROM ({_area('length', 'text_samples', 'split = ' + chr(39) + 'validation' + chr(39))}))", "directed AS (SELECT label, length * direction AS s, split FROM text_samples, dir)", f"cand AS ({_candidates('s', 'directed', 'split = ' + chr(39) + 'validation' + chr(39))})"))
def _(spark, d):
    model = protocol.fit_length(T(spark, d).filter("split = 'validation'").withColumn("answer_length_chars", F.col("length")))
    return spark.createDataFrame([(model.direction, model.threshold)], "direction int, threshold double")


def _solved(p: int) -> list[str]:
    """Newton moves of up to three weights from gradient g0.. and Hessian h00.., by Cramer's rule."""
    h = lambda i, j: f"h{min(i, j)}{max(i, j)}"
    if p == 2:
        det = "(h00 * h11 - h01 * h01)"
        return [f"(h11 * g0 - h01 * g1) / {det}", f"(h00 * g1 - h01 * g0) / {det}"]
    pairs = lambda i, j: [(i + 1) % 3, (i + 2) % 3, (j + 1) % 3, (j + 2) % 3]
    minor = lambda i, j: (lambda a, b, c, d: f"({h(a, c)} * {h(b, d)} - {h(a, d)} * {h(b, c)})")(*pairs(i, j))
    det = "(" + " + ".join(f"h0{j} * {minor(0, j)}" for j in range(3)) + ")"
    return ["(" + " + ".join(f"{minor(j, i)} * g{j}" for j in range(3)) + f") / {det}" for i in range(3)]


def _newton_sql(name: str, rows: str, k: int, free: bool, by: str = "grp", steps: int = 25) -> str:
    """Recursive term that fits logistic regressions of y on x1.. for each ``by`` of ``rows``:
    weights w0.. after ``steps`` Newton steps, penalty |w|^2 / 2 with or without the intercept."""
    w, g = [f"w{i}" for i in range(k + 1)], range(k + 1)
    x = lambda i: "1.0" if i == 0 else f"x{i}"
    ridge = lambda i: 0 if free and i == 0 else 1
    grads = [f"sum((q - y) * {x(i)}) + {ridge(i)} * w{i} AS g{i}" for i in g]
    curves = [f"sum(q * (1 - q) * {x(i)} * {x(j)}) + {ridge(i) if i == j else 0} AS h{i}{j}" for i in g for j in g if i <= j]
    z = " + ".join(f"w{i} * {x(i)}" for i in g)
    return f"""{name} AS (SELECT DISTINCT {by}, 0 AS step, {', '.join(f'0.0::DOUBLE AS {c}' for c in w)} FROM {rows} UNION ALL
    SELECT {by}, step + 1, {', '.join(f'w{i} - {m}' for i, m in enumerate(_solved(k + 1)))} FROM (SELECT {by}, step, {', '.join(w)}, {', '.join([*grads, *curves])}
      FROM (SELECT r.*, step, {', '.join(w)}, 1 / (1 + exp(-({z}))) AS q FROM {name} JOIN {rows} r USING ({by}) WHERE step < {steps}) GROUP BY {by}, step, {', '.join(w)}))"""


_ZERO_F1 = "coalesce(2 * p * r / nullif(p + r, 0), 0)"
_R11 = (
    "sd AS (SELECT avg(length) AS m, CASE WHEN stddev_pop(length) > 0 THEN stddev_pop(length) ELSE 1 END AS s FROM text_samples WHERE split = 'train')",
    "train AS (SELECT 0 AS grp, label::DOUBLE AS y, (length - m) / s AS x1 FROM text_samples, sd WHERE split = 'train')",
    _newton_sql("fit", "train", 1, free=True),
    "scored AS (SELECT split, label, 1 / (1 + exp(-(w0 + w1 * (length - m) / s))) AS p, length FROM text_samples, sd, (SELECT * FROM fit QUALIFY step = max(step) OVER ()))",
    "cand AS (SELECT t, lead, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM (SELECT t, lead, (SELECT count(*) FROM scored WHERE split = 'validation' AND label = 1 AND p >= t)::DOUBLE AS tp, (SELECT count(*) FROM scored WHERE split = 'validation' AND label = 0 AND p >= t)::DOUBLE AS fp, (SELECT count(*) FROM scored WHERE split = 'validation' AND label = 1 AND p < t)::DOUBLE AS fn FROM (SELECT DISTINCT p AS t, 0 AS lead FROM scored WHERE split = 'validation' UNION SELECT 0.0, 0 UNION SELECT 1.0, 0)))",
    f"chosen AS (SELECT t FROM cand ORDER BY {_ZERO_F1} DESC, t LIMIT 1)",
    "counted AS (SELECT t, count(*) FILTER (label = 1 AND p >= t)::DOUBLE AS tp, count(*) FILTER (label = 0 AND p >= t)::DOUBLE AS fp, count(*) FILTER (label = 1 AND p < t)::DOUBLE AS fn, count(*) FILTER (label = 0 AND p < t)::DOUBLE AS tn FROM scored, chosen WHERE split = 'test' GROUP BY 1)",
    "rated AS (SELECT t, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, (tp + fp + fn + tn)::BIGINT AS n FROM counted)",
)


@q("r11_length_logistic", sql("text_samples", f"SELECT round(t, 6) AS threshold, round(accuracy, 9) AS accuracy, round(p, 9) AS precision, round(r, 9) AS recall, round({_ZERO_F1}, 9) AS f1, n, (SELECT round(auroc, 9) FROM ({_area('round(p, 12)', 'scored', 'split = ' + chr(39) + 'test' + chr(39))})) AS auroc FROM rated", *_R11).replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    """Logistic regression on the length alone (intercept free), fitted on train, threshold of best
    F1 (lowest on ties) on validation, metrics on test."""
    rows = T(spark, d).withColumn("chars", F.col("length").cast("double"))
    p = 1 / (1 + F.exp(-F.col("score")))
    scored = held(probe.feature_models(rows, F.col("split") == "train", F.col("split") != "train", {"chars": ["chars"]}, free_intercept=True, keep=["split"]).withColumn("score", p))
    chosen = metrics.select_threshold(metrics.score_thresholds(metrics.score_groups(scored.filter("split = 'validation'"), []), []), [], "f1", "lowest", "zero")
    test = scored.filter("split = 'test'").join(F.broadcast(chosen.select("threshold"))).withColumn("pred", metrics.predicted(F.col("score"), F.col("threshold")))
    found = metrics.metrics(test, ["threshold"], undefined="zero").join(F.broadcast(metrics.auroc(test.withColumn("score", F.round("score", 12)), [])))
    return found.select("threshold", "accuracy", "precision", "recall", "f1", "n", "auroc").withColumns(rounded("accuracy", "precision", "recall", "f1", "auroc") | rounded("threshold", digits=6))


def _rates_at_zero(source: str, by: str) -> str:
    """Rates at decision 0 and AUROC (of decisions to nine digits) for each ``by`` of (by, label, z)."""
    return f"""SELECT {by}, round(auroc, 9) AS auroc, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
    round(coalesce(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 0), 9) AS f1 FROM
    (SELECT {by}, count(*) FILTER (label = 1 AND z >= 0)::DOUBLE AS tp, count(*) FILTER (label = 0 AND z >= 0)::DOUBLE AS fp, count(*) FILTER (label = 1 AND z < 0)::DOUBLE AS fn, count(*) FILTER (label = 0 AND z < 0)::DOUBLE AS tn FROM {source} GROUP BY ALL)
    JOIN (SELECT {by}, sum(pos * (coalesce(below, 0) + neg / 2)) / nullif(sum(pos)::DOUBLE * sum(neg), 0) AS auroc FROM (SELECT {by}, pos, neg, sum(neg) OVER (PARTITION BY {by} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
      FROM (SELECT {by}, round(z, 9) AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {source} GROUP BY ALL)) GROUP BY 1) USING ({by})"""


def _rated_at_zero(scored):
    """The same of (feature, label, score)."""
    scored = held(scored.withColumn("score", F.round("score", 9)))
    rates = metrics.metrics(scored.withColumn("pred", metrics.predicted(F.col("score"), F.lit(0.0))), ["feature"], undefined="zero")
    out = metrics.auroc(scored, ["feature"]).select("feature", "auroc").join(rates.select("feature", "accuracy", "precision", "recall", "f1"), "feature")
    return out.withColumns(rounded("auroc", "accuracy", "precision", "recall", "f1"))


_LENGTHS = (
    f"sized AS (SELECT split, label, length::DOUBLE AS chars, {WORDS_SQL}::DOUBLE AS words FROM text_samples)",
    "sd AS (SELECT avg(chars) AS m1, stddev_pop(chars) AS s1, avg(words) AS m2, stddev_pop(words) AS s2 FROM sized WHERE split = 'train')",
    "ready AS (SELECT 'lengths' AS grp, split, label, label::DOUBLE AS y, (chars - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1 END AS x1, (words - m2) / CASE WHEN s2 > 0 THEN s2 ELSE 1 END AS x2 FROM sized, sd)",
    "train AS (SELECT * FROM ready WHERE split = 'train')",
    _newton_sql("fit", "train", 2, free=False),
    "tested AS (SELECT grp AS feature, label, round(w0 + w1 * x1 + w2 * x2, 9) AS z FROM ready JOIN (SELECT * FROM fit QUALIFY step = max(step) OVER ()) USING (grp) WHERE split = 'test')",
)


@q("r11_length_pair_logistic", sql("text_samples", _rates_at_zero("tested", "feature"), *_LENGTHS).replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    """Logistic regression on characters and words (intercept penalised), fitted on train, at one half on test."""
    rows = T(spark, d).select("split", "label", F.col("length").cast("double").alias("chars"), text.word_count(F.col("text")).cast("double").alias("words"))
    return _rated_at_zero(probe.feature_models(rows, F.col("split") == "train", F.col("split") == "test", {"lengths": ["chars", "words"]}))


def _single_sql() -> str:
    """A fit of each formatting feature by itself, all fits in one recursion."""
    names = text.FEATURES
    return sql(
        "text_samples", _rates_at_zero("tested", "feature"), f"f AS ({FEATURE_SQL})",
        f"long AS (SELECT doc_id, label, unnest([{', '.join(repr(n) for n in names)}]) AS grp, unnest([{', '.join(f'{n}::DOUBLE' for n in names)}]) AS v FROM f)",
        "own AS (SELECT long.*, split FROM long JOIN (SELECT doc_id, split FROM text_samples) USING (doc_id))",
        "sd AS (SELECT grp, avg(v) AS m, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS s FROM own WHERE split = 'train' GROUP BY 1)",
        "ready AS (SELECT grp, split, label, label::DOUBLE AS y, (v - m) / s AS x1 FROM own JOIN sd USING (grp))",
        "train AS (SELECT * FROM ready WHERE split = 'train')", _newton_sql("fit", "train", 1, free=False),
        "tested AS (SELECT grp AS feature, label, round(w0 + w1 * x1, 9) AS z FROM ready JOIN (SELECT * FROM fit QUALIFY step = max(step) OVER (PARTITION BY grp)) USING (grp) WHERE split = 'test')",
    ).replace("WITH", "WITH RECURSIVE", 1)


@q("l13_single_features", _single_sql())
def _(spark, d):
    """Logistic regression on each formatting feature by itself, fitted on train, at one half on test."""
    rows = views.formatting(spark, d).withColumns(rounded(*text.FEATURES))
    split = F.col("split")
    return _rated_at_zero(probe.feature_models(rows, split == "train", split == "test", {n: [n] for n in text.FEATURES}))


@q("r30_matched_formatting")
def _(spark, d):
    """Formatting models fitted on train, scored on the length-matched part of all other rows."""
    ensure_checkpoint_dir(spark)
    rows = held(views.formatting(spark, d).withColumn("sample_id", F.col("doc_id").cast("string")))
    rest = rows.filter("split <> 'train'").select("sample_id", "label", F.col("char_count").cast("int").alias("length"))
    matched = matching.greedy_length_matches(rest, 5).select(F.explode(F.array("id0", "id1")).alias("sample_id")).withColumn("matched", F.lit(True))
    marked = rows.join(matched, "sample_id", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    sets = {"all": list(text.FEATURES), "without_counts": [n for n in text.FEATURES if n not in ("char_count", "word_count")]}
    scored = held(probe.feature_models(marked, F.col("split") == "train", F.col("matched"), sets))
    rates = metrics.metrics(scored.withColumn("pred", metrics.predicted(F.col("score"), F.lit(0.0))), ["feature"], undefined="zero")
    return metrics.auroc(scored, ["feature"]).join(rates, "feature")


@q("j5_logit", sql("samples", "SELECT sample_id, round(ln(p / (1 - p)), 9) AS z FROM (SELECT sample_id, greatest(least(score_b / 20, 1 - 1e-12), 1e-12) AS p FROM samples)"))
def _(spark, d):
    return S(spark, d).select("sample_id", F.round(fusion.logit(F.col("score_b") / 20), 9).alias("z"))


@q("j6_standardise", sql("samples", "SELECT sample_id, round((score_a - m) / s, 6) AS z FROM samples, (SELECT avg(score_a) AS m, stddev_pop(score_a) AS s FROM samples WHERE split = 'validation') WHERE split = 'test'"))
def _(spark, d):
    s = S(spark, d)
    fit = fusion.standardisation(s.filter("split = 'validation'"), ["score_a"])
    return fusion.standardised(s.filter("split = 'test'"), fit).select("sample_id", F.round("score_a", 6).alias("z"))


@q("j8_j9_feature_layers", "SELECT vec_id AS sample_id, l.layer::INTEGER AS layer, round(list_avg(embedding[l.layer * 16 + 1:l.layer * 16 + 16]::DOUBLE[]), 6) AS pooled FROM embeddings, (SELECT unnest(range(4)) AS layer) l")
def _(spark, d):
    return views.features(spark, d).select("sample_id", "layer", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x) / F.size("features"), 6).alias("pooled"))


@q("l9_f11_layer_probe")
def _(spark, d):
    """AUROC of a logistic probe on each layer (trained on four fifths), best layer first on ties."""
    rows = views.features(spark, d)
    _, scored = probe.layer_probes(rows, F.pmod(F.xxhash64("sample_id"), F.lit(5)) != 0)
    return probe.layer_table(scored)


@q("l13_g3_formatting_features_auroc")
def _(spark, d):
    """Logistic regression on each formatting feature, on all and on all but the counts,
    fitted on train: AUROC, accuracy, precision, recall and F1 on test, best first."""
    counts = ("char_count", "word_count")
    sets = {n: [n] for n in text.FEATURES} | {"formatting_plus_length": list(text.FEATURES), "surface_features_without_explicit_length": [n for n in text.FEATURES if n not in counts]}
    split = F.col("split")
    scored = held(probe.feature_models(views.formatting(spark, d), split == "train", split == "test", sets))
    rates = metrics.metrics(scored.withColumn("pred", metrics.predicted(F.col("score"), F.lit(0.0))), ["feature"], undefined="zero")
    return metrics.auroc(scored, ["feature"]).select("feature", "auroc").join(rates.select("feature", "accuracy", "precision", "recall", "f1"), "feature").orderBy(F.desc("auroc"), "feature")


@q("l10_l11_l12_fusion")
def _(spark, d):
    """Fusion of two scores and length, fitted on validation only, and what it and its average reach on test."""
    cols = ["score_a", "score_b", "log_length"]
    keep = ["sample_id", "pair_id", "label", *cols]
    s = held(S(spark, d).filter("split <> 'train'").withColumn("log_length", fusion.log_length(F.col("length"))).select("split", *keep))
    fitted, oof = fusion.fit_fusion(s.filter("split = 'validation'").select(*keep), cols)
    threshold = metrics.select_threshold(metrics.threshold_candidates(metrics.score_groups(oof, [])), [])
    test = s.filter("split = 'test'").select(*keep)
    both = fusion.apply_fusion(test, fitted).select("label", F.lit("fusion").alias("detector"), "score").unionByName(fusion.average_score(test, cols, fitted.scale).select("label", F.lit("average").alias("detector"), "score"))
    raw = fitted.model.raw_scale(fitted.scale)
    weights = spark.createDataFrame([("fusion", fitted.c, *raw.coef, raw.intercept)], "detector string, c double, " + ", ".join(f"w_{c} double" for c in cols) + ", intercept double")
    return metrics.auroc(both, ["detector"]).join(weights, "detector", "left").join(F.broadcast(threshold.select(F.col("threshold").alias("oof_threshold"))))


@q("v11_smoke_gates", f"""{sql('samples', '').replace('samples AS (SELECT p.*', 'all_samples AS (SELECT p.*')}, random AS (SELECT *, ('0x' || substr(sha256('42:' || sample_id || ':0'), 1, 8))::BIGINT AS s FROM all_samples WHERE split = 'test'),
  areas AS (SELECT (SELECT auroc FROM ({_area('s', 'random')})) AS r, (SELECT auroc FROM ({_area('length', 'random')})) AS l, (SELECT avg(CASE WHEN h > f THEN 1.0 WHEN h = f THEN 0.5 ELSE 0.0 END) FROM (SELECT max(s) FILTER (label = 1) AS h, max(s) FILTER (label = 0) AS f FROM random GROUP BY pair_id)) AS p)
  SELECT unnest(['random AUROC', 'random pair accuracy', 'length AUROC']) AS gate, unnest([round(r, 9), round(p, 9), round(l, 9)]) AS value, unnest([abs(r - 0.5) < 0.05, abs(p - 0.5) < 0.06, l > 0.5]) AS ok FROM areas""")
def _(spark, d):
    """Gates of a smoke run on test: random scores say nothing, and how far length alone goes."""
    s = S(spark, d).filter("split = 'test'").withColumn("score", text.derived_seed(42, F.col("sample_id"), F.lit(0)))
    a = metrics.auroc(s, []).select(F.col("auroc").alias("r"))
    p = metrics.pair_accuracy(metrics.pairs(s, "pair_id")).select(F.col("pair_accuracy").alias("p"))
    n = metrics.auroc(s, [], "length").select(F.col("auroc").alias("l"))
    row = a.join(F.broadcast(p)).join(F.broadcast(n))
    gate = lambda name, v, ok: F.struct(F.lit(name).alias("gate"), F.round(v, 9).alias("value"), ok.alias("ok"))
    r, p, l = (F.col(c) for c in "rpl")
    return row.select(F.explode(F.array(gate("random AUROC", r, F.abs(r - 0.5) < 0.05), gate("random pair accuracy", p, F.abs(p - 0.5) < 0.06), gate("length AUROC", l, l > 0.5))).alias("e")).select("e.*")


QUERIES, ORACLE_SQL = R.queries, R.sql
