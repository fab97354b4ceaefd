"""Queries for text functions, validation, joins, sets, reshaping and exploratory tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import eda, leakage, matching, semantic, splits, validate
from ..sources.shared import held
from . import views
from .registry import Registry, rounded

R = Registry()
q, sql = R.query, views.sql
S = views.samples
T = views.text_samples


# --- text functions -------------------------------------------------------------------
WSQL = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


@q("b1_clean_text", f"SELECT doc_id, nfc_normalize(trim(regexp_replace(text, '{WSQL}+', ' ', 'g'))) AS clean FROM documents")
def _(spark, d):
    return views.table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("clean"))


@q("b2_preprocess_record", sql("raw_pairs", "SELECT printf('P%05d', conv_id * 1000 + turn) AS pair_id, 'en' AS language, trim(regexp_replace(question, '\\s+', ' ', 'g')) AS question, trim(regexp_replace(answer, '\\s+', ' ', 'g')) AS answer FROM raw_pairs"))
def _(spark, d):
    rows = views.raw_pairs(spark, d)
    return rows.select(F.format_string("P%05d", F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.lit("en").alias("language"), text.clean(F.col("question")).alias("question"), text.clean(F.col("answer")).alias("answer"))


@q("b3_audit_normalize", f"SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '{WSQL}+', ' ', 'g')) AS norm FROM documents")
def _(spark, d):
    return views.table(spark, d, "documents").select("doc_id", text.normalized(F.col("text")).alias("norm"))


@q("b4_normalize_answer", f"SELECT doc_id, trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '{WSQL}+', ' ', 'g')) AS norm FROM documents")
def _(spark, d):
    return views.table(spark, d, "documents").select("doc_id", text.normalized_answer(F.col("text")).alias("norm"))


@q("b5_lengths", "SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[^\\s\\x0b\\x{a0}]+'))::INTEGER AS words FROM documents")
def _(spark, d):
    return views.table(spark, d, "documents").select("doc_id", text.char_length(F.col("text")).cast("long").alias("chars"), text.word_count(F.col("text")).alias("words"))


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


_PUNCT = "[!-/:-@\\[-`{-~]"
_NON_WS = WSQL.replace("[", "[^", 1)
WORDS_SQL = _n(_NON_WS + "+")
_RATIOS = {
    "digit_ratio": "\\p{Nd}", "punctuation_ratio": _PUNCT, "whitespace_ratio": WSQL, "comma_ratio": ",", "period_ratio": "[.]", "question_mark_ratio": "[?]", "exclamation_ratio": "!",
    "parenthesis_ratio": "[()]", "non_ascii_ratio": "[^\\x00-\\x7F]",
}
FEATURE_SQL = f"""SELECT doc_id, label, length(text)::DOUBLE AS char_count, {_n(_NON_WS + '+')}::DOUBLE AS word_count, round((length(text) - {_n(' ')}) / greatest({_n(_NON_WS + '+')}, 1), 9) AS avg_word_length,
  round({_n(chr(92) + 'p{Lu}')} / letters, 9) AS uppercase_ratio, round({_n(chr(92) + 'p{Ll}')} / letters, 9) AS lowercase_ratio,
  {', '.join(f"round({_n(p)} / m, 9) AS {n}" for n, p in _RATIOS.items())}, round(len(list_distinct(string_split(text, ''))) / m, 9) AS unique_char_ratio,
  CASE WHEN regexp_matches(text, '^\\p{{Lu}}') THEN 1.0 ELSE 0.0 END::DOUBLE AS starts_uppercase, CASE WHEN regexp_matches(text, '{_PUNCT}$') THEN 1.0 ELSE 0.0 END::DOUBLE AS ends_punctuation
  FROM (SELECT *, greatest(length(text), 1)::DOUBLE AS m, greatest({_n(chr(92) + 'p{L}')}, 1)::DOUBLE AS letters FROM text_samples)"""


@q("b6_formatting_features", sql("text_samples", FEATURE_SQL))
def _(spark, d):
    names = [n for n in text.FEATURES if n not in ("char_count", "word_count", "starts_uppercase", "ends_punctuation")]
    return views.formatting(spark, d).drop("split").withColumns(rounded(*names))


@q("b7_b8_ends_sentence_non_ascii", sql("text_samples", "SELECT doc_id, right(text, 1) IN ('.', ',', '!', '?', ';', ':') AS ends, regexp_matches(text, '[^\\x00-\\x7F]') AS non_ascii FROM text_samples"))
def _(spark, d):
    return T(spark, d).select("doc_id", text.ends_sentence(F.col("text")).alias("ends"), text.has_non_ascii(F.col("text")).alias("non_ascii"))


def _trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WSQL}+', ''), '{WSQL}+$', '')"


@q("b9_b10_prompts", sql("raw_pairs", f"""SELECT conv_id, turn, message, '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || 'You are a helpful assistant. Answer the question in one short, factual sentence.<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || message
  || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS prompt, 'Question: ' || {_trim('question')} AS closed_book
  FROM (SELECT *, 'Knowledge: ' || {_trim('answer')} || chr(10) || chr(10) || 'Question: ' || {_trim('question')} AS message FROM raw_pairs)"""))
def _(spark, d):
    rows = views.raw_pairs(spark, d).withColumn("message", text.user_message(F.concat(F.lit(" "), "question", F.lit("\t")), F.concat(F.lit("\n"), "answer")))
    return rows.select("conv_id", "turn", "message", text.generation_prompt(F.col("message")).alias("prompt"), text.user_message(F.col("question")).alias("closed_book"))


@q("b11_classifier_inputs", sql("raw_pairs", f"SELECT conv_id, turn, 'Question: ' || {_trim('question')} || chr(10) || 'Answer: ' || {_trim('answer')} AS segment_a, 'Knowledge: ' || {_trim('question')} AS segment_b, 'Answer: ' || {_trim('answer')} AS answer_only FROM raw_pairs"))
def _(spark, d):
    asked, said = F.concat("question", F.lit(" ")), F.concat(F.lit("\t"), "answer", F.lit(" "))
    a, b = text.classifier_inputs(said, asked, F.col("question"))
    return views.raw_pairs(spark, d).select("conv_id", "turn", a.alias("segment_a"), b.alias("segment_b"), text.classifier_inputs(said)[0].alias("answer_only"))


# a short answer of the first one or two words, and a longer one in which a denial may follow it
_SHORTS = """shorts AS (SELECT conv_id, turn, question, answer, s, CASE (conv_id + turn) % 6 WHEN 0 THEN s || ' is not so' WHEN 1 THEN upper(s) || ', isn''t it' WHEN 2 THEN s || ' not' WHEN 3 THEN s || 's are' WHEN 4 THEN s ELSE answer END AS l
  FROM (SELECT *, regexp_extract(answer, '^[^ ]+(?: [^ ]+)?') AS s FROM (SELECT conv_id, turn, question, trim(regexp_replace(answer, '\\s+', ' ', 'g')) AS answer FROM raw_pairs)))"""
_words = lambda c: f"len(regexp_extract_all({c}, '{_NON_WS}+'))"
_DENIED = "'^(((is|was|are|were|does|do|did|has|have|had|would|could|should)([ \\t\\n]+not|n''t))|not|cannot|can''t|will[ \\t\\n]+not|won''t)([^\\p{L}\\p{N}_]|$)'"


def _anchored(short: str, long: str) -> str:
    word = "regexp_matches({}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]')"
    after = f"substr({long}, length({short}) + 1)"
    return f"({short} <> '' AND {_words(short)} <= 3 AND {_words(long)} > {_words(short)} AND starts_with(lower({long}), lower({short})) AND {word.format(f'right({short}, 1)')} <> {word.format(f'substr({long}, length({short}) + 1, 1)')} AND NOT regexp_matches(ltrim(lower({after}), ' ' || chr(9) || ':,-–—'), {_DENIED}))"


def _shorts(spark, d):
    rows = views.raw_pairs(spark, d).withColumn("answer", text.collapse(F.col("answer")))
    rows = rows.withColumn("s", F.regexp_extract("answer", r"^[^ ]+(?: [^ ]+)?", 0))
    made = [F.concat("s", F.lit(" is not so")), F.concat(text.upper_by_letter(F.col("s")), F.lit(", isn't it")), F.concat("s", F.lit(" not")), F.concat("s", F.lit("s are")), F.col("s")]
    k = (F.col("conv_id") + F.col("turn")) % 6
    long = F.when(F.lit(False), F.col("s"))
    for i, m in enumerate(made):
        long = long.when(k == i, m)
    return rows.withColumn("l", long.otherwise(F.col("answer")))


@q("b12_anchored_short_answer", sql("raw_pairs", f"SELECT conv_id, turn, {_anchored('s', 'l')} AS anchored FROM shorts", _SHORTS))
def _(spark, d):
    return _shorts(spark, d).select("conv_id", "turn", text.anchored_short_answer(F.col("s"), F.col("l")).alias("anchored"))


_PROBABILITY = "(('0x' || substr(sha256({} || '|' || {}), 1, 8))::BIGINT % 1000) / 1000"
_RULES = f"CASE WHEN trim(s) = '' OR trim(l) = '' THEN false WHEN lower(s) = lower(l) OR {_anchored('s', 'l')} OR {_anchored('l', 's')} THEN true END"


@q("l5_r27_equivalence", sql("raw_pairs", f"""SELECT conv_id, turn, coalesce(rules, (sl >= 0.85 AND ls >= 0.85) OR ({_words('s')} <= 3 AND {_words('l')} > {_words('s')} AND ls >= 0.85) OR ({_words('l')} <= 3 AND {_words('s')} > {_words('l')} AND sl >= 0.85)) AS same, rules IS NULL AS asked
  FROM (SELECT *, {_RULES} AS rules, {_PROBABILITY.format('s', 'l')} AS sl, {_PROBABILITY.format('l', 's')} AS ls FROM shorts)""", _SHORTS))
def _(spark, d):
    """Rules, then entailment probabilities from a table (a hash stands for the model)."""
    from ..operators import equivalence

    pairs = _shorts(spark, d).select("conv_id", "turn", F.col("s").alias("a"), F.col("l").alias("b"))
    given = F.conv(F.substring(F.sha2(F.concat_ws("|", "premise", "hypothesis"), 256), 1, 8), 16, 10).cast("long") % 1000 / 1000
    known = equivalence.open_pairs(pairs).withColumn("probability", given)
    asked = equivalence.by_rules(F.col("a"), F.col("b")).isNull()
    return equivalence.equivalent(pairs, known).select("conv_id", "turn", "same", asked.alias("asked"))


@q("b13_derived_seed", "SELECT doc_id, ('0x' || substr(sha256('42:' || doc_id || ':3'), 1, 8))::BIGINT AS seed FROM documents")
def _(spark, d):
    return views.table(spark, d, "documents").select("doc_id", text.derived_seed(42, F.col("doc_id"), F.lit(3)).alias("seed"))


_CONFIG = {"paths": {"root": "/somewhere"}, "model": {"name": "m", "size": 3}, "run": {"seed": 42}}


@q("b14_config_hash", """SELECT substr(sha256('{"model":{"name":"m","size":3},"run":{"seed":42}}'), 1, 12) AS hash""")
def _(spark, d):
    from ..sources.io import config_hash

    return spark.createDataFrame([(config_hash(_CONFIG),)], "hash string")


@q("b14_b15_names_and_hashes", "SELECT page_id, replace(url, '/', '__') AS name, substr(sha256(url), 1, 12) AS hash FROM pages")
def _(spark, d):
    return views.table(spark, d, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"), F.substring(F.sha2("url", 256), 1, 12).alias("hash"))


@q("b16_b17_preview_unfinished", "SELECT conv_id, turn, substr(text, 1, 80) AS preview, coalesce(contains(text, 'the') AND NOT contains(text, 'that'), false) AS unfinished FROM conversations")
def _(spark, d):
    rows = views.table(spark, d, "conversations")
    return rows.select("conv_id", "turn", text.preview(F.col("text"), 80).alias("preview"), text.unfinished_thinking(F.col("text"), "the", "that").alias("unfinished"))


@q("b20_stop_token", """WITH t AS (SELECT conv_id, list(length(text) % 7 ORDER BY turn) AS ids FROM conversations GROUP BY 1), p AS (SELECT *, list_position(ids, 3) AS place FROM t)
  SELECT conv_id, (CASE WHEN place IS NULL THEN len(ids) ELSE place END)::INTEGER AS kept, place IS NULL AS truncated FROM p""")
def _(spark, d):
    rows = views.table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", (F.length("text") % 7).alias("x")))), lambda s: s["x"]).alias("ids"))
    kept, truncated = text.until_stop(F.col("ids"), [3])
    return rows.select("conv_id", F.size(kept).alias("kept"), truncated.alias("truncated"))


@q("b21_e29_token_logprobs", """WITH t AS (SELECT conv_id, list(-ln(1 + length(text)) ORDER BY turn) AS lp FROM conversations GROUP BY 1)
  SELECT conv_id, len(lp)::INTEGER AS num_tokens, round(list_sum(lp), 9) AS sum_logprob, round(list_sum(lp) / greatest(len(lp), 1), 9) AS mean_logprob FROM t""")
def _(spark, d):
    rows = views.table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", (-F.ln(1 + F.length("text"))).alias("x")))), lambda s: s["x"]).alias("lp"))
    total = F.aggregate("lp", F.lit(0.0), lambda a, x: a + x)
    return rows.select("conv_id", F.size("lp").alias("num_tokens"), F.round(total, 9).alias("sum_logprob"), F.round(total / F.greatest(F.size("lp"), F.lit(1)), 9).alias("mean_logprob"))


_EMBEDDED = "e AS (SELECT vec_id, [embedding[i * 16 + 1:i * 16 + 16]::DOUBLE[] FOR i IN range(4)] AS states, [1 + vec_id % 7, 2, 3, 4] AS ids FROM embeddings)"


@q("b19_b21_answer_logprobs", f"WITH {_EMBEDDED} SELECT vec_id, 2::INTEGER AS answer_start, 4::INTEGER AS answer_end, round(states[2][ids[2] + 1] - ln(list_sum(list_transform(states[2], lambda x: exp(x)))), 6) AS second FROM e")
def _(spark, d):
    """Spans of two prompt and two answer tokens, and the log-softmax of four steps' logits at their ids."""
    from ..functions import tokens

    rows = views.states(spark, d).withColumn("ids", F.array((1 + F.col("vec_id") % 7).cast("int"), F.lit(2), F.lit(3), F.lit(4)))
    _, start, end = tokens.answer_span(F.slice("ids", 1, 2), F.slice("ids", 3, 2), 9)
    return rows.select("vec_id", start.alias("answer_start"), end.alias("answer_end"), F.round(tokens.target_logprobs(F.col("states"), F.col("ids"))[1], 6).alias("second"))


@q("j9_r29_poolings", f"WITH {_EMBEDDED} SELECT vec_id, pooling, round(list_sum(v), 6) AS total FROM (SELECT vec_id, unnest(['tbg', 'last_answer', 'mean_answer', 'eot']) AS pooling, unnest([states[1], states[3], list_transform(range(1, 17), lambda i: (states[2][i] + states[3][i]) / 2), states[4]]) AS v FROM e)")
def _(spark, d):
    """States of four tokens, of which the second and third are the answer."""
    from ..functions import tokens

    each = F.array(*[F.struct(F.lit(p).alias("pooling"), tokens.pooled(F.col("states"), F.lit(1), F.lit(3), p).alias("v")) for p in tokens.POOLINGS])
    rows = views.states(spark, d).select("vec_id", F.explode(each).alias("e")).select("vec_id", "e.*")
    return rows.select("vec_id", "pooling", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@q("b18_token_lengths", "SELECT conv_id, turn, len(regexp_extract_all(text, '[^ ]+'))::INTEGER AS answer_length_tokens FROM conversations")
def _(spark, d):
    """Token lengths under a tokenizer that cuts at spaces."""
    from ..functions import tokens

    split = lambda texts: [list(range(len([w for w in t.split(" ") if w]))) for t in texts]
    rows = views.table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("_", "conv_id", "turn").alias("sample_id"), F.col("text").alias("answer"))
    return tokens.with_token_lengths(rows, split, "spaces").select("conv_id", "turn", "answer_length_tokens")


@q("b23_r18_efficiency", "SELECT user_id, sum(value) AS latency_s, count(*) AS n_generations, sum(value > 50)::BIGINT AS n_generated_tokens, round(sum(value > 50) / nullif(sum(value), 0), 9) AS tokens_per_s FROM events GROUP BY 1")
def _(spark, d):
    from ..functions import tokens

    stats = views.table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("wall_time_s"), F.count("*").alias("num_sequences"), F.sum((F.col("value") > 50).cast("int")).alias("new_tokens_total"), F.lit(None).cast("double").alias("peak_gpu_mem_mb"))
    rows = stats.select("user_id", *tokens.efficiency_fields()).drop("peak_gpu_mem_mb")
    return rows.withColumn("tokens_per_s", F.round(F.try_divide(F.col("n_generated_tokens").cast("double"), F.col("latency_s")), 9))


@q("b22_j7_logit_margin_log_length", sql("samples", "SELECT sample_id, round(score_a - score_b, 9) AS margin, round(ln(greatest(length, 1)), 9) AS log_length FROM samples"))
def _(spark, d):
    return S(spark, d).select("sample_id", F.round(F.col("score_a") - F.col("score_b"), 9).alias("margin"), F.round(F.ln(F.greatest("length", F.lit(1)).cast("double")), 9).alias("log_length"))


# --- validation -----------------------------------------------------------------------
def _records(spark, d):
    """Samples as detector records, some of them broken on purpose."""
    s = S(spark, d)
    n = F.col("o_orderkey")
    return s.select(
        F.when(n % 97 == 0, F.lit(" ")).otherwise(F.col("sample_id")).alias("sample_id"), F.when(n % 89 == 0, "dev").otherwise(F.col("split")).alias("split"), F.lit("price").alias("detector"),
        F.when(n % 83 == 0, "a b").otherwise(F.lit("v1")).alias("variant"), F.when(n % 79 == 0, F.lit(float("nan"))).otherwise(F.col("score_a")).alias("score"), F.lit("abc").alias("config_hash"), F.lit("p1").alias("prompt_version"),
        F.when(n % 73 == 0, 2).otherwise(F.col("label")).alias("pred_label"), F.when(n % 71 == 0, -1.0).otherwise(F.col("score_b")).alias("latency_s"), F.lit(None).cast("double").alias("peak_gpu_mem_mb"),
        F.col("score_b").cast("long").alias("n_generations"), F.lit(None).cast("long").alias("n_generated_tokens"),
    )


@q("v1_v3_record_violations", """SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN o_orderkey % 97 = 0 THEN 'sample_id' END, CASE WHEN o_orderkey % 89 = 0 THEN 'split' END, CASE WHEN o_orderkey % 83 = 0 THEN 'variant' END,
  CASE WHEN o_orderkey % 79 = 0 THEN 'score' END, CASE WHEN o_orderkey % 73 = 0 THEN 'pred_label' END, CASE WHEN o_orderkey % 71 = 0 THEN 'latency_s' END], lambda x: x IS NOT NULL)) AS rule FROM orders) GROUP BY 1""")
def _(spark, d):
    return validate.record_violations(_records(spark, d)).groupBy("rule").agg(F.count("*").alias("n"))


@q("v4_pair_violations", sql("samples", "SELECT pair_id, count(*) AS n, count(*) FILTER (label = 1)::BIGINT AS n1 FROM samples WHERE o_orderkey % 101 <> 0 GROUP BY 1 HAVING count(*) <> 2"))
def _(spark, d):
    bad = splits.pair_violations(S(spark, d).filter("o_orderkey % 101 <> 0"))
    return bad.select("pair_id", F.col("n"), F.col("n1").cast("long").alias("n1"))


# a controlled set broken on purpose: a row too few, a reused id, a far length and a changed text
_BROKEN = """m AS (SELECT doc_id, label, text, length, row_number() OVER (PARTITION BY label, length ORDER BY doc_id) AS k FROM text_samples),
  joint AS (SELECT 'd0_' || a.length || '_' || a.k AS match_id, a.doc_id AS i0, b.doc_id AS i1, a.text AS t0, b.text AS t1 FROM m a JOIN m b ON a.label = 0 AND b.label = 1 AND a.length = b.length AND a.k = b.k),
  r AS (SELECT match_id, i0::VARCHAR AS sample_id, 0 AS label, t0 AS answer FROM joint UNION ALL SELECT match_id, i1::VARCHAR, 1, t1 || CASE WHEN i1 % 3 = 0 THEN 'xx' ELSE '' END FROM joint),
  own AS (SELECT *, length(answer) AS n FROM r WHERE NOT (label = 1 AND sample_id::BIGINT % 5 = 0)),
  g AS (SELECT match_id, count(*) AS n, count(DISTINCT label) AS labels, max(n) - min(n) AS gap FROM own GROUP BY 1)"""


@q("v6_artifact_checks", sql("text_samples", """SELECT name, n = 0 AS ok, n AS n_problems FROM (SELECT 'row count' AS name, (SELECT count(*) <> 40 FROM own)::BIGINT AS n UNION ALL SELECT 'class balance', (SELECT 2 * count(*) FILTER (label = 0) <> count(*) FROM own)::BIGINT
  UNION ALL SELECT 'sample_id uniqueness', (SELECT count(*) FROM (SELECT sample_id FROM own GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'no sample reuse', (SELECT count(*) FROM (SELECT sample_id FROM own GROUP BY 1 HAVING count(*) > 1))
  UNION ALL SELECT 'match_id structure', (SELECT count(*) FROM g WHERE n <> 2) + (SELECT 2 * count(*) <> 40 FROM g)::BIGINT UNION ALL SELECT 'one of each label per match', (SELECT count(*) FROM g WHERE n <> 2 OR labels <> 2)
  UNION ALL SELECT 'length tolerance', (SELECT count(*) FROM g WHERE gap > 1) UNION ALL SELECT 'source membership', 0 UNION ALL SELECT 'content preservation', (SELECT count(*) FROM own WHERE label = 1 AND sample_id::BIGINT % 3 = 0))""", _BROKEN))
def _(spark, d):
    """The nine checks on a controlled set that was broken on purpose."""
    from pyspark.sql import Window

    t = T(spark, d).select(F.col("doc_id").cast("string").alias("sample_id"), "doc_id", "label", F.col("text").alias("answer"), "length")
    w = Window.partitionBy("label", "length").orderBy("doc_id")
    named = t.withColumn("match_id", F.concat_ws("_", F.lit("d0"), "length", F.row_number().over(w)))
    whole = named.groupBy("match_id").count().filter("count = 2").select("match_id")
    far = (F.col("label") == 1) & (F.col("doc_id") % 3 == 0)
    broken = named.join(whole, "match_id", "left_semi").filter("not (label = 1 and doc_id % 5 = 0)").withColumn("answer", F.when(far, F.concat("answer", F.lit("xx"))).otherwise(F.col("answer")))
    return matching.artefact_checks(broken.select("match_id", "sample_id", "label", "answer"), t, 1, 40)


@q("c1_valid_raw", "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND regexp_matches(text, '[^\\s]')")
def _(spark, d):
    return validate.valid_raw(views.table(spark, d, "conversations"), ("text",)).select("conv_id", "turn")


@q("c2_sample_rules", """SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN o_orderkey % 11 = 0 THEN 'label' END, CASE WHEN o_orderkey % 13 = 0 THEN 'answer_length_chars' END, CASE WHEN o_orderkey % 17 = 0 THEN 'question' END, CASE WHEN o_orderkey % 19 = 0 THEN 'split' END], lambda x: x IS NOT NULL)) AS rule FROM orders) GROUP BY 1""")
def _(spark, d):
    """Samples broken on purpose, by rule."""
    n = F.col("o_orderkey")
    rows = S(spark, d).withColumns({
        "answer": F.col("o_orderpriority"), "answer_length_chars": F.col("length") + (n % 13 == 0).cast("int"), "question": F.when(n % 17 == 0, F.lit("\u00a0")).otherwise(F.lit("q")), "knowledge": F.lit("k"),
        "label": F.when(n % 11 == 0, 2).otherwise(F.col("label")), "split": F.when(n % 19 == 0, F.lit(None)).otherwise(F.col("split")),
    })
    return validate.violations(rows, validate.sample_rules()).groupBy("rule").agg(F.count("*").alias("n"))


@q("c1_reject_counts", "SELECT count(*) FILTER (ok) AS n_valid, count(*) FILTER (NOT ok) AS n_rejected FROM (SELECT text IS NOT NULL AND regexp_matches(text, '[^\\s]') AND turn % 3 <> 0 AS ok FROM conversations)")
def _(spark, d):
    rows = views.table(spark, d, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 0, F.lit(" \t")).otherwise(F.col("text")))
    return validate.reject_counts(rows, ("text",))


# --- joins ----------------------------------------------------------------------------
@q("d2_coverage", sql("samples", "SELECT sample_id, CASE WHEN o_orderkey % 100 = 7 THEN 'missing' ELSE 'extra' END AS problem FROM samples WHERE o_orderkey % 100 IN (7, 9)"))
def _(spark, d):
    s = held(S(spark, d).select("sample_id", "o_orderkey"))  # both sides read it
    return leakage.coverage(s.filter("o_orderkey % 100 <> 9"), s.filter("o_orderkey % 100 <> 7"))


@q("d1_d5_align", sql("samples", "SELECT split, count(*) AS n, round(sum(score_a), 2) AS total FROM samples GROUP BY 1"))
def _(spark, d):
    s = held(S(spark, d).select("sample_id", "split", "label", "score_a"))  # read by both sides, to check and to join
    joined = leakage.align(s.select("sample_id", "split", "label"), s.select("sample_id", "score_a"))
    return joined.groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("score_a"), 2).alias("total"))


@q("d6_d7_c6_optional_inputs", sql("samples", "SELECT count(*) AS n, count(*) FILTER (o_orderkey % 3 <> 0) AS n_a, count(*) FILTER (o_orderkey % 5 <> 0) AS n_b, count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0) AS n_both FROM samples"))
def _(spark, d):
    s = S(spark, d)
    a, b = s.filter("o_orderkey % 3 <> 0").select("sample_id", "score_a"), s.filter("o_orderkey % 5 <> 0").select("sample_id", "score_b")
    both = leakage.with_optional(leakage.with_optional(s.select("sample_id"), a, score="score_a"), b, score="score_b")
    return both.agg(F.count("*").alias("n"), F.count_if("has_score_a").alias("n_a"), F.count_if("has_score_b").alias("n_b"), F.count_if(F.col("has_score_a") & F.col("has_score_b")).alias("n_both"))


@q("d8_seen_in_train", sql("docs", """SELECT d.doc_id, t.norm IS NOT NULL AS seen, coalesce(CASE WHEN d.label = 1 THEN t.has0 ELSE t.has1 END, false) AS seen_opposite FROM docs d
  LEFT JOIN (SELECT norm, bool_or(label = 0) AS has0, bool_or(label = 1) AS has1 FROM docs WHERE split = 'train' GROUP BY 1) t ON d.norm = t.norm WHERE d.split = 'test'"""))
def _(spark, d):
    docs = views.documents_split(spark, d)
    return leakage.seen_in_train(docs.filter("split = 'test'"), docs.filter("split = 'train'"), "norm").select("doc_id", "seen", "seen_opposite")


@q("c5_r19_exclude_leaked_pairs", sql("docs", "SELECT doc_id FROM docs WHERE split = 'test' AND pair_id NOT IN (SELECT pair_id FROM docs WHERE split = 'test' AND norm IN (SELECT norm FROM docs WHERE split = 'train'))"))
def _(spark, d):
    docs = views.documents_split(spark, d)
    return leakage.exclude_pairs(docs.filter("split = 'test'"), docs.filter("split = 'train'"), ["norm"]).select("doc_id")


@q("r19_report_without_seen", sql("docs", "SELECT 'all' AS scope, count(*) AS n, count(DISTINCT pair_id) AS n_pairs FROM docs WHERE split = 'test' UNION ALL SELECT 'unseen', count(*), count(DISTINCT pair_id) FROM docs WHERE split = 'test' AND pair_id NOT IN (SELECT pair_id FROM docs WHERE split = 'test' AND norm IN (SELECT norm FROM docs WHERE split = 'train'))"))
def _(spark, d):
    """Every report stands on all of test and on test without what train has seen."""
    docs = views.documents_split(spark, d)
    return leakage.scopes(docs.filter("split = 'test'"), docs.filter("split = 'train'"), {"unseen": ["norm"]}).groupBy("scope").agg(F.count("*").alias("n"), F.countDistinct("pair_id").alias("n_pairs"))


@q("c6_covered_by_all", sql("samples", "SELECT count(*) AS n, count(DISTINCT pair_id) AS n_pairs FROM samples WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0"))
def _(spark, d):
    s = S(spark, d)
    found = leakage.covered_by_all(s, [s.filter("o_orderkey % 3 <> 0"), s.filter("o_orderkey % 5 <> 0")], least_pairs=100)
    return found.agg(F.count("*").alias("n"), F.countDistinct("pair_id").alias("n_pairs"))


@q("d13_feature_mismatches", "SELECT vec_id AS sample_id, CASE WHEN vec_id % 50 = 0 THEN 'missing' ELSE 'label' END AS problem FROM embeddings WHERE vec_id % 50 = 0 OR vec_id % 70 = 0")
def _(spark, d):
    """Features without some ids and with some labels turned round."""
    wanted = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") >= 5).cast("int").alias("label"))
    own = wanted.filter("sample_id % 50 <> 0").withColumn("label", F.when(F.col("sample_id") % 70 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    return leakage.label_mismatches(own, wanted)


@q("f12_match_ids", sql("text_samples", "SELECT 'd0_m' || lpad((dense_rank() OVER (ORDER BY i0) - 1)::VARCHAR, 4, '0') AS match_id, i0, i1 FROM (SELECT a.doc_id::VARCHAR AS i0, b.doc_id::VARCHAR AS i1 FROM m a JOIN m b ON a.label = 0 AND b.label = 1 AND a.length = b.length AND a.k = b.k)", "m AS (SELECT label, doc_id, length, row_number() OVER (PARTITION BY label, length ORDER BY doc_id::VARCHAR) AS k FROM text_samples)"))
def _(spark, d):
    """Matches of equal length, numbered by factual id."""
    rows = T(spark, d).select(F.col("doc_id").cast("string").alias("sample_id"), "label", "length")
    named = matching.matched_rows(matching.optimal_matches(rows, 0), rows, 0)
    return named.groupBy("match_id").agg(F.max(F.when(F.col("label") == 0, F.col("sample_id"))).alias("i0"), F.max(F.when(F.col("label") == 1, F.col("sample_id"))).alias("i1"))


@q("d14_resume", sql("plain", "SELECT sample_id FROM plain WHERE o_orderkey % 4 <> 0"))
def _(spark, d):
    s = views.plain_samples(spark, d)
    return leakage.not_done(s, s.filter("o_orderkey % 4 = 0"), "sample_id").select("sample_id")


def _test_texts(spark, d):
    return T(spark, d).filter("split = 'test'").select(F.col("doc_id").cast("string").alias("sample_id"), "label", "length")


@q("d9_caliper_edges", sql("text_samples", "SELECT a.doc_id::VARCHAR AS id0, b.doc_id::VARCHAR AS id1, abs(a.length - b.length)::INTEGER AS gap FROM text_samples a JOIN text_samples b ON a.label = 0 AND b.label = 1 AND abs(a.length - b.length) <= 5"))
def _(spark, d):
    return matching.caliper_edges(T(spark, d).select(F.col("doc_id").cast("string").alias("sample_id"), "label", "length"), 5)


@q("d10_e20_r20_optimal_matches")
def _(spark, d):
    rows = T(spark, d).select(F.col("doc_id").cast("string").alias("sample_id"), "label", "length", text.word_count(F.col("text")).alias("words"))
    out = None
    for delta in (1, 3, 5, 10, 15):
        one = matching.match_summary(matching.optimal_matches(rows, delta), rows).withColumn("delta", F.lit(delta))
        out = one if out is None else out.unionByName(one)
    return out


@q("d9_caliper_lengths", sql("text_samples", "SELECT l0, l1, abs(l0 - l1)::INTEGER AS gap, n0, n1 FROM (SELECT length AS l0, count(*) AS n0 FROM text_samples WHERE label = 0 GROUP BY 1) JOIN (SELECT length AS l1, count(*) AS n1 FROM text_samples WHERE label = 1 GROUP BY 1) ON abs(l0 - l1) <= 5"))
def _(spark, d):
    """All edges of D9 in folded form."""
    return matching.caliper_lengths(T(spark, d), 5)


#: The plain table of the best matches of prefixes, a row of it for each factual row; a match outweighs all gaps.
_OPTIMAL = sql("text_samples", """SELECT delta, (best[-1] + 999999) // 1000000 AS n_matches, (best[-1] + 999999) // 1000000 * 1000000 - best[-1] AS total_gap FROM r QUALIFY k = max(k) OVER (PARTITION BY delta)""",
  "f AS (SELECT length AS n, row_number() OVER (ORDER BY length) AS k FROM text_samples WHERE label = 0)",
  "h AS (SELECT coalesce(list(length ORDER BY length), []) AS ns FROM text_samples WHERE label = 1)",
  """r AS (SELECT unnest([1, 3, 5])::INTEGER AS delta, 0::BIGINT AS k, ns, list_transform(range(len(ns) + 1), lambda i: 0::BIGINT) AS best FROM h UNION ALL
    SELECT delta, k, ns, list_transform(range(1, len(can) + 1), lambda j: list_max(can[1:j])) FROM (SELECT delta, f.k, ns, list_transform(range(1, len(ns) + 2), lambda j: greatest(best[j], CASE WHEN j > 1 AND abs(ns[j - 1] - f.n) <= delta THEN best[j - 1] + 1000000 - abs(ns[j - 1] - f.n) ELSE 0 END)) AS can FROM r JOIN f ON f.k = r.k + 1))""").replace("WITH", "WITH RECURSIVE", 1)


@q("d10_matches_and_total_gap", _OPTIMAL)
def _(spark, d):
    """How many matches the best one-to-one matching has, and their total gap."""
    out = None
    for delta in (1, 3, 5):
        found = matching.optimal_matches(T(spark, d).select(F.col("doc_id").cast("string").alias("sample_id"), "label", "length"), delta)
        one = found.agg(F.lit(delta).alias("delta"), F.count("*").alias("n_matches"), F.coalesce(F.sum("gap"), F.lit(0)).cast("long").alias("total_gap"))
        out = one if out is None else out.unionByName(one)
    return out


_GREEDY = """WITH RECURSIVE x AS (SELECT doc_id::VARCHAR AS id, (1 - quality)::INTEGER AS label, length(text) AS n FROM documents JOIN labels USING (doc_id)),
  e AS (SELECT *, row_number() OVER (ORDER BY gap, id0, id1) AS k FROM (SELECT a.id AS id0, b.id AS id1, abs(a.n - b.n)::INTEGER AS gap FROM x a JOIN x b ON a.label = 0 AND b.label = 1 AND abs(a.n - b.n) <= 5)),
  r AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS used, false AS taken UNION ALL
    SELECT e.k, CASE WHEN list_has_any(r.used, ['0' || e.id0, '1' || e.id1]) THEN r.used ELSE list_concat(r.used, ['0' || e.id0, '1' || e.id1]) END, NOT list_has_any(r.used, ['0' || e.id0, '1' || e.id1]) FROM r JOIN e ON e.k = r.k + 1)
  SELECT id0, id1, gap FROM r JOIN e USING (k) WHERE taken"""


@q("d11_greedy_matches", _GREEDY)
def _(spark, d):
    from ..sources.shared import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return matching.greedy_length_matches(T(spark, d).select(F.col("doc_id").cast("string").alias("sample_id"), "label", "length"), 5)


_NEAREST = sql("text_samples", """SELECT id0, id1, gap FROM r WHERE id1 IS NOT NULL""",
  "f AS (SELECT doc_id::VARCHAR AS id, length AS n, row_number() OVER (ORDER BY doc_id::VARCHAR) AS k FROM text_samples WHERE split = 'test' AND label = 0)",
  "h AS (SELECT list({'id': doc_id::VARCHAR, 'n': length} ORDER BY doc_id::VARCHAR) AS free FROM text_samples WHERE split = 'test' AND label = 1)",
  """r AS (SELECT 0::BIGINT AS k, free, NULL::VARCHAR AS id0, NULL::VARCHAR AS id1, NULL::INTEGER AS gap FROM h UNION ALL
    SELECT k, list_filter(free, lambda x: x.id <> best.id), id, best.id, abs(best.n - n)::INTEGER FROM (SELECT f.k, r.free, f.id, f.n, list_sort(list_transform(r.free, lambda x: {'d': abs(x.n - f.n), 'id': x.id, 'n': x.n}))[1] AS best FROM r JOIN f ON f.k = r.k + 1 WHERE len(r.free) > 0))""").replace("WITH", "WITH RECURSIVE", 1)


@q("d12_nearest_greedy", _NEAREST)
def _(spark, d):
    return matching.nearest_greedy(_test_texts(spark, d))


# --- sets, splits, reshaping ------------------------------------------------------------
@q("j2_split_pairs", sql("samples", "SELECT split, count(DISTINCT pair_id) AS n_pairs, min(pair_id) AS first_pair, max(pair_id) AS last_pair FROM samples GROUP BY 1"))
def _(spark, d):
    pairs = splits.split_pairs(views.plain_samples(spark, d), "pair_id", views.SEED)
    return pairs.groupBy("split").agg(F.count("*").alias("n_pairs"), F.min("pair_id").alias("first_pair"), F.max("pair_id").alias("last_pair"))


@q("j1_r1_expand_pairs", sql("raw_pairs", """SELECT printf('S%06d_%d', conv_id * 1000 + turn, y) AS sample_id, y::INTEGER AS label, CASE y WHEN 0 THEN answer ELSE question END AS answer,
  length(CASE y WHEN 0 THEN answer ELSE question END) AS answer_length_chars FROM raw_pairs CROSS JOIN (VALUES (0), (1)) v(y)"""))
def _(spark, d):
    rows = views.raw_pairs(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_no"), F.col("answer").alias("right_answer"), F.col("question").alias("hallucinated_answer"))
    return splits.expand_pairs(rows).select("sample_id", "label", "answer", F.col("answer_length_chars").cast("long").alias("answer_length_chars"))


@q("j3_grouped_folds", sql("samples", """SELECT fold, count(*) AS n, count(DISTINCT pair_id) AS n_pairs FROM samples JOIN (SELECT pair_id, ((row_number() OVER (ORDER BY sha256('42:' || pair_id), pair_id) - 1) % 5)::INTEGER AS fold FROM (SELECT DISTINCT pair_id FROM samples WHERE split = 'validation')) f USING (pair_id) WHERE split = 'validation' GROUP BY 1"""))
def _(spark, d):
    rows = splits.grouped_folds(S(spark, d).filter("split = 'validation'"), "pair_id", 5, 42)
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("pair_id").alias("n_pairs"))


@q("a15_manifest", sql("samples", "SELECT split, count(*) AS n_rows, count(DISTINCT pair_id) AS n_pairs, count(*) FILTER (label = 1) AS n_pos FROM samples GROUP BY 1"))
def _(spark, d):
    return splits.manifest_summary(S(spark, d)).drop("content_hash")


@q("h1_h2_h3_e22_split_overlap", sql("docs", "SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_shared FROM (SELECT DISTINCT norm, split FROM docs) a JOIN (SELECT DISTINCT norm, split FROM docs) b ON a.norm = b.norm AND a.split < b.split GROUP BY 1, 2"))
def _(spark, d):
    return splits.split_overlap(views.documents_split(spark, d), ["norm"])


@q("h5_compare_manifests", sql("samples", """SELECT split, pair_id, split_part(sample_id, '_', 1) AS stem, 'old' AS only_in FROM samples WHERE label = 0 AND o_orderkey % 1000 = 0
  UNION ALL SELECT 'moved', pair_id, split_part(sample_id, '_', 1), 'new' FROM samples WHERE label = 0 AND o_orderkey % 1000 = 0"""))
def _(spark, d):
    old = held(splits.manifest(S(spark, d)))  # both sides read it
    pair = F.substring("pair_id", 2, 20).cast("long")
    return splits.compare_manifests(old, old.withColumn("split", F.when(pair % 500 == 0, "moved").otherwise(F.col("split"))))


@q("h5_order_differences", sql("samples", "SELECT split, pair_id, split_part(sample_id, '_', 1) AS stem, 'order' AS only_in FROM samples WHERE label = 0 AND split = 'test' AND pair_id IN (SELECT min(pair_id) FROM samples WHERE split = 'test' UNION SELECT max(pair_id) FROM samples WHERE split = 'test')"))
def _(spark, d):
    """Two manifests of the same members, of which the pairs of test with the first and the last id changed places."""
    k = F.floor(F.col("o_orderkey") / 2)
    s = held(S(spark, d).select("sample_id", "pair_id", "split", "o_orderkey", k.alias("k")))
    pair = F.struct("pair_id", "k")  # ids are texts: P100000 comes before P99999
    ends = s.filter("split = 'test'").agg(F.min(pair).alias("_a"), F.max(pair).alias("_b")).select(F.col("_a.k").alias("_a"), F.col("_b.k").alias("_b"))
    place = F.when(F.col("split") != "test", F.col("k")).when(F.col("k") == F.col("_a"), F.col("_b")).when(F.col("k") == F.col("_b"), F.col("_a")).otherwise(F.col("k"))
    return splits.compare_manifests(splits.manifest(s, "o_orderkey"), splits.manifest(s.join(F.broadcast(ends)).withColumn("at", place), "at"))


@q("h6_f13_distinct_first", "SELECT source, min(doc_id) AS first_id FROM documents GROUP BY 1")
def _(spark, d):
    return views.table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("first_id"))


@q("a21_row_hashes", "SELECT source, count(*) AS n, sum(('0x' || substr(sha256(doc_id || ':' || text), 1, 8))::BIGINT)::BIGINT AS hash_sum FROM documents GROUP BY 1")
def _(spark, d):
    rows = views.table(spark, d, "documents")
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text")), 256), 1, 8), 16, 10).cast("long")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(h).alias("hash_sum"))


# --- exploratory tables -----------------------------------------------------------------
@q("e12_length_stats", sql("text_samples", "SELECT label, count(*) AS n, round(avg(length), 6) AS mean, round(coalesce(stddev_samp(length), 0.0), 6) AS std, min(length) AS min, median(length)::DOUBLE AS median, max(length) AS max FROM text_samples GROUP BY 1"))
def _(spark, d):
    out = eda.length_stats(T(spark, d).withColumn("length", F.col("length").cast("long")), "length", ["label"])
    return out.withColumns(rounded("mean", "std", digits=6))


@q("e13_formatting_summary", sql("text_samples", """SELECT label, count(*) AS n, round(100 * avg((right(text, 1) IN ('.', ',', '!', '?', ';', ':'))::INTEGER), 6) AS pct_ends_sentence, round(100 * avg(regexp_matches(text, '[^\\x00-\\x7F]')::INTEGER), 6) AS pct_non_ascii,
  round(avg(length), 6) AS mean_chars, median(length)::DOUBLE AS median_chars, round(avg(len(regexp_extract_all(text, '[^\\s]+'))), 6) AS mean_words, median(len(regexp_extract_all(text, '[^\\s]+')))::DOUBLE AS median_words FROM text_samples GROUP BY 1"""))
def _(spark, d):
    return eda.formatting_summary(T(spark, d), "text", "label").withColumns(rounded("pct_ends_sentence", "pct_non_ascii", "mean_chars", "mean_words", digits=6))


@q("e14_class_distribution", sql("samples", "SELECT split, label, n, round(100.0 * n / sum(n) OVER (PARTITION BY split), 6) AS pct FROM (SELECT split, label, count(*) AS n FROM samples GROUP BY GROUPING SETS ((split, label), (label)))"))
def _(spark, d):
    return eda.class_distribution(S(spark, d)).withColumns(rounded("pct", digits=6))


@q("e15_e16_missing_blank", """SELECT 'text' AS "column", count(*) FILTER (text IS NULL) AS n_missing, round(100.0 * count(*) FILTER (text IS NULL) / count(*), 6) AS pct_missing, count(*) FILTER (NOT regexp_matches(text, '[^\\s]')) AS n_blank FROM documents
  UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL), round(100.0 * count(*) FILTER (lang IS NULL) / count(*), 6), count(*) FILTER (NOT regexp_matches(lang, '[^\\s]')) FROM documents""")
def _(spark, d):
    docs = views.table(spark, d, "documents")
    return eda.missing(docs, ["text", "lang"]).join(eda.blanks(docs, ["text", "lang"]), "column").withColumn("pct_missing", F.round("pct_missing", 6))


@q("e17_e18_duplicates", sql("docs", "SELECT count(*) FILTER (n > 1) AS n_groups, sum(n - 1)::BIGINT AS n_extra FROM (SELECT norm, count(*) AS n FROM docs GROUP BY 1)"))
def _(spark, d):
    return eda.duplicates(views.documents_split(spark, d), ["norm"])


@q("e19_describe", "SELECT count(n_chars) AS count, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS min, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS q50, quantile_cont(n_chars, 0.75) AS q75, max(n_chars) AS max FROM documents")
def _(spark, d):
    return eda.describe(views.table(spark, d, "documents"), "n_chars").withColumns(rounded("mean", "std", digits=6))


@q("g4_extremes", "SELECT arg_min(doc_id, (n_chars, doc_id)) AS least, arg_min(doc_id, (-n_chars, doc_id)) AS greatest FROM documents")
def _(spark, d):
    return eda.extremes(views.table(spark, d, "documents"), "n_chars", "doc_id")


@q("g5_first_examples", sql("text_samples", "SELECT label, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS r FROM text_samples) WHERE r <= 5"))
def _(spark, d):
    return eda.first_of_each(T(spark, d), "label", "doc_id").select("label", "doc_id")


@q("g2_g6_first_pairs", sql("plain", "SELECT pair_id, sample_id FROM plain WHERE pair_id IN (SELECT DISTINCT pair_id FROM plain ORDER BY 1 LIMIT 20)"))
def _(spark, d):
    s = views.plain_samples(spark, d)
    return s.join(s.select("pair_id").distinct().orderBy("pair_id").limit(20), "pair_id", "left_semi").select("pair_id", "sample_id")


@q("f15_histograms", "SELECT floor(4 * log10(n_chars))::INTEGER AS bin, count(*) AS n FROM documents WHERE n_chars >= 1 GROUP BY 1")
def _(spark, d):
    return eda.log_histogram(views.table(spark, d, "documents"), "n_chars")


@q("f15_fixed_bins_and_ecdf", "SELECT bin, n, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 9) AS ecdf FROM (SELECT least(greatest(floor(n_chars / 500) + 1, 1), 10)::INTEGER AS bin, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY 1)")
def _(spark, d):
    return eda.ecdf(eda.histogram(views.table(spark, d, "documents").filter("n_chars is not null"), "n_chars", 0, 5000, 10)).withColumns(rounded("ecdf"))


@q("f14_running_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS running FROM events")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return views.table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("running"))


# --- semantic clusters ------------------------------------------------------------------
_GROUP_SHARES = "e AS (SELECT user_id, group_no, list_transform(list_distinct(answers), lambda a: len(list_filter(answers, lambda x: x = a)) / len(answers)) AS p FROM generation_groups)"
_ENTROPY = sql("generation_groups", "SELECT user_id, group_no, len(p)::INTEGER AS clusters, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 9) + 0.0 AS entropy, round(CASE WHEN len(p) <= 1 THEN 0.0 ELSE -list_sum(list_transform(p, lambda x: x * ln(x))) / ln(len(p)) END, 9) + 0.0 AS normalized FROM e", _GROUP_SHARES)
_FIRST_FIT = sql("generation_groups", "SELECT user_id, group_no, list_transform(answers, lambda a: list_position(list_filter(answers, lambda x, i: list_position(answers, x) = i), a) - 1)::INTEGER[] AS ids FROM generation_groups")
_CANDIDATE = sql("generation_groups", "SELECT user_id, group_no, CASE WHEN complete THEN len(list_filter(answers, lambda x: x = candidate)) / len(answers) END AS probability, CASE WHEN complete THEN 1 - len(list_filter(answers, lambda x: x = candidate)) / len(answers) END AS score, CASE WHEN complete THEN list_contains(answers, candidate) END AS matched, CASE WHEN complete THEN len(p)::INTEGER END AS num_clusters, CASE WHEN complete THEN round(-list_sum(list_transform(p, lambda x: x * ln(x))), 9) + 0.0 END AS global_entropy FROM generation_groups JOIN e USING (user_id, group_no)", _GROUP_SHARES)


@q("e23_e24_e25_entropy", _ENTROPY)
@q("e23_e24_e25_entropy_all_rows", _ENTROPY)
def _(spark, d):
    ids = F.col("ids")
    rows = views.generation_groups(spark, d, normal=True).withColumn("ids", semantic.first_fit(F.col("answers"), lambda a, b: a == b))
    out = rows.select("user_id", "group_no", F.size(F.array_distinct(ids)).alias("clusters"), semantic.entropy(ids).alias("entropy"), semantic.normalized_entropy(ids).alias("normalized"))
    return out.withColumns(rounded("entropy", "normalized"))


@q("l3_first_fit_clusters", _FIRST_FIT)
@q("l3_first_fit_clusters_all_rows", _FIRST_FIT)
def _(spark, d):
    return views.generation_groups(spark, d).select("user_id", "group_no", semantic.first_fit(F.col("answers"), lambda a, b: a == b).alias("ids"))


@q("l4_l6_candidate_score", _CANDIDATE)
@q("l4_l6_candidate_score_all_rows", _CANDIDATE)
def _(spark, d):
    """Null where a last short group has no candidate."""
    some = F.coalesce("candidate", F.lit("none"))  # a blank candidate is an error
    parts = semantic.candidate_score(F.when(F.col("complete"), F.col("answers")).otherwise(F.array(F.lit("none"))), some, lambda a, b: a == b)
    names = ("probability", "score", "matched", "num_clusters", "global_entropy")
    return views.generation_groups(spark, d).select("user_id", "group_no", *[F.when(F.col("complete"), parts[n]).alias(n) for n in names]).withColumns(rounded("global_entropy"))


#: The candidate of a last short group is its last answer.
_EVENT_PAIRS = """own AS (SELECT user_id || '.' || group_no AS pair_id, answers, y, CASE y WHEN 0 THEN coalesce(candidate, answers[-1]) ELSE 'other' END AS answer FROM generation_groups, (VALUES (0), (1)) s(y)),
  shares AS (SELECT *, list_transform(list_distinct(answers), lambda a: len(list_filter(answers, lambda x: x = a)) / len(answers)) AS p FROM own)"""


@q("l6_l7_d15_entropy_records", sql("generation_groups", "SELECT pair_id || '_' || y AS sample_id, 'se_candidate' AS detector, round(1 - len(list_filter(answers, lambda x: x = answer)) / len(answers), 9) AS score, pair_id, len(p)::INTEGER AS num_clusters FROM shares UNION ALL SELECT pair_id || '_' || y, 'se_global', round(-list_sum(list_transform(p, lambda x: x * ln(x))), 9) + 0.0, pair_id, len(p)::INTEGER FROM shares", _EVENT_PAIRS))
def _(spark, d):
    """Records of both entropy detectors: a group's generations are shared by two candidates, and rescoring gives the same again."""
    from ..operators import records

    g = views.generation_groups(spark, d).withColumn("pair_id", F.concat_ws(".", "user_id", "group_no"))
    own = F.coalesce("candidate", F.element_at("answers", -1))
    two = F.explode(F.array(F.struct(F.lit(0).alias("y"), own.alias("answer")), F.struct(F.lit(1).alias("y"), F.lit("other").alias("answer")))).alias("e")
    samples = g.select("pair_id", two).select(F.concat_ws("_", "pair_id", "e.y").alias("sample_id"), "pair_id", "e.answer")
    meta = {"split": "validation", "variant": "normalized", "config_hash": "c", "prompt_version": "v1"}
    first = records.entropy_records(records.candidates(g.select("pair_id", "answers"), samples), meta)
    saved = g.select("pair_id", "answers", F.lit("c").alias("config_hash"), F.lit("v1").alias("prompt_version"))
    again = records.rescored(saved, samples, first, "c", "v1", "again")
    extra = lambda k: F.get_json_object("extra", f"$.{k}")
    return again.select("sample_id", "detector", F.round("score", 9).alias("score"), extra("pair_id").alias("pair_id"), extra("num_clusters").cast("int").alias("num_clusters"))


# --- rank statistics ----------------------------------------------------------------------
@q("f1_average_rank", sql("samples", "SELECT sample_id, rank() OVER (ORDER BY score_b) + (count(*) OVER (PARTITION BY score_b) - 1) / 2 AS rank FROM samples"))
def _(spark, d):
    return stats.average_rank(S(spark, d).select("sample_id", "score_b"), "score_b").select("sample_id", "rank")


@q("f2_e28_spearman_pearson", sql("samples", "SELECT round(corr(ra, rb), 9) AS spearman, round(any_value(p), 9) AS pearson FROM (SELECT corr(score_a, score_b) OVER () AS p, rank() OVER (ORDER BY score_a) + (count(*) OVER (PARTITION BY score_a) - 1) / 2 AS ra, rank() OVER (ORDER BY score_b) + (count(*) OVER (PARTITION BY score_b) - 1) / 2 AS rb FROM samples)"))
def _(spark, d):
    s = S(spark, d).select("score_a", "score_b")
    pearson = s.agg(F.round(stats.guarded_corr(F.col("score_a"), F.col("score_b")), 9).alias("pearson"))
    return stats.spearman(s, "score_a", "score_b").select(F.round("spearman", 9).alias("spearman")).join(F.broadcast(pearson))


@q("e21_ks_statistic", sql("text_samples", "SELECT round(max(abs(f0 - f1)), 9) AS ks FROM (SELECT sum((label = 0)::INTEGER) OVER w / sum((label = 0)::INTEGER) OVER () AS f0, sum((label = 1)::INTEGER) OVER w / sum((label = 1)::INTEGER) OVER () AS f1 FROM text_samples WINDOW w AS (ORDER BY length RANGE UNBOUNDED PRECEDING))"))
def _(spark, d):
    return stats.ks_statistic(T(spark, d), "length", "label").select(F.round("ks", 9).alias("ks"))


QUERIES, ORACLE_SQL = R.queries, R.sql
