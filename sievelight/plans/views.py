"""The driver's tables seen through the engine's data model, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import formatting_features, normalized_answer
from ..operators.semantic import consecutive_generations, grouped_generations
from ..operators.splits import split_column

SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as paired samples: two consecutive keys are a pair, the odd one is label 1."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    pair, label = F.floor(F.col("o_orderkey") / 2), (F.col("o_orderkey") % 2).cast("int")
    return orders.select(
        F.format_string("S%06d_%d", pair, label).alias("sample_id"), F.format_string("P%05d", pair).alias("pair_id"), label.alias("label"),
        F.col("o_totalprice").alias("score_a"), F.length("o_orderpriority").alias("length"), "o_orderkey", "o_orderpriority",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired samples with split and a second score that has many ties (lines of the order)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("score_b"))
    base = plain_samples(spark, sf_dir)
    joined = base.join(lines, base.o_orderkey == lines.l_orderkey, "left").withColumn("score_b", F.coalesce("score_b", F.lit(0)).cast("double")).drop("l_orderkey")
    return joined.select("pair_id", *[c for c in joined.columns if c != "pair_id"], split_column(base, "pair_id", SEED).alias("split"))


def text_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: low quality is the positive class; split by a hash of the id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.length("text").alias("length"))  # so that texts needn't be moved for their length
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    tenth = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("42"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long") % 10
    split = F.when(tenth == 0, "test").when(tenth == 1, "validation").otherwise("train")
    return docs.join(labels, "doc_id").select("doc_id", "text", "lang", "source", (1 - F.col("quality")).cast("int").alias("label"), "length", split.alias("split"))


def documents_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a hash split and a simple normalised text."""
    docs = table(spark, sf_dir, "documents")
    tenth = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("42"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long") % 10
    split = F.when(tenth == 0, "test").when(tenth == 1, "validation").otherwise("train")
    return docs.select("doc_id", F.floor(F.col("doc_id") / 2).alias("pair_id"), (F.col("doc_id") % 2).cast("int").alias("label"), split.alias("split"), F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r]+", " ")).alias("norm"))


def _answers(spark: SparkSession, sf_dir: str, normal: bool) -> DataFrame:
    """Events as answers, normalised before they are collected if asked for: each distinct answer once."""
    events = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type")
    if not normal:
        return events
    said = events.select(F.col("event_type").alias("given")).distinct().withColumn("said", normalized_answer(F.col("given")))
    return events.join(said, F.col("event_type").eqNullSafe(F.col("given"))).select("user_id", "at", F.col("said").alias("event_type"))


def generations(spark: SparkSession, sf_dir: str, k: int = 10, normal: bool = False) -> DataFrame:
    """Events of a user in time order: ten answers, then a candidate."""
    events = _answers(spark, sf_dir, normal)
    return grouped_generations(events, "user_id", "at", "event_type", k)


def generation_groups(spark: SparkSession, sf_dir: str, k: int = 10, normal: bool = False) -> DataFrame:
    """All events of a user in time order, in groups of ten answers and a candidate."""
    events = _answers(spark, sf_dir, normal)
    return consecutive_generations(events, "user_id", "at", "event_type", k)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of each embedding as four tokens' states of equal width."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array(*[F.slice(v, 16 * i + 1, 16) for i in range(4)]).alias("states"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as four layers of sixteen features in long form."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") >= 5).cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.select("sample_id", "label", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("layer"), "v").select("sample_id", "label", "layer", F.slice("v", F.col("layer") * 16 + 1, F.lit(16)).alias("features"))


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn followed by an assistant turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nxt = c.select(F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("t2"), F.col("role").alias("r2"), F.col("text").alias("answer"))
    return c.join(nxt, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2"))).filter("role = 'user' and r2 = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_samples(spark, sf_dir).select("doc_id", "label", "split", *formatting_features(F.col("text")))


# The same views as SQL common table expressions.
_TENTH = "(('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT % 10)"
_SPLIT = f"CASE WHEN {_TENTH} = 0 THEN 'test' WHEN {_TENTH} = 1 THEN 'validation' ELSE 'train' END"

SQL = {
    "plain": """plain AS (SELECT printf('S%06d_%d', o_orderkey // 2, o_orderkey % 2) AS sample_id, printf('P%05d', o_orderkey // 2) AS pair_id,
        (o_orderkey % 2)::INTEGER AS label, o_totalprice AS score_a, length(o_orderpriority) AS length, o_orderkey, o_orderpriority FROM orders)""",
    "splits": """ranked AS (SELECT pair_id, row_number() OVER (ORDER BY sha256('42:' || pair_id), pair_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT pair_id FROM plain)),
      sized AS (SELECT *, ceil(0.1 * n)::BIGINT AS n_test FROM ranked),
      splits AS (SELECT pair_id, CASE WHEN pos < n_test THEN 'test' WHEN pos < n_test + ceil(0.1::DOUBLE / 0.9::DOUBLE * (n - n_test))::BIGINT THEN 'validation' ELSE 'train' END AS split FROM sized)""",
    "samples": """samples AS (SELECT p.*, coalesce(l.c, 0)::DOUBLE AS score_b, s.split FROM plain p JOIN splits s USING (pair_id)
        LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) l ON p.o_orderkey = l.l_orderkey)""",
    "text_samples": f"""text_samples AS (SELECT d.doc_id, d.text, d.lang, d.source, (1 - l.quality)::INTEGER AS label, length(d.text) AS length, split FROM
        (SELECT *, {_SPLIT} AS split FROM documents) d JOIN labels l USING (doc_id))""",
    "docs": f"""docs AS (SELECT doc_id, doc_id // 2 AS pair_id, (doc_id % 2)::INTEGER AS label, {_SPLIT} AS split,
        trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')) AS norm FROM documents)""",
    "generations": """listed AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS l FROM events GROUP BY 1),
      generations AS (SELECT user_id, l[1:10] AS answers, l[11] AS candidate FROM listed WHERE len(l) > 10)""",
    "generation_groups": """numbered_events AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
      listed_groups AS (SELECT user_id, n // 11 AS group_no, list(event_type ORDER BY n) AS l FROM numbered_events GROUP BY 1, 2),
      generation_groups AS (SELECT user_id, group_no, l[1:10] AS answers, l[11] AS candidate, len(l) = 11 AS complete FROM listed_groups)""",
    "raw_pairs": """raw_pairs AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b
        ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')""",
}
_NEEDS = {"samples": ["plain", "splits", "samples"], "plain": ["plain"], "text_samples": ["text_samples"], "docs": ["docs"], "generations": ["generations"], "generation_groups": ["generation_groups"], "raw_pairs": ["raw_pairs"]}


def sql(view: str, query: str, *more: str) -> str:
    """A query over a view (and further CTE texts)."""
    return "WITH " + ",\n".join([*(SQL[v] for v in _NEEDS[view]), *more]) + "\n" + query
