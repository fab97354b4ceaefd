"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. A ledger
table, partitioned by rule version, records which blobs were scanned and what was
found; a run scans one text of each blob that the ledger lacks under the current
rules, appends the outcome, and joins findings back to all paths by address.

All steps are DataFrame expressions. Match positions come from cutting a text at
its matches: the pieces between and the matches alternate, so their running
lengths give the spans.

Defined cases: null text counts as empty; empty text has no span and the hash of
the empty string; rows with equal doc_id are each returned; a null doc_id is kept;
equal texts are scanned once; extra columns are ignored; an empty table gives an
empty result. Spans count code points, end exclusive; kinds may overlap, spans of
one kind don't.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound, carried, new_path, stored, unused


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` as Java reads it; a match counts if group
    ``group`` has at least ``least`` characters; ``screen`` holds wherever it can match."""

    kind: str
    pattern: str
    group: int
    least: int
    screen: str
    base: bool = True


#: Fixed patterns of the base rules, in the order in which kinds are listed.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i:passw|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN", base=False),
)


def version_of(rules: tuple[Rule, ...]) -> str:
    """Names a set of rules by its content, so that blobs are scanned afresh whenever a rule changes."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


#: Blobs with findings up to which findings are broadcast to the paths; beyond it, only those of
#: a text that holds at least this share of all rows.
BROADCAST_ROWS, CROWDED = 200_000, 1 / 256
SPAN = "struct<kind:int,start:int,end:int>"
_SPAN_TYPE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "start", "end")])
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule_version", T.StringType()), T.StructField("spans", T.ArrayType(_SPAN_TYPE))])


def _located(steps: Column, kind: int, least: int) -> Column:
    """Spans of one kind from alternating (gap, size, measure): lengths of the text before
    a match, of the match, and of what must reach ``least``."""

    def spans(s):
        begins = carried(F.transform(s, lambda x: x["gap"] + x["size"]), lambda a, x: a + x)
        found = F.filter(F.arrays_zip(s.alias("s"), begins.alias("at")), lambda z: z["s"]["measure"] >= least)
        begin = lambda z: z["at"] + z["s"]["gap"]
        return F.transform(found, lambda z: F.struct(F.lit(kind).alias("kind"), begin(z).alias("start"), (begin(z) + z["s"]["size"]).alias("end")))

    return bound(steps, spans)


def spans_of(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans in a text, by start, then kind as listed."""
    every = []
    for k, rule in enumerate(rules):
        # a hex run shorter than asked for can't hold a longer one, so only long runs are cut out
        pattern = "[0-9a-f]{%d,}" % rule.least if rule.pattern == "[0-9a-f]+" else rule.pattern
        matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
        pieces = F.split(text, pattern, -1)
        steps = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(matches, F.length).alias("size"), F.transform(groups, F.length).alias("measure"))
        steps = F.transform(steps, lambda x: F.struct(x["gap"], F.coalesce(x["size"], F.lit(0)).alias("size"), F.coalesce(x["measure"], F.lit(-1)).alias("measure")))
        found = _located(steps, k, rule.least)
        every.append(F.when(text.rlike(rule.screen), found).otherwise(F.array().cast(f"array<{SPAN}>")))
    by_start = F.transform(F.array_sort(F.transform(F.concat(*every), lambda s: F.struct(s["start"], s["kind"], s["end"]))), lambda s: F.struct(s["kind"], s["start"], s["end"]))
    return by_start.cast(f"array<{SPAN}>")


def written(spans: Column, rules: tuple[Rule, ...] = RULES, base_only: bool = False) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    if base_only:
        base = F.array(*[F.lit(r.base) for r in rules])
        spans = F.filter(spans, lambda s: base[s["kind"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")


def plain(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def address(text: Column) -> Column:
    return F.sha2(plain(text), 256)


def open_ledger(spark, path: str) -> DataFrame:
    """The ledger at ``path``; empty if nothing was written there yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def _addressed(versions: DataFrame) -> DataFrame:
    return versions.select("doc_id", plain(F.col("text")).alias("text"), address(F.col("text")).alias("blob"))


def _scan(versions: DataFrame, counted: DataFrame, ledger: str, rules: tuple[Rule, ...]) -> None:
    """Append what the ledger lacks; ``counted`` has each blob with its first path."""
    version = version_of(rules)
    rows, seen = _addressed(versions), open_ledger(versions.sparkSession, ledger).filter(F.col("rule_version") == version).select("blob")
    first = counted.join(seen, "blob", "left_anti").select(F.col("blob").alias("first_blob"), "first_id")
    same = rows["doc_id"].eqNullSafe(first["first_id"]) & (rows["blob"] == first["first_blob"])
    texts = rows.join(first, same, "left_semi")
    # a path listed twice with one text would be scanned twice: spans are equal, one row stays
    found = texts.select("blob", spans_of(F.col("text"), rules).alias("spans")).dropDuplicates(["blob"])
    found.select("blob", F.lit(version).alias("rule_version"), "spans").write.mode("append").partitionBy("rule_version").parquet(ledger)


def _counted(versions: DataFrame) -> DataFrame:
    """(blob, first_id, n): each text's address, one of its paths and how many there are."""
    return versions.select("doc_id", address(F.col("text")).alias("blob")).groupBy("blob").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def known(spark, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's rows under these rules, one for each blob: two runs that met may both have
    scanned a blob, with the same outcome."""
    return open_ledger(spark, ledger).filter(F.col("rule_version") == version_of(rules)).dropDuplicates(["blob"])


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger at ``ledger`` up to date with ``versions`` (doc_id, text); return it for these rules.

    Each blob that is new under this rule version is scanned once. Only its
    address and one path are grouped; the text follows by a join on the path.
    """
    with Scratch(versions.sparkSession) as keep:
        _scan(versions, keep.keep(_counted(versions), "blobs"), ledger, rules)
    return known(versions.sparkSession, ledger, rules)


def _hits(versions: DataFrame, ledger: str | None, rules: tuple[Rule, ...], keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """(blob, spans) of the texts that hold something, in two parts: those to broadcast and the rest."""
    spark = versions.sparkSession
    counted = keep.keep(_counted(versions), "blobs")
    own = ledger or keep.path("secret-ledger")
    _scan(versions, counted, own, rules)
    # nobody else writes a ledger of this call's own: its blobs are there once
    found = known(spark, own, rules) if ledger else open_ledger(spark, own)
    hit = stored(found.filter(F.size("spans") > 0).select("blob", "spans").join(counted.select("blob", "n"), "blob"), "secret-hits")
    total = counted.agg(F.sum("n")).first()[0] or 0
    few = hit.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    often = F.lit(True) if few else F.col("n") >= max(1, total * CROWDED)
    return hit.filter(often).drop("n"), hit.filter(~often).drop("n")


def _with_spans(rows: DataFrame, blob: str, spans: str, hits: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``rows`` with the spans of their blob, null where it has none. Findings of texts that many
    rows hold are broadcast, so that copies of one text never meet in one task."""
    (crowded, rest), (a, b) = hits, unused(rows.withColumn(spans, F.lit(0)), "hit_blob", "hit_spans")
    named = lambda df: df.select(F.col("blob").alias(a), F.col("spans").alias(b))
    out = rows.join(F.broadcast(named(crowded)), F.col(blob) == F.col(a), "left").withColumnRenamed(b, spans).drop(a)
    if rest.isEmpty():
        return out
    clear, left = out.filter(F.col(spans).isNotNull()), out.filter(F.col(spans).isNull()).drop(spans)
    return clear.unionByName(left.join(named(rest), F.col(blob) == F.col(a), "left").withColumnRenamed(b, spans).drop(a))


def findings(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, spans) for every row of ``versions``, through the ledger (a fresh one if none is named)."""
    with Scratch(versions.sparkSession) as keep:
        hits = _hits(versions, ledger, rules, keep)
    rows = versions.select("doc_id", address(F.col("text")).alias("blob"))
    return _with_spans(rows, "blob", "spans", hits).withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))


def report(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, counts of each base kind, hash of the base spans, and all spans."""
    found = findings(docs, ledger)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{RULES[k].kind}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(written(F.col("spans"), base_only=True), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every stretch covered by spans replaced by ``mark``."""

    def pieces(s):
        reach = carried(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x))  # how far the spans before have come
        cut = lambda z: F.concat(F.substring(text, z["reach"] + 1, z["s"]["start"] - z["reach"]), F.lit(mark))
        opening = F.filter(F.arrays_zip(s.alias("s"), reach.alias("reach")), lambda z: z["s"]["start"] >= z["reach"])
        rest = F.substring(text, F.array_max(F.transform(s, lambda x: x["end"])) + 1, F.length(text))
        return F.concat(F.array_join(F.transform(opening, cut), ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(bound(spans, pieces))


def redact(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """``docs`` with secrets cut out of ``text`` and ``n_chars`` renewed; texts without secrets stay as they are."""
    blob, spans = unused(docs, "hit_blob", "hit_spans")
    with Scratch(docs.sparkSession) as keep:
        hits = _hits(docs, ledger, RULES, keep)
    joined = _with_spans(docs.withColumn(blob, address(F.col("text"))), blob, spans, hits)
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col(spans)))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
