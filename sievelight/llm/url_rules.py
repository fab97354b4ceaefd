"""URL filters by a sort-merge range join.

A rule names a host (with all its subdomains) and a path prefix. A URL is keyed
by the reversed labels of its host and by its path, once for each depth of host
that rules use; a rule is then the interval of keys that start with its own key.
Keys and rules are dealt to the same key ranges, a rule to every range that its
interval meets; in a range both are swept in key order with a stack of the rules
whose intervals are open, which are nested. The longest rule wins, whatever the
depth it was found at.

There are as many ranges as the number of keys asks for. They are cut at quantiles
of a hash sample of the keys (they only balance the work) and by key and page
together, so that even one key with a third of the rows is spread over several
ranges. Rows stay Arrow tables, so ids of any type come back as they were.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no
rule and gets the default verdict; a rule with empty path fits every path; of
rules with equal text the first listed wins; two rules of equal length can't
both fit unless host and path split differently, then the longer host wins; rows
with equal page_id are each returned; a null page_id is kept; extra columns are
ignored; without rules all get the default; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, partitions, stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    """``example.org/es/`` as host ``example.org``, path ``/es/``."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + path)


#: Fixed rules of the registered query.
RULES = tuple(
    parse_rule(v, t)
    for v, t in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
)
DEFAULT = "allow"
#: Keys in a range, and those sampled for each range when ranges are cut.
RANGE_KEYS, SAMPLE = 250_000, 20

_SEP = "\x00"  # between host labels and path: below every character of either


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL as the rules read it."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def key_of(host: str, path: str) -> str:
    return ".".join(reversed(host.split("."))) + _SEP + path


def sweep(rules: list[tuple[str, int]], keys: list[str]) -> list[int]:
    """For each key (ascending) the rule that opened last among those it starts with, or -1.

    ``rules`` are (key, number), ascending; prefixes nest, so the open ones form a stack.
    """
    out, stack, at = [], [], 0
    for key in keys:
        while at < len(rules) and rules[at][0] <= key:
            while stack and not rules[at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        out.append(stack[-1][1] if stack else -1)
    return out


def _rule_frame(spark, rules):
    rows = [(i, key_of(r.host, r.path), len(r.host.split(".")), r.verdict, r.text, len(r.text), len(r.host)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_no int, rule_key string, depth int, verdict string, rule string, size int, host_size int")


def judge(pages: DataFrame, rules: tuple[Rule, ...] | list[Rule] = RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict for every row of ``pages``."""
    spark = pages.sparkSession
    first = {}
    for r in rules:
        first.setdefault((r.host, r.path), r)
    listed = _rule_frame(spark, list(first.values()))
    depths = sorted({len(r.host.split(".")) for r in first.values()})
    host, path = host_and_path(F.col("url"))
    rows = stored(pages.select("page_id", host.alias("host"), path.alias("path"), F.xxhash64("url").alias("salt")), "urls")
    labels = F.reverse(F.split("host", r"\."))
    keys = F.array_compact(
        F.array(*[F.when(F.size(labels) >= d, F.concat(F.array_join(F.slice(labels, 1, d), "."), F.lit(_SEP), F.col("path"))) for d in depths] or [F.lit(None).cast("string")])
    )
    # pages that differ in nothing are judged once; counts bring them back
    distinct = rows.groupBy("page_id", "host", "path").agg(F.count("*").alias("copies"), F.min("salt").alias("salt"))
    page = F.xxhash64("page_id", "host", "path")
    keyed = distinct.select("page_id", "host", "path", "copies", page.alias("tie"), F.explode_outer(keys).alias("key"))
    total = max(1, rows.count() * max(1, len(depths)))
    ranges = max(partitions(spark), -(-total // RANGE_KEYS))
    every = max(1, total // (SAMPLE * ranges))
    sample = sorted((r.key, r.tie) for r in keyed.filter((F.pmod("tie", F.lit(every)) == 0) & F.col("key").isNotNull()).select("key", "tie").limit(4 * SAMPLE * ranges).collect())
    cuts = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
    cut_keys = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def range_of(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cut_keys.value, (k, t)) if k is not None else 0 for k, t in zip(key, tie)], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_of(key: pd.Series) -> pd.Series:
        """Ranges that hold the keys which start with ``key``."""
        past = lambda k: bisect_left(cut_keys.value, 1, key=lambda c: int(c[0] > k and not c[0].startswith(k)))
        return pd.Series([list(range(bisect_right(cut_keys.value, (k, -(2**63) - 1)), past(k) + 1)) for k in key])

    placed = keyed.withColumn("range", range_of("key", "tie"))
    dealt = listed.select("rule_no", "rule_key", F.explode(ranges_of("rule_key")).alias("range"))

    def merge(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        own = sorted(zip(theirs["rule_key"].to_pylist(), theirs["rule_no"].to_pylist()))
        keys = [k or "" for k in mine["key"].to_pylist()]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        found = sweep(own, [keys[i] for i in order])
        kept = mine.select(["page_id", "host", "path", "copies"]).take(pa.array(order, pa.int64()))
        return kept.append_column("rule_no", pa.array(found, pa.int32()))

    fields = pages.select("page_id").schema["page_id"].dataType.simpleString()
    swept = placed.groupBy("range").cogroup(dealt.groupBy("range")).applyInArrow(merge, f"page_id {fields}, host string, path string, copies long, rule_no int")
    ranked = swept.join(F.broadcast(listed) if len(first) <= 100_000 else listed, "rule_no", "left")
    best = ranked.groupBy("page_id", "host", "path").agg(
        F.max("copies").alias("copies"), F.max(F.when(F.col("rule").isNotNull(), F.struct("size", "host_size", "rule", "verdict"))).alias("best")
    )
    out = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
