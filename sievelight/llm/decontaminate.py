"""Benchmark decontamination over a distributed positional inverted index.

1. Test items are cut into windows (ten consecutive words; a shorter item is one
   window). The index holds a posting (term, document, position) for every token
   of the training texts that is a test term; it is stored, sorted by term within
   each file, and counts how often each test term occurs.
2. A window starts from the list of its rarest term: a posting's position less the
   term's offset is a place where the window may stand. Its second rarest list is
   intersected at its own offset, then all others, each shrinking what is left.
3. What every list of a window confirms is an exact phrase match.
   :func:`proximity_matches` asks instead that all terms, as often as the window has
   them, stand near that place in any order.

All steps are DataFrame expressions. A side is broadcast only when its counted
number of rows is at most ``BROADCAST_ROWS``; beyond it the same join is shuffled.

Defined cases: null text has no words; null or wordless items have no windows;
items with equal text all count; rows with equal doc_id are each returned with
their own counts; null ids are kept; extra columns are ignored; an empty
benchmark marks nothing; an empty document table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, stored, unused

#: Words in a window.
WINDOW = 10
#: Rows up to which a counted side of a join is broadcast.
BROADCAST_ROWS = 200_000
#: What separates words: all ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What names a document: its id may be null or repeated.
DOC = ("doc_id", "text_hash")


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text, in order."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words): the distinct windows of every test item."""
    items = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - window + 1))
    return items.select("item_id", F.explode(starts).alias("at"), "all").select("item_id", F.slice("all", F.col("at"), F.lit(window)).alias("words")).distinct()


def _small(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast ``df`` if it is counted to have at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _meet(left: DataFrame, right: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    """Join on the document (its id may be null) and on columns ``more``; keys come from ``left``."""
    keys = (*DOC, *more)
    right = right.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns])
    equal = reduce(lambda a, c: a & (F.col(c) == F.col(f"_{c}")), keys[1:], F.col("doc_id").eqNullSafe(F.col("_doc_id")))
    return left.join(right, equal, how).drop(*[f"_{c}" for c in keys])


class Index:
    """Postings of the test terms over the training texts.

    ``windows`` (w, words) are the distinct windows and ``items`` (item_id, w) who has
    them; ``postings`` (term, doc_id, text_hash, pos) is the stored index and
    ``documents`` (doc_id, text_hash, n_words) has a row for each row of the texts.
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_ROWS):
        self.limit = limit
        listed = stored(windows_of(benchmark, window), "windows")
        self.windows = stored(listed.select("words").distinct().withColumn("w", F.monotonically_increasing_id()), "window-numbers")
        self.items = listed.join(self.windows, "words").select("item_id", "w")
        terms = stored(listed.select(F.explode("words").alias("term")).distinct(), "test-terms")
        texts = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), words_of(F.col("text")).alias("words"))
        # the empty term stands behind the words: its position is their number
        tokens = texts.select(*DOC, F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "term"))
        if terms.limit(limit + 1).count() <= limit:
            found = tokens.join(F.broadcast(terms.unionByName(terms.sparkSession.createDataFrame([("",)], "term string"))), "term", "left_semi")
        else:  # a row for each document is no posting of one crowded term
            found = tokens.filter("term <> ''").join(terms, "term", "left_semi").unionByName(tokens.filter("term = ''").select("term", *DOC, "pos"))
        table = stored(found.select("term", *DOC, "pos").sortWithinPartitions("term"), "postings")
        self.postings = table.filter("term <> ''")
        self.documents = table.filter("term = ''").select(*DOC, F.col("pos").alias("n_words"))

    def places(self) -> DataFrame:
        """(w, term, offset, rank): every place of every window, ranked from the rarest term on.

        Windows with a term that the texts lack are left out: they cannot occur."""
        counts = self.postings.groupBy("term").agg(F.count("*").alias("n"))
        places = self.windows.select("w", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term")).join(counts, "term")
        mine = Window.partitionBy("w")  # a window has at most WINDOW places
        ranked = places.withColumn("rank", F.row_number().over(mine.orderBy("n", "term", "offset"))).withColumn("known", F.count("*").over(mine))
        return stored(ranked.filter("known = size").select("w", "term", "offset", "rank", "size"), "window-places")

    def starts(self, places: DataFrame) -> DataFrame:
        """(w, doc_id, text_hash, start): where a window would stand by its rarest term."""
        rarest = _small(places.filter("rank = 1").select("w", "term", "offset"), self.limit)
        return self.postings.join(rarest, "term").select("w", *DOC, (F.col("pos") - F.col("offset")).alias("start"))

    def near(self, found: DataFrame) -> DataFrame:
        """Postings of the documents that ``found`` names."""
        named = _small(stored(found.select(*DOC).distinct(), "named"), self.limit)
        return _meet(self.postings, named, how="left_semi")

    def phrases(self) -> DataFrame:
        """(w, doc_id, text_hash, start): the exact places of all windows, each once."""
        places = self.places()
        left = stored(self.starts(places).filter("start >= 0").distinct(), "candidates")
        for ranks in ("rank = 2", "rank > 2"):
            wanted = places.filter(ranks).select("w", "term", "offset")
            # the second lists by their terms, as many documents are left; all others by the few documents that are
            lists = self.postings.join(_small(wanted.select("term").distinct(), self.limit), "term", "left_semi") if ranks == "rank = 2" else self.near(left)
            asked = left.join(_small(wanted, self.limit), "w").withColumn("pos", F.col("start") + F.col("offset"))
            kept = _meet(asked, lists, "term", "pos", how="left_semi").groupBy("w", *DOC, "start").agg(F.count("*").alias("n"))
            need = places.filter(ranks).groupBy("w").agg(F.count("*").alias("need"))
            whole = kept.join(_small(need, self.limit), "w").filter("n = need").select("w", *DOC, "start")
            done = left.join(_small(need.select("w"), self.limit), "w", "left_anti")  # windows with fewer terms
            left = stored(whole.unionByName(done), "candidates")
        return left

    def stretches(self, slop: int) -> DataFrame:
        """(w, doc_id, text_hash, start, size): places around which all terms of a window
        stand, as often as it has them, from ``slop`` before ``start`` to ``slop`` behind its end."""
        places = self.places()
        terms = places.groupBy("w", "term", "size").agg(F.count("*").alias("times"))
        found = stored(self.starts(places).distinct(), "candidates")
        asked = found.join(_small(terms, self.limit), "w")
        width = WINDOW + 2 * slop  # postings meet by stretches of positions, not by whole documents
        low, high = F.col("start") - slop, F.col("start") + F.col("size") + slop - 1
        part = lambda c: F.floor(c / width)
        asked = asked.select("*", F.explode(F.sequence(part(low), part(high))).alias("part"))
        lists = self.near(found).withColumn("part", part(F.col("pos"))).distinct()
        met = _meet(asked, lists, "term", "part").filter(F.col("pos").between(low, high))
        enough = met.groupBy("w", *DOC, "start", "size", "term", "times").agg(F.count("*").alias("n")).filter("n >= times")
        whole = enough.groupBy("w", *DOC, "start", "size").agg(F.count("*").alias("n"))
        need = terms.groupBy("w").agg(F.count("*").alias("need"))
        return whole.join(_small(need, self.limit), "w").filter("n = need").select("w", *DOC, "start", "size")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated.

    A document's matches meet in one group; no group spans documents.
    """
    index = Index(docs, benchmark, window, limit)
    found = index.phrases()
    sizes = _small(index.windows.select("w", F.size("words").alias("size")), limit)
    spans = found.join(sizes, "w").select(*DOC, "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    before = Window.partitionBy(*DOC).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    hit = spans.withColumn("new", new).groupBy(*DOC).agg(F.sum("new").alias("n_hit"))
    items = found.select("w", *DOC).distinct().join(_small(index.items, limit), "w").groupBy(*DOC)
    items = items.agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = _meet(index.documents, _small(stored(_meet(hit, items), "hits"), limit), how="left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def proximity_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 5, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, start, end): stretches (word positions, end exclusive) that hold all
    terms of a test window, each as often as the window has it, in any order. A stretch is
    the window's place by its rarest term, widened by ``slop`` words to either side."""
    index = Index(docs, benchmark, window, limit)
    found = index.stretches(slop)
    placed = _meet(found, index.documents.distinct())
    low, high = F.greatest(F.col("start") - slop, F.lit(0)), F.least(F.col("start") + F.col("size") + slop, F.col("n_words"))
    return placed.join(_small(index.items, limit), "w").select("doc_id", "item_id", low.alias("start"), high.alias("end")).distinct()


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The documents without a test window, all columns. Contaminated texts are known
    by id and text hash; counted few, they go to the texts, else both sides meet."""
    mine, theirs, mark = unused(docs, "dirty_id", "dirty_hash", "dirty_mark")
    dirty = stored(Index(docs, benchmark, window, limit).phrases().select(F.col("doc_id").alias(mine), F.col("text_hash").alias(theirs)).distinct(), "dirty")
    rows = docs.withColumn(mark, text_hash(F.col("text")))
    return rows.join(_small(dirty, limit), rows["doc_id"].eqNullSafe(dirty[mine]) & (rows[mark] == dirty[theirs]), "left_anti").select(*docs.columns)
