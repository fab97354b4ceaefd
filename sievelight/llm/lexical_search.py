"""Ranked lexical search over an inverted index of all terms.

The index is a DataFrame of posting lists, bucketed and sorted by term: a row holds a term's
documents in one block of the texts (their places in the block, how often the term occurs,
how many terms the documents have). A block has about ``BLOCK_POSTINGS`` postings, never
parts a document, and orders its documents by id; a row without term lists those ids.
Lists of a term that is frequent within its block are dealt by block as well, so that a
crowded term isn't one bucket; the index is worked out once and can be searched again.

A search joins the items' terms to the lists, brings the lists found together by block,
scores each match with integers, sums by item and document inside the block, and takes each
item's best with a window: first in the block, where places are in the order of ids, then,
with the ids of what is left, over all blocks.

    w = floor(1000 * ln((2N + 2) / (2 df + 1)))
    m = 10 + (90 n N) div L
    score = sum of w * ((10**9 tf) div (1000 tf + 8 m)) over the item's terms

N: documents with terms, L: all terms, n: a document's terms, df: documents with the term.

Defined cases: null and termless texts are in no list and not in N; documents are rows, so
rows with equal doc_id are ranked each, null ids behind others of their score; an item is an
item_id (null is one too) and has the terms of all its rows; termless items have no result;
ties go to the smaller doc_id; extra columns are ignored; empty tables give no rows. A long
text is read in pieces; the terms of one document are held by one task.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, small, stored, tidied
from .decontaminate import words_of

#: Documents returned for an item.
TOP = 10
#: Postings from which a block is complete.
BLOCK_POSTINGS = 1_000_000
#: A term in more than this share of a block's documents has its list dealt by block.
FREQUENT = 1 / 64
#: Rows up to which the items' terms are broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of a text that are taken apart at once.
PIECE = 4 << 20
#: Terms: letters A-Z in lower case, digits and all that isn't ASCII; the rest parts them.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_LISTS = pa.schema([("term", pa.string()), ("part", pa.int64()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
_DDL = "term string, part long, block long, doc_ids array<long>, places array<int>, lengths array<int>, counts array<int>"


def term_counts(text: str | None) -> Counter:
    """How often each term (bytes) occurs."""
    found, data = Counter(), (text or "").encode()
    at = 0
    while at < len(data):
        piece, end = b"", at + PIECE
        if end < len(data):  # up to the last gap of the piece, or the next one behind it
            piece = data[at:end].translate(_FOLD)
            cut = piece.rfind(b" ")
            while cut <= 0 and end < len(data):
                more = data[end : end + PIECE].translate(_FOLD)
                gap = more.find(b" ")
                piece, end = piece + (more if gap < 0 else more[:gap]), end + (len(more) if gap < 0 else gap)
                cut = len(piece) if gap >= 0 or end >= len(data) else -1
            found.update(piece[:cut].split())
            at += cut
        else:
            found.update(data[at:].translate(_FOLD).split())
            at = len(data)
    return found


def _block(number: int, ids: list, sizes: list[int], lengths: list[int], terms: list[bytes], counts: list[int]) -> pa.Table:
    """Posting lists of a block, and a list without term of all its documents."""
    codes = pa.array(terms, pa.binary()).dictionary_encode()
    code, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.cast(pa.string())
    by_id = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, i))
    place = np.empty(len(ids), np.int32)
    place[by_id] = np.arange(len(ids))
    document = np.repeat(np.arange(len(ids)), sizes)
    order = np.lexsort((place[document], code))
    document, length = document[order], np.array(lengths, np.int32)
    held = np.bincount(code, minlength=len(names))
    starts = pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32))
    lists = [pa.array(x) for x in (place[document], length[document], np.array(counts, np.int32)[order])]
    part = np.where(held > max(1.0, len(ids) * FREQUENT), number + 1, 0)
    none = pa.nulls(len(names), pa.list_(pa.int64()))
    found = pa.table([names, pa.array(part), pa.array(np.full(len(names), number)), none, *[pa.ListArray.from_arrays(starts, x) for x in lists]], schema=_LISTS)
    whole = pa.table([[None], [number + 1], [number], [[ids[i] for i in by_id]], [None], [length[by_id]], [None]], schema=_LISTS)
    return pa.concat_tables([found, whole])


def _lists(batches):
    task, made = TaskContext.get().partitionId(), 0
    ids, sizes, lengths, terms, counts = [], [], [], [], []
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            found = term_counts(text.as_py())
            if not found:
                continue
            ids.append(doc_id), sizes.append(len(found)), lengths.append(found.total())
            terms.extend(found.keys()), counts.extend(found.values())
            if len(terms) >= BLOCK_POSTINGS:
                yield from _block(task << 32 | made, ids, sizes, lengths, terms, counts).to_batches(max_chunksize=20_000)
                made += 1
                ids, sizes, lengths, terms, counts = [], [], [], [], []
    if ids:
        yield from _block(task << 32 | made, ids, sizes, lengths, terms, counts).to_batches(max_chunksize=20_000)


def posting_lists(docs: DataFrame) -> DataFrame:
    """term, part, block, places (in the block), lengths, counts; a row without term has the
    doc_ids and lengths of all documents of a block."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(tidied(_lists), _DDL)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""
    return items.select("item_id", F.explode(words_of(F.col("text"))).alias("term")).distinct()


@dataclass(frozen=True)
class Index:
    """A stored index: ``lists`` as :func:`posting_lists` has them."""

    lists: DataFrame

    @staticmethod
    def build(docs: DataFrame, table: str, path: str) -> Index:
        """Write the lists of ``docs`` as ``table``, bucketed by term, with its files at ``path``."""
        spark, n = docs.sparkSession, partitions(docs.sparkSession)
        dealt = posting_lists(docs).repartition(n, "term", "part")
        dealt.write.bucketBy(n, "term", "part").sortBy("term").option("path", path).saveAsTable(table)
        return Index.open(spark, table)

    @staticmethod
    def open(spark: SparkSession, table: str) -> Index:
        return Index(spark.table(table))

    def totals(self) -> tuple[int, int]:
        """Documents with terms, and all their terms."""
        sums = self.lists.filter("term is null").agg(F.sum(F.size("doc_ids")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
        return sums.n or 0, sums.l or 0

    def search(self, items: DataFrame, k: int = TOP, limit: int = BROADCAST_ROWS) -> DataFrame:
        """item_id, rank, doc_id, score of each item's ``k`` best documents."""
        documents, tokens = self.totals()
        with Scratch(items.sparkSession) as keep:
            asked = keep.keep(item_terms(items), "item-terms")
            terms = small(asked.select("term").distinct(), limit)
            found = keep.keep(self.lists.join(terms, "term").select("term", "block", "places", "lengths", "counts"), "found-lists")
            df = found.groupBy("term").agg(F.sum(F.size("places")).alias("df"))
            weight = F.floor(1000 * F.ln(F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1)))
            weighed = keep.keep(asked.join(df, "term").select("item_id", "term", weight.cast("long").alias("w")).filter("w > 0"), "weights")
            matches = found.repartition("block").select("term", "block", F.inline(F.arrays_zip("places", "lengths", "counts")))
            m = f"(10L + (90L * lengths * {documents}L) div {max(tokens, 1)}L)"
            matches = matches.select("term", "block", F.col("places").alias("place"), F.expr(f"(1000000000L * counts) div (1000L * counts + 8L * {m})").alias("s"))
            # a block's lists are in one task: neither the sums nor the best of a block need a further exchange
            summed = matches.join(small(weighed, limit), "term").groupBy("block", "place", "item_id").agg(F.sum(F.col("w") * F.col("s")).alias("score")).filter("score > 0")
            in_block = Window.partitionBy("block", "item_id").orderBy(F.desc("score"), "place")
            left = keep.keep(summed.withColumn("rank", F.row_number().over(in_block)).filter(F.col("rank") <= k).drop("rank"), "best-of-blocks")
            named = self.lists.filter("term is null").select("block", F.posexplode("doc_ids").alias("place", "doc_id"))
            best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
            ranked = left.join(named, ["block", "place"]).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            return stored(ranked.select("item_id", "rank", "doc_id", "score"), "ranked")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, limit: int = BROADCAST_ROWS) -> DataFrame:
    """:meth:`Index.search` over an index that is built for it and then removed."""
    with Scratch(docs.sparkSession) as keep:
        return Index.build(docs, keep.table("postings"), keep.path("postings")).search(items, k, limit)
