"""Katz backoff model of any order: trained on part of the documents, scoring all.

Probability of a token w after the history h (order - 1 tokens), evaluated recursively;
h' is h without its first token:

    P(w | h) = d(c(h,w)) c(h,w) / c(h)      if c(h,w) > 0
             = alpha(h) P(w | h')           otherwise
    P(w)     = d(c(w)) c(w) / N             if c(w) > 0
             = the mass left                for all unseen words together

with Good-Turing discounts d of each length up to TOP and alpha(h) = (1 - seen mass of h) /
(1 - P(. | h') of the words seen after h), so that every history sums to one exactly. A
history without discounted n-grams gives up 1 / (c(h) + 1). A history that wasn't seen leaves
all to h'. Before a text stands one start, which is the whole history there. Every training
n-gram is stored and scored, those seen once by their Good-Turing discount.

Counting and look-up are one exchange for each length. Documents are packed into blocks of
token numbers, stored in a table bucketed by block. A block sends its distinct keys
(64-bit hashes of words, n-grams or histories) with its own numbers to key ranges;
a range adds them up, stores the model's rows (counts of n-grams, and backoff weights) in a
table partitioned by kind, and answers each block in the order of its keys. From the answers
up to a length a block knows its n-grams' probabilities, and so what it adds to the weights
of the next longer histories. Words that fill a third of the corpus are one key of each block,
so no range is crowded, and only distinct keys are moved: a block asks a range only
for keys it has, so there are never more requests than distinct keys of all blocks.
Two different n-grams share counts only if their 64-bit hashes collide. Scores are
stored; blocks, requests and answers are deleted, also after a failure.

Defined cases: null text counts as empty (its end token is scored); rows with
equal doc_id are each scored and, if in training, each counted; a null doc_id
hashes as the empty text; extra columns are ignored; an empty table gives an
empty result; without training documents every token has probability one.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, Scratch, bucket_of_id, partitions, stored

#: Words of an n-gram.
ORDER = 2
#: Count up to which Good-Turing discounts.
TOP = 5
#: Bytes of text in a block, and tokens for each key range.
BLOCK_BYTES, RANGE_TOKENS = 12 << 20, 2_000_000

_END, _START = xxhash.xxh64_intdigest(b"\n"), xxhash.xxh64_intdigest(b"\n\n")

ENCODED = "block long, docs binary, nulls binary, held binary, sizes binary, tokens binary, vocab binary, n_tokens long"
REQUEST = "range int, block long, keys binary, data binary"
#: What a block knows of a history: discounted counts of the pairs it owns, P of their words, and the history's count.
HISTORY = np.dtype([("mass", "f8"), ("lower", "f8"), ("count", "u4")])
REPLY = "kind string, block long, range int, keys binary, data binary, stats array<long>"


def squeeze(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, its bytes grouped by place."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes())


def expand(packed: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype)[:, 0] if len(raw) else np.zeros(0, dtype)


def gaps(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as steps from one to the next; their running sum gives them back."""
    return np.diff(keys, prepend=np.uint64(0))


def pair_keys(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit keys of (history, word) hashes."""
    x = history * np.uint64(0x9E3779B97F4A7C15) ^ (word * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Grams(NamedTuple):
    """Distinct n-grams of a block, by ascending key.

    ``context`` and ``suffix`` are numbers among the n-grams one shorter (a context may also be
    the start, numbered behind them), ``word`` among the words; ``place`` is each position's n-gram."""

    keys: np.ndarray
    context: np.ndarray
    suffix: np.ndarray
    word: np.ndarray
    place: np.ndarray


class Block:
    """Documents as token numbers, and their n-grams of each length."""

    def __init__(self, row):
        self.tokens = expand(row.tokens, np.int32).astype(np.int64)
        self.vocab = np.frombuffer(row.vocab, np.uint64)
        self.sizes = np.frombuffer(row.sizes, np.int32).astype(np.int64)
        self.held = np.frombuffer(row.held, np.bool_)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.training = np.repeat(~self.held, self.sizes)

    def grams(self, order: int) -> list[Grams]:
        """Those of length 1 to ``order``."""
        by_hash = np.argsort(self.vocab, kind="stable")
        rank = np.empty_like(by_hash)
        rank[by_hash] = np.arange(len(by_hash))
        none = np.zeros(len(by_hash), np.int64)
        found = [Grams(self.vocab[by_hash], none, none, np.arange(len(by_hash)), rank[self.tokens])]
        words = found[0]
        for _ in range(1, order):
            low = found[-1]
            context = np.empty_like(low.place)
            context[1:] = low.place[:-1]
            context[self.starts] = len(low.keys)
            codes, inverse = np.unique(context * max(1, len(words.keys)) + words.place, return_inverse=True)
            before, word = np.divmod(codes, max(1, len(words.keys)))
            keys = pair_keys(contexts(low)[before], words.keys[word])
            order_ = np.argsort(keys, kind="stable")
            place = np.empty_like(order_)
            place[order_] = np.arange(len(order_))
            place = place[inverse]
            suffix = np.empty(len(keys), np.int64)
            suffix[place] = low.place
            found.append(Grams(keys[order_], before[order_], suffix, word[order_], place))
        return found

    def counts(self, grams: Grams) -> np.ndarray:
        """How often the training part of the block has each."""
        return np.bincount(grams.place[self.training], minlength=len(grams.keys)).astype(np.uint32)


def contexts(low: Grams) -> np.ndarray:
    """Keys of the histories that n-grams of a length are, with the start behind them."""
    return np.append(low.keys, np.uint64(_START))


def encode(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of the documents (doc_id, held_out, text)."""

    def pack(rows, block):
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        number[b"\n"]
        words = [t.translate(LOWER_ASCII).split() for _, _, t in rows]
        sizes = np.array([len(w) + 1 for w in words], np.int32)
        found = np.fromiter(map(number.__getitem__, chain.from_iterable((*w, b"\n") for w in words)), np.int32, int(sizes.sum()))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
        often = np.argsort(-np.bincount(found, minlength=len(number)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(often), np.int32)
        rank[often] = np.arange(len(often))
        ids = np.array([d or 0 for d, _, _ in rows], np.int64)
        nulls, held = np.array([d is None for d, _, _ in rows], np.bool_), np.array([h for _, h, _ in rows], np.bool_)
        values = [block, ids.tobytes(), nulls.tobytes(), held.tobytes(), sizes.tobytes(), squeeze(rank[found]), hashes[often].tobytes(), len(found)]
        names = [c.split(" ")[0] for c in ENCODED.split(", ")]
        types = [pa.int64()] + [pa.binary()] * 6 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    def run(batches):
        block, rows, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                rows.append((row[0], row[1], row[2] or b""))
                held += len(rows[-1][2])
                if held >= block_bytes:
                    yield pack(rows, block)
                    block, rows, held = block + 1, [], 0
        if rows:
            yield pack(rows, block)

    return docs.mapInArrow(run, ENCODED)


def _requests(block: int, keys: np.ndarray, data: np.ndarray, ranges: int) -> list[tuple]:
    """Ascending keys and the rows of ``data`` that belong to them, cut at key ranges."""
    to = ((keys >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)
    cuts = np.concatenate([[0], np.nonzero(np.diff(to))[0] + 1, [len(to)]]) if len(to) else np.array([0])
    return [(int(to[a]), block, squeeze(keys[a:b]), squeeze(data[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])


def _answered(replies: pd.DataFrame, kind: str, dtype) -> np.ndarray:
    """A block's answers of one kind, in the order of its ascending keys."""
    own = replies[replies["kind"] == kind].sort_values("range")
    parts = [expand(d, dtype) for d in own["data"]]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _merge_counts(kind: str):
    """Range side of a count exchange: totals to every asker (twice the total, plus one
    for the first asker that has counted the key), the model's rows, and counts of counts."""

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        keys = [expand(k, np.uint64) for k in pdf["keys"]]
        counts = [expand(c, np.uint32) for c in pdf["data"]]
        sizes = [len(k) for k in keys]
        every, own = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        distinct, at = np.unique(every, return_inverse=True)
        total = np.bincount(at, own, len(distinct)).astype(np.int64)
        first = np.full(len(distinct), len(every))
        mine = np.nonzero(own)[0]
        np.minimum.at(first, at[mine], mine)
        answer = (total[at] * 2 + (first[at] == np.arange(len(every)))).astype(np.uint32)
        stats = [int(total.sum()), int((total > 0).sum()), *np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)[1 : TOP + 2].tolist()]
        kept = total > 0
        rows = [(f"{kind}_model", None, key[0], squeeze(gaps(distinct[kept])), squeeze(total[kept].astype(np.uint32)), stats)]
        for block, a, b in zip(pdf["block"], np.cumsum(sizes) - sizes, np.cumsum(sizes)):
            rows.append((kind, int(block), key[0], None, squeeze(answer[a:b]), None))
        return _frame(rows, REPLY)

    return merge


def _merge_histories(kind: str):
    """Range side of the history exchange: the backoff weight of each history, to every asker and into the model."""

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        keys = [expand(k, np.uint64) for k in pdf["keys"]]
        values = np.concatenate([expand(d, HISTORY) for d in pdf["data"]])
        sizes = [len(k) for k in keys]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(at, values[f], len(distinct)) for f in ("mass", "lower")]
        count = np.zeros(len(distinct), np.int64)
        count[at] = values["count"]
        weights = backoff(*sums, count)
        rows = [(f"{kind}_model", None, key[0], squeeze(gaps(distinct)), squeeze(weights), None)]
        for block, a, b in zip(pdf["block"], np.cumsum(sizes) - sizes, np.cumsum(sizes)):
            rows.append((kind, int(block), key[0], None, squeeze(weights[at[a:b]]), None))
        return _frame(rows, REPLY)

    return merge


def backoff(mass: np.ndarray, lower: np.ndarray, count: np.ndarray) -> np.ndarray:
    """alpha of histories from the discounted counts of their pairs, P of those pairs' words,
    and their own counts; negative where no pair was discounted, 1 where there is no pair."""
    c = np.maximum(count, 1)
    whole = mass >= c
    alpha = np.where(whole, 1 / (c + 1), 1 - mass / c) / np.maximum(1 - lower, 1e-300)
    return np.where(mass > 0, np.where(whole, -alpha, alpha), 1.0)


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d(r) for r = 0..TOP (d(0) unused); beyond TOP counts stand. Good-Turing as Katz
    has it where the counts of counts allow it, else absolute discounting."""
    n = [0, *counts_of_counts]
    out = np.ones(TOP + 1)
    common = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    whole = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    for r in range(1, TOP + 1):
        good = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = good if 0 < good < 1 else 1 - whole / r
    return out


class Model:
    """The numbers that all blocks share: totals, and discounts of each length of n-gram."""

    def __init__(self, total: int, distinct: int, end_count: int, counts_of_counts: list[list[int]]):
        self.total, self.distinct, self.end_count = total, distinct, end_count
        self.d = [discounts(n) for n in counts_of_counts]
        seen = sum(r * n for r, n in zip(range(1, TOP + 1), counts_of_counts[0]))
        kept = sum(self.d[0][r] * r * n for r, n in zip(range(1, TOP + 1), counts_of_counts[0]))
        self.unseen = (seen - kept) / total if total else 1.0
        if total and self.unseen <= 0:  # no rare words: one unit of mass is set aside
            self.unseen = 1 / (total + 1)
        self.scale = (1 - self.unseen) / (1 - (seen - kept) / total) if total else 1.0

    def mass(self, count: np.ndarray, length: int) -> np.ndarray:
        """Discounted counts of n-grams of a length."""
        return np.where(count > TOP, 1.0, self.d[length - 1][np.minimum(count, TOP)]) * count

    def word(self, count: np.ndarray) -> np.ndarray:
        """P(w); for an unseen word the whole unseen mass."""
        return np.where(count > 0, self.scale * self.mass(count, 1) / max(1, self.total), self.unseen)

    def probabilities(self, grams: list[Grams], counts: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        """P of the longest of ``grams`` given their histories, length by length: ``counts`` of the
        n-grams of each length, :func:`backoff` ``weights`` of the histories from length two on."""
        found = self.word(counts[0])
        if not self.total:
            return np.ones(len(grams[-1].keys))
        for length, (own, count) in enumerate(zip(grams[1:], counts[1:]), 2):
            weight = weights[length - 2][own.context]
            whole = np.maximum(self.of_contexts(counts[length - 2])[own.context], 1) + (weight < 0)
            found = np.where(count > 0, self.mass(count, length) / whole, np.abs(weight) * found[own.suffix])
        return found

    def of_contexts(self, counts: np.ndarray) -> np.ndarray:
        """How often histories were seen: every text of the training part has one start, as it has one end."""
        return np.append(counts, self.end_count)


def train_and_score(docs: DataFrame, held_out, block_bytes: int = BLOCK_BYTES, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    if order < 1:
        raise ValueError("the order is at least 1")
    with Scratch(docs.sparkSession) as keep:
        return stored(_scores(docs, held_out, block_bytes, order, keep), "katz-scores")


def _scores(docs: DataFrame, held_out, block_bytes: int, order: int, keep: Scratch) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), F.col("text").cast("string").alias("text"))
    blocks = _bucketed(encode(rows, block_bytes), keep)
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = max(partitions(spark), -(-tokens // RANGE_TOKENS))
    by_block = blocks.groupBy("block")
    replied = lambda tables: _all_replies(tables).groupBy("block")

    def ask_counts(length: int):
        def ask(batches):
            for batch in batches:
                out = []
                for row in batch.to_pandas().itertuples():
                    b = Block(row)
                    own = b.grams(length)[-1]
                    out += _requests(row.block, own.keys, b.counts(own), ranges)
                yield pa.RecordBatch.from_pandas(_frame(out, REQUEST).astype({"range": "int32"}), preserve_index=False)

        return ask

    def answered_counts(replies: pd.DataFrame, lengths: int) -> list[np.ndarray]:
        return [(_answered(replies, f"counts{n}", np.uint32) >> 1).astype(np.int64) for n in range(1, lengths + 1)]

    def answered_weights(b: list[Grams], replies: pd.DataFrame, lengths: int) -> list[np.ndarray]:
        """Weights of the histories of n-grams of length 2 to ``lengths``, by number."""
        out = []
        for n in range(2, lengths + 1):
            weights = np.empty(len(b[n - 2].keys) + 1)
            weights[np.argsort(contexts(b[n - 2]), kind="stable")] = _answered(replies, f"histories{n}", np.float64)
            out.append(weights)
        return out

    def ask_histories(length: int, model: Model):
        def ask(mine: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in mine.itertuples():
                grams = Block(row).grams(length)
                counts = answered_counts(replies, length)
                lower = model.probabilities(grams[:-1], counts[:-1], answered_weights(grams, replies, length - 1))
                own, answer = grams[-1], _answered(replies, f"counts{length}", np.uint32)
                owned = np.nonzero((answer & 1) & (answer > 1))[0]  # each stored n-gram is owned by one block
                keys = contexts(grams[-2])
                known = np.zeros(len(keys), HISTORY)
                known["mass"] = np.bincount(own.context[owned], model.mass(counts[-1][owned], length), len(keys))
                known["lower"] = np.bincount(own.context[owned], lower[own.suffix[owned]], len(keys))
                known["count"] = model.of_contexts(counts[-2])
                by_key = np.argsort(keys, kind="stable")
                out += _requests(row.block, keys[by_key], known[by_key], ranges)
            return _frame(out, REQUEST)

        return ask

    tables, counts_of_counts = [], []
    for length in range(1, order + 1):
        tables.append(_answers(blocks.mapInArrow(ask_counts(length), REQUEST), _merge_counts(f"counts{length}"), keep))
        n, different, *of_counts = _stats(tables[-1], f"counts{length}_model")
        counts_of_counts.append(of_counts)
        if length == 1:
            total, distinct, end_count = n, different, _count_of(tables[0], _END, ranges)
        model = Model(total, distinct, end_count, counts_of_counts)
        if length > 1:
            asked = by_block.cogroup(replied(tables)).applyInPandas(ask_histories(length, model), REQUEST)
            tables.append(_answers(asked, _merge_histories(f"histories{length}"), keep))

    def score(mine: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for row in mine.itertuples():
            b = Block(row)
            grams = b.grams(order)
            counts = answered_counts(replies, order)
            p = model.probabilities(grams, counts, answered_weights(grams, replies, order))
            known = counts[0][grams[0].place]
            base = np.log10((known + 0.1) / (total + 0.1 * (distinct + 1)))
            ids = np.frombuffer(row.docs, np.int64)
            parts.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array(ids, dtype="Int64"),
                        "held_out": b.held,
                        "n_tokens": b.sizes,
                        "n_known": np.add.reduceat((known > 0).astype(np.int64), b.starts),
                        "train_tokens": np.full(len(ids), total, np.int64),
                        "base_score": np.add.reduceat(base, b.starts),
                        "score": np.add.reduceat(np.log10(p)[grams[-1].place], b.starts),
                    }
                )
            )
            parts[-1].loc[np.frombuffer(row.nulls, np.bool_), "doc_id"] = pd.NA
        return pd.concat(parts)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_block.cogroup(replied(tables)).applyInPandas(score, schema)


def _bucketed(blocks: DataFrame, keep: Scratch) -> DataFrame:
    """Store the blocks bucketed by block: joins by block then leave them in place."""
    name = keep.table("katz_blocks")
    blocks.write.bucketBy(partitions(keep.spark), "block").option("path", keep.path("katz-blocks")).saveAsTable(name)
    return keep.spark.table(name)


def _answers(requests: DataFrame, merge, keep: Scratch) -> DataFrame:
    """Add up the requests of each key range; store answers and model rows, partitioned by kind."""
    path = keep.path("katz")
    requests.groupBy("range").applyInPandas(merge, REPLY).write.partitionBy("kind").parquet(path)
    fields = "block long, range int, keys binary, data binary, stats array<long>, kind string"
    return requests.sparkSession.read.schema(fields).parquet(path)


def _stats(answers: DataFrame, kind: str) -> list[int]:
    found = answers.filter(F.col("kind") == kind).select(F.posexplode("stats").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").collect()
    return [r.n for r in found] or [0] * (TOP + 3)


def _count_of(words: DataFrame, key: int, ranges: int) -> int:
    """Count of one word, from its range's row of the stored model."""
    at = (key >> 40) * ranges >> 24
    for row in words.filter((F.col("kind") == "counts1_model") & (F.col("range") == at)).select("keys", "data").collect():
        keys = np.cumsum(expand(row["keys"], np.uint64), dtype=np.uint64)
        where = np.searchsorted(keys, np.uint64(key))
        if where < len(keys) and keys[where] == key:
            return int(expand(row["data"], np.uint32)[where])
    return 0


def _all_replies(tables) -> DataFrame:
    parts = [t.filter(F.col("block").isNotNull()).select("block", "range", "kind", "data") for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, order: int = ORDER) -> DataFrame:
    """Train on documents whose crc32(doc_id) mod 10 is not 0, score all."""
    return train_and_score(docs, bucket_of_id(F.col("doc_id"), 10) == 0, block_bytes, order)
