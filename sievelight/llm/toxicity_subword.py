"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is a bag: its character n-grams (hashed buckets, with end marks) and itself.
The bag's vector is the mean of their embeddings, and a two-class linear softmax
reads it; a document is as toxic as its most toxic bag, so one insult counts the
same in a short text and in a very long one.

Embeddings and softmax start at random and are trained jointly. While learning, a
document's logit is the soft maximum (log of the mean of exponentials) over its
bags, sharpened from near a mean to near a maximum; in every step a random half of
the words keep only a third of their n-grams, as a misspelling would, so each part
of an insult must carry it. A bucket's step is its gradient over its number of
documents (plus ``PRIOR``), which keeps n-grams of every text from swinging and
those of a single text from passing for an insult.

The settings were chosen by three folds inside the learnable rows (see README).
Training is one task over a bounded sample: at most ``SAMPLE`` documents of each
label in order of a hash of the id; of a text above ``SAMPLE_CHARS`` it takes
``STRETCHES`` stretches spread evenly over the whole text. Scoring covers every
whole text in Arrow batches.

Defined cases: null or wordless text scores the model's value for no evidence;
labels other than 0/1, or null, and labels without document are not learnt from;
a sample without both classes gives the constant share of toxic labels (0 if
there are no labels); rows with equal doc_id are all scored, and of those with
equal label the least text teaches; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of_id, tidied

#: Hash buckets, embedding size, n-gram sizes.
BUCKETS, DIM, GRAMS = 1 << 18, 8, (3, 4)
#: Bounds of the labelled sample: documents of label 0 and of label 1, characters of a document, and the stretches of a longer one.
SAMPLE, SAMPLE_CHARS, STRETCHES = (3000, 1000), 8192, 8
#: Documents that a bucket must occur in to be learnt, and those added to its number in a step.
MIN_DOCS, PRIOR = 3, 50
#: Sharpness of the soft maximum at the first and at the last step.
SHARP = (4.0, 16.0)
#: Share of words thinned in a step, and the part of their n-grams that stays.
THINNED, STAYS = 0.5, 0.35
#: Words a worker remembers before it starts afresh.
CACHE = 200_000

_WORD = re.compile(r"[^\W_]+")


def features(word: str) -> list[int]:
    """Buckets of a word: itself and its n-grams with end marks."""
    marked = f"<{word}>"
    n, mask = len(marked), BUCKETS - 1
    grams = [marked] + [marked[i : i + k] for k in GRAMS if k < n for i in range(n - k + 1)]
    return [crc32(g.encode()) & mask for g in grams]


class Bags(dict):
    """Logit of each word met so far; at most CACHE of them."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = float(self.weights[features(word)].mean())
        return value


class Model:
    """Per-bucket contributions to the logit (embedding times the softmax's class difference) and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def packed(self) -> bytes:
        return np.append(self.weights, self.bias).astype(np.float32).tobytes()

    @classmethod
    def unpacked(cls, packed: bytes) -> Model:
        values = np.frombuffer(packed, np.float32)
        return cls(values[:-1], float(values[-1]))

    def score(self, text: str, bags: Bags) -> float:
        words = set(_WORD.findall(text.lower()))
        top = max(map(bags.__getitem__, words)) if words else 0.0
        return float(1 / (1 + np.exp(-np.clip(top + self.bias, -30, 30))))


def least_loss_bias(best: np.ndarray, y: np.ndarray) -> float:
    """Bias of least log loss for documents whose highest bags are ``best``."""
    places = np.linspace(-best.max() - 1, -best.min() + 1, 1024)
    toxic, clean = best[y == 1], best[y == 0]
    return float(places[int(np.argmin([np.logaddexp(0, -toxic - b).sum() + np.logaddexp(0, clean + b).sum() for b in places]))])


def train(texts: list[str], labels: list[int], steps: int = 100, rate: float = 1.0, seed: int = 7) -> Model:
    """Fit embeddings and softmax jointly by gradient steps over all texts."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in _WORD.findall(t.lower())] or [vocab.setdefault("", len(vocab))], np.int32) for t in texts]
    packed, counts = array("i"), array("i")
    for w in vocab:
        f = features(w)
        packed.extend(f)
        counts.append(len(f))
    del vocab
    flat, sizes = np.array(packed, np.int32), np.array(counts, np.int32)
    del packed, counts
    ends = np.cumsum(sizes)
    seen = np.zeros(BUCKETS)
    for words in docs:
        words = np.unique(words)
        n = sizes[words]
        seen[np.unique(flat[np.arange(n.sum()) + np.repeat(ends[words] - np.cumsum(n), n)])] += 1
    known = seen >= MIN_DOCS
    word_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    kept = known[flat]
    flat, word_of = flat[kept], word_of[kept]
    emb = (rng.normal(0, 0.1 / DIM, (BUCKETS, DIM)) * known[:, None]).astype(np.float32)
    soft = rng.normal(size=DIM).astype(np.float32)
    soft /= np.sqrt(soft @ soft)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    lens = np.array([len(d) for d in docs])
    tokens, starts = np.concatenate(docs), np.cumsum(lens) - lens
    owner = np.repeat(np.arange(len(docs), dtype=np.int32), lens)

    def thinned():
        """Which n-grams of the vocabulary's words a step sees."""
        stays = np.where(rng.random(len(sizes)) < THINNED, STAYS, 1.0).astype(np.float32)
        return rng.random(len(flat), dtype=np.float32) < stays[word_of]

    def bag_logits(z, live):
        return (np.bincount(word_of[live], z[flat[live]], len(sizes)) / sizes)[tokens]

    first = 0.0
    for step in range(steps):
        part = step / max(1, steps - 1)
        sharp = SHARP[0] * (SHARP[1] / SHARP[0]) ** part
        live = thinned()
        bags = bag_logits(emb @ soft, live)
        top = np.maximum.reduceat(bags, starts)
        share = np.exp(sharp * (bags - top[owner]))
        total = np.add.reduceat(share, starts)
        logit = top + np.log(total / lens) / sharp + bias
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
        word_grad = np.bincount(tokens, (share / total[owner]) * error[owner], len(sizes)) / sizes
        grad = np.bincount(flat[live], word_grad[word_of[live]], BUCKETS) / (seen + PRIOR)
        grad = (grad / max(np.abs(grad).max(), 1e-30)).astype(np.float32)
        missing = np.abs(error).sum()
        first = first or missing
        move = rate * (1 - 0.9 * part) * min(1.0, missing / first)
        soft_grad = emb.T @ grad
        soft_grad /= max(1.0, float(np.sqrt(soft_grad @ soft_grad)))
        emb = emb - np.float32(move) * np.outer(grad, soft)
        soft = soft - np.float32(0.1 * move) * soft_grad
        bias -= 2 * move * error.sum()
    z = emb @ soft
    best = np.concatenate([np.maximum.reduceat(bag_logits(z, thinned()), starts) for _ in range(4)])
    return Model(np.where(known, z, 0), least_loss_bias(best, np.tile(y, 4)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, sample: tuple[int, int], sample_chars: int) -> DataFrame:
    """At most ``sample[c]`` (doc_id, label, text) rows of each label c, of bounded size.

    Ids are chosen from the label table alone (the top of a hash order, kept in
    bounded heaps); at most sum(sample) ids are then broadcast to the texts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("int").alias("label")).filter("label_id is not null")
    known = known.filter(learnable)
    picked = [
        known.filter(F.col("label") == c).groupBy("label_id", "label").agg(F.xxhash64("label_id").alias("order")).orderBy("order", "label_id").limit(sample[c]).select("label_id", "label")
        for c in (0, 1)
    ]
    ids = picked[0].unionByName(picked[1])
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = text.join(F.broadcast(ids), F.col("doc_id") == F.col("label_id")).select("doc_id", "label", spread(F.col("text"), sample_chars).alias("text"))
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def spread(text: Column, most: int) -> Column:
    """The text, or of one with more than ``most`` characters STRETCHES stretches spread evenly over it, of ``most`` together."""
    size = most // STRETCHES
    begin = lambda i: F.floor((F.length(text) - size) * F.lit(i) / F.lit(STRETCHES - 1)).cast("int") + 1
    return F.when(F.length(text) <= most, text).otherwise(F.concat_ws(" ", *[F.substring(text, begin(i), F.lit(size)) for i in range(STRETCHES)]))


def learnt(sample: DataFrame, fit) -> bytes | None:
    """Run ``fit(texts, labels) -> bytes`` in one task over a bounded sample; None if it is empty."""

    def run(batches):
        rows = sorted(((r["doc_id"], r["label"], r["text"]) for b in batches for r in b.to_pylist()), key=lambda r: r[:2])
        texts, labels = [r[2] for r in rows], [r[1] for r in rows]
        del rows
        yield pa.RecordBatch.from_arrays([pa.array([fit(texts, labels)], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(tidied(run), "model binary").collect()
    return bytes(found[0].model) if found else None


def toxicity(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model.packed())

    def run(batches):
        own = Model.unpacked(shipped.value)
        bags = Bags(own.weights)
        for batch in batches:
            scores = [own.score(t or "", bags) for t in batch.column(2).to_pylist()]
            flags = [int(s >= 0.5) for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(flags, pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int")


def fitted(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Model learnt from the labelled rows whose crc32(doc_id) mod 5 is not 0."""
    rows = labelled_sample(docs, labels, "toxic", bucket_of_id(F.col("label_id"), 5) != 0, sample, sample_chars)
    packed = learnt(rows, lambda texts, marks: train(texts, marks).packed())
    return Model.unpacked(packed) if packed else train([], [])


def score_documents(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    return toxicity(docs, fitted(docs, labels, **bounds), bucket_of_id(F.col("doc_id"), 5) == 0)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(model.packed())
    place = docs.columns.index("text")

    def run(batches):
        own = Model.unpacked(shipped.value)
        bags = Bags(own.weights)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t or "", bags) < 0.5 for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
