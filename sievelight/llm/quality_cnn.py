"""Quality: a byte-level convolutional network in numpy.

Bytes are embedded; filters of eight bytes at every byte slide over the whole document; rectified responses are max-pooled within overlapping chunks of
512 bytes (every 256 bytes), then the chunks' mean and maximum feed one logistic
output. Embedding, filters and output are
trained together by Adam.

Training is one task over a bounded sample: at most ``SAMPLE`` documents of
each label in order of a hash of the id, of a text above ``SAMPLE_CHARS`` some
stretches spread evenly over the whole; the output's bias is then moved to the labels' own shares. Scoring
covers every whole text in Arrow batches, a slice of documents at a time.

Defined cases: null text counts as empty, and empty text is one chunk of padding
with a score like any other; labels other than 0/1, or null, and labels without
document are not learnt from; a sample without both classes gives the constant
share of label 1 (0.5 if there are no labels); rows with equal doc_id are all
scored; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of_id
from .toxicity_subword import labelled_sample, learnt

#: Embedding size, filters, stride, strides that a filter is wide, bytes of half a chunk.
DIM, FILTERS, STRIDE, TAPS, HALF = 8, 16, 1, 8, 256
#: Bounds of the labelled sample: documents of label 0 and of label 1, characters of a document.
SAMPLE, SAMPLE_CHARS = (1000, 1500), 12_288
#: Bytes of text whose responses are held at once.
SLICE_BYTES = 1 << 19
PAD = 256


def halves_of(sizes: np.ndarray) -> np.ndarray:
    """Halves of texts of so many bytes, with room for a filter's width of padding behind."""
    return (np.asarray(sizes) + TAPS * STRIDE + HALF - 1) // HALF


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes of the texts, each padded to whole halves, and the halves of each."""
    halves = halves_of([len(t) for t in texts])
    codes = np.full(int(halves.sum()) * HALF, PAD, np.uint16)
    at = 0
    for t, n in zip(texts, halves):
        codes[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * HALF
    return codes, halves


class Network:
    """Parameters and forward pass."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        wide = STRIDE * DIM
        shapes = {"embed": (PAD + 1, DIM), "taps": (TAPS, wide, FILTERS)}
        scale = {"embed": 0.5, "taps": 0.25}
        p = {k: rng.normal(0, scale[k], s).astype(np.float32) for k, s in shapes.items()}
        p |= {"shift": np.zeros(FILTERS, np.float32), "out": rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32), "bias": np.zeros(1, np.float32)}
        return cls(p)

    @classmethod
    def constant(cls, share: float) -> Network:
        net = cls.fresh()
        net.p["out"] *= 0
        share = float(np.clip(share, 1e-6, 1 - 1e-6))
        net.p["bias"][0] = np.log(share / (1 - share))
        return net

    def responses(self, codes: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter responses at every stride, (halves, positions, filters), and the embedded input."""
        x = self.p["embed"].take(codes, axis=0).reshape(-1, STRIDE * DIM)
        r = x @ self.p["taps"][0]
        for k in range(1, TAPS):
            r[:-k] += x[k:] @ self.p["taps"][k]
        r += self.p["shift"]
        r = r.reshape(-1, HALF // STRIDE, FILTERS)
        r[np.cumsum(halves) - 1, 1 - TAPS :] = 0  # would read into the next document
        return r, x

    def pooled(self, top: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chunk maxima from half maxima, the chunks of each document, their mean and their maximum."""
        ends = np.cumsum(halves)
        keep = np.ones(len(top), bool)
        keep[ends - 1] = halves == 1  # the last half starts no chunk, unless it stands alone
        following = np.append(top[1:], top[-1:], axis=0)
        alone = np.repeat(halves == 1, halves)
        chunk = np.where(alone[:, None], top, np.maximum(top, following))[keep]
        chunks = np.maximum(halves - 1, 1)
        starts = np.cumsum(chunks) - chunks
        return chunk, keep, np.add.reduceat(chunk, starts) / chunks[:, None], np.maximum.reduceat(chunk, starts)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        halves = halves_of([len(t) for t in texts])
        tops, cuts, most_halves, begin = [], np.cumsum(halves), SLICE_BYTES // HALF, 0
        while begin < len(texts):  # whole documents, SLICE_BYTES at a time; a longer one by itself in parts
            base = cuts[begin] - halves[begin]
            end = max(begin + 1, int(np.searchsorted(cuts, base + most_halves, "right")))
            if halves[begin] <= most_halves:
                tops.append(np.maximum(self.responses(*laid_out(texts[begin:end]))[0].max(axis=1), 0))
            else:
                text, n = texts[begin], int(halves[begin])
                for first in range(0, n, most_halves):
                    stop = min(n, first + most_halves)
                    ahead = min(n, stop + 1)  # the last filters of a part read into the next half
                    part = text[first * HALF : ahead * HALF]
                    codes = np.full((ahead - first) * HALF, PAD, np.uint16)
                    codes[: len(part)] = np.frombuffer(part, np.uint8)
                    tops.append(np.maximum(self.responses(codes, np.array([ahead - first]))[0].max(axis=1), 0)[: stop - first])
            begin = end
        _, _, mean, most = self.pooled(np.concatenate(tops), halves)
        z = np.hstack([mean, most]) @ self.p["out"] + self.p["bias"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))

    def gradients(self, codes: np.ndarray, halves: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        r, x = self.responses(codes, halves)
        place = r.argmax(axis=1)
        top = np.take_along_axis(r, place[:, None], 1)[:, 0]
        live = top > 0
        top = np.maximum(top, 0)
        chunk, keep, mean, most = self.pooled(top, halves)
        read = np.hstack([mean, most])
        z = read @ self.p["out"] + self.p["bias"]
        error = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        g = {"out": read.T @ error, "bias": error.sum(keepdims=True)}
        back = error[:, None] * self.p["out"]
        chunks = np.maximum(halves - 1, 1)
        doc = np.repeat(np.arange(len(halves)), chunks)
        d_chunk = back[doc, :FILTERS] / chunks[doc, None]
        is_most = chunk == most[doc]
        share = np.add.reduceat(is_most.astype(np.float32), np.cumsum(chunks) - chunks)
        d_chunk += is_most * back[doc, FILTERS:] / share[doc]
        d_top = np.zeros_like(top)
        lead = np.nonzero(keep)[0]
        follow = np.minimum(lead + (halves[doc] > 1), len(top) - 1)
        second = (top[follow] > top[lead])
        np.add.at(d_top, lead, d_chunk * ~second)
        np.add.at(d_top, follow, d_chunk * second)
        d_top *= live
        rows = (np.arange(len(top))[:, None] * (HALF // STRIDE) + place).ravel()
        d_r = np.zeros((len(x), FILTERS), np.float32)
        d_r[rows, np.tile(np.arange(FILTERS), len(top))] = d_top.ravel()
        for k in range(1, TAPS):
            d_r[(np.cumsum(halves) * (HALF // STRIDE)) - k] = 0
        hit = np.nonzero(d_r.any(axis=1))[0]
        d = d_r[hit]
        g |= {"taps": np.stack([x[hit + k].T @ d for k in range(TAPS)]), "shift": d.sum(axis=0)}
        g["embed"] = np.zeros_like(self.p["embed"])
        grid = codes.reshape(-1, STRIDE)
        for k in range(TAPS):
            np.add.at(g["embed"], grid[hit + k], (d @ self.p["taps"][k].T).reshape(-1, STRIDE, DIM))
        return g


def train(texts: list[bytes], labels: list[int], share: float | None = None, epochs: int = 14, batch: int = 32, rate: float = 0.01, seed: int = 11) -> Network:
    """Fit all layers; ``share`` of label 1 among all labels sets the final bias."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Network.constant(float(y.mean()) if len(y) else 0.5)
    net, rng, step = Network.fresh(seed), np.random.default_rng(seed), 0
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            some = order[at : at + batch]
            grads = net.gradients(*laid_out([texts[i] for i in some]), y[some])
            step += 1
            for k, g in grads.items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= rate * (0.5 if epoch > epochs * 2 // 3 else 1) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if share is not None:
        own, all_of = np.clip([y.mean(), share], 1e-3, 1 - 1e-3)
        net.p["bias"] += np.float32(np.log(all_of / (1 - all_of)) - np.log(own / (1 - own)))
    return net


def fitted(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Network:
    """Network learnt from the labelled rows whose crc32(doc_id) mod 3 is not 1."""
    learnable = bucket_of_id(F.col("label_id"), 3) != 1
    rows = labelled_sample(docs, labels, "quality", learnable, sample, sample_chars)
    marks = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("q")).filter(learnable & F.col("q").isin(0, 1))
    share = marks.agg(F.avg("q")).first()[0]
    packed = learnt(rows, lambda texts, y: pickle.dumps(train([t.encode() for t in texts], y, share).p))
    return Network(pickle.loads(packed)) if packed else Network.constant(0.5 if share is None else share)


def quality(docs: DataFrame, net: Network, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches):
        own = Network(shipped.value)
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            parts, at = [], 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= 4 * SLICE_BYTES):
                    held += len(texts[end])
                    end += 1
                parts.append(own.scores(texts[at:end]))
                at = end
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    return quality(docs, fitted(docs, labels, **bounds), bucket_of_id(F.col("doc_id"), 3) == 1)
