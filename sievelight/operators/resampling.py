"""Cluster bootstrap with weights that each task draws for its own clusters.

A replicate gives every cluster a weight: how often it was drawn. All replicates' weights of
a block of clusters come from one function of the block alone, so nothing is exchanged to
know them, and a task that is run again draws the same:

- ``tree``: the draws of a replicate are split down a binary tree over blocks by conditional
  binomials and inside a block by a multinomial, which is exactly the distribution of
  drawing with replacement. Every node has a counter-based generator of its own.
- ``sequence``: numpy's ``default_rng(seed).integers(0, n, n)``, replicate after replicate.
  Every task goes through the whole sequence, so this suits test sets; its intervals equal
  those of a program that resamples with that generator, draw for draw.

Counts at the threshold are sums over tasks. For AUROC each distinct score carries its
weights of both labels as one vector; scores are sorted by range, each range adds up its
own share for all replicates at once, and the table of ranges, a bounded one, adds the rest.
Place 0 of each vector is the sample itself, every cluster once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import held
from .bootstrap import DRAWS_PER_TASK, ITSELF
from .metrics import rates

#: Clusters whose weights are drawn, and are held, at once.
BLOCK = 512
#: The same where draws are exchanged, and draws that are packed at once.
HASH_BLOCK, PACKED = 2048, 1 << 20
#: Draws of one replicate that a task makes at once.
HASH_CHUNK = 1 << 18
COUNTS = ("tp", "fp", "fn", "tn", "won", "pairs")


class Draw(NamedTuple):
    clusters: int
    replicates: int = 1000
    seed: int = 42
    kind: str = "tree"
    block: int = BLOCK

    def _node(self, node: int) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(key=np.array([self.seed, node], np.uint64)))

    def _size(self, low: int, high: int) -> int:
        """Clusters of the blocks from ``low`` up to ``high``."""
        return min(high * self.block, self.clusters) - low * self.block

    def _tree(self, block: int) -> np.ndarray:
        low, high, node = 0, -(-self.clusters // self.block), 1
        left = np.full(self.replicates, self.clusters, np.int64)
        while high - low > 1:
            middle = (low + high) // 2
            lower = self._node(node).binomial(left, self._size(low, middle) / self._size(low, high))
            if block < middle:
                left, high, node = lower, middle, 2 * node
            else:
                left, low, node = left - lower, middle, 2 * node + 1
        m = self._size(low, high)
        return self._node(node).multinomial(left, np.full(m, 1 / m))

    def _sequence(self, blocks: list[int]) -> dict[int, np.ndarray]:
        rng, found = np.random.default_rng(self.seed), {b: np.empty((self.replicates, self._size(b, b + 1)), np.int64) for b in blocks}
        for r in range(self.replicates):
            drawn = np.bincount(rng.integers(0, self.clusters, self.clusters), minlength=self.clusters)
            for b, rows in found.items():
                rows[r] = drawn[b * self.block : b * self.block + rows.shape[1]]
        return found

    def weights(self, blocks: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """For each block its number and (place, cluster): ones at place 0, then a row a replicate."""
        found = self._sequence(blocks) if self.kind == "sequence" else None
        for b in blocks:
            drawn = found[b] if found else self._tree(b)
            yield b, np.vstack([np.ones((1, drawn.shape[1]), np.int64), drawn])


def _packed(rows: np.ndarray) -> list[bytes]:
    """Weights as bytes where they fit, else as 64-bit integers."""
    return [r.astype(np.uint8).tobytes() if r.max(initial=0) < 256 else r.tobytes() for r in rows]


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == n else np.int64).astype(np.int64)


_NAMES = ["detector", "score", "pos", "neg", *COUNTS]


def _told(detector: str, s0: np.ndarray, s1: np.ndarray, w: np.ndarray, threshold: float) -> tuple[pa.RecordBatch, np.ndarray]:
    """A row for each distinct score of some clusters with the packed weights of both labels, and
    the counts of every place; ``w`` is (place, cluster)."""
    up0, up1 = s0 >= threshold, s1 >= threshold
    won = 2 * (s1 > s0) + (s1 == s0)  # in halves
    sides = np.stack([up1, up0, ~up1, ~up0, won, np.ones(len(won))], axis=1).astype(float)
    counts = (w.astype(float) @ sides).T.astype(np.int64)  # far below 2**53, so exact
    scores, at = np.unique(np.concatenate([s0, s1]), return_inverse=True)
    sums = np.zeros((2, len(scores), len(w)), np.int64)
    np.add.at(sums[0], at[: len(s0)], w.T)
    np.add.at(sums[1], at[len(s0) :], w.T)
    nothing = pa.nulls(len(scores), pa.list_(pa.int64()))
    binary = lambda x: pa.array(_packed(x), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([detector] * len(scores), pa.string()), pa.array(scores, pa.float64()), binary(sums[1]), binary(sums[0]), *[nothing] * len(COUNTS)], _NAMES), counts


def _counted(detector: str, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([detector]), pa.nulls(1, pa.float64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in counts]], _NAMES)


def _hashed(spark, draw: Draw) -> DataFrame:
    """(block, rep, at): the places in the block that the replicate drew, packed as 16-bit integers."""
    blocks = -(-draw.clusters // draw.block)

    def packed(waiting: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rep, number = (np.concatenate(x).astype(np.int64) for x in zip(*waiting))
        key = rep * blocks + number // draw.block
        order = np.argsort(key, kind="stable")
        key, at = key[order], (number % draw.block).astype(np.uint16)[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        ends = np.append(starts, len(at)) * at.itemsize
        data = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(at)])
        return pa.RecordBatch.from_arrays([pa.array((key[starts] % blocks).astype(np.int32)), pa.array((key[starts] // blocks).astype(np.int32)), data], ["block", "rep", "at"])

    # a task has some replicates' draws of the same numbers, so the numbers' digits are written once
    size = min(HASH_CHUNK, max(1, draw.clusters))
    chunks, most = -(-draw.clusters // size), max(1, DRAWS_PER_TASK // size)
    per = max(1, min(most, draw.replicates * chunks // spark.sparkContext.defaultParallelism))
    groups = -(-draw.replicates // per)

    def run(batches):
        """What ``bootstrap.single_draws`` says in SQL functions, without a hex text for each."""
        for task in (i for batch in batches for i in batch["id"].to_pylist()):
            chunk, group = divmod(task, groups)
            digits = [b"%d" % i for i in range(chunk * size, min((chunk + 1) * size, draw.clusters))]
            waiting, n = [], 0
            for rep in range(group * per, min((group + 1) * per, draw.replicates)):
                head = b"%d:%d:" % (draw.seed, rep)
                digests = b"".join([sha256(head + i).digest() for i in digits])
                waiting.append((np.full(len(digits), rep), np.frombuffer(digests, ">u4")[::8].astype(np.int64) % draw.clusters))
                n += len(digits)
                if n >= PACKED:
                    yield packed(waiting)
                    waiting, n = [], 0
            if n:
                yield packed(waiting)

    tasks = chunks * groups
    return spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(run, "block int, rep int, at binary")


def _drawn(wide: DataFrame, detectors: dict[str, float], draw: Draw) -> DataFrame:
    """For each detector rows (score, pos, neg) with packed weights, and one row a task with its counts."""
    n = draw.replicates + 1
    arrays = ", ".join(f"{c} array<long>" for c in COUNTS)

    def run(batches):
        totals = {d: np.zeros((len(COUNTS), n), np.int64) for d in detectors}
        for batch in batches:
            number = batch["cluster_no"].to_numpy(zero_copy_only=False)
            for block, drawn in draw.weights(np.unique(number // draw.block).tolist()):
                mine = number // draw.block == block
                for d, threshold in detectors.items():
                    scores = [batch[f"{d}_{y}"].to_numpy(zero_copy_only=False)[mine].astype(float) for y in (0, 1)]
                    rows, counts = _told(d, *scores, drawn[:, number[mine] - block * draw.block], threshold)
                    totals[d] += counts
                    yield rows
        for d, t in totals.items():
            yield _counted(d, t)

    columns = ["cluster_no", *[f"{d}_{y}" for d in detectors for y in (0, 1)]]
    schema = f"detector string, score double, pos binary, neg binary, {arrays}"
    if draw.kind != "hash":
        return wide.select(*columns).mapInArrow(run, schema)

    def run_block(key: tuple, mine: pa.Table, packed: pa.Table) -> pa.Table:
        number = mine["cluster_no"].to_numpy() - key[0].as_py() * draw.block
        weights = np.zeros((n, draw.block), np.int64)
        weights[0] = 1
        for rep, at in zip(packed["rep"].to_pylist(), packed["at"]):
            weights[rep + 1] += np.bincount(np.frombuffer(at.as_buffer(), np.uint16), minlength=draw.block)
        out = []
        for d, threshold in detectors.items():
            rows, counts = _told(d, *[mine[f"{d}_{y}"].to_numpy().astype(float) for y in (0, 1)], weights[:, number], threshold)
            out += [rows, _counted(d, counts)]
        return pa.Table.from_batches(out)

    block = F.floor(F.col("cluster_no") / draw.block).cast("int").alias("block")
    return wide.select(block, *columns).groupBy("block").cogroup(_hashed(wide.sparkSession, draw).groupBy("block")).applyInArrow(run_block, schema)


def _areas(drawn: DataFrame, draw: Draw) -> DataFrame:
    """(detector, rep, auroc): ranges of scores, then the table of ranges."""
    n = draw.replicates + 1

    def run(batches):
        open_: list = [None, None, None, None]  # detector, score, pos, neg of the score at hand
        first, pos, neg, twice = None, None, None, None  # of the range: first score, sums so far, twice the wins

        def close():
            nonlocal pos, neg, twice
            twice += open_[2] * (2 * neg + open_[3])
            pos, neg = pos + open_[2], neg + open_[3]

        def told():
            return pa.RecordBatch.from_arrays([pa.array([open_[0]]), pa.array([first]), *[pa.array([x.tolist()]) for x in (pos, neg, twice)]], ["detector", "first", "pos", "neg", "twice"])

        for batch in batches:
            for d, s, p, q in zip(*[batch[c].to_pylist() for c in ("detector", "score", "pos", "neg")]):
                p, q = _unpacked(p, n), _unpacked(q, n)
                if d == open_[0] and s == open_[1]:
                    open_[2:] = [open_[2] + p, open_[3] + q]
                    continue
                if open_[0] is not None:
                    close()
                if d != open_[0]:
                    if open_[0] is not None:
                        yield told()
                    first, pos, neg, twice = s, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                open_ = [d, s, p, q]
        if open_[0] is not None:
            close()
            yield told()

    scores = drawn.filter("score is not null").select("detector", "score", "pos", "neg")
    parts = int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = scores.repartitionByRange(parts, "detector", "score").sortWithinPartitions("detector", "score")
    ranges = ranges.mapInArrow(run, "detector string, first double, pos array<long>, neg array<long>, twice array<long>")
    each = ranges.select("detector", "first", F.posexplode(F.arrays_zip("pos", "neg", "twice")).alias("place", "e")).select("detector", "first", "place", "e.*")
    before = Window.partitionBy("detector", "place").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    summed = each.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0))).groupBy("detector", "place")
    area = F.try_divide(F.sum(F.col("twice") + 2 * F.col("pos") * F.col("below")).cast("double"), 2.0 * F.sum("pos") * F.sum("neg"))
    return summed.agg(area.alias("auroc")).select("detector", (F.col("place") - 1).alias("rep"), "auroc")


def replicates(wide: DataFrame, detectors: dict[str, float], draw: Draw) -> DataFrame:
    """(detector, rep, auroc, accuracy, precision, recall, f1, pair_accuracy) of every replicate and,
    as replicate ITSELF, of the sample. ``wide`` is ``bootstrap.pair_table`` of the detectors, which
    are given with their thresholds; all meet the same weights."""
    if draw.kind == "hash":
        draw = draw._replace(block=HASH_BLOCK)
    drawn = held(_drawn(wide, detectors, draw))
    zipped = F.posexplode(F.arrays_zip(*COUNTS)).alias("place", "e")
    counts = drawn.filter("score is null").select("detector", zipped).select("detector", (F.col("place") + ITSELF).alias("rep"), "e.*")
    counts = counts.groupBy("detector", "rep").agg(*[F.sum(c).alias(c) for c in COUNTS])
    counts = counts.withColumn("pair_accuracy", F.try_divide(F.col("won").cast("double"), 2 * F.col("pairs"))).drop("won", "pairs")
    return rates(counts, "tp").join(_areas(drawn, draw), ["detector", "rep"]).select("detector", "rep", "auroc", "accuracy", "precision", "recall", "f1", "pair_accuracy")
