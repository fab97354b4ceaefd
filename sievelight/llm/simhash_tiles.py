"""SimHash near-duplicates by exact tiled comparison.

Distinct fingerprints are packed into tiles that share the population counts of
their four 16-bit words. Two fingerprints at Hamming distance r differ in these
counts by at most r in sum, so a tile pair whose counts are farther apart than
the radius is skipped; every other pair is compared whole by numpy XOR and bit
counts. A tile pair yields at most one edge for each of its fingerprints (a
spanning forest of what it links), never all pairs, and components come from
alternating star contraction over stored edge tables.

Defined cases: null text counts as empty; text without words has fingerprint
zero, linked like any other; rows with equal doc_id are all returned; a null
doc_id is returned and never names a component unless all members are null
(then null); of rows with equal id and text one can represent a component; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_ASCII, stored, tidied, unused

#: Fingerprints in a tile; a crowded set of counts is dealt to several tiles.
TILE = 4096
#: Shingles of one text hashed together, a bound on a worker's arrays.
SHINGLES = 65_536
#: Documents from which a fingerprint is crowded, and the share of all from which it is whatever the number.
CROWD, CROWD_SHARE = 200, 1e-4
#: Word widths whose population counts name a tile, and the base that packs them.
WORDS, BITS, BASE = 4, 16, 17

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Majority fingerprint (unsigned) of the word shingles of UTF-8 ``text``, SHINGLES of them at a time."""
    words = text.translate(LOWER_ASCII).split()
    if not words:
        return 0
    total = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, SHINGLES):
        ones += _set_bits(words[at : at + SHINGLES + shingle - 1], shingle, seed)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _set_bits(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """How many shingle hashes of consecutive words have each bit set."""
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = digest(joined, seed)
    else:
        ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
        starts = [0, *(e + 1 for e in ends[:-shingle])]
        hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :])])
    grid = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    if len(grid) < 256:
        return np.unpackbits(grid, axis=1).sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(grid[:, j], minlength=256) @ _BYTE_BITS for j in range(8)])


def text_hash(text):
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())  # one text at a time leaves Arrow
            fps = np.array([fingerprint(t.as_py() or b"", shingle, seed) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash(F.col("text")).alias("text_hash"))
    return rows.mapInArrow(tidied(run), "doc_id long, text_hash long, fp long")


def linked(left: np.ndarray, right: np.ndarray, radius: int, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within radius between two tiles: (node, root) arrays."""
    nodes = np.concatenate([left, right])
    label = np.arange(len(nodes))
    for at in range(0, len(left), rows):
        near = np.bitwise_count(left[at : at + rows, None] ^ right[None, :]) <= radius
        u, v = np.nonzero(near)
        u, v = u + at, v + len(left)
        while len(u):
            low = np.minimum(label[u], label[v])
            if (low == label[u]).all() and (low == label[v]).all():
                break
            np.minimum.at(label, label[u], low)
            np.minimum.at(label, label[v], low)
            label = label[label]
    while (label[label] != label).any():
        label = label[label]
    moved = nodes[label] != nodes
    return nodes[moved], nodes[label][moved]


def _counts(fp):
    return [F.bit_count(F.shiftrightunsigned(fp, BITS * k).bitwiseAND(F.lit(0xFFFF).cast("long"))) for k in range(WORDS)]


def _packed(counts):
    out = F.lit(0)
    for c in counts:
        out = out * BASE + c
    return out.cast("int")


def links(nodes: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """(a, b) edges, b the smaller, that connect exactly the fingerprints within radius.

    ``nodes`` has distinct ``fp``. The table of tile sizes has at most 17^4 rows
    whatever the input, so it is safe to broadcast.
    """
    placed = nodes.select("fp", _packed(_counts(F.col("fp"))).alias("sig"))
    sizes = placed.groupBy("sig").agg(F.count("*").alias("n")).select("sig", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    tiles = (
        placed.join(F.broadcast(sizes), "sig")
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int"))
        .groupBy("sig", "part")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = stored(tiles, "simhash-tiles")
    deltas = [d for d in product(range(-radius, radius + 1), repeat=WORDS) if sum(map(abs, d)) <= radius and d >= (0,) * WORDS]
    digits = [(F.floor(F.col("sig") / BASE ** (WORDS - 1 - k)) % BASE).cast("int") for k in range(WORDS)]
    moves = F.array(*[F.struct(*[(digits[k] + d[k]).alias(f"d{k}") for k in range(WORDS)]) for d in deltas])
    inside = [F.col(f"m.d{k}").between(0, BITS) for k in range(WORDS)]
    near = sizes.select("sig", "parts", F.explode(moves).alias("m"))
    for test in inside:
        near = near.filter(test)
    near = near.select(F.col("sig").alias("sig_a"), F.col("parts").alias("parts_a"), _packed([F.col(f"m.d{k}") for k in range(WORDS)]).alias("sig_b"))
    other = sizes.select(F.col("sig").alias("sig_b"), F.col("parts").alias("parts_b"))
    pairs = (
        near.join(F.broadcast(other), "sig_b")
        .withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1)))
        .withColumn("part_b", F.explode(F.sequence(F.when(F.col("sig_a") == F.col("sig_b"), F.col("part_a")).otherwise(0), F.col("parts_b") - 1)))
    )
    side = lambda x: tiles.select(F.col("sig").alias(f"sig_{x}"), F.col("part").alias(f"part_{x}"), F.col("fps").alias(f"fps_{x}"))
    work = pairs.join(side("a"), ["sig_a", "part_a"]).join(side("b"), ["sig_b", "part_b"]).select("fps_a", "fps_b")

    def compare(batches):
        for batch in batches:
            out = []
            for a, b in zip(batch.column(0), batch.column(1)):
                left, right = (np.asarray(x.values).view(np.uint64) for x in (a, b))
                node, root = linked(left, right, radius)
                if len(node):
                    out.append(np.stack([node, root]).view(np.int64))
            if out:
                e = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(e.max(axis=0)), pa.array(e.min(axis=0))], ["a", "b"])

    return work.mapInArrow(tidied(compare), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the component's least node.

    Alternating large-star and small-star steps; every round is a stored table,
    so lineage stays short and no edge reaches the driver.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after_df = stored(small.filter("a <> b").distinct(), "cc")
        after = mark(after_df)
        now = after_df
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def classed(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42, tile: int = TILE) -> DataFrame:
    """doc_id, text_hash, fp of every document, with ``first``: the least (id is null, id, text_hash) of its component.

    Documents meet their class by fingerprint. Crowded fingerprints are known from the
    partial counts; there are at most 1 / CROWD_SHARE of them, so their classes are
    broadcast and the documents that share them stay where they are.
    """
    prints = stored(fingerprints(docs, shingle, seed), "simhash")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    nodes = stored(prints.groupBy("fp").agg(least.alias("own"), F.count("*").alias("n")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius, tile))
    joined = nodes.join(roots, nodes.fp == roots.node).select("fp", "own", "root")
    named = joined.join(joined.groupBy("root").agg(F.min("own").alias("of_all")), "root").select("fp", "of_all")
    classes = stored(nodes.join(named, "fp", "left").select("fp", "n", F.coalesce("of_all", "own").alias("first")), "simhash-classes")
    crowd = max(CROWD, int(CROWD_SHARE * (nodes.agg(F.sum("n")).first()[0] or 0)))
    crowded = classes.filter(F.col("n") >= crowd).select("fp", "first")
    here = prints.join(F.broadcast(crowded), "fp")
    there = prints.join(F.broadcast(crowded.select("fp")), "fp", "left_anti").join(classes.filter(F.col("n") < crowd).select("fp", "first"), "fp")
    return here.unionByName(there).select("doc_id", "text_hash", "fp", "first")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    found = classed(docs, **options)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, all columns: the least id, then the least text
    hash (documents without id come last). Of rows with that id and text the one whose
    columns hash least stays, a null text before an empty one."""
    mark, order, mine, theirs = unused(docs, "kept_mark", "kept_order", "kept_id", "kept_hash")
    kept = classed(docs, **options).select(F.col("first.doc_id").alias(mine), F.col("first.text_hash").alias(theirs)).distinct()
    every = F.struct(docs["text"].isNotNull(), F.xxhash64(*[F.to_json(F.struct(c)) if dict(docs.dtypes)[c].startswith("map") else docs[c] for c in docs.columns]))
    rows = docs.withColumns({mark: text_hash(F.col("text")), order: every})
    found = rows.join(kept, rows["doc_id"].eqNullSafe(kept[mine]) & (rows[mark] == kept[theirs]), "left_semi")
    first = Window.partitionBy("doc_id", mark).orderBy(order)
    return found.withColumn(mine, F.row_number().over(first)).filter(F.col(mine) == 1).select(*docs.columns)
