"""Vector codes: every part of an integer vector is replaced by its nearest codebook entry.

Components become floor(``SCALE`` * x); a vector is cut into ``PARTS`` equal consecutive
parts, and each part position has a codebook of its own.

1. Equal integer parts of a position become one weighted row.
2. A codebook starts as that part of the vectors of smallest id. A round assigns every
   distinct part to its nearest entry (squared distance, ties to the lower index) and
   replaces an entry by the floor of its parts' weighted mean; unused entries stay. Tasks
   send a sum for each entry and component, so the driver gets one codebook's numbers.
3. The last assignment is joined back to the vectors by position and part. Parts of very
   many vectors are broadcast in that join, as are labels of very many vectors.

All arithmetic is in 64-bit integers. Defined cases: vectors null or with null or non-finite
components are dropped; the width is that of the smallest vec_id whose vector has a multiple
of ``PARTS`` components and at least one for each, and vectors of other widths are returned
with null code and error; vec_ids may be null (they come last) or repeat (less components
first), each row is returned; fewer vectors than entries give smaller codebooks; a component
beyond ``LARGEST`` is an error, as sums of squares would not be exact; without a fitting
vector the result has no codes, and an empty table an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_counted, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bound on an integer component: its difference squared, summed over 2**7 components, fits 64 bits.
LARGEST = 2**27
#: A key that holds at least this share of all rows is broadcast rather than shuffled.
CROWDED = 1 / 256
#: Distances worked out at once in a task.
CELLS = 2**20
#: Distinct labels up to which their sums are broadcast.
BROADCAST_ROWS = 100_000


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part, ties to the lower entry."""
    codes, errors = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    step = max(1, CELLS // max(1, book.size))
    for at in range(0, len(parts), step):
        gaps = parts[at : at + step, None, :] - book[None]
        distances = np.einsum("ijk,ijk->ij", gaps, gaps)
        best = distances.argmin(axis=1)
        codes[at : at + step], errors[at : at + step] = best, distances[np.arange(len(best)), best]
    return codes, errors


def _parts(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return batch["pos"].to_numpy(zero_copy_only=False), batch["part"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass(frozen=True)
class Codebooks:
    """``entries``: position x entry x component."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assigned(self, distinct: DataFrame) -> DataFrame:
        """pos, part, n of ``distinct`` with ``code`` and ``error``."""
        books, width = self.entries, self.width

        def run(batches):
            for batch in batches:
                pos, parts = _parts(batch, width)
                codes, errors = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
                for p in np.unique(pos):
                    codes[pos == p], errors[pos == p] = nearest(parts[pos == p], books[p])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.astype(np.int32)), pa.array(errors)], [*batch.schema.names, "code", "error"])

        return distinct.mapInArrow(run, "pos int, part array<long>, n long, code int, error long")

    def moved(self, distinct: DataFrame) -> Codebooks:
        """After one round: entries are the floors of their parts' means."""
        books, width = self.entries, self.width

        def run(batches):
            sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                (pos, parts), n = _parts(batch, width), batch["n"].to_numpy()
                for p in np.unique(pos):
                    mine = pos == p
                    codes, _ = nearest(parts[mine], books[p])
                    np.add.at(sums[p], codes, parts[mine] * n[mine, None])
                    np.add.at(counts[p], codes, n[mine])
            used = np.argwhere(counts > 0)
            if len(used):
                p, e, c = (np.repeat(used[:, 0], width), np.repeat(used[:, 1], width), np.tile(np.arange(width), len(used)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, e, c, sums[p, e, c], counts[p, e])], ["p", "e", "c", "total", "n"])

        found = distinct.mapInArrow(run, "p long, e long, c long, total long, n long").groupBy("p", "e", "c").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        new = books.copy()
        for r in found.collect():  # as many rows as the codebooks have numbers
            new[r.p, r.e, r.c] = r.total // r.n
        return Codebooks(new)

    def decoded(self, codes: DataFrame) -> DataFrame:
        """``codes`` with ``approximation``: the vector that each ``code`` stands for, in the original scale."""
        # a literal of the codebooks' size
        books = F.array(*[F.array(*[F.array(*[F.lit(v / SCALE) for v in entry]) for entry in book]) for book in self.entries.tolist()])
        entry = lambda p: F.conv(F.substr(F.col("code"), 2 * p + 1, F.lit(2)), 16, 10).cast("int")
        places = F.sequence(F.lit(0), F.lit(len(self.entries) - 1))
        whole = F.flatten(F.transform(places, lambda p: F.get(F.get(books, p), entry(p))))
        return codes.withColumn("approximation", F.when(F.col("code").isNotNull(), whole))


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label, ints of the vectors whose components are all finite."""
    limit = float("inf")
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < limit, F.lit(False)) & ~F.isnan(x))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    scaled = lambda x: F.floor(x.cast("double") * SCALE)
    checked = lambda x: F.when(F.abs(x.cast("double")) * SCALE > LARGEST, F.raise_error(F.lit("a component is too large for exact sums")).cast("long")).otherwise(scaled(x).cast("long"))
    kept = vectors.filter(F.col("embedding").isNotNull() & finite)
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id"), label.alias("label"), F.transform("embedding", checked).alias("ints"))


def cut(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """row, vec_id, label, pos, part of vectors of ``parts`` * ``width`` components."""
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("ints", p * width + 1, F.lit(width)))
    return rows.filter(F.size("ints") == parts * width).select("row", "vec_id", "label", F.posexplode(pieces).alias("pos", "part"))


def train(rows: DataFrame, parts: int, entries: int, rounds: int, keep: Scratch) -> tuple[Codebooks | None, DataFrame | None]:
    """Codebooks after ``rounds`` rounds over integer vectors, and their distinct parts (pos, part, n)."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("ints")]
    fitting = rows.filter((F.size("ints") > 0) & (F.size("ints") % parts == 0))
    first = fitting.orderBy(*order).select(F.size("ints").alias("n")).first()
    if first is None:
        return None, None
    width = first.n // parts
    start = fitting.filter(F.size("ints") == first.n).orderBy(*order).limit(entries).select("ints").collect()
    books = Codebooks(np.array([r.ints for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2))
    distinct = keep.keep(cut(rows, parts, width).groupBy("pos", "part").agg(F.count("*").alias("n")), "distinct-parts")
    for _ in range(rounds):
        books = books.moved(distinct)
    return books, distinct


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    with Scratch(vectors.sparkSession) as keep:
        rows = keep.keep(integer_vectors(vectors), "integer-vectors")
        books, distinct = train(rows, parts, entries, rounds, keep)
        named = F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256")
        crowded = max(1000, int(rows.count() * CROWDED))
        coded = rows.select("row", "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        if books is not None:
            known = keep.keep(books.assigned(distinct), "part-codes")
            met = join_counted(cut(rows, parts, books.width), known, ["pos", "part"], "n", crowded)
            whole = F.array_sort(F.collect_list(F.struct("pos", "code")))  # one entry a part
            digits = F.array_join(F.transform(whole, lambda s: F.lower(F.lpad(F.hex(s["code"]), 2, "0"))), "")
            fitted = met.groupBy("row", "vec_id", "label").agg(digits.alias("code"), F.sum("error").alias("error"))
            coded = fitted.unionByName(coded.join(rows.filter(F.size("ints") != parts * books.width).select("row"), "row", "left_semi"))
        coded = keep.keep(coded, "vector-codes")
        coded = coded.withColumn("of", F.struct("label"))  # so that null labels are equal
        sums = coded.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
        few = sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        out = coded.join(F.broadcast(sums), "of") if few else join_counted(coded, sums, ["of"], "n", crowded)
        return stored(out.select("vec_id", "code", "error", "label_error", named), "codes")
