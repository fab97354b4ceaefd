import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import kk_shards, lexical_search, part_codes
from sievelight.llm.common import Scratch, join_counted

LOW = {i: i + 32 for i in range(65, 91)}
CLASH = ("term", "block", "part", "shard", "slot", "unit", "split", "row", "code", "n", "rank", "places")


def clashing(df, leave=()):
    return df.withColumns({c: F.lit(1) for c in CLASH if c not in leave})


# --- lexical search -----------------------------------------------------------------------
def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_rank(docs, items, k=10):
    rows = [(i, Counter(terms_of(t))) for i, t in docs]
    rows = [(i, c) for i, c in rows if c]
    n_docs, tokens = len(rows), sum(c.total() for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms_of(t))
    out = []
    for item, terms in wanted.items():
        found = []
        for i, c in rows:
            m = 10 + 90 * c.total() * n_docs // tokens
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


TEXTS = ["The cat, the dog.", "cat dog bird", "Ünï-cödé ünï 2024 a_b", None, "", "... !!", "dog " * 3000 + "cat", "cat dog bird", "x\x00y\x7fz {b} 0", "É é e"]
ITEMS = [(1, "the CAT"), (2, "bird 2024 ünï"), (3, None), (4, "nothing here"), (5, "cat dog the x b"), (None, "dog"), (6, "?!"), (2, "cat"), (7, "É")]


@pytest.mark.parametrize("limit,postings", [(200_000, 1_000_000), (0, 5)])
def test_search_is_brute_force(spark, monkeypatch, limit, postings):
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", postings)
    rows = [*enumerate(TEXTS), (3, "the the cat"), (3, "the the cat"), (None, "cat x"), *[(100 + i, f"cat word{i} dog{i % 3}") for i in range(40)]]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    items = clashing(spark.createDataFrame(ITEMS, "item_id long, text string"))
    got = sorted(map(tuple, lexical_search.search(docs, items, limit=limit).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == brute_rank(rows, ITEMS)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(docs, items).count() == 0
    assert lexical_search.search(spark.createDataFrame([(1, "cat")], docs.schema), items.limit(0)).count() == 0


def test_index_is_kept_and_searched_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c d")], "doc_id long, text string")
    index = lexical_search.Index.build(docs, "kept_postings", f"file://{tmp_path}/postings")
    for text in ("a", "c d", "b"):
        items = spark.createDataFrame([(0, text)], "item_id long, text string")
        assert sorted(map(tuple, index.search(items).collect()), key=str) == brute_rank([(1, "a b"), (2, "b c"), (3, "c d")], [(0, text)])
    assert lexical_search.Index.open(spark, "kept_postings").totals() == (3, 6)
    spark.sql("DROP TABLE kept_postings")


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_pieces_of_long_texts(monkeypatch, piece):
    monkeypatch.setattr(lexical_search, "PIECE", piece)
    for text in (" a bb  ccc Ünï", "longwordlongword" * 5, " longwordlongword" * 5 + " ", "", None, "  ", "ab", "é" * 9):
        assert lexical_search.term_counts(text) == Counter(w.encode() for w in terms_of(text))


# --- shards -------------------------------------------------------------------------------
def plain_differencing(weights, shards):
    """Lists of members: the two partitions of largest spread meet in opposite orders."""
    parts = [[(w, [i])] + [(0, [])] * (shards - 1) for i, w in enumerate(weights)]
    age = list(range(len(parts)))
    while len(parts) > 1:
        first, second = sorted(range(len(parts)), key=lambda k: (parts[k][-1][0] - parts[k][0][0], age[k]))[:2]
        met = [(x + y, m + n) for (x, m), (y, n) in zip(parts[first], parts[second][::-1])]
        parts = [p for k, p in enumerate(parts) if k not in (first, second)] + [sorted(met, key=lambda x: -x[0])]
        age = [a for k, a in enumerate(age) if k not in (first, second)] + [max(age) + 1]
    return parts[0] if parts else []


def test_differencing_by_hand_and_by_lists():
    # 8-7 and 6-5 leave 4, 1, 1; then 4-1 and 3-1 leave a spread of 2
    assert sorted(np.bincount(kk_shards.difference(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]
    rng, spread, greedy = np.random.default_rng(0), 0, 0
    for shards in (2, 3, 7):
        for n in (1, 5, 40, 90):
            w = np.sort(rng.integers(1, 5000, n))[::-1]
            got = kk_shards.difference(w, shards)
            sums = np.bincount(got, weights=w, minlength=shards)
            assert sorted(sums) == sorted(x for x, _ in plain_differencing(w.tolist(), shards))
            loads = [0] * shards
            for x in w.tolist():
                loads[loads.index(min(loads))] += x
            spread, greedy = spread + sums.max() - sums.min(), greedy + max(loads) - min(loads)
    assert spread < greedy  # tighter than giving each weight to the emptiest shard
    assert kk_shards.difference(np.array([], np.int64), 3).tolist() == [] and kk_shards.difference(np.array([5, 3]), 1).tolist() == [0, 0]


@pytest.mark.parametrize("units,limit", [(kk_shards.UNITS, kk_shards.BROADCAST_ROWS), (64, 0)])
def test_shards_are_even_whole_and_gapless(spark, monkeypatch, units, limit):
    monkeypatch.setattr(kk_shards, "BROADCAST_ROWS", limit)
    rng = np.random.default_rng(1)
    rows = [(i, "é" * int(n)) if i % 3 else (i, f"{i} " + "x" * int(n)) for i, n in enumerate(rng.integers(0, 400, 1500))]
    rows += [(5000, None), (5001, ""), (None, "y"), (7, "again"), (7, "again"), *[(6000 + i, "copy") for i in range(30)], (9999, "long " * 9000)]
    got = kk_shards.assign(clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), 8, units).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    of, sums, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        of[r.text_crc32, r.size].add(r.shard), slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert all(len(s) == 1 for s in of.values()) and set(sums) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sums.values()) - min(sums.values()) <= (2 if units > 64 else 600)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_group_beyond_a_shard_stands_alone(spark):
    rows = [(i, "copy of a text " * 20) for i in range(300)] + [(1000 + i, f"own text {i}") for i in range(400)]
    got = kk_shards.assign(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    big = {r.shard for r in got if r.doc_id < 1000}
    rest = Counter()
    for r in got:
        if r.doc_id >= 1000:
            rest[r.shard] += r.size
    assert len(big) == 1 and not big & set(rest) and max(rest.values()) - min(rest.values()) <= 30
    assert kk_shards.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in kk_shards.assign(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 16, 0, "bytes", 0, 0, None)]


def test_written_shards_hold_all_rows(spark, tmp_path):
    rows = [(i, f"text {i % 50} " + "z" * (i % 70)) for i in range(300)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), leave=("shard",)).withColumn("Group_Hash", F.lit("own"))
    kk_shards.write_shards(docs, f"file://{tmp_path}/shards", 4, files=3)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert set(back.columns) == {*docs.columns, "shard"} and back.count() == 300
    assert back.groupBy("text").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    sums = [r.b for r in back.groupBy("shard").agg(F.sum(F.octet_length("text") + 16).alias("b")).collect()]
    assert len(sums) == 4 and max(sums) - min(sums) <= 16


# --- vector codes -------------------------------------------------------------------------
def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    pieces = [[v[p * width : (p + 1) * width] for _, _, v in kept] for p in range(parts)]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))[:entries]
    books = [[list(pieces[p][k]) for k in order] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for x in pieces[p]:
                mine[near(x, books[p])[1]].append(x)
            for k, xs in mine.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out, errors = [], Counter()
    for k, (i, y, _) in enumerate(kept):
        best = [near(pieces[p][k], books[p]) for p in range(parts)]
        out.append([i, "".join(f"{c:02x}" for _, c in best), sum(e for e, _ in best), y])
        errors[y] += out[-1][2]
    return Counter((i, c, e, errors[y]) for i, c, e, y in out), books


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("few", [100_000, 1])
def test_codes_are_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(part_codes, "BROADCAST_ROWS", few)
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in np.float32(v)], int(i % 4) if i % 5 else None) for i, v in enumerate(rng.normal(scale=0.02, size=(150, 32)))]
    rows += [(1000 + i, rows[3][1], 9) for i in range(120)] + [(3, rows[9][1], 1), (None, rows[5][1], 1)]  # copies, a repeated and a null id
    broken = [(2000, None, 1), (2001, [None] * 32, 1), (2002, [float("nan")] * 32, 1), (2003, [float("-inf")] * 32, 1)]
    df = clashing(spark.createDataFrame(rows + broken, VECTORS))
    got = part_codes.encode(df).collect()
    wanted, books = brute_codes([(i, v, y) for i, v, y in rows])
    assert Counter(tuple(r)[:4] for r in got) == wanted
    assert {r.codebooks_sha256 for r in got} == {part_codes.Codebooks(np.array(books)).sha256()}


def test_few_odd_and_no_vectors(spark):
    rows = [(5, [0.5] * 16, 1), (7, [1.0] * 16, None), (6, [0.25] * 5, 1), (1, [], 2), (8, [0.5] * 16, 1)]
    got = {r.vec_id: tuple(r)[1:4] for r in part_codes.encode(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == {5: ("00" * 16, 0, 0), 7: ("01" * 16, 0, 0), 8: ("00" * 16, 0, 0), 6: (None, None, 0), 1: (None, None, None)}
    assert part_codes.encode(spark.createDataFrame([], VECTORS)).count() == 0
    assert [tuple(r) for r in part_codes.encode(spark.createDataFrame([(1, [1.0], 0)], VECTORS)).collect()] == [(1, None, None, None, None)]
    with pytest.raises(Exception, match="too large"):
        part_codes.encode(spark.createDataFrame([(1, [1e30] * 16, 0)], VECTORS)).count()
    with pytest.raises(ValueError):
        part_codes.encode(spark.createDataFrame(rows, VECTORS), entries=300)


def test_codes_can_be_read_back(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v], 0) for i, v in enumerate(rng.integers(-2, 3, size=(40, 16)) / 4)]
    with Scratch(spark) as keep:
        ints = keep.keep(part_codes.integer_vectors(spark.createDataFrame(rows, VECTORS)), "ints")
        books, _ = part_codes.train(ints, 16, 40, 2, keep)
        back = {r.vec_id: r for r in books.decoded(part_codes.encode(spark.createDataFrame(rows, VECTORS), 16, 40)).collect()}
    for i, v, _ in rows:
        assert sum((256 * a - 256 * b) ** 2 for a, b in zip(v, back[i].approximation)) == back[i].error


# --- shared -------------------------------------------------------------------------------
def test_scratch_deletes_after_failure_too(spark, tmp_path):
    with pytest.raises(KeyError), Scratch(spark) as keep:
        kept = keep.keep(spark.range(5), "x")
        files = kept.inputFiles()
        raise KeyError
    import pathlib

    assert files and not any(pathlib.Path(f.removeprefix("file:")).exists() for f in files)


def test_counted_join_keeps_all_rows(spark):
    rows = spark.createDataFrame([(i % 7 if i % 2 else 0, i) for i in range(100)], "k long, v long")
    found = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    for crowded in (1, 10, 1000):
        assert sorted(map(tuple, join_counted(rows, found, ["k"], "n", crowded).select("k", "v", "s").collect())) == sorted(map(tuple, rows.join(found, "k").select("k", "v", "s").collect()))
