"""Length matching: caliper range join, optimal and greedy one-to-one matches.

Inputs have ``sample_id``, ``label`` (0 factual, 1 hallucinated) and ``length``.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..sources.shared import held


#: Edges that one task of :func:`caliper_edges` makes at most, about.
EDGES_PER_TASK = 4_000_000


def caliper_lengths(rows: DataFrame, caliper: int = 5) -> DataFrame:
    """(l0, l1, gap, n0, n1): lengths of both labels at most ``caliper`` apart, with how many rows
    have them. These are all edges in folded form: a table of lengths, however many rows."""
    width = caliper + 1
    b = F.floor(F.col("length") / width)
    counts = rows.filter("length is not null").groupBy("label", "length").agg(F.count("*").alias("n"))
    left = counts.filter("label = 0").select(F.col("length").alias("l0"), F.col("n").alias("n0"), F.explode(F.array(b - 1, b, b + 1)).alias("b"))
    right = counts.filter("label = 1").select(F.col("length").alias("l1"), F.col("n").alias("n1"), b.alias("b"))
    gap = F.abs(F.col("l0") - F.col("l1"))
    return left.join(right, "b").filter(gap <= caliper).select("l0", "l1", gap.cast("int").alias("gap"), "n0", "n1")


def caliper_edges(rows: DataFrame, caliper: int = 5, per_task: int | None = None) -> DataFrame:
    """(id0, id1, gap) for all cross-label rows whose lengths differ by at most ``caliper``.

    A join on two lengths, for the pairs of lengths that can match. Where a pair of lengths has
    more than ``per_task`` edges its factual rows are dealt to parts by number and its
    hallucinated rows go to every part, so no task makes many more. The result itself has all
    edges; use :func:`caliper_lengths`, :func:`greedy_length_matches` or :func:`optimal_matches`
    where these are too many. Rows without length or label have no edge."""
    per_task = per_task or EDGES_PER_TASK
    pairs = caliper_lengths(rows, caliper)
    parts = F.least(F.col("n0"), F.ceil(F.col("n0") * F.col("n1") / per_task)).cast("int")
    pairs = pairs.select("l0", "l1", "gap", parts.alias("parts"))
    side = lambda y: rows.filter(F.col("label") == y).select(F.col("sample_id").alias(f"id{y}"), F.col("length").alias(f"l{y}"))
    # lengths are few (at most as many as characters of the longest text); Spark broadcasts them where they are small
    left = side(0).join(pairs, "l0").withColumn("part", F.pmod(F.xxhash64("id0"), F.col("parts")))
    right = side(1).join(pairs.filter("parts > 1").select("l0", "l1", "parts"), "l1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    plain = left.filter("parts = 1").join(side(1), "l1").select("id0", "id1", "gap")
    split = left.filter("parts > 1").join(right.select("id1", "l0", "l1", "part"), ["l0", "l1", "part"]).select("id0", "id1", "gap")
    return plain.unionByName(split)


def islands(rows: DataFrame, delta: int) -> DataFrame:
    """``rows`` with ``island``: lengths chain while neighbours differ by at most delta.
    Works on the distinct lengths, of which there are few however many rows."""
    lengths = rows.select("length").distinct()
    w = Window.orderBy("length")
    new = (F.col("length") - F.lag("length").over(w) > delta).cast("int")
    marked = lengths.withColumn("_new", F.coalesce(new, F.lit(0)))
    return rows.join(F.broadcast(marked.select("length", F.sum("_new").over(w).alias("island"))), "length")


def matched_counts(a: np.ndarray, n0: np.ndarray, b: np.ndarray, n1: np.ndarray, delta: int) -> list[tuple[int, int, int]]:
    """(i, j, n): how many rows of length a[i] are matched with rows of length b[j], for ascending
    distinct lengths with n0 and n1 rows: within delta, as many as possible, then of least total gap.

    A flow on lengths, not rows: shortest augmenting ways are found for all lengths at once, and
    everything that fits along ways of the least cost is sent before the next search. Memory is
    one number for each two lengths within delta.
    """
    low, high = np.searchsorted(b, a - delta, "left"), np.searchsorted(b, a + delta, "right")
    ei = np.repeat(np.arange(len(a)), high - low)
    if not len(ei):
        return []
    ej = np.concatenate([np.arange(x, y) for x, y in zip(low, high)])
    cost = np.abs(a[ei] - b[ej]).astype(np.int64)
    free0, free1, flow = n0.astype(np.int64).copy(), n1.astype(np.int64).copy(), np.zeros(len(ei), np.int64)
    by_j = np.argsort(ej, kind="stable")
    at_i, at_j = np.unique(ei, return_index=True), np.unique(ej[by_j], return_index=True)
    ends = [ei.tolist(), (ej + len(a)).tolist()]  # nodes: lengths of a, then those of b
    edges = [[] for _ in range(len(a) + len(b))]
    for e, (i, j) in enumerate(zip(*ends)):
        edges[i].append(e)
        edges[j].append(e)
    far = np.iinfo(np.int64).max // 4
    while True:
        d0, d1 = np.where(free0 > 0, 0, far), np.full(len(b), far)
        while True:  # over every edge, and back over those that carry flow, until nothing gets nearer
            d1[at_j[0]] = np.minimum(d1[at_j[0]], np.minimum.reduceat((d0[ei] + cost)[by_j], at_j[1]))
            back = np.minimum.reduceat(np.where(flow > 0, d1[ej] - cost, far), at_i[1])
            if not (back < d0[at_i[0]]).any():
                break
            d0[at_i[0]] = np.minimum(d0[at_i[0]], back)
        least = d1[free1 > 0].min(initial=far)
        if least >= far // 2:
            return [(int(ei[e]), int(ej[e]), int(flow[e])) for e in np.flatnonzero(flow)]
        _send(edges, ends, (d0[ei] + cost == d1[ej]).tolist(), flow, free0, free1, d0 == 0, d1 == least)


def _send(edges: list[list[int]], ends: list[list[int]], tight: list[bool], flow: np.ndarray, free0: np.ndarray, free1: np.ndarray, source: np.ndarray, goal: np.ndarray) -> None:
    """Send all that fits from free sources to free goals over ``tight`` edges, along ways of
    fewest edges; ``flow``, ``free0`` and ``free1`` are changed."""
    n = len(free0)
    usable = lambda v, e: tight[e] and (v < n or flow[e] > 0)
    other = lambda v, e: ends[1][e] if v < n else ends[0][e]
    starts = np.flatnonzero(source & (free0 > 0)).tolist()
    level, front = dict.fromkeys(starts, 0), starts
    while front and not any(v >= n and goal[v - n] and free1[v - n] > 0 for v in front):
        after = []
        for v in front:
            for e in edges[v]:
                if usable(v, e) and (u := other(v, e)) not in level:
                    level[u] = level[v] + 1
                    after.append(u)
        front = after
    tried = dict.fromkeys(level, 0)
    for start in starts:
        way: list[int] = []  # edges from start to the node at hand
        v = start
        while free0[start] > 0:
            if v >= n and goal[v - n] and free1[v - n] > 0:
                amount = min(free0[start], free1[v - n], *[flow[e] for e in way[1::2]])
                flow[way[::2]] += amount
                flow[way[1::2]] -= amount
                free0[start] -= amount
                free1[v - n] -= amount
                way, v = [], start
                continue
            while tried[v] < len(edges[v]):
                e = edges[v][tried[v]]
                if usable(v, e) and level.get(u := other(v, e)) == level[v] + 1:
                    break
                tried[v] += 1
            if tried[v] < len(edges[v]):
                way.append(e)
                v = u
            elif way:  # a dead end: back, and on to the next edge there
                e = way.pop()
                v = ends[0][e] if v >= n else ends[1][e]
                tried[v] += 1
            else:
                break


def optimal_matches(rows: DataFrame, delta: int = 1) -> DataFrame:
    """(id0, id1, gap): one-to-one matches within delta, as many as possible, then of least total gap.

    Counts of lengths are matched, each island (a stretch of adjacent lengths) in one task; its
    memory grows with the distinct lengths, not with the rows. Rows are then dealt by their
    number within label and length, in the order of their ids, so a crowded length is never one
    task either. Ids are unique; rows without length or label are left out."""
    from .splits import numbered

    rows = rows.filter("length is not null and label in (0, 1)").select("sample_id", "label", "length")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = numbered(rows, ["label", "length", "sample_id"], "_at", parts)
    counts = placed.groupBy("label", "length").agg(F.count("*").alias("n"), F.min("_at").alias("first"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        side = [pdf[pdf["label"] == y].sort_values("length") for y in (0, 1)]
        (a, n0), (b, n1) = [(s["length"].to_numpy(np.int64), s["n"].to_numpy(np.int64)) for s in side]
        used0, used1, out = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), []
        for i, j, n in matched_counts(a, n0, b, n1, delta):
            out.append((int(a[i]), int(b[j]), int(used0[i]), int(used1[j]), n))
            used0[i], used1[j] = used0[i] + n, used1[j] + n
        return pd.DataFrame(out, columns=["l0", "l1", "start0", "start1", "n"])

    cut = islands(counts, delta)
    found = held(cut.groupBy("island").applyInPandas(solve, "l0 long, l1 long, start0 long, start1 long, n long"))

    def dealt(y: int) -> DataFrame:
        """Rows of label ``y`` with the pair of lengths that they serve and their place in it."""
        first = counts.filter(F.col("label") == y).select(F.col("length").alias(f"l{y}"), "first")
        own = placed.filter(F.col("label") == y).select(F.col("sample_id").alias(f"id{y}"), F.col("length").cast("long").alias(f"l{y}"), "_at")
        numbers = own.join(first, f"l{y}").join(found.select("l0", "l1", f"start{y}", "n"), f"l{y}")
        place = F.col("_at") - F.col("first") - F.col(f"start{y}")
        return numbers.withColumn("place", place).filter("place >= 0 and place < n").select("l0", "l1", "place", f"id{y}")

    return dealt(0).join(dealt(1), ["l0", "l1", "place"]).select("id0", "id1", F.abs(F.col("l0") - F.col("l1")).cast("int").alias("gap"))


def matched_rows(matches: DataFrame, rows: DataFrame, delta: int) -> DataFrame:
    """``rows`` of matches (id0, id1) with ``match_id``, numbered from 0 in order of the factual id."""
    from .splits import numbered

    named = numbered(matches.select("id0", "id1"), ["id0"], "_no").select(F.format_string(f"d{delta}_m%04d", "_no").alias("match_id"), F.explode(F.array("id0", "id1")).alias("sample_id"))
    return rows.drop("match_id").join(named, "sample_id")


def controlled_set(test: DataFrame, delta: int = 1) -> DataFrame:
    """The length-controlled part of test samples (with answer): optimal matches, checked, with match ids."""
    from .validate import require_none

    sized = test.select("sample_id", "label", F.length("answer").alias("length"))
    out = matched_rows(optimal_matches(sized, delta), test, delta)
    require_none(match_violations(out.withColumn("length", F.length("answer")), delta), "broken matches")
    return out


def greedy_matches(edges: DataFrame) -> DataFrame:
    """Greedy one-to-one matches of (id0, id1, gap) edges in the order (gap, id0, id1).

    In each round every edge that is the first of both its ends is taken and the
    ends' other edges go, until no edge is left; that gives what taking edges one by
    one gives. Rounds are cut by checkpoints. Where many ends share their edges a
    round may take a single one: for lengths use :func:`greedy_length_matches`.
    """
    left = edges.select("id0", "id1", "gap")
    taken, rounds = None, 0
    while True:
        key = F.struct("gap", "id0", "id1")
        first0 = left.groupBy("id0").agg(F.min(key).alias("k")).select("k")
        first1 = left.groupBy("id1").agg(F.min(key).alias("k")).select("k")
        now = first0.join(first1, "k").select("k.id0", "k.id1", "k.gap").checkpoint()
        if now.isEmpty():
            break
        taken, rounds = now if taken is None else taken.unionByName(now), rounds + 1
        if rounds % 50 == 0:  # keeps the plan short
            taken = taken.checkpoint()
        left = left.join(now.select("id0"), "id0", "left_anti").join(now.select("id1"), "id1", "left_anti").checkpoint()
    return taken if taken is not None else left


def greedy_length_matches(rows: DataFrame, caliper: int = 5) -> DataFrame:
    """What :func:`greedy_matches` gives for :func:`caliper_edges`, without the edges.
    Ids are unique; rows without length or label are left out, as they have no edge.

    Edges come gap by gap. Rows of one length are matched in id order, so gap 0 is
    a join by number within label and length, which leaves one label at each length.
    At a larger gap each factual row in id order takes the lower of the first free
    ids at the two lengths that far away; that is sequential within a chain of
    lengths of alternating label, which is read by one task.
    """
    nth = F.row_number().over(Window.partitionBy("label", "length").orderBy("sample_id"))
    numbered = rows.filter("length is not null").select("sample_id", "label", "length", nth.alias("nth"))
    side = lambda y: numbered.filter(F.col("label") == y).select(F.col("sample_id").alias(f"id{y}"), "length", "nth")
    both = side(0).join(side(1), ["length", "nth"], "full").checkpoint()
    taken = both.filter("id0 is not null and id1 is not null").select("id0", "id1", F.lit(0).alias("gap"))
    left = both.filter("id0 is null or id1 is null").select(F.coalesce("id0", "id1").alias("sample_id"), F.col("id0").isNull().cast("int").alias("label"), "length")
    for gap in range(1, caliper + 1):
        now = _chains(left, gap).groupBy("rest", "chain").applyInPandas(_taker(gap), "id0 string, id1 string, gap int").checkpoint()
        taken = taken.unionByName(now)
        if gap < caliper:
            used = now.select(F.explode(F.array("id0", "id1")).alias("sample_id"))
            left = left.join(used, "sample_id", "left_anti").checkpoint()
    return taken


def _taker(gap: int):
    """Matches of a chain's rows at ``gap``, factual rows in id order."""

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        free = {n: sorted(ids, reverse=True) for n, ids in pdf[pdf["label"] == 1].groupby("length")["sample_id"]}
        out = []
        for i, n in sorted(pdf[pdf["label"] == 0][["sample_id", "length"]].itertuples(index=False, name=None)):
            ends = [free[m] for m in (n - gap, n + gap) if free.get(m)]
            if ends:
                out.append((i, min(ends, key=lambda ids: ids[-1]).pop(), gap))
        return pd.DataFrame(out, columns=["id0", "id1", "gap"])

    return take


def _chains(rows: DataFrame, gap: int) -> DataFrame:
    """Rows of lengths that can match at ``gap``, with ``rest`` and ``chain``: lengths chain
    while the next one is ``gap`` away and has the other label. A length has one label."""
    lengths = rows.select("length", "label").distinct().withColumn("rest", F.pmod(F.col("length"), F.lit(gap)))
    w = Window.partitionBy("rest").orderBy("length")
    linked = (F.col("length") - F.lag("length").over(w) == gap) & (F.col("label") != F.lag("label").over(w))
    marked = lengths.withColumn("_new", F.when(linked, 0).otherwise(1)).withColumn("chain", F.sum("_new").over(w))
    some = F.count("*").over(Window.partitionBy("rest", "chain")) > 1
    return rows.join(F.broadcast(marked.withColumn("_some", some).filter("_some").select("length", "rest", "chain")), "length")


def nearest_free(factual: list[tuple[str, int]], hallucinated: list[tuple[str, int]]) -> list[tuple[str, str, int]]:
    """Each of ``factual`` (id, length), in order, takes the nearest free length of ``hallucinated``
    (in order of their ids; of equally near ones the lower id). A length that is used up points
    to the next one still free on either side, so a look-up costs next to nothing."""
    lengths = sorted({n for _, n in hallucinated})
    waiting: dict[int, list[str]] = {n: [] for n in lengths}
    for i, n in reversed(hallucinated):
        waiting[n].append(i)  # the lowest id last
    stacks = [waiting[n] for n in lengths]
    up, down = list(range(len(lengths) + 1)), list(range(len(lengths) + 1))  # down is shifted by one: 0 is no length

    def free(towards: list[int], k: int) -> int:
        end = k
        while towards[end] != end:
            end = towards[end]
        while towards[k] != end:
            towards[k], k = end, towards[k]
        return end

    out = []
    for i, n in factual:
        at = bisect.bisect_left(lengths, n)
        ends = [k for k in (free(down, at) - 1, free(up, at)) if 0 <= k < len(lengths)]
        if not ends:
            break
        k = min(ends, key=lambda k: (abs(lengths[k] - n), stacks[k][-1]))
        out.append((i, stacks[k].pop(), abs(lengths[k] - n)))
        if not stacks[k]:
            up[k], down[k + 1] = k + 1, k
    return out


def nearest_greedy(rows: DataFrame) -> DataFrame:
    """Each factual row in id order takes the nearest free hallucinated length (ties: lower id).

    Order dependent by definition and without a caliper: meant for one controlled set, whose
    ids and lengths are read by one task in n log n steps; it isn't a control for length.
    Rows without length or label are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_id")
        side = [list(zip(p["sample_id"].tolist(), p["length"].tolist())) for p in (pdf[pdf["label"] == y] for y in (0, 1))]
        return pd.DataFrame(nearest_free(*side), columns=["id0", "id1", "gap"])

    whole = rows.filter("length is not null and label is not null").select("sample_id", "label", "length")
    return whole.groupBy(F.lit(0).alias("_one")).applyInPandas(run, "id0 string, id1 string, gap int")


def match_violations(matched: DataFrame, delta: int) -> DataFrame:
    """Matches (match_id, label, length) that lack a row of either label, exceed the gap, or
    hold a sample that also stands in another match."""
    reused = (F.count("*").over(Window.partitionBy("sample_id")) > 1).cast("int") if "sample_id" in matched.columns else F.lit(0)
    g = matched.withColumn("_reused", reused).groupBy("match_id").agg(
        F.count("*").alias("n"), F.countDistinct("label").alias("labels"), (F.max("length") - F.min("length")).alias("gap"), F.max("_reused").alias("reused")
    )
    return g.filter((F.col("n") != 2) | (F.col("labels") != 2) | (F.col("gap") > delta) | (F.col("reused") > 0))


def artefact_checks(matched: DataFrame, test: DataFrame, delta: int, expected: int) -> DataFrame:
    """(name, ok, n_problems): the nine properties of a written controlled set of ``expected`` rows."""
    from .validate import checks

    own = matched.withColumn("length", F.length("answer"))
    groups = own.groupBy("match_id").agg(F.count("*").alias("n"), F.sum("label").alias("n1"), F.countDistinct("label").alias("labels"), (F.max("length") - F.min("length")).alias("gap"))
    size = own.agg(F.count("*").alias("n"), F.sum((F.col("label") == 0).cast("int")).alias("n0"), F.countDistinct("match_id").alias("m"))
    repeats = own.groupBy("sample_id").count().filter("count > 1")
    same = ["sample_id", *[c for c in ("pair_id", "language", "question", "knowledge", "answer", "label") if c in test.columns and c in matched.columns]]
    stored = own.filter(F.col("answer_length_chars") != F.col("length")).select("match_id") if "answer_length_chars" in own.columns else own.select("match_id").limit(0)
    return checks(
        [
            ("row count", size.filter(F.col("n") != expected)),
            ("class balance", size.filter(F.col("n0") * 2 != F.col("n"))),
            ("sample_id uniqueness", repeats),
            ("match_id structure", groups.filter("n <> 2").select("match_id").unionByName(size.filter(F.col("m") * 2 != expected).select(F.lit("").alias("match_id")))),
            ("one of each label per match", groups.filter("n <> 2 or labels <> 2")),
            ("length tolerance", groups.filter(F.col("gap") > delta).select("match_id").unionByName(stored)),
            ("source membership", own.join(test.select("sample_id"), "sample_id", "left_anti")),
            ("no sample reuse", repeats),
            ("content preservation", own.join(test.select(*same), same, "left_anti")),
        ]
    )


def match_summary(matches: DataFrame, rows: DataFrame) -> DataFrame:
    """Number and gaps of (id0, id1, gap) matches, the share of ``rows`` they cover, the
    lengths and words of both matched classes, and the KS distance of the two lengths.

    ``rows`` have sample_id, label, length and words. Without matches all but counts is null."""
    names = {0: "factual", 1: "hallucinated"}
    both = matches
    for y in names:
        both = both.join(rows.select(F.col("sample_id").alias(f"id{y}"), F.col("length").alias(f"length{y}"), F.col("words").alias(f"words{y}")), f"id{y}")
    both = held(both)
    median = lambda c: F.percentile(c, F.lit(0.5))
    spread = lambda c: F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c))
    values = [F.count("*").alias("n_matches"), F.avg("gap").alias("mean_gap"), median("gap").alias("median_gap"), F.max("gap").alias("max_gap"), F.sum("gap").cast("long").alias("total_gap")]
    for y, name in names.items():
        values += [f(f"length{y}").alias(f"{name}_{n}_length") for n, f in (("mean", F.avg), ("median", median), ("std", spread), ("min", F.min), ("max", F.max))]
        values += [f(f"words{y}").alias(f"{name}_{n}_words") for n, f in (("mean", F.avg), ("median", median))]
    ends = both.select(F.explode(F.array(*[F.struct(F.lit(y).alias("label"), F.col(f"length{y}").alias("length")) for y in names])).alias("e")).select("e.*")
    out = both.agg(*values).join(F.broadcast(rows.agg(F.count("*").alias("n_rows")))).join(F.broadcast(stats.ks_statistic(ends, "length", "label", "ks_statistic")))
    p_value = F.udf(stats.ks_p_value_equal, "double")  # called for the one row of the summary
    return out.withColumn("coverage_percent", F.try_divide(200.0 * F.col("n_matches"), F.col("n_rows"))).withColumn("ks_p_value", p_value("n_matches", "ks_statistic"))
