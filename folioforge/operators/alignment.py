"""Alignment of two ordered sides of a pair, as rows: which elements are equal.

Elements are rows (pair_id, side 0 or 1, ix, code); equal codes are equal elements. A pair is a range on both
sides. Common ends of a range are equal. A rest of more than ``ANCHOR_LEAST`` elements is cut at its anchors, the codes that are
there once on each side, as far as they rise on both; what lies between is a range of its own, and met in the next round. Rests that
are shorter, or without anchors, are compared by shortest edits, a rest to a row.

Rounds are joins, aggregates and windows over elements: a long pair is in many tasks. Anchors with all earlier ones before them on
both sides, and all later ones after, are in every longest rising choice, and cut the others into pieces, which are
chosen from one by one. What one task must hold is the codes of a rest without anchors, or the places of the anchors of one piece.

Of shortest edits there are several; here an insertion goes first where it reaches at least as far. Beyond ``edit_limit`` edits
nothing of a rest is equal; None sets no limit.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.batches import vectorized
from folioforge.functions.scan import before
from folioforge.functions.scratch import paired, stored

EDIT_LIMIT, ANCHOR_LEAST = 1500, 400
#: Frontiers between those that are kept; the ones between are made again on the way back.
STRIDE = 256
#: Up to so many edits, diagonals are met one by one.
FEW = 64
#: Up to so many places of one side times those of the other, common subsequences are counted in bits, half a megabyte of them.
CELLS = 1 << 22

Match = tuple[int, int]
Op = tuple[str, int, int]  # equal, delete or insert; place in a; place in b (-1 where there is none)
RANGE = ["pair_id", "a0", "b0"]


def increasing(values: Sequence[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    previous = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        previous[i] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [v], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = previous[i]
    return out[::-1]


def _further(a: np.ndarray, b: np.ndarray, reach: np.ndarray, d: int) -> tuple[np.ndarray, bool]:
    """How far into ``a`` d edits lead on each diagonal (-d, -d + 2, ..., d), from what d - 1 edits do; whether they lead to the end."""
    n, m = len(a), len(b)
    x = np.zeros(d + 1, np.int32)
    if d:
        x[0], x[d] = reach[0], reach[-1] + 1
        x[1:d] = np.where(reach[:-1] < reach[1:], reach[1:], reach[:-1] + 1)
    y = x + np.arange(d, -d - 1, -2, dtype=np.int32)
    live = np.flatnonzero((x < n) & (y < m))
    while len(live := live[a[x[live]] == b[y[live]]]):
        x[live] += 1
        y[live] += 1
        live = live[(x[live] < n) & (y[live] < m)]
    return x, bool(((x >= n) & (y >= m)).any())


def _further_few(a: list, b: list, reach: list[int], d: int) -> tuple[list[int], bool]:
    """The same for few edits, one diagonal after another."""
    n, m = len(a), len(b)
    out = [0] * (d + 1)
    for t in range(d + 1):
        x = 0 if d == 0 else reach[t] if t == 0 or (t != d and reach[t - 1] < reach[t]) else reach[t - 1] + 1
        y = x + d - 2 * t
        while x < n and y < m and a[x] == b[y]:
            x, y = x + 1, y + 1
        out[t] = x
        if x >= n and y >= m:
            return out, True
    return out, False


def _edits_by_bits(a: Sequence, b: Sequence, most: int) -> list[Op] | None:
    """The script of ``shortest_edits`` for short sides. A row of bits for each place of ``a``: bit j is 0 where the longest common
    subsequence of what is before the places grows from j to j + 1. The furthest points that the frontiers keep are those where neither
    neighbour has as long a one; so on the way back an insertion goes first, then a deletion."""
    x, y, v = len(a), len(b), (1 << len(b)) - 1
    whole, places = v, {}
    for j, code in enumerate(b):
        places[code] = places.get(code, 0) | 1 << j
    rows = [v]
    for code in a:
        if code in places:
            met = v & places[code]
            v = (v + met | v - met) & whole
        rows.append(v)
    if x - y + 2 * v.bit_count() > most:
        return None
    out: list[Op] = []
    while x and y:
        bit = 1 << y - 1
        if rows[x] & bit:
            y -= 1
            out.append(("insert", -1, y))
        else:
            x -= 1
            if rows[x] & bit:
                y -= 1
                out.append(("equal", x, y))
            else:
                out.append(("delete", x, -1))
    out += [("insert", -1, j) for j in range(y - 1, -1, -1)] or [("delete", i, -1) for i in range(x - 1, -1, -1)]
    return out[::-1]


def shortest_edits(a: Sequence, b: Sequence, limit: int | None = EDIT_LIMIT, cells: int = CELLS) -> list[Op] | None:
    """A shortest edit script, in order; None beyond the limit. Sides of few ``cells`` are met in bits; for others every STRIDE-th frontier
    is kept, so that memory grows with the edits times STRIDE, not with their square."""
    most = len(a) + len(b) if limit is None else min(len(a) + len(b), limit)
    if len(a) * len(b) <= cells:
        return _edits_by_bits(a, b, most)
    number: dict = {}
    few = [number.setdefault(v, len(number)) for v in a], [number.setdefault(v, len(number)) for v in b]
    many = tuple(np.array(side, np.int32) for side in few)

    def further(reach: Sequence[int], d: int) -> tuple[Sequence[int], bool]:
        if d < FEW:
            return _further_few(*few, reach, d)
        return _further(*many, np.asarray(reach, np.int32), d)

    kept: dict[int, Sequence[int]] = {}
    recent: dict[int, Sequence[int]] = {}
    reach, d = [], 0
    while True:
        if d % STRIDE == 0:
            kept[d], recent = reach, {}
        recent[d] = reach
        reach, there = further(reach, d)
        if there:
            break
        d += 1
        if d > most:
            return None
    out: list[Op] = []
    x, y = len(a), len(b)
    for step in range(d, -1, -1):
        if step not in recent:
            at = step // STRIDE * STRIDE
            recent = {at: kept.pop(at)}
            for s in range(at, step):
                recent[s + 1] = further(recent[s], s)[0]
        seen = recent[step]
        t = (x - y + step) // 2
        down = step > 0 and (t == 0 or (t != step and seen[t - 1] < seen[t]))
        from_x = 0 if step == 0 else int(seen[t] if down else seen[t - 1])
        from_y = from_x if step == 0 else from_x - (x - y) - (1 if down else -1)
        while x > from_x and y > from_y:
            x, y = x - 1, y - 1
            out.append(("equal", x, y))
        if step:
            out.append(("insert", -1, from_y) if down else ("delete", from_x, -1))
            x, y = from_x, from_y
    return out[::-1]


def range_matches(a: Sequence, b: Sequence, limit: int | None = EDIT_LIMIT) -> list[Match]:
    """The equal places of one range without anchors: its ends, and those of shortest edits."""
    n, m = len(a), len(b)
    head = 0
    while head < n and head < m and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    script = shortest_edits(a[head : n - tail], b[head : m - tail], limit) if head + tail < min(n, m) else []
    inner = [(i + head, j + head) for kind, i, j in script or [] if kind == "equal"]
    return [(k, k) for k in range(head)] + inner + [(n - tail + k, m - tail + k) for k in range(tail)]


def _compared(rows: DataFrame, limit: int | None) -> DataFrame:
    """(pair_id, i, j) of ranges (RANGE, side, ix, code), a range to a row. Python gets and gives arrays of codes and of places: one of
    rows would be an object for each field of each element."""

    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        out = []
        for codes in zip(left, right, strict=True):
            number: dict[bytes, int] = {}
            found = range_matches(*([number.setdefault(bytes(x), len(number)) for x in side] for side in codes), limit)
            out.append([np.array(places, np.int32) for places in zip(*found, strict=True)] or [np.empty(0, np.int32)] * 2)
        return pd.DataFrame(out, columns=["i", "j"])

    told = vectorized(run, "struct<i:array<int>,j:array<int>>")
    whole = rows.groupBy(*RANGE).agg(F.array_sort(F.collect_list(F.struct("side", "ix", "code"))).alias("found"), F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m"))
    codes = lambda side: F.transform(F.filter("found", lambda x: x["side"] == side), lambda x: x["code"])
    both = whole.where("n > 0 and m > 0").select(*RANGE, told(codes(0), codes(1)).alias("x"))
    met = both.select(*RANGE, F.explode(F.arrays_zip(F.col("x.i").alias("i"), F.col("x.j").alias("j"))).alias("x"))
    return met.select("pair_id", (F.col("a0") + F.col("x.i")).alias("i"), (F.col("b0") + F.col("x.j")).alias("j"))


def _sized(rows: DataFrame) -> DataFrame:
    """With n and m, the elements of each range on both sides; ranges with none on one side go."""
    size = rows.groupBy(*RANGE).agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m")).where("n > 0 and m > 0")
    return paired(rows, size, RANGE)


def _trimmed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches of the common ends, the rest as ranges with their sizes) of rows (RANGE, side, ix, code, n, m)."""
    place = F.col("ix") - F.when(F.col("side") == 0, F.col("a0")).otherwise(F.col("b0"))
    back = F.when(F.col("side") == 0, F.col("n")).otherwise(F.col("m")) - 1 - place
    rows = rows.withColumns({"place": place, "back": back})
    ends = rows.select(*RANGE, "code", "n", "m", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("place").alias("k")), F.struct(F.lit(1).alias("end"), F.col("back").alias("k")))).alias("e")).where("e.k < least(n, m)")
    met = ends.groupBy(*RANGE, "e.end", "e.k").agg((F.min("code") != F.max("code")).alias("unlike"))
    first = lambda end: F.min(F.when(F.col("unlike") & (F.col("end") == end), F.col("k")))
    cut = met.groupBy(*RANGE).agg(first(0).alias("head"), first(1).alias("tail"))
    told = paired(rows, cut, RANGE).withColumn("head", F.coalesce("head", F.least("n", "m"))).withColumn("tail", F.least(F.coalesce("tail", F.least("n", "m")), F.least("n", "m") - F.col("head")))
    left = told.where("side = 0")
    matches = left.where("place < head").select("pair_id", F.col("ix").alias("i"), (F.col("b0") + F.col("place")).alias("j")).unionByName(
        left.where("back < tail and place >= head").select("pair_id", F.col("ix").alias("i"), (F.col("b0") + F.col("m") - 1 - F.col("back")).alias("j"))
    )
    inner = told.where("place >= head and back >= tail")
    moved = inner.withColumns({"a0": F.col("a0") + F.col("head"), "b0": F.col("b0") + F.col("head"), "n": F.col("n") - F.col("head") - F.col("tail"), "m": F.col("m") - F.col("head") - F.col("tail")})
    return matches, moved.where("n > 0 and m > 0").select(*RANGE, "side", "ix", "code", "n", "m")


def _rising(found: DataFrame) -> DataFrame:
    """Of anchors (RANGE, i, j) a longest choice that rises in j."""
    told = before(found, RANGE, F.col("i"), F.col("j"), "largest")
    told = before(told, RANGE, -F.col("i"), -F.col("j"), "smallest")
    sure = (F.coalesce("largest", F.lit(-1)) < F.col("j")) & (F.coalesce(-F.col("smallest"), F.lit(2**62)) > F.col("j"))
    told = told.withColumn("sure", sure)
    pieces = before(told, RANGE, F.col("i"), F.when(F.col("sure"), F.col("i")), "piece").withColumn("piece", F.coalesce("piece", F.lit(-1)))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pdf.iloc[increasing(pdf["j"].tolist())][[*RANGE, "i", "j"]]

    chosen = pieces.where("not sure").select(*RANGE, "piece", "i", "j").groupBy(*RANGE, "piece").applyInPandas(choose, "pair_id long, a0 int, b0 int, i int, j int")
    return pieces.where("sure").select(*RANGE, "i", "j").unionByName(chosen)


def _between(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rows that are no anchors, each in the range behind the last anchor before it."""
    sides = anchors.select(*RANGE, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("ix")), F.struct(F.lit(1).alias("side"), F.col("j").alias("ix")))).alias("x"), F.struct((F.col("i") + 1).alias("a"), (F.col("j") + 1).alias("b")).alias("next"))
    told = paired(rows, sides.select(*RANGE, "x.side", "x.ix", "next"), [*RANGE, "side", "ix"], "left")
    told = before(told, [*RANGE, "side"], F.col("ix"), F.col("next"), "start").where("next is null")
    return told.select("pair_id", F.coalesce("start.a", "a0").cast("int").alias("a0"), F.coalesce("start.b", "b0").cast("int").alias("b0"), "side", "ix", "code")


def matches(rows: DataFrame, edit_limit: int | None = EDIT_LIMIT) -> DataFrame:
    """pair_id, i and j of the equal elements of (pair_id, side, ix, code); ix counts from 0 without gaps, pair_id is not null."""
    elements = rows.select("pair_id", F.lit(0).alias("a0"), F.lit(0).alias("b0"), F.col("side").cast("int").alias("side"), F.col("ix").cast("int").alias("ix"), "code")
    sizes = stored(rows.groupBy("pair_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > ANCHOR_LEAST), "long-pairs")
    if sizes.isEmpty():
        return _compared(elements, edit_limit)
    out = _compared(paired(elements, sizes, "pair_id", "left_anti"), edit_limit)
    open_rows = stored(_sized(paired(elements, sizes, "pair_id", "left_semi")), "ranges")
    while not open_rows.isEmpty():
        equal, rest = _trimmed(open_rows)
        rest = stored(rest, "rests")
        long = rest.where(F.col("n") + F.col("m") > ANCHOR_LEAST)
        place = lambda side: F.min(F.when(F.col("side") == side, F.col("ix")))
        once = long.groupBy(*RANGE, "code").agg(place(0).alias("i"), place(1).alias("j"), F.count(F.lit(1)).alias("k")).where("k = 2 and i is not null and j is not null").select(*RANGE, "i", "j")
        anchors = stored(_rising(once), "anchors")
        anchored = anchors.select(*RANGE).distinct()
        plain = rest.where(F.col("n") + F.col("m") <= ANCHOR_LEAST).unionByName(paired(long, anchored, RANGE, "left_anti"))
        parts = stored(_sized(_between(paired(long, anchored, RANGE, "left_semi").drop("n", "m"), anchors)), "ranges")
        short = parts.where(F.col("n") + F.col("m") <= ANCHOR_LEAST)
        compared = _compared(plain.drop("n", "m").unionByName(short.drop("n", "m")), edit_limit)
        out = out.unionByName(equal).unionByName(anchors.select("pair_id", "i", "j")).unionByName(compared)
        open_rows = parts.where(F.col("n") + F.col("m") > ANCHOR_LEAST)
    return out
