"""Comparison of ordered block texts: rows of equal, deleted, inserted and modified blocks, with spans of the modified ones.

Both sides are tables of blocks; ``alignment`` tells the equal ones, ``pairing`` the modified ones. A row's place in its pair comes from its
blocks' places by running values, so that a pair of any length is spread over tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.batches import vectorized
from folioforge.functions.scan import before
from folioforge.functions.scratch import paired, stored
from folioforge.functions.similarity import coefficient as dice
from folioforge.functions.text import WS, bound, u16_length
from folioforge.operators import alignment, pairing

REFINE_FROM, MAX_INLINE = 0.4, 5000
_TOKEN = regex.compile(f"[{WS}]+|[^{WS}]+")
_GRAPHEME = regex.compile(r"\X")
SPANS = "array<struct<kind:string,text:string>>"
ROWS = ["pair_id", "row_ix", "kind", "left_ix", "right_ix", "left_text", "right_text", "similarity", "spans"]


def span_script(a: Sequence[str], b: Sequence[str], limit: int | None) -> list[alignment.Op]:
    """The edit script of two texts' parts, in order: what the alignment does by rounds, in one task."""
    out: list[alignment.Op] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append(("equal", i, j))
            i, j = i + 1, j + 1
        tail = 0
        while tail < min(n - i, m - j) and a[n - 1 - tail] == b[m - 1 - tail]:
            tail += 1
        n, m = n - tail, m - tail
        rising = _rising(a, b, i, n, j, m) if i < n and j < m and n - i + m - j > alignment.ANCHOR_LEAST else []
        if rising:
            cuts = [(i, rising[0][0], j, rising[0][1])]
            for (p, q), (p2, q2) in zip(rising, [*rising[1:], (n, m)], strict=True):
                cuts += [(p, p + 1, q, q + 1), (p + 1, p2, q + 1, q2)]
            todo += reversed([*cuts, (n, n + tail, m, m + tail)])
            continue
        script = alignment.shortest_edits(a[i:n], b[j:m], limit)
        if script is None:
            script = [("delete", k, -1) for k in range(n - i)] + [("insert", -1, k) for k in range(m - j)]
        out += [(kind, p + i if p >= 0 else -1, q + j if q >= 0 else -1) for kind, p, q in script]
        out += [("equal", n + k, m + k) for k in range(tail)]
    return out


def _rising(a: Sequence[str], b: Sequence[str], i: int, n: int, j: int, m: int) -> list[tuple[int, int]]:
    """Places of parts that are there once on each side, as far as they rise on both."""
    places = []
    for side, start, stop in ((a, i, n), (b, j, m)):
        times = Counter(side[start:stop])
        places.append({side[k]: k for k in range(start, stop) if times[side[k]] == 1})
    met = [(p, places[1][v]) for v, p in places[0].items() if v in places[1]]
    return [met[k] for k in alignment.increasing([q for _, q in met])]


def _merged(spans: list[tuple[str, str]]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for kind, text in spans:
        if text and out and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1] + text)
        elif text:
            out.append((kind, text))
    return out


def _spans(a: Sequence[str], b: Sequence[str], limit: int | None) -> list[tuple[str, str]]:
    return [(kind, a[i] if i >= 0 else b[j]) for kind, i, j in span_script(a, b, limit)]


def inline(left: str, right: str, limit: int | None = alignment.EDIT_LIMIT) -> list[tuple[str, str]]:
    """Spans of two texts word by word; a word that replaces a similar one is compared by graphemes."""
    words, out, at = _spans(_TOKEN.findall(left), _TOKEN.findall(right), limit), [], 0
    while at < len(words):
        kind, text = words[at]
        if kind == "delete" and at + 1 < len(words) and words[at + 1][0] == "insert" and dice(text, words[at + 1][1]) >= REFINE_FROM:
            out.extend(_spans(_GRAPHEME.findall(text), _GRAPHEME.findall(words[at + 1][1]), limit))
            at += 2
        else:
            out.append((kind, text))
            at += 1
    return _merged(out)


def spans_of(left: Column, right: Column, limit: int | None = alignment.EDIT_LIMIT) -> Column:
    """Spans of two texts; null counts as empty. Python gives arrays of kinds and of texts: one of spans would be some objects for each."""

    def told(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        found = (inline(p or "", q or "", limit) for p, q in zip(left, right, strict=True))
        return pd.DataFrame([[[k for k, _ in spans], [x for _, x in spans]] for spans in found], columns=["kind", "text"])

    lists = vectorized(told, "struct<kind:array<string>,text:array<string>>")(left, right)
    return bound(lists, lambda x: F.arrays_zip(x["kind"].alias("kind"), x["text"].alias("text"))).cast(SPANS)


def inline_spans(pairs: DataFrame, limit: int | None = alignment.EDIT_LIMIT) -> DataFrame:
    """pair_id and the spans of its texts left and right (null counts as empty). Pairs are few bytes but much work, so the number of
    their tasks is fixed: adaptive execution would make few tasks of them."""
    spark = pairs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return pairs.select("pair_id", "left", "right").repartition(tasks).select(F.col("pair_id").cast("long"), spans_of(F.col("left"), F.col("right"), limit).alias("spans"))


def runs(left: DataFrame, right: DataFrame, edit_limit: int | None = alignment.EDIT_LIMIT) -> DataFrame:
    """All blocks of both sides (pair_id, block_ix, text), aligned: pair_id, side (0 or 1), ix, text, other (the place of the equal
    block, or null), run (a number that rises with the runs between equal blocks) and place (the block's place on its side of the
    run). Blocks are numbered by block_ix; a null text counts as empty, and rows without a pair_id are left out."""
    order = Window.partitionBy("pair_id", "side").orderBy("block_ix")
    both = left.select(F.col("pair_id").cast("long"), F.lit(0).alias("side"), "block_ix", "text").unionByName(right.select(F.col("pair_id").cast("long"), F.lit(1).alias("side"), "block_ix", "text"))
    text = F.coalesce("text", F.lit(""))
    rows = stored(both.where("pair_id is not null").select("pair_id", "side", (F.row_number().over(order) - 1).alias("ix"), text.alias("text"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("code")), "blocks")
    met = alignment.matches(rows, edit_limit)
    of = lambda side, ix, other: F.struct(F.lit(side).alias("side"), F.col(ix).alias("ix"), F.col(other).alias("other"))
    sides = met.select("pair_id", F.explode(F.array(of(0, "i", "j"), of(1, "j", "i"))).alias("x")).select("pair_id", "x.*")
    # Places are told without the texts, which are dealt once.
    told = paired(rows.select("pair_id", "side", "ix"), sides, ["pair_id", "side", "ix"], "left")
    here = F.when(F.col("other").isNotNull(), F.struct("ix", "other"))
    told = before(told, ["pair_id", "side"], F.col("ix"), here, "last")
    told = told.select("pair_id", "side", "ix", "other", F.coalesce(F.col("last.ix") + F.col("last.other") + 2, F.lit(0)).cast("long").alias("run"), (F.col("ix") - F.coalesce("last.ix", F.lit(-1)) - 1).alias("place"))
    return paired(rows.select("pair_id", "side", "ix", "text"), told, ["pair_id", "side", "ix"]).select("pair_id", "side", "ix", "text", "other", "run", "place")


def diff_rows(left: DataFrame, right: DataFrame, max_inline: int | None = MAX_INLINE, edit_limit: int | None = alignment.EDIT_LIMIT, max_blocks: int | None = None) -> DataFrame:
    """The rows of each pair, from the blocks of both sides (pair_id, block_ix, text): ROWS; each block is in one row.

    In a run, deleted and modified blocks come in the order of the left side; an inserted block comes before the first modified one
    whose right block is behind it, or last. Modified blocks of more than ``max_inline`` UTF-16 units have no spans (None: all have).
    A pair of more than ``max_blocks`` blocks (None: no bound) has a single row, whose kind is the error."""
    large = None
    if max_blocks is not None:
        sizes = left.select("pair_id").unionByName(right.select("pair_id")).groupBy(F.col("pair_id").cast("long").alias("pair_id")).agg(F.count(F.lit(1)).alias("blocks"))
        large = stored(sizes.where(F.col("blocks") > max_blocks).select("pair_id"), "large")
        left, right = (paired(side, large, "pair_id", "left_anti") for side in (left, right))
    # Of equal blocks the left text is enough.
    rows = stored(runs(left, right, edit_limit).withColumn("text", F.when((F.col("side") == 0) | F.col("other").isNull(), F.col("text"))), "runs")
    changed = rows.where("other is null").drop("other")
    pairs = stored(pairing.pairs(changed), "pairs")
    run = pairing.RUN

    # One scan for both sides: deleted blocks look back for the furthest right block that was taken, inserted ones look
    # from the end for the first deleted block that took one behind them.
    taken = pairs.select(*run, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("place"), F.col("j").alias("mate")), F.struct(F.lit(1).alias("side"), F.col("j").alias("place"), F.col("i").alias("mate")))).alias("x"), "score").select(*run, "x.*", "score")
    told = paired(changed.drop("text"), taken, [*run, "side", "place"], "left")
    at = F.when(F.col("side") == 0, F.col("place")).otherwise(-F.col("place"))
    told = before(told, [*run, "side"], at, F.when(F.col("side") == 0, F.col("mate") + 1).otherwise(-F.col("mate")), "seen")
    told = paired(changed.select(*run, "side", "place", "text"), told, [*run, "side", "place"])
    deleted = told.where("side = 0").withColumn("at", F.col("run") + F.col("place") + F.greatest(F.coalesce("seen", F.lit(0)), F.coalesce(F.col("mate") + 1, F.lit(0))))
    lengths = changed.where("side = 0").groupBy(*run).agg(F.count(F.lit(1)).alias("length"))
    alone = paired(told.where("side = 1 and mate is null"), lengths, run, "left").withColumn("at", F.col("run") + F.col("place") + F.coalesce(-F.col("seen"), "length", F.lit(0)))

    partner = told.where("side = 1 and mate is not null").select(*run, F.col("place").alias("mate"), F.col("ix").alias("right_ix"), F.col("text").alias("right_text"))
    modified = paired(deleted.where("mate is not null"), partner, [*run, "mate"])
    fits = F.lit(True) if max_inline is None else (u16_length(F.col("text")) <= max_inline) & (u16_length(F.col("right_text")) <= max_inline)
    short = lambda test: modified.where(test).select("pair_id", "at", F.lit("modify").alias("kind"), F.col("ix").alias("left_ix"), "right_ix", F.col("text").alias("left_text"), "right_text", (F.floor(F.col("score") * 100 + 0.5) / 100).alias("similarity"))
    out = short(fits).withColumn("spans", spans_of(F.col("left_text"), F.col("right_text"), edit_limit))
    if max_inline is not None:
        out = out.unionByName(short(~fits).withColumn("spans", F.lit(None).cast(SPANS)))
    none = lambda kind: F.lit(None).cast(kind)
    plain = lambda df, kind, *columns: df.select("pair_id", "at", F.lit(kind).alias("kind"), *(c.alias(name) for c, name in zip(columns, ("left_ix", "right_ix", "left_text", "right_text"), strict=True)), none("double").alias("similarity"), none(SPANS).alias("spans"))
    ix, text, no_ix, no_text = F.col("ix"), F.col("text"), none("int"), none("string")
    equal = rows.where("side = 0 and other is not null").withColumn("at", (F.col("ix") + F.col("other")).cast("long"))
    out = out.unionByName(plain(equal, "equal", ix, F.col("other"), text, text)).unionByName(plain(deleted.where("mate is null"), "delete", ix, no_ix, text, no_text)).unionByName(plain(alone, "insert", no_ix, ix, no_text, text))
    out = before(out, ["pair_id"], F.col("at"), F.lit(1), "row_ix", total=True).withColumn("row_ix", F.coalesce("row_ix", F.lit(0)).cast("int")).select(ROWS)
    if large is not None:
        out = out.unionByName(large.select("pair_id", F.lit(0).alias("row_ix"), F.lit("OUT_OF_MEMORY").alias("kind"), *(none(k).alias(c) for c, k in zip(ROWS[3:], ("int", "int", "string", "string", "double", SPANS), strict=True))))
    return out


def statistics(rows: DataFrame) -> DataFrame:
    """Per pair the rows of each kind and the deleted and inserted characters (of modified rows those of their spans)."""
    count = lambda kind: F.sum((F.col("kind") == kind).cast("long")).alias(f"n_{kind}")
    def chars(kind: str, side: str):
        inside = F.aggregate(F.filter("spans", lambda s: s["kind"] == kind), F.lit(0), lambda n, s: n + u16_length(s["text"]))
        whole = u16_length(F.coalesce(F.col(side), F.lit("")))
        return F.sum(F.when(F.col("kind") == kind, whole).when((F.col("kind") == "modify") & F.col("spans").isNotNull(), inside).when(F.col("kind") == "modify", whole).otherwise(0)).cast("long").alias(f"{kind}_chars")

    return rows.groupBy("pair_id").agg(*map(count, ("equal", "insert", "delete", "modify")), chars("delete", "left_text"), chars("insert", "right_text"))
