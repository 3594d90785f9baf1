"""Views over diff rows: folding, positions, navigation, segments."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions import text as t
from folioforge.functions.batches import vectorized

CONTEXT, LEAST_HIDDEN = 3, 6


def fold(rows: DataFrame, key: str = "pair_id", context: int = CONTEXT, least: int = LEAST_HIDDEN, collapse: bool = True, expanded: DataFrame | None = None) -> DataFrame:
    """The items of a folded view of rows (key, row_ix, kind): key, item_ix, kind (row or gap), row_ix,
    gap_from, gap_to, gap_count, run_start (of a gap's run). Long runs of equal rows shrink to their edges next to changes,
    but not those in ``expanded`` (key, run_start), and none without ``collapse``."""
    order = Window.partitionBy(key).orderBy("row_ix")
    equal = F.col("kind") == "equal"
    runs = rows.withColumn("eq", equal).withColumn("run", F.col("row_ix") - F.row_number().over(Window.partitionBy(key, "eq").orderBy("row_ix")))
    run = Window.partitionBy(key, "eq", "run")
    last = F.max("row_ix").over(Window.partitionBy(key))
    told = runs.withColumn("a", F.min("row_ix").over(run)).withColumn("b", F.max("row_ix").over(run)).withColumn("last", last)
    head, tail = F.when(F.col("a") == 0, 0).otherwise(context), F.when(F.col("b") == F.col("last"), 0).otherwise(context)
    told = told.withColumn("gap_from", F.col("a") + head).withColumn("gap_to", F.col("b") - tail)
    hidden = F.col("gap_to") - F.col("gap_from") + 1
    if expanded is not None:
        told = told.join(expanded.select(F.col(key).alias("_k"), F.col("run_start").alias("_a")).distinct(), (F.col(key) == F.col("_k")) & (F.col("a") == F.col("_a")), "left")
    shown = F.col("_a").isNotNull() if expanded is not None else F.lit(False)
    told = told.withColumn("folded", F.lit(collapse) & F.col("eq") & ~shown & (hidden >= least) & F.col("row_ix").between(F.col("gap_from"), F.col("gap_to")))
    kept = told.where(~F.col("folded") | (F.col("row_ix") == F.col("gap_from")))
    blank = F.lit(None).cast("long")
    gap = lambda c: F.when(F.col("folded"), c).otherwise(blank)
    return kept.select(
        key, (F.row_number().over(order) - 1).alias("item_ix"), F.when(F.col("folded"), "gap").otherwise("row").alias("kind"), F.when(~F.col("folded"), F.col("row_ix").cast("long")).alias("row_ix"),
        gap(F.col("gap_from").cast("long")).alias("gap_from"), gap(F.col("gap_to").cast("long")).alias("gap_to"), gap(hidden.cast("long")).alias("gap_count"), gap(F.col("a").cast("long")).alias("run_start"),
    )


def view_index(items: DataFrame, wanted: DataFrame, key: str = "pair_id") -> DataFrame:
    """For wanted rows (key, row_ix) the item that shows or hides each; -1 if there is none."""
    span = items.select(key, "item_ix", F.coalesce("row_ix", "gap_from").alias("lo"), F.coalesce("row_ix", "gap_to").alias("hi"))
    w = wanted.select(F.col(key).alias("k"), "row_ix")
    return w.join(span, (F.col("k") == F.col(key)) & F.col("row_ix").between(F.col("lo"), F.col("hi")), "left").select(F.col("k").alias(key), "row_ix", F.coalesce("item_ix", F.lit(-1)).alias("item_ix"))


def minimap(rows: DataFrame, key: str = "pair_id") -> DataFrame:
    """Each change's place in percent of all rows."""
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key))).where("kind <> 'equal'").select(key, "row_ix", "kind", (F.col("row_ix") * 100.0 / F.col("n")).alias("position"))


def change_nav(rows: DataFrame, key: str = "pair_id") -> DataFrame:
    """The changes in order with the rows of the one before and the one after."""
    order = Window.partitionBy(key).orderBy("row_ix")
    return rows.where("kind <> 'equal'").select(key, "row_ix", (F.row_number().over(order) - 1).alias("change_ix"), F.lag("row_ix").over(order).alias("previous_row"), F.lead("row_ix").over(order).alias("next_row"))


def segments_of(spans: Column) -> Column:
    """The segments of one row from its spans (array of kind and text, in order), an array of kind, text (common), left_text and right_text
    (divergent). Each span is read where it lies: nothing is exploded, sorted or shuffled."""
    eq = lambda s: s["kind"] == "equal"
    joined = lambda part: F.array_join(F.transform(part, lambda s: s["text"]), "")

    def told(part: Column) -> Column:
        same, side = eq(F.get(part, F.lit(0))), lambda kind: joined(F.filter(part, lambda s: s["kind"] == kind))
        return F.struct(F.when(same, "common").otherwise("divergent").alias("kind"), F.when(same, joined(part)).alias("text"), F.when(~same, side("delete")).alias("left_text"), F.when(~same, side("insert")).alias("right_text"))

    def cut(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda _, i: i), lambda i: (i == 0) | (eq(F.get(s, i)) != eq(F.get(s, i - 1))))
        return t.bound(starts, lambda at: F.transform(at, lambda i, k: t.bound(F.slice(s, i + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - i), told)))

    return t.bound(spans, cut)


def span_segments(rows: DataFrame, key: str = "pair_id") -> DataFrame:
    """Common and divergent segments of modified rows (key, row_ix, spans): seg_ix, kind, text (common), left and right (divergent)."""
    return rows.select(key, "row_ix", F.posexplode(segments_of(F.col("spans"))).alias("seg_ix", "s")).select(key, "row_ix", F.col("seg_ix").cast("long").alias("seg_ix"), "s.*")


def triple_segments(spans: DataFrame, key: str = "pair_id") -> DataFrame:
    """The same from spans that are rows (key, row_ix, span_ix, kind, text)."""
    whole = spans.groupBy(key, "row_ix").agg(F.array_sort(F.collect_list(F.struct("span_ix", "kind", "text"))).alias("spans"))
    return span_segments(whole, key)


def row_segments(rows: DataFrame, key: str = "pair_id") -> DataFrame:
    """The segments of all rows of a comparison (key, row_ix, kind, left_text, right_text, spans). An equal row is common (none
    if it is empty); a row of one side, and a modified one without spans, is divergent, a missing side of it empty."""
    inline = (F.col("kind") == "modify") & (F.coalesce(F.size("spans"), F.lit(0)) > 0)
    same = F.col("kind") == "equal"
    text = F.coalesce("right_text", "left_text", F.lit(""))
    side = lambda c: F.when(~same, F.coalesce(c, F.lit(""))).alias(c)
    whole = rows.where(~inline & (~same | (text != ""))).select(key, "row_ix", F.lit(0).cast("long").alias("seg_ix"), F.when(same, "common").otherwise("divergent").alias("kind"), F.when(same, text).alias("text"), side("left_text"), side("right_text"))
    return span_segments(rows.where(inline), key).unionByName(whole)


def common_text(segments: DataFrame, key: str = "pair_id") -> DataFrame:
    """What both sides share: the common segments joined in order."""
    common = segments.where("kind = 'common'")
    return common.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_ix", "seg_ix", "text"))), lambda s: s["text"]), "").alias("common_text"))


def shared_text(rows: DataFrame, key: str = "pair_id") -> DataFrame:
    """What both sides share, from modified rows (key, row_ix, spans): the common segments of a row are joined where they lie, then those of a pair's rows."""
    same = lambda s: s["kind"] == "equal"
    text = F.array_join(F.transform(F.filter("spans", same), lambda s: s["text"]), "")
    return common_text(rows.where(F.exists("spans", same)).select(key, "row_ix", F.lit(0).cast("long").alias("seg_ix"), F.lit("common").alias("kind"), text.alias("text")), key)


SHORT, NEAR = 3, 12
_GRAPHEME = regex.compile(r"\X")
_WORDS = regex.compile(r"(?V1w)\b")


def _length(text: str) -> int:
    return len(_GRAPHEME.findall(text))


def near_text(text: str, most: int, last: bool) -> str:
    """Whole words from the beginning, or the end, of up to so many graphemes; of a longer word the graphemes."""
    words = [w for w in _WORDS.split(text) if w]
    out = ""
    for word in reversed(words) if last else words:
        more = word + out if last else out + word
        if _length(more) > most:
            break
        out = more
    return out or "".join(_GRAPHEME.findall(text)[-most:] if last else _GRAPHEME.findall(text)[:most])


def with_context(segments: DataFrame, key: str = "pair_id", short: int = SHORT, most: int = NEAR) -> DataFrame:
    """Segments with before and after: for divergent ones of fewer than ``short`` graphemes some of the common text next to
    them, with an ellipsis where that is cut; null elsewhere."""

    def cut(texts: pd.Series, last: bool) -> pd.Series:
        return texts.map(lambda x: None if not x else x if (near := near_text(x, most, last)) == x else f"…{near}" if last else f"{near}…")

    order = Window.partitionBy(key, "row_ix").orderBy("seg_ix")
    lonely = (F.col("kind") == "divergent") & (F.greatest(*[F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("\\X"), F.lit(0))) for c in ("left_text", "right_text")]) < short)
    beside = segments.withColumn("_b", F.when(lonely, F.lag("text").over(order))).withColumn("_a", F.when(lonely, F.lead("text").over(order)))
    head, tail = vectorized(lambda x: cut(x, False), "string"), vectorized(lambda x: cut(x, True), "string")
    return beside.withColumn("before", tail("_b")).withColumn("after", head("_a")).drop("_a", "_b")


def location(page: Column, section: Column) -> Column:
    """Where a block is: its page, or its section counted from 1, else nothing."""
    return F.when(page.isNotNull(), F.concat(F.lit("p."), page.cast("string"))).when(section.isNotNull(), F.concat(F.lit("§"), (section + 1).cast("string"))).otherwise("")


def gutter(kind: Column) -> Column:
    return F.when(kind == "insert", "+").when(kind == "delete", "−").when(kind == "modify", "~").otherwise(" ")


def side_text(kind: Column, spans: Column, left: Column, right: Column, side: str) -> Column:
    """What a row shows on a side (left, right or both): of a modified row its spans without those of the other side; null
    where the side has no block."""
    other = {"left": "insert", "right": "delete"}.get(side, "")
    joined = F.array_join(F.transform(F.filter(spans, lambda s: s["kind"] != other), lambda s: s["text"]), "")
    block = left if side == "left" else right if side == "right" else F.coalesce(right, left)
    return F.when((kind == "modify") & spans.isNotNull(), joined).otherwise(block)


def table_cells(text: Column) -> Column:
    """The rows and cells of a flattened table."""
    return F.transform(F.split(text, "\n", -1), lambda r: F.split(r, " \\| ", -1))
