"""Blocks: the ordered pieces of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions import text as t


def split_paragraphs(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Paragraphs between blank lines: keys, draft_ix, raw_text, char_offset (of the piece in the text, in UTF-16 units). Blank
    pieces go; line breaks are unified first. The offset sums what is before a piece, in a window that plans without it leave out."""
    body = t.unify_newlines(F.col(text))
    sep = "\\n[ \\t]*\\n"
    parts, gaps = F.split(body, sep, -1), F.regexp_extract_all(body, F.lit(sep), F.lit(0))
    cut = docs.select(*keys, parts.alias("parts"), gaps.alias("gaps"))
    rows = cut.select(*keys, F.posexplode(F.arrays_zip(F.col("parts").alias("part"), F.col("gaps").alias("gap"))).alias("draft_ix", "x"))
    size = t.u16_length(F.col("x.part")) + F.coalesce(F.length("x.gap"), F.lit(0))
    at = F.sum(size).over(Window.partitionBy(*keys).orderBy("draft_ix")) - size
    told = rows.select(*keys, "draft_ix", F.col("x.part").alias("raw_text"), at.cast("long").alias("char_offset")).where(F.col("raw_text").isNotNull())
    return told.where(t.full(F.col("raw_text")))


def finish_blocks(drafts: DataFrame, options: t.Options = t.Options(), keys: tuple[str, ...] = ("doc_id",), compose: bool = True) -> DataFrame:
    """Normalised blocks: empty ones go, then block_ix counts and block_id is made of index and text."""
    ix = F.row_number().over(Window.partitionBy(*keys).orderBy("draft_ix")) - 1
    kept = drafts.withColumn("text", t.normalize(F.col("raw_text"), options, compose)).where(F.col("text") != "").withColumn("block_ix", ix)
    return kept.withColumn("block_id", t.block_id(F.col("text"), F.col("block_ix")))


def renormalize(blocks: DataFrame, options: t.Options, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The blocks under other options, from their raw text; nothing is parsed again."""
    drafts = blocks.drop("text", "block_id").withColumn("draft_ix", F.col("block_ix")).drop("block_ix")
    return finish_blocks(drafts, options, keys)


def counts(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(t.u16_length(F.col("text"))).alias("n_chars"))
