"""Text and Markdown files into blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as t
from folioforge.operators import blocks, markdown, markdown_pieces
from folioforge.sources import decode, files

#: Markdown files of more bytes are cut into pieces.
LONG_BYTES = 1 << 20


def read_texts(contents: DataFrame) -> DataFrame:
    """path, format, length, text, encoding, confidence, error of files (path, length, content). Only txt and md files within
    the limits are decoded; the others have a null text, and those beyond the limits an error."""
    sized = contents.select("path", "length", "content", files.size_error(F.col("length")).alias("error")).withColumn("format", F.when(F.col("error").isNull(), files.resolve(F.col("path"), F.col("content"))))
    read = sized.withColumn("d", decode.decoded(F.when(F.col("format").isin("txt", "md"), F.col("content"))))
    return read.select("path", "format", "length", "d.text", "d.encoding", F.when(F.col("d.text").isNotNull(), decode.confidence(F.col("d.guessed"))).alias("confidence"), "error")


def text_blocks(texts: DataFrame, options: t.Options = t.DEFAULTS["text"], long_bytes: int = LONG_BYTES) -> DataFrame:
    """The blocks of txt files (between blank lines) and md files (by their markup): path, block_ix, block_id, type, level, text, raw_text, char_offset.
    Long md files are read in pieces, the others a file to a row; with a column ``length``, that of the files, neither way opens the other's files."""
    columns = ["path", "draft_ix", "type", "level", "raw_text", "char_offset"]
    size = F.col("length") if "length" in texts.columns else F.octet_length("text")
    plain = blocks.split_paragraphs(texts.where("format = 'txt'"), keys=("path",)).withColumn("type", F.lit("paragraph")).withColumn("level", F.lit(None).cast("int"))
    marked = texts.where("format = 'md'")
    short, long = markdown.blocks(marked.where(size <= long_bytes), keys=("path",)), markdown_pieces.long_blocks(marked.where(size > long_bytes), keys=("path",))
    drafts = plain.select(columns).unionByName(short.select(columns)).unionByName(long.select(columns))
    return blocks.finish_blocks(drafts, options, keys=("path",)).drop("draft_ix")
