"""A store of parsed blocks: a table in buckets by document, so that changed options are answered without parsing or a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as t
from folioforge.operators import blocks as b

#: Buckets of a store. A bucket is one task's share when the store is read, so it should grow with the corpus: some 200 MB each.
BUCKETS = 64


def save(blocks: DataFrame, name: str, path: str, buckets: int = BUCKETS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Writes blocks (keys, block_ix, raw_text, ...) as table ``name`` at ``path``, bucketed by the keys and sorted by keys and block_ix; an
    existing table of that name is an error. This is the one shuffle; every bucket is one file. Composing characters is the one step of
    normalisation that every option shares and Python does, so it is done here: column ``composed`` (replaced if there is one) is
    set where it changes the raw text."""
    composed = t.nfc(F.col("raw_text"))
    dealt = blocks.withColumn("composed", composed).withColumn("composed", F.when(F.col("composed") != F.col("raw_text"), F.col("composed"))).repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys, "block_ix").option("path", path).format("parquet").saveAsTable(name)
    return blocks.sparkSession.table(name)


def _under(rows: DataFrame, options: t.Options, keys: tuple[str, ...]) -> DataFrame:
    drafts = rows.withColumns({"_raw": F.col("raw_text"), "raw_text": F.coalesce("composed", "raw_text"), "draft_ix": F.col("block_ix")}).drop("text", "block_id", "block_ix", "composed")
    return b.finish_blocks(drafts, options, keys, compose=False).drop("raw_text").withColumnRenamed("_raw", "raw_text")


def under(spark: SparkSession, name: str, options: t.Options, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All blocks of a store under other options, as ``operators.blocks.renormalize`` gives them. The plan has no exchange: buckets meet the
    windows of the documents as they lie."""
    return _under(spark.table(name), options, keys)


def read(spark: SparkSession, name: str, key: str | int, options: t.Options, column: str = "doc_id") -> DataFrame:
    """The blocks of one document under other options: only its bucket is read."""
    return _under(spark.table(name).where(F.col(column) == key), options, (column,))
