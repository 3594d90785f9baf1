"""From documents to token files: language, near duplicates, contamination, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import arrow_tokens, decontaminate, kneser_ney, mixture, prefix_join
from folioforge.llm.common import table, written
from folioforge.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The near-duplicate stage's own shingle width and similarity; prefix_join's defaults are those of op6_prefix_join.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification doesn't reject."""
    model = kneser_ney.train(docs.where(kneser_ney.fold(F.col("doc_id")) != 0))
    return docs.select(COLUMNS).where(~kneser_ney.rejects(F.col("text"), model, spark))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id, nulls last; of rows with that doc_id the one of
    the smallest hash of the text. Rows are told apart by both; documents without words are not linked and stay."""
    told = prefix_join.components(docs, NEAR_WIDTH, NEAR_PERCENT).select("component", "doc_id", "text_key", F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "text_key").alias("row"))
    firsts, _ = written(told.where("component is not null").groupBy("component").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    linked = told.join(F.broadcast(firsts) if firsts.count() <= prefix_join.BROADCAST_ROWS else firsts, "component").select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), (F.col("row") == F.col("first")).alias("stays"))
    rows, _ = written(linked.groupBy("d", "t", "stays").agg(F.count(F.lit(1)).alias("n")), "dropped")
    dropped = rows.where("not stays")
    dropped = F.broadcast(dropped) if dropped.count() <= prefix_join.BROADCAST_ROWS else dropped
    kept = docs.select(COLUMNS).join(dropped, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("t")), "left_anti")
    return kept if rows.where("stays and n > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.remove(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"), "document")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each document and pass."""
    return mixture.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and each row's place in them as read back."""
    return arrow_tokens.read(arrow_tokens.write(docs, vocabulary("word_bpe_49k.json")))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("mixed", mixed), ("token_files", token_files)]

#: The language models and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what each returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
