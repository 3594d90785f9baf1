"""Exact deduplication as a stateful stream.

The rows arrive as a file stream. The state, keyed by the text's SHA-256 digest, lies in RocksDB on
the executors' disks, is saved in the shared folder and never expires. For each digest it retains
the stable identifier (the largest doc_id), the content locator (file and row of that document) and
the number of rows seen; texts are not in it. Every row whose digest was met more than once is a
hit: its bytes are compared in full with the content at the locator. Rows that differ there (a
collision of digests) are grouped anew by their bytes.

Null text counts as empty. Null doc_id is smaller than any other. Of rows that repeat text and
doc_id, the one at the larger locator stays. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import delete, fresh_path, shared_dir, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAM_CONF = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
#: The digests that occur more than once are broadcast up to so many. Beyond, those of the largest groups are (no more than
#: so many can have more than this part of all rows each), and the others are joined by shuffling.
BROADCAST_ROWS, HOT_ROWS, SALT = 1_000_000, 1000, 64


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _glob(path: str) -> str:
    """The same path as a pattern: a stream's source takes one file only by a pattern."""
    head, _, name = path.rstrip("/").rpartition("/")
    return f"{head}/{name[:-1]}[{name[-1]}]"


def _rows(df: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select(F.col("doc_id"), text.alias("text"), digest(text).alias("digest"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"))


def digest_state(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, bytes_per_trigger: int = 256 << 30, folder: str | None = None) -> tuple[DataFrame, str]:
    """Runs the stream over all files under ``path`` and returns the state's last word on each digest:
    digest, keep (doc_id, locator) and group_size; and the folder that holds it. A stream with a folder of its own is
    continued there: files that were added since are read, and what they hold is told beside what came before."""
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    stream = _rows(spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_trigger)).parquet(_glob(path)), digest)
    state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    out = folder or fresh_path(spark, "dedup-state")
    saved = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    try:
        for k, v in STREAM_CONF.items():
            spark.conf.set(k, v)
        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={n}"))
            .option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = state.schema
    done = [int(m[1]) for m in map(re.compile(r"batch=(\d+)$").search, _children(spark, f"{out}/rows")) if m]
    if not done:
        return spark.createDataFrame([], schema), out
    rows = spark.read.schema(schema).option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    if len(done) > 1:
        rows = rows.groupBy("digest").agg(F.max_by("keep", "batch").alias("keep"), F.max("group_size").alias("group_size"))
    return rows.select("digest", "keep", "group_size"), out


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder: one for each micro-batch of the stream."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []


def _told(rows: DataFrame, many: DataFrame, n_many: int, hot_from: int, how: str) -> DataFrame:
    """The rows (digest) with the columns of their digest in many (d, ...), by an inner or a left join."""
    same = F.col("digest") == F.col("d")
    if n_many <= BROADCAST_ROWS:
        return rows.join(F.broadcast(many), same, how)
    hot, rest = many.where(F.col("group_size") > hot_from), many.where(F.col("group_size") <= hot_from)
    first = rows.join(F.broadcast(hot), same, "left")
    other = first.where(F.col("d").isNull()).select(*rows.columns).join(rest.hint("merge"), same, how)
    return first.where(F.col("d").isNotNull()).unionByName(other)


def deduplicate(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, bytes_per_trigger: int = 256 << 30) -> DataFrame:
    """One row per row of the table: doc_id, keep_id, group_size, kept, text_sha256."""
    state, folder = digest_state(spark, path, digest, bytes_per_trigger)
    docs = _rows(spark.read.parquet(path), digest)
    # The hits' bytes meet the content at their locator; rows that are alone with their digest need no text and no join.
    many, _ = written(state.where(F.col("group_size") > 1).select(F.col("digest").alias("d"), "keep", "group_size"), "dedup-repeated")
    sizes = many.agg(F.count(F.lit(1)).alias("n"), F.sum("group_size").alias("rows")).first()
    hot_from = max(HOT_ROWS, -(-(sizes["rows"] or 0) // BROADCAST_ROWS))
    hits = _told(docs, many.select("d", F.col("keep.locator").alias("at"), "group_size"), sizes["n"], hot_from, "inner")
    # Of large groups the content is sent to as many tasks as their rows are dealt to.
    hot = F.col("group_size") > hot_from
    content = hits.where(F.col("locator") == F.col("at")).select(F.col("d").alias("c"), F.col("text").alias("content"), F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))).alias("c_salt"))
    salted = hits.withColumn("salt", F.when(hot, F.pmod(F.col("locator.row"), F.lit(SALT)).cast("int")).otherwise(0))
    wrong, wrong_at = written(salted.join(content, (F.col("d") == F.col("c")) & (F.col("salt") == F.col("c_salt"))).where(F.col("text") != F.col("content")).select("digest").distinct(), "dedup-collisions")
    members = docs.select("doc_id", "digest", "locator", (F.sha2("text", 256) if digest is not sha256 else F.col("digest")).alias("text_sha256"))
    known = _told(members, many, sizes["n"], hot_from, "left")
    told = known.select("digest", "doc_id", "locator", "text_sha256", F.coalesce("keep", F.struct("doc_id", "locator")).alias("keep"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    if not wrong.isEmpty():
        told = told.join(wrong, "digest", "left_anti")
        apart = docs.join(wrong, "digest", "left_semi")
        groups = apart.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        again = apart.join(groups, ["digest", "text"]).select("digest", "doc_id", "locator", F.sha2("text", 256).alias("text_sha256"), "keep", "group_size")
        told = told.unionByName(again)
    else:
        delete(spark, wrong_at)
    delete(spark, folder)
    return told.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("group_size").cast("long"), (F.col("locator") == F.col("keep.locator")).alias("kept"), "text_sha256")


__all__ = ["deduplicate", "digest_state", "sha256", "shared_dir"]
