"""Shared helpers: tables, the shared scratch folder, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of our own only where it is unset and the
    executors are threads of this machine. On a cluster a missing setting is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not (set_already := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='folioforge-')}")
        set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    return set_already.get().rstrip("/")


_folders: dict[str, str] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's own part of the shared folder, which goes when the application ends, also
    where a job has failed before its tables were deleted."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_dir(spark)}/folioforge/{app}-{uuid.uuid4().hex[:8]}"
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(_folders[app])
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return f"{_folders[app]}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, and its path; its lineage starts there."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Arrow batches of texts: rows and bytes at most. Spark's own bounds let tens of MB lie in the JVM and in Python at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches from here on, unless the session has bounds of its own."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
