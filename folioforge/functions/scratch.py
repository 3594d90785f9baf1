"""Tables written to the folder that all executors share; a plan's lineage starts there anew."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and the executors are threads of this machine, a folder of our own."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not (there := context._jsc.sc().getCheckpointDir()).isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='folioforge-')}")
        there = context._jsc.sc().getCheckpointDir()
    return there.get().rstrip("/")


_made: dict[str, str] = {}


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = f"{shared_folder(spark)}/folioforge-rows/{app}-{uuid.uuid4().hex[:8]}"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made[app])
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
    return f"{_made[app]}/{name}-{uuid.uuid4().hex[:12]}"


def paired(rows: DataFrame, other: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input, by a shuffle. Spark tells a table's size by its files; those of ``stored`` tables of
    numbers or of like texts are a few bytes a row, so that millions of rows would be broadcast, through the driver."""
    return rows.join(other.hint("merge"), on, how)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, read from a Parquet table of this application, which goes when the application ends."""
    path = fresh_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
