"""Functions over Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch at most. Spark's own bounds, 64 MB and 10,000 rows, are several times that in Python, in each worker.
BATCH_BYTES = 4 << 20
BYTES, DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded(spark: SparkSession) -> None:
    """Small Arrow batches from here on, unless the session has a bound of its own."""
    if spark.conf.get(BYTES) == DEFAULT:
        spark.conf.set(BYTES, str(BATCH_BYTES))


def vectorized(f: Callable, returns: str) -> Callable:
    """A pandas function whose batches are bounded in this session."""
    if (spark := SparkSession.getActiveSession()) is not None:
        bounded(spark)
    return F.pandas_udf(f, returns)
