"""Running values over rows in order, in two steps, so that rows of one key are spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one key whose places lie within so many are in one task.
SPAN = 8192


def before(rows: DataFrame, keys: list[str], at: Column, value: Column, name: str, total: bool = False, span: int = SPAN) -> DataFrame:
    """The rows with the largest value (or the sum, for ``total``) of the rows of their keys at smaller places; null where there
    is none. Places (``at``) are integers and differ among the rows of a key; null values don't count."""
    fold = F.sum if total else F.max
    cut = rows.withColumns({"_at": at.cast("long"), "_value": value}).withColumn("_part", F.floor(F.col("_at") / span))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(*keys, "_part").agg(fold("_value").alias("_whole")).select(*keys, "_part", fold("_whole").over(earlier).alias("_far")).where("_far is not null")
    inside = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    near = cut.withColumn("_near", fold("_value").over(inside)).join(parts.hint("merge"), [*keys, "_part"], "left")
    both = F.coalesce(F.col("_near") + F.col("_far"), "_near", "_far") if total else F.when(F.col("_near").isNull() | (F.col("_far") > F.col("_near")), F.col("_far")).otherwise(F.col("_near"))
    return near.select(*rows.columns, both.alias(name))
