"""Files that arrive again and again, as a stream: what is new, what has changed, and the table of what there is.

The state of a path is the digest and the number of its newest version; it is kept by key in the state store, without expiry, since a file
can change at any time. A batch may hold several versions of a path: they are taken in order of their times. A version that arrives
after a newer one was seen is late, and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

CHANGES = "path string, version long, change string, digest string, modified timestamp, length long"
_STATE = "digest string, version long, modified timestamp"


def _versions(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes of one path: added or changed; the same content again is no version."""
    digest, version, newest = state.get if state.exists else (None, 0, None)
    out = []
    for r in pd.concat(list(batches)).sort_values(["modified", "digest"]).itertuples(index=False):
        if newest is not None and r.modified < newest:
            continue
        newest = r.modified
        if r.digest != digest:
            version += 1
            out.append((key[0], version, "added" if version == 1 else "changed", r.digest, r.modified, r.length))
            digest = r.digest
    state.update((digest, version, newest))
    yield pd.DataFrame(out, columns=["path", "version", "change", "digest", "modified", "length"])


def changes(files: DataFrame) -> DataFrame:
    """A stream of CHANGES from a stream of files (path, modified, content); contents themselves don't go through the state. Rows
    without path or time are left out, null content counts as empty."""
    content = F.coalesce("content", F.unhex(F.lit("")))
    told = files.where("path is not null and modified is not null").select("path", F.sha2(content, 256).alias("digest"), "modified", F.length(content).cast("long").alias("length"))
    return told.groupBy("path").applyInPandasWithState(_versions, CHANGES, _STATE, "append", GroupStateTimeout.NoTimeout)


def current(log: DataFrame) -> DataFrame:
    """The newest version of each path in a table of changes: one row a path, also where a batch was written twice."""
    order = Window.partitionBy("path").orderBy(F.desc("version"))
    return log.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("path", "version", "digest", "modified", "length")


def follow(files: DataFrame, log: str, checkpoint: str):
    """Runs the stream over all that has arrived, appending to the table of changes at ``log``; the query, when it has ended. It goes on where
    it stopped when it is called again with the same checkpoint."""
    query = changes(files).writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
