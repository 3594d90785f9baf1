"""Importance resampling towards a target by hashed n-grams.

A text's features are its runs of 1 to ``order`` consecutive words. In a task each Arrow batch of texts (some MB, or one
text) has an integer dictionary: its distinct words get ids, an n-gram is a tuple of ids (the id of its first n-1 words'
tuple and that of its last word), and the bytes of each distinct tuple are put together and hashed once; the buckets go
back to all of its occurrences by number. A document's buckets, 16 bits a feature, are written to the shared folder, so
that texts are cut and hashed in one pass. The dictionaries are those of batches because tuples of all documents would
have to be shuffled twice, at some thirty bytes for each occurrence, to be hashed once in all.

Counts by bucket are of fixed size: each task adds up its own, and the driver holds ``buckets`` gains. Ranks come from a
sort by ranges: a row's place in its range and the numbers of rows of the ranges before.

Null and empty texts have no words and no features: weight 0, never drawn. A null doc_id is hashed as no text, and comes
last in ties. Rows that repeat one another are drawn one by one. Empty tables give no rows, an empty target no counts.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import bounded_batches, delete, written
from folioforge.llm.words import words

ORDER, BUCKETS = 3, 10_000
PERCENT, LEAST_WORDS, SEED = 5, 20, 42

FEATURES = "doc_id long, text_key long, n_words long, buckets binary"


def buckets_of(texts: list[bytes], order: int = ORDER, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, end of each text's features, bucket of each feature in text order)."""
    found: list[bytes] = []
    ends = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        found += words(text)
        ends[i] = len(found)
    n_words = np.diff(ends, prepend=0)
    place = np.arange(len(found)) - np.repeat(ends - n_words, n_words)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in found), np.int64, len(found))
    named = list(index)
    out = np.zeros((len(found), order), np.uint16)
    tuples = ids  # of the n-gram that ends at each place
    grams = named  # the bytes of each distinct tuple
    for n in range(1, order + 1):
        at = np.flatnonzero(place >= n - 1)
        if n > 1:
            tuples_before = tuples
            codes, distinct = pd.factorize((tuples_before[at - 1] << 32) | ids[at])
            grams = list(map(b" ".join, zip(map(grams.__getitem__, (distinct >> 32).tolist()), map(named.__getitem__, (distinct & 0xFFFFFFFF).tolist()), strict=True)))
            tuples = np.zeros(len(found), np.int64)
            tuples[at] = codes
        hashed = np.fromiter(map(crc32, grams), np.int64, len(grams)) % buckets
        out[at, n - 1] = hashed[tuples[at]]
    features = np.minimum(place[:, None] + 1, order) > np.arange(order)[None, :]
    return n_words, np.cumsum(sum((np.maximum(n_words - n, 0) for n in range(order)), np.zeros(len(texts), np.int64))), out[features]


def features(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """Per row of (doc_id, text): doc_id, text_key (a hash of the text), n_words and the buckets of its features, 16 bits each."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket has 16 bits")
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, ends, found = buckets_of([x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()], order, buckets)
            offsets = np.concatenate(([0], ends * 2)).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(found.astype("<u2").tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n_words, pa.int64()), packed], ["doc_id", "text_key", "n_words", "buckets"])

    return texts.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, FEATURES)


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 16-bit values of all rows and the end of each row's, with a leading 0."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 2
    data = column.buffers()[2]
    values = np.frombuffer(data, "<u2", int(ends[-1])) if data is not None and len(data) else np.empty(0, np.uint16)
    return values[ends[0] :], ends - ends[0]


def histogram(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall in each bucket: counted by each task, then added up by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_packed(batch.column(0))[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held, pa.int64()), "n": pa.array(total[held], pa.int64())})

    rows = found.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's shares in the target and in the source, each count raised by one."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + n) / ((x + 1) * (t + n)))) for x, y in zip(map(float, source), map(float, target), strict=True)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel value that the seed and the doc_id fix."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, text_key, n_words, n_features and weight of rows of ``features``: the sum of their buckets' gains."""
    shared = found.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = _packed(batch.column("buckets"))
            total = np.concatenate(([0], np.cumsum(shared.value[values])))
            n = [batch.column(c) for c in ("doc_id", "text_key", "n_words")]
            yield pa.RecordBatch.from_arrays([*n, pa.array(np.diff(ends).astype(np.int64)), pa.array(total[ends[1:]] - total[ends[:-1]])], ["doc_id", "text_key", "n_words", "n_features", "weight"])

    return found.mapInArrow(weigh, "doc_id long, text_key long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list[Column], limit: Column | int) -> DataFrame:
    """The rows with their place in the order (1, 2, 3, ...), null beyond the limit. The order must tell all rows apart."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_ranges, at = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ranges")
    # A place is the number of its task, and below 33 bits its number in the task.
    task = F.shiftright("place", 33)
    sizes = sorted((r["task"], r["count"]) for r in in_ranges.groupBy(task.alias("task")).count().collect())
    before, firsts = 0, []
    for number, n in sizes:  # as many as there are ranges
        firsts.append((number, before))
        before += n
    starts = spark.createDataFrame(firsts, "task long, before long")
    place = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    told = in_ranges.withColumn("task", task).join(F.broadcast(starts), "task").withColumn("rank", F.when(place <= limit, place))
    return told.drop("task", "before", "place")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, target_text: str = "text") -> DataFrame:
    """One row per row of the documents: doc_id, text_key, n_words, n_features, weight, score (the weight and the noise), and
    rank: of the N rows of at least ``least_words`` words, those of the floor(percent * N / 100) highest scores have one,
    ties by smaller doc_id; null for the others."""
    spark = docs.sparkSession
    found, found_at = written(features(docs, order, buckets), "features")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text")), order, buckets)
    gain = gains(histogram(found, buckets), histogram(wanted, buckets))
    scored, scored_at = written(weights(found, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    delete(spark, found_at)
    n = scored.where(F.col("n_words") >= least_words).count()
    numbered = scored.withColumn("short", F.col("n_words") < least_words).withColumn("row", F.monotonically_increasing_id())
    return ranked(numbered, [F.asc("short"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], percent * n // 100).drop("short", "row")


def drawn(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The documents that are drawn, all their columns. Rows of one doc_id and text come together, if one of them is drawn."""
    chosen = resample(docs, target, **parameters).where("rank is not null").select(F.col("doc_id").alias("drawn_id"), F.col("text_key").alias("drawn_text"))
    return docs.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col("drawn_id")) & (F.xxhash64("text") == F.col("drawn_text")), "left_semi")
