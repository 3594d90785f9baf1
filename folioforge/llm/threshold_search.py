"""Ranked lexical search by Fagin's threshold algorithm.

One scan of the documents keeps, of each, its number of terms and how often the queries' terms occur in it: the forward
index, written to the shared folder. N, L and the terms' document frequencies come from it as sums of fixed-size counts.
A task then takes its documents in shards. In a shard every term has a list of its documents by falling impact. For each query the
lists are read in turn, ``STEP`` entries of each at a time; documents seen for the first time are scored whole by
the forward index; reading ends once the threshold, the sum of the impacts last read, is strictly below the k-th score, so
that ties are never lost. The shards' k best meet in two steps, by query and part, then by query.

The queries' terms are held by each task: queries of more than ``QUERY_BYTES`` of text are answered in parts, each with a scan of
its own. Documents are never collected, and no list or shard grows beyond ``SHARD_POSTINGS`` entries and one document.

Null and empty texts, and those without a term, are no documents (N) and never found; such queries have no rows. Rows that
repeat a doc_id are documents of their own; a null doc_id comes last in ties. Rows that repeat an item_id are
queries of their own. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.llm.common import bounded_batches, delete, written
from folioforge.llm.words import words

TOP, STEP = 10, 16
QUERY_BYTES = 8 << 20
#: A shard's postings (16 bytes each in the index) and documents, at most.
SHARD_POSTINGS, SHARD_DOCS = 2_000_000, 16_384
#: Parts in which the shards' results for one query meet first.
PARTS = 32

FORWARD = "doc_id long, n long, terms array<int>, tfs array<int>"


class Queries(NamedTuple):
    """The queries of one part: their ids, their terms by number with how often each occurs, and the numbers of terms."""

    ids: list[int | None]
    terms: list[dict[int, int]]
    vocabulary: dict[bytes, int]


def read_queries(rows: list[tuple[int | None, str | None]]) -> Queries:
    vocabulary: dict[bytes, int] = {}
    terms = [{vocabulary.setdefault(w, len(vocabulary)): c for w, c in Counter(words((text or "").encode())).items()} for _, text in rows]
    return Queries([i for i, _ in rows], terms, vocabulary)


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, its number of terms, and those of the vocabulary that occur in it, with how often."""
    bounded_batches(docs.sparkSession)
    shared, size = docs.sparkSession.sparkContext.broadcast(vocabulary), max(1, len(vocabulary))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            found: list[bytes] = []
            ends = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found += words(text or b"")
                ends.append(len(found))
            n = np.diff(np.array(ends, np.int64), prepend=0)
            term = np.fromiter(map(number, found, repeat(-1)), np.int64, len(found))
            row = np.repeat(np.arange(len(n)), n)
            keys, tfs = np.unique((row * size + term)[term >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(keys, np.arange(len(n) + 1) * size), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array((keys % size).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(tfs.astype(np.int32)))],
                ["doc_id", "n", "terms", "tfs"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, FORWARD)


def statistics(forward: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all terms with repeats, documents holding each term of the vocabulary)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(held, pa.int64()), "df": pa.array(df[held], pa.int64())})

    out = np.zeros(size, np.int64)
    for r in forward.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    whole = forward.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return whole["docs"], whole["terms"], out


def term_weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Shard:
    """Some documents, with lists by term and falling impact, and the forward index by document."""

    def __init__(self, lengths: list[int], counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n: int, total: int, weight: np.ndarray) -> None:
        m = np.array([25 + 75 * x * n // total for x in lengths], np.int64)  # in unbounded integers
        self.begin = np.concatenate(([0], np.cumsum(counts)))
        doc = np.repeat(np.arange(len(counts)), counts)
        tf = tfs.astype(np.int64)
        self.term, self.impact = terms, weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.lexsort((-self.impact, terms))
        self.listed_doc, self.listed_impact = doc[order], self.impact[order]
        self.list_at = np.searchsorted(terms[order], np.arange(len(weight) + 1))
        self.factor = np.zeros(len(weight), np.int64)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """The whole scores of documents that hold a term: one lookup each in the forward index."""
        n = self.begin[docs + 1] - self.begin[docs]
        first = np.cumsum(n) - n
        at = np.repeat(self.begin[docs] - first, n) + np.arange(int(n.sum()))
        return np.add.reduceat(self.impact[at] * self.factor[self.term[at]], first)

    def best(self, query: dict[int, int], keys: np.ndarray, top: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores) of the best by score, then key; and how many documents were looked up."""
        terms = np.fromiter(query, np.int64, len(query))
        begin, end = self.list_at[terms], self.list_at[terms + 1]
        times = np.fromiter(query.values(), np.int64, len(query))
        held = begin < end
        begin, end, times = begin[held], end[held], times[held]
        self.factor[terms] = list(query.values())
        seen = np.zeros(len(keys), bool)
        docs, scores, depth, looked_up = np.empty(0, np.int64), np.empty(0, np.int64), 0, 0
        while len(begin):
            stop = np.minimum(begin + depth + step, end)
            fresh = np.unique(np.concatenate([self.listed_doc[a:b] for a, b in zip((begin + depth).tolist(), stop.tolist(), strict=True)]))
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            looked_up += len(fresh)
            if len(fresh):
                docs, scores = np.concatenate((docs, fresh)), np.concatenate((scores, self.scores(fresh)))
                kept = np.lexsort((keys[docs], -scores))[:top]
                docs, scores = docs[kept], scores[kept]
            depth += step
            going = begin + depth < end
            begin, end, times = begin[going], end[going], times[going]
            threshold = int((times * self.listed_impact[begin + depth - 1]).sum())
            if threshold == 0 or (len(docs) == top and threshold < scores[-1]):
                break
        self.factor[terms] = 0
        return docs[scores > 0], scores[scores > 0], looked_up


def _part(docs: DataFrame, queries: Queries, top: int) -> tuple[DataFrame, list[str]]:
    """(query's number, doc_id, score) of the shards' best, and the folders that hold what it reads."""
    forward, at = written(forward_index(docs, queries.vocabulary), "forward-index")
    n, total, df = statistics(forward, len(queries.vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast((queries.terms, term_weights(n, df)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value

        def answer(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks()
            counts = np.diff(rows["terms"].combine_chunks().offsets.to_numpy())
            flat = lambda c: rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            shard = Shard(rows["n"].to_pylist(), counts, flat("terms"), flat("tfs"), n, total, weight)
            keys = rows["doc_id"].fill_null(2**63 - 1).to_numpy()
            found = [shard.best(q, keys, top)[:2] for q in asked]
            place = np.concatenate([d for d, _ in found] or [np.empty(0, np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asked)), [len(d) for d, _ in found])), rows["doc_id"].combine_chunks().take(pa.array(place)), pa.array(np.concatenate([s for _, s in found] or [place]))], ["query", "doc_id", "score"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for row in range(0, len(batch), 1000):
                part = batch.slice(row, 1000)
                here = len(part.column("terms").flatten())
                if held and (size + here > SHARD_POSTINGS or sum(map(len, held)) + len(part) > SHARD_DOCS):
                    yield answer(held)
                    held, size = [], 0
                held.append(part)
                size += here
        if held:
            yield answer(held)

    return forward.where(F.size("terms") > 0).mapInArrow(search, "query long, doc_id long, score long"), [at]


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, item: str = "item_id", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents (doc_id, text) of each row of the queries (item, text)."""
    spark = docs.sparkSession
    asked = queries.select(F.col(item).alias("item_id"), "text")
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    parts = -(-size // query_bytes)
    dealt, dealt_at = written(asked.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, parts)))), "queries")
    whole: DataFrame | None = None
    for part in range(parts):
        read = read_queries([(r["item_id"], r["text"]) for r in dealt.where(F.col("part") == part).orderBy("item_id", "text").collect()])
        found, folders = _part(docs, read, top)
        best = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= top)
        few = best(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), "query", "salt").select("query", "doc_id", "score")
        named = spark.createDataFrame(list(enumerate(read.ids)), f"query long, item_id {queries.schema[item].dataType.simpleString()}")
        told, _ = written(best(few, "query").join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score"), "found")
        for path in folders:
            delete(spark, path)
        whole = told if whole is None else whole.unionByName(told)
    delete(spark, dealt_at)
    return whole if whole is not None else spark.createDataFrame([], f"item_id {queries.schema[item].dataType.simpleString()}, rank int, doc_id long, score long")
