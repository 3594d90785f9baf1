"""Exact top-k by inner product: branch and bound over a vertical layout.

Vectors are written once to the shared folder in blocks of ``BLOCK`` vectors. A block holds, for each ``WIDTH`` dimensions, a
matrix with a row for each dimension, and for each vector the length of what lies beyond those dimensions, its remaining mass.
Dimensions come in falling order of their mass over all vectors. A task meets its blocks one after
another: scores are accumulated matrix by matrix; after each, a vector's score so far and the product of both
remaining masses bound its score, and the vectors whose bound lies below the query's k-th score are dropped from the
rest (compacted by their places). Ties stay, as only lower bounds are dropped.

Components are floor(1024 * x). Sums are taken in doubles where all of them are exact (below 2**53 at most), else in
64-bit integers; vectors whose scores could pass 64 bits are an error. The queries are read by ``QUERY_BYTES`` at a time, each
part of them with one scan of the blocks, and each task gives the ``top`` best for a query.

Vectors that are null or hold a null or non-finite component take no part. A shorter vector is filled up by zeros. A
query meets every row with another vec_id; rows that repeat a vec_id are rows, and queries, of their own. A null vec_id is no
query, and comes last in ties. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.llm.common import bounded_batches, delete, fresh_path, written

TOP, SCALE = 10, 1024
BLOCK, WIDTH, TILE = 4096, 16, 128
QUERY_BYTES = 8 << 20
NULL_ID = 2**63 - 1

BLOCKS = "ids array<long>, parts array<binary>, masses array<binary>"


class Layout(NamedTuple):
    """The order of the dimensions, and the type whose sums are exact."""

    order: np.ndarray
    kind: str


def _whole(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, their lengths, their components) of a list column."""
    n = np.diff(column.offsets.to_numpy())
    if column.null_count:
        n = np.where(column.is_valid().to_numpy(zero_copy_only=False), n, 0)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    bad = np.bincount(np.repeat(np.arange(len(n)), n)[~np.isfinite(flat)], minlength=len(n)) > 0
    if column.null_count:
        bad |= ~column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(~bad)
    return rows, n[rows], np.floor(flat[np.repeat(~bad, n)] * scale)


def _filled(n: np.ndarray, flat: np.ndarray, dims: int) -> np.ndarray:
    """A row for each vector, filled up by zeros."""
    out = np.zeros((len(n), dims))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(n)), n), place] = flat
    return out


def measure(vectors: DataFrame, scale: int = SCALE) -> Layout:
    """From the mass and the largest component of each dimension over all vectors (as many rows as dimensions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, n, flat = _whole(batch.column(0), scale)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            mass, most = np.bincount(place, flat * flat), np.zeros(int(n.max(initial=0)))
            np.maximum.at(most, place, np.abs(flat))
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(len(most)), pa.int64()), "mass": pa.array(mass[: len(most)]), "most": pa.array(most)})

    rows = vectors.select("vector").mapInArrow(run, "dim long, mass double, most double").groupBy("dim").agg(F.sum("mass").alias("mass"), F.max("most").alias("most")).toPandas().sort_values("dim")
    bound = float((rows["most"] ** 2).sum())
    if bound >= 2**63:
        raise ValueError("scores of these vectors may pass 64 bits")
    return Layout(np.argsort(-rows["mass"].to_numpy(), kind="stable"), "float64" if bound < 2**53 else "int64")


def _masses(m: np.ndarray) -> np.ndarray:
    """For each block of dimensions (rows of m: dimensions) the length of what lies beyond it."""
    square = np.add.reduceat((m.astype(np.float64)) ** 2, np.arange(0, len(m), WIDTH), axis=0)
    beyond = np.cumsum(square[::-1], axis=0)[::-1] - square
    return np.sqrt(np.maximum(beyond, 0))


def blocks(vectors: DataFrame, layout: Layout, scale: int = SCALE, size: int = BLOCK) -> DataFrame:
    """Blocks of (vec_id, vector): ids, and for each block of dimensions the components, dimension by dimension, and the masses beyond."""
    bounded_batches(vectors.sparkSession)
    dims, cell = len(layout.order), "<i4" if layout.kind == "float64" else "<i8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids: list[int | None], m: np.ndarray) -> pa.RecordBatch:
            parts = [m[at : at + WIDTH].astype(cell).tobytes() for at in range(0, dims, WIDTH)]
            return pa.RecordBatch.from_pydict({"ids": [ids], "parts": [parts], "masses": [[x.tobytes() for x in _masses(m)]]}, schema=pa.schema([("ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.binary())), ("masses", pa.list_(pa.binary()))]))

        ids: list[int | None] = []
        held: list[np.ndarray] = []
        for batch in batches:
            rows, n, flat = _whole(batch.column(1), scale)
            ids += batch.column(0).take(pa.array(rows)).to_pylist()
            held.append(_filled(n, flat, dims))
            while len(ids) >= size:
                m = np.concatenate(held)
                yield block(ids[:size], m[:size].T[layout.order])
                ids, held = ids[size:], [m[size:]]
        if ids:
            yield block(ids, np.concatenate(held).T[layout.order])

    return vectors.mapInArrow(run, BLOCKS)


class Query(NamedTuple):
    """Queries of one part: ids, components (a row for each), and the masses beyond each block of dimensions."""

    ids: np.ndarray
    m: np.ndarray
    beyond: np.ndarray


class Best:
    """The best candidates of each query so far, and the score that a further one must reach."""

    def __init__(self, queries: int, top: int) -> None:
        self.top, self.floor, self.held = top, np.full(queries, -np.inf), {}

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if query in self.held:
            ids, scores = np.concatenate((self.held[query][0], ids)), np.concatenate((self.held[query][1], scores))
        kept = np.lexsort((ids, -scores))[: self.top]
        self.held[query] = ids[kept], scores[kept]
        if len(kept) == self.top:
            self.floor[query] = scores[kept[-1]]


def meet(queries: Query, ids: np.ndarray, parts: list[np.ndarray], beyond: np.ndarray, best: Best) -> int:
    """One block of candidates against all queries; how many components were multiplied."""
    work = 0
    for at in range(0, len(queries.ids), TILE):
        tile = slice(at, at + TILE)
        sums = queries.m[tile, :WIDTH] @ parts[0]
        work += sums.size * len(parts[0])
        bound = sums + queries.beyond[tile, 0][:, None] * beyond[0][None, :]
        alive = (bound + np.abs(bound) * 1e-9 + 1 >= best.floor[tile, None]) & (ids[None, :] != queries.ids[tile, None])
        for i in np.flatnonzero(alive.any(axis=1)):
            query = at + int(i)
            left = np.flatnonzero(alive[i])
            score = sums[i, left]
            for part in range(1, len(parts)):
                dims = slice(part * WIDTH, part * WIDTH + len(parts[part]))
                score = score + queries.m[query, dims] @ parts[part][:, left]
                work += len(left) * len(parts[part])
                bound = score + queries.beyond[query, part] * beyond[part][left]
                going = bound + np.abs(bound) * 1e-9 + 1 >= best.floor[query]
                left, score = left[going], score[going]
                if not len(left):
                    break
            if len(left):
                best.add(query, ids[left], score)
    return work


def _read(row: dict, kind: str, dims: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The ids, the matrices and the masses of a block."""
    ids = np.array([NULL_ID if i is None else i for i in row["ids"]], np.int64)
    cell = "<i4" if kind == "float64" else "<i8"
    parts = [np.frombuffer(p, cell).reshape(-1, len(ids)).astype(kind) for p in row["parts"]]
    return ids, parts, np.array([np.frombuffer(x) for x in row["masses"]]).reshape(-1, len(ids))


def _query(rows: list, layout: Layout, scale: int) -> Query:
    m = np.zeros((len(rows), len(layout.order)))
    for i, r in enumerate(rows):
        m[i, : len(r["vector"])] = np.floor(np.array(r["vector"], np.float64) * scale)
    m = m[:, layout.order]
    return Query(np.array([r["vec_id"] for r in rows], np.int64), m.astype(layout.kind), _masses(m.T).T)


def search(vectors: DataFrame, is_query: Column, top: int = TOP, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, query_bytes: int = QUERY_BYTES, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``top`` largest inner products of each query's row with all others."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    asked = vectors.where(is_query & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    whole = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = asked.where(F.col("vector").isNotNull() & whole)
    layout = measure(rows, scale)
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not len(layout.order):
        layout = Layout(np.array([0]), layout.kind)  # only vectors without components, whose products are 0
    table, table_at = written(blocks(rows, layout, scale, block), "vertical")
    parts = max(1, -(-asked.count() * len(layout.order) * 8 // query_bytes))
    dealt, dealt_at = written(asked.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))), "queries")
    found_at = fresh_path(spark, "found")
    done = 0
    for part in range(parts):
        query = _query(dealt.where(F.col("part") == part).collect(), layout, scale)
        if not len(query.ids):
            continue
        shared = spark.sparkContext.broadcast(query)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, done = shared.value, None
            for batch in batches:
                for row in batch.to_pylist():
                    done = done or Best(len(asked.ids), top)
                    meet(asked, *_read(row, layout.kind, len(layout.order)), done)
            for at, (ids, scores) in (done.held if done else {}).items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), at)), pa.array(np.full(len(ids), asked.ids[at])), pa.array([None if i == NULL_ID else i for i in ids.tolist()], pa.int64()), pa.array(scores.astype(np.int64))], ["query", "query_id", "vec_id", "score"])

        table.mapInArrow(run, "query long, query_id long, vec_id long, score long").withColumn("part", F.lit(part)).write.mode("append").parquet(found_at)
        shared.unpersist()
        done += 1
    for path in (table_at, dealt_at):
        delete(spark, path)
    if not done:
        return none
    found = spark.read.schema("query long, query_id long, vec_id long, score long, part int").parquet(found_at)
    order = Window.partitionBy("part", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
