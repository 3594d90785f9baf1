"""Token ids in Arrow files of equal-length sequences.

Documents are put in ascending order of doc_id, shard by shard. Each shard is one Arrow IPC file whose
record batches hold ``BATCH`` rows of two fixed-size lists of ``length`` values: ``ids`` (unsigned 16-bit if
the vocabulary fits, else 32-bit) and ``mask`` (bits: true for an id, false for the padding after the shard's
last id). Sequence i of a file is thus row i % BATCH of batch i // BATCH: found without a scan and,
memory-mapped, read without a copy. A second Arrow file beside it has a row for each document: doc_id, start
within the shard, n_tokens.

Files are written under names of their own and listed in a manifest only when their task has ended well, so
a task that is run again, or twice, does no harm. They are opened through Arrow's file systems by the
folder's URI.

Null text counts as empty: such a document has the end id alone. Null doc_id comes first. Rows that repeat
a doc_id follow each other, ordered by a hash of their text. An empty table gives an empty manifest. Other
columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.llm.common import bounded_batches, fresh_path, written
from folioforge.llm.encoder import WordEncoder

LENGTH, BATCH, END_ID = 2048, 64, 2
#: A shard has so much text, or more where there would be more shards than the other bound.
SHARD_BYTES, MAX_SHARDS = 32 << 20, 20_000
MANIFEST = "shard int, path string, n_docs long, n_ids long"


def opened(uri: str):
    """Arrow's file system for a URI or a local path, and the path in it."""
    from pyarrow import fs

    # Hadoop's names of object stores.
    for name, other in (("s3a://", "s3://"), ("s3n://", "s3://")):
        uri = other + uri[len(name) :] if uri.startswith(name) else uri
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def sequence_schema(length: int, dtype: str = "<u4") -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


DOCS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Takes ids piece by piece and writes full batches of sequences; the rest is padded at the end."""

    def __init__(self, sink, length: int, batch: int = BATCH, dtype: str = "<u4") -> None:
        self.length, self.batch, self.schema, self.dtype = length, batch, sequence_schema(length, dtype), np.dtype(dtype)
        self.out, self.parts, self.waiting, self.total = pa.ipc.new_file(sink, self.schema), [], 0, 0

    def _emit(self, ids: np.ndarray, n_real: int) -> None:
        mask = np.arange(len(ids)) < n_real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(lists, self.schema, strict=True)], schema=self.schema))

    def add(self, raw: bytes) -> None:
        self.parts.append(raw)
        self.waiting += len(raw) // self.dtype.itemsize
        self.total += len(raw) // self.dtype.itemsize
        full = self.length * self.batch
        if self.waiting >= full:
            ids = np.frombuffer(b"".join(self.parts), self.dtype)
            n = len(ids) // full * full
            for at in range(0, n, full):
                self._emit(ids[at : at + full], full)
            self.parts, self.waiting = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> None:
        if self.waiting:
            ids = np.zeros(-(-self.waiting // self.length) * self.length, self.dtype)
            ids[: self.waiting] = np.frombuffer(b"".join(self.parts), self.dtype)
            self._emit(ids, self.waiting)
        self.out.close()


class SequenceFile:
    """Random access to the sequences of one file: ``views(i)`` is (ids, mask) as Arrow arrays that are views of the
    mapped file; ``file[i]`` the same for numpy, which has no arrays of bits: the mask's are spread to bytes."""

    def __init__(self, path: str, batch: int = BATCH) -> None:
        where, name = opened(path)
        source = pa.memory_map(name) if where.type_name == "local" else where.open_input_file(name)
        self.reader, self.batch = pa.ipc.open_file(source), batch
        self.length = self.reader.schema.field("ids").type.list_size
        n = self.reader.num_record_batches
        self.rows = (n - 1) * batch + self.reader.get_batch(n - 1).num_rows if n else 0

    def __len__(self) -> int:
        return self.rows

    def views(self, i: int) -> tuple[pa.Array, pa.Array]:
        if not 0 <= i < self.rows:
            raise IndexError(i)
        rows, at = self.reader.get_batch(i // self.batch), i % self.batch * self.length
        return tuple(rows.column(c).values.slice(at, self.length) for c in (0, 1))

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.views(i)
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def runs(self) -> Iterator[np.ndarray]:
        """All ids, padding included, batch by batch."""
        for k in range(self.reader.num_record_batches):
            yield self.reader.get_batch(k).column(0).values.to_numpy(zero_copy_only=True)


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, length: int = LENGTH, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes and writes all documents; returns the manifest (shard, path, n_docs, n_ids, base: ids before the shard)."""
    bounded_batches(docs.sparkSession)
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    size = docs.agg(F.sum(F.octet_length("text") + F.lit(16)).alias("b")).first()["b"] or 0
    shards = max(1, min(MAX_SHARDS, -(-size // shard_bytes)))
    # Rows that repeat a doc_id, or each other, may lie in several shards.
    order = (F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("r"))
    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("r")).repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    run = uuid.uuid4().hex[:8]
    manifest = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = writer = end = None
        ids, starts, sizes = [], [], []
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}-{run}-{uuid.uuid4().hex[:8]}.arrow"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                where, name = opened(path)
                where.create_dir(name.rpartition("/")[0], recursive=True)
                encoder, sink = WordEncoder(tokenizer), where.open_output_stream(name)
                writer, end = SequenceWriter(sink, length, dtype=encoder.dtype), np.array([end_id], encoder.dtype).tobytes()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encoder.ids(text.as_py()) + end
                ids.append(doc_id)
                starts.append(writer.total)
                sizes.append(len(raw) // writer.dtype.itemsize)
                writer.add(raw)
        if writer is not None:
            writer.close()
            sink.close()
            with where.open_output_stream(f"{name}.docs") as out, pa.ipc.new_file(out, DOCS_SCHEMA) as file:
                file.write_table(pa.table([pa.array(x, pa.int64()) for x in (ids, starts, sizes)], schema=DOCS_SCHEMA), max_chunksize=65536)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [len(ids)], "n_ids": [writer.total]}, schema=manifest)

    listed, _ = written(ordered.mapInArrow(encode, MANIFEST), "manifest")
    _delete_leftovers(docs.sparkSession, folder, run, {r["path"].rpartition("/")[2] for r in listed.select("path").collect()})
    # A row for each file: the running sum over them is small.
    return listed.withColumn("base", F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids"))


def _delete_leftovers(spark, folder: str, run: str, listed: set[str]) -> None:
    """Deletes the files of this run's attempts that failed; the names of at most ``MAX_SHARDS`` files are compared."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(where) if files.exists(where) else []:
        name = status.getPath().getName()
        if f"-{run}-" in name and name.removesuffix(".docs") not in listed:
            files.delete(status.getPath(), False)


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, name = opened(path)
                runs, run, run_at = SequenceFile(path).runs(), np.empty(0, np.uint16), 0
                with where.open_input_file(f"{name}.docs") as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        docs = index.get_batch(k)
                        sums = []
                        for start, n in zip(docs.column(1).to_numpy(), docs.column(2).to_numpy(), strict=True):
                            crc = 0
                            while n:
                                if start >= run_at + len(run):
                                    run_at += len(run)
                                    run = next(runs)
                                    continue
                                part = run[start - run_at : start - run_at + n]
                                crc = zlib.crc32(part.astype("<u4"), crc)
                                start, n = start + len(part), n - len(part)
                            sums.append(crc)
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(docs.column(1).to_numpy() + base), docs.column(2), pa.array(sums, pa.int64())], schema=schema)

    files = manifest.select("path", "base")
    return files.repartition(max(1, min(files.count(), 4096))).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
