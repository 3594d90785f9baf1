"""Grouped prefix join on word shingles.

A document's set is its distinct shingles of ``width`` words (64-bit hashes). Documents with the same set
are one node. In a global order, rare shingles first, two sets of Jaccard similarity t or more share a
shingle among the first n - ceil(t n) + 1 of each, their prefixes. Nodes with the same size and the same
prefix form a group. Groups that share a prefix shingle make group pairs, filtered by size and by the
number and the last place of the shared prefix shingles; pairs that remain are expanded to their members,
filtered by their sketches and verified on the whole sets.

A node's sketch is one bit of parity for each of some n to 2n hash buckets of its set. Two sets differ in at least as many
shingles as their sketches in bits, so a pair whose sketches differ by more than linked sets can is no link;
no whole sets are made or moved for it.

The order goes by the counts of a fixed number of hash buckets over all shingles of all documents, then by
hash; any such order gives the same links. It keeps frequent shingles out of the prefixes. Where more than
``LIST`` groups share a prefix shingle all the same (many near copies of one text), no pairs are emitted: they are a
clump with a hub. First every node is verified against the hub, which is linear in the clump. Those that link to it are
connected already and are not compared with each other. The rest is dealt into blocks by size, each of which meets blocks of the whole clump of sizes that can link: each pair of blocks is
verified in one task as a product of incidence matrices, and only a spanning forest of its links leaves the task.

Links are those of the exact counts; hashes of 64 bits stand for shingles, and of 128 bits for sets.
A text without words (or null) has an empty set and no links. Rows that repeat a doc_id are documents of
their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import bounded_batches, delete, fresh_path, written
from folioforge.llm.components import connected_components
from folioforge.llm.textkernel import mix64, shingle_sets, slices

WIDTH, PERCENT = 4, 85
LOG_BUCKETS, SEGMENT = 20, 4096
#: Up to so many groups in a prefix shingle's list, its pairs are emitted; beyond, blocks of so many nodes are compared.
LIST, BLOCK = 48, 256
#: Broadcast up to so many rows of a few longs each; beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def need(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that it links to."""
    return -(-percent * n // 100)


def bucket_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How often the shingles of each of 2**LOG_BUCKETS hash buckets occur in all texts: a fixed-size array."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << LOG_BUCKETS, np.int64)
        for batch in batches:
            for _, part in slices(batch.column(0).to_pylist()):
                found = list(shingle_sets(part, width))
                if found:
                    total += np.bincount((np.concatenate(found) >> np.uint64(64 - LOG_BUCKETS)).astype(np.int64), minlength=1 << LOG_BUCKETS)
        if total.any():
            for at in range(0, len(total), SEGMENT):
                yield pa.RecordBatch.from_pydict({"segment": [at // SEGMENT], "counts": [zlib.compress(total[at : at + SEGMENT].tobytes(), 1)]}, schema=pa.schema([("segment", pa.int32()), ("counts", pa.binary())]))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in pdf["counts"])
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "counts": [zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)]})

    out = np.zeros(1 << LOG_BUCKETS, np.uint32)
    for row in docs.select("text").mapInArrow(count, "segment int, counts binary").groupBy("segment").applyInPandas(add, "segment int, counts binary").toLocalIterator():
        out[row["segment"] * SEGMENT : (row["segment"] + 1) * SEGMENT] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return out


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        return np.array([mix64(hashes).sum(dtype=np.uint64), mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64).tobytes()


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The parities of the set's counts in B buckets by hash modulo B, 64 to a long; B is the largest 64 * 2**i up to twice the set's size."""
    bits = 64 << max(0, (len(hashes) // 32).bit_length() - 1)
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def may_link(nx: Column, x: Column, ny: Column, y: Column, percent: int) -> Column:
    """False only where sets of nx and ny with the sketches x and y can't link. Of sketches of which one is twice as long, that
    one is folded; sketches of other lengths tell nothing."""
    fold = lambda one, other: F.when(
        F.size(one) > F.size(other), F.zip_with(F.slice(one, 1, F.size(other)), F.slice(one, F.size(other) + 1, F.size(other)), lambda a, b: a.bitwiseXOR(b))
    ).otherwise(one)
    differ = F.aggregate(F.zip_with(fold(x, y), fold(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, n: total + n)
    told = F.greatest(F.size(x), F.size(y)) <= 2 * F.least(F.size(x), F.size(y))
    return ~told | ((100 + percent) * differ <= (100 - percent) * (nx + ny))


def signatures(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """Per row: doc_id, text_key (a hash of the text), n (set size), set_key, group_key (of size and prefix), the prefix in the global order and the sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int32()), ("set_key", pa.binary()), ("group_key", pa.binary()), ("prefix", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for at, part in slices(batch.column(1).to_pylist()):
                rows: dict[str, list] = {name: [] for name in schema.names}
                for i, hashes in enumerate(shingle_sets(part, width), at):
                    n = len(hashes)
                    keep = n - need(n, percent) + 1 if n else 0
                    c = rank[(hashes >> np.uint64(64 - LOG_BUCKETS)).astype(np.int64)]
                    prefix = _signed(hashes[np.argsort(c, kind="stable")[:keep]])
                    for name, value in zip(schema.names, (ids[i], keys[i], n, set_key(hashes), hashlib.md5(prefix.tobytes() + n.to_bytes(8, "little")).digest(), prefix, sketch(hashes)), strict=True):
                        rows[name].append(value)
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(sign, "doc_id long, text_key long, n int, set_key binary, group_key binary, prefix array<long>, sketch array<long>")


def whole_sets(docs: DataFrame, nodes: DataFrame, n_nodes: int, width: int) -> DataFrame:
    """node, its whole set, from the text of the node's first document, and its number of rows. Nodes of several rows come
    more than once where rows repeat a doc_id."""
    schema = pa.schema([("set_key", pa.binary()), ("hashes", pa.list_(pa.int64()))])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch.column(0).to_pylist()):
                found = list(shingle_sets(part, width))
                yield pa.RecordBatch.from_pydict({"set_key": [set_key(h) for h in found], "hashes": [_signed(h) for h in found]}, schema=schema)

    wanted = nodes.select("first_doc", "set_key", "node", "copies")
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), "text").join(_small(wanted.select("first_doc").distinct(), n_nodes), F.col("d").eqNullSafe(F.col("first_doc")), "left_semi")
    return texts.select("text").mapInArrow(sets, "set_key binary, hashes array<long>").join(_small(wanted.select("set_key", "node", "copies"), n_nodes), "set_key").select("node", "hashes", "copies")


def forest(inside: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges (node, root) of a boolean adjacency matrix."""
    left, out = np.ones(len(inside), bool), []
    for root in range(len(inside)):
        if not left[root]:
            continue
        left[root] = False
        front = inside[root] & left
        while front.any():
            left &= ~front
            out.extend((int(i), root) for i in np.flatnonzero(front))
            front = inside[front].any(axis=0) & left
    return out


def block_links(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets in ``first`` and those in ``second``."""
    n, size = np.array([len(s) for s in sets], np.int64), len(sets)
    tokens, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(size), n)
    twice = times[column] > 1
    row, column = row[twice], (np.cumsum(times > 1) - 1)[column[twice]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common, step = np.zeros((size, size), np.float32), 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (at, at + step))
        part = np.zeros((size, step), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        common += part @ part.T
    shared = common.astype(np.int64)
    linked = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
    linked &= (first[:, None] & second[None, :]) | (second[:, None] & first[None, :])
    return forest(linked)


def _by_hubs(clumps: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(rest, members, edges, folders): edges from nodes of a clump to its hub, which names it, and the nodes that don't
    link to it. A hub is sent to as many tasks as its clump has blocks of nodes."""
    same = ["clump", "kind"]
    members, members_at = written(clumps.join(nodes.select("node", "n"), "node"), "clump-members")
    hubs = members.groupBy(*same).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"))
    dealt = members.join(hubs, same).withColumn("part", F.pmod(F.xxhash64("node"), "nb").cast("int")).join(sets, "node")
    centre = hubs.join(sets.select(F.col("node").alias("clump"), F.col("hashes").alias("centre")), "clump").select(*same, "centre", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("part"))
    shared = F.size(F.array_intersect("hashes", "centre"))
    told, told_at = written(dealt.join(centre.hint("merge"), [*same, "part"]).select(*same, "node", "n", (100 * shared >= percent * (F.size("hashes") + F.size("centre") - shared)).alias("linked")), "hub-links")
    edges = told.where("linked and node <> clump").select(F.col("clump").alias("a"), F.col("node").alias("b"))
    return told.where("not linked").select(*same, "node", "n"), members, edges, [members_at, told_at]


def _meetings(rest: DataFrame, members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of the rest (side 0) and those of their clumps (side 1) for each pair of blocks (bi, bj) that can link."""
    same = ["clump", "kind"]
    size = F.log(F.col("n").cast("double")) / float(np.log(100 / percent))  # sets whose sizes differ by over one step can't link
    step = F.floor(size).cast("int")
    blocks = lambda df, by: df.groupBy(*same, "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(by))
    few, whole = rest.withColumn("step", step), members.withColumn("step", step)
    nf, nw = blocks(few, "nf"), blocks(whole, "nw")
    few = few.join(nf, [*same, "step"]).withColumn("i", F.pmod(F.xxhash64("node"), "nf").cast("int"))
    whole = whole.join(nw, [*same, "step"]).withColumn("j", F.pmod(F.xxhash64("node"), "nw").cast("int"))
    pairs = nf.select(*same, F.col("step").alias("sf"), "nf").join(nw.select(*same, F.col("step").alias("sw"), "nw"), same).where("abs(sf - sw) <= 1")
    name = lambda s, k: F.concat_ws("-", s, k)
    left = few.withColumnRenamed("step", "sf").drop("nf").join(pairs, [*same, "sf"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nw") - 1)))
    right = whole.withColumnRenamed("step", "sw").drop("nw").join(pairs, [*same, "sw"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nf") - 1)))
    cut = lambda df, side: df.select(*same, name("sf", "i").alias("bi"), name("sw", "j").alias("bj"), F.lit(side).alias("side"), "node")
    return cut(left, 0), cut(right, 1)


def links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows, edges, folders): rows with doc_id, n, set_key, node (null for an empty set); edges (a, b) between
    nodes, which keep every linked set connected with its partners; the shared folders that hold them."""
    bounded_batches(docs.sparkSession)
    counts = bucket_counts(docs, width)
    signed, signed_at = written(signatures(docs, counts, width, percent), "signatures")
    nodes, nodes_at = written(
        signed.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("group_key").alias("group_key"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    groups, groups_at = written(nodes.groupBy("group_key").agg(F.min("node").alias("grp"), F.first("n").alias("n"), F.count(F.lit(1)).alias("members"), F.first("prefix").alias("prefix")), "groups")

    tokens = groups.select("grp", "n", F.posexplode("prefix").alias("pos", "token"))
    lists, lists_at = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "lists")
    listed, listed_at = written(tokens.join(_small(lists, lists.count()), "token"), "listed")

    # Lists of moderate length: group pairs, filtered, then expanded to pairs of members.
    short = listed.where(F.col("k") <= LIST)
    x, y = short.alias("x"), short.alias("y")
    both = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.grp") < F.col("y.grp")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")))
    rest = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) - 1
    pairs = (
        both.groupBy(F.col("x.grp").alias("gx"), F.col("y.grp").alias("gy"))
        .agg(F.count(F.lit(1)).alias("c"), F.max("x.pos").alias("px"), F.max("y.pos").alias("py"), F.first("x.n").alias("nx"), F.first("y.n").alias("ny"))
        .where((100 + percent) * (F.col("c") + rest) >= percent * (F.col("nx") + F.col("ny")))
        .select("gx", "gy")
    )
    members = nodes.join(groups.select("group_key", "grp", "members"), "group_key").select("grp", "members", "node", "n", "sketch")
    few, many = members.where(F.col("members") <= LIST), members.where(F.col("members") > LIST)
    side = lambda df, grp, node: df.select(F.col("grp").alias(grp), *(F.col(c).alias(c + node) for c in ("n", "sketch")), F.col("node").alias(node))
    one = few.where("members > 1")
    inside = side(one, "grp", "a").join(side(one, "grp", "b"), "grp").where("a < b").drop("grp")
    expanded = pairs.join(side(members, "gx", "a"), "gx").join(side(members, "gy", "b"), "gy").select(*inside.columns).unionByName(inside)
    linkable = may_link(F.col("na"), F.col("sketcha"), F.col("nb"), F.col("sketchb"), percent)
    candidates, candidates_at = written(expanded.where(linkable).select("a", "b"), "candidates")

    # Long lists, and large groups: clumps of nodes, compared in blocks.
    # Lists with the same hub (the node that is in most long lists) are one clump: near copies of one text share
    # many shingles, and so are sent once instead of once for each list.
    long_lists, long_at = written(listed.where(F.col("k") > LIST).select("token", "grp").join(members, "grp").select("token", "node"), "long-lists")
    in_lists = long_lists.groupBy("node").agg(F.count(F.lit(1)).alias("h"))
    hubs = long_lists.join(in_lists, "node").groupBy("token").agg(F.max(F.struct("h", "node")).alias("hub"))
    by_hub = long_lists.join(hubs, "token").select(F.col("hub.node").alias("clump"), F.lit(0).alias("kind"), "node").distinct()
    clumps, clumps_at = written(by_hub.unionByName(many.select(F.col("grp").alias("clump"), F.lit(1).alias("kind"), "node")), "clumps")

    wanted, wanted_at = written(candidates.select(F.col("a").alias("node")).unionByName(candidates.select(F.col("b").alias("node"))).unionByName(clumps.select("node")).distinct().join(nodes.select("node", "first_doc", "set_key", "copies"), "node"), "wanted")
    found, sets_at = written(whole_sets(docs, wanted, wanted.count(), width), "sets")
    sets = found.where("copies = 1").unionByName(found.where("copies > 1").dropDuplicates(["node"])).select("node", "hashes")

    a, b = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    shared = F.size(F.array_intersect("ha", "hb"))
    verified = candidates.join(a, "a").join(b, "b").where(100 * shared >= percent * (F.size("ha") + F.size("hb") - shared)).select("a", "b")

    rest, sized_clumps, by_hub, clump_folders = _by_hubs(clumps, sets, nodes, percent)
    first, other = _meetings(rest, sized_clumps, percent)
    dealt = first.unionByName(other).join(sets, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        # A node may be on both sides, as rest and as part of the whole clump.
        sides = pdf.groupby("node", sort=True).agg(side=("side", "max"), low=("side", "min"), hashes=("hashes", "first"))
        node = sides.index.to_numpy()
        found = block_links([np.asarray(h, np.int64) for h in sides["hashes"]], sides["low"].to_numpy() == 0, sides["side"].to_numpy() == 1, percent)
        return pd.DataFrame({"a": [node[i] for i, _ in found], "b": [node[j] for _, j in found]}, dtype="int64")

    in_blocks = dealt.groupBy("clump", "kind", "bi", "bj").applyInPandas(compare, "a long, b long")
    edges, edges_at = written(verified.unionByName(by_hub).unionByName(in_blocks), "edges")
    for path in (groups_at, lists_at, listed_at, candidates_at, long_at, clumps_at, wanted_at, sets_at, *clump_folders):
        delete(docs.sparkSession, path)
    rows = signed.join(nodes.select("set_key", "node", "first_doc"), "set_key", "left").select("doc_id", "text_key", "n", "set_key", "node", "first_doc")
    return rows, edges, [signed_at, nodes_at, edges_at]


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of the table: doc_id, n_shingles, component_id (smallest doc_id reachable by links),
    set_key, first_in_set (smallest doc_id with the same set), text_key (a hash of the text), and component (a name of the
    component, null for empty sets)."""
    rows, edges, folders = links(docs, width, percent)
    labels = connected_components(edges)
    firsts = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    smallest = labels.join(firsts, "node").groupBy("component").agg(F.min("first").alias("smallest"))
    named = labels.join(smallest, "component").select(F.col("node").alias("linked"), "smallest", "component")
    told = rows.join(named, F.col("node") == F.col("linked"), "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("smallest", "first_doc", "doc_id").alias("component_id"), "set_key", F.coalesce("first_doc", "doc_id").alias("first_in_set"), "text_key", F.coalesce("component", "node").alias("component"))
    out, _ = written(told, "components")
    for path in folders:
        delete(docs.sparkSession, path)
    return out


__all__ = ["block_links", "components", "fresh_path", "links"]
