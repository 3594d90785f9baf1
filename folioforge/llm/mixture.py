"""Mixing sources to target weights.

Each source's words, in a fixed order of its documents, are packed into blocks of ``block_words`` (the
last one may be shorter; sources of few words have smaller blocks, so that each has ``LEAST_BLOCKS`` of them or blocks of one word). The mix has as many block slots as the targets ask for, in output shards of about
``shard_slots``. A source's slots are dealt over the shards by a multinomial draw: down a tree of halves of the shards by
binomial draws, and where few are left by a draw for each, all seeded by their place in the tree. So the counts of each
source in each shard are multinomial, their totals over all shards are the targets, and a task finds the part of the
draw that it needs without the rest, at any size. The slots of a source, counted through all shards, are mapped through
pseudorandom permutations of the source's block indices, one for each pass over the source: no block is used an
(n+1)-th time before all were used n times. The blocks are joined to the slots by index.

Sources are ordered by code point, null last; weights repeat over them. No target exceeds ``max_repeat``
times its source's size; what lies above is shared anew by weight. Null or empty texts have no words
and take no part. Rows that repeat each other are packed one by one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS, LEAST_BLOCKS = 128, 64
SHARD_SLOTS = 4096
ROWS_PER_CHUNK = 4096
#: So many chunks of documents, and of slots, are one group of the level above.
FAN = 4096
#: Sources, and repeated rows, are broadcast up to so many (a short row each); beyond, they are joined by shuffling.
BROADCAST_ROWS = 1_000_000
SALT = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ordered_sources(sized: DataFrame) -> DataFrame:
    """source, source_size and source_no: their numbers in order of code points, null last."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = (F.col("source").isNull(), F.col("source"))
    ranged, _ = written(per.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("m", F.monotonically_increasing_id()), "source-sizes")
    part = F.shiftright("m", 33)
    before, offsets = 0, []  # a row for each partition
    for r in ranged.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets.append((r["p"], before))
        before += r["count"]
    starts = sized.sparkSession.createDataFrame(offsets, "p long, before long")
    return ranged.join(F.broadcast(starts), part == F.col("p")).select("source", "source_size", (F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("source_no"))


def targets(sources: DataFrame, weights: Sequence[float], share: float, max_repeat: int) -> DataFrame:
    """The sources with their target: what is left beside the sources at their most, in proportion to the weights.

    A source is at its most if its weight times the level, words for each unit of weight, exceeds that. Each round
    takes those out and raises the level for the others, until none is above."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("w", weight)
    most = F.col("source_size") * F.lit(max_repeat)
    level = 0.0
    while True:
        over = (F.col("w") * F.lit(level) > most) | (F.col("source_size") == 0)
        r = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, most).otherwise(0)).alias("fixed"), F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("w")).first()
        new = (share * (r["all"] or 0) - r["fixed"]) / r["w"] if r["w"] else level
        if new <= level:
            break
        level = new
    return weighed.withColumn("target", F.when(F.col("w") * F.lit(level) > most, most.cast("double")).otherwise(F.col("w") * F.lit(level)) * F.when(F.col("source_size") > 0, 1.0).otherwise(0.0)).drop("w")


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of [0, n): a Feistel network on the next even number of bits; places
    beyond n walk on until they are inside."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.Generator(np.random.Philox(key=[key & (2**64 - 1), n])).integers(0, 2**64, 4, dtype=np.uint64)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shards_of(draws: int, shards: int, begin: int, end: int, seed: int, few: int = SHARD_SLOTS) -> np.ndarray:
    """The shards of a source's slots from ``begin`` to ``end``: down the tree to the nodes that hold them."""
    out, todo = [], [(0, shards, draws, 0)]
    while todo:
        lo, hi, n, first = todo.pop()
        if not n or first + n <= begin or first >= end:
            continue
        at = slice(max(0, begin - first), max(0, min(n, end - first)))
        if hi - lo == 1:
            out.append(np.full(at.stop - at.start, lo))
            continue
        draw = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), lo * (shards + 1) + hi]))
        if n <= few:
            out.append(np.sort(draw.integers(lo, hi, n))[at])
            continue
        mid = (lo + hi) // 2
        left = int(draw.binomial(n, (mid - lo) / (hi - lo)))
        todo += [(mid, hi, n - left, first + left), (lo, mid, left, first)]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def slots(sources: DataFrame, shards: int, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """All slots of the mix from sources (source_no, blocks, draws): shard, slot (a random order within the shard),
    source_no, block, pass_no (how often the block was used before)."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for no, blocks, draws, begin in zip(batch["source_no"], batch["blocks"], batch["draws"], batch["begin"], strict=True):
                j = np.arange(begin, min(begin + shard_slots, draws))
                done, place = j // blocks, j % blocks
                block = np.empty_like(j)
                for p in np.unique(done):
                    here = done == p
                    block[here] = permuted(place[here], blocks, (seed << 40) ^ (int(no) << 16) ^ int(p))
                order = np.random.Generator(np.random.Philox(key=[(seed + 1) << 40 ^ int(no), int(begin)])).integers(0, 2**63, len(j))
                yield pd.DataFrame({"shard": shards_of(int(draws), shards, int(begin), int(begin) + len(j), (seed + 2) << 40 ^ int(no), shard_slots), "slot": order, "source_no": no, "block": block, "pass_no": done})

    step = FAN * shard_slots  # in two steps, as a source may have more pieces than one array holds
    coarse = sources.where("draws > 0").select("source_no", "blocks", "draws", F.explode(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1, F.lit(step).cast("long"))).alias("b"))
    fine = coarse.select("source_no", "blocks", "draws", F.explode(F.sequence(F.col("b"), F.least(F.col("draws"), F.col("b") + step) - 1, F.lit(shard_slots).cast("long"))).alias("begin"))
    return fine.repartition(max(1, min(shards, 4096)), "source_no", "begin").mapInPandas(fill, "shard long, slot long, source_no long, block long, pass_no long")


def _with_source(rows: DataFrame, sources: DataFrame, n_sources: int, *columns: str) -> DataFrame:
    """The rows with columns of their source. Beyond what is broadcast, rows of a source are dealt by a salt."""
    told = sources.select(F.col("source").alias("_s"), *columns)
    if n_sources <= BROADCAST_ROWS:
        return rows.join(F.broadcast(told), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    salted = told.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_m", F.pmod(F.col("rid"), F.lit(SALT)).cast("int")).join(salted.hint("merge"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_m") == F.col("_n"))).drop("_s", "_m", "_n")


def _numbered(sized: DataFrame) -> DataFrame:
    """The rows with ``copy``, their number among rows of the same document, text and source, and whether there are
    more than one. Copies are counted in the partitions they were written from, then these counts are summed, so a text
    that most rows repeat is not numbered by one task."""
    key = ["doc_id", "text_key", "source"]
    repeated, _ = written(sized.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*[F.col(k).alias(f"_{k}") for k in key]), "repeated")
    n = repeated.count()
    if not n:
        return sized.withColumn("copy", F.lit(0).cast("long")).withColumn("many", F.lit(False))
    same = lambda other: [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in key]
    told = sized.join(F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated.hint("merge"), same("_"), "left").withColumn("many", F.col("_text_key").isNotNull() | F.col("_doc_id").isNotNull() | F.col("_source").isNotNull())
    told = told.drop(*[f"_{k}" for k in key]).withColumn("part", F.shiftright("rid", 33))
    some = told.where("many")
    per = some.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("c"))
    before = per.select(*[F.col(k).alias(f"b_{k}") for k in key], F.col("part").alias("b_part"), (F.sum("c").over(Window.partitionBy(*key).orderBy("part")) - F.col("c")).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*key, "part").orderBy("rid")) - 1
    copies = some.withColumn("inside", inside).join(before, [*same("b_"), F.col("part") == F.col("b_part")]).withColumn("copy", (F.col("before") + F.col("inside")).cast("long")).select(*sized.columns, "copy", "many")
    return told.where("not many").select(*sized.columns, F.lit(0).cast("long").alias("copy"), "many").unionByName(copies)


def packed(rows: DataFrame, n: int, rows_per_chunk: int = ROWS_PER_CHUNK, fan: int = FAN) -> DataFrame:
    """The rows (rid, doc_id, text_key, copy, size, source_no, block_words) with first, the place of their first word among their
    source's words.

    The sum runs in three steps, so that no task holds a whole source: rows are dealt into chunks by a hash, ``fan``
    chunks are a group; the groups' sums are added up (a few thousand rows to a source at 10**11 documents), then those
    of the chunks of each group, then each chunk's own rows.
    """
    chunks = max(1, -(-n // rows_per_chunk))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_key", "copy"), F.lit(chunks)))
    sums = dealt.groupBy("source_no", "chunk").agg(F.sum("size").alias("s")).withColumn("grp", F.expr(f"chunk div {fan}"))
    groups = sums.groupBy("source_no", "grp").agg(F.sum("s").alias("g"))
    group_first = groups.select("source_no", "grp", (F.sum("g").over(Window.partitionBy("source_no").orderBy("grp")) - F.col("g")).alias("group_first"))
    in_group = F.sum("s").over(Window.partitionBy("source_no", "grp").orderBy("chunk")) - F.col("s")
    starts = sums.withColumn("in_group", in_group).join(group_first, ["source_no", "grp"]).select("source_no", "chunk", (F.col("group_first") + F.col("in_group")).alias("chunk_first"))
    inside = F.sum("size").over(Window.partitionBy("source_no", "chunk").orderBy("doc_id", "text_key", "copy").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return dealt.withColumn("inside", inside).join(starts, ["source_no", "chunk"]).select("rid", "size", "source_no", "block_words", (F.col("chunk_first") + F.col("inside")).alias("first"))


@dataclass
class Mix:
    sources: DataFrame  # source, source_no, source_size, target, block_words, blocks, draws
    n_sources: int
    sized: DataFrame  # rid, doc_id, source, text_key, size, copy, many: a row for each document, in the shared folder
    pieces: DataFrame  # rid, source_no, block, begin, n (words of the row in the block)
    slots: DataFrame


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7, extra: Sequence[str] = (), rows_per_chunk: int = ROWS_PER_CHUNK, fan: int = FAN) -> Mix:
    # Texts are read and measured once: all sums run over this narrow table. A row's number is fixed by its being written.
    sized, _ = written(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", F.xxhash64("text").alias("text_key"), n_words(F.col("text")).alias("size"), *extra), "sizes")
    wanted = targets(ordered_sources(sized), weights, share, max_repeat)
    own_block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.expr(f"source_size div {LEAST_BLOCKS}"))).cast("long")
    blocks = F.expr("(source_size + block_words - 1) div block_words")
    draws = F.when(F.col("source_size") > 0, F.least(F.rint(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.col("blocks") * max_repeat)).otherwise(F.lit(0).cast("long"))
    sources, _ = written(wanted.withColumn("block_words", own_block).withColumn("blocks", blocks).withColumn("draws", draws), "sources")
    totals = sources.agg(F.count(F.lit(1)).alias("n"), F.sum("draws").alias("d")).first()
    numbered = _numbered(sized)
    with_no = _with_source(numbered.where("size > 0"), sources, totals["n"], "source_no", "block_words")
    inside = packed(with_no, sized.count(), rows_per_chunk, fan)
    w = F.col("block_words")
    cut = inside.select("*", F.explode(F.sequence(F.expr("first div block_words"), F.expr("(first + size - 1) div block_words"))).alias("block"))
    begin = F.greatest(F.lit(0).cast("long"), F.col("block") * w - F.col("first"))
    end = F.least(F.col("size"), (F.col("block") + 1) * w - F.col("first"))
    pieces = cut.select("rid", "source_no", "block", begin.alias("begin"), (end - begin).alias("n"))
    return Mix(sources, totals["n"], numbered, pieces, slots(sources, max(1, -(-(totals["d"] or 0) // shard_slots)), shard_slots, seed))


def block_uses(m: Mix) -> DataFrame:
    """How often the mix has each block: source_no, block, times. Spark takes the slots for few, as it sees only their
    beginnings, so joins of what comes from them are told to shuffle: it grows with the input and is never broadcast."""
    return m.slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source), taken (its words in the mix, repeats counted)."""
    m = mix(docs, **options)
    taken = m.pieces.join(block_uses(m), ["source_no", "block"]).groupBy("rid").agg(F.sum(F.col("n") * F.col("times")).alias("t"))
    base = _with_source(m.sized.select("rid", "doc_id", "source", "size"), m.sources, m.n_sources, "source_size", "target")
    return base.join(taken.hint("merge"), "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("t", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, in the columns doc_id, text, lang, source, n_chars: for each pass over a document's
    blocks the words that the pass takes, joined by spaces in their order; other columns are left out."""
    m = mix(docs, extra=["lang"], **options)
    key = ["doc_id", "text_key", "source", "lang"]
    passes = (
        m.pieces.join(block_uses(m), ["source_no", "block"])
        .select("rid", "begin", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("pass_no"))
        .groupBy("rid", "pass_no")
        .agg(F.array_sort(F.collect_list(F.struct("begin", "n"))).alias("parts"))
    )
    salt = lambda on, n: F.when(on, n).otherwise(F.lit(0))
    told = m.sized.select("rid", *[F.col(k).alias(f"p_{k}") for k in key], salt(F.col("many"), F.pmod(F.col("rid"), F.lit(SALT))).cast("int").alias("p_salt")).join(passes.hint("merge"), "rid").drop("rid", "pass_no")
    # One text stands for rows that repeat each other; it is sent to as many tasks as they are dealt to.
    keyed = docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("text_key"))
    repeated = m.sized.where("many").select(*[F.col(k).alias(f"r_{k}") for k in key]).distinct()
    if m.sized.where("many").limit(1).count():
        same = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in key]
        few = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
        once = keyed.join(few, same, "left_semi").groupBy(*key).agg(F.first("text").alias("text")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        keyed = keyed.join(few, same, "left_anti").withColumn("salt", F.lit(0)).unionByName(once)
    else:
        keyed = keyed.withColumn("salt", F.lit(0))
    joined = keyed.join(told.hint("merge"), [*[F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in key], F.col("salt") == F.col("p_salt")])
    # The words are bound as the outer lambda's variable: named inside the inner one, they would be cut anew for every part.
    words = F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    taken = F.transform(words, lambda w: F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(w, p["begin"].cast("int") + 1, p["n"].cast("int")))), " "))
    return joined.select("doc_id", F.element_at(taken, 1).alias("text"), "lang", "source").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
