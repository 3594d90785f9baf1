"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

A window is ``width`` consecutive words of a benchmark item (an item of fewer words, but not none,
is one window). Each window has an anchor: its longest word, the first of equals. The scan of the
training texts emits their words with positions, looks each up among the broadcast anchors, and
verifies the n-gram around every find against the broadcast set of whole windows; so only words
that are an anchor ever build an n-gram. Both sets hold benchmark text alone; their size is measured
first, and windows of more than ``max_broadcast_bytes`` are broadcast in parts, each with a scan of its own. Hits carry a
window's number; its items join afterwards, once for each document and window.

Nulls, empty texts and texts without a word have no words and no hits. Repeated rows get the same
result each. Extra columns of either table are ignored by ``contamination``; ``remove`` keeps those
of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import ascii_lower, written

#: Everything that is not in a word: the ASCII characters other than 0-9 and a-z (after lower-casing).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
MAX_BROADCAST_BYTES = 64 << 20
#: Contaminated documents (an id and a hash each) are broadcast up to so many.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """The lower-cased words of a text; null has none."""
    flat = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), GAP, " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, text: str = "text", item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """A row for each distinct window: window (its number), ngram, k (its words), anchor, back (words before the anchor);
    and the rows (window, item)."""
    all_of = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    k = F.least(F.lit(width), F.size("w"))
    parts = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.slice("w", i, k))
    cut, _ = written(all_of.select("item", F.explode(parts).alias("part")).select("item", "part", F.array_join("part", " ").alias("ngram")).distinct(), "benchmark-windows")
    numbered, _ = written(cut.select("ngram", "part").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    sizes = F.transform("part", lambda x: F.length(x))
    back = (F.array_position(sizes, F.array_max(sizes)) - 1).cast("int")
    windows = numbered.select("window", "ngram", F.size("part").alias("k"), back.alias("back"), F.element_at("part", back + 1).alias("anchor"))
    return windows, cut.join(numbered.select("ngram", "window"), "ngram").select("window", "item")


def occurrences(docs: DataFrame, windows: DataFrame, keys: list[str], text: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """keys, start (position of the first word), k and window of every occurrence of a window in a text."""
    size = windows.agg(F.sum(F.length("ngram") + F.length("anchor") + 96).alias("b")).first()["b"] or 0
    parts = max(1, -(-size // max_broadcast_bytes))
    spread = docs.select(*keys, words(F.col(text)).alias("w"))
    out = None
    for part in range(parts):
        # All windows of an anchor are in one part.
        some = windows if parts == 1 else windows.where(F.pmod(F.xxhash64("anchor"), F.lit(parts)) == part)
        found = spread.select(*keys, "w", F.posexplode("w").alias("pos", "word")).join(F.broadcast(some.select("anchor", "back", "k").distinct()), F.col("word") == F.col("anchor"))
        grams = found.withColumn("start", F.col("pos") - F.col("back")).where((F.col("start") >= 0) & (F.col("start") + F.col("k") <= F.size("w"))).select(*keys, "start", F.array_join(F.slice("w", F.greatest(F.col("start") + 1, F.lit(1)), F.col("k")), " ").alias("ngram"))
        hits = grams.join(F.broadcast(some.select("ngram", "k", "window")), "ngram").select(*keys, "start", "k", "window")
        out = hits if out is None else out.unionByName(hits)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, hit_words (positions of hit words, ascending), items (sorted ids as strings).

    Rows are told apart by doc_id and a hash of the text, so a repeated doc_id or a null one does no harm.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_key"))
    windows, items = benchmark_windows(benchmark, width)
    key = ["doc_id", "text_key"]
    hits, _ = written(occurrences(keyed, windows, key, "text", max_broadcast_bytes).distinct(), "benchmark-hits")
    covered = F.transform(F.col("spans"), lambda s: F.sequence(s["start"], s["start"] + s["k"] - 1))
    spans = hits.groupBy(*key).agg(F.collect_set(F.struct("start", "k")).alias("spans")).select(*key, F.array_sort(F.array_distinct(F.flatten(covered))).alias("hit_words"))
    named = hits.select(*key, "window").distinct().join(items, "window").groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.col("doc_id").alias("i_doc"), F.col("text_key").alias("i_text"), "items")
    by_doc = spans.join(named, F.col("doc_id").eqNullSafe(F.col("i_doc")) & (F.col("text_key") == F.col("i_text"))).select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "hit_words", "items")
    n_words = F.size(words(F.col("text"))).cast("long")
    none = F.array()
    return keyed.select("doc_id", "text_key", n_words.alias("n_words")).join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("hit_words", none.cast("array<int>")).alias("hit_words"), F.coalesce("items", none.cast("array<string>")).alias("items")
    )


def remove(docs: DataFrame, benchmark: DataFrame, unit: str = "document", width: int = WIDTH, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The documents, all columns kept, without contaminated ones (unit "document") or without their hit words ("span")."""
    hit = contamination(docs, benchmark, width, max_broadcast_bytes=max_broadcast_bytes).where(F.size("hit_words") > 0).select(F.col("doc_id").alias("_hit_doc"), F.col("text_key").alias("_hit_text"), *([F.col("hit_words").alias("_hit_words")] if unit == "span" else [])).distinct()
    hit, _ = written(hit, "contaminated")
    hit = F.broadcast(hit) if unit == "document" and hit.count() <= BROADCAST_ROWS else hit
    same = docs["doc_id"].eqNullSafe(hit["_hit_doc"]) & (F.xxhash64(docs["text"]) == hit["_hit_text"])
    if unit == "document":
        return docs.join(hit, same, "left_anti")
    parts = F.regexp_extract_all(F.coalesce(docs["text"], F.lit("")), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|" + r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"), F.lit(0))
    # Of the first character alone: the lambda evaluates it for each part, and must not cut the text anew there.
    lead = F.when(F.substring(docs["text"], 1, 1).rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), 0).otherwise(1)
    kept = F.filter(parts, lambda p, i: ~(((i - lead) % 2 == 0) & F.array_contains("_hit_words", F.floor((i - lead) / 2).cast("int"))))
    cleaned = F.when(F.col("_hit_words").isNull(), docs["text"]).otherwise(F.array_join(kept, ""))
    return docs.join(hit, same, "left").select(*[cleaned.alias("text") if c == "text" else docs[c] for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``contamination``, a row for each document."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated")
    )
