"""The mix against a version in plain Python, with repeated rows and at small bounds."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioforge.llm import mixture

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, source_no string, rid string, size string, text_key string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, x, lang, s, 0, "a", "b", "c", "d") for i, x, lang, s in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_targets(sizes, weights, total, most):
    out, free, left = {}, [s for s in sizes if sizes[s] > 0], total
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    while True:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / whole > most * sizes[s]]
        if not over:
            return {s: 0.0 for s in sizes} | out | {s: left * weight[s] / whole for s in free}
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]


def rows_of(rng, n):
    rows = [(i, " ".join(f"w{rng.integers(99)}" for _ in range(rng.integers(0, 400))), "en", rng.choice(["a", "b", "é", "c"])) for i in range(n)]
    rows += [(1000, "x y z " * 100, "en", "hot")] * 300 + [(1001, "q " * 50, lang, None) for lang in ("en", "de", None, "en")]
    return rows + [(None, "n " * 30, None, "a")] * 3 + [(1002, None, "en", "a"), (1003, "", None, "only empty"), (1004, " \t", "en", "b")]


@pytest.mark.parametrize("options", [{"block_words": 64, "shard_slots": 128, "rows_per_chunk": 40, "fan": 3}, {"weights": (1,), "share": 5.0}])
def test_against_plain_python(spark, monkeypatch, options):
    rows = rows_of(np.random.default_rng(2), 200)
    docs = docs_of(spark, rows)
    if "fan" in options:  # also beyond what is broadcast
        monkeypatch.setattr(mixture, "BROADCAST_ROWS", 1)
    got = mixture.taken_words(docs, **options).collect()
    sizes = Counter()
    for _, x, _, s in rows:
        sizes[s] += len(words(x))
    want = brute_targets(sizes, options.get("weights", (3, 1, 2)), options.get("share", 1.5) * sum(sizes.values()), 2)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == Counter((i, len(words(x)), sizes[s], round(want[s], 6)) for i, x, _, s in rows)
    source_of = {(i, len(words(x))): s for i, x, _, s in rows}
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source_of[r["doc_id"], r["size"]]] += r["taken"]
    block = options.get("block_words", mixture.BLOCK_WORDS)
    assert all(abs(taken[s] - want[s]) <= 2 * block for s in want)
    if "fan" in options:
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixture.taken_words(docs.repartition(5), **options).collect()), key=str)
    # The mix's documents hold as many words of each document as are taken of it, in the document's order.
    mixed = mixture.mixed_documents(docs, **options).collect()
    per = Counter()
    for r in mixed:
        assert r["n_chars"] == len(r["text"])
        per[r["doc_id"], r["source"]] += len(words(r["text"]))
    by_doc = Counter()
    for r in got:
        by_doc[r["doc_id"], source_of[r["doc_id"], r["size"]]] += r["taken"]
    assert per == Counter({k: v for k, v in by_doc.items() if v})
    inside = defaultdict(set)
    for i, x, _, s in rows:
        inside[i, s] |= set(words(x))
    assert all(set(words(r["text"])) <= inside[r["doc_id"], r["source"]] for r in mixed)
    assert Counter(r["lang"] for r in mixed if r["doc_id"] == 1001).keys() <= {"en", "de", None}


def test_empty(spark):
    empty = docs_of(spark, [])
    assert mixture.taken_words(empty).count() == 0 and mixture.mixed_documents(empty).count() == 0
    blank = docs_of(spark, [(1, None, None, None), (2, "", "en", "a")])
    assert [r["taken"] for r in mixture.taken_words(blank).collect()] == [0, 0] and mixture.mixed_documents(blank).count() == 0


def test_real_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixture.taken_words(docs).toPandas()
    assert len(got) == docs.count() and (got["taken"] <= 2 * got["size"]).all()
    sources = docs.select("doc_id", "source").toPandas().merge(got, on="doc_id").groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(sources["taken"] - sources["target"]) < 0.05 * sources["target"] + 130).all()


@pytest.mark.parametrize("draws, shards, few", [(1000, 7, 16), (5000, 1, 64), (30, 500, 64), (20000, 64, 100)])
def test_the_draw(draws, shards, few):
    whole = mixture.shards_of(draws, shards, 0, draws, 3, few)
    assert len(whole) == draws and (np.diff(whole) >= 0).all() and 0 <= whole.min() and whole.max() < shards
    parts = [mixture.shards_of(draws, shards, a, min(draws, a + 13), 3, few) for a in range(0, draws, 13)]
    assert (np.concatenate(parts) == whole).all()
    counts = np.bincount(whole, minlength=shards)
    spread = ((counts - draws / shards) ** 2 / (draws / shards)).sum()
    assert spread < shards + 5 * np.sqrt(2 * shards) + 5  # as of a multinomial draw


def test_a_large_draw():
    """Beyond 2**40 slots a part of the draw is found without the rest."""
    draws, shards = 1 << 42, 1 << 30
    got = mixture.shards_of(draws, shards, draws // 2, draws // 2 + 4096, 3)
    assert len(got) == 4096 and abs(int(got[0]) - shards // 2) < 1000


def test_permutation():
    for n in (1, 2, 5, 1000):
        assert sorted(mixture.permuted(np.arange(n), n, 3)) == list(range(n))


def test_tiny_sources(spark):
    """Sources of fewer words than a block: what is taken is near the targets all the same."""
    docs = docs_of(spark, [(10 * k + i, "w " * 20, "en", s) for k, s in enumerate("abc") for i in range(5)] + [(99, "one two three", "en", "d")])
    rows = mixture.taken_words(docs).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source_size"], r["target"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
        target[r["source_size"], r["target"]] = r["target"]
    assert all(abs(taken[k] - target[k]) <= 1 for k in target)
