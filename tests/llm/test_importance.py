import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import importance

LONG = " ".join(f"w{i % 977}é" for i in range(60000))
SCHEMA = "doc_id long, text string, n_words string, row int, rank string, score string, bucket string"


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, order):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def expected(docs, target, percent, least, order, buckets, seed):
    """Plain counts over all features; rows by place."""
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for rows, counts in ((docs, s), (target, t)):
        for _, text in rows:
            for f in grams(text, order):
                counts[of(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * float(sum(s) + buckets) / ((a + 1) * float(sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[of(f)] for f in grams(text, order))
        out.append([i, len(words_of(text)), len(grams(text, order)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    n = percent * len(able) // 100
    return sorted(([*x, k] for k, x in enumerate(able[:n], 1)), key=lambda x: x[5]), out


DOCS = [(i, " ".join(f"T{(i * j) % 23}x-{j % 5}, Über" for j in range(i % 40))) for i in range(300)] + [(None, None), (400, ""), (401, "-- ?!"), (402, LONG), (403, "a b"), (404, "一 二 three"), (None, "t0x " * 30)] + [(7, "same words here " * 9)] * 25
TARGET = [(1, "t3x 2 über t5x 0"), (2, None), (3, "same words"), (4, "")]


@pytest.mark.parametrize("percent, least, order, buckets, seed", [(5, 20, 3, 10000, 42), (50, 1, 2, 64, 7), (100, 0, 1, 65536, 1)])
def test_resample(spark, percent, least, order, buckets, seed):
    docs = spark.createDataFrame([(i, x, "n", 1, "r", "s", "b") for i, x in DOCS], SCHEMA).repartition(5)
    target = spark.createDataFrame(TARGET, "doc_id long, text string")
    got = importance.resample(docs, target, percent, least, order, buckets, seed).collect()
    drawn, rows = expected(DOCS, TARGET, percent, least, order, buckets, seed)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got if r["doc_id"] is not None) == sorted(tuple(x) for x in rows if x[0] is not None)
    assert [(r["rank"], r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"] or 0) if r["rank"] is not None] == [(x[5], x[0], x[4]) for x in sorted(drawn, key=key and (lambda x: x[5]))]
    assert len(got) == len(DOCS)


def test_resample_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    row = importance.resample(some, none, 100, 1).first()
    assert row["rank"] == 1 and row["n_features"] == 6


def test_drawn_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, x, "n", 1, "r", "s", "b") for i, x in DOCS], SCHEMA)
    target = spark.createDataFrame(TARGET, "doc_id long, text string")
    ranks = importance.resample(docs, target, percent=20).where("rank is not null")
    got = importance.drawn(docs, target, percent=20)
    assert got.columns == docs.columns
    assert {(r["doc_id"]) for r in got.collect()} == {r["doc_id"] for r in ranks.collect()}


def test_each_tuple_is_hashed_once(monkeypatch):
    seen = []
    monkeypatch.setattr(importance, "crc32", lambda x: seen.append(x) or zlib.crc32(x))
    n, ends, found = importance.buckets_of([b"a b a b a b", b"", b"A b-c"], 3, 1000)
    assert len(seen) == len(set(seen)) and n.tolist() == [6, 0, 3] and ends.tolist() == [15, 15, 21]
    assert sorted(found[15:].tolist()) == sorted(zlib.crc32(g.encode()) % 1000 for g in grams("a b c", 3))
    assert set(seen) == {g.encode() for x in ("a b a b a b", "a b c") for g in grams(x, 3)}


def test_noise_is_fixed(spark):
    got = spark.range(50).select(importance.noise(F.col("id"), 42).alias("z")).collect()
    for i, r in enumerate(got):
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        assert r["z"] == math.floor(-1000 * np.log(-np.log((h + 0.5) / 2**32)))
