import math
from collections import Counter

import numpy as np
import pytest

from folioforge.llm import threshold_search, vertical_search
from folioforge.llm.words import words

LONG = " ".join(f"w{i % 9973}" for i in range(80000))


# 12
def brute_force(docs, items, top):
    terms = [(i, words((t or "").encode())) for i, t in docs]
    held = [(i, Counter(w), len(w)) for i, w in terms if w]
    n, total = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in held:
            m = 100 - 75 + (75 * size * n) // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in Counter(words((text or "").encode())).items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def corpus():
    r = np.random.default_rng(5)
    zipf = lambda n: " ".join(f"W{int(x)}" for x in np.minimum(r.zipf(1.3, n), 400))
    docs = [(i, zipf(int(r.integers(1, 120)))) for i in range(900)]
    docs += [(1000 + i, "w1 w7 copied text w33 with a tie") for i in range(60)] + [(5, None), (6, ""), (7, "?! .")] + [(None, "w7 w7 w33 tie"), (8, LONG), (3, "w7 w33 twice"), (3, "w7 w33 twice"), (9, "été 日本 w7")]
    items = [(i, zipf(12)) for i in range(25)] + [(100, "copied W33 text, tie!"), (101, None), (102, ""), (103, "unknownword"), (104, "été 日本"), (104, "été"), (None, "w7 w7 w33")]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"SHARD_DOCS": 40, "STEP": 1}, {"SHARD_POSTINGS": 300, "STEP": 3}])
def test_ranked_search(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(threshold_search, name, value)
    docs, items = corpus()
    table = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, n long, terms string, rank int").repartition(3)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, query int")
    for size in (1 << 20, 500):  # queries in one part, and in several
        got = threshold_search.search(table, asked, query_bytes=size).collect()
        assert sorted(map(tuple, got), key=str) == brute_force(docs, items, 10)


def test_threshold_stops_early_and_keeps_ties():
    """Lists by falling impact: the best is told before the lists end, but not before the threshold is strictly below it."""
    n = 2000
    weight = np.array([100, 100])
    counts = np.full(n, 2)
    tfs = np.ones((n, 2), np.int64)
    tfs[-1] = [50, 50]
    shard = threshold_search.Shard([10] * n, counts, np.tile([0, 1], n), tfs.ravel(), n, 10 * n, weight)
    docs, _, looked_up = shard.best({0: 1, 1: 2}, np.arange(n), 1)
    assert docs.tolist() == [n - 1] and looked_up < 100
    docs, scores, looked_up = shard.best({0: 1, 1: 1}, np.arange(n)[::-1].copy(), 3)
    assert docs.tolist() == [n - 1, n - 2, n - 3] and scores[1] == scores[2] and looked_up == n


def test_ranked_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id string, text string")
    some = spark.createDataFrame([("a", "b c")], "item_id string, text string")
    assert threshold_search.search(none, some).count() == 0
    got = threshold_search.search(spark.createDataFrame([(1, "x b"), (2, "y")], "doc_id long, text string"), items)
    assert got.count() == 0 and dict(got.dtypes)["item_id"] == "string"


# 13
def nearest(rows, top, every):
    held = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in held:
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j is None, j or 0, j) for j, c in held if j != i)
        out += [(i, rank, x[3], -x[0]) for rank, x in enumerate(scored[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("scale", [1, 1e4])
def test_exact_top_k(spark, scale):
    """Doubles, and 64-bit integers where doubles aren't exact; blocks smaller than the table, queries in several parts."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 40))
    rows = [(i, (scale * (centres[i % 6] + 0.1 * r.normal(size=40))).tolist()) for i in range(700)]
    rows += [(800 + i, rows[0][1]) for i in range(30)] + [(1000, None), (1010, [None] * 40), (1020, [math.inf] + [0.0] * 39), (1030, [math.nan] * 40), (1040, []), (1050, [1.0, -0.5]), (None, rows[3][1]), (10, rows[5][1]), (10, rows[5][1])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, ids string").repartition(3)
    want = nearest(rows, 10, 10)
    for size in (1 << 20, 4000):
        got = vertical_search.search(table, table["vec_id"] % 10 == 0, query_bytes=size, block=64).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_bounds_drop_work():
    r = np.random.default_rng(1)
    m = r.integers(-40, 40, (64, 3000)).astype(float)
    m[:, :20] = m[:, :1] * 3 + np.arange(20)
    query = vertical_search.Query(np.array([0]), m[:, :1].T, vertical_search._masses(m[:, :1]).T)
    best = vertical_search.Best(1, 10)
    work = sum(vertical_search.meet(query, np.arange(at, at + 100), [m[i : i + 16, at : at + 100] for i in range(0, 64, 16)], vertical_search._masses(m[:, at : at + 100]), best) for at in range(0, 3000, 100))
    assert work < 0.7 * m.size
    scores = m[:, 0] @ m
    assert best.held[0][0].tolist() == [int(i) for i in sorted(range(1, 3000), key=lambda i: (-scores[i], i))[:10]]


def test_exact_top_k_of_nothing(spark):
    for rows in ([], [(0, None)], [(0, [1.0])]):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert vertical_search.search(table, table["vec_id"] % 100 == 0).count() == 0
    table = spark.createDataFrame([(0, []), (1, []), (2, [])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vertical_search.search(table, table["vec_id"] % 100 == 0).orderBy("rank").collect()] == [(0, 1, 1, 0), (0, 2, 2, 0)]
    table = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError):
        vertical_search.search(table, table["vec_id"] % 100 == 0)
