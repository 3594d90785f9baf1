"""The rule ensemble against plain code: weights by their optimum's conditions, trees by brute force, and the compiled column."""

import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import rule_ensemble


def made(rng, n=600, m=6):
    x = rng.normal(size=(n, m))
    x[:, 1] = np.round(x[:, 1])  # many ties
    x[:, 2] = 1.0  # nothing to tell
    y = ((x[:, 0] > 0.3) & (x[:, 1] <= 0) | (x[:, 3] > 1)).astype(float)
    flip = rng.random(n) < 0.1
    return x, np.where(flip, 1 - y, y)


@pytest.mark.parametrize("penalty", [0.002, 0.02, 10.0])
def test_weights_are_optimal(penalty):
    """At the lasso's optimum the gradient of a weight is -penalty * its sign, and at most the penalty where it is 0."""
    x, y = made(np.random.default_rng(3))
    b, w = rule_ensemble.lasso_logistic(x, y, penalty, steps=6000)
    r = 1 / (1 + np.exp(-(x @ w + b))) - y
    gradient = x.T @ r / len(y)
    on = w != 0
    assert abs(r.mean()) < 1e-4
    assert gradient[on] == pytest.approx(-penalty * np.sign(w[on]), abs=2e-4)
    assert (np.abs(gradient[~on]) <= penalty + 2e-4).all()
    assert penalty < 1 or not on.any()


def test_first_cut_by_brute_force():
    """The first tree's root is the cut of the largest gain among all statistics and bounds."""
    x, y = made(np.random.default_rng(4))
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))
    best = max(
        ((g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1), -j, -float(bound)) for j in range(x.shape[1]) for bound in np.unique(np.quantile(x[:, j], np.linspace(0, 1, rule_ensemble.BINS + 1)[1:-1])) if 5 <= (low := x[:, j] <= bound).sum() <= len(y) - 5)
    )
    first = rule_ensemble.grow_rules(x, y, trees=1, depth=1)
    assert {r.tests for r in first} == {((-best[1], at_most, -best[2]),) for at_most in (True, False)}
    for rule in rule_ensemble.grow_rules(x, y, trees=3, depth=3):  # a rule holds where all its tests do
        assert rule.holds(x).tolist() == [all((row[j] <= bound) == at_most for j, at_most, bound in rule.tests) for row in x]


def test_compiled_column(spark):
    """The column gives what the rules and weights say, also on bounds, at the ends of linear parts, and on odd texts."""
    names = list(rule_ensemble.statistics(F.col("text")))
    rng = np.random.default_rng(5)
    texts = [None, "", " ", "\n\n", "a", "A b. C!", "é 日本 😀 ???", "word " * 500, "1 2 3\n1 2 3\n", "x" * 3000, "'\"()-,;:", "Q. " * 40]
    rows = rule_ensemble.measured(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string"), ["doc_id"]).orderBy("doc_id").toPandas()
    x = rows[names].to_numpy(np.float64)
    assert np.isfinite(x).all()
    rules = [(rule_ensemble.Rule(tuple((int(j), bool(rng.integers(2)), float(x[rng.integers(len(x)), j])) for j in rng.choice(len(names), rng.integers(1, 4), replace=False))), float(rng.normal())) for _ in range(40)]
    linear = [(j, float(np.min(x[:, j])), float(np.median(x[:, j])), float(rng.normal())) for j in range(0, len(names), 2)]
    model = rule_ensemble.Ensemble(names, 0.25, rules, linear)
    want = []
    for row in x:
        total = 0.25 + sum(w for rule, w in rules if all((row[j] <= bound) == at_most for j, at_most, bound in rule.tests)) + sum(w * min(max(row[j], lo), hi) for j, lo, hi, w in linear)
        want.append(1 / (1 + math.exp(-total)))
    docs = spark.createDataFrame([(i, t, "w", "l", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, words string, lines string, letters double")
    got = [r["score"] for r in rule_ensemble.score(docs, model, ["doc_id"]).orderBy("doc_id").collect()]
    assert got == pytest.approx(want)


def test_statistics_against_plain_code(spark):
    text = "Ab, cd ef! Ab 12 éÉ ??\nline two.\nline two."
    row = rule_ensemble.measured(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first()
    words, lines = text.split(), text.split("\n")
    letters = sum(unicodedata.category(c)[0] == "L" for c in text)
    assert row["letters"] == pytest.approx(letters / len(text)) and row["word_length"] == pytest.approx(letters / len(words))
    assert row["capitals"] == pytest.approx(sum(unicodedata.category(c) == "Lu" for c in text) / letters)
    assert row["distinct_words"] == pytest.approx(len(set(words)) / len(words)) and row["distinct_lines"] == pytest.approx(len(set(lines)) / len(lines))
    assert row["ends_of_sentence"] == pytest.approx(len(re.findall(r"[.!?](?=\s|$)", text)) / len(words))
    assert row["log_words"] == pytest.approx(math.log1p(len(words)))


def test_nothing_to_learn(spark):
    assert rule_ensemble.fit(np.zeros((0, 2)), np.zeros(0), ["a", "b"]).rules == []
    one = rule_ensemble.fit(np.ones((5, 2)), np.ones(5), ["a", "b"])
    assert one.rules == [] and 0.9 < 1 / (1 + math.exp(-one.intercept)) < 1
