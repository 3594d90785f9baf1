"""Quality classification by a sparse rule ensemble.

Statistics of the whole text are Spark column expressions. On a bounded sample of labelled rows
(``sample_rows``, those of the smallest hash) boosted trees of small depth are grown; the path to each of
their nodes is a rule, a conjunction of comparisons of statistics. A logistic model over all rules and the
scaled statistics is fitted with the lasso, which leaves few of them. What is left becomes one Spark
column expression, so scoring needs no Python.

Null or empty texts have statistics of 0 and a score like any other. Without labelled rows of both kinds
every score is the share of label 1 (0.5 if there is none). A document that is labelled twice counts twice.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 30, 3, 32, 0.3
PENALTY = 0.002


def statistics(text: Column) -> dict[str, Column]:
    """Names and expressions; needs the columns ``words`` and ``lines`` made by ``with_parts``."""
    n_chars = F.greatest(F.length(text), F.lit(1))
    n_words = F.greatest(F.size("words"), F.lit(1))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    symbols = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:!?'\"()-]"))
    marks = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]{2,}"))
    return {
        "log_words": F.log1p(F.size("words").cast("double")),
        "word_length": letters / n_words,
        "letters": letters / n_chars,
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) / F.greatest(letters, F.lit(1)),
        "digits": F.regexp_count(text, F.lit(r"\p{N}")) / n_chars,
        "symbols": symbols / n_words,
        "runs_of_marks": marks / n_words,
        "ends_of_sentence": F.regexp_count(text, F.lit(r"[.!?](?=\s|$)")) / n_words,
        "distinct_words": F.size(F.array_distinct("words")) / n_words,
        "short_words": F.size(F.filter("words", lambda w: F.length(w) <= 3)) / n_words,
        "words_per_line": F.log1p(n_words / F.greatest(F.size("lines"), F.lit(1))),
        "distinct_lines": F.size(F.array_distinct("lines")) / F.greatest(F.size("lines"), F.lit(1)),
    }


def with_parts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("text", text).withColumn("words", F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != "")).withColumn("lines", F.filter(F.split(F.col("text"), "\n"), lambda w: w != ""))


def measured(docs: DataFrame, extra: list[str]) -> DataFrame:
    """The extra columns and the statistics of the column text."""
    stats = statistics(F.col("text"))
    return with_parts(docs).select(*extra, *(c.cast("double").alias(name) for name, c in stats.items()))


@dataclass
class Rule:
    tests: tuple[tuple[int, bool, float], ...]  # statistic, whether at most the bound (else above), bound

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, at_most, bound in self.tests:
            out &= (x[:, j] <= bound) == at_most
        return out


@dataclass
class Ensemble:
    names: list[str]
    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    linear: list[tuple[int, float, float, float]] = field(default_factory=list)  # statistic, low, high, weight

    def column(self) -> Column:
        """The score as a column expression over the statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            test = F.lit(True)
            for j, at_most, bound in rule.tests:
                test = test & ((F.col(self.names[j]) <= bound) if at_most else (F.col(self.names[j]) > bound))
            total = total + F.when(test, float(weight)).otherwise(0.0)
        for j, low, high, weight in self.linear:
            total = total + F.least(F.greatest(F.col(self.names[j]), F.lit(low)), F.lit(high)) * float(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, bounds: list[np.ndarray], rows: np.ndarray, depth: int, path: tuple, rules: dict, out: np.ndarray) -> None:
    if path:
        rules.setdefault(tuple(sorted(path)), None)
    g, h = gradient[rows].sum(), weight[rows].sum()
    best = (1e-6, -1, 0.0)
    if depth and len(rows) >= 20:
        for j, cuts in enumerate(bounds):
            if not len(cuts):
                continue
            place = np.searchsorted(cuts, x[rows, j])  # at most cuts[place]
            gl = np.cumsum(np.bincount(place, gradient[rows], len(cuts) + 1))[:-1]
            hl = np.cumsum(np.bincount(place, weight[rows], len(cuts) + 1))[:-1]
            nl = np.cumsum(np.bincount(place, minlength=len(cuts) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < 5) | (len(rows) - nl < 5)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(cuts[k]))
    if best[1] < 0:
        out[rows] = g / (h + 1)
        return
    _, j, bound = best
    low = x[rows, j] <= bound
    _grow(x, gradient, weight, bounds, rows[low], depth - 1, (*path, (j, True, bound)), rules, out)
    _grow(x, gradient, weight, bounds, rows[~low], depth - 1, (*path, (j, False, bound)), rules, out)


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """The paths of boosted trees, in the order in which they were found."""
    bounds = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    rules: dict[tuple, None] = {}
    margin = np.full(len(y), np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        _grow(x, y - p, p * (1 - p), bounds, np.arange(len(y)), depth, (), rules, step)
        margin += RATE * step
    return [Rule(tests) for tests in rules]


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept (free) and weights, by accelerated proximal gradient steps."""
    n, m = z.shape
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    v = np.random.Generator(np.random.PCG64(5)).normal(size=m + 1)
    for _ in range(30):  # the largest curvature, by power iteration
        v /= np.linalg.norm(v)
        u = z @ v[:-1] + v[-1]
        v = np.append(z.T @ u, u.sum())
    rate = 4 * n / (np.linalg.norm(v) * 1.05 + 1e-9)
    pw, pb, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ pw + pb))) - y
        nw = pw - rate * (z.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = pb - rate * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


def fit(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = PENALTY) -> Ensemble:
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Ensemble(names, float(np.log(share / (1 - share))))
    rules = grow_rules(x, y)
    hold = np.array([r.holds(x) for r in rules], np.float64).T.reshape(len(y), len(rules))
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    clipped = np.clip(x, low, high)
    scale = 0.4 / np.maximum(clipped.std(axis=0), 1e-9) * (clipped.std(axis=0) > 1e-9)
    b, w = lasso_logistic(np.hstack([hold, clipped * scale]), y, penalty)
    kept = [(r, float(a)) for r, a in zip(rules, w[: len(rules)], strict=True) if abs(a) > 1e-6]
    linear = [(j, float(low[j]), float(high[j]), float(a * scale[j])) for j, a in enumerate(w[len(rules) :]) if abs(a) > 1e-6]
    return Ensemble(names, float(b), kept, linear)


def train(docs: DataFrame, labels: DataFrame, may_learn: Callable[[Column], Column], sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    """An ensemble from docs (doc_id, text) and labels (doc_id, label 0 or 1) where may_learn(doc_id) holds."""
    names = list(statistics(F.col("text")))
    usable = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).where(may_learn(F.col("doc_id")))
    # By a bound on the hash first, so that about twice the sample is sorted, not as much of each partition.
    share = min(1.0, 2 * sample_rows / max(1, usable.count()))
    usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) <= F.lit(int(share * (1 << 40))))
    chosen = usable.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id", "label").limit(sample_rows)
    rows = measured(docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "label")), "doc_id"), ["doc_id", "label"]).toPandas()
    rows = rows.sort_values(["doc_id", "label", *names], kind="stable")
    return fit(rows[names].to_numpy(np.float64), rows["label"].to_numpy(np.float64), names)


def score(docs: DataFrame, model: Ensemble, extra: list[str]) -> DataFrame:
    """The extra columns and the score."""
    return measured(docs, extra).select(*extra, model.column().alias("score"))
