"""Language models: held-out accuracy, what is rejected, the sample, and probabilities against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import kneser_ney

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_rejection(spark, docs):
    """Of unknown languages and junk nearly all go, of the known languages' held-out texts nearly none."""
    model = kneser_ney.train(docs.where((F.col("lang") != "es") & (kneser_ney.fold(F.col("doc_id")) != 0)))
    got = kneser_ney.predict(docs, model, ("doc_id", "lang")).where(kneser_ney.fold(F.col("doc_id")) == 0).toPandas()
    assert got[got["lang"] == "es"]["rejected"].mean() > 0.93 and got[got["lang"] != "es"]["rejected"].mean() < 0.01
    assert (got["lang"] == got["lang_pred"])[got["lang"] != "es"].mean() > 0.98
    rng = random.Random(1)
    junk = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(3, 9))) for _ in range(rng.choice([6, 12, 20]))) for _ in range(200)]
    junk += ["".join(chr(0x430 + rng.randrange(30)) for _ in range(60)) for _ in range(50)]
    assert kneser_ney.predict(spark.createDataFrame(list(enumerate(junk)), "doc_id long, text string"), model).toPandas()["rejected"].mean() > 0.98


def test_sample(spark):
    rows = [("one text of a language that has only copies of it", "copies")] * 500 + [("une seule ligne", "single")] + [(f"text number {i} of many", "many") for i in range(300)] + [(None, "many"), ("no language", None)]
    labelled = spark.createDataFrame(rows, "text string, lang string").withColumn("h", F.lit("x"))
    sample = kneser_ney.sampled(labelled, 1000).toPandas()
    per = sample.groupby("lang")["text"].agg(["size", lambda t: t.str.len().sum(), "nunique"])
    assert per.loc["copies", "size"] == 1 == per.loc["single", "size"] and not sample[sample["lang"] != "many"]["held"].any()
    assert 10 <= per.loc["many", "size"] == per.loc["many", "nunique"] < 60 and sample[sample["lang"] == "many"]["held"].sum() == per.loc["many", "size"] // 5
    model = kneser_ney.train(labelled, 1000)
    assert model.languages == ["copies", "many", "single"] and np.isfinite(model.mean).all()
    assert kneser_ney.predict(spark.createDataFrame([(1, "une seule ligne")], "doc_id long, text string"), model).first()["lang_pred"] == "single"
    small = kneser_ney.train(labelled, 100_000, model_values=2000)  # the sample shrinks until the model fits
    assert len(small.grams[-1].keys) * 3 <= 2000 and small.languages == model.languages


def test_probabilities_against_plain_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab cä") for _ in range(rng.randrange(3, 40))) for _ in range(40)]
    n = kneser_ney.ORDER
    labelled = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string")
    sample = kneser_ney.sampled(labelled, 10**6).toPandas()
    counted = sample[~sample["held"]]["text"]
    model = kneser_ney.train(labelled)
    levels = {n: Counter()}
    for text in counted:
        folded = " " * (n - 1) + " ".join(text.lower().split()) + " "
        if text.endswith(" ") or not text.strip():
            folded = folded.rstrip(" ") + " "
        folded = folded if folded.strip() else " " * n
        levels[n].update(folded[i : i + n] for i in range(len(folded) - n + 1))
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    discounts, contexts = {}, {}
    for k, counts in levels.items():
        one, two = (sum(c == x for c in counts.values()) for x in (1, 2))
        discounts[k] = one / (one + 2 * two) if one and two else 0.5
        contexts[k] = defaultdict(lambda: [0, 0])
        for g, c in counts.items():
            contexts[k][g[:-1]][0] += c
            contexts[k][g[:-1]][1] += 1

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(levels[1]) + 1)
        total, types = contexts[k].get(gram[:-1], (0, 0))
        if not total:
            return p(gram[1:])
        return max(levels[k][gram] - discounts[k], 0) / total * (gram in levels[k]) + discounts[k] * types / total * p(gram[1:])

    for text in ("abc ab", "cab", "zab", "äää"):
        padded = " " * (n - 1) + text + " "
        want = -sum(math.log(p(padded[i : i + n])) for i in range(len(padded) - n + 1)) / (len(text) + 1)
        assert model.entropies([text])[0][0, 0] == pytest.approx(want, rel=1e-4)


def test_odd_texts(spark, docs):
    model = kneser_ney.train(docs.where("doc_id % 3 = 0"))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "word " * 200_000), (5, "a"), (5, "a")]
    got = {r["doc_id"]: r for r in kneser_ney.predict(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")), model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (1, 2, 3)) and 0 < got[4]["score"] <= 1
    assert kneser_ney.train(docs.limit(0)) is None and kneser_ney.predict(docs.limit(5), None).where("lang_pred = 'und'").count() == 5


def test_marks_are_no_letters(spark, docs):
    model = kneser_ney.train(docs)
    odd = spark.createDataFrame([(1, "́́"), (2, "12 ́!"), (3, None), (4, "é the words of a text")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in kneser_ney.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] != "und"


def test_fold_of_no_id(spark):
    assert spark.createDataFrame([(None,)], "doc_id long").select(kneser_ney.fold(F.col("doc_id")).alias("f")).first()["f"] == 0
