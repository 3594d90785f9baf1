"""A store of blocks: other options without an exchange, and one document from one bucket."""

import uuid

import pytest
from pyspark.sql.utils import AnalysisException

from folioforge.functions import text as t
from folioforge.functions.scratch import fresh_folder
from folioforge.operators import blocks
from folioforge.sources import store

LOUD = t.Options(ignore_case=True, normalize_punct=True)
BLOCKS = "doc_id long, block_ix int, text string, raw_text string, words string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_other_options(spark):
    rows = [(d, i, f"x{i}", ("\u201cA\u201d " * i, "\u200b", "Be\u0301\u2026  c", None, "")[((d or 0) + i) % 5], "kept") for d in [*range(40), None] for i in range(6)]
    parsed = spark.createDataFrame(rows, BLOCKS)
    name = f"store_{uuid.uuid4().hex[:8]}"
    store.save(parsed, name, fresh_folder(spark, "store"), 8)
    got = store.under(spark, name, LOUD)
    assert "Exchange" not in plan(got) and "SelectedBucketsCount: 8 out of 8" in plan(got)
    want = blocks.renormalize(parsed, LOUD)
    assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, want.select(sorted(want.columns)).collect())) and got.count() > 80
    one = store.read(spark, name, 7, LOUD)
    assert "Exchange" not in plan(one) and "SelectedBucketsCount: 1 out of 8" in plan(one)
    assert sorted(r["text"] for r in one.collect()) == sorted(r["text"] for r in want.where("doc_id = 7").collect())
    with pytest.raises(AnalysisException):
        store.save(parsed, name, fresh_folder(spark, "store"), 8)


def test_empty_store(spark):
    name = f"store_{uuid.uuid4().hex[:8]}"
    store.save(spark.createDataFrame([], BLOCKS), name, fresh_folder(spark, "store"), 4)
    assert store.under(spark, name, LOUD).count() == 0
