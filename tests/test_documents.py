import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioforge.functions import similarity
from folioforge.functions import text as t
from folioforge.operators import diff, quality, views
from folioforge.sources import files

SF = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def applied(a, b, ops):
    left = [a[i] for k, i, _ in ops if k != "insert"]
    right = [b[j] for k, _, j in ops if k != "delete"]
    return left == list(a) and right == list(b) and all(a[i] == b[j] for k, i, j in ops if k == "equal")


def test_alignment_rebuilds_both_sides():
    rng = random.Random(12345)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(20))] for _ in range(2))
        assert applied(a, b, diff.span_script(a, b, 1500))


def test_alignment_of_long_sequences():
    a = [f"line {i}" for i in range(3000)]
    b = a[:1000] + ["changed"] + a[1001:2000] + ["new"] + a[2000:]
    ops = diff.span_script(a, b, 1500)
    assert applied(a, b, ops) and sum(k != "equal" for k, _, _ in ops) < 10
    a, b = [f"a{i}" for i in range(600)], [f"b{i}" for i in range(600)]
    assert applied(a, b, diff.span_script(a, b, 1500))


def test_rows(spark):
    def kinds(left, right):
        sides = [spark.createDataFrame([(1, i, x) for i, x in enumerate(side)], "pair_id long, block_ix int, text string") for side in (left, right)]
        return [(r["kind"], r["right_ix"]) for r in diff.diff_rows(*sides).orderBy("row_ix").collect()]

    assert kinds(["A", "B", "C"], ["A", "B", "C"]) == [("equal", 0), ("equal", 1), ("equal", 2)]
    assert [k for k, _ in kinds(["A", "C"], ["A", "B", "C"])] == ["equal", "insert", "equal"]
    rows = kinds(["alpha beta gamma", "one two three"], ["one two three!", "zzz", "alpha beta gammas"])
    assert sorted(j for _, j in rows if j is not None) == [0, 1, 2]


@pytest.mark.parametrize("a, b", [("", "x y"), ("x y", ""), ("same", "same"), ("the cat sat", "the cats sat"), ("계약서를 보라", "계약서는 보라")])
def test_inline_round_trip(a, b):
    spans = diff.inline(a, b)
    assert "".join(s for k, s in spans if k != "insert") == a and "".join(s for k, s in spans if k != "delete") == b
    if a == "계약서를 보라":
        assert ("delete", "를") in spans and ("insert", "는") in spans


def test_normalization(spark):
    n = lambda x, **o: one(spark, x, lambda c: t.normalize(c, t.Options(**o)))
    assert n("é") == "é" and n("a​b­c") == "abc" and n("a　 b") == "a b" and n("a\r\nb\rc") == "a\nb\nc"
    assert n("ＡＢ", fold_width=True) == "AB" and n("“x” – ‘y’…", normalize_punct=True) == "\"x\" - 'y'..."
    assert n("agree-\nment", join_hyphen=True) == "agreement" and n("한-\n글", join_hyphen=True) == "한-\n글"
    assert n("  a  \n  b  ", ignore_whitespace=False) == "a\nb" and n("ABC", ignore_case=True) == "abc" and n(None) is None and n("") == ""


def test_text_functions(spark):
    assert one(spark, "abc", t.fnv1a) == 440920331
    assert one(spark, "a😀", t.u16_length) == 3
    assert one(spark, "**b** [l](u) `c` ~~s~~ <i>x</i> ![i](p)", t.strip_markdown) == "b l c s x i"
    assert one(spark, "Page 12  of 90 ", t.repeat_key) == "Page # of #"


def test_dice(spark):
    rows = spark.createDataFrame([(1, "night", "nacht"), (2, "a", "b"), (3, "", ""), (4, "aaaa", "aa")], "id int, l string, r string")
    got = {r["id"]: r["dice"] for r in similarity.dice(rows, ["id"], "l", "r").collect()}
    assert got == {1: 0.25, 2: 0.0, 3: 1.0, 4: 0.5}


def test_fold(spark):
    kinds = ["insert"] + ["equal"] * 20 + ["insert"]
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)] + [(2, i, "equal") for i in range(30)], "pair_id long, row_ix int, kind string")
    got = [r.asDict() for r in views.fold(rows).orderBy("pair_id", "item_ix").collect()]
    assert [r["gap_count"] for r in got if r["kind"] == "gap"] == [14, 30] and sum(r["pair_id"] == 1 for r in got) == 9


def test_files(spark, tmp_path):
    for name, data in {"a.txt": b"hello", "b.pdf": b"%PDF-1.7", "c.hwpx": b"PK\x03\x04x", "d.docx": b"PK\x03\x04x", "e.txt": b"\x00\x01\x00", "f.exe": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"][-5:]: r["f"] for r in files.read_files(spark, str(tmp_path)).select("path", files.resolve(F.col("path"), F.col("content")).alias("f")).collect()}
    assert got == {"a.txt": "txt", "b.pdf": "pdf", ".hwpx": "hwpx", ".docx": "docx", "e.txt": None}
    pairs = spark.createDataFrame([("a.md", "b.markdown"), ("a.txt", None), ("a.pdf", "b.docx"), (None, None)], "l string, r string")
    assert [tuple(r["m"]) for r in pairs.select(files.mode(F.col("l"), F.col("r")).alias("m")).collect()] == [("compare", True), ("viewer-single", False), ("viewer-split", False), ("empty", False)]


def test_density(spark):
    rows = spark.createDataFrame([(499, 10), (500, 10), (2000, 10)], "c int, p int")
    assert [r[0] for r in rows.select(quality.density(F.col("c"), F.col("p"))).collect()] == ["scanned", "suspect", "text"]


def test_entry(spark):
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", ["block_ids", "diff_roundtrip_left", "diff_roundtrip_right", "fold_view", "hangul_sanity", "repeated_lines"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "events", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df, sql = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    key = sorted(df.columns)
    ours = sorted(tuple(str(r[c]) for c in key) for r in df.collect())
    theirs = sorted(tuple(str(r[sql.columns.index(c)]) for c in key) for r in sql.fetchall())
    assert ours == theirs
