"""What the third round's findings were about."""

import random
from statistics import median

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioforge.functions import batches
from folioforge.functions import text as t
from folioforge.operators import alignment, diff, geometry, pairing, views
from folioforge.plans import queries
from folioforge.sources import documents, office

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in entry.queries()[name](spark, SF).select(columns).collect()]
    return sorted(got, key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["pdf_items", "pdf_lines"])
def test_equals_its_sql(spark, name):
    assert same_as_sql(spark, name)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_segments_are_told_within_a_row(spark):
    """spans were exploded, sorted and collected again."""
    spans = [("equal", "a"), ("equal", "b"), ("delete", "c"), ("insert", "d"), ("equal", "e"), ("insert", "f")]
    rows = spark.createDataFrame([(1, 0, spans), (1, 1, [("delete", "x")]), (2, 0, [("insert", "y")]), (3, 0, [])], "pair_id long, row_ix int, spans array<struct<kind:string,text:string>>")
    told = views.span_segments(rows)
    assert "Sort" not in plan(told) and "Aggregate" not in plan(told)
    want = [(1, 0, 0, "common", "ab", None, None), (1, 0, 1, "divergent", None, "c", "d"), (1, 0, 2, "common", "e", None, None), (1, 0, 3, "divergent", None, "", "f"), (1, 1, 0, "divergent", None, "x", ""), (2, 0, 0, "divergent", None, "", "y")]
    assert sorted(map(tuple, told.collect()), key=lambda r: r[:3]) == want
    flat = rows.select("pair_id", "row_ix", F.posexplode("spans").alias("span_ix", "s")).select("pair_id", "row_ix", "span_ix", "s.*")
    assert sorted(map(tuple, views.triple_segments(flat).collect()), key=lambda r: r[:3]) == want
    assert [tuple(r) for r in views.shared_text(rows).collect()] == [(1, "abe")]


def test_batches_are_bounded(spark):
    """F8, F9, F11 to F16: a batch held 64 MB of texts, and several times that in Python."""
    seen = batches.vectorized(lambda x: pd.Series([len(x)] * len(x)), "int")
    rows = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("x"))
    assert rows.select(F.max(seen("x"))).first()[0] <= 6


def test_no_side_is_broadcast(spark):
    """stored tables are few bytes on disk, so that Spark took them for small."""
    side = spark.range(0, 2000, 1, 2).select((F.col("id") % 9).alias("pair_id"), F.col("id").cast("int").alias("block_ix"), F.concat(F.lit("line "), F.col("id") % 4).alias("text"))
    assert "Broadcast" not in plan(diff.diff_rows(side, side.where("block_ix % 5 <> 1")))


def test_files_are_parsed_once(spark, monkeypatch):
    """both files of a pair were parsed for their warnings and again for their documents."""
    calls = []
    monkeypatch.setattr(documents, "parse_files", lambda *a, f=documents.parse_files: calls.append(1) or f(*a))
    entry.queries()["pair_triage"](spark, SF)
    assert len(calls) == 1


def test_settled_texts_are_left(spark):
    """F22 to F25: texts that no step changes are told by searches; the steps give the same."""
    rng = random.Random(17)
    parts = ["a", "Zb", "é", "-", "\n", " ", "  ", "\t", "\r\n", " ", "\u0085", "­", "é", "…", "ｎ", "​", " ", "😀", "\x0b", "-\nx"]
    texts = ["", *("".join(rng.choices(parts[: rng.choice((4, 6, 20))], k=rng.randrange(1, 9))) for _ in range(3000))]
    rows = spark.createDataFrame([(x,) for x in texts] + [(None,)], "x string")
    x = F.col("x")
    for options in (*t.DEFAULTS.values(), t.Options(ignore_whitespace=False, ignore_case=True)):
        steps = t._steps(x, options, True)
        assert rows.where(~t.normalize(x, options).eqNullSafe(F.lower(steps) if options.ignore_case else steps)).count() == 0
    assert rows.where(~t.trim(x).eqNullSafe(F.regexp_replace(x, f"^[{t.WS}]+|[{t.WS}]+$", ""))).count() == 0
    assert rows.where(t.full(x) != (t.trim(x) != "")).count() == 0


def test_inline_spans_have_tasks(spark):
    """a few MB of pairs went to one task, however long they took."""
    pairs = spark.range(0, 40, 1, 2).select(F.col("id").alias("pair_id"), F.lit("a b").alias("left"), F.lit("a c").alias("right"))
    grouped = pairs.groupBy("pair_id").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    assert diff.inline_spans(grouped).select(F.spark_partition_id()).distinct().count() == 4


def test_python_gives_arrays_of_plain_values(spark, monkeypatch):
    """F13 to F15: for each element of a batch there were a dict and an object for each of its fields."""
    given = []
    for module in (alignment, pairing, diff):
        monkeypatch.setattr(module, "vectorized", lambda f, returns: given.append(returns) or batches.vectorized(f, returns))
    side = spark.range(0, 60, 1, 2).select((F.col("id") % 3).alias("pair_id"), F.col("id").cast("int").alias("block_ix"), F.concat(F.lit("line "), F.col("id")).alias("text"))
    rows = diff.diff_rows(side, side.withColumn("text", F.when(F.col("block_ix") % 5 == 1, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))))
    assert rows.schema["spans"].dataType.simpleString() == diff.SPANS
    spans = {r.right_text: [tuple(s) for s in r.spans] for r in rows.where("kind = 'modify'").collect()}
    assert len(spans) == 12 and spans["line 21 more"] == [("equal", "line 21"), ("insert", " more")]
    assert given and not any("struct<" in x.removeprefix("struct<") for x in given)


def test_events_of_a_part_are_read_once(spark):
    """events were shuffled, and told anew for texts, properties, paragraphs and cells; an element within a text is none of it."""
    body = '<w:p><w:r><w:t>a<w:x>b</w:x>c</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p/><w:p><w:r><w:t>d</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl><w:p><w:del/><w:r><w:t/><w:t>e</w:t></w:r></w:p>'
    part = F.array(F.struct(F.lit(0).alias("section"), F.lit(f"<w:document><w:body>{body}</w:body></w:document>").alias("xml")))
    files = spark.range(3).select(F.col("id").cast("string").alias("path"), F.lit("docx").alias("format"), F.lit(None).cast("string").alias("error"), part.alias("parts"))
    told = office.drafts(files)
    assert "Generate" not in plan(told)
    assert [tuple(r) for r in told.where("path = '2'").orderBy("draft_ix").select("type", "raw_text", "char_offset").collect()] == [("paragraph", "ac", 0), ("table", "d | ", 2), ("paragraph", "e", 6)]
    parts = files.select("path", "format", F.explode("parts").alias("p")).select("path", "format", "p.*")
    assert plan(office.paragraphs(office.scoped(parts))).count("Exchange") == 1


ODD = ["", " ", None, "a b", "a b　\x0b", "x ing th was y", " th" * 5115 + "ing" * 41]


@pytest.mark.parametrize("name", ["text_quality", "quality_flags"])
def test_quality_of_odd_documents_equals_its_sql(spark, tmp_path, name):
    """F1, F2 of round 4: empty texts, missing and repeated ids, other private characters and blanks, halves in the last digit."""
    rows = [(i, text) for i, text in enumerate(ODD * 8)] + [(3, "x was y"), (3, "x"), (None, "a was b"), (None, "a")]
    docs = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}).assign(source="s")
    docs.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).select(columns).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)


def test_doubles_are_rounded_as_sql_rounds_them(spark):
    """F2 of round 4: 41 / 5120 is 0.0080078125, and as a double times a power of ten below the half."""
    pairs = [(41, 5120), (-41, 5120), (169, 5120), (1, 1024), (1, 3), (0, 7), (5, 1)]
    x = spark.createDataFrame(pairs, "a long, b long")
    got = [r[0] for r in x.select(queries._rounded(F.col("a") / F.col("b"), 9)).collect()]
    assert got == [duckdb.sql(f"SELECT round({a} / {b}, 9)").fetchall()[0][0] for a, b in pairs]


def test_short_scripts_are_met_in_bits(monkeypatch):
    """F3 of round 4: a pair of some hundred words took hundreds of steps over its diagonals. The scripts are those of the frontiers."""
    draw = random.Random(4)
    for _ in range(400):
        a, b = ([draw.randrange(k) for _ in range(draw.randint(0, 90))] for k in [draw.choice((1, 2, 5, 60))] * 2)
        for limit in (None, 0, 7, 60):
            assert alignment.shortest_edits(a, b, limit) == alignment.shortest_edits(a, b, limit, cells=-1)
    monkeypatch.setattr(alignment, "_further", None)
    assert diff.inline(" ".join(f"a{i}" for i in range(150)), " ".join(f"b{i}" for i in range(150)))


def test_pages_are_read_as_they_were_item_by_item(spark, monkeypatch):
    """F4 of round 4: items came back from Python one by one, and were dealt and sorted twice more for their lines."""

    def plain(page):
        seen, turns = [], {0: []}
        for item in page:
            if item[3] and not any(item[3] == s[3] and abs(item[4] - s[4]) <= 1 and abs(item[5] - s[5]) <= 1 for s in seen):
                seen.append(item)
                turns.setdefault(item[9] if abs(item[9]) > 1 else 0, []).append(item)
        for turn, part in enumerate(turns.values()):
            reach, anchor, n = (median(i[7] for i in part) or 1) * 0.3 if part else 0, None, -1
            for item in sorted(part, key=lambda i: (-i[5], i[4])):
                if anchor is None or abs(item[5] - anchor) >= reach:
                    anchor, n = item[5], n + 1
                yield *item, turn, n

    draw = random.Random(9)
    pages = {(d, p): [(d, p, i, draw.choice(["a", "b ", " ", "", "über", "\U0001f600x"]), draw.randint(0, 12) / 2, draw.randint(0, 40) / 2, draw.choice([0.0, 6.0]), draw.choice([0.0, 8.0, 10.0]), draw.choice("FG"), draw.choice([0, 0, 0, 1, 90, -45])) for i in range(draw.randint(1, 40))] for d in range(4) for p in range(30)}
    rows = spark.createDataFrame([i for page in pages.values() for i in page], ", ".join(f"{c} {k}" for c, k in geometry.ITEM.items()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # pages lie in several batches
    try:
        got = geometry.in_lines(rows).collect()
        told = [tuple(r) for r in geometry.page_lines(rows).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [i for page in pages.values() for i in plain(page)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert told and sorted(told) == sorted(tuple(r) for r in geometry.lines(geometry.in_lines(rows)).collect())
    assert plan(geometry.page_lines(rows)).count("Exchange") == 1


def test_pages_behind_the_thousandth_are_read(spark, tmp_path):
    """F7 of round 4: parsed_pdf left out pages from the thousandth on."""
    docs = pd.DataFrame({"doc_id": [7, 8], "text": ["\n".join(f"Line {i} ends here." for i in range(20_050)), "\n".join(["A line of its own."] * 3)], "source": "s"})
    docs.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(entry.oracle_sql()["parsed_pdf"])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in entry.queries()["parsed_pdf"](spark, str(tmp_path)).select(columns).collect()]
    assert len(got) == 20_053 and sorted(got) == sorted(want.fetchall())


def test_lines_are_told_once_for_blocks(spark):
    """F5 of round 4: whatever named the lines read the pages again, and each dealt the texts anew."""
    rows = [(d, p, k, f"Line {k} of page {p} goes on and on, up to the end of it." if k else "Report", 50.0, 790.0 - 150 * k, 500.0, 10.0, "F", 0) for d in range(2) for p in range(3) for k in range(1 + 3 * (1 - d))]
    placed = spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in geometry.ITEM.items()))
    geoms = placed.select("doc_id", "page", F.lit(600.0).alias("width"), F.lit(0.0).alias("y_min"), F.lit(800.0).alias("y_max")).distinct()
    docs, blocks = geometry.parse(placed, geoms)
    assert "MapIn" not in plan(blocks)
    got = blocks.orderBy("block_ix").collect()
    assert {r["doc_id"] for r in got} == {0} and all("Report" not in r["text"] for r in got)
    assert [r["track"] for r in docs.orderBy("doc_id").collect()] == ["B", "C"]


def test_texts_are_dealt_once_for_runs(spark):
    """F6 of round 4: texts were dealt for the equal places, and again for the place before."""
    side = lambda name: spark.range(0, 60, 1, 2).select((F.col("id") % 3).alias("pair_id"), F.col("id").cast("int").alias("block_ix"), F.concat(F.lit(name), F.col("id") % 4).alias("text"))
    rows = plan(diff.runs(side("a"), side("b"))).splitlines()
    scan = next(k for k, line in enumerate(rows) if "FileScan" in line and "text#" in line)
    assert not any("Window" in line for line in rows[:scan])  # the texts' side of the last join comes first
