import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioforge.functions import text as t
from folioforge.operators import markdown, xml
from folioforge.plans import queries
from folioforge.sources import decode, parse

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["xml_entities", "xml_events", "xml_attributes", "decode_bytes", "md_blocks", "md_piece_blocks"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df, sql = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    key = sorted(df.columns)
    assert key == sorted(sql.columns)
    ours = sorted(tuple(str(r[c]) for c in key) for r in df.collect())
    assert ours and ours == sorted(tuple(str(r[sql.columns.index(c)]) for c in key) for r in sql.fetchall())


def md(text):
    return [(b.type, b.level, "\n".join(b.lines)) for b in markdown.parse(text)]


def test_markdown():
    assert md("# A *b* ##\n\none\ntwo\n\n---\n- x\n  - y\nmore\n3) z") == [("heading", 1, "A b"), ("paragraph", None, "one\ntwo"), ("listItem", 0, "x"), ("listItem", 1, "y\nmore"), ("listItem", 0, "z")]
    assert md("T\r\n===\r\nU\n--\n> q\n> r\nlazy") == [("heading", 1, "T"), ("heading", 2, "U"), ("quote", None, "q\nr\nlazy")]
    assert md("```py\n# no\n~~~\n\n````\n|a|b|\n|-|-|\n| c | `d` |") == [("code", None, "# no\n~~~\n"), ("table", None, "a | b\nc | d")]
    assert md("~~~\nopen") == [("code", None, "open")]
    assert md("") == md("\n \n") == []
    assert [b.place for b in markdown.parse("a\r\n\r\n# b\nc")] == [0, 5, 9]


def test_markdown_rows(spark):
    docs = spark.createDataFrame([(1, "# a\n\nb"), (2, None), (3, ""), (1, "# a\n\nb")], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in markdown.blocks(docs).collect()) == sorted([(1, 0, "heading", 1), (1, 1, "paragraph", None)] * 2, key=str)


def scan(spark, text):
    return [(r.kind, r.name or r.text) for r in xml.events(spark.createDataFrame([(1, text)], "doc_id long, xml string")).orderBy("event_ix").collect()]


def test_xml(spark):
    assert scan(spark, "<?xml?><!DOCTYPE d><w:a x='1'>t&amp;u<!-- <no> --><b/><![CDATA[<&lt;>]]></w:a >") == [("open", "a"), ("text", "t&u"), ("open", "b"), ("text", "<&lt;>"), ("close", "a")]
    assert scan(spark, "<a>x<b c") == [("open", "a"), ("text", "x")]
    assert scan(spark, "a<!-- open <b>") == [("text", "a")]
    assert scan(spark, "<![CDATA[rest") == [("text", "rest")]
    assert scan(spark, "<>x< y>") == [("text", "x")]
    assert scan(spark, "") == scan(spark, None) == []
    one = xml.root_attributes(spark.createDataFrame([(1, """<r a="1 &lt;" b='2' c=3 a="4"/>"""), (2, "none")], "doc_id long, xml string")).select("attrs", xml.attribute(F.col("attrs"), "a"), xml.attribute(F.col("attrs"), "z")).collect()
    assert [([tuple(a) for a in r[0]], r[1], r[2]) for r in one] == [([("a", "1 <"), ("b", "2"), ("c", "3"), ("a", "4")], "4", None)]


@pytest.mark.parametrize("text, out", [("&#65;&#x42;&#128512;", "AB😀"), ("&amp;lt; &copy; & &;", "&lt; &copy; & &;"), ("&nbsp;", "\u00a0"), ("&#x110000;&#xD800;&#99999999;", "&#x110000;&#xD800;&#99999999;"), ("", ""), (None, None)])
def test_entities(spark, text, out):
    assert spark.createDataFrame([(text,)], "x string").select(t.decode_entities(F.col("x"))).first()[0] == out


KOREAN = "\uacc4\uc57d\uc11c \uc81c1\uc870 \ubaa9\uc801\uacfc \uc815\uc758"


@pytest.mark.parametrize(
    "raw, want",
    [
        (b"", ("", "utf-8", False)),
        (KOREAN.encode("cp949"), (KOREAN, "euc-kr", True)),
        (KOREAN.encode(), (KOREAN, "utf-8", False)),
        ("plain text".encode("utf-16-le"), ("plain text", "utf-16le", True)),
        ("plain text".encode("utf-16-be"), ("plain text", "utf-16be", True)),
        (b"\xff\xfea\0", ("a", "utf-16le", False)),
        (b"\xfe\xff\0a", ("a", "utf-16be", False)),
        (b"\xef\xbb\xbfa", ("a", "utf-8-bom", False)),
        ("the caf\u00e9 is open today".encode("cp1252"), ("the caf\u00e9 is open today", "windows-1252", True)),
    ],
)
def test_decode(spark, raw, want):
    assert decode.decode(raw) == want
    rows = spark.createDataFrame([(bytearray(raw),), (None,)], "c binary").select(decode.decoded(F.col("c")).alias("d")).collect()
    assert tuple(rows[0]["d"]) == want
    assert tuple(rows[1]["d"]) == (None, None, None)


def test_files(spark):
    rows = [("a.md", b"# T\n\nb *c*"), ("b.txt", "x\n\n \n\ny".encode("utf-16")), ("c.pdf", b"%PDF-1.7"), ("d.txt", b"")]
    files = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in rows], "path string, length long, content binary")
    texts = parse.read_texts(files)
    assert {r.path: (r.format, r.encoding, r.error) for r in texts.collect()} == {"a.md": ("md", "utf-8", None), "b.txt": ("txt", "utf-16le", None), "c.pdf": ("pdf", None, None), "d.txt": (None, None, "EMPTY_FILE")}
    assert sorted((r.path, r.block_ix, r.type, r.text) for r in parse.text_blocks(texts).collect()) == [("a.md", 0, "heading", "T"), ("a.md", 1, "paragraph", "b c"), ("b.txt", 0, "paragraph", "x"), ("b.txt", 1, "paragraph", "y")]


def test_markdown_lines_are_whole(spark):
    lines = queries._markdown(spark, SF).join(queries._blocks(spark, SF).select("doc_id", "block_ix", "text"), ["doc_id", "block_ix"]).where("length(text) > 60 and pmod(doc_id + block_ix, 9) <> 8")
    assert lines.count() > 0 and lines.where("not contains(line, text)").isEmpty()
