"""Table functions in SQL against the operators over DataFrames."""

import random
import struct

from folioforge.operators import markdown, xml
from folioforge.sources import tables

EVENTS = ["id", "event_ix", "kind", "qname", "name", "attrs", "self_closing", "text"]


def test_xml_events(spark):
    tables.register(spark)
    rng = random.Random(3)
    parts = ["<a>", "</a>", "</ w:p >", "<w:p w:x='1' y=\"&lt;2&#65;\" z=q/>", "<br/>", "<>", "< a>", "text", " ", "&amp;&#x41;&#xD800;&#1114112;&#0;&#12ab;&no;&nbsp;&", "<!-- <b> -->", "<!DOCTYPE x>", "<?pi?>", "<![CDATA[<i>&amp;]]>", "<![CDATA[]]>", "\u4e2d\U0001f600", "<a k='1' k='2'\n>", "\n"]
    cut = ["<!-- open", "<b unfinished", "<![CDATA[open", "</b", ""]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12))) + rng.choice(cut)) for i in range(400)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "id long, xml string")
    df.createOrReplaceTempView("xml_rows")
    got = spark.sql("SELECT id, e.* FROM xml_rows, LATERAL xml_events(xml) AS e").select(EVENTS).collect()
    told = xml.events(df, keys=("id",)).select(EVENTS).collect()
    as_map = lambda a: None if a is None else {x["name"]: x["value"] for x in a}
    want = [(*r[:5], as_map(r["attrs"]), *r[6:]) for r in told]
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_hwp_records(spark):
    tables.register(spark)
    record = lambda tag, level, body: struct.pack("<I", tag | level << 10 | min(len(body), 0xFFF) << 20) + (struct.pack("<I", len(body)) if len(body) >= 0xFFF else b"") + body
    rows = [(0, record(66, 0, b"") + record(67, 1, b"ab") + record(68, 1023, b"x" * 5000)), (1, record(66, 0, b"a") + record(67, 0, b"abc")[:-1]), (2, b""), (3, None), (4, b"\x01\x02")]
    spark.createDataFrame(rows, "id long, section binary").createOrReplaceTempView("section_rows")
    got = spark.sql("SELECT id, r.record_ix, r.tag, r.level, length(r.payload) FROM section_rows, LATERAL hwp_records(section) AS r").collect()
    assert sorted(map(tuple, got)) == [(0, 0, 66, 0, 0), (0, 1, 67, 1, 2), (0, 2, 68, 1023, 5000), (1, 0, 66, 0, 1)]


def test_markdown_blocks(spark):
    tables.register(spark)
    rows = [(0, "# T\n\U0001f600 a\nb\n\n- i\n```\nx\n"), (1, ""), (2, None), (3, "| a | b |\n|---|---|\n| c | d |\n> q\n> r")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.createOrReplaceTempView("markdown_rows")
    got = spark.sql("SELECT doc_id, b.* FROM markdown_rows, LATERAL markdown_blocks(text) AS b").collect()
    want = markdown.blocks(df).select("doc_id", "draft_ix", "type", "level", "raw_text", "char_offset").collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(map(tuple, want), key=lambda r: r[:2]) and len(want) > 5
