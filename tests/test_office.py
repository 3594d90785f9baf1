import io
import random
import re
import zipfile
from xml.etree import ElementTree

import pytest

from folioforge.operators import blocks
from folioforge.sources import office

W = 'xmlns:w="urn:w"'


def zipped(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in entries.items():
            archive.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def p(text, props=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def read(spark, raw, fmt):
    """blocks, warnings and error of one file."""
    docs, drafts = office.read_office(spark.createDataFrame([("a", bytearray(raw), fmt)], "path string, content binary, format string"))
    return docs.first().asDict() | {"blocks": drafts.orderBy("draft_ix").collect()}


def docx(spark, body):
    return read(spark, zipped(word__document=f"<w:document {W}><w:body>{body}</w:body></w:document>"), "docx")


def kinds(parsed):
    return [(b["type"], b["level"], b["raw_text"]) for b in parsed["blocks"]]


def test_docx(spark):
    props = ['<w:pStyle w:val="Heading2"/>', '<w:pStyle w:val="제목 3"/>', '<w:outlineLvl w:val="0"/>', '<w:numPr><w:ilvl w:val="1"/></w:numPr>', '<w:pStyle w:val="IntenseQuote"/>', '<w:tabs><w:tab w:val="left"/></w:tabs>']
    got = docx(spark, "".join(p(str(i), x) for i, x in enumerate(props)))
    assert kinds(got) == [("heading", 2, "0"), ("heading", 3, "1"), ("heading", 1, "2"), ("listItem", 1, "3"), ("quote", None, "4"), ("paragraph", None, "5")]
    assert [b["char_offset"] for b in got["blocks"]] == [0, 1, 2, 3, 4, 5] and got["error"] is None
    run = "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b &amp; c</w:t><w:br/><w:t>d</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:del/><w:r><w:t>e</w:t></w:r></w:p>"
    assert kinds(docx(spark, run)) == [("paragraph", None, "a\tb & c\nde")]


def test_docx_tables(spark):
    inner = f"<w:tbl><w:tr><w:tc>{p('x')}</w:tc><w:tc>{p('y')}</w:tc></w:tr></w:tbl>"
    table = f"<w:tbl><w:tr><w:tc>{p(' A ')}</w:tc><w:tc>{p('B')}{p('B2')}</w:tc></w:tr><w:tr><w:tc>{inner}</w:tc><w:tc>{p('D')}</w:tc></w:tr></w:tbl>"
    got = docx(spark, table + p("after"))
    assert kinds(got) == [("table", None, "A | B\nB2\nx\ny | D"), ("paragraph", None, "after")]
    assert got["warnings"] == ["TABLE_FLATTENED"]
    box = f"<w:p><w:r><w:t>out</w:t><w:txbx>{p('in')}</w:txbx><w:t>side</w:t></w:r></w:p>"
    assert [b[2] for b in kinds(docx(spark, box))] == ["outside", "in"]


@pytest.mark.parametrize("raw, error", [(b"PK\x03\x04 no zip", "CORRUPTED"), (b"", "CORRUPTED"), (zipped(other="<a/>"), "CORRUPTED"), (zipped(word__document="<a><b>"), "CORRUPTED"), (zipped(**{f"n{i}": "" for i in range(2001)}), "CORRUPTED")])
def test_broken(spark, raw, error):
    got = read(spark, raw, "docx")
    assert (got["blocks"], got["error"]) == ([], error)


def test_empty_docx(spark):
    assert docx(spark, "")["warnings"] == ["PARTIAL_PARSE"]


def test_hwpx(spark):
    header = '<h:head xmlns:h="urn:h" secCnt="3"><h:styles><h:style id="4" name="개요 2"/><h:style id="5" name="바탕글"/></h:styles></h:head>'
    section = '<s:sec xmlns:s="urn:s"><s:p styleIDRef="4"><s:run><s:t>H<s:tab/>x</s:t></s:run></s:p><s:p styleIDRef="5" paraPrIDRef="4"><s:run><s:t>a<s:lineBreak/>b</s:t></s:run></s:p><s:p/></s:sec>'
    raw = zipped(Contents__header=header, Contents__section0=section, Contents__section1=section)
    got = read(spark, raw, "hwpx")
    assert kinds(got)[:2] == [("heading", 2, "H\tx"), ("paragraph", None, "a\nb")]
    assert got["warnings"] == ["HWPX_SECTION_MISSING", "HWP_NO_PAGE_INFO"]
    files = spark.createDataFrame([("a.hwpx", bytearray(raw), "hwpx"), ("b.docx", None, "docx"), ("c.txt", bytearray(b"x"), "txt")], "path string, content binary, format string")
    docs, drafts = office.read_office(files)
    assert sorted((r.path, r.error) for r in docs.collect()) == [("a.hwpx", None), ("b.docx", None)]
    rows = blocks.finish_blocks(drafts, keys=("path",)).orderBy("block_ix").collect()
    assert [(r.block_ix, r.section, r.text, r.char_offset) for r in rows] == [(0, 0, "H x", 0), (1, 0, "a\nb", 3), (2, 1, "H x", 6), (3, 1, "a\nb", 9)]
    assert read(spark, zipped(Contents__section0="<s/>"), "hwpx")["error"] == "CORRUPTED"


# The same by recursion over a tree, for random documents.
def local(name: str) -> str:
    return name.rpartition("}")[2]


def value(node, key: str = "val") -> str | None:
    return None if node is None else next((v for k, v in node.attrib.items() if local(k) == key), None)


def nearest(node, name: str, stop: tuple[str, ...] = ("tbl",)) :
    """Descendants of a name, from the outside; not those inside of each other or of ``stop``."""
    for child in node:
        if local(child.tag) == name:
            yield child
        elif local(child.tag) not in stop:
            yield from nearest(child, name, stop)


def paragraph_text(node) -> tuple[str, list]:
    """The text of a paragraph without what is deleted, and the paragraphs and tables that lie inside of it."""
    parts: list[str] = []
    inner: list = []

    def go(parent, in_text: bool) -> None:
        if in_text:
            parts.append(parent.text or "")
        for child in parent:
            name = local(child.tag)
            if name in ("p", "tbl"):
                inner.append(child)
            elif name in office.CHARACTERS or (name == "ctrl" and value(child, "id") == "tab"):
                parts.append(office.CHARACTERS.get(name, "\t"))
            elif name not in ("pPr", "del"):
                go(child, name == "t")
            if in_text:
                parts.append(child.tail or "")

    go(node, False)
    return "".join(parts), inner


def cell_lines(node, deleted=False):
    for child in node:
        gone = deleted or local(child.tag) == "del"
        if local(child.tag) == "p":
            yield "" if gone else paragraph_text(child)[0]
        yield from cell_lines(child, gone)


def table_text(table) -> tuple[str, bool]:
    """Rows as lines, cells between ' | '; a cell has the lines of its paragraphs, those of tables inside of it too."""
    rows = [[("\n".join(cell_lines(cell))).strip() for cell in nearest(row, "tc")] for row in nearest(table, "tr")]
    rows = [r for r in rows if r]
    return "\n".join(" | ".join(r) for r in rows), bool(rows)


def docx_kind(paragraph) -> tuple[str, int | None]:
    found = {local(n.tag): n for pr in nearest(paragraph, "pPr", ("p", "tbl")) for n in pr.iter()}
    style, outline = value(found.get("pStyle")), value(found.get("outlineLvl"))
    if style and (m := re.match(office.DOCX_HEADING, style)):
        return "heading", int(m[1])
    if outline and outline.isdecimal() and int(outline) <= 8:
        return "heading", int(outline) + 1
    if "numPr" in found:
        depth = value(found.get("ilvl")) or "0"
        return "listItem", int(depth) if depth.isdecimal() else 0
    return ("quote" if style and re.search(office.QUOTE, style) else "paragraph"), None


def blocks_of(node, kind) :
    """Blocks below a node in document order; ``kind`` gives type and level of a paragraph."""
    for child in node:
        name = local(child.tag)
        if name == "p":
            text, inner = paragraph_text(child)
            yield *kind(child), text
            holder = ElementTree.Element("inner")
            holder.extend(inner)
            yield from blocks_of(holder, kind)
        elif name == "tbl":
            text, any_rows = table_text(child)
            if any_rows:
                yield "table", None, text
        elif name != "del":
            yield from blocks_of(child, kind)


def random_body(rng, depth=0):
    def para():
        props = rng.choice(["", '<w:pStyle w:val="Heading2"/>', '<w:numPr><w:ilvl w:val="1"/></w:numPr>', '<w:outlineLvl w:val="9"/>', '<w:outlineLvl w:val="3"/><w:pStyle w:val="Quote"/>', "<w:tabs><w:tab/></w:tabs>"])
        inner = "".join(rng.choice(["<w:t>ab </w:t>", "<w:t/>", "<w:tab/>", "<w:br></w:br>", "<w:t>&amp;x<!-- c -->y</w:t>", "<w:t><![CDATA[<q>]]></w:t>", "<w:del><w:r><w:t>no</w:t></w:r></w:del>", "stray", f"<w:txbx>{random_body(rng, depth + 1)}</w:txbx>" if depth < 2 else ""]) for _ in range(rng.randrange(5)))
        return rng.choice([f"<w:p><w:pPr>{props}</w:pPr><w:r>{inner}</w:r></w:p>", f"<w:p>{inner}</w:p>", "<w:p/>"])

    def table():
        return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{random_body(rng, depth + 1)}</w:tc>" for _ in range(rng.randrange(3))) + "</w:tr>" for _ in range(rng.randrange(3))) + "</w:tbl>"

    return "".join(rng.choice([para, para, table if depth < 3 else para, lambda: f"<w:del>{para()}</w:del>", lambda: f"<w:sdt>{para()}</w:sdt>"])() for _ in range(rng.randrange(1, 5)))


def test_against_a_tree(spark):
    rng = random.Random(17)
    bodies = [f"<w:document {W}><w:body>{random_body(rng)}</w:body></w:document>" for _ in range(300)]
    files = spark.createDataFrame([(f"{i:03}", bytearray(zipped(word__document=x)), "docx") for i, x in enumerate(bodies)], "path string, content binary, format string").repartition(4)
    got = {}
    for r in office.read_office(files)[1].orderBy("path", "draft_ix").collect():
        got.setdefault(int(r.path), []).append((r.type, r.level, r.raw_text))
    for i, x in enumerate(bodies):
        assert got.get(i, []) == [tuple(b) for b in blocks_of(ElementTree.fromstring(x), docx_kind)], x
