"""Table functions for SQL: what a text or a binary value holds, as rows beside it (``FROM t, LATERAL xml_events(t.xml)``)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from folioforge.functions.text import ENTITIES, REFERENCE
from folioforge.operators import markdown, xml
from folioforge.sources import hwp

# Python names the end of a text otherwise than Java does.
_PIECE, _ATTRIBUTE, _REFERENCE = re.compile(xml.PIECE.replace(r"\z", r"\Z")), re.compile(xml.ATTRIBUTE, re.ASCII), re.compile(REFERENCE)


def _decoded(text: str) -> str:
    """Named and numeric references, each decoded once; unknown ones, zero, surrogates and numbers beyond U+10FFFF stay."""

    def one(m: re.Match) -> str:
        name = m[0][1:-1]
        if not name.startswith("#"):
            return ENTITIES.get(name, m[0])
        try:
            code = int(name[2:], 16) if name[1:2] == "x" else int(re.match("#[0-9]*", name)[0][1:])
        except ValueError:
            return m[0]
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    return _REFERENCE.sub(one, text) if "&" in text else text


def _attributes(source: str) -> dict[str, str]:
    """The attributes of a tag's inside; of repeated ones the last stays."""
    return {m[1]: _decoded(m[2][1:-1] if m[2][0] in "\"'" else m[2]) for m in _ATTRIBUTE.finditer(source)}


@udtf(returnType="event_ix int, kind string, qname string, name string, attrs map<string,string>, self_closing boolean, text string")
class XmlEvents:
    """The events of an XML or HTML text, as ``operators.xml.events`` tells them; null has none."""

    def eval(self, source: str) -> Iterator[tuple]:
        n = 0
        for m in _PIECE.finditer(source or ""):
            told = self._told(m[0])
            if told:
                yield (n, *told)
                n += 1

    def _told(self, piece: str) -> tuple | None:
        if piece.startswith("<![CDATA["):
            body = piece[9:].removesuffix("]]>")
            return ("text", None, None, None, None, body) if body else None
        if not piece.startswith("<"):
            return "text", None, None, None, None, _decoded(piece)
        if piece[1:2] in ("!", "?") or not piece.endswith(">"):
            return None
        if piece.startswith("</"):
            qname = piece[2:-1].strip(" ")
            return "close", qname, re.sub("^[^:]*:", "", qname), None, None, None
        inner = piece[1:-2] if piece.endswith("/>") else piece[1:-1]
        qname = re.match(r"[^\s/]*", inner, re.ASCII)[0]
        rest = re.search(r"[\s/].*$", inner, re.ASCII | re.DOTALL)
        return ("open", qname, re.sub("^[^:]*:", "", qname), _attributes(rest[0] if rest else ""), piece.endswith("/>"), None) if qname else None


@udtf(returnType="record_ix int, tag int, level int, payload binary")
class HwpRecords:
    """The records of a section's inflated bytes; null has none, a record that reaches beyond the end ends them."""

    def eval(self, section: bytes) -> Iterator[tuple]:
        for n, record in enumerate(hwp.records(bytes(section or b""))):
            yield (n, *record)


@udtf(returnType="draft_ix int, type string, level int, raw_text string, char_offset bigint")
class MarkdownBlocks:
    """The draft blocks of a Markdown text, their places in UTF-16 units; null has none."""

    def eval(self, source: str) -> Iterator[tuple]:
        for n, block in enumerate(markdown.placed(source or "")):
            yield n, block["type"], block["level"], block["raw_text"], block["char_offset"]


FUNCTIONS = {"xml_events": XmlEvents, "hwp_records": HwpRecords, "markdown_blocks": MarkdownBlocks}


def register(spark: SparkSession) -> None:
    """Makes xml_events, hwp_records and markdown_blocks known to the session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
