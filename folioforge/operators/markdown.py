"""Markdown into blocks: headings, paragraphs, list items, quotes, tables, code."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.batches import vectorized
from folioforge.functions.text import MARKUP

# What a line of Markdown can be.
FENCE = re.compile(r"^\s*(```+|~~~+)")
RULE = re.compile(r"^\s*([-*_])(\s*\1){2,}\s*$")
HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
SETEXT = re.compile(r"^(=+|-{2,})\s*$")
QUOTE = re.compile(r"^\s*>\s?")
ITEM = re.compile(r"^(\s*)(?:[-*+]|\d{1,9}[.)])\s+(.*)$")
TABLE_ROW = re.compile(r"^\s*\|.*\|\s*$")
TABLE_DELIM = re.compile(r"^\s*\|?[\s:-]*-[\s|:-]*\|?\s*$")
LINE = re.compile(r"([^\r\n]*)(?:\r\n?|\n|$)")
_MARKUP = [re.compile(p) for p in MARKUP]

BLOCKS = "array<struct<type string, level int, raw_text string, char_offset long>>"
FENCES = ("`", "~")
#: Blocks whose text goes on in a line that is nothing else.
FLOWING = ("paragraph", "quote", "listItem")


def line_class(line: Column) -> Column:
    """What a line is by itself: fence, blank, rule, heading, quote, bullet, ordered, table or text."""
    item = F.when(line.rlike(ITEM.pattern), F.when(line.rlike(r"^\s*\d"), "ordered").otherwise("bullet"))
    out = F.coalesce(item, F.when(line.rlike(TABLE_ROW.pattern), "table"), F.lit("text"))
    for kind, pattern in (("quote", QUOTE.pattern), ("heading", HEADING.pattern), ("rule", RULE.pattern), ("blank", r"^\s*$"), ("fence", FENCE.pattern)):
        out = F.when(line.rlike(pattern), kind).otherwise(out)
    return out


def strip_inline(line: str) -> str:
    for p in _MARKUP:
        line = p.sub(r"\1", line)
    return line


def _line(line: str, after: str, strip: Callable[[str], str]) -> tuple[str, int | None, str]:
    """Type, level and text of a line outside of code, after an open block of type ``after``. The types ``end``
    (closes the open block), ``title`` (makes it a heading) and ``skip`` (adds nothing to it) are no blocks."""
    if not line.strip() or (RULE.match(line) and after != "paragraph"):
        return "end", None, ""
    if m := HEADING.match(line):
        return "heading", len(m[1]), strip(re.sub(r"\s+#+\s*$", "", m[2]))
    if after == "paragraph" and (m := SETEXT.match(line)):
        return "title", 1 if m[1][0] == "=" else 2, ""
    if m := QUOTE.match(line):
        return "quote", None, strip(line[m.end() :])
    if m := ITEM.match(line):
        return "listItem", len(m[1]) // 2, strip(m[2])
    if TABLE_ROW.match(line):
        if after == "table" and TABLE_DELIM.match(line):
            return "skip", None, ""
        return "table", None, " | ".join(strip(c).strip() for c in line.strip()[1:-1].split("|"))
    return "text", None, strip(line)


@dataclass
class Block:
    """A block, or what one piece of a text holds of it. ``starts``: its first line is there. A block that began before
    the piece has no type, unless it becomes a heading there."""

    type: str | None
    level: int | None
    lines: list[str]
    place: int
    starts: bool = True


def step(line: str, state: str, strip: Callable[[str], str] = strip_inline) -> tuple[str, str, int | None, str]:
    """State after a line, what it does, level, text. A state is the type of the open block, the marks that opened the code, or
    empty. A line adds to the open block, ends it, makes it a title, is skipped, or starts a block of the type named."""
    found = FENCE.match(line)
    if state[:1] in FENCES:
        closed = found and found[1][0] == state[0] and len(found[1]) >= len(state)
        return ("", "end", None, "") if closed else (state, "add", None, line)
    if found:
        return found[1], "code", None, ""
    kind, level, body = _line(line, state, strip)
    if kind == "skip" or (kind == state and kind in ("quote", "table")) or (kind == "text" and state in FLOWING):
        return state, kind if kind == "skip" else "add", None, body
    if kind in ("end", "title", "heading"):
        return "", kind, level, body
    kind = "paragraph" if kind == "text" else kind
    return kind, kind, level, body


def lines_of(text: str) -> Iterator[tuple[int, str]]:
    """Place and text of each line; after the last line break there is none."""
    return ((m.start(), m[1]) for m in LINE.finditer(text) if m.end() > m.start())


def parse(text: str, state: str = "") -> Iterator[Block]:
    """The blocks of a text, or of a piece of whole lines that begins in ``state``. Code that isn't closed ends with the text."""
    block = Block(None, None, [], 0, False) if state else None
    for place, line in lines_of(text):
        state, does, level, body = step(line, state)
        if does == "add":
            block.lines.append(body)
            continue
        if does == "skip":
            continue
        if does == "title":
            block.type, block.level = "heading", level
        if block:
            yield block
        block = None
        if does not in ("end", "title"):
            block = Block(does, level, [] if does == "code" else [body], place)
        if does == "heading":
            yield block
            block = None
    if block:
        yield block


def _parsed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else list(placed(t)))


def placed(text: str) -> Iterator[dict]:
    """The blocks with their places in UTF-16 units."""
    units = at = 0
    for block in parse(text):
        units, at = units + u16_units(text[at : block.place]), block.place
        yield {"type": block.type, "level": block.level, "raw_text": "\n".join(block.lines), "char_offset": units}


def u16_units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def blocks(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Draft blocks: keys, draft_ix, type, level, raw_text, char_offset. Null and empty texts have none. A document
    is read in order, in one row; ``markdown_pieces`` cuts long ones."""
    rows = docs.select(*keys, F.posexplode(vectorized(_parsed, BLOCKS)(F.col(text))).alias("draft_ix", "b"))
    return rows.select(*keys, "draft_ix", "b.*")
