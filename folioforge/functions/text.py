"""Text functions as Spark column expressions: normalisation, tokens, lengths, ids."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.batches import vectorized

# The white space that trims and splits, and the characters that normalisation folds.
WS = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
WS_IN_LINE = "\\t\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
INVISIBLE = "[\\u200B-\\u200D\\uFEFF\\u00AD]"
SINGLE_QUOTES, DOUBLE_QUOTES, DASHES = "‘’‚‛′", "“”„‟″", "‐‑‒–—―−"
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF_WIDTH = "".join(map(chr, range(0x21, 0x7F)))


@dataclass(frozen=True)
class Options:
    ignore_whitespace: bool = True
    normalize_punct: bool = False
    ignore_case: bool = False
    fold_width: bool = False
    join_hyphen: bool = False


#: Defaults of each group of formats.
DEFAULTS = {
    "text": Options(),
    "docx": Options(normalize_punct=True, fold_width=True),
    "hwp": Options(normalize_punct=True, fold_width=True),
    "pdf": Options(normalize_punct=True, fold_width=True, join_hyphen=True),
}


def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def nfc(text: Column) -> Column:
    """Canonical composition. Texts of characters below U+0300 are composed; only others go to Python."""
    other = F.when(~is_ascii(text) & text.rlike("[\\x{300}-\\x{10FFFF}]"), text)
    return F.coalesce(vectorized(_compose, "string")(other), text)


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def unify_newlines(text: Column) -> Column:
    return bound(text, lambda x: F.when(F.contains(x, F.lit("\r")), F.regexp_replace(x, "\\r\\n?", "\n")).otherwise(x))


def fold_width(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def join_hyphen(text: Column) -> Column:
    return F.regexp_replace(text, "([A-Za-z])-\\n([a-z])", "$1$2")


def fold_punct(text: Column) -> Column:
    plain = F.translate(text, SINGLE_QUOTES + DOUBLE_QUOTES + DASHES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES))
    return F.replace(plain, F.lit("…"), F.lit("..."))


def fold_blanks(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\t\\u00A0\\u3000]+", " ")


def trim(text: Column) -> Column:
    """Without white space at both ends; texts without any there are not searched. ($ is before a last line end too, hence U+0085.)"""
    ends = lambda x: F.substring(x, 1, 1).rlike(f"[{WS}]") | F.substring(x, -1, 1).rlike(f"[{WS}\\x{{85}}]")
    return bound(text, lambda x: F.when(ends(x), F.regexp_replace(x, f"^[{WS}]+|[{WS}]+$", "")).otherwise(x))


def full(text: Column) -> Column:
    """Whether a text has more than white space."""
    return text.rlike(f"[^{WS}]")


def trim_lines(text: Column) -> Column:
    return trim(F.regexp_replace(text, f"(?m)^[{WS_IN_LINE}]+|[{WS_IN_LINE}]+$", ""))


def normalize(text: Column, options: Options = Options(), compose: bool = True) -> Column:
    """All steps in their fixed order. ``compose`` may be left out where texts are known to be composed. A text that no step would change
    is told by a few searches and left as it is."""
    out = F.when(_settled(text, options), text).otherwise(_steps(text, options, compose))
    return F.lower(out) if options.ignore_case else out


#: What some step changes, or what ends a line: these texts are not settled.
UNSETTLED = "[\\x{85}\\x{A0}\\x{AD}\\x{300}-\\x{10FFFF}]"


def _settled(text: Column, options: Options) -> Column:
    """Whether a text has no character that a step may change, no blanks to fold, and none at the ends of lines."""
    parts = ["\r", "\t", "\x0b", "\f", "  ", " \n", "\n ", *(["-\n"] if options.join_hyphen else [])]
    said = is_ascii(text) | ~text.rlike(UNSETTLED)
    for part in parts:
        said = said & ~F.contains(text, F.lit(part))
    for end in (" ", "\n"):
        said = said & ~F.startswith(text, F.lit(end)) & ~F.endswith(text, F.lit(end))
    return said


def _steps(text: Column, options: Options, compose: bool) -> Column:
    out = unify_newlines(strip_invisible(nfc(text) if compose else text))
    if options.fold_width:
        out = fold_width(out)
    if options.join_hyphen:
        out = join_hyphen(out)
    if options.normalize_punct:
        out = fold_punct(out)
    if options.ignore_whitespace:
        out = fold_blanks(out)
    return trim_lines(out)


def u16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return bound(text, lambda x: F.length(x) + F.when(is_ascii(x), 0).otherwise(F.regexp_count(x, F.lit("[\\x{10000}-\\x{10FFFF}]"))))


def tokens(text: Column) -> Column:
    """Words and the white space between them; nothing is lost."""
    return F.regexp_extract_all(text, F.lit(f"[{WS}]+|[^{WS}]+"), F.lit(0))


def graphemes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("\\X"), F.lit(0))


def _fnv1a(texts: pd.Series) -> pd.Series:
    """All texts of a batch side by side, the longest first: one step for each place."""
    units = [np.frombuffer((x or "").encode("utf-16-le", "surrogatepass"), "<u2") for x in texts]
    sizes = np.array([len(u) for u in units], np.int64)
    order = np.argsort(-sizes, kind="stable")
    joined = np.concatenate([*units, np.zeros(1, "<u2")]).astype(np.uint64)
    starts = (np.cumsum(sizes) - sizes)[order]
    h = np.full(len(units), 2166136261, np.uint64)
    active = np.searchsorted(-sizes[order], -np.arange(sizes.max() if len(sizes) else 0), side="left")
    for at, m in enumerate(active):
        h[:m] = ((h[:m] ^ joined[starts[:m] + at]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    out = np.empty(len(units), np.int64)
    out[order] = h.astype(np.int64)
    return pd.Series(out).where(texts.notna().reset_index(drop=True), None)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units."""
    return vectorized(_fnv1a, "long")(text)


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def block_id(text: Column, index: Column) -> Column:
    return F.concat(base36(index), F.lit("-"), base36(fnv1a(text)))


def flatten_table(rows: Column) -> Column:
    """Cells trimmed and joined by ' | ', rows by line breaks."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, trim), " | ")), "\n")


def repeat_key(text: Column) -> Column:
    """A line without what differs from page to page."""
    return F.regexp_replace(F.regexp_replace(trim(text), "[0-9]+", "#"), f"[{WS}]+", " ")


# Inline markup of Markdown, in the order it is removed. Group 1 stays; tags go whole.
MARKUP = ("!\\[([^\\]]*)\\]\\([^)]*\\)", "\\[([^\\]]*)\\]\\([^)]*\\)", "`([^`]*)`", *(f"{m}(.+?){m}" for m in ("\\*\\*\\*", "___", "\\*\\*", "__", "\\*", "_", "~~")), "()</?[A-Za-z][^>]*>")

#: What a text must hold for each of them to be found.
MARKS = ("![", "](", "`", "***", "___", "**", "__", "*", "_", "~~", "<")


def strip_markdown(text: Column) -> Column:
    """Inline markup of one line removed: images, links, code, strong, emphasis, strike, tags. A pattern is tried where its marks are."""
    def removed(pattern: str, mark: str) -> Callable[[Column], Column]:
        return lambda x: F.when(F.contains(x, F.lit(mark)), F.regexp_replace(x, pattern, "$1")).otherwise(x)

    for pattern, mark in zip(MARKUP, MARKS, strict=True):
        text = bound(text, removed(pattern, mark))
    return text


# The named references that the scanner knows.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}
REFERENCE = "&(?:#x?[0-9a-fA-F]+|[a-zA-Z]+);"


def decode_entities(text: Column) -> Column:
    """Named and numeric references, each decoded once; unknown ones, surrogates and numbers beyond U+10FFFF stay."""

    def one(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^&#0*([0-9]{0,7})(?![0-9])", 1)
        hexa = F.regexp_extract(piece, "^&#x0*([0-9a-fA-F]{0,6});", 1)
        code = F.when(digits != "", digits.cast("long")).when(hexa != "", F.conv(hexa, 16, 10).cast("long"))
        code = F.when((code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), code)
        named = F.lit(None).cast("string")
        for name, char in ENTITIES.items():
            named = F.when(piece == f"&{name};", char).otherwise(named)
        return F.coalesce(named, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), piece)

    pieces = F.regexp_extract_all(text, F.lit(f"{REFERENCE}|[^&]+|&"), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(text)
