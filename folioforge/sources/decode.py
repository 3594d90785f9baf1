"""Bytes of unknown encoding into text."""

from __future__ import annotations

import codecs
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.batches import vectorized

RESULT = "struct<text string, encoding string, guessed boolean>"
HEAD = 4096
# Byte order marks, and the encodings that are tried (their name, Python's codec), first on ties.
MARKS = ((codecs.BOM_UTF8, "utf-8-bom", "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le", "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16be", "utf-16-be"))
TRIED = (("euc-kr", "cp949"), ("utf-16le", "utf-16-le"), ("utf-16be", "utf-16-be"), ("windows-1252", "cp1252"))
BAD = re.compile("[\ufffd\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\U00010000-\U0010ffff]")
HANGUL = re.compile("[\uac00-\ud7a3]")
PLAIN = re.compile("[\u3131-\u318e\u4e00-\u9fff\x20-\x7e\n\t]")


def _latin(error: UnicodeError) -> tuple[str, int]:
    """Bytes that windows-1252 leaves undefined are control characters."""
    return error.object[error.start : error.end].decode("latin-1"), error.end


codecs.register_error("folioforge-latin", _latin)


def zero_pattern(raw: bytes) -> str | None:
    """utf-16le or utf-16be by where the zero bytes are among the first ones."""
    head = np.frombuffer(raw[:HEAD], np.uint8)
    if len(head) < 4:
        return None
    even, odd = ((head[k::2] == 0).sum() / (len(head) / 2) for k in (0, 1))
    return "utf-16le" if odd > 0.3 and even < 0.05 else "utf-16be" if even > 0.3 and odd < 0.05 else None


def score(text: str) -> float:
    """How much a text looks like one; a character beyond the basic plane counts as two bad units."""
    wide = sum(c > "\uffff" for c in text)
    if not text:
        return -np.inf
    good = 2 * len(HANGUL.findall(text)) + len(PLAIN.findall(text))
    return (good - 6 * (len(BAD.findall(text)) + wide)) / (len(text) + wide)


def decode(raw: bytes) -> tuple[str, str, bool]:
    """(text, encoding, guessed): by mark, by zero bytes, as UTF-8, else the most plausible of those tried."""
    for mark, name, codec in MARKS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(codec, "replace"), name, False
    if name := zero_pattern(raw):
        return raw.decode(dict(TRIED)[name], "replace"), name, True
    try:
        return raw.decode("utf-8"), "utf-8", False
    except UnicodeDecodeError:
        readings = [(raw.decode(codec, "folioforge-latin" if codec == "cp1252" else "replace"), name) for name, codec in TRIED]
        text, name = max(readings, key=lambda r: score(r[0]))
        return text, name, True


def _decoded(contents: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if c is None else decode(bytes(c)) for c in contents]
    return pd.DataFrame(rows, columns=["text", "encoding", "guessed"])


def decoded(content: Column) -> Column:
    """text, encoding and guessed of a column of bytes; null for null. UTF-8 without mark and zero bytes, the common
    case, stays in the JVM; only other bytes go to Python."""
    text = content.cast("string")
    plain = F.is_valid_utf8(text) & ~F.contains(text, F.lit("\0")) & ~text.startswith("\ufeff")
    named = F.struct(text.alias("text"), F.lit("utf-8").alias("encoding"), F.lit(False).alias("guessed"))
    return F.when(plain, named).otherwise(vectorized(_decoded, RESULT)(F.when(~plain, content)))


def confidence(guessed: Column) -> Column:
    return F.when(guessed, 0.7).otherwise(1.0)
