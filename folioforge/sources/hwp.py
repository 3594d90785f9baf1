"""HWP 5.0 files: a compound file whose section streams are records, some of which hold the text of paragraphs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.batches import vectorized
from folioforge.functions.scratch import stored
from folioforge.functions import text as t
from folioforge.operators import blocks as b

# Signatures, tags of records, and the units that control characters take.
COMPOUND = bytes.fromhex("D0CF11E0A1B11AE1")
SIGNATURE = b"HWP Document File"
PARA_HEADER, PARA_TEXT, TABLE = 66, 67, 77
#: Characters of one unit, and what stands for them; all other controls below 32 take eight units.
SINGLE = {0: "", 10: "\n", 13: "\n", 24: "-", 25: "", 26: "", 27: "", 28: "", 29: "", 30: " ", 31: " "}
LEAST_CHARS, LEAST_PREVIEW = 50, 10
FREE, END = 0xFFFFFFFF, 0xFFFFFFFE


class Compound:
    """The streams of a compound file by path, lower-cased. A file that contradicts itself raises ValueError."""

    def __init__(self, raw: bytes) -> None:
        if len(raw) < 512 or raw[:8] != COMPOUND:
            raise ValueError("no compound file")
        self.raw = raw
        shift, mini_shift = struct.unpack_from("<HH", raw, 30)
        if not (7 <= shift <= 16 and 2 <= mini_shift < shift):
            raise ValueError("sector size")
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        first_dir, _, self.cutoff, first_mini, _, first_more, n_more = struct.unpack_from("<IIIIIII", raw, 48)
        tables = [s for s in struct.unpack_from("<109I", raw, 76) if s < END]
        for _ in range(min(n_more, len(raw) // self.size)):
            if first_more >= END:
                break
            *more, first_more = struct.unpack(f"<{self.size // 4}I", self._sector(first_more))
            tables += [s for s in more if s < END]
        self.next = [x for s in tables for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        entries = self._chain(first_dir)
        self.entries = [entries[i : i + 128] for i in range(0, len(entries) - 127, 128)]
        root = self.entries[0] if self.entries else b"\0" * 128
        mini = self._chain(first_mini) if first_mini < END else b""
        self.mini_next = list(struct.unpack(f"<{len(mini) // 4}I", mini))
        self.mini = self._chain(struct.unpack_from("<I", root, 116)[0])
        self.places = dict(self._walk())

    def _sector(self, n: int) -> bytes:
        part = self.raw[(n + 1) * self.size : (n + 2) * self.size]
        if not part:
            raise ValueError("sector outside of the file")
        return part.ljust(self.size, b"\0")

    def _chain(self, at: int) -> bytes:
        out, left = [], len(self.next) + 1
        while at < END:
            if not left or at >= len(self.next):
                raise ValueError("broken chain")
            out.append(self._sector(at))
            at, left = self.next[at], left - 1
        return b"".join(out)

    def _walk(self) -> Iterator[tuple[str, tuple[int, int]]]:
        """Path, first sector and size of the streams: each storage holds a tree of siblings."""
        todo, seen = [("", 0, True)], set()
        while todo:
            path, n, top = todo.pop()
            if n >= len(self.entries) or (n in seen):
                continue
            seen.add(n)
            e = self.entries[n]
            length, kind = struct.unpack_from("<HB", e, 64)
            left, right, child = struct.unpack_from("<III", e, 68)
            name = e[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace").lower()
            own = "" if top else f"{path}/{name}".lstrip("/")
            if not top:
                todo += [(path, left, False), (path, right, False)]
            if kind in (1, 5):
                todo.append((own, child, False))
            elif kind == 2:
                yield own, struct.unpack_from("<II", e, 116)

    def find(self, name: str) -> bytes | None:
        """A stream by its path or the end of it."""
        for path, (at, size) in self.places.items():
            if path == name or path.endswith("/" + name):
                if size >= self.cutoff:
                    return self._chain(at)[:size]
                out, left = [], len(self.mini_next) + 1
                while at < END and left:
                    if at >= len(self.mini_next):
                        raise ValueError("broken chain")
                    out.append(self.mini[at * self.mini_size : (at + 1) * self.mini_size])
                    at, left = self.mini_next[at], left - 1
                return b"".join(out)[:size]
        return None


def inflated(raw: bytes) -> bytes:
    """Raw deflate; bytes that aren't are taken as they are."""
    try:
        return zlib.decompress(raw, -15)
    except zlib.error:
        return raw


def header(raw: bytes) -> tuple[str, bool, str | None]:
    """(version, compressed, error) of the file header stream."""
    if len(raw) < 40 or not raw.startswith(SIGNATURE):
        return "", False, "NOT_HWP"
    version, flags = struct.unpack_from("<II", raw, 32)
    error = "ENCRYPTED" if flags & 2 else "HWP_DISTRIBUTION_DOC" if flags & 4 else None
    return ".".join(str(version >> s & 255) for s in (24, 16, 8, 0)), bool(flags & 1), error


def records(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tag, level, payload) of each record; a record that reaches beyond the end ends them."""
    at = 0
    while at + 4 <= len(raw):
        (word,) = struct.unpack_from("<I", raw, at)
        size, at = word >> 20, at + 4
        if size == 0xFFF:
            if at + 4 > len(raw):
                return
            (size,) = struct.unpack_from("<I", raw, at)
            at += 4
        if at + size > len(raw):
            return
        yield word & 0x3FF, word >> 10 & 0x3FF, raw[at : at + size]
        at += size


def paragraph_text(payload: bytes) -> tuple[str, int]:
    """The text of a paragraph's units and the number of its larger controls; a tab is one of those."""
    units = struct.unpack(f"<{len(payload) // 2}H", payload[: len(payload) // 2 * 2])
    out, controls, at = [], 0, 0
    while at < len(units):
        unit = units[at]
        if unit >= 32:
            upto = at
            while upto < len(units) and units[upto] >= 32:
                upto += 1
            out.append(payload[2 * at : 2 * upto].decode("utf-16-le", "replace"))
            at = upto
        elif unit in SINGLE:
            out.append(SINGLE[unit])
            at += 1
        else:
            out.append("\t" if unit == 9 else "")
            controls, at = controls + 1, at + 8
    return "".join(out), controls


def strip_controls(text: Column) -> Column:
    """Without control characters but tab and line break."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B-\\x1F\\x7F]", "")


OPENED = "struct<error string, version string, sections array<binary>, preview binary>"


def _open(raw: bytes) -> dict:
    nothing = {"error": None, "version": None, "sections": [], "preview": None}
    try:
        file = Compound(raw)
        head = file.find("fileheader")
        if head is None:
            return nothing | {"error": "LEGACY_DOC" if file.find("worddocument") is not None else "NOT_HWP"}
        version, compressed, error = header(head)
        if error:
            return nothing | {"error": error, "version": version or None}
        sections = []
        while (part := file.find(f"bodytext/section{len(sections)}")) is not None:
            sections.append(inflated(part) if compressed else part)
        return nothing | {"version": version, "sections": sections, "preview": file.find("prvtext")}
    except (ValueError, struct.error):
        return nothing | {"error": "CORRUPTED"}


def opened(contents: DataFrame) -> DataFrame:
    """path, error, version, sections (of inflated bytes), preview of files (path, content): a file is read by one task."""
    read = vectorized(lambda c: pd.DataFrame([_open(bytes(x)) for x in c], columns=["error", "version", "sections", "preview"]), OPENED)
    return contents.where("content is not null").select("path", read("content").alias("o")).select("path", "o.*")


def section_records(files: DataFrame) -> DataFrame:
    """path, section, ix, tag, level, payload of all records of opened files."""
    read = vectorized(lambda s: s.map(lambda raw: [{"tag": a, "level": b, "payload": c} for a, b, c in records(bytes(raw))]), "array<struct<tag int, level int, payload binary>>")
    rows = files.select("path", F.posexplode("sections").alias("section", "raw"))
    return rows.select("path", "section", F.posexplode(read("raw")).alias("ix", "r")).select("path", "section", "ix", "r.*")


def paragraphs(rows: DataFrame) -> DataFrame:
    """The paragraphs of records: path, draft_ix, section, raw_text, char_offset (in UTF-16 units). A header begins one; those without text go."""
    read = vectorized(lambda p: p.map(lambda raw: paragraph_text(bytes(raw))[0]), "string")
    told = rows.where(F.col("tag").isin(PARA_HEADER, PARA_TEXT))
    n = F.sum((F.col("tag") == PARA_HEADER).cast("int")).over(Window.partitionBy("path", "section").orderBy("ix"))
    texts = told.withColumn("n", n).where(F.col("tag") == PARA_TEXT).withColumn("text", read("payload"))
    whole = texts.groupBy("path", "section", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "text"))), lambda p: p["text"]), "").alias("raw_text")).where(t.trim(F.col("raw_text")) != "")
    order = Window.partitionBy("path").orderBy("section", "n")
    size = t.u16_length(F.col("raw_text"))
    return whole.select("path", (F.row_number().over(order) - 1).cast("int").alias("draft_ix"), "section", "raw_text", (F.sum(size).over(order) - size).cast("long").alias("char_offset"))


def utf16(raw: Column) -> Column:
    """Little-endian UTF-16; what isn't is replaced."""
    return vectorized(lambda x: x.map(lambda b: None if b is None else bytes(b).decode("utf-16-le", "replace")), "string")(raw)


def read_hwp(contents: DataFrame, options: t.Options = t.DEFAULTS["hwp"]) -> tuple[DataFrame, DataFrame]:
    """(docs, blocks) of HWP files (path, content). docs: path, version, sections, confidence, warnings (comma-joined), error.

    A file whose sections have few characters is read from its preview, if that has some (confidence 0.4); one without any
    text is corrupted."""
    files = stored(opened(contents), "opened")
    rows = section_records(files)
    body = b.finish_blocks(paragraphs(rows), options, keys=("path",)).withColumn("type", F.lit("paragraph"))
    sizes = body.groupBy("path").agg(F.sum(t.u16_length(F.col("text"))).alias("chars"))
    # Whole code points of an even number of bytes.
    preview = strip_controls(t.unify_newlines(utf16(F.col("preview"))))
    even = F.when(F.col("preview").isNotNull(), F.expr("substring(preview, 1, length(preview) div 2 * 2)"))
    shown = files.withColumn("preview", even).select("path", "error", "version", F.size("sections").alias("sections"), t.trim(preview).alias("preview")).join(sizes, "path", "left").na.fill(0, ["chars"])
    tables = rows.where(F.col("tag") == TABLE).select("path").distinct().withColumn("tables", F.lit(True))
    short, usable = F.col("chars") < LEAST_CHARS, t.u16_length(F.coalesce("preview", F.lit(""))) >= LEAST_PREVIEW
    told = shown.join(tables, "path", "left").withColumn("by_preview", F.col("error").isNull() & short & usable)
    error = F.coalesce("error", F.when((F.col("chars") == 0) & ~F.col("by_preview"), "CORRUPTED"))
    codes = [("PARTIAL_PARSE", F.col("by_preview")), ("TABLE_FLATTENED", F.col("tables")), ("HWP_NO_PAGE_INFO", F.lit(True))]
    warnings = F.array_join(F.filter(F.array(*[F.when(test, name) for name, test in codes]), lambda w: w.isNotNull()), ",")
    told = told.withColumn("error", error)
    docs = told.select("path", "version", "sections", F.when(F.col("error").isNull(), F.when(F.col("by_preview"), 0.4).otherwise(0.85)).alias("confidence"), F.when(F.col("error").isNull(), warnings).alias("warnings"), "error")
    drafts = b.split_paragraphs(told.where("by_preview").select("path", "preview"), "preview", ("path",)).withColumn("section", F.lit(None).cast("int"))
    by_preview = b.finish_blocks(drafts, options, keys=("path",)).withColumn("type", F.lit("paragraph"))
    columns = ["path", "block_ix", "block_id", "type", "text", "raw_text", "section", "char_offset"]
    own = body.join(told.where("by_preview or error is not null").select("path"), "path", "left_anti")
    return docs, own.select(columns).unionByName(by_preview.select(columns))
