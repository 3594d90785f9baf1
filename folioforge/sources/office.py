"""DOCX and HWPX files, which are XML in a zip, into blocks.

A task only opens the zip. The parts are dealt over tasks, and become event rows (``operators.xml``) there; all else is told from these by windows
over a part in order: how many elements of a kind are open at an event, and which was opened last among those at the same depth. So a
text knows its paragraph, a paragraph its cell, row and outermost table, and what is deleted or a property is left out. Events are read
once: their paragraphs are put together by grouping and stored, then cells, rows and tables by grouping these.

A paragraph within a paragraph (a text box) is a block of its own after it. A table is one block: rows are lines, cells are
parted by ' | ', and a cell has the lines of all its paragraphs, those of tables inside of it too.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.batches import vectorized
from folioforge.functions import text as t
from folioforge.functions.scratch import paired, stored
from folioforge.operators import xml

# Limits, names of heading styles, elements that stand for one character.
MAX_ENTRIES, MAX_XML = 2000, 256 << 20
DOCX_HEADING = r"(?i)^(?:heading|제목|개요)\s*([1-9])$"
HWPX_HEADING = r"(?i)(?:개요|제목)\s*([1-9])|^(?:outline|heading)\s*([1-9])$"
QUOTE = "(?i)quote|인용"
CHARACTERS = {"tab": "\t", "br": "\n", "cr": "\n", "lineBreak": "\n"}

OPENED = "struct<error string, warnings array<string>, parts array<struct<section int, xml string>>>"
PART = ["path", "section"]
#: The section of a part that holds styles, and of the only part of a DOCX file.
HEADER, WHOLE = -1, 0


class Refused(Exception):
    """The file can't be read; the argument says why."""


def _part(archive: zipfile.ZipFile, name: str) -> tuple[str, dict[str, str]] | None:
    """The text of a well-formed part with the attributes of its first element; None if the archive hasn't got it."""
    try:
        entry = archive.getinfo(name)
    except KeyError:
        return None
    if entry.file_size > MAX_XML:
        raise Refused("OUT_OF_MEMORY")
    raw, first = archive.read(entry), []
    parser = expat.ParserCreate()
    parser.StartElementHandler = lambda _, attributes: first or first.append(attributes)
    parser.Parse(raw, True)
    text = raw.decode("utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig", "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n"), first[0]


def _docx(archive: zipfile.ZipFile) -> tuple[list[dict], list[str]]:
    body = _part(archive, "word/document.xml")
    if body is None:
        raise Refused("CORRUPTED")
    return [{"section": WHOLE, "xml": body[0]}], []


def _hwpx(archive: zipfile.ZipFile) -> tuple[list[dict], list[str]]:
    header = _part(archive, "Contents/header.xml")
    parts = [{"section": HEADER, "xml": header[0]}] if header else []
    declared = next((v for k, v in header[1].items() if k.rpartition(":")[2] == "secCnt"), "0") if header else "0"
    present = sum(bool(re.fullmatch(r"Contents/section\d+\.xml", n, re.IGNORECASE)) for n in archive.namelist())
    warnings = []
    # A declared count can't exceed what an archive may hold.
    for section in range(max(min(int(declared), MAX_ENTRIES) if declared.isdecimal() else 0, present, 1)):
        body = _part(archive, f"Contents/section{section}.xml")
        if body is None:
            warnings.append("HWPX_SECTION_MISSING")
        else:
            parts.append({"section": section, "xml": body[0]})
    return parts, [*warnings, "HWP_NO_PAGE_INFO"]


def unzipped(content: bytes, fmt: str) -> dict:
    """The XML parts of a file, warnings and error."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            if len(archive.infolist()) > MAX_ENTRIES:
                raise Refused("CORRUPTED")
            parts, warnings = (_hwpx if fmt == "hwpx" else _docx)(archive)
    except Refused as error:
        return {"error": str(error), "warnings": [], "parts": []}
    except (zipfile.BadZipFile, zlib.error, expat.ExpatError, EOFError, NotImplementedError, RuntimeError):
        return {"error": "CORRUPTED", "warnings": [], "parts": []}
    return {"error": None, "warnings": warnings, "parts": parts}


def _opened(contents: pd.Series, formats: pd.Series) -> pd.DataFrame:
    none = {"error": None, "warnings": None, "parts": None}
    return pd.DataFrame([none if c is None else unzipped(bytes(c), f) for c, f in zip(contents, formats, strict=True)], columns=["error", "warnings", "parts"])


def _value(inner: Column, *names: str | Column) -> Column:
    """The first attribute of a name (without prefix) of an open tag, from its inside."""
    attrs = xml.inner_attributes(inner)
    named = lambda name: F.get(F.filter(attrs, lambda a: xml.local_name(a["name"]) == name), F.lit(0))["value"]
    return F.when(F.contains(inner, F.lit("=")), F.coalesce(*map(named, names)))


#: Elements that say something of the paragraph they are properties of, and the attributes that are read.
PROPERTIES = ["pStyle", "outlineLvl", "numPr", "ilvl"]
READ = {"p": "styleIDRef", "ctrl": "id", "pStyle": "val", "outlineLvl": "val", "ilvl": "val"}
PLACE = ["n_tbl", "n_tc", "table", "row", "cell"]


def scoped(parts: DataFrame) -> DataFrame:
    """What the events of parts (PART, format, xml) say: PART, format, at (places rise), name, said and n_tbl, n_tc, table, row and cell, where the row
    and cell of the outermost table were opened, of the rows that are a ``piece`` of text, a ``prop``, the begin of a paragraph (``begins``,
    and ``shown`` unless it is left out), of a cell of an outermost table (``is_cell``) or of a header's ``style``; with ``para``, where the innermost paragraph was opened.

    A part's rows are made where its text is, so that they are sorted there and not shuffled. An element that closes itself is open on
    its own row only."""
    is_open, name, inner = F.col("kind") == "open", F.col("name"), F.col("inner")
    events = xml.pieces(parts.repartition(*PART), "xml", (*PART, "format")).withColumn("name", xml.local_name(F.col("qname")))
    key = F.try_element_at(F.create_map(*[F.lit(x) for pair in READ.items() for x in pair]), name)
    said = F.when(~is_open, F.col("text")).when((F.col("section") == HEADER) & (name == "style"), inner).when(name.isin(*READ), _value(inner, key))
    closed = is_open & F.col("self_closing")
    step = F.when(is_open & ~closed, 1).when(F.col("kind") == "close", -1).otherwise(0)
    rows = events.select(*PART, "format", F.col("piece_ix").alias("at"), "kind", "name", said.alias("said"), step.alias("step"), F.coalesce(closed, F.lit(False)).cast("int").alias("closed"))

    order = Window.partitionBy(*PART).orderBy("at")
    opens = lambda x: is_open & (name == x)
    count = lambda test: F.sum(F.when(test, F.col("step")).otherwise(0)).over(order) + F.when(test, F.col("closed")).otherwise(0)
    rows = rows.withColumns({f"n_{x.lower()}": count(name == x) for x in ("p", "tbl", "del", "pPr", "t", "styles")} | {"depth": count(F.lit(True))})
    outer = F.col("n_tbl") == 1
    last = lambda test, value="at": F.last(F.when(test, F.col(value)), ignorenulls=True).over(order)
    rows = rows.withColumns({"table": last(opens("tbl") & outer), "row": last(opens("tr") & outer), "cell": last(opens("tc") & outer), "text_depth": last(opens("t"), "depth"), "n_tc": count(outer & (name == "tc"))})

    body, inside = F.col("section") > HEADER, F.col("n_ppr") > 0
    char = F.try_element_at(F.create_map(*[F.lit(x) for pair in CHARACTERS.items() for x in pair]), name)
    piece = F.when((F.col("kind") == "text") & (F.col("n_t") > 0) & (F.col("depth") == F.col("text_depth")), F.col("said")).when(is_open, F.coalesce(char, F.when((name == "ctrl") & (F.col("said") == "tab"), "\t")))
    rows = rows.withColumns({
        "piece": F.when(body & (F.col("n_del") == 0) & ~inside & (F.col("n_p") > 0), piece),
        "prop": body & is_open & inside & (F.col("n_p") > 0) & name.isin(*PROPERTIES),
        "begins": body & opens("p"),
        "shown": ~inside & ((F.col("n_del") == 0) | (F.col("n_tbl") > 0)),  # a deleted paragraph of a cell is an empty line
        "is_cell": body & opens("tc") & outer & (F.col("n_del") == 0),
        "style": ~body & opens("style") & (F.col("n_styles") > 0),
    })
    rows = rows.where("piece is not null or prop or begins or is_cell or style")
    para = F.last(F.when(F.col("begins"), F.struct("at", "n_tbl")), ignorenulls=True).over(Window.partitionBy(*PART, "n_p").orderBy("at"))
    return rows.select(*PART, "format", "at", "name", "said", *PLACE, "piece", "prop", "begins", "shown", "is_cell", "style", para.alias("para"))


def _text(order: str, text: str, between: str) -> Column:
    """The texts of a group in order, joined; null ones are left out."""
    pairs = F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text)))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x[text]), between)


def paragraphs(rows: DataFrame) -> DataFrame:
    """The paragraphs of scoped rows: PART, format, at, style (of HWPX), p_style, outline, numbered, ilvl, n_tbl, n_tc, table, row, cell and text; as rows
    of their own the cells (``is_cell``, without text) and the heading styles' tags (``header``)."""
    alone = F.col("is_cell") | F.col("style")
    own = F.col("para.n_tbl") == F.col("n_tbl")
    named = lambda name: F.col("prop") & (F.col("name") == name)
    value = lambda name, alias: F.max_by(F.when(named(name), F.col("said")), F.when(named(name), F.col("at"))).alias(alias)
    only = lambda test, value, alias: F.first(F.when(test, value), ignorenulls=True).alias(alias)
    placed = rows.withColumns({"p_at": F.when(alone, F.col("at")).otherwise(F.col("para.at")), "piece": F.when(own, F.col("piece"))})
    begin = F.struct(*PLACE, F.when(~F.col("is_cell"), F.col("said")).alias("style"), "is_cell")
    told = placed.groupBy(*PART, "format", "p_at").agg(
        only(F.col("is_cell") | (F.col("begins") & F.col("shown")), begin, "x"), only(F.col("style"), F.col("said"), "header"), _text("at", "piece", "").alias("text"),
        value("pStyle", "p_style"), value("outlineLvl", "outline"), F.max(F.when(F.col("prop"), F.col("name") == "numPr")).alias("numbered"), value("ilvl", "ilvl"),
    )
    return told.where("x is not null or header is not null").select(*PART, "format", F.col("p_at").alias("at"), "x.*", "p_style", "outline", "numbered", "ilvl", "text", "header")


def tables(paras: DataFrame) -> DataFrame:
    """PART, format, at and raw_text of the outermost tables that have cells, from rows of paragraphs and cells."""
    part = [*PART, "format"]
    lines = paras.where("is_cell or (n_tbl > 0 and n_tc > 0)").withColumn("text", F.when(~F.col("is_cell"), F.col("text")))
    of = lambda name: F.first(F.when(F.col("is_cell"), F.struct(name)), ignorenulls=True)[name].alias(name)
    cells = lines.groupBy(*part, "cell").agg(F.max("is_cell").alias("known"), of("table"), of("row"), _text("at", "text", "\n").alias("text")).where("known")
    cells = cells.withColumn("text", t.trim(F.col("text")))
    whole = cells.groupBy(*part, "table", "row").agg(_text("cell", "text", " | ").alias("line"))
    return whole.groupBy(*part, F.col("table").alias("at")).agg(_text("row", "line", "\n").alias("raw_text"))


def _levels(paras: DataFrame) -> DataFrame:
    """path and levels, from the heading styles of its header to their levels; the last of an id counts."""
    inner = F.col("header")
    named = F.coalesce(F.nullif(_value(inner, "name"), F.lit("")), _value(inner, "engName"), F.lit(""))
    level = F.when(named.rlike(HWPX_HEADING), F.coalesce(F.nullif(F.regexp_extract(named, HWPX_HEADING, 1), F.lit("")), F.regexp_extract(named, HWPX_HEADING, 2)).cast("int"))
    found = paras.where("header is not null").select("path", "at", _value(inner, "id").alias("style"), level.alias("level")).where("level is not null and style is not null")
    last = found.groupBy("path", "style").agg(F.max_by("level", "at").alias("level"))
    return last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("style", "level"))).alias("levels"))


def drafts(files: DataFrame) -> DataFrame:
    """Draft blocks of opened files: path, draft_ix, type, level, raw_text, section (of HWPX), char_offset (in UTF-16 units). A job is run when
    this is called: it stores the paragraphs."""
    parts = files.where("error is null and path is not null").select("path", "format", F.explode("parts").alias("p")).select("path", "format", "p.*")
    paras = stored(paragraphs(scoped(parts)), "paragraphs")
    lines = paras.where("header is null and not is_cell and n_tbl = 0").select(*PART, "format", "at", "style", "p_style", "outline", "numbered", "ilvl", F.col("text").alias("raw_text"))
    grids = tables(paras).withColumn("grid", F.lit(True))
    found = paired(lines.unionByName(grids, allowMissingColumns=True), _levels(paras), "path", "left")
    digit = lambda c: c.rlike("^[0-9]{1,9}$")
    heading = F.regexp_extract("p_style", DOCX_HEADING, 1)
    outline = F.when(digit(F.col("outline")) & (F.col("outline").cast("int") <= 8), F.col("outline").cast("int") + 1)
    level = F.coalesce(F.try_element_at("levels", F.col("style")), F.when(heading != "", heading.cast("int")), outline)
    depth = F.when(digit(F.col("ilvl")), F.col("ilvl").cast("int")).otherwise(0)
    kind = F.when(F.col("grid"), "table").when(level.isNotNull(), "heading").when(F.coalesce("numbered", F.lit(False)), "listItem").when(F.col("p_style").rlike(QUOTE), "quote").otherwise("paragraph")
    order, size = Window.partitionBy("path").orderBy("section", "at"), t.u16_length(F.col("raw_text"))
    typed = found.withColumn("type", kind).withColumn("level", F.when(F.col("type") == "heading", level).when(F.col("type") == "listItem", depth))
    placed = typed.withColumns({"draft_ix": (F.row_number().over(order) - 1).cast("int"), "char_offset": (F.sum(size).over(order) - size).cast("long")})
    return placed.select("path", "draft_ix", "type", "level", "raw_text", F.when(F.col("format") == "hwpx", F.col("section")).alias("section"), "char_offset")


def opened(contents: DataFrame) -> DataFrame:
    """path, format, error, warnings and parts (section and XML) of the DOCX and HWPX files among (path, content, format); null for
    null content. A file is opened by one task."""
    chosen = contents.where(F.col("format").isin("docx", "hwpx"))
    return chosen.select("path", "format", vectorized(_opened, OPENED)("content", "format").alias("o")).select("path", "format", "o.*")


def read_office(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, drafts) of files (path, content, format): docs has path, format, warnings and error. A file without text is corrupted
    if it is HWPX, else read in part; one with an error has no drafts."""
    files = stored(opened(contents), "opened")
    found = drafts(files)
    seen = found.groupBy("path").agg(F.max(F.col("type") == "table").alias("tables"), F.max(t.trim(F.col("raw_text")) != "").alias("full"))
    told = files.drop("parts").join(seen, "path", "left").na.fill(False, ["tables", "full"])
    error = F.coalesce("error", F.when(F.col("warnings").isNotNull() & ~F.col("full") & (F.col("format") == "hwpx"), "CORRUPTED"))
    codes = [("TABLE_FLATTENED", F.col("error").isNull() & F.col("tables")), ("PARTIAL_PARSE", F.col("error").isNull() & ~F.col("full") & (F.col("format") == "docx"))]
    said = F.concat("warnings", F.filter(F.array(*[F.when(test, name) for name, test in codes]), lambda w: w.isNotNull()))
    docs = told.select("path", "format", said.alias("warnings"), error.alias("error"))
    return docs, found.join(docs.where("error is not null").select("path"), "path", "left_anti")
