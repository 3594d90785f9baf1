"""XML and HTML as a sequence of events, in columns alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.text import decode_entities

#: Comments, character data, declarations and instructions, tags, text; what isn't closed reaches to the end.
PIECE = r"(?s)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)|<[!?][^>]*(?:>|\z)|<[^>]*>|<.*|[^<]+"
ATTRIBUTE = r"""([\w:.-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def local_name(name: Column) -> Column:
    """A name without its prefix."""
    return F.substr(name, F.instr(name, ":") + 1)


def attributes(source: Column) -> Column:
    """The attributes of a tag's inside as an array of (name, value), in order, references decoded."""
    names, values = (F.regexp_extract_all(source, F.lit(ATTRIBUTE), F.lit(g)) for g in (1, 2))
    bare = F.transform(values, lambda v: decode_entities(F.regexp_replace(v, "(?s)^([\"'])(.*)\\1$", "$2")))
    return F.arrays_zip(names.alias("name"), bare.alias("value"))


def attribute(attrs: Column, name: str) -> Column:
    """The value of an attribute, the last if it is repeated; null if it is missing."""
    return F.try_element_at(F.filter(attrs, lambda a: a["name"] == name), F.lit(-1))["value"]


def pieces(docs: DataFrame, xml: str = "xml", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, piece_ix, kind (open, close, text), qname, inner (of an open tag, without its brackets), self_closing, text: what events are made
    of. Places rise, but have gaps, so that nothing is shuffled."""
    cut = docs.select(*keys, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(PIECE), F.lit(0))).alias("piece_ix", "piece"))
    piece, size = F.col("piece"), F.length("piece")
    cdata, closed = piece.startswith("<![CDATA["), piece.endswith("/>")
    tag = piece.startswith("<") & piece.endswith(">") & ~piece.startswith("<!") & ~piece.startswith("<?")
    close = tag & piece.startswith("</")
    named = tag & ~close & ~F.substring(piece, 2, 1).isin(*" \t\n\x0b\f\r/>")
    inner = F.substr(piece, F.lit(2), size - 2 - closed.cast("int"))
    qname = F.when(close, F.trim(F.substr(piece, F.lit(3), size - 3))).when(named, F.regexp_extract(inner, "^[^\\s/]*", 0))
    kind = F.when(cdata, "text").when(close, "close").when(named, "open").when(~piece.startswith("<"), "text")
    data = F.regexp_extract(piece, "(?s)^<!\\[CDATA\\[(.*?)(?:\\]\\]>)?$", 1)
    text = F.when(cdata, data).when(~piece.startswith("<"), decode_entities(piece))
    kept = cut.where(F.when(cdata, data != "").otherwise(close | named | ~piece.startswith("<")))
    return kept.select(*keys, "piece_ix", kind.alias("kind"), qname.alias("qname"), F.when(named, inner).alias("inner"), F.when(named, closed).alias("self_closing"), text.alias("text"))


def inner_attributes(inner: Column) -> Column:
    """The attributes in an open tag's inside, behind its name."""
    return attributes(F.regexp_extract(inner, "(?s)[\\s/].*$", 0))


def events(docs: DataFrame, xml: str = "xml", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, event_ix, kind (open, close, text), qname, name (without prefix), attrs, self_closing, text; by document order.

    Comments, declarations and instructions are passed over, character data is text as it stands, other text has its
    references decoded. A tag that is cut off ends the document. Null and empty documents have no events."""
    rows = pieces(docs, xml, keys)
    attrs = F.when(F.col("kind") == "open", inner_attributes(F.col("inner")))
    event_ix = F.row_number().over(Window.partitionBy(*keys).orderBy("piece_ix")) - 1
    return rows.select(*keys, "kind", "qname", local_name(F.col("qname")).alias("name"), attrs.alias("attrs"), "self_closing", "text", event_ix.alias("event_ix"))


def root_attributes(docs: DataFrame, xml: str = "xml", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The attributes of the first element."""
    opened = events(docs, xml, keys).where("kind = 'open'")
    return opened.groupBy(*keys).agg(F.min_by("attrs", "event_ix").alias("attrs"))
