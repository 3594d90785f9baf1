"""Files of any format into documents, blocks and warnings; comparisons that they allow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as t
from folioforge.functions.scratch import stored
from folioforge.operators import blocks as b
from folioforge.sources import decode, files, hwp, office, parse

# The severity of warnings; those not named are of severity warn.
SEVERITY = {"TABLE_FLATTENED": "info", "HWP_NO_PAGE_INFO": "info", "STRUCT_TREE_MISSING": "info", "HEADER_FOOTER_REMOVED": "info", "PAGE_BREAK_MERGED": "info", "ROTATED_TEXT": "info", "GARBLED_TEXT": "error"}
BLOCK = ["path", "block_ix", "block_id", "type", "level", "text", "raw_text", "page", "section", "char_offset"]


@dataclass
class Parsed:
    docs: DataFrame  # path, format, fmt_group, length, parser_version, confidence, n_blocks, sections, error
    blocks: DataFrame  # BLOCK
    warnings: DataFrame  # path, seq, code, severity, detail


def severity(code: Column) -> Column:
    out = F.lit("warn")
    for name, said in SEVERITY.items():
        out = F.when(code == name, said).otherwise(out)
    return out


def _columns(df: DataFrame) -> DataFrame:
    missing = {"level": "int", "page": "int", "section": "int"}
    return df.select([F.col(c) if c in df.columns else F.lit(None).cast(missing[c]).alias(c) for c in BLOCK])


def parse_files(contents: DataFrame, options: dict[str, t.Options] = t.DEFAULTS) -> Parsed:
    """Files (path, length, content): sizes are looked at before contents, formats are told by both name and content, and each
    format goes to its parser. A file that is refused is a row with an error and no blocks, and no other file fails with
    it. Decoded texts, opened files and what is said of each file are stored, so that each file is read once, whoever asks for its
    blocks, its document or its warnings. The bytes of PDF files are not read here: their placed text goes to ``operators.geometry``."""
    sized = contents.select("path", "length", "content", files.size_error(F.col("length")).alias("size_error"))
    told = sized.withColumn("r", F.when(F.col("size_error").isNull(), files.resolved(F.col("path"), F.col("content")))).select("path", "length", "content", F.col("r.format").alias("format"), F.coalesce(F.col("r.mismatch"), F.lit(False)).alias("mismatch"), F.coalesce("size_error", "r.error").alias("error"))
    fine = told.where("error is null")

    texts = fine.where(F.col("format").isin("txt", "md")).select("path", "format", "length", decode.decoded(F.col("content")).alias("d")).select("path", "format", "length", "d.text", "d.guessed")
    texts = stored(texts, "texts")
    text_blocks = parse.text_blocks(texts.select("path", "format", "length", "text"), options["text"])
    text_docs = texts.select("path", decode.confidence(F.col("guessed")).alias("confidence"), F.when(F.col("guessed"), F.array(F.lit("ENCODING_GUESS"))).otherwise(F.array().cast("array<string>")).alias("codes"), F.lit(None).cast("string").alias("parse_error"))

    zipped, drafts = office.read_office(fine.select("path", "content", "format"))
    office_blocks = b.finish_blocks(drafts, options["docx"], keys=("path",))
    office_docs = zipped.select("path", F.lit(0.95).alias("confidence"), F.col("warnings").alias("codes"), F.col("error").alias("parse_error"))

    hwp_docs, hwp_blocks = hwp.read_hwp(fine.where("format = 'hwp'").select("path", "content"), options["hwp"])
    hwp_docs = hwp_docs.select("path", "confidence", F.filter(F.split(F.coalesce("warnings", F.lit("")), ","), lambda w: w != "").alias("codes"), F.col("error").alias("parse_error"))

    blocks = _columns(text_blocks).unionByName(_columns(office_blocks)).unionByName(_columns(hwp_blocks))
    parsed = text_docs.unionByName(office_docs).unionByName(hwp_docs)
    counts = blocks.groupBy("path").agg(F.count(F.lit(1)).alias("n_blocks"), F.countDistinct("section").alias("sections"), F.max((F.col("type") == "table").cast("int")).alias("tables"))
    whole = stored(told.drop("content").join(parsed, "path", "left").join(counts, "path", "left"), "files")
    error = F.coalesce("error", "parse_error", F.when(F.col("format") == "pdf", "UNSUPPORTED_FORMAT"))
    versions = F.create_map(*[F.lit(x) for row in files.PARSERS for x in (row[0], row[2])])
    docs = whole.select("path", "format", files.group_of(F.col("format")).alias("fmt_group"), "length", F.when(F.col("confidence") <= 0.4, "hwp-prv@1").otherwise(versions[F.col("format")]).alias("parser_version"), F.when(error.isNull(), F.col("confidence")).alias("confidence"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("sections", F.lit(0)).alias("sections"), error.alias("error"))
    none = F.array().cast("array<string>")
    flattened = F.when((F.col("format") == "md") & (F.col("tables") == 1), F.array(F.lit("TABLE_FLATTENED"))).otherwise(none)
    mismatch = F.when(F.col("mismatch"), F.array(F.lit("PARTIAL_PARSE"))).otherwise(none)
    codes = F.concat(F.coalesce("codes", none), flattened, mismatch)
    rows = whole.where(error.isNull()).select("path", "format", F.posexplode(codes).alias("seq", "code"))
    warnings = rows.select("path", "seq", "code", severity(F.col("code")).alias("severity"), F.concat(F.lit("read as "), "format").alias("detail"))
    return Parsed(docs, blocks, warnings)


def snapshots(parsed: Parsed) -> DataFrame:
    """path and json of each document with its blocks and warnings, without times: a text sink's rows."""
    body = parsed.blocks.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(*BLOCK[1:]))).alias("blocks"))
    said = parsed.warnings.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("seq", "code", "severity", "detail"))).alias("warnings"))
    whole = parsed.docs.join(body, "path", "left").join(said, "path", "left")
    return whole.select("path", F.to_json(F.struct(*parsed.docs.columns, "blocks", "warnings")).alias("json"))


def gate(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (pair_id, left_path, right_path) with refused: why they can't be compared, or null. A side's error comes first,
    then a confidence of 0, for which the warning that tells the reason is named if docs has warnings; the left side's before
    the right one's."""
    warned = F.col("warnings") if "warnings" in docs.columns else F.lit("")
    reason = F.coalesce("error", F.when(F.col("confidence") == 0, F.when(F.array_contains(F.split(F.coalesce(warned, F.lit("")), ","), "SCANNED_PDF"), "SCANNED_PDF").otherwise("GARBLED_TEXT")))
    side = lambda name: docs.select(F.col("path").alias(f"{name}_path"), reason.alias(f"_{name}"))
    return pairs.join(side("left"), "left_path", "left").join(side("right"), "right_path", "left").select(*pairs.columns, F.coalesce("_left", "_right").alias("refused"))


def swap(pairs: DataFrame) -> DataFrame:
    """The pairs with their sides exchanged: every column of one side takes the name of the other's."""
    other = lambda c: f"right_{c[5:]}" if c.startswith("left_") else f"left_{c[6:]}" if c.startswith("right_") else c
    return pairs.select([F.col(c).alias(other(c)) for c in pairs.columns]).select(pairs.columns)
