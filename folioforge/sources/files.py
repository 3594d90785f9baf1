"""Files as a source: their bytes, and the format that name and content tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats by extension, groups by format, magic numbers, limits.
FORMATS = {"txt": "txt", "md": "md", "markdown": "md", "docx": "docx", "pdf": "pdf", "hwp": "hwp", "hwpx": "hwpx"}
GROUPS = {"txt": "text", "md": "text", "docx": "docx", "pdf": "pdf", "hwp": "hwp", "hwpx": "hwp"}
MAGIC = {"25504446": "pdf", "D0CF11E0": "cfb", "504B0304": "zip"}
MAX_FILE_BYTES = 30 * 1024 * 1024


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path, length, content of all files with a known extension below a folder; hidden files and folders are passed over. The
    reader gets the bound on the length, so larger files are listed, but never opened: their content is null. Spark's readers pass over files of no bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(extension(F.col("path")).isin(*FORMATS) & ~F.col("path").rlike("/\\.[^/]*"))
    fits = F.col("length") <= max_bytes
    return found.where(fits).select("path", "length", "content").unionByName(found.where(~fits).select("path", "length", F.lit(None).cast("binary").alias("content")))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, "\\.([^.]*)$", 1))


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def format_of_extension(ext: Column) -> Column:
    return _mapped(ext, FORMATS)


def group_of(fmt: Column) -> Column:
    return _mapped(fmt, GROUPS)


def zero_pattern(head: Column) -> Column:
    """Whether zero bytes stand as in UTF-16 without a mark: at every second place, of the hexadecimal first bytes."""
    units = F.regexp_extract_all(head, F.lit("[0-9A-F]{4}"), F.lit(0))
    zeros = lambda end: F.size(F.filter(units, (lambda u: u.endswith("00")) if end else (lambda u: u.startswith("00"))))
    n = F.size(units)
    return (n >= 2) & (((zeros(True) > 0.3 * n) & (zeros(False) < 0.05 * n)) | ((zeros(False) > 0.3 * n) & (zeros(True) < 0.05 * n)))


def sniff(content: Column) -> Column:
    """pdf, cfb or zip by the first bytes, else text or binary."""

    def told(head: Column) -> Column:
        zeros = F.size(F.filter(F.regexp_extract_all(head, F.lit("[0-9A-F]{2}"), F.lit(0)), lambda b: b == "00"))
        text = head.startswith("FFFE") | head.startswith("FEFF") | (zeros * 100 < F.greatest(F.length(head) / 2, F.lit(1))) | zero_pattern(head)
        return F.coalesce(_mapped(F.substring(head, 1, 8), MAGIC), F.when(text, "text").otherwise("binary"))

    return _bound(F.hex(F.substring(content, 1, 4096)), told)


def resolve(name: Column, content: Column) -> Column:
    """The format: the content's, with the name where it leaves a choice; null for binary files."""
    return _bound(F.struct(format_of_extension(extension(name)).alias("declared"), sniff(content).alias("seen")), lambda x: _chosen(x["declared"], x["seen"]))


def _chosen(declared: Column, seen: Column) -> Column:
    return (
        F.when(seen == "pdf", "pdf").when(seen == "cfb", "hwp")
        .when(seen == "zip", F.when(declared == "hwpx", "hwpx").otherwise("docx"))
        .when(seen == "text", F.when(declared == "md", "md").otherwise("txt"))
    )


def resolved(name: Column, content: Column) -> Column:
    """format, mismatch (whether the name says another one) and error: names and contents of no known format are refused."""

    def told(x: Column) -> Column:
        declared, actual = x["declared"], x["actual"]
        known = declared.isNotNull() & actual.isNotNull()
        return F.struct(F.when(known, actual).alias("format"), (known & (actual != declared)).alias("mismatch"), F.when(~known, "UNSUPPORTED_FORMAT").alias("error"))

    return _bound(F.struct(format_of_extension(extension(name)).alias("declared"), resolve(name, content).alias("actual")), told)


def size_error(length: Column) -> Column:
    return F.when(length == 0, "EMPTY_FILE").when(length > MAX_FILE_BYTES, "FILE_TOO_LARGE")


def mode_of(names: Column) -> Column:
    """What an array of file names allows: mode (empty, viewer-single, viewer-split or compare), fmt_group and cross_format of
    a comparison, and error. Names of unknown formats are refused where two are given, and so are more than two."""
    a, b = (extension(F.get(names, F.lit(i))) for i in (0, 1))
    ga, gb = group_of(format_of_extension(a)), group_of(format_of_extension(b))
    n = F.size(names)
    error = F.when(n > 2, "TOO_MANY_FILES").when((n == 2) & (ga.isNull() | gb.isNull()), "UNSUPPORTED_FORMAT")
    kind = F.when(error.isNotNull(), F.lit(None)).when(n == 0, "empty").when(n == 1, "viewer-single").when(ga != gb, "viewer-split").otherwise("compare")
    compared = kind == "compare"
    return F.struct(kind.alias("mode"), F.when(compared, ga).alias("fmt_group"), F.when(compared, a != b).alias("cross_format"), error.alias("error"))


def mode(left: Column, right: Column) -> Column:
    """What two file names allow: mode and cross_format. Either may be null."""
    told = mode_of(F.filter(F.array(left, right), lambda name: name.isNotNull()))
    return F.struct(told["mode"].alias("mode"), F.coalesce(told["cross_format"], F.lit(False)).alias("cross_format"))


def default_group(names: Column) -> Column:
    """The group whose normalisation a pair begins with: the first file's, text if that is unknown."""
    return F.coalesce(group_of(format_of_extension(extension(F.get(names, F.lit(0))))), F.lit("text"))


# The parsers by format, with the version that a change of their results raises.
PARSERS = (
    ("txt", "TXT", "txt@1", "real", "encoding by mark, zeros, UTF-8 and plausibility; paragraphs between blank lines", "", "guessed encodings lower the confidence"),
    ("md", "Markdown", "md@1", "real", "blocks by their markup, inline markup removed", "", "changes of markup alone are not seen"),
    ("docx", "DOCX", "docx@1", "real", "paragraphs and tables of the document part", "zip", "tables are one block each"),
    ("pdf", "PDF", "pdf@1", "real", "structure trees, else lines and columns of placed text", "a reader of the bytes", "columns lower the confidence; scanned and garbled files are refused"),
    ("hwpx", "HWPX", "hwpx@1", "real", "paragraphs and tables of the section parts", "zip", "no pages: places are sections"),
    ("hwp", "HWP 5.0", "hwp@1", "real", "records of the section streams of a compound file", "deflate", "locked and distributed files are refused; the preview stands in for empty sections"),
)


def parsers(spark: SparkSession) -> DataFrame:
    """The catalogue: format, label, version, status, how, needs, limits."""
    return spark.createDataFrame(list(PARSERS), "format string, label string, version string, status string, how string, needs string, limits string")
