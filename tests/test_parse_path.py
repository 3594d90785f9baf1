"""The parse path, the gate before comparisons, and contexts of segments."""

import json


from folioforge.operators import quality, views
from folioforge.sources import documents, files
from test_hwp import compound, head, para


def contents(spark, rows):
    return spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, length long, content binary")


def test_parse_files(spark):
    rows = [
        ("a.txt", "One\n\ntwo".encode()), ("b.md", b"# Head\n\n| a | b |\n|---|---|\n| c | d |"), ("c.txt", "한글 문서".encode("cp949")), ("d.txt", b""), ("e.exe", b"x"), ("f.md", b"%PDF-1.7"),
        ("g.hwp", compound({"FileHeader": head(), "BodyText/Section0": para("글 " * 40)})), ("h.hwp", compound({"FileHeader": head(2)})), ("i.docx", b"PK\x03\x04 broken"), ("j.pdf", b"plain text"),
    ]
    parsed = documents.parse_files(contents(spark, rows))
    docs = {r["path"]: r for r in parsed.docs.collect()}
    assert {k: r["error"] for k, r in docs.items() if r["error"]} == {"d.txt": "EMPTY_FILE", "e.exe": "UNSUPPORTED_FORMAT", "f.md": "UNSUPPORTED_FORMAT", "h.hwp": "ENCRYPTED", "i.docx": "CORRUPTED"}
    assert {k: (r["format"], r["confidence"], r["n_blocks"], r["parser_version"]) for k, r in docs.items() if not r["error"]} == {"a.txt": ("txt", 1.0, 2, "txt@1"), "b.md": ("md", 1.0, 2, "md@1"), "c.txt": ("txt", 0.7, 1, "txt@1"), "g.hwp": ("hwp", 0.85, 1, "hwp@1"), "j.pdf": ("txt", 1.0, 1, "txt@1")}
    said = {(r["path"], r["code"], r["severity"]) for r in parsed.warnings.collect()}
    assert said == {("b.md", "TABLE_FLATTENED", "info"), ("c.txt", "ENCODING_GUESS", "warn"), ("g.hwp", "HWP_NO_PAGE_INFO", "info"), ("j.pdf", "PARTIAL_PARSE", "warn")}
    shot = {r["path"]: json.loads(r["json"]) for r in documents.snapshots(parsed).collect()}
    assert [b["text"] for b in shot["a.txt"]["blocks"]] == ["One", "two"] and shot["d.txt"]["error"] == "EMPTY_FILE" and len(shot) == 10
    pairs = spark.createDataFrame([(1, "a.txt", "b.md"), (2, "a.txt", "h.hwp"), (3, "d.txt", "h.hwp")], "pair_id long, left_path string, right_path string")
    assert [r["refused"] for r in documents.gate(pairs, parsed.docs).orderBy("pair_id").collect()] == [None, "ENCRYPTED", "EMPTY_FILE"]
    assert [tuple(r) for r in documents.swap(pairs).where("pair_id = 2").collect()] == [(2, "h.hwp", "a.txt")]
    assert files.parsers(spark).count() == 6


def test_gate_names_the_reason(spark):
    docs = spark.createDataFrame([("a", 0.0, None, "SCANNED_PDF"), ("b", 0.0, None, "GARBLED_TEXT"), ("c", 0.9, None, "")], "path string, confidence double, error string, warnings string")
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "c", "b"), (3, "c", "c")], "pair_id long, left_path string, right_path string")
    assert [r["refused"] for r in documents.gate(pairs, docs).orderBy("pair_id").collect()] == ["SCANNED_PDF", "GARBLED_TEXT", None]


def test_context(spark):
    rows = [(1, 0, 0, "common", "the quick brown fox ", None, None), (1, 0, 1, "divergent", None, "1", "2"), (1, 0, 2, "common", " short", None, None), (1, 0, 3, "divergent", None, "long one", "x"), (1, 1, 0, "divergent", None, "", "é"), (1, 1, 1, "common", "supercalifragilistic", None, None)]
    got = views.with_context(spark.createDataFrame(rows, "pair_id long, row_ix int, seg_ix int, kind string, text string, left_text string, right_text string")).orderBy("row_ix", "seg_ix").collect()
    assert [(r["before"], r["after"]) for r in got] == [(None, None), ("… brown fox ", " short"), (None, None), (None, None), (None, "supercalifra…"), (None, None)]


def test_fold_keeps_what_is_expanded(spark):
    kinds = ["insert"] + ["equal"] * 20 + ["delete"]
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "pair_id long, row_ix int, kind string")
    gap = views.fold(rows).where("kind = 'gap'").first()
    assert (gap["gap_from"], gap["gap_to"], gap["gap_count"], gap["run_start"]) == (4, 17, 14, 1)
    expanded = spark.createDataFrame([(1, 1)], "pair_id long, run_start long")
    assert views.fold(rows, expanded=expanded).count() == 22 == views.fold(rows, collapse=False).count() and views.fold(rows).count() == 9


def test_tagged_ratio(spark):
    pages = spark.createDataFrame([(1, p, p % 2 == 0) for p in range(40)] + [(2, 0, False)], "doc_id long, page int, tagged boolean")
    assert {r["doc_id"]: r["tagged_ratio"] for r in quality.tagged_ratio(pages).collect()} == {1: 0.5, 2: 0.0}
