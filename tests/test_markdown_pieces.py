"""Markdown that is cut into pieces against the same text read in order."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from folioforge.operators import markdown
from folioforge.operators import markdown_pieces as mp
from folioforge.sources import parse

LINES = ["", " ", "text", "more *text*", "# head", "===", "--", "---", "* * *", "- item", "  2. item", "> quote", ">", "| a | b |", "|---|---|", "```", "````", "``````", "~~~", "~~~~~", "```py", "\U0001f600 wide 中", "***"]


def made(rng):
    lines = [rng.choice(LINES) for _ in range(rng.randrange(14))]
    return "".join(line + rng.choice(["\n", "\n", "\r\n", "\r"]) for line in lines) + rng.choice(["", "end", "```", "|"])


def in_pieces(text, span, fan):
    pieces = list(mp.cut(text, span))
    assert "".join(p for _, p in pieces) == text
    maps = [mp.state_map(p) for _, p in pieces]
    runs = [maps[k : k + fan] for k in range(0, len(maps), fan)]
    began = list(accumulate(map(mp.composed, runs), mp.applied, initial=("", 0)))
    places = [at for run, start in zip(runs, began) for at in list(accumulate(run, mp.applied, initial=start))[:-1]]
    out = {}
    for (units, piece), (state, first) in zip(pieces, places, strict=True):
        for part in mp.parts(piece, state):
            block = out.setdefault(first + part["nth"], {"lines": []})
            if part["starts"]:
                block.update(type=part["type"], level=part["level"], char_offset=units + part["units"])
            elif part["type"]:
                block.update(type=part["type"], level=part["level"])
            block["lines"] += [part["text"]] if part["n_lines"] else []
    return [{"type": b["type"], "level": b["level"], "raw_text": "\n".join(b["lines"]), "char_offset": b["char_offset"]} for _, b in sorted(out.items())]


def test_random_files():
    rng = random.Random(1)
    for _ in range(10_000):
        text = made(rng)
        assert in_pieces(text, rng.choice([1, 2, 9, 30]), rng.choice([1, 2, 3])) == list(markdown.placed(text)), text


def test_map_of_open_code():
    told = mp.state_map("x\n```\ny\n``\n`````\n~~~\n````\n")
    # Open ``` ends at the second line. Then y starts a paragraph, and ````` starts code that stays open.
    assert told["```"] == ("`````", 2)
    assert mp.applied(("``````", 4), told) == ("``````", 4)


def test_rows(spark):
    rng = random.Random(2)
    rows = [(k if k % 5 else None, f"n{k % 3}", made(rng) + made(rng), k) for k in range(300)]
    rows += rows[:20] + [(1, None, None, 0), (2, "x", "", 0), (3, "x", "\n \n", 0), (3, "x", "```\n" + "line\n" * 500 + "\n# no", 0), (3, "x", "long " * 2000 + "\n===\n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, name string, text string, _piece long").repartition(3)
    columns = ["doc_id", "name", "draft_ix", "type", "level", "raw_text", "char_offset"]
    want = markdown.blocks(docs, keys=("doc_id", "name")).select(columns)
    got = mp.long_blocks(docs, keys=("doc_id", "name"), span=16, fan=4)
    assert got.columns == columns and got.dtypes == want.dtypes
    told = sorted(map(tuple, got.collect()), key=repr)
    assert told and told == sorted(map(tuple, want.collect()), key=repr)


def test_empty_table(spark):
    assert mp.long_blocks(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


@pytest.mark.parametrize("sized", [True, False])
def test_parse_path(spark, sized):
    """Files beyond the bound go by pieces, and have the same blocks."""
    rng = random.Random(3)
    rows = [(f"{k}.md", "md", "".join(made(rng) for _ in range(1 + 40 * (k % 2)))) for k in range(20)]
    texts = spark.createDataFrame(rows, "path string, format string, text string")
    if sized:
        texts = texts.withColumn("length", F.octet_length("text").cast("long"))
    told = [sorted(map(tuple, parse.text_blocks(texts, long_bytes=n).collect())) for n in (600, 1 << 40)]
    assert told[0] and told[0] == told[1]
