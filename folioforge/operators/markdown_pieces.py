"""Long Markdown files, cut into pieces that are read in different tasks.

What a line is depends on the block that is open before it, so a piece alone can't be read. But what it does to any such state can
be told: a piece's map gives, for each state it may begin in, the state after it and the number of blocks that start in it. Maps
compose, in two steps (``FAN`` pieces at a time), to the state and the number of the first block of each piece; then each piece is
read once more. Parts of a block that runs over several pieces are joined in the end.

Open code has as many states as there are lengths of its marks. It goes on until the first line of as many marks or more, so
a map names only the lines that have more marks than any line before them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.batches import vectorized
from folioforge.operators.markdown import FENCE, FENCES, lines_of, parse, step, u16_units

#: Characters of a piece, apart from the rest of its last line.
SPAN = 1 << 18
#: Maps that are composed in one row. A text of 2 GB, the most a row can hold, has 8192 pieces: 32 rows of them.
FAN = 256
#: States that a piece may begin in besides open code.
PLAIN = ("", "paragraph", "quote", "listItem", "table")
#: Lines that start no block.
WITHIN = ("add", "end", "title", "skip")
BREAK = re.compile(r"\r\n?|\n")

CUT = "array<struct<units long, text string>>"
PLACES = "array<struct<state string, first long>>"
PARTS = "array<struct<nth long, starts boolean, type string, level int, text string, n_lines int, units long>>"

Map = dict[str, tuple[str, int]]  # state before (for code, the marks that end it): state after, blocks that start


def cut(text: str, span: int = SPAN) -> Iterator[tuple[int, str]]:
    """(place in UTF-16 units, piece): whole lines, of ``span`` characters or more."""
    at = units = 0
    while at < len(text):
        end = BREAK.search(text, at + span - 1)
        stop = end.end() if end else len(text)
        yield units, text[at:stop]
        units, at = units + u16_units(text[at:stop]), stop


class _Runs:
    """What has become of the states that a piece may begin in. Those that have come to one state go on as one."""

    def __init__(self) -> None:
        self.at: dict[str, list] = {}  # state: [blocks started, {state before: blocks started less these}]

    def add(self, state: str, n: int, members: dict[str, int]) -> None:
        into = self.at.setdefault(state, [n, {}])
        into[1].update({start: more + n - into[0] for start, more in members.items()})

    def line(self, line: str) -> None:
        before, self.at = self.at, {}
        for state, (n, members) in before.items():
            after, does, _, _ = step(line, state, str)
            self.add(after, n + (does not in WITHIN), members)

    def ends(self) -> Map:
        return {start: (state, n + more) for state, (n, members) in self.at.items() for start, more in members.items()}


def state_map(piece: str) -> Map:
    runs, most = _Runs(), dict.fromkeys(FENCES, 0)
    for state in PLAIN:
        runs.add(state, 0, {state: 0})
    for _, line in lines_of(piece):
        runs.line(line)
        if (found := FENCE.match(line)) and len(found[1]) > most[found[1][0]]:
            most[found[1][0]] = len(found[1])
            runs.add("", 0, {found[1]: 0})
    return runs.ends()


def applied(at: tuple[str, int], told: Map) -> tuple[str, int]:
    state, n = at
    if state[:1] in FENCES:
        closing = min((s for s in told if s[:1] == state[0] and len(s) >= len(state)), key=len, default=None)
        if closing is None:
            return at
        state = closing
    after, more = told[state]
    return after, n + more


def composed(maps: list[Map]) -> Map:
    out: Map = {}
    for state in PLAIN:
        out[state] = reduce(applied, maps, (state, 0))
    most = dict.fromkeys(FENCES, 0)
    for k, told in enumerate(maps):
        for marks in sorted((s for s in told if s[:1] in FENCES), key=len):
            if len(marks) > most[marks[0]]:
                most[marks[0]] = len(marks)
                out[marks] = reduce(applied, maps[k + 1 :], told[marks])
    return out


def parts(piece: str, state: str) -> Iterator[dict]:
    """The blocks and parts of blocks of a piece; ``nth`` counts those that start, from 0, and is -1 for the one before."""
    nth, at, units = -1, 0, 0
    for block in parse(piece, state):
        units, at = units + u16_units(piece[at : block.place]), block.place
        nth += block.starts
        yield {"nth": nth, "starts": block.starts, "type": block.type, "level": block.level, "text": "\n".join(block.lines), "n_lines": len(block.lines), "units": units}


def _maps(run: Iterable[str]) -> list[Map]:
    return [json.loads(told) for told in run]


def _map_of(pieces: pd.Series) -> pd.Series:
    return pieces.map(lambda p: json.dumps(state_map(p)))


def _composed(runs: pd.Series) -> pd.Series:
    return runs.map(lambda r: json.dumps(composed(_maps(r))))


def _places(runs: pd.Series, states: pd.Series, firsts: pd.Series) -> pd.Series:
    """What holds before each map of a run."""
    told = [list(accumulate(_maps(run), applied, initial=(state, first)))[:-1] for run, state, first in zip(runs, states, firsts, strict=True)]
    return pd.Series([[{"state": s, "first": n} for s, n in one] for one in told])


def _parts(pieces: pd.Series, states: pd.Series) -> pd.Series:
    return pd.Series([list(parts(p, s)) for p, s in zip(pieces, states, strict=True)])


def long_blocks(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), span: int = SPAN, fan: int = FAN) -> DataFrame:
    """The rows of ``markdown.blocks`` for texts of any length. Rows of equal keys and texts are read once, and each
    has its blocks; null and empty texts have none. Keys may be null; other columns are left out.

    Cutting takes one row; all else is spread over a text's pieces. Texts are shuffled twice: to spread pieces, and to join the
    parts of blocks. A block that is a whole file is still one row."""

    def cut_all(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"units": u, "text": p} for u, p in cut(t, span)])

    map_of, compose, places, read = (vectorized(f, schema) for f, schema in ((_map_of, "string"), (_composed, "string"), (_places, PLACES), (_parts, PARTS)))
    named = F.struct(*[F.col(k) for k in keys])
    told = docs.where(F.col(text) != "").select(named.alias("_keys"), F.sha2(F.concat(F.to_json(named), F.lit("\n"), F.col(text)), 256).alias("_id"), F.col(text).alias("_text"))
    cuts = told.select("_keys", "_id", F.posexplode(vectorized(cut_all, CUT)("_text")).alias("_piece", "_x"))
    # Pieces are few bytes but much work, so their number of tasks is fixed: adaptive execution would make few tasks of them.
    spark = docs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = cuts.repartition(tasks, "_id", "_piece").groupBy("_id", "_piece").agg(F.first("_keys").alias("_keys"), F.first("_x.units").alias("_at"), F.first("_x.text").alias("_text"), F.count(F.lit(1)).alias("_copies"))

    maps = pieces.select("_id", "_piece", F.floor(F.col("_piece") / fan).alias("_run"), map_of("_text").alias("_map"))
    runs = maps.groupBy("_id", "_run").agg(F.array_sort(F.collect_list(F.struct("_piece", "_map"))).alias("_m"))
    wholes = runs.select("_id", "_run", compose("_m._map").alias("_map")).groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_run", "_map"))).alias("_m"))
    began = wholes.select("_id", F.explode(F.arrays_zip(F.col("_m._run").alias("_run"), places("_m._map", F.lit(""), F.lit(0).cast("long")).alias("_p"))).alias("_x")).select("_id", "_x._run", "_x._p.state", "_x._p.first")
    each = runs.join(began, ["_id", "_run"]).select("_id", F.explode(F.arrays_zip(F.col("_m._piece").alias("_piece"), places("_m._map", "state", "first").alias("_p"))).alias("_x"))
    begun = each.select("_id", "_x._piece", F.col("_x._p.state").alias("_state"), F.col("_x._p.first").alias("_first"))

    found = pieces.join(begun, ["_id", "_piece"]).select("_id", "_keys", "_copies", "_piece", "_at", "_first", F.explode(read("_text", "_state")).alias("b"))
    first_or_title = lambda name: F.coalesce(F.max(F.when(~F.col("b.starts"), F.col(f"b.{name}"))), F.max(F.when(F.col("b.starts"), F.col(f"b.{name}"))))
    body = F.array_join(F.array_sort(F.collect_list(F.when(F.col("b.n_lines") > 0, F.struct("_piece", "b.text"))))["text"], "\n")
    joined = found.groupBy("_id", (F.col("_first") + F.col("b.nth")).cast("int").alias("draft_ix")).agg(
        F.first("_keys").alias("_keys"), F.first("_copies").alias("_copies"), first_or_title("type").alias("type"), first_or_title("level").alias("level"),
        body.alias("raw_text"), F.max(F.when(F.col("b.starts"), F.col("_at") + F.col("b.units"))).alias("char_offset"),
    )
    each_copy = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return each_copy.select(*[F.col("_keys")[k].alias(k) for k in keys], "draft_ix", "type", "level", "raw_text", "char_offset")
