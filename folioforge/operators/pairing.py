"""Changed blocks of two sides that replace each other.

Between two equal blocks lies a run of deleted and inserted blocks, each with its place in the run. Deleted blocks choose in order:
each takes the most similar inserted block (the first of equals) whose place is at most ``PAIR_WINDOW`` away, which no earlier one
took, if they are more similar than ``PAIR_ABOVE``.

Runs are dealt into buckets of ``BUCKET`` deleted blocks and the inserted ones near them. What a choice depends on is which of the
next places are taken, six bits; so a bucket maps each of 64 states to the state behind it, the maps of a run's buckets are
composed, and each bucket chooses from its own state. Only a run's maps, 64 bytes a bucket, are ever together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.batches import vectorized
from folioforge.functions.similarity import pair_counts, shared_share
from folioforge.functions.scratch import paired, stored

PAIR_ABOVE, PAIR_WINDOW = 0.5, 3
BUCKET = 128
STATES = 1 << 2 * PAIR_WINDOW
RUN = ["pair_id", "run"]

#: Candidates of a bucket's deleted blocks: place in the bucket, place of the inserted block less its own plus the window, similarity; in
#: the order of the blocks, and of each block the best first.
Wishes = list[tuple[int, int, float]]


def _choices(wishes: Wishes, state: int, size: int) -> tuple[Wishes, int]:
    """Those that are taken, from a state, and the state behind all ``size`` deleted blocks."""
    out: Wishes = []
    here, done = 0, -1
    for wish in wishes:
        at, shift, _ = wish
        state, here = state >> (at - here), at
        if done < at and not state >> shift & 1:
            state |= 1 << shift
            done = at
            out.append(wish)
    return out, state >> (size - here)


def _wishes(first: int, deleted: Sequence[tuple[int, str]], inserted: Sequence[tuple[int, str]]) -> Wishes:
    counts = {j: (text, pair_counts(text)) for j, text in inserted}
    out: Wishes = []
    for i, text in deleted:
        own, found = None, []
        for j in range(max(0, i - PAIR_WINDOW), i + PAIR_WINDOW + 1):
            if j in counts:
                own = own or pair_counts(text)
                score = 1.0 if text == counts[j][0] else shared_share(own, counts[j][1], PAIR_ABOVE)
                if score > PAIR_ABOVE:
                    found.append((i - first, j - i + PAIR_WINDOW, score))
        out += sorted(found, key=lambda c: (-c[2], c[1]))
    return out


#: Wishes as arrays of their fields, which are small in Python.
_LISTS = "at:array<int>,shift:array<int>,score:array<double>"


def _lists(wishes: Wishes) -> list[np.ndarray]:
    return [np.array([w[k] for w in wishes], kind) for k, kind in enumerate((np.int32, np.int32, np.float64))]


def pairs(changed: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """RUN, i, j and score of the pairs among changed blocks (RUN, side, place, text): places of the deleted and the inserted
    block in their run. Places count from 0 on each side."""
    near = F.explode(F.sequence(F.floor(F.greatest(F.col("place") - PAIR_WINDOW, F.lit(0)) / bucket), F.floor((F.col("place") + PAIR_WINDOW) / bucket)))
    own = changed.where("side = 0").withColumn("bucket", F.floor(F.col("place") / bucket))
    met = own.unionByName(changed.where("side = 1").withColumn("bucket", near))
    blocks = met.groupBy(*RUN, "bucket").agg(F.array_sort(F.collect_list(F.struct("side", "place", "text"))).alias("found"), F.max(F.when(F.col("side") == 0, F.col("place"))).alias("last"), F.max("side").alias("most"))

    def wish(buckets: pd.Series, i: pd.Series, deleted: pd.Series, j: pd.Series, inserted: pd.Series) -> pd.DataFrame:
        out = []
        for at, places, texts, others, theirs in zip(buckets, i, deleted, j, inserted, strict=True):
            told = _wishes(at * bucket, list(zip(places.tolist(), texts, strict=True)), list(zip(others.tolist(), theirs, strict=True)))
            ends = bytes(_choices(told, state, bucket)[1] for state in range(STATES)) if len(places) == bucket else None
            out.append((*_lists(told), ends))
        return pd.DataFrame(out, columns=["at", "shift", "score", "ends"])

    of = lambda side, field: F.transform(F.filter("found", lambda x: x["side"] == side), lambda x: x[field])
    told = vectorized(wish, f"struct<{_LISTS},ends:binary>")("bucket", *(of(side, field) for side in (0, 1) for field in ("place", "text")))
    told = blocks.where("last is not null and most = 1").select(*RUN, "bucket", told.alias("x")).select(*RUN, "bucket", "x.*")
    told = stored(told, "wishes")

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        state, last, starts = 0, -1, []
        pdf = pdf.sort_values("bucket")
        for at, ends in zip(pdf["bucket"], pdf["ends"], strict=True):
            state = state if at == last + 1 else 0  # a bucket without inserted blocks in reach takes none
            starts.append(state)
            state, last = (ends[state] if ends is not None else 0), at
        return pdf[[*RUN, "bucket"]].assign(state=starts)

    maps = told.where("ends is not null or bucket > 0").select(*RUN, "bucket", "ends")
    states = maps.groupBy(*RUN).applyInPandas(compose, "pair_id long, run long, bucket long, state int")

    def take(at: pd.Series, shift: pd.Series, score: pd.Series, states: pd.Series) -> pd.DataFrame:
        rows = zip(at, shift, score, states, strict=True)
        return pd.DataFrame([_lists(_choices(list(zip(a.tolist(), s.tolist(), v.tolist(), strict=True)), state, bucket)[0]) for a, s, v, state in rows], columns=["at", "shift", "score"])

    taken = vectorized(take, f"struct<{_LISTS}>")("at", "shift", "score", F.coalesce("state", F.lit(0)))
    rows = paired(told, states, [*RUN, "bucket"], "left").select(*RUN, "bucket", taken.alias("x"))
    rows = rows.select(*RUN, "bucket", F.explode(F.arrays_zip(*(F.col(f"x.{name}").alias(name) for name in ("at", "shift", "score")))).alias("c")).withColumn("i", (F.col("bucket") * bucket + F.col("c.at")).cast("int"))
    return rows.select(*RUN, "i", (F.col("i") + F.col("c.shift") - PAIR_WINDOW).cast("int").alias("j"), "c.score")
