"""Similarity of short texts by pairs of UTF-16 units."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.batches import vectorized


def pair_counts(text: str) -> Counter:
    """How often each pair of UTF-16 units occurs."""
    u = text.encode("utf-16-le", "surrogatepass")
    return Counter(u[i : i + 4] for i in range(0, len(u) - 2, 2))


def shared_share(a: Counter, b: Counter, above: float = -1.0) -> float:
    """Twice the pairs in common among all pairs; 0 if one side has none, or if the numbers alone tell that it isn't above."""
    x, y = a.total(), b.total()
    if not x or not y or 2 * min(x, y) / (x + y) <= above:
        return 0.0
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    return 2 * sum(min(n, many[g]) for g, n in few.items() if g in many) / (x + y)


def coefficient(a: str, b: str) -> float:
    """Dice coefficient over multisets of pairs of UTF-16 units: 1 if equal, 0 if one has no pair."""
    return 1.0 if a == b else shared_share(pair_counts(a), pair_counts(b))


def _dice(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else coefficient(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def dice_of(left: Column, right: Column) -> Column:
    return vectorized(_dice, "double")(left, right)


def dice(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """The pairs' keys with their Dice coefficient; both texts of a pair are in one row, so nothing is shuffled."""
    return pairs.select(*keys, dice_of(F.col(left), F.col(right)).alias("dice"))


def candidates(deleted: DataFrame, inserted: DataFrame, keys: list[str], window: int = 3) -> DataFrame:
    """Changed blocks that may be paired, with their Dice coefficient: keys, i, j of deleted (keys, i, text) and inserted (keys, j,
    text) blocks of one run whose places differ by the window at most."""
    d, n = deleted.withColumnRenamed("text", "left"), inserted.withColumnRenamed("text", "right")
    near = d.join(n, keys).where(F.abs(F.col("i") - F.col("j")) <= window)
    return near.select(*keys, "i", "j", dice_of(F.col("left"), F.col("right")).alias("dice"))
