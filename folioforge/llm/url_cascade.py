"""URL filters by cascades of Bloom filters.

A rule is a host and the beginning of a path; it fits that host and its subdomains. A url's candidate
keys are the ends of its host (at label borders) joined to beginnings of its path, for the numbers of
labels and path lengths that the rules have. Such a key is a rule exactly if it is listed.

The listed keys of each verdict are encoded in a cascade: level 1 is a Bloom filter of the listed keys,
level 2 one of those keys of the corpus that pass level 1 wrongly, level 3 one of the listed keys that
pass level 2, and so on until a level lets nothing wrong pass. Over the keys of the corpus, all of which
were tried in the building, membership is then exact: a key is listed if the first level that refuses
it has an even number. Urls are judged with these filters alone, without joins.

With n listed keys and u keys in the corpus, level 1 has about 1.44 n log2(u / n) bits and the others
together a few bits for each listed key. What a plan carries is bounded by about ``max_bits`` for each level: longer lists
are dealt by a hash of their keys into parts, each with cascades and a pass of its own, in which a url's
candidate keys of that part are tried; between passes the pages are written with their best rule so far.
The cascades of all verdicts are built from one pass over the corpus's keys.

Null or malformed urls have an empty host and path and fit nothing. An empty rule list allows all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import ascii_lower, delete, written

MAX_BITS = 1 << 24


@dataclass(frozen=True)
class Rule:
    verdict: str  # block or allow
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: str  # 64-bit words in decimal, comma-separated: one string literal in the plan


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.coalesce(ascii_lower(after), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))
    return F.coalesce(after, F.lit(""))


def candidate_keys(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The keys of a url that a rule of such a shape could list, longest first."""
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules}, reverse=True)
    if not shapes:
        return F.array().cast("array<string>")
    labels = F.split(host, r"\.", -1)

    def key(depth: int, length: int) -> Column:
        start = F.size(labels) - depth + 1
        tail = F.array_join(F.slice(labels, F.greatest(start, F.lit(1)), depth), ".")
        return F.when((start >= 1) & (F.length(path) >= length) & (host != ""), F.concat(tail, F.substring(path, 1, length)))

    made = F.filter(F.array(*[key(*s) for s in shapes]), lambda k: k.isNotNull())
    return F.array_sort(F.array_distinct(made), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a > b, -1).when(a < b, 1).otherwise(0))


def _places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """The bits of a key: double hashing with a seed for each level."""
    h = F.xxhash64(F.lit(level), key)
    a, b = F.pmod(h, F.lit(2147483647)), F.pmod(F.shiftright(h, 31), F.lit(2147483629)) + 1
    return [F.pmod(a + b * i, F.lit(bits)) for i in range(hashes)]


def first_rate(n: int, universe: int) -> float:
    """The rate of false positives of level 1 for n listed keys: about as many keys pass wrongly as are listed."""
    return max(min(0.5, n * math.sqrt(0.5) / (max(universe, 2 * n) - n)), 2.0**-30)


def level_bits(n: int, rate: float) -> int:
    return max(64, 64 * math.ceil(max(1, n) * 1.44 * math.log2(1 / rate) / 64))


def build_level(keys: DataFrame, level: int, n: int, rate: float) -> Level:
    """A Bloom filter of the column ``key``, for n keys and a rate of false positives. Its words are gathered to
    become a literal."""
    bits = level_bits(n, rate)
    hashes = max(1, round(bits / max(1, n) * math.log(2))) if n else 1
    hashes = min(hashes, 24)
    set_bits = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits, hashes))).alias("p"))
    words = {r["w"]: r["b"] for r in set_bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("b")).collect()}
    return Level(bits, hashes, ",".join(str(words.get(i, 0)) for i in range(bits // 64)))


def passes(key: Column, level: int, built: Level) -> Column:
    words = F.split(F.lit(built.words), ",").cast("array<bigint>")  # folded to one literal
    test = F.lit(True)
    for p in _places(key, level, built.bits, built.hashes):
        test = test & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
    return test


def build_cascades(universe: DataFrame, listed: DataFrame, n_universe: int) -> dict[str, list[Level]]:
    """The levels for the listed keys (column ``key``) of each name (column ``v``) over all keys of the universe (column
    ``key``, repeats allowed; about ``n_universe`` different ones)."""
    listed = listed.select("key", "v").distinct()
    sizes = {r["v"]: r["n"] for r in listed.groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()}
    levels = {v: [build_level(listed.where(F.col("v") == v), 1, n, first_rate(n, n_universe))] for v, n in sorted(sizes.items())}
    if not levels:
        return {}
    # Of the universe only what passes a level 1 is shuffled: wrong passes, about as many as there are listed keys, and the listed.
    passed = F.array_compact(F.array(*[F.when(passes(F.col("key"), 1, built[0]), v) for v, built in levels.items()]))
    tagged = universe.select("key", F.explode(passed).alias("v"), F.lit(0).alias("is_listed")).unionByName(listed.select("key", "v", F.lit(1).alias("is_listed")))
    wrong, path = written(tagged.groupBy("key", "v").agg(F.max("is_listed").alias("m")).where(F.col("m") == 0).select("key", "v"), "cascade")
    for v, built in levels.items():
        inside, outside = listed.where(F.col("v") == v), wrong.where(F.col("v") == v)
        while n_wrong := outside.count():  # halves from level to level
            built.append(build_level(outside, len(built) + 1, n_wrong, 0.5))
            inside, outside = outside, inside.where(passes(F.col("key"), len(built), built[-1]))
    delete(universe.sparkSession, path)
    return levels


def is_listed(key: Column, levels: Sequence[Level]) -> Column:
    """The first level that refuses the key decides: an even one, or none after an odd last one, says listed."""
    said = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels), 0, -1):
        said = F.when(~passes(key, number, levels[number - 1]), F.lit(number % 2 == 0)).otherwise(said)
    return said


def _first_listed(levels: Sequence[Level], of_part: Callable[[Column], Column]) -> Column:
    return F.get(F.filter("_keys", lambda k: of_part(k) & is_listed(k, levels)), F.lit(0))


_HIT = "struct<n:int,b:boolean,rule:string,verdict:string>"


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", otherwise: str = "allow", max_bits: int = MAX_BITS) -> DataFrame:
    """The pages with host, path, rule (the longest that fits, else null) and verdict. Where a key has both
    verdicts, block holds. The four columns replace any of those names; columns _keys, _hit and _firsts don't return."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "_keys", "_hit", "_firsts")]
    cut = pages.select(*kept, host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    judged = cut.withColumns({"_keys": candidate_keys(F.col("host"), F.col("path"), rules), "_hit": F.lit(None).cast(_HIT)})
    verdict_of = {r.key: r.verdict for r in sorted(rules, key=lambda r: r.verdict == "block")}  # block last, so it overrides
    if verdict_of:
        spark = pages.sparkSession
        listed = spark.createDataFrame(sorted(verdict_of.items()), "key string, v string")
        keys = lambda df: df.select(F.explode("_keys").alias("key"))
        n_universe = keys(judged).agg(F.approx_count_distinct("key").alias("u")).first()["u"]
        parts = -(-level_bits(len(verdict_of), first_rate(len(verdict_of), n_universe)) // max(64, max_bits))
        before = None
        for part in range(parts):
            of_part = lambda k, part=part: (F.pmod(F.xxhash64(k), F.lit(parts)) == part) if parts > 1 else F.lit(True)
            cascades = build_cascades(keys(judged).where(of_part(F.col("key"))), listed.where(of_part(F.col("key"))), n_universe // parts)
            first = [F.col("_firsts")[i] for i in range(len(cascades))]
            # The longest key wins: of (length, block before allow) the largest.
            hits = [F.when(k.isNotNull(), F.struct(F.length(k).alias("n"), F.lit(v == "block").alias("b"), k.alias("rule"), F.lit(v).alias("verdict"))) for k, v in zip(first, cascades, strict=True)]
            if hits:
                firsts = F.array(*[_first_listed(levels, of_part) for levels in cascades.values()])
                judged = judged.withColumn("_firsts", firsts).withColumn("_hit", F.array_max(F.array("_hit", *hits))).drop("_firsts")
            if part + 1 < parts:
                judged, path = written(judged, "url-pass")
                if before:
                    delete(spark, before)
                before = path
    return judged.select(*kept, "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", F.lit(otherwise)).alias("verdict"))
