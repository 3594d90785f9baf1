"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased; everything but letters and marks becomes one space. For each language an
interpolated Kneser-Ney model of order ``ORDER`` is made from labelled rows. The models share sorted
arrays of n-gram hashes, one for each order, with a row of log probabilities (a column per language) for
each n-gram, interpolated already, and one of back-off weights for each context. A text gets the language
of the lowest cross-entropy per character.

The labelled rows are a bounded sample: of each language the different texts of the smallest hashes, up to
``sample_chars`` characters and ``LEAST_TEXTS`` texts at least; copies of a text count once. Their n-grams are counted by
Spark, all of them. A model has a value for each n-gram and language; where these would be more than ``model_values``,
the sample is halved until they are not, so that what goes to the driver and is broadcast is bounded.

Rejection is calibrated on every fifth text of the sample, which is not counted (of languages with fewer than
``LEAST_TEXTS`` texts all are counted). By how much a text's cross-entropy exceeds its language's mean is compared with the
``KEEP`` quantile of that excess among texts of about its length, of all languages together, since shorter texts vary more;
beyond ``SLACK`` times that and ``MARGIN`` nats it is rejected. A language without such texts takes the mean of the others.

Null texts and texts without letters are ``und`` with score 0, and rejected. Without labelled rows all
texts are. Rows may repeat; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.llm.common import bounded_batches, delete, written

ORDER = 4
SAMPLE_CHARS, LEAST_TEXTS = 2_000_000, 10
MODEL_VALUES = 16_000_000
SLICE_CHARS = 1 << 18
UNKNOWN = "und"
KEEP, SLACK, MARGIN = 0.999, 1.25, 0.5
#: Lengths by powers of two, in letters.
BINS = 20
_STEP = np.random.Generator(np.random.PCG64(90210)).integers(0, 2**63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RADIX = 20

_folding: np.ndarray | None = None


def folding() -> np.ndarray:
    """code point -> lower-cased letter, or the space."""
    global _folding
    if _folding is None:
        out = np.full(0x110000, 32, np.uint32)
        for code in (*range(0xD800), *range(0xE000, 0x110000)):
            c = chr(code)
            if c.isalpha() or unicodedata.category(c)[0] == "M":
                low = c.lower()
                out[code] = ord(low) if len(low) == 1 else code
        _folding = out
    return _folding


_letters: np.ndarray | None = None


def letters_of(codes: np.ndarray) -> np.ndarray:
    """1 for each code point that is a letter; marks are part of the texts, but no letters."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(code).isalpha() for code in range(0x110000)])
    return _letters[codes].astype(np.int64)


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, each with ORDER - 1 spaces before and one after, runs of spaces joined inside; and
    the offsets of the texts."""
    lead = " " * (ORDER - 1)
    joined = "".join(lead + (t or "") + " " for t in texts)
    sizes = np.array([ORDER + len(t or "") for t in texts])
    ends = np.cumsum(sizes)
    codes = folding()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    starts = ends - sizes
    for k in range(ORDER):
        keep[starts + k] = True
    # The text's own leading blanks join the lead.
    first = starts + ORDER - 1
    keep[first] = codes[first] != 32
    kept = np.concatenate(([0], np.cumsum(keep)))
    return codes[keep], kept[np.concatenate(([0], ends))]


def gram_keys(codes: np.ndarray) -> list[np.ndarray]:
    """For orders 0 to ORDER the hash of the characters that end at each place (of fewer at the beginning)."""
    total, out = np.zeros(len(codes), np.uint64), []
    wide = codes.astype(np.uint64)
    for k in range(ORDER + 1):
        h = total ^ (total >> np.uint64(31))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        out.append(h * np.uint64(0x94D049BB133111EB))
        if k < ORDER:
            total = total.copy()
            total[k:] += (wide[: len(wide) - k] + np.uint64(1)) * _STEP[k]
    return out


@dataclass
class Table:
    """Sorted hashes with a row of values each, and where each leading ``_RADIX`` bits begin."""

    keys: np.ndarray
    values: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys)
        keys, values = keys[order], np.ascontiguousarray(values[order], np.float32)
        begin = np.searchsorted(keys, np.arange(1 << _RADIX, dtype=np.uint64) << np.uint64(64 - _RADIX)).astype(np.int32)
        return cls(keys, values, np.append(begin, np.int32(len(keys))))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Rows of the wanted hashes, -1 for those that are not there."""
        out = np.full(len(wanted), -1, np.int32)
        if not len(self.keys):
            return out
        top = (wanted >> np.uint64(64 - _RADIX)).astype(np.int32)
        place, end = self.begin[top], self.begin[top + 1]
        todo = np.flatnonzero(place < end)
        while len(todo):
            p = place[todo]
            same = self.keys[p] == wanted[todo]
            out[todo[same]] = p[same]
            todo = todo[~same & (p + 1 < end[todo])]
            place[todo] += 1
        return out


def length_bin(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), BINS - 1)


@dataclass
class Model:
    languages: list[str]
    grams: list[Table]  # by order, from 1: log probabilities
    contexts: list[Table]  # by order, from 1: log back-off weights of the contexts of order - 1 characters
    unseen: np.ndarray  # log of the share of a character that no language has, before the back-off weight
    mean: np.ndarray  # cross-entropy of each language's own texts
    excess: np.ndarray  # by length: what may be above it

    def bound(self, language: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The cross-entropy above which a text of a language is rejected."""
        return self.mean[language] + SLACK * self.excess[length_bin(letters)] + MARGIN

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text in each language, and the number of its letters."""
        out, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= SLICE_CHARS):
                size += len(texts[upto] or "")
                upto += 1
            codes, offsets = folded(texts[at:upto])
            sums, n = self._sums(codes, offsets)
            letters[at:upto] = np.add.reduceat(letters_of(codes), offsets[:-1])
            out[at:upto] = -sums / np.maximum(n, 1)[:, None]
            at = upto
        return out, letters

    def _sums(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = gram_keys(codes)
        value = np.empty((len(codes), len(self.languages)), np.float32)
        todo = np.arange(len(codes))
        carried = np.zeros((0, len(self.languages)), np.float32)
        for k in range(ORDER, 0, -1):
            row = self.grams[k - 1].find(keys[k][todo])
            hit = row >= 0
            found = self.grams[k - 1].values[row[hit]]
            value[todo[hit]] = found if k == ORDER else found + carried[hit]
            if hit.all():
                todo = todo[:0]
                break
            missing = todo[~hit]
            row = self.contexts[k - 1].find(keys[k - 1][np.maximum(missing - 1, 0)])
            weight = np.where(row[:, None] >= 0, self.contexts[k - 1].values[row] if len(self.contexts[k - 1].values) else np.float32(0), np.float32(0))
            carried = weight if k == ORDER else carried[~hit] + weight
            todo = missing
        if len(todo):
            value[todo] = self.unseen + carried
        lead = offsets[:-1, None] + np.arange(ORDER - 1)
        value[lead.ravel()] = 0
        return np.add.reduceat(value.astype(np.float64), offsets[:-1], axis=0), np.diff(offsets) - (ORDER - 1)


def _discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one and two else 0.5


def _codes_of(grams: list[str]) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(grams), -1)


def _key_of(codes: np.ndarray) -> np.ndarray:
    """The hash of each row's characters."""
    width = codes.shape[1]
    return gram_keys(codes.ravel())[width][width - 1 :: width] if width else gram_keys(np.zeros(len(codes), np.uint32))[0]


def estimate(counts: pd.DataFrame, languages: list[str]) -> Model:
    """The models from the counts of n-grams of the highest order: columns lang, gram, c."""
    n, no = len(languages), {lang: i for i, lang in enumerate(languages)}
    level = counts
    by_order = {}
    for k in range(ORDER, 0, -1):
        by_order[k] = level
        # The lower orders count how many different characters stand before.
        level = level.assign(gram=level["gram"].str.slice(1)).groupby(["lang", "gram"], sort=False, as_index=False).agg(c=("c", "size")) if k > 1 else level
    grams, contexts = [], []
    below, below_keys = None, None
    alphabet = by_order[1]["gram"].nunique()
    unseen = np.zeros(n)
    for k in range(1, ORDER + 1):
        rows = by_order[k]
        names, which = np.unique(rows["gram"].to_numpy(dtype=object), return_inverse=True)
        table = np.zeros((len(names), n))
        table[which, rows["lang"].map(no).to_numpy()] = rows["c"].to_numpy()
        codes = _codes_of(list(names))
        _, context = np.unique(_key_of(codes[:, :-1]), return_inverse=True)
        total, types = np.zeros((context.max() + 1, n)), np.zeros((context.max() + 1, n))
        np.add.at(total, context, table)
        np.add.at(types, context, table > 0)
        d = np.array([_discount(table[:, j][table[:, j] > 0]) for j in range(n)])
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(total > 0, d * types / total, 1.0)
            own = np.where(total[context] > 0, np.maximum(table - d, 0) / total[context], 0.0)
        if k == 1:
            lower = np.full((len(names), n), 1.0 / (alphabet + 1))
            unseen = np.full(n, -np.log(alphabet + 1))
        else:
            lower = below[np.searchsorted(below_keys, _key_of(codes[:, 1:]))]
        p = own + weight[context] * lower
        keys = _key_of(codes)
        grams.append(Table.of(keys, np.log(p)))
        first = np.unique(context, return_index=True)[1]
        contexts.append(Table.of(_key_of(codes[first, :-1]), np.log(weight)))
        order = np.argsort(keys)
        below, below_keys = p[order], keys[order]
    return Model(languages, grams, contexts, unseen, np.full(n, np.inf), np.zeros(BINS))


def _ngrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, gram and how often it ends in a batch's texts."""
    for pdf in batches:
        for lang, part in pdf.groupby("lang"):
            texts = part["text"].tolist()
            for at in range(0, len(texts), 64):
                codes, offsets = folded(texts[at : at + 64])
                windows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)
                ends = np.ones(len(codes), bool)
                ends[(offsets[:-1, None] + np.arange(ORDER - 1)).ravel()] = False
                grams, c = np.unique(windows[ends[ORDER - 1 :]].copy().view(f"V{4 * ORDER}").ravel(), return_counts=True)
                text = np.frombuffer(grams.tobytes(), np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
                yield pd.DataFrame({"lang": lang, "gram": [text[i : i + ORDER] for i in range(0, len(text), ORDER)], "c": c})


#: The share of texts below the k-th level is 2 ** (-k / STEPS).
LEVELS, STEPS = 160, 4


def sampled(labelled: DataFrame, sample_chars: int) -> DataFrame | None:
    """lang, text and held: the different texts of the smallest hashes, written to the shared folder; None if there are none."""
    spark = labelled.sparkSession
    rows = labelled.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text", F.lit(11)).alias("h"))
    unit = lambda h: (F.shiftright(h, 11) + F.lit(float(1 << 52))) / float(1 << 53)  # noqa: E731  to [0, 1)
    # Hashes and lengths alone are shuffled to tell copies; then a few rows for each language are left.
    texts = rows.groupBy("lang", "h").agg(F.max(F.length("text")).alias("n"))
    level = F.least(F.floor(-F.log2(F.greatest(unit(F.col("h")), F.lit(2.0**-60))) * STEPS), F.lit(LEVELS)).cast("int")
    found: dict[str, dict[int, tuple[int, int]]] = {}
    for r in texts.groupBy("lang", level.alias("level")).agg(F.sum("n").alias("chars"), F.count(F.lit(1)).alias("texts")).collect():
        found.setdefault(r["lang"], {})[r["level"]] = (r["chars"], r["texts"])
    if not found:
        return None
    shares = []
    for lang, levels in found.items():
        chars = texts_in = 0
        least = LEVELS
        for k in sorted(levels, reverse=True):  # the smallest hashes first
            more, n = levels[k]
            if texts_in >= LEAST_TEXTS and chars + more > sample_chars:
                break
            chars, texts_in, least = chars + more, texts_in + n, k
        shares.append((lang, least))
    chosen = rows.join(F.broadcast(spark.createDataFrame(shares, "l string, least int")), F.col("lang") == F.col("l")).where(level >= F.col("least"))
    once = chosen.groupBy("lang", "h").agg(F.first("text").alias("text"))
    place, n = F.row_number().over(Window.partitionBy("lang").orderBy("h")), F.count(F.lit(1)).over(Window.partitionBy("lang"))
    return written(once.select("lang", "text", ((n >= LEAST_TEXTS) & (place % 5 == 0)).alias("held")), "language-sample")[0]


def train(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS, model_values: int = MODEL_VALUES) -> Model | None:
    """A model from the columns text and lang; None without labelled rows."""
    spark = labelled.sparkSession
    bounded_batches(spark)
    while True:
        sample = sampled(labelled, sample_chars)
        if sample is None:
            return None
        counted, counted_at = written(sample.where("not held").select("lang", "text").mapInPandas(_ngrams, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c")), "ngrams")
        size = counted.agg(F.countDistinct("gram").alias("g"), F.countDistinct("lang").alias("l")).first()
        if size["g"] * size["l"] <= model_values or sample_chars < 1000:
            break
        sample_chars //= 2
        delete(spark, counted_at)
    counts = counted.toPandas()
    delete(spark, counted_at)
    if not len(counts):
        return None
    model = estimate(counts.sort_values(["lang", "gram"]), sorted(set(counts["lang"])))
    calibrate(model, sample.where("held").select("lang", "text"))
    return model


def calibrate(model: Model, held: DataFrame) -> None:
    """Sets the mean of each language and the excess by length from labelled texts that were not counted."""
    spark = held.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def entropies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            e, letters = shared.value.entropies(pdf["text"].tolist())
            own = pdf["lang"].map({lang: i for i, lang in enumerate(shared.value.languages)}).fillna(-1).astype(int).to_numpy()
            keep = (own >= 0) & (letters > 0)
            yield pd.DataFrame({"lang": pdf["lang"][keep], "e": e[np.arange(len(e)), own][keep], "n": letters[keep], "bin": length_bin(letters[keep])})

    told, at = written(held.mapInPandas(entropies, "lang string, e double, n long, bin long"), "held-entropies")
    means = {r["lang"]: r["m"] for r in told.groupBy("lang").agg((F.sum(F.col("e") * F.col("n")) / F.sum("n")).alias("m")).collect()}
    if means:
        other = float(np.mean(list(means.values())))
        model.mean[:] = [means.get(lang, other) for lang in model.languages]
        known = spark.createDataFrame(list(means.items()), "l string, m double")
        over = told.join(F.broadcast(known), F.col("lang") == F.col("l")).groupBy("bin").agg(F.percentile_approx(F.col("e") - F.col("m"), F.lit(KEEP), F.lit(100_000)).alias("q"), F.count(F.lit(1)).alias("n")).collect()
        seen = {r["bin"]: max(r["q"], 0.0) for r in over if r["n"] >= LEAST_TEXTS} or {r["bin"]: max(r["q"], 0.0) for r in over}
        last = seen[max(seen)]
        for k in range(BINS - 1, -1, -1):
            # Shorter texts vary at least as much; where too few were seen, by the root of the length.
            last = max(last, seen[k]) if k in seen else last if k > max(seen) else last * 2**0.5
            model.excess[k] = last
    delete(spark, at)


def predict(docs: DataFrame, model: Model | None, extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The extra columns with lang_pred, score (0 to 1), entropy and rejected."""
    bounded_batches(docs.sparkSession)
    fields = [f for f in docs.select(*extra).schema.fields]
    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = shared.value
        for batch in batches:
            texts = batch.column(len(fields)).to_pylist()
            if m is None:
                name, p, e, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
            else:
                entropy, letters = m.entropies(texts)
                best = entropy.argmin(axis=1)
                e = entropy[np.arange(len(best)), best]
                weight = np.exp(-(entropy - e[:, None]) * np.minimum(letters, 50)[:, None])
                p = np.where(letters > 0, 1 / weight.sum(axis=1), 0.0)
                rejected = (letters == 0) | (e > m.bound(best, letters))
                name = [m.languages[i] if n else UNKNOWN for i, n in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(name, pa.string()), pa.array(p), pa.array(e), pa.array(rejected)], names=[*(f.name for f in fields), "lang_pred", "score", "entropy", "rejected"])

    return docs.select(*extra, "text").mapInArrow(score, f"{declared}, lang_pred string, score double, entropy double, rejected boolean")


def rejects(text: Column, model: Model | None, spark) -> Column:
    """Whether a text is rejected, as a column."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def judge(texts: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series(np.ones(len(texts), bool))
        entropy, letters = shared.value.entropies(texts.tolist())
        best = entropy.argmin(axis=1)
        return pd.Series((letters == 0) | (entropy[np.arange(len(best)), best] > shared.value.bound(best, letters)))

    return judge(F.coalesce(text, F.lit("")))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text, so it is 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))
