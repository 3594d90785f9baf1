"""Vectorised word and shingle hashing on UTF-8 bytes, shared by the operators on word sequences.

Everything here works on one Arrow batch inside a task. Texts are handled in slices of
``SLICE_BYTES``, so that memory stays bounded whatever the batch holds; one text that is longer
than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SLICE_BYTES = 1 << 20

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = _SEED.integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.multiply.accumulate(np.full(256, _BASE, dtype=np.uint64))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.multiply.accumulate(np.full(1 << (n - 1).bit_length(), _BASE, dtype=np.uint64))
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: Sequence[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts as bytes), with about SLICE_BYTES in each; null is empty."""
    at, size, part = 0, 0, []
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if part and size + len(raw) > SLICE_BYTES:
            yield at, part
            at, size, part = i, 0, []
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield at, part


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and the offsets of each text's words."""
    raw = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = _SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    at = np.cumsum(first, dtype=np.int32)
    place = np.arange(len(raw), dtype=np.int32)
    place -= np.concatenate(([0], starts)).astype(np.int32)[at]
    value = _BYTE_LOWER[raw]
    value *= _power_table(int(place.max()) + 1)[place]
    value[space] = 0
    offsets = np.concatenate(([0], np.searchsorted(starts, ends)))
    return mix64(np.add.reduceat(value, starts)), offsets


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Per text its sorted distinct shingle hashes: of ``width`` words each, or of all words if fewer."""
    words, offsets = word_hashes(texts)
    n = len(words) - width + 1
    rolled = np.empty(0, np.uint64)
    if n > 0:
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled += words[k : k + n] * _MIX[k % 8] if k < 8 else mix64(words[k : k + n] + np.uint64(k))
        rolled = mix64(rolled)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = mix64(np.array([(int(h) * 0x9E3779B97F4A7C15 + int(w)) & (2**64 - 1)], np.uint64))[0]
            yield np.array([h], np.uint64)
        else:
            yield np.empty(0, np.uint64)
