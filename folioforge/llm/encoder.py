"""Whole-text encoding with a tokenizers file, remembered piece by piece inside a task.

The word-level tokenizer drops white space and never joins across it, nor across the border between a run
of letters and what follows, apostrophes apart. So a text's ids are those of its pieces in order, and a
piece is encoded by the library once and remembered. Texts with apostrophes, special strings or letters
beyond Latin-1 are cut at ASCII white space only. Two generations of remembered pieces bound the memory.
"""

from __future__ import annotations

import os
import re

import numpy as np

ASCII_SPACE = re.compile(r"[ \t\n\r\f\v]+")
#: After lower-casing, the letters of Latin-1.
_LETTERS = "a-zªµºß-öø-ÿ"
PIECES = re.compile(f"[{_LETTERS}]+|[^{_LETTERS} \t\n\r\f\v]+")
WORD = re.compile(f"[{_LETTERS}]+")
GENERATION = 200_000


#: The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_CHAR = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
#: In Latin-1 text as it is in UTF-8, then in that alphabet.
_AS_BYTES = {c: "".join(_CHAR[b] for b in chr(c).encode("utf-8")) for c in range(256)}


class _Memory(dict):
    """piece -> ids as little-endian bytes of the encoder's type."""

    def __init__(self, tokenizer, dtype: str) -> None:
        super().__init__()
        self.tokenizer, self.dtype, self.old = tokenizer, dtype, {}

    def encode(self, piece: str) -> list[int]:
        if WORD.fullmatch(piece):  # one word of the model as it is: nothing is left to normalise or to cut
            return [t.id for t in self.tokenizer.model.tokenize(piece.translate(_AS_BYTES))]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(self.encode(piece), self.dtype).tobytes()
        if len(piece) <= 64:
            if len(self) >= GENERATION:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: 16 bits where all ids fit.
        self.dtype = "<u2" if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else "<u4"
        self.memory = _Memory(self.tokenizer, self.dtype)

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian bytes of ``dtype``; null is empty."""
        if not text:
            return b""
        pieces = None
        if "'" not in text and "<|" not in text:
            try:
                text.encode("latin-1")
                pieces = PIECES.findall(text.lower())
            except UnicodeEncodeError:
                pass
        if pieces is None:
            pieces = filter(None, ASCII_SPACE.split(text))
        return b"".join(map(self.memory.__getitem__, pieces))
