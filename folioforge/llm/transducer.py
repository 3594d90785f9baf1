"""Token counts of a byte-level BPE by a compiled finite-state transducer.

The transducer reads bytes. Its state tells, for the longest end of the read piece that begins some token,
the last token and the number of tokens (relative to now) at each place within it; that is all that the
future needs: the last token after one more byte is the longest vocabulary entry ending there that follows
compatibly on the last token at the place where it begins (two tokens are compatible if BPE turns their
bytes into just these two). Each transition carries the change of the number of emitted tokens. States and
transitions are compiled when they are first met, from the tokenizer's own vocabulary and BPE model, and
held in a table of at most ``MAX_STATES`` rows and ``MAX_TABLE`` cells: when it is full, in the middle of a text too, it starts anew with
the states that are still in use. A tokenizer with a normaliser, or that cuts texts in another way, is refused.

Texts are cut into chunks that run side by side. BPE works inside the pieces that the tokenizer's pattern cuts; where a
piece begins is decided by the character classes of at most three characters before and one after, for all characters
at once. A chunk that begins with a piece begins in the start state whatever came before: its state map is constant. A
chunk inside of a long piece has a map from the states it may begin in to the state it ends in and the tokens it
emits. The map's first entry is for the state that ``WARM`` bytes of run-up lead to, which mostly is the right one; chunks
of the same bytes share their map. The maps are composed by a parallel prefix scan: each entry points to the one that it leads to
in the next chunk, and pointers are doubled, so that after log2 of the number of chunks all entries that the text takes are known.
Those that are missing are run, all chunks side by side again, until none is. Special strings of the tokenizer are one token each, and cut the text.

Null is an empty text. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import bounded_batches

#: Cells have four bytes; there is one for each state and each byte that was met.
MAX_STATES, MAX_TABLE = 200_000, 16 << 20
SLICE_CHARS = 1 << 20
CHUNK, WARM = 1024, 64
SPACE, BLANK, LETTER, NUMBER, OTHER = range(5)


def character_classes() -> np.ndarray:
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{White_Space}+", BLANK), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            if a < 0xD800 <= b:
                out[a:0xD800] = kind
                a = 0xE000
            out[a : b + 1] = kind
    out[32] = SPACE
    return out


def piece_starts(codes: np.ndarray, kinds: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Where the pieces of the pattern 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|blanks(?!nonblank)|blanks begin."""
    kind = kinds[codes]
    blank = kind <= BLANK
    before = np.concatenate(([np.uint8(OTHER)], kind[:-1]))
    blank_before = np.concatenate(([False], blank[:-1]))
    last_blank = np.zeros(len(codes), bool)
    last_blank[:-1] = blank[:-1] & ~blank[1:] & ~text_start[1:]
    start = np.where(blank, ~blank_before | last_blank, np.where(blank_before, before != SPACE, kind != before)) | text_start
    quote = np.flatnonzero((codes == 39) & start)
    if len(quote):
        padded = np.concatenate((codes, np.zeros(3, codes.dtype)))
        ends = np.concatenate((text_start, np.ones(3, bool)))
        one, two = padded[quote + 1], padded[quote + 2]
        short = ~ends[quote + 1] & np.isin(one, [ord(c) for c in "stmd"])
        long = ~ends[quote + 1] & ~ends[quote + 2] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        start[quote[short | long] + 1] = False
        after = np.concatenate((quote[short] + 2, quote[long] + 3))
        start[after[after < len(start)]] = True
    return start


class Transducer:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        cut = form.get("pre_tokenizer") or {}
        if form.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("not a byte-level tokenizer that cuts texts by its usual pattern")
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        if set(self.char.values()) != set(ByteLevel.alphabet()):
            raise ValueError("not a byte-level alphabet")
        byte = {c: b for b, c in self.char.items()}
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("special tokens that take spaces or whole words are not handled")
        self.special = re.compile("|".join(re.escape(t.content) for t in sorted(added.values(), key=lambda t: -len(t.content)))) if added else None
        self.tokens = {bytes(byte[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if i not in added}
        self.begins = {t[:n] for t in self.tokens for n in range(1, len(t))}
        self.kinds = character_classes()
        self.fits: dict[int, bool] = {}
        self.shapes: dict[bytes, tuple] = {}
        self.bytes_of = {i: t for t, i in self.tokens.items()}
        self._clear()

    def _clear(self) -> None:
        self.states = [(b"", (-1,), (0,))]
        self.number = {self.states[0]: 0}
        self.symbol = np.full(256, -1, np.int16)  # column of a byte: only bytes that were met have one
        self.columns = 0
        self.table = np.full((4096, 64), -1, np.int32)

    def _renumber(self, live: list[np.ndarray]) -> None:
        """Starts the table anew with the states in the arrays alone, which get their new numbers in place."""
        used = np.union1d([0], np.concatenate(live))
        self.states = [self.states[i] for i in used]
        self.number = {s: i for i, s in enumerate(self.states)}
        for states in live:
            states[:] = np.searchsorted(used, states)
        self.table = np.full((max(4096, 2 * len(used)), self.table.shape[1]), -1, np.int32)

    def _bpe(self, raw: bytes) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize("".join(map(self.char.__getitem__, raw)))]

    def _follows(self, last: int, token: int) -> bool:
        """Whether BPE leaves a token as it is after the token ``last`` (-1: at the beginning)."""
        key = last << 32 | token
        if (said := self.fits.get(key)) is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            head = self.bytes_of[last] if last >= 0 else b""
            said = self.fits[key] = self._bpe(head + self.bytes_of[token]) == ([last, token] if last >= 0 else [token])
        return said

    def _shape(self, read: bytes) -> tuple:
        """Of what was read: the tokens that end it, longest first, with their places; and the places from which a
        token may still go on."""
        if (found := self.shapes.get(read)) is None:
            if len(self.shapes) > 200_000:
                self.shapes.clear()
            ends = tuple((at, self.tokens[read[at:]]) for at in range(len(read)) if read[at:] in self.tokens)
            drop = next((d for d in range(len(read)) if read[d:] in self.begins), len(read))
            live = tuple(at for at in range(drop, len(read)) if read[at:] in self.begins)
            found = self.shapes[read] = (ends, drop, live, read[drop:])
        return found

    def compile(self, state: int, byte: int) -> int:
        """The transition as next state * 256 + change of the count + 128."""
        end, last, count = self.states[state]
        ends, drop, live, rest = self._shape(end + bytes((byte,)))
        for at, token in ends:
            if self._follows(last[at], token):
                break
        else:
            raise AssertionError("no token ends here")
        change = count[at] + 1
        # Only places from which a token may still go on matter.
        new_last, new_count = [-2] * len(rest), [0] * len(rest)
        for at in live:
            new_last[at - drop], new_count[at - drop] = last[at], count[at] - change
        new = (rest, (*new_last, token), (*new_count, 0))
        if (to := self.number.get(new)) is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
            if to >= len(self.table):
                self.table = np.concatenate((self.table, np.full_like(self.table, -1)))
        packed = self.table[state, self.symbol[byte]] = to * 256 + change + 128
        return int(packed)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        out, at = np.zeros(len(texts), np.int64), 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= SLICE_CHARS):
                size += len(texts[upto] or "")
                upto += 1
            self._count(texts, at, upto, out)
            at = upto
        return out

    def _count(self, texts: list[str | None], lo: int, hi: int, out: np.ndarray) -> None:
        parts, owner = [], []
        for i in range(lo, hi):
            text = texts[i]
            if not text:
                continue
            if self.special is not None and self.special.search(text):
                cut = self.special.split(text)
                out[i] += len(cut) - 1
                kept = [p for p in cut if p]
            else:
                kept = [text]
            parts.extend(kept)
            owner.extend([i] * len(kept))
        if not parts:
            return
        joined = "".join(parts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        text_start = np.zeros(len(codes), bool)
        text_start[np.cumsum([0, *(len(p) for p in parts[:-1])])] = True
        starts = piece_starts(codes, self.kinds, text_start)
        raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
        first_byte = np.flatnonzero((raw & 0xC0) != 0x80)
        piece = np.zeros(len(raw), bool)
        piece[first_byte[starts]] = True
        part_at = first_byte[text_start]
        # Chunks begin with each text, at the first piece after every CHUNK bytes, and every CHUNK bytes inside of a
        # piece that goes on.
        piece_at = np.flatnonzero(piece)
        begins = np.union1d(piece_at[np.searchsorted(piece_at, np.arange(0, piece_at[-1] + 1, CHUNK))], part_at)
        long = np.flatnonzero(np.diff(np.append(begins, len(raw))) > 2 * CHUNK)
        inner = [np.arange(begins[k] + CHUNK, np.append(begins, len(raw))[k + 1], CHUNK) for k in long]
        lane_at = np.union1d(begins, np.concatenate(inner)) if len(long) else begins
        totals = self._composed(raw, piece, lane_at)
        np.add.at(out, np.array(owner), np.add.reduceat(totals, np.searchsorted(lane_at, part_at)))

    def _composed(self, raw: np.ndarray, piece: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The tokens that each chunk emits; chunks begin at the places ``at`` and reach to the next."""
        upto = np.append(at[1:], len(raw))
        open_ = ~piece[at]  # begins inside of a piece
        # Run-up: from where the piece begins, or WARM bytes before the chunk.
        warm = np.zeros(len(at), np.int64)
        warm[open_] = np.minimum(WARM, at[open_] - np.maximum.accumulate(np.where(piece, np.arange(len(piece)), 0))[at[open_]]) if open_.any() else 0
        first, last, total = self._run(raw, piece, at - warm, upto, warm, np.zeros(len(at), np.int64), [])
        if not open_.any():
            return total
        # Maps: of the bytes of a chunk, from its first state to its last one and its tokens.
        content = [raw[a:b].tobytes() if o else b"" for a, b, o in zip(at, upto, open_, strict=True)]
        names = {c: i for i, c in enumerate(dict.fromkeys(content))}
        kind = np.array([names[c] for c in content], np.int64)
        keys, begin, end, emitted = kind[open_], first[open_], last[open_], total[open_]
        inside = np.flatnonzero(open_)
        heads = inside[~open_[inside - 1]]  # a text begins with a piece, so the first chunk is never one of these
        follows = np.append(open_[1:], False)
        while True:
            # A place for each chunk inside of a piece and each entry of its map.
            by_kind = np.argsort(keys, kind="stable")
            lo, n = np.searchsorted(keys[by_kind], kind[inside]), np.bincount(keys, minlength=len(names))[kind[inside]]
            chunk = np.repeat(inside, n)
            entry = by_kind[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(chunk))]
            own = np.zeros(len(at), np.int64)
            own[inside] = np.cumsum(n) - n  # the first place of a chunk, to go on from where an entry is missing
            states = len(self.states)
            code = chunk * states + begin[entry]
            sorted_code = np.argsort(code)

            def find(chunks: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """The places of entries (chunk, state), and which are missing; for these the chunk's first place."""
                i = np.searchsorted(code, chunks * states + wanted, sorter=sorted_code)
                place = sorted_code[np.minimum(i, len(code) - 1)]
                there = code[place] == chunks * states + wanted
                return np.where(there, place, own[chunks]), ~there

            jump, lost = np.arange(len(chunk)), np.zeros(len(chunk), bool)
            on = np.flatnonzero(follows[chunk])
            jump[on], lost[on] = find(chunk[on] + 1, end[entry[on]])
            start, start_lost = find(heads, last[heads - 1])
            taken = np.zeros(len(chunk), bool)
            taken[start] = True
            for _ in range(len(inside).bit_length()):
                taken[jump[taken]] = True
                jump = jump[jump]
            wanted = np.flatnonzero(taken & lost)
            if not len(wanted) and not start_lost.any():
                total[chunk[taken]] = emitted[entry[taken]]
                return total
            lanes = np.concatenate((chunk[wanted] + 1, heads[start_lost]))
            state = np.concatenate((end[entry[wanted]], last[heads[start_lost] - 1]))
            _, once = np.unique(kind[lanes] * states + state, return_index=True)
            lanes, state = lanes[once], state[once]
            new_first, new_last, new_total = self._run(raw, piece, at[lanes], upto[lanes], np.zeros(len(lanes), np.int64), state, [begin, end, last])
            keys, begin, end, emitted = np.append(keys, kind[lanes]), np.append(begin, new_first), np.append(end, new_last), np.append(emitted, new_total)

    def _run(self, raw: np.ndarray, piece: np.ndarray, at: np.ndarray, upto: np.ndarray, warm: np.ndarray, state: np.ndarray, live: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs chunks side by side: of each the state after its run-up, its last state and the tokens emitted after the
        run-up. ``live`` are arrays of states that must be kept."""
        for b in np.flatnonzero(np.bincount(raw, minlength=256)):
            if self.symbol[b] < 0:
                self.symbol[b] = self.columns
                self.columns += 1
        while self.columns > self.table.shape[1]:
            self.table = np.concatenate((self.table, np.full_like(self.table, -1)), axis=1)
        lengths = upto - at
        order = np.argsort(-lengths, kind="stable")
        sorted_lengths = lengths[order]
        read, place, warm = self.symbol[raw], at[order], warm[order]
        now, total = state[order], np.zeros(len(at), np.int64)
        first = now.copy()
        active = np.searchsorted(-sorted_lengths, -np.arange(sorted_lengths[0]), side="left")
        run_ups = set(warm.tolist()) - {0}
        for step, m in enumerate(active):
            if step in run_ups:
                done = warm == step
                first[done], total[done] = now[done], 0
            if len(self.states) > min(MAX_STATES, MAX_TABLE // self.table.shape[1]):
                self._renumber([now, first, *live])
            here = place[:m]
            symbol = read[here]
            from_ = np.where(piece[here], 0, now[:m])
            move = self.table[from_, symbol]
            if (move < 0).any():
                for i in np.flatnonzero(move < 0):
                    known = self.table[from_[i], symbol[i]]
                    move[i] = known if known >= 0 else self.compile(int(from_[i]), int(raw[here[i]]))
            now[:m] = move >> 8
            total[:m] += (move & 255) - 128
            here += 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return first[back], now[back], total[back]


def token_counts(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(tokenizer)
        for batch in batches:
            n = machine.counts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(n > limit)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
