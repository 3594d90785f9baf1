"""Runs of ASCII letters, digits and other than ASCII characters, A-Z lower-cased, as UTF-8 bytes."""

from __future__ import annotations

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Byte by byte: letters and digits (A-Z lower-cased) and bytes beyond ASCII stay, the rest is a space.
TABLE = bytes(b if b in _WORD or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()
