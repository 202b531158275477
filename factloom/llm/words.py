"""ASCII words of whole texts as bytes: runs of a-z, 0-9 and everything beyond ASCII, after lower-casing A-Z only."""

from __future__ import annotations

_LETTERS = bytes(range(ord("a"), ord("z") + 1)) + b"0123456789"
#: Each byte of UTF-8: itself, its lower case, or the space that parts words.
TABLE = bytes(b if b >= 0x80 or b in _LETTERS else b + 32 if ord("A") <= b <= ord("Z") else 32 for b in range(256))
#: The same as a pattern of Spark and other engines, for texts whose letters A-Z are lower-cased already.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()
