"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once per worker.

A text is cut where the tokenizer's own pre-tokenizer always cuts (before white space), so that the ids of the
text are the ids of its pieces one after the other. Texts for which that isn't certain (special strings, control
separators, unusual white space, letters that would compose with a mark once they are lower-cased) go to the library whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
from array import array

import numpy as np

_SPACES = "\t-\r \x85\xa0  -     　"
#: A run of white space belongs to the piece after it; one at the end is a piece of its own.
_PIECES = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")
#: Control separators, and letters whose lower case depends on what follows or grows.
_UNSURE = ("\x1c", "\x1d", "\x1e", "\x1f", "İ", "Σ")
#: White space other than one space or line feed between two other characters.
_RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0")
_WIDE = re.compile("[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Punctuation that may stand after a word. Letters and it never share a pre-token.
_ENDS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: New pieces that the library gets as one text.
_LOT = 200


#: What a remembered piece takes besides its letters and ids: two objects and its share of a dictionary.
_ENTRY = 190


class PieceIds(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers. A new piece gets an empty value that fill() completes:
    of a word with punctuation after it from the two parts, of others with one call of the library. Pieces live in two
    generations: age() makes all present ones old, old ones that are met again become young, and the next age() forgets the
    others."""

    def __init__(self, tokenizer, before: str = "", ends: PieceIds | None = None):
        """before: what stands before every piece and isn't part of the key; ends: has the punctuation after words (None: this one)."""
        super().__init__()
        self.tokenizer, self.before, self.new, self.joined = tokenizer, before, [], []
        self.ends = self if ends is None else ends
        self.parts = False  # whether punctuation after a word is looked up on its own
        self.lots: tuple | None = None  # see MemoEncoder.lots()
        self.old: dict = {}
        self.bytes = 0  # of the young generation

    def age(self) -> None:
        self.old, self.bytes = dict(self), 0
        self.clear()

    def __missing__(self, piece: str) -> bytes | bytearray:
        value = self.old.get(piece)
        if value is not None:
            self[piece] = value
            self.bytes += _ENTRY + len(piece) + len(value)
            return value
        value = bytearray()
        word = piece.rstrip(_ENDS) if self.parts else piece
        if len(word) < len(piece) and len(word) > 2 and word[-1].isalpha():
            self.joined.append((value, self[word], self.ends[piece[len(word) :]], piece))
        else:
            self.new.append((piece, value))
        self[piece] = value
        return value

    def encode(self) -> None:
        """Complete the new pieces that aren't joined from others."""
        single = [] if self.lots else self.new
        if self.lots:
            fits, after, mark, first, cut = self.lots
            fit = []
            for entry in self.new:
                (fit if fits(entry[0]) else single).append(entry)
            lots = [fit[k : k + _LOT] for k in range(0, len(fit), _LOT)]
            texts = ["".join([self.before + p + after for p, _ in lot]) for lot in lots]
            for lot, e in zip(lots, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                at = np.flatnonzero(mark[ids])
                bounds = [*at.tolist(), len(ids)] if first else [0, *(at + 1).tolist()]
                if len(at) != len(lot) or bounds[0] != 0 or bounds[-1] != len(ids):  # not one mark to each piece
                    single += lot
                    continue
                raw = ids.tobytes()
                for (_, value), start, end in zip(lot, bounds, bounds[1:], strict=False):
                    value += raw[4 * start : 4 * end - cut]
        if single:
            for (_, value), e in zip(single, self.tokenizer.encode_batch_fast([self.before + p for p, _ in single], add_special_tokens=False), strict=True):
                value += array("I", e.ids).tobytes()

    def fill(self) -> None:
        """Of another's `ends`, that one comes first."""
        if self.new:
            self.encode()
        for value, head, end, _ in self.joined:
            value += head
            value += end
        again = []
        for value, head, _, piece in self.joined:
            if type(head) is bytes:
                again.append((piece, value))
            else:  # the word is new as well: most such pieces never come again
                del self[piece]
        for p, v in [*self.new, *again]:
            self[p] = bytes(v)  # takes half the memory of what can grow
            self.bytes += _ENTRY + len(p) + len(v)
        self.new, self.joined = [], []


class MemoEncoder:
    """ids(texts) -> bytes of each. Handles the byte-level layout with spaces kept and the layout that drops white space;
    other tokenizers encode every text whole. What is remembered takes at most about `limit` bytes, besides what one call brings."""

    def __init__(self, path: str, limit: int = 400 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, normalizers

        self.tokenizer, self.compose = Tokenizer.from_file(path), normalizers.NFC().normalize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        pre = spec["pre_tokenizer"]
        if spec.get("normalizer") is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.kind = "spaced"
        elif spec["model"].get("end_of_word_suffix") and any(x.get("pattern") == {"Regex": "\\s+"} for x in (spec.get("normalizer") or {}).get("normalizers", [])):
            self.kind = "words"
        else:
            self.kind = "whole"
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.cache, self.limit = PieceIds(self.tokenizer), limit
        self.spaced = PieceIds(self.tokenizer, " ", self.cache)
        self.feed = self.whole("\n")
        self.cache.parts = self.spaced.parts = self.kind != "whole"
        self.cache.lots, self.spaced.lots = self.lots(spec, ""), self.lots(spec, " ")

    def lots(self, spec: dict, before: str) -> tuple | None:
        """How many pieces go to the library as one text: which ones may, what stands after each, by id whether it marks a
        piece, whether as its first id (or as the last one), and how many bytes at its end aren't its own. None: they don't."""
        vocab, suffix = self.tokenizer.get_vocab(), spec["model"].get("end_of_word_suffix")
        if any(c.isspace() for s in self.special for c in s):
            return None
        own = lambda piece: piece and not piece[0].isspace()
        if self.kind == "spaced" and before:  # only the first id of a piece has the space
            marks, how = [i for token, i in vocab.items() if token[0] == "Ġ"], (own, "", True, 0)
        elif self.kind == "spaced" and len(self.feed) == 4:  # a line feed before a word is a pre-token of its own
            marks, how = [int.from_bytes(self.feed, "little")], (own, "\n", False, 4)
        elif self.kind == "words" and sum(token.endswith(suffix) and len(token) == len(suffix) + 1 for token in vocab) >= 256:  # every pre-token has an end
            marks, how = [i for token, i in vocab.items() if token.endswith(suffix)], (str.isalpha, " ", False, 0)
        else:
            return None
        mark = np.zeros(max(vocab.values()) + 1, bool)
        mark[marks] = True
        return *how[:2], mark, *how[2:]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def found(self, text: str) -> list:
        """The values of the text's pieces; some may be filled later."""
        if self.kind == "whole" or any(s in text for s in _UNSURE) or any(s in text for s in self.special):
            return [self.whole(text)]
        if self.kind == "words":
            # the library composes letters and marks, then lower-cases; pieces would be composed again after that
            ascii_ = text.isascii()
            lower = (text if ascii_ or unicodedata.is_normalized("NFC", text) else self.compose(text)).lower()
            if not ascii_ and not unicodedata.is_normalized("NFC", lower):
                return [self.whole(text)]
            if any(s in lower for s in self.special):  # none of the library's, as it looks before lower-casing
                return [self.whole(text)]
            return list(map(self.cache.__getitem__, lower.split()))
        if any(s in text for s in _RUNS) or text[:1].isspace() or text[-1:].isspace() or not text.isascii() and _WIDE.search(text):
            return list(map(self.cache.__getitem__, _PIECES.findall(text)))
        out: list = []
        for line in text.split("\n") if text else ():  # a line feed between two words is a pre-token of its own
            first, *rest = line.split(" ")
            out += (self.feed, self.cache[first]) if out else (self.cache[first],)
            out += map(self.spaced.__getitem__, rest)
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.cache.bytes + self.spaced.bytes >= self.limit // 2:
            self.cache.age()
            self.spaced.age()
        gc.disable()  # nothing here makes cycles; collections would walk all pieces again and again
        try:
            found = [self.found(t) for t in texts]
            self.cache.fill()
            self.spaced.fill()
        finally:
            gc.enable()
        return [b"".join(f) for f in found]

