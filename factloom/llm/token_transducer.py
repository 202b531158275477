"""Token counts by a compiled finite-state transducer (operator 1).

The tokenizer file (normaliser, pre-tokenizer and byte-pair merges with a word-end mark) becomes one deterministic
transducer over code points. Its transitions carry the number of tokens they emit: what the count of the word read so
far changes by, so the sum over a text is its token count.

A state is the kind of pre-token being read and the merge context: the longest suffix of the word that can still grow
into a token and, for each place in that suffix, the last token of the encoding up to there with its count. The context
is finite because tokens are, and it decides the next one: of the tokens that end at a place exactly one goes together
with the encoding before it. States and transitions are determinised when first met and kept in a dense table, which is
emptied when it has reached its bound.

Texts are cut into chunks of equal length that run in lockstep, one numpy gather a step. White space is synchronising:
whatever state enters, the same one leaves. So a chunk's state map is constant but for the symbols before its first white
space, and maps compose by a parallel scan: a constant map takes over whatever came before, and only those head symbols
are run again from the state that the scan delivers. Within a long word states converge too, only later. So the map of a
chunk without white space is first held to be the constant that the word's start gives; every round of the scan runs all
chunks again, at once, whose entry turned out otherwise, until no exit changes. That takes a few rounds, not one a chunk.

The table is emptied between batches when it has reached its bound. A single text may bring any number of states: when they
reach a larger bound in the middle of a batch, those that lanes are in are kept, all others are forgotten and compiled again
where they are met again.

Cases: null and empty texts have 0 tokens; special strings inside a text count as one token, as the library's default
has it; rows are independent, so ties and repeated rows change nothing; other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import blocks, id_and_text, machine, record, ship

_SPACES = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() and c not in "\x1c\x1d\x1e\x1f")
START, LETTERS, OTHER, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
#: The contractions of the pre-tokenizer's pattern.
_SHORT, _LONG = frozenset("stmd"), {"r": (QUOTE_R, "e"), "v": (QUOTE_V, "e"), "l": (QUOTE_L, "l")}
_SECOND = {QUOTE_R: "re", QUOTE_V: "ve", QUOTE_L: "ll"}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CHUNK, SPACE, PAD_BITS = 128, 0, 6
#: What a state takes besides its row of the table, about.
STATE_BYTES = 1000
#: What table and states may take while a batch runs, as a multiple of the table's bound.
HARD = 4.5


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + n)
            n += 1
    return [letters[b] for b in range(256)]


class Merges:
    """Byte-pair encoding of short symbol sequences, to decide which two tokens go together."""

    def __init__(self, model: dict):
        self.end = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.inner = {t for t in self.vocab if not t.endswith(self.end)}
        self.final = {t[: -len(self.end)] for t in self.vocab if t.endswith(self.end)}
        self.prefixes = {t[:i] for t in self.inner for i in range(1, len(t))} | {t[:i] for t in self.final for i in range(1, len(t) + 1)}
        self.known: dict[tuple, bool] = {}

    def encode(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best = min(((self.rank.get(p, 1 << 40), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False))))
            if best[0] == 1 << 40:
                break
            i = best[1]
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
        return symbols

    def together(self, before: str | None, token: str, final: bool) -> bool:
        """Whether the encoding of `before`+`token` is those two (of `token` alone where nothing is before it)."""
        key = (before, token, final)
        if (ok := self.known.get(key)) is None:
            letters = [*(before or ""), *token]
            if final:
                letters[-1] += self.end
            want = [token + self.end if final else token]
            ok = self.known[key] = self.encode(letters) == ([before, *want] if before else want)
        return ok


#: A merge context: suffix, and for each k up to its length the last token k letters ago (None: the word's start) and
#: how many tokens came since.
EMPTY = ("", ((None, 0),))


class Transducer:
    def __init__(self, path: str, bound_mb: float = 100):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["pattern"] != {"Regex": _PATTERN} or level["type"] != "ByteLevel" or level["add_prefix_space"]:
            raise ValueError("this tokenizer's normaliser or pre-tokenizer isn't one that the compiler knows")
        self.merges = Merges(spec["model"])
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or r"(?!)")
        self.marks = [x["content"] for x in spec["added_tokens"]]
        self.letters = byte_letters()
        self.bound = bound_mb * 1_000_000
        self.reset()

    def reset(self) -> None:
        self.symbol_of = np.full(0x110000, -1, np.int32)
        self.symbols: list[tuple] = []
        self.width = 128
        self.empty()
        self.add_symbol(ord(" "))

    def empty(self) -> None:
        """No states but the first, which is 0."""
        self.merges.known.clear()
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.height = 1024
        self.table = np.full((self.height, self.width), -1, np.int32)
        self.state((START, EMPTY))

    @property
    def full(self) -> bool:
        """Whether states have to go while a batch runs. Between batches the table's own size decides, which is met sooner."""
        return len(self.keys) * (4 * self.width + STATE_BYTES) > HARD * self.bound

    def kept(self, *lanes: np.ndarray) -> None:
        """Forget all states but those in the arrays, where they get new numbers."""
        old = np.unique(np.concatenate(lanes))
        keys = [self.keys[i] for i in old.tolist()]
        self.empty()
        new = np.array([self.state(k) for k in keys], np.int64)
        for lane in lanes:
            lane[:] = new[np.searchsorted(old, lane)]

    # --- compilation -----------------------------------------------------------------------------------------------
    def state(self, key: tuple) -> int:
        if (i := self.states.get(key)) is None:
            i = self.states[key] = len(self.keys)
            self.keys.append(key)
            if i >= self.height:
                more = min(self.height, 1 << 14)
                self.height += more
                self.table = np.concatenate([self.table, np.full((more, self.width), -1, np.int32)])
        return i

    def add_symbol(self, code: int) -> None:
        c = chr(code)
        if c in _SPACES:
            if self.symbols:
                self.symbol_of[code] = SPACE
                return
            read = None
        else:
            read = tuple(self.classified(x) for x in c.lower())
        self.symbol_of[code] = len(self.symbols)
        self.symbols.append(read)
        if len(self.symbols) > self.width:
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
            self.width *= 2

    def classified(self, c: str) -> tuple:
        kind = unicodedata.category(c)[0]
        return c, "L" if kind == "L" else "N" if kind == "N" else "S" if c in _SPACES else "O", tuple(self.letters[b] for b in c.encode("utf-8", "surrogatepass"))

    def grow(self, context: tuple, letters: tuple) -> tuple[tuple, int]:
        """The context after more letters of the word, and the change of its token count."""
        total = 0
        for x in letters:
            suffix, last = context
            for n in range(len(suffix) + 1, 0, -1):
                token = suffix[len(suffix) - n + 1 :] + x
                before, since = last[n - 1]
                if token in self.merges.inner and self.merges.together(before, token, False):
                    break
            else:
                raise ValueError(f"no token ends at {suffix + x!r}")
            emitted = 1 - since
            total += emitted
            longer = suffix + x
            keep = len(longer)
            while keep and longer[len(longer) - keep :] not in self.merges.prefixes:
                keep -= 1
            context = longer[len(longer) - keep :], ((token, 0), *((t, k + emitted) for t, k in last[:keep]))
        return context, total

    def close(self, context: tuple) -> int:
        """The change of the count when the word ends here."""
        suffix, last = context
        if not suffix and last[0][0] is None:
            return 0
        for n in range(len(suffix), 0, -1):
            token = suffix[len(suffix) - n :]
            before, since = last[n]
            if token in self.merges.final and self.merges.together(before, token, True):
                return 1 - since
        raise ValueError(f"no token ends a word at {suffix!r}")

    def word(self, letters: tuple) -> int:
        context, n = self.grow(EMPTY, letters)
        return n + self.close(context)

    def step(self, key: tuple, char: tuple) -> tuple[tuple, int]:
        kind, context = key
        c, of, letters = char
        if kind == QUOTE and of == "L" and c in _SHORT:
            quote = self.grow(EMPTY, tuple("'"))[1]
            return (START, EMPTY), self.word(("'", *letters)) - quote
        if kind in _SECOND and c == _SECOND[kind][1]:
            so_far = self.word(("'",)) + self.grow(EMPTY, (_SECOND[kind][0],))[1]
            return (START, EMPTY), self.word(("'", *_SECOND[kind])) - so_far
        if kind in _SECOND:
            kind = LETTERS
        if kind == LETTERS and of == "L" or kind in (OTHER, QUOTE) and of == "O":
            context, n = self.grow(context, letters)
            return (LETTERS if of == "L" else OTHER, context), n
        n = self.close(context) if kind != START else 0
        if of == "S":
            return (START, EMPTY), n
        if of == "N":
            return (START, EMPTY), n + self.word(letters)
        context, more = self.grow(EMPTY, letters)
        if of == "L":
            new = _LONG[c][0] if kind == QUOTE and c in _LONG else LETTERS
        else:
            new = QUOTE if c == "'" else OTHER
        return (new, context), n + more

    def compile(self, state: int, symbol: int) -> int:
        key, n = self.keys[state], 0
        for char in self.symbols[symbol] or ((" ", "S", ()),):
            key, more = self.step(key, char)
            n += more
        packed = self.state(key) << PAD_BITS | (n + 32)
        self.table[state, symbol] = packed
        return packed

    def advance(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Packed (next state, emitted + 32) of many lanes."""
        at = state * self.width + symbol
        packed = self.table.ravel()[at]
        if packed.min(initial=0) < 0:
            for x in np.unique(at[packed < 0]).tolist():
                self.compile(x // self.width, x % self.width)
            packed = self.table.ravel()[state * self.width + symbol]
        return packed

    # --- running ---------------------------------------------------------------------------------------------------
    def count(self, texts: list[str]) -> np.ndarray:
        if self.table.nbytes > self.bound:
            self.reset()
        total = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, t in enumerate(texts):
            if any(m in t for m in self.marks):
                segments = self.special.split(t)
                total[i] += len(segments) - 1
            else:
                segments = [t]
            for s in segments:
                if s:
                    parts.append(s if unicodedata.is_normalized("NFC", s) else unicodedata.normalize("NFC", s))
                    owner.append(i)
        if not parts:
            return total
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = self.symbol_of[codes]
        if symbols.min(initial=0) < 0:
            for c in np.unique(codes[symbols < 0]).tolist():
                self.add_symbol(c)
            symbols = self.symbol_of[codes]
        n = np.array([len(p) for p in parts], np.int64)
        chunks = n // CHUNK + 1  # at least one white space ends each part
        first = np.concatenate([[0], np.cumsum(chunks)])
        lanes = np.zeros(int(first[-1]) * CHUNK, np.int32)
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        lanes[np.arange(len(symbols)) + np.repeat(first[:-1] * CHUNK - start, n)] = symbols
        sums = self.scan(lanes.reshape(-1, CHUNK), first[:-1])
        per_part = np.add.reduceat(sums, first[:-1])
        np.add.at(total, np.array(owner), per_part)
        return total

    def scan(self, lanes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Tokens emitted in each chunk. firsts: the chunks that begin a text."""
        k = len(lanes)
        space = lanes == SPACE
        constant = space.any(1)
        head = np.where(constant, space.argmax(1), CHUNK)
        begins = np.zeros(k, bool)
        begins[firsts] = True
        skip = np.where(constant & ~begins, head, 0)  # what the entry decides; the others are run from the start of a word
        steps = np.ascontiguousarray(np.where(np.arange(CHUNK) < skip[:, None], SPACE, lanes).T)
        state, sums = np.zeros(k, np.int64), np.zeros(k, np.int64)
        for symbol in steps:
            if self.full:
                self.kept(state)
            packed = self.advance(state, symbol)
            state = (packed >> PAD_BITS).astype(np.int64)
            sums += (packed & 63) - 32
        heads = np.where(constant, 0, sums)  # tokens before the first white space, as far as known
        sums -= heads
        todo = np.flatnonzero(~begins)  # a word may also end just where a chunk begins
        while len(todo):
            order = todo[np.argsort(-head[todo], kind="stable")]
            length = np.minimum(head[order] + 1, CHUNK)  # with the white space that ends the word
            s = state[order - 1]
            emitted = np.zeros(len(order), np.int64)
            for j in range(int(length[0])):
                if self.full:
                    self.kept(state, s)
                live = int(np.searchsorted(-length, -j, side="left"))
                packed = self.advance(s[:live], lanes[order[:live], j])
                s[:live] = packed >> PAD_BITS
                emitted[:live] += (packed & 63) - 32
            heads[order] = emitted
            moved = ~constant[order] & (state[order] != s)
            state[order[moved]] = s[moved]
            after = order[moved] + 1
            todo = after[after < k]
            todo = todo[~begins[todo]]
        return sums + heads


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def op1_token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs(doc_id, text)."""
    ship(docs.sparkSession)

    def count(batches) -> Iterator[pa.RecordBatch]:
        own = machine(Transducer, tokenizer)
        for ids, texts in blocks(batches, 2_500_000, keep=True):
            n = own.count(texts)
            yield record(_OUT, ids, [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts], n, n > limit)

    return id_and_text(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
