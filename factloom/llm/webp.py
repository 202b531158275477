"""Lossless WebP images as binary columns (operator 9).

decode() reads any lossless WebP stream: prefix codes (simple and canonical), several code groups, back-references, the
colour cache, and the predictor, cross-colour, subtract-green and palette transforms. Streams whose codes have one
length for each channel are decoded by numpy without a loop. Where only one channel takes bits, as in grey images, numpy
looks the symbol up that would begin at each bit, and a walk from symbol to symbol picks those that do. Transforms are
numpy too, but for the predictors that need the pixel just made.

pack() stores bytes losslessly as 8-bit samples of the green channel: prefix codes with back-references to earlier samples,
before that the left predictor where it saves bits, or a palette with bundled pixels where there are few values. The codes
come from fixed rankings of bytes, so headers repeat and are parsed once; of the rankings the cheapest for the image is
taken. A grey image has no use for cross-colour, subtract-green and the colour cache: pack() doesn't write them.

Cases: null and empty texts are 64 zero bytes; equal texts give equal values; payloads above 2**28 bytes become several
images in a row; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import blocks, id_and_text, record, ship

SIDE = 1 << 14
#: Fixed values of the format: the order of code-length codes and the neighbours of short distance codes (x, y).
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_CACHE_MUL = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class Bits:
    """Bits of a byte string from the lowest of each byte upwards."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        first = self.at >> 3
        value = int.from_bytes(self.data[first : first + 5], "little") >> (self.at & 7) & (1 << n) - 1
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return value


class PrefixCode:
    """A canonical prefix code, given the length of each symbol's code (0: none)."""

    def __init__(self, lengths: list[int]):
        self._table = self._runs = None
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        self.symbols = [s for _, s in used]
        self.equal = used[0][0] if used and used[0][0] == used[-1][0] and len(used) == 1 << used[0][0] else None
        if len(used) <= 1:  # a lone symbol takes no bits
            self.symbols, self.equal, self.codes = self.symbols or [0], 0, None
            return
        self.codes, code, last = {}, 0, used[0][0]
        for n, s in used:
            code <<= n - last
            last = n
            self.codes[n, code] = s
            code += 1
        if code != 1 << last:
            raise ValueError("the prefix code isn't complete")

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the lowest of any 15 bits begin with: up to three literals (below 256) whose codes lie in them, the bits that
        these take (0: a symbol that isn't a literal), and how many they are."""
        if self._runs is None:
            symbol, size = self.table()
            all_ = np.arange(1 << 15)
            literals, taken, count = np.zeros((1 << 15, 3), np.uint8), np.zeros(1 << 15, np.uint8), np.zeros(1 << 15, np.uint8)
            open_ = np.ones(1 << 15, bool)
            for k in range(3):
                ahead = all_ >> taken
                n = size[ahead]
                open_ &= (symbol[ahead] < 256) & (n > 0) & (taken + n <= 15)
                literals[open_, k] = symbol[ahead[open_]]
                taken[open_] += n[open_]
                count += open_
            self._runs = literals, taken, count
        return self._runs

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length of the code that the lowest of any 15 bits begin with."""
        if self._table is None:
            symbol, size = np.zeros(1 << 15, np.uint16), np.zeros(1 << 15, np.uint8)
            for (n, code), s in (self.codes or {}).items():
                at = reverse_bits(code, n)
                symbol[at :: 1 << n], size[at :: 1 << n] = s, n
            self._table = symbol, size
        return self._table

    def read(self, bits: Bits) -> int:
        if self.codes is None:
            return self.symbols[0]
        if self._table is not None:  # worth building where many symbols are read
            at = bits.at
            ahead = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & 0x7FFF
            bits.at = at + int(self._table[1][ahead])
            if bits.at > 8 * len(bits.data):
                raise ValueError("the stream ends early")
            return int(self._table[0][ahead])
        code = n = 0
        while True:
            code, n = code << 1 | bits.read(1), n + 1
            if (s := self.codes.get((n, code))) is not None:
                return s
            if n > 15:
                raise ValueError("no such code")


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    lengths = [0] * alphabet
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return PrefixCode(lengths)
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[_LENGTH_ORDER[k]] = bits.read(3)
    code = PrefixCode(own)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and most:
        most -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
        else:
            n, value = (3 + bits.read(2), last) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
            if at + n > alphabet:
                raise ValueError("code lengths beyond the alphabet")
            lengths[at : at + n] = [value] * n
            at += n
    return PrefixCode(lengths)


def _count(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return (2 + (prefix & 1) << extra) + bits.read(extra) + 1


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """width * height ARGB values of an entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    group_bits, groups_of, groups = 0, None, 1
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        across = -(-width >> group_bits)
        groups_of = (read_pixels(bits, across, -(-height >> group_bits), False) >> 8 & 0xFFFF).reshape(-1, across)
        groups = int(groups_of.max()) + 1
    alphabets = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [_known_codes(bits, alphabets) for _ in range(groups)]
    n = width * height
    if groups == 1 and not cache_bits and all(c.equal is not None for c in codes[0][:4]) and codes[0][0].symbols[-1] < 256:
        return _read_equal(bits, codes[0], n)
    if groups == 1 and not cache_bits and all(c.equal == 0 for c in codes[0][1:4]):
        return _read_green(bits, codes[0], n, width)
    return _read_any(bits, codes, groups_of, group_bits, cache_bits, n, width)


def _read_any(bits: Bits, codes: list, groups_of: np.ndarray | None, group_bits: int, cache_bits: int, n: int, width: int) -> np.ndarray:
    """Pixel by pixel: any codes, groups and cache."""
    out = np.zeros(n, np.uint32)
    cache = [0] * (1 << cache_bits)
    shift, at, cached = 32 - cache_bits, 0, 0
    while at < n:
        group = codes[int(groups_of[at // width >> group_bits, at % width >> group_bits]) if groups_of is not None else 0]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = (group[k].read(bits) for k in (1, 2, 3))
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length, distance = _count(bits, s - 256), _count(bits, group[4].read(bits))
            distance = _distance(distance, width)
            if distance > at or at + length > n:
                raise ValueError("a reference beyond the image")
            for k in range(at, at + length):
                out[k] = out[k - distance]
            at += length
        else:
            while cached < at:
                v = int(out[cached])
                cache[(_CACHE_MUL * v & 0xFFFFFFFF) >> shift] = v
                cached += 1
            out[at] = cache[s - 280]
            at += 1
    return out


#: Code groups that were read before, by their number of bits and those bits; at most so many.
_KNOWN: dict[int, dict[tuple, list]] = {}
KNOWN_GROUPS = 64


def _known_codes(bits: Bits, alphabets: tuple[int, ...]) -> list[PrefixCode]:
    """The codes of one group. Many images share theirs, so what was read is looked up by its bits."""

    def key(n: int) -> tuple:
        first = bits.at >> 3
        return alphabets, int.from_bytes(bits.data[first : first + (n >> 3) + 2], "little") >> (bits.at & 7) & (1 << n) - 1

    for n, groups in _KNOWN.items():
        if (found := groups.get(key(n))) is not None and bits.at + n <= 8 * len(bits.data):
            bits.at += n
            return found
    start = bits.at
    codes = [read_code(bits, n) for n in alphabets]
    end, bits.at = bits.at, start
    if sum(map(len, _KNOWN.values())) >= KNOWN_GROUPS:
        _KNOWN.clear()
    _KNOWN.setdefault(end - start, {})[key(end - start)] = codes
    bits.at = end
    return codes


def reverse_bits(code: int, n: int) -> int:
    return int(f"{code:0{n}b}"[::-1], 2) if n else 0


#: Bytes of a stream whose symbols are looked up at once.
WINDOW = 1 << 18


def _read_green(bits: Bits, group: list[PrefixCode], n: int, width: int) -> np.ndarray:
    """Pixels of which only green takes bits, with back-references."""
    symbol, size = group[0].table()
    group[4].table()
    rest = np.uint32(group[3].symbols[0] << 24 | group[1].symbols[0] << 16 | group[2].symbols[0])
    if not size.any():  # a lone green symbol takes no bits either
        if group[0].symbols[0] < 256:
            return np.full(n, rest | np.uint32(group[0].symbols[0] << 8), np.uint32)
        raise ValueError("an image of references only")
    literals, taken, count = group[0].runs()
    data, green, at = bits.data, bytearray(n + 2), 0
    p, end = bits.at, 8 * len(data)
    while at < n:
        first = p >> 3
        raw = np.frombuffer(data[first : first + WINDOW + 2] + b"\0\0", np.uint8).astype(np.uint32)
        raw = (raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16)[:WINDOW]
        windows = (raw[:, None] >> np.arange(8, dtype=np.uint32)).astype(np.uint16).ravel() & np.uint16(0x7FFF)
        steps = taken[windows].tobytes()
        p -= 8 * first
        last = len(steps)
        while at < n and p < last:
            places: list[int] = []
            push, room = places.append, n - at
            stop = min(last, p + 15 * room)  # no code is longer; what is read beyond the image is dropped below
            while p < stop and (step := steps[p]):
                push(p)
                p += step
            if places:
                found = windows[places]
                many = count[found]
                made = literals[found][np.arange(3, dtype=np.uint8) < many[:, None]]
                if len(made) > room:  # codes of the last lookups lie beyond the image
                    before = np.cumsum(many)
                    k = int(np.searchsorted(before, room))  # the lookup that completes it
                    p, left = places[k], room - (int(before[k - 1]) if k else 0)
                    for _ in range(left):
                        w = int.from_bytes(data[first + (p >> 3) : first + (p >> 3) + 3], "little") >> (p & 7) & 0x7FFF
                        p += int(size[w])
                    made = made[:room]
                green[at : at + len(made)] = made.tobytes()
                at += len(made)
            if p < last and at < n and not steps[p]:
                w = int(windows[p])
                s = int(symbol[w])
                bits.at = 8 * first + p + int(size[w])
                if s < 256:  # a literal whose code is longer than what is left of a lookup can't be: it comes first
                    raise ValueError("no such code")
                length, distance = _count(bits, s - 256), _count(bits, group[4].read(bits))
                distance = _distance(distance, width)
                if distance > at or at + length > n:
                    raise ValueError("a reference beyond the image")
                source = green[at - distance : at - distance + min(length, distance)]
                green[at : at + length] = (source * (length // len(source) + 1))[:length]
                at += length
                p = bits.at - 8 * first
        p += 8 * first
        if p > end:
            raise ValueError("the stream ends early")
    bits.at = p
    return np.frombuffer(bytes(green[:n]), np.uint8).astype(np.uint32) << np.uint32(8) | rest


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = _NEAR[code - 1]
    return max(1, x + y * width)


def _read_equal(bits: Bits, group: list[PrefixCode], n: int) -> np.ndarray:
    """Pixels whose codes have one length a channel: every pixel has as many bits."""
    lengths = [c.equal for c in group[:4]]
    stride = sum(lengths)
    first, skip = bits.at >> 3, bits.at & 7
    raw = np.unpackbits(np.frombuffer(bits.data, np.uint8, -(-(skip + stride * n) // 8), first) if stride else np.zeros(0, np.uint8), bitorder="little")
    flat = raw[skip : skip + stride * n].reshape(n, stride)
    bits.at += stride * n
    out, at = np.zeros(n, np.uint32), 0
    for c, length, shift in zip(group, lengths, (8, 16, 0, 24), strict=False):
        if length:
            code = np.packbits(flat[:, at : at + length], axis=1)[:, 0] >> np.uint8(8 - length)
            out |= np.array(c.symbols, np.uint32)[code] << np.uint32(shift)
        else:
            out |= np.uint32(c.symbols[0] << shift)
        at += length
    return out


# --- transforms; pixels as uint8 arrays (height, width, 4) in the order blue, green, red, alpha ------------------------
def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint16) + b) >> 1).astype(np.uint8)


def _predict(mode: int, left, top, top_left, top_right) -> np.ndarray:
    if mode == 11:
        towards = top.astype(int) - top_left, left.astype(int) - top_left
        return left if abs(towards[0]).sum() < abs(towards[1]).sum() else top
    if mode == 12:
        return np.clip(left.astype(int) + top - top_left, 0, 255).astype(np.uint8)
    if mode == 13:
        mean = _average(left, top).astype(int)
        return np.clip(mean + np.trunc((mean - top_left) / 2).astype(int), 0, 255).astype(np.uint8)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left, 5: lambda: _average(_average(left, top_right), top), 6: lambda: _average(left, top_left),
        7: lambda: _average(left, top), 8: lambda: _average(top_left, top), 9: lambda: _average(top, top_right), 10: lambda: _average(_average(left, top_left), _average(top, top_right)),
    }.get(mode, lambda: np.array([0, 0, 0, 255], np.uint8))()


_NEEDS_LEFT = frozenset((1, 5, 6, 7, 10, 11, 12, 13))


def unpredict(p: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    """Add its prediction to every residue, in place."""
    height, width = p.shape[:2]
    p[0, 0, 3] = (int(p[0, 0, 3]) + 255) & 255
    p[0] = np.cumsum(p[0], axis=0, dtype=np.uint8)
    for y in range(1, height):
        above = p[y - 1]
        p[y, 0] += above[0]
        row = modes[y >> size_bits]
        for block in range(len(row)):
            lo, hi = max(1, block << size_bits), min(width, block + 1 << size_bits)
            if lo >= hi:
                continue
            mode = int(row[block])
            right = np.concatenate([above[lo + 1 : hi + 1], p[y, :1]])[: hi - lo] if hi == width else above[lo + 1 : hi + 1]
            if mode == 1:
                p[y, lo:hi] = np.cumsum(np.concatenate([p[y, lo - 1 : lo], p[y, lo:hi]]), axis=0, dtype=np.uint8)[1:]
            elif mode not in _NEEDS_LEFT:
                p[y, lo:hi] += _predict(mode, None, above[lo:hi], above[lo - 1 : hi - 1], right)
            else:
                for x in range(lo, hi):
                    p[y, x] += _predict(mode, p[y, x - 1], above[x], above[x - 1], right[x - lo])
    return p


def uncross(p: np.ndarray, elements: np.ndarray, size_bits: int) -> np.ndarray:
    """Undo the cross-colour transform. elements: ARGB values of the blocks."""
    height, width = p.shape[:2]
    e = np.repeat(np.repeat(elements, 1 << size_bits, 0)[:height], 1 << size_bits, 1)[:, :width]
    part = lambda shift: (e >> np.uint32(shift)).astype(np.uint8).view(np.int8).astype(np.int16)
    signed = lambda c: c.view(np.int8).astype(np.int16)
    green = signed(np.ascontiguousarray(p[..., 1]))
    p[..., 2] += (part(0) * green >> 5).astype(np.uint8)
    p[..., 0] += (part(8) * green >> 5).astype(np.uint8)
    p[..., 0] += (part(16) * signed(np.ascontiguousarray(p[..., 2])) >> 5).astype(np.uint8)
    return p


def _as_pixels(argb: np.ndarray, width: int) -> np.ndarray:
    return argb.astype("<u4").view(np.uint8).reshape(-1, width, 4)


def decode_stream(data: bytes) -> np.ndarray:
    """A VP8L stream as uint8 pixels (height, width, 4): blue, green, red, alpha."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen, wide = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size_bits = bits.read(3) + 2
            across = -(-wide >> size_bits)
            blocks_ = read_pixels(bits, across, -(-height >> size_bits), False).reshape(-1, across)
            undo.append((kind, wide, size_bits, blocks_))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = np.cumsum(_as_pixels(read_pixels(bits, n, 1, False), n)[0], axis=0, dtype=np.uint8)
            pack_bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, wide, pack_bits, colours))
            wide = -(-wide >> pack_bits)
        else:
            undo.append((kind, wide, 0, None))
    p = _as_pixels(read_pixels(bits, wide, height, True), wide).copy()
    for kind, wide, size_bits, own in reversed(undo):
        if kind == PREDICTOR:
            p = unpredict(p, own >> 8 & 0xF, size_bits)
        elif kind == CROSS_COLOUR:
            p = uncross(p, own, size_bits)
        elif kind == SUBTRACT_GREEN:
            p[..., 0] += p[..., 1]
            p[..., 2] += p[..., 1]
        else:
            index = p[..., 1]
            if size_bits:
                each = 8 >> size_bits
                index = (index[..., None] >> (np.arange(1 << size_bits, dtype=np.uint8) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :wide]
            table = np.zeros((256, 4), np.uint8)
            table[: len(own)] = own
            p = table[index]
    return p


def chunks(data: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes, int]]:
    """(name, content, end) of the chunks of the RIFF file that begins at `at`."""
    if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
        raise ValueError("no WebP file")
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    at += 12
    while at + 8 <= end:
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], data[at + 8 : at + 8 + n], end
        at += 8 + n + (n & 1)


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file."""
    for name, content, _ in chunks(data):
        if name == b"VP8L":
            return decode_stream(content)
    raise ValueError("no lossless image in the file")


# --- storing bytes as samples ----------------------------------------------------------------------------------------
def _field(value: int, n: int) -> np.ndarray:
    return (value >> np.arange(n) & 1).astype(np.uint8)


def _lone(symbol: int) -> list[np.ndarray]:
    return [_field(0b101, 3), _field(symbol, 8)]


def _equal_code(length: int, alphabet: int) -> list[np.ndarray]:
    """The code in which the first 2**length symbols have codes of that length: two code-length codes of one bit each."""
    own = [int(s in (0, length)) for s in _LENGTH_ORDER]
    n = max(4, max(k for k, x in enumerate(own) if x) + 1)
    flags = np.zeros(alphabet, np.uint8)
    flags[: 1 << length] = 1
    return [_field(0, 1), _field(n - 4, 4), *[_field(x, 3) for x in own[:n]], _field(0, 1), flags]


def code_lengths(weights: list[float], longest: int = 15) -> list[int]:
    """Huffman's code lengths; weights are flattened until no code is longer than `longest`."""
    while True:
        heap = [(w, i, None) for i, w in enumerate(weights) if w]
        heapq.heapify(heap)
        n = len(weights)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], n, (a, b)))
            n += 1
        lengths, todo = [0] * len(weights), [(heap[0], 0)]
        while todo:
            (_, i, pair), depth = todo.pop()
            if pair is None:
                lengths[i] = depth
            else:
                todo += [(pair[0], depth + 1), (pair[1], depth + 1)]
        if max(lengths) <= longest:
            return lengths
        weights = [w and w**0.9 for w in weights]


def codes_of(lengths: list[int]) -> np.ndarray:
    """The canonical codes in the order in which their bits are written."""
    out, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = reverse_bits(code, n)
        code += 1
    return out


def written_code(lengths: list[int]) -> list[np.ndarray]:
    """The bits by which a stream tells code lengths, runs shortened."""
    symbols: list[tuple[int, int, int]] = []  # symbol, extra bits, their number
    at, before = 0, 8
    while at < len(lengths):
        value, end = lengths[at], at
        while end < len(lengths) and lengths[end] == value:
            end += 1
        run = end - at
        while run:
            if value == 0 and run >= 3:
                take = min(run, 138)
                symbols.append((18, take - 11, 7) if take >= 11 else (17, take - 3, 3))
            elif value and value == before and run >= 3:
                take = min(run, 6)
                symbols.append((16, take - 3, 2))
            else:
                take, before = 1, value or before
                symbols.append((value, 0, 0))
            run -= take
        at = end
    own = code_lengths([float(sum(s == k for s, _, _ in symbols)) for k in range(19)], 7)
    if sum(map(bool, own)) < 2:
        own[0 if own[0] == 0 else 1] = own[[i for i, x in enumerate(own) if x or symbols[0][0] == i][0]] = 1
    codes = codes_of(own)
    n = max(4, max(k for k, s in enumerate(_LENGTH_ORDER) if own[s]) + 1)
    out = [_field(0, 1), _field(n - 4, 4), *[_field(own[s], 3) for s in _LENGTH_ORDER[:n]], _field(0, 1)]
    for s, extra, wide in symbols:
        out += [_field(int(codes[s]), own[s]), _field(extra, wide)]
    return out


#: Bytes from frequent to rare in texts of Latin letters.
RANKED = b" etaonirsldhcumpgfbywv.k,\nETAxjqzINSOHRLDCUMPGFBYWVKXJQZ0123456789-'\"!?:;()/|&%$*@#=_+<>[]{}~^`\\\t\r"
LITERALS, SHORTEST, LONGEST, FURTHEST = 256, 24, 4096, (1 << 20) - 121


def rankings() -> list[list[float]]:
    """Weights of the 280 green symbols: Latin text, other text (bytes from 128 on first), and differences of neighbours."""
    latin = [*RANKED, *(b for b in range(128, 256)), *(b for b in range(128) if b not in RANKED)]
    other = [*range(128, 192), 32, *range(192, 256), *(b for b in latin if b < 128 and b != 32)]
    steps = sorted(range(256), key=lambda d: (min(d, 256 - d), d))
    out = []
    for order, slope in ((latin, 1.35), (other, 0.9), (steps, 1.8)):
        weights = [0.0] * 280
        for rank, b in enumerate(order):
            weights[b] = (rank + 4) ** -slope
        total = sum(weights)
        for k in range(24):
            weights[LITERALS + k] = total * (0.02 if 4 <= k <= 9 else 0.002)
        out.append(weights)
    return out


class Coder:
    """The fixed codes of pack(): three for samples, one for distances, with the bits of their headers."""

    def __init__(self):
        lengths = [code_lengths(w) for w in rankings()]
        distance = code_lengths([0.2 if k < 12 else 1.0 + k / 20 for k in range(40)])
        self.size = np.array(lengths, np.int32)
        self.code = np.array([codes_of(n) for n in lengths], np.uint32)
        self.d_size, self.d_code = np.array(distance, np.int32), codes_of(distance)
        tail = [*_lone(0), *_lone(0), *_lone(255), *written_code(distance)]
        plain = [_field(0, 1), _field(0, 1), _field(0, 1)]  # no more transforms, no cache, one group
        self.head = [np.concatenate([*plain, *written_code(n), *tail]) for n in lengths[:2]]
        # the left predictor in blocks of the largest size, named by one lone green symbol
        predict = [_field(1, 1), _field(PREDICTOR, 2), _field(7, 3), _field(0, 1), *_lone(1), *_lone(0), *_lone(0), *_lone(0), *_lone(0)]
        zero = [*_lone(0), *_lone(0), *_lone(0), *written_code(distance)]
        self.head.append(np.concatenate([*predict, *plain, *written_code(lengths[2]), *zero]))


@lru_cache(maxsize=1)
def coder() -> Coder:
    return Coder()


def references(samples: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of repeats of SHORTEST samples or more, from left to right without overlap. A sample's
    partner is a place before it at which the next eight samples are the same: the last one with their 16-bit hash."""
    n = len(samples) - 7
    if n <= SHORTEST:
        return []
    ahead = np.ndarray((n,), "<u8", samples.tobytes(), strides=(1,)).copy()
    with np.errstate(over="ignore"):
        hashed = (ahead * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(hashed, kind="stable")  # sixteen bits are sorted by counting
    ahead = ahead[order]
    same = np.flatnonzero(ahead[1:] == ahead[:-1])
    distance = np.zeros(n, np.int64)
    distance[order[same + 1]] = order[same + 1] - order[same]
    distance[distance > FURTHEST] = 0
    edge = np.flatnonzero(distance[1:] != distance[:-1]) + 1
    begin = np.concatenate([[0], edge])
    lengths = np.diff(np.append(begin, n)) + 7
    some = np.flatnonzero((distance[begin] > 0) & (lengths >= SHORTEST))
    out, covered = [], 0
    for start, length, d in zip(begin[some].tolist(), lengths[some].tolist(), distance[begin[some]].tolist(), strict=True):
        if start < covered:
            start, length = covered, length - covered + start
        while length >= SHORTEST:
            take = min(length, LONGEST)
            out.append((start, take, d))
            start, length, covered = start + take, length - take, start + take
    return out


def prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of lengths and distances."""
    v = value - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    small = v < 4
    extra = np.where(small, 0, high - 1)
    return np.where(small, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1)), v & (1 << extra) - 1, extra


def _fields(samples: np.ndarray, which: int, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and their numbers of bits: a field for each literal, four for each reference."""
    own = coder()
    start, length, distance = found.T
    fields = np.ones(len(samples), np.int32)
    inside = np.zeros(len(samples) + 1, np.int32)
    np.add.at(inside, start, 1)
    np.add.at(inside, start + length, -1)
    fields[np.cumsum(inside[:-1]) > 0] = 0
    fields[start] = 4
    first = np.cumsum(fields) - fields
    total = int(first[-1] + fields[-1])
    value, size = np.zeros(total, np.uint32), np.zeros(total, np.int32)
    alone = np.flatnonzero(fields == 1)
    value[first[alone]], size[first[alone]] = own.code[which][samples[alone]], own.size[which][samples[alone]]
    at = first[start]
    for k, (numbers, codes, sizes, base) in enumerate(((length, own.code[which], own.size[which], LITERALS), (distance + 120, own.d_code, own.d_size, 0))):
        symbol, extra, wide = prefixed(numbers)
        value[at + 2 * k], size[at + 2 * k] = codes[symbol + base], sizes[symbol + base]
        value[at + 2 * k + 1], size[at + 2 * k + 1] = extra, wide
    return value, size


def coded(samples: np.ndarray, which: int) -> np.ndarray:
    """The bits of samples in a fixed code, with references."""
    own = coder()
    found = references(samples)
    if found:
        value, size = _fields(samples, which, np.array(found, np.int64))
    else:
        value, size = own.code[which][samples], own.size[which][samples]
    ends = np.cumsum(size)
    place = np.arange(int(ends[-1]), dtype=np.uint32) - np.repeat((ends - size).astype(np.uint32), size)
    return (np.repeat(value, size) >> place & np.uint32(1)).astype(np.uint8)


_BITS_OF = {n: np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[: 1 << n, 8 - n :].copy() for n in range(1, 9)}
#: Images with at most so many values have a palette; samples that take more bits each, in the mean, may be better predicted.
FEW, DENSE = 4, 6.5


def pack(payload: bytes) -> bytes:
    """One WebP file whose green samples are the payload's bytes, row by row; chunk LENG holds their number."""
    samples = np.frombuffer(payload, np.uint8)
    rows = -(-len(samples) // 64)
    width = 64 * max(1, -(-rows // SIDE))
    height = max(1, -(-len(samples) // width))
    if height * width > len(samples):
        samples = np.concatenate([samples, np.full(height * width - len(samples), samples[-1] if len(samples) else 0, np.uint8)])
    head = [_field(0x2F, 8), _field(width - 1, 14), _field(height - 1, 14), _field(0, 4)]
    colours = np.flatnonzero(np.bincount(samples, minlength=256))
    if len(colours) <= FEW:
        body = _with_palette(samples, colours)
    else:
        counts = np.bincount(samples, minlength=256)
        cost = [int(coder().size[k, :256] @ counts) for k in (0, 1)]
        which, written_ = cost.index(min(cost)), samples
        if min(cost) > DENSE * len(samples):  # no text of letters: neighbours may be alike
            grid = samples.reshape(height, width)
            steps = np.diff(grid, axis=1, prepend=np.concatenate([[np.uint8(0)], grid[:-1, 0]])[:, None]).ravel()
            if int(coder().size[2, :256] @ np.bincount(steps, minlength=256)) < min(cost):
                which, written_ = 2, steps
        body = [coder().head[which], coded(written_, which)]
    stream = np.packbits(np.concatenate([*head, *body]), bitorder="little").tobytes()
    pad = b"\0" * (len(stream) & 1)
    chunk = b"".join([b"WEBPVP8L", len(stream).to_bytes(4, "little"), stream, pad, b"LENG", (8).to_bytes(4, "little"), len(payload).to_bytes(8, "little")])
    return b"RIFF" + len(chunk).to_bytes(4, "little") + chunk


def _with_palette(samples: np.ndarray, colours: np.ndarray) -> list[np.ndarray]:
    """The palette, and its indices bundled to pixels."""
    n = len(colours)
    place = np.zeros(256, np.uint8)
    place[colours] = np.arange(n)
    pack_bits = 3 if n <= 2 else 2 if n <= 4 else 1
    each = 8 >> pack_bits
    index = (place[samples].reshape(-1, 1 << pack_bits) << (np.arange(1 << pack_bits, dtype=np.uint8) * each)).sum(1, dtype=np.uint8)
    head = [
        _field(1, 1), _field(PALETTE, 2), _field(n - 1, 8),
        # the palette: green steps in a code of 8 bits, alpha 255 once and then 0
        _field(0, 1), *_equal_code(8, 280), *_lone(0), *_lone(0), _field(0b111, 3), _field(0, 8), _field(255, 8), _field(0b001, 3), _field(0, 1),
    ]
    steps = np.diff(colours, prepend=0)
    palette = np.concatenate([_BITS_OF[8][steps], np.array([[1]] + [[0]] * (n - 1), np.uint8)], axis=1).ravel()
    main = [_field(0, 1), _field(0, 1), _field(0, 1), *_equal_code(8, 280), *_lone(0), *_lone(0), *_lone(255), _field(0b001, 3), _field(0, 1)]
    return [*head, palette, *main, _BITS_OF[8][index].ravel()]


LARGEST = 1 << 28


def store(payload: bytes) -> bytes:
    return b"".join(pack(payload[i : i + LARGEST]) for i in range(0, max(1, len(payload)), LARGEST))


def _images(data: bytes) -> Iterator[tuple[np.ndarray, int]]:
    at = 0
    while at < len(data):
        pixels, n = None, None
        for name, content, end in chunks(data, at):
            if name == b"VP8L":
                pixels = np.ascontiguousarray(decode_stream(content)[..., 1])
            elif name == b"LENG":
                n = int.from_bytes(content, "little")
        yield pixels, pixels.size if n is None else n
        at = end


def restore(data: bytes) -> bytes:
    return b"".join(p.ravel()[:n].tobytes() for p, n in _images(data))


def feature(height: int, width: int, payload: bytes) -> str:
    """Size of the first image, and of all samples: mean in thousandths, distinct values, entropy in thousandths of a bit."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts[counts > 0] / len(payload)
    return f"{width}x{height};mean={int(counts @ np.arange(256)) * 1000 // len(payload)};distinct={len(p)};entropy={round(float(-(p * np.log2(p)).sum()) * 1000)}"


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def op9_webp(docs: DataFrame) -> DataFrame:
    """Store every text of docs(doc_id, text) as lossless WebP, read it back and digest what was read."""
    ship(docs.sparkSession)

    def through(batches) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            rows: list[list] = [[] for _ in _OUT]
            for doc, text in zip(ids, texts, strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                media = store(raw + b"\0" * (-len(raw) % 64 if raw else 64))
                back, shape = [], None
                for p, n in _images(media):
                    shape = shape or p.shape
                    back.append(p.ravel()[:n].tobytes())
                payload = b"".join(back)
                for column, value in zip(rows, (doc, len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), sha256(media).hexdigest(), feature(*shape, payload)), strict=True):
                    column.append(value)
            yield record(_OUT, *rows)

    return id_and_text(docs).mapInArrow(through, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
