"""Sampled segmentations over a piece lattice, and their decoding (operator 7).

A text becomes the model's pieces in a way drawn at random: a segmentation has probability in proportion to
exp(theta * sum of its pieces' scores). Forward filtering sums over all segmentations up to each place, backward sampling
then draws the last piece, the one before it, and so on. No piece holds a space after another character, nor a line
feed, so the lattice falls apart into units (a word with the spaces before it), which are filtered once while they are
remembered; the draws are made anew for every unit of every text. The draws hash the seed, the row's key, the unit's
number in the text and the step, so a row gives the same pieces wherever and beside whatever it runs.

Characters without a piece become the byte pieces of their UTF-8. Decoding joins the pieces, turns the space mark to a
space and drops the first one, and gives the text back whatever it holds.

Cases: null and empty texts have no pieces; equal texts under different keys are drawn independently, rows with the same
key and text alike; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import blocks, id_and_text, machine, record, ship
from factloom.llm.token_shards import _GOLD, mix

MARK = "▁"
_UNIT = re.compile("\n|[ ]*[^ \n]+|[ ]+")
#: Units of more characters are filtered one by one, so many characters at a time; edges of the lattice that are remembered.
LONG, SLAB, EDGES = 400, 50_000, 16_000_000
_SLOW = re.compile(f"  |{MARK}| \n|\n |\n\n")


class Lattice:
    def __init__(self, path: str, theta: float, limit: int = 700_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = [0] * 256
        self.text_of: list[str | None] = [None] * n
        scores: dict[str, tuple[int, float]] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                if (b := int(piece[3:5], 16)) < 128:  # a character by itself
                    self.text_of[i] = chr(b)
            elif sp.get_score(i) > -1e8 and not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):  # runs of spaces have no real score
                scores[piece] = (i, sp.get_score(i))
                self.text_of[i] = piece.replace(MARK, " ")
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in scores) or not all(self.byte_ids):
            raise ValueError("pieces of this model cross words or lines, or it has no byte pieces")
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.theta, self.size, self.limit = theta, n, limit
        self.longest = max(map(len, scores))
        self.lowest = theta * min(s for _, s in scores.values()) - 1.0
        # the pieces as a trie: sorted keys node << 21 | code point
        nodes: dict[str, int] = {"": 0}
        for p in scores:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        keys = np.array([nodes[p[:-1]] << 21 | ord(p[-1]) for p in nodes if p], np.int64)
        to = np.array([i for p, i in nodes.items() if p], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.piece_at = np.full(len(nodes), -1, np.int32)
        self.weight_at = np.full(len(nodes), -np.inf)
        for p, (i, s) in scores.items():
            self.piece_at[nodes[p]], self.weight_at[nodes[p]] = i, theta * s
        self.forget()

    def forget(self) -> None:
        self.units: dict[str, int] = {}
        self.ends: list[int] = []  # the last node of each unit
        self.first = np.zeros(0, np.int64)
        self.cdf, self.length, self.piece = np.zeros(0, np.float32), np.zeros(0, np.uint8), np.zeros(0, np.int32)

    # --- forward filtering of units not seen before ------------------------------------------------------------------
    def filter(self, new: list[str]) -> None:
        """Adds nodes and edges of the units; edges of a node stand together, with their cumulated probabilities."""
        for u in new:
            if len(u) > LONG:
                self.filter_long(u)
        new = sorted((u for u in new if len(u) <= LONG), key=len, reverse=True)
        n = np.array([len(u) for u in new], np.int64)
        code = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        start = np.concatenate([[0], np.cumsum(n)])
        left = np.repeat(start[1:], n) - np.arange(len(code))
        mark = ord(MARK)
        spaced = np.where(code == 32, mark, np.where(code == mark, 0x10FFFF, code))  # a real mark goes to byte pieces
        width = self.longest
        weight = np.full((len(code), width), -np.inf)
        piece = np.full((len(code), width), -1, np.int32)
        at, node = np.arange(len(code)), np.zeros(len(code), np.int64)
        for k in range(width):
            live = left[at] > k
            at, node = at[live], node[live]
            if not len(at):
                break
            key = node << 21 | spaced[at + k]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            at, node = at[hit], self.to[found[hit]]
            weight[at, k], piece[at, k] = self.weight_at[node], self.piece_at[node]
        bare = weight[:, 0] == -np.inf  # no piece for the character alone: its bytes
        weight[bare, 0] = self.lowest
        piece[bare, 0] = np.where(code[bare] < 128, np.array(self.byte_ids)[np.minimum(code[bare], 127)], self.size + code[bare])
        alpha = np.zeros(len(code) + len(new))
        base = start[:-1] + np.arange(len(new))  # a node before each character of a unit, and one after the last
        first = np.full(len(alpha), -1, np.int64)
        cdfs, lengths, pieces, have = [], [], [], len(self.cdf)
        for i in range(1, int(n[0]) + 1 if len(n) else 1):
            live = int(np.searchsorted(-n, -i, side="right"))
            w = min(i, width)
            back = np.arange(1, w + 1)
            spot = start[:live, None] + i - back
            ways = alpha[base[:live, None] + i - back] + weight[spot, back - 1]
            top = ways.max(1)
            p = np.exp(ways - top[:, None])
            total = p.sum(1)
            alpha[base[:live] + i] = top + np.log(total)
            some = p > 0
            cum = np.cumsum(p, 1) / total[:, None]
            count = some.sum(1)
            last = np.cumsum(count)
            first[base[:live] + i] = have + last - count
            flat = cum[some].astype(np.float32)
            flat[last - 1] = 2.0  # the last edge always holds
            cdfs.append(flat)
            lengths.append(np.broadcast_to(back.astype(np.uint8), some.shape)[some])
            pieces.append(piece[spot, back - 1][some])
            have += len(flat)
        offset = len(self.first)
        self.first = np.concatenate([self.first, first])
        self.cdf, self.length, self.piece = np.concatenate([self.cdf, *cdfs]), np.concatenate([self.length, *lengths]), np.concatenate([self.piece, *pieces])
        for u, end in zip(new, (offset + base + n).tolist(), strict=True):
            self.units[u] = len(self.ends)
            self.ends.append(end)

    def filter_long(self, unit: str) -> None:
        """filter() of one long unit, character by character over the pieces that end there, in slabs of SLAB characters."""
        mark, width, n = ord(MARK), self.longest, len(unit)
        alpha, low = [0.0], 0  # from node `low` onwards
        first, cdf, length, pieces, have = [-1], [], [], [], len(self.cdf)
        for lo in range(0, n, SLAB):
            # pieces that end in this slab begin at most width - 1 characters before it
            begin, end = max(0, lo - width + 1), min(n, lo + SLAB)
            code = np.frombuffer(unit[begin:end].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            spaced = np.where(code == 32, mark, np.where(code == mark, 0x10FFFF, code))
            at, node, found = np.arange(len(code)), np.zeros(len(code), np.int64), []
            bare = np.ones(len(code), bool)
            for k in range(width):
                live = at < len(code) - k
                at, node = at[live], node[live]
                if not len(at):
                    break
                key = node << 21 | spaced[at + k]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[place] == key
                at, node = at[hit], self.to[place[hit]]
                real = self.weight_at[node] > -np.inf
                if k == 0:
                    bare[at[real]] = False
                found.append((at[real] + k + 1, np.full(int(real.sum()), k + 1), self.weight_at[node[real]], self.piece_at[node[real]].astype(np.int64)))
            alone = np.flatnonzero(bare)
            found.append((alone + 1, np.ones(len(alone), np.int64), np.full(len(alone), self.lowest), np.where(code[alone] < 128, np.array(self.byte_ids)[np.minimum(code[alone], 127)], self.size + code[alone])))
            ends, sizes, weights, ids = (np.concatenate(x) for x in zip(*found, strict=True))
            inside = ends > lo - begin
            order = np.lexsort((sizes[inside], ends[inside]))
            ends, sizes, weights, ids = (x[inside][order] for x in (ends, sizes, weights, ids))
            cuts = np.searchsorted(ends, np.arange(lo - begin + 1, end - begin + 2)).tolist()
            sizes_, weights_ = sizes.tolist(), weights.tolist()
            for i, (a, b) in enumerate(zip(cuts, cuts[1:]), lo + 1):
                ways = [alpha[i - low - sizes_[e]] + weights_[e] for e in range(a, b)]
                top = max(ways)
                p = [math.exp(w - top) for w in ways]
                total = sum(p)
                alpha.append(top + math.log(total))
                first.append(have)
                have += b - a
                cum = 0.0
                for x in p:
                    cum += x
                    cdf.append(cum / total)
                cdf[-1] = 2.0
            length.append(sizes.astype(np.uint8))
            pieces.append(ids.astype(np.int32))
            keep = min(len(alpha), width)
            low += len(alpha) - keep
            del alpha[: len(alpha) - keep]
        self.ends.append(len(self.first) + n)
        self.units[unit] = len(self.ends) - 1
        self.first = np.concatenate([self.first, np.array(first, np.int64)])
        self.cdf, self.length, self.piece = np.concatenate([self.cdf, np.array(cdf, np.float32)]), np.concatenate([self.length, *length]), np.concatenate([self.piece, *pieces])

    # --- backward sampling -------------------------------------------------------------------------------------------
    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        text = " " + text
        if _SLOW.search(text, 1) or text[1] in " \n" or text[-1] in " \n":
            return _UNIT.findall(text)
        out: list[str] = []
        for line in text[1:].split("\n"):
            head, *rest = line.split(" ")
            if out:
                out += ("\n", head)
            else:
                out.append(" " + head)
            out += [" " + w for w in rest]
        return out

    def encode(self, keys: np.ndarray, texts: list[str], seed: int) -> list[np.ndarray]:
        """Piece ids of each text (byte pieces for characters without a piece)."""
        if len(self.units) > self.limit or len(self.cdf) > EDGES:
            self.forget()
        cut = [self.cut(t) for t in texts]
        new = {u for c in cut for u in c if u not in self.units}
        if new:
            self.filter(list(new))
        per = np.array([len(c) for c in cut], np.int64)
        unit = np.fromiter((self.units[u] for c in cut for u in c), np.int64, int(per.sum()))
        ordinal = np.arange(len(unit)) - np.repeat(np.cumsum(per) - per, per)
        with np.errstate(over="ignore"):
            stream = mix(mix(keys.astype(np.uint64) + _GOLD * np.uint64(seed + 1)).repeat(per) + ordinal.astype(np.uint64) * _GOLD)
        # a unit's first node is the one without edges; walking back ends there
        node = np.array(self.ends, np.int64)[unit]
        live = np.arange(len(unit))
        steps, count = [], np.zeros(len(unit), np.int64)
        step = 0
        while len(live):
            with np.errstate(over="ignore"):
                u = (mix(stream[live] + np.uint64(step) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
            edge = self.first[node]
            more = np.flatnonzero(self.cdf[edge] <= u)
            while len(more):
                edge[more] += 1
                more = more[self.cdf[edge[more]] <= u[more]]
            steps.append((live, self.piece[edge]))
            node = node - self.length[edge]
            on = self.first[node] >= 0
            count[live[~on]] = step + 1
            live, node = live[on], node[on]
            step += 1
        ends = np.cumsum(count)
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for k, (where, piece) in enumerate(steps):
            ids[ends[where] - 1 - k] = piece
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])]
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [self.spelled(x) if len(x) and x.max() >= self.size else x for x in out]

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        out: list[int] = []
        for i in ids.tolist():
            out += [i] if i < self.size else [self.byte_ids[b] for b in chr(i - self.size).encode("utf-8", "surrogatepass")]
        return np.array(out, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        names = self.text_of
        try:
            return "".join([names[i] for i in ids.tolist()])[1:]
        except TypeError:
            raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else names[i].encode() for i in ids.tolist())
            return raw.decode("utf-8", "surrogatepass")[1:]



_OUT = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_())])


def op7_piece_sampling(docs: DataFrame, model: str, theta: float = 0.0005, seed: int = 0) -> DataFrame:
    """doc_id, the number of sampled pieces, the crc32 of their ids (little-endian 32-bit) and whether decoding gives the
    text back, for every row of docs(doc_id, text)."""
    ship(docs.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = machine(Lattice, model, theta)
        for ids, texts in blocks(batches, 2_000_000, keep=True):
            drawn = own.encode(np.array([-1 if i is None else i for i in ids], np.int64), texts, seed)
            yield record(_OUT, ids, [len(x) for x in drawn], [zlib.crc32(x.astype("<u4").tobytes()) for x in drawn], [own.decode(x) == t for x, t in zip(drawn, texts, strict=True)])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
