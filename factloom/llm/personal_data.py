"""Personal data by fixed patterns and a linear-chain conditional random field (operator 10).

The base patterns give the spans that must be there. The random field is trained on the driver from the small labelled
table below (features: word shapes, digit counts and those of the neighbours) and decoded by Viterbi over batches of
lines in numpy; it adds spans where no base span lies, such as telephone numbers without a country code. Every line of
every text is decoded, and what the field says isn't filtered.

Cases: null and empty texts have no spans; rows are independent; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import blocks, id_and_text, record, ship

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match never starts within a run of digits: from its first digit it'd be the same
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost non-overlapping matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from each '@'."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the random field ------------------------------------------------------------------------------------------------
#: The labelled table: one line a row, spans marked <kind ...>. All of it is invented here; no line comes from any corpus.
LABELLED = """
Ring the workshop on <phone (312) 867-4400> after lunch.
Her desk is <phone (415) 230-1188> and mine is <phone (415) 230-1189>.
the clinic answers at <phone (208) 771-9032>
Booking desk: <phone 503-221-7764>, open daily.
Leave word at <phone 918-404-6630> if late.
Old line <phone 770-883-2015> was cut off in spring
ask Marta, <phone 612.335.9081>, about tiles
Garage <phone 415.902.7733> does tyres too
Night porter <phone 207 613 4498> has keys.
Hotline <phone 1-866-340-7719> is free.
the hall can be had via <phone 1-844-902-1153>
Werkstatt <phone 040/7782310> macht um acht auf.
Die Praxis <phone 089/4455120> hat zu.
Anruf unter <phone 0711 9023344> genügt
Der Hausmeister (<phone 0351 8840127>) kommt gleich.
Frau Öztürk erreicht man unter <phone 0221 7719035>
La mairie répond au <phone 04 76 33 20 91> le matin.
Notre atelier, <phone 05 61 48 77 02>, ferme en août
appelez le <phone 02 99 12 54 36> pour le pain
El taller atiende en <phone 93 418 22 70> hasta las seis.
Pida hora al <phone 95 277 31 46> si puede
London office <phone 020 7946 0811>, ground floor
try <phone 0161 496 0237> or <phone 0161 496 0238> in the week
Rotterdam: <phone 010-4147755>
call <phone +44 20 7946 0123> or <phone +1 212 736 5000>
Milano <phone +39 02 7209 4411> solo mattina
Notes go to <email petra.holm@atelier-nord.example>, thanks.
Mail <email j_okafor@clinic.example.org> before Friday
cc <email tiles+orders@shop.example.net> and <email front.desk@hall.example.com>
Schreib an <email werkstatt@rad.example.de>.
écrire à <email accueil@mairie.example.fr> pour cela
old address <email root@workbench> still works
ask <email keys@porter-lodge> for the key
reach <email night@desk> or <email day@desk> any time
Router <email admin@gateway> hears you
The printer sits at <ip 192.168.40.17> in the hall.
gateway <ip 10.20.0.1>, mask off
Backup from <ip 172.20.9.31> to <ip 172.20.9.44> ran.
proxy <ip 10.44.7.9:3128> is slow
open <ip 192.168.77.5:8443> in a browser
nodes <ip 10.1.2.3/24> and <ip 10.1.9.0/16> are joined
ssh <ip 203.0.113.58> failed twice
Paid with <card 4929 1174 0032 8862> at noon.
the card <card 5412-7530-1188-2045> was refused
Karte <card 4539871200346613> läuft ab
charged <card 6011348820157797> twice
use <card 3714 496353 98431> for travel
tarjeta <card 4716 2203 9915 4476> caducada
old <card 5301882746610936>, new <card 5301882746610944>
Karte <card 5412.7530.1188.2045> ist neu
billed <card 4929.1174.0032.8862> in May
account 4929117400328861 is closed
ledger 5301882746610934 and 6011348820157792 differ
parcel 4716220399154470 is on its way
ticket 371449635398432 was stamped
serial 0038172299410075 on the frame
The loom was built in 1884 and sold in 1921.
They wove 2,450 yards in 31 days.
Release 4.11.2 came after 4.11.1 by a week.
It cost 18.75 or 21.40 with post.
Read pages 211, 215-219 and 304.
From 1939 to 1946 the mill stood still.
on 2019-11-02 at 07:35 the bell rang
Posten 14 und 15 fehlen noch.
Around 35% of 8,600,000 spindles turned.
const seed = "9c1f77e2ab30d4485e6b02fa71c3d90e4481bb6f" in the file
the hash 5ed7c0a9913bb24f was wrong
row c4e1 and d90 of z80
snapshot 20190811 of tree 6.3
thread by @weaver was long
passcode=8f2a66d01c93eb57aa in a script
secret_key=91be03dd7f is stale
meet @ noon
come over @ ten or so
A Loud Drum beat twice
NO ENTRY!! KEEP OUT
pour les uns et des autres que la nuit
wool$$$ and% silk&&&
Of | warp | and | weft.
part 7 row 3 bobbin 220
in 1871 1872 1873 1874
weights 15 25 35 45 55
2 of 9 or 4 in 11
some 640,000 bales by 1905
norm EN 14971 and DIN 53804
shed 512 on level 9
8.5 m by 4.75 m
build 3.0.8.1-rc ready
24/03/2018 until 02/04/2018
All rights 2007-2016 kept by the guild
GNU terms (c) 2014 apply
ratio 3:2 and 16:9
temperatures of -12 to +35 degrees
lot 0042 and lot 0117
batch 7700123 was dyed blue
serial 88203114590 on the frame
order 100245 shipped, 100246 waits
isbn 978-3-16-148410-0 in print
see (12) and (13) below
in (1998) she moved
item [4] of list (b)
1.2.3 then 1.2.4
1 2 3 4 5 6 7 8 9
10 000 and 25 000 marks
about 1 500 000 people
x = 3.14159 and y = 2.71828
room 12-14 or 16-18
the 5th, 6th and 21st
at 9am or 10:30pm
1080p on a 27in screen
"""
_MARK = re.compile(r"<(email|ip|card|phone) ([^>]*)>")
_TOKEN = re.compile(r"[^\s\"'<>|,;!?]+")
_SHAPE = str.maketrans("0123456789" + "abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "9" * 10 + "a" * 26 + "A" * 26)
_RUN = re.compile(r"(.)\1+")
_BUCKETS = (0, 1, 2, 3, 4, 5, 7, 10, 12, 13, 20)
LABELS = ("outside", *KINDS)
EDGE = ("edge",)


def tokens(line: str, start: int = 0) -> list[tuple[int, int, str]]:
    """(start, end, word) of words(line)."""
    return [(start + m.start(), start + m.start() + len(w), w) for m in _TOKEN.finditer(line) if (w := m[0].rstrip(".:"))]


def words_of(line: str) -> list[str]:
    """Words without the punctuation that ends them."""
    found = _TOKEN.findall(line)
    return [w for m in found if (w := m if m[-1] not in ".:" else m.rstrip(".:"))] if "." in line or ":" in line else found


def shape_features(word: str) -> tuple[str, ...]:
    digits = sum(map(word.count, "0123456789"))
    first = word[0] if word[0] in "+(@0" else "9" if word[0].isdigit() else "a"
    if not digits and "@" not in word:
        return ("plain", f"p={first}")
    shape = "".join("a" if c.isalpha() and c > "\x7f" else c for c in word.translate(_SHAPE))
    short = _RUN.sub(r"\1", shape)[:24]
    check = f"luhn={luhn(x)}" if 13 <= len(x := word.replace("-", "").replace(".", "")) <= 19 and x.isascii() and x.isdigit() else "short"
    pure = f"pure={digits}" if digits == len(word) and digits < 20 else f"pure={digits == len(word)}"
    return (f"s={short}", pure, f"d={max(b for b in _BUCKETS if b <= digits)}", f"dots={shape.count('9.9')}", f"at={'@' in word}", f"dash={word.count('-')}", f"p={first}", f"alpha={'a' in shape or 'A' in shape}", f"full={shape}" if len(shape) <= 19 else "full=long", check)


def features(own: tuple[str, ...], before: tuple[str, ...], after: tuple[str, ...]) -> list[str]:
    return [*own, *(f"<{x}" for x in before[:3]), *(f">{x}" for x in after[:3])]


class RandomField:
    """Weights of features x labels and of label pairs; start weights. What a word's shape gives to itself and to its
    neighbours is added up once for each shape, so that emissions of a batch are three gathers."""

    #: Distinct words that are remembered, and shapes.
    LIMIT, SHAPES = 150_000, 50_000

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.names, self.emit, self.move, self.start = names, emit, move, start
        # Moves shifted by what a label's move to "outside" is worth, so that leaving any span costs the same.
        shift = move[:, 0] - move[0, 0]
        level = move - shift[:, None] + shift
        #: The most that arriving at a label can be worth; the same at the begin of a line.
        self.arrive = level.max(0) - move[0, 0]
        self.begin = np.maximum(self.arrive, start + shift - start[0])
        #: The most that a span loses by not reaching into the word before, and by not reaching to the end of a line.
        self.reach, self.end = max(0.0, float((level[1:, 1:] - level[0, 1:]).max())), max(0.0, float((-shift).max()))
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.shapes: dict[tuple, int] = {}
        self.tables = np.zeros((3, 0, len(LABELS)))
        self.rows: list[np.ndarray] = []
        self.number_of(EDGE)
        self.letters = self.number_of(shape_features("a"))

    def number_of(self, shape: tuple[str, ...]) -> int:
        if shape not in self.shapes:
            self.shapes[shape] = len(self.rows)
            given = (shape, [f"<{x}" for x in shape[:3]], [f">{x}" for x in shape[:3]])
            self.rows.append(np.stack([self.emit[[n for f in some if (n := self.names.get(f)) is not None]].sum(0) for some in given]))
        return self.shapes[shape]

    def numbered(self, words: list[str]) -> list[int]:
        out = list(map(self.numbers.get, words))
        for i, n in enumerate(out):
            if n is None:
                w = words[i]
                n = out[i] = self.letters if w.isalpha() else self.number_of(shape_features(w))
                if len(w) <= 64:
                    self.numbers[w] = n
        return out

    def scores(self, lines: list[list[str]]) -> np.ndarray:
        """Emissions of the words of all lines, one after the other."""
        if len(self.shapes) > self.SHAPES:
            self._forget()
        if len(self.numbers) > self.LIMIT:
            self.numbers.clear()
        numbers = np.array(self.numbered(list(chain.from_iterable(lines))), np.int64)
        if len(self.rows) > self.tables.shape[1]:
            self.tables = np.stack(self.rows, 1)
        at = np.arange(len(numbers)) + np.repeat(np.arange(1, len(lines) + 1), list(map(len, lines)))
        flat = np.zeros(len(numbers) + len(lines) + 1, np.int64)  # an edge, which is 0, before, between and after lines
        flat[at] = numbers
        return self.tables[0][flat[at]] + self.tables[1][flat[at - 1]] + self.tables[2][flat[at + 1]]

    def undecided(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which words may be in a span on a best path. A word is cold if no label is worth arriving at it. A span that holds
        cold words can end before the first of them, or, if a word that isn't cold follows them, be cut there; as that
        costs `reach` at most, a word is surely outside if it and the cold words after it lose more than that together."""
        cold = np.where(first[:-1, None], self.begin, self.arrive)
        cold = (emit - emit[:, :1] + cold)[:, 1:].max(1)
        stop = np.append(cold >= 0, True) | first  # after a cold word: one that isn't, or another line
        stops = np.flatnonzero(stop)
        after = stops[np.searchsorted(stops, np.arange(len(cold)), side="right")]
        total = np.concatenate([[0.0], np.cumsum(cold)])
        loss = total[after] - total[:-1]
        return (cold >= 0) | (loss + np.where(first[after], self.end, self.reach) >= -1e-6)

    def decode(self, lines: list[list[str]]) -> np.ndarray:
        """The best labels of all words, one line after the other, by Viterbi. Words that are surely outside cut lines into
        runs, and the runs of a batch go in lockstep, longest first."""
        n = np.array([len(line) for line in lines], np.int64)
        labels = np.zeros(int(n.sum()), np.int8)
        if not len(labels):
            return labels
        emit = self.scores(lines)
        first = np.zeros(len(labels) + 1, bool)
        first[np.cumsum(n) - n] = True
        first[-1] = True  # where lines begin; the end begins one that isn't there
        open_ = self.undecided(emit, first)
        begin = np.flatnonzero(open_ & (first[:-1] | ~np.concatenate([[False], open_[:-1]])))
        if not len(begin):
            return labels
        stop = ~open_ | first[:-1]
        stops = np.append(np.flatnonzero(stop), len(labels))
        end = stops[np.searchsorted(stops, begin, side="right")]
        order = np.argsort(begin - end, kind="stable")
        begin, end = begin[order], end[order]
        length = end - begin
        best = np.where(first[begin][:, None], self.start, self.move[0]) + emit[begin]
        back = {}
        for t in range(1, int(length[0])):
            live = int(np.searchsorted(-length, -t, side="left"))
            ways = best[:live, :, None] + self.move
            back[t] = ways.argmax(1).astype(np.int8)
            best[:live] = ways.max(1) + emit[begin[:live] + t]
        best += np.where(first[end][:, None], 0.0, self.move[:, 0])
        now = best.argmax(1)
        for t in range(int(length[0]) - 1, -1, -1):
            live = int(np.searchsorted(-length, -t, side="left"))
            labels[begin[:live] + t] = now[:live]
            if t:
                now[:live] = back[t][np.arange(live), now[:live]]
        return labels


def labelled_rows(table: str = LABELLED) -> list[tuple[list[str], list[int]]]:
    rows = []
    for line in table.strip().split("\n"):
        text, spans = unmarked(line)
        found = tokens(text)
        rows.append(([w for _, _, w in found], [next((1 + k for s, k, e in spans if s <= a < e), 0) for a, _, _ in found]))
    return rows


def unmarked(line: str) -> tuple[str, list[tuple[int, int, int]]]:
    """A line of a labelled table as its text and its spans (start, kind's number, end)."""
    text, spans, at = "", [], 0
    for m in _MARK.finditer(line):
        text += line[at : m.start()]
        spans.append((len(text), KINDS.index(m[1]), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    return text + line[at:], spans


def train(rows: list[tuple[list[str], list[int]]], rounds: int = 300, rate: float = 0.1, decay: float = 0.02) -> RandomField:
    """Maximum likelihood with a quadratic penalty, Adam, all rows at once (forward and backward in lockstep)."""
    names: dict[str, int] = {}
    of = []
    for words, _ in rows:
        shapes = [EDGE, *map(shape_features, words), EDGE]
        of.append([[names.setdefault(f, len(names)) for f in features(shapes[i + 1], shapes[i], shapes[i + 2])] for i in range(len(words))])
    k, width, n = len(LABELS), max(len(w) for w, _ in rows), len(rows)
    y = np.zeros((n, width), int)
    real = np.zeros((n, width), bool)
    x = np.zeros((n * width, len(names)))
    for r, (_, labels) in enumerate(rows):
        for i, label in enumerate(labels):
            x[r * width + i, of[r][i]] = 1
            y[r, i], real[r, i] = label, True
    theta = [np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k)]
    first, second = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    one = np.eye(k)
    by_feature = lambda node: x.T @ node.reshape(-1, k)
    seen = [by_feature(one[y] * real[..., None]), np.einsum("rti,rtj->ij", one[y[:, :-1]], one[y[:, 1:]] * real[:, 1:, None]), one[y[:, 0]].sum(0)]
    for step in range(1, rounds + 1):
        emit, move, start = (x @ theta[0]).reshape(n, width, k), theta[1], theta[2]
        alpha, beta = np.zeros((n, width, k)), np.zeros((n, width, k))
        alpha[:, 0] = start + emit[:, 0]
        for t in range(1, width):
            z = alpha[:, t - 1, :, None] + move
            m = z.max(1)
            alpha[:, t] = np.where(real[:, t, None], m + np.log(np.exp(z - m[:, None]).sum(1)) + emit[:, t], alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            z = move + (emit[:, t + 1] + beta[:, t + 1])[:, None, :]
            m = z.max(2)
            beta[:, t] = np.where(real[:, t + 1, None], m + np.log(np.exp(z - m[..., None]).sum(2)), 0)
        top = alpha[:, -1].max(1)
        log_z = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(1))
        node = np.exp(alpha + beta - log_z[:, None, None]) * real[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + move + (emit + beta)[:, 1:, None, :] - log_z[:, None, None, None]) * real[:, 1:, None, None]
        grads = [seen[0] - by_feature(node), seen[1] - pair.sum((0, 1)), seen[2] - node[:, 0].sum(0)]
        for p, g, a, b in zip(theta, grads, first, second, strict=True):
            g = g - decay * p
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return RandomField(names, *theta)


@lru_cache(maxsize=1)
def trained() -> RandomField:
    return train(labelled_rows())


#: Words that are decoded together, about.
BATCH_WORDS = 200_000


def added_spans(texts: list[str], field: RandomField) -> dict[int, list[tuple[int, int, int]]]:
    """For each text with some, the spans (start, kind's number, end) that the field sees. All lines are decoded."""
    out: dict[int, list] = {}
    lines, places, held = [], [], 0

    def decoded() -> None:
        labels = field.decode(lines)
        hits = np.flatnonzero(labels)
        if len(hits):
            first = np.cumsum([0, *map(len, lines)])
            for line in np.unique(np.searchsorted(first, hits, side="right") - 1).tolist():
                owner, at, end = places[line]
                own = labels[first[line] : first[line + 1]].tolist()
                found, k = tokens(texts[owner][at:end], at), 0
                while k < len(own):
                    j = k
                    if own[k]:
                        while j + 1 < len(own) and own[j + 1] == own[k] and texts[owner][found[j][1] : found[j + 1][0]].isspace():
                            j += 1
                        out.setdefault(owner, []).append((found[k][0], own[k] - 1, found[j][1]))
                    k = j + 1

    for i, t in enumerate(texts):
        at = 0
        for line in t.split("\n"):
            if words := words_of(line):
                lines.append(words)
                places.append((i, at, at + len(line)))
                held += len(words)
            at += len(line) + 1
            if held >= BATCH_WORDS:
                decoded()
                lines, places, held = [], [], 0
    decoded()
    return out


def all_spans(texts: list[str], field: RandomField) -> list[tuple[list, list]]:
    """For each text its base spans, and those together with what the field adds where no base span lies."""
    base, seen = [base_spans(t) for t in texts], added_spans(texts, field)
    out = []
    for i, b in enumerate(base):
        more = [x for x in seen.get(i, ()) if not any(s < x[2] and x[0] < e for s, _, e in b)]
        out.append((b, sorted(b + more) if more else b))
    return out


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])


def op10_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, all spans and their number of every row of docs(doc_id, text)."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(trained())  # a few hundred weights, whatever the input

    def find(batches) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            both = all_spans(texts, held.value)
            counts = [[sum(k == kind for _, k, _ in b) for b, _ in both] for kind in range(len(KINDS))]
            yield record(_OUT, ids, *counts, [sha256(joined(b).encode()).hexdigest() for b, _ in both], [joined(a) for _, a in both], [len(a) for _, a in both])

    return id_and_text(docs).mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked(text: str, spans: list) -> str:
    """The text with each span (and what overlaps it) replaced by its kind in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += (text[at:s], f"[{KINDS[k].upper()}]")
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with its personal data masked; the same columns, null texts stay null and n_chars follows where there is one."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(trained())

    def mask(series: Iterator) -> Iterator:
        import pandas as pd

        for texts in series:
            given = [t or "" for t in texts]
            yield pd.Series([None if t is None else masked(t, a) for t, (_, a) in zip(texts, all_spans(given, held.value), strict=True)], dtype=object)

    out = docs.withColumn("text", F.pandas_udf(mask, "string", F.PandasUDFType.SCALAR_ITER)("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
