"""Quality classifier: a generalised additive model with pairwise interactions (operator 8).

Features are figures of the whole text. Each is cut into quantile bins, and cyclic boosting goes round the features
again and again: a shallow tree (at most four leaves) over one feature's bins is fitted to the gradient and added, at a
small rate, to that feature's lookup table. Then the pairs of features that explain most of what is left get tables of
their own, grown by trees with one split on each side. A score is the sum of table entries, one addition for each
feature and pair, through the logistic function.

Labels are learned from rows whose crc32(doc_id as text) mod 5 isn't 0, and of those from at most `rows` (20,000 by
default): the ones with the smallest xxhash64 of doc_id. Labels, lang, source and doc_id are no features.

Cases: null text is empty, and empty text has a score like any other; a null doc_id counts as held out; labels that are
null are left out, and of several labels of a document the largest holds; without labelled rows of both kinds every
score is the share of ones, or 0.5; rows are independent; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import blocks, id_and_text, record, ship, written

FEATURES = (
    "log_bytes", "upper", "lower", "digit", "blank", "feed", "stop_comma", "other_mark", "symbol", "bar", "loud", "wide", "log_words", "word_length", "short_words",
    "long_words", "distinct_words", "top_word", "line_length", "repeated_lines", "entropy", "caps_words",
)
_GROUPS = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789", "blank": " \t", "feed": "\n\r", "stop_comma": ".,", "other_mark": ";:?'\"()-", "symbol": "#$%&*@~^=+<>_/\\{}[]`", "bar": "|", "loud": "!"}
_MASK = np.zeros((256, len(_GROUPS) + 1))
for _i, _letters in enumerate(_GROUPS.values()):
    _MASK[[ord(c) for c in _letters], _i] = 1
_MASK[128:, -1] = 1


def features(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / n
    some = share[share > 0]
    words = text.split()
    k = max(1, len(words))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    lines = text.split("\n")
    return [
        float(np.log1p(len(raw))), *(share @ _MASK).tolist(), float(np.log1p(len(words))), float(sizes.mean()) if words else 0.0, float((sizes <= 3).sum() / k), float((sizes >= 12).sum() / k),
        len(seen) / k, max(seen.values(), default=0) / k, len(text) / len(lines), 1 - len(set(lines)) / len(lines), float(-(some * np.log2(some)).sum()) if raw else 0.0, sum(map(str.isupper, words)) / k,
    ]


@dataclass
class Additive:
    """edges: a row of bin edges for each feature; tables: its values by bin; pairs: (first, second, table)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]) if self.edges else np.zeros((0, len(x)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[b[f]]
        for f, g, table in self.pairs:
            total += table[b[f], b[g]]
        return 1 / (1 + np.exp(-total))


def _gain(g, h, ridge: float = 1.0):
    return g * g / (h + ridge)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best place to cut a run of bins in two, and what it gains."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
    at = int(gains.argmax())
    return float(gains[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A tree over the bins of one feature, as the step to add to each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_split(g[a:b], h[a:b]), i) for i, (a, b) in enumerate(parts)), key=lambda t: t[0])
        if best[0] <= 1e-6:
            break
        a, b = parts.pop(best[2])
        parts += [(a, a + best[1]), (a + best[1], b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut on each side, the second on either half of the first; whichever order gains more. An interaction may show in
    neither side's sums, so first cuts at eighths of the bins are tried beside the best single one."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        whole = _gain(a.sum(), b.sum())
        for at in {_split(a.sum(1), b.sum(1))[1], *(len(a) * k // 8 for k in range(1, 8))} - {0}:
            parts, total = [], -whole
            for lo, hi in ((0, at), (at, len(a))):
                gs, hs = a[lo:hi].sum(0), b[lo:hi].sum(0)
                cut = _split(gs, hs)[1]
                for x, y in ((0, cut), (cut, len(gs))):
                    if x < y:
                        parts.append((lo, hi, x, y, gs[x:y].sum(), hs[x:y].sum()))
                        total += _gain(*parts[-1][4:])
            if total > best[0]:
                step = np.zeros_like(a)
                for lo, hi, x, y, gp, hp in parts:
                    step[lo:hi, x:y] = gp / (hp + 1.0)
                best = (float(total), step.T if turned else step)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, rate: float = 0.1) -> Additive:
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Additive(float(np.log(share / (1 - share))), [], [], [])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    mean = y.mean()
    model = Additive(float(np.log(mean / (1 - mean))), edges, [np.zeros(len(e) + 1) for e in edges], [])
    b = model.bins(x)
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(b[f], y - p, len(table)), np.bincount(b[f], p * (1 - p), len(table)))
            table += step
            total += step[b[f]]
    p = 1 / (1 + np.exp(-total))
    grid = lambda f, g, v: np.bincount(b[f] * len(model.tables[g]) + b[g], v, len(model.tables[f]) * len(model.tables[g])).reshape(len(model.tables[f]), -1)
    found = sorted(((_pair_tree(grid(f, g, y - p), grid(f, g, p * (1 - p)))[0], f, g) for f in range(len(edges)) for g in range(f)), reverse=True)
    model.pairs = [(f, g, np.zeros((len(model.tables[f]), len(model.tables[g])))) for gain, f, g in found[:pairs] if gain > 0]
    for _ in range(pair_rounds):
        for f, g, table in model.pairs:
            p = 1 / (1 + np.exp(-total))
            step = rate * _pair_tree(grid(f, g, y - p), grid(f, g, p * (1 - p)))[1]
            table += step
            total += step[b[f], b[g]]
    return model


_FEATURE_DDL = "doc_id long, x array<double>"


def feature_rows(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            yield record(schema, ids, [features(t) for t in texts])

    return id_and_text(docs).mapInArrow(run, _FEATURE_DDL)


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(x: DataFrame, labels: DataFrame, rows: int = 20_000) -> Additive:
    """The model from feature rows and labels(doc_id, quality); at most `rows` rows come to the driver."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y"))
    sample = x.where(~held_out()).join(known, "doc_id").withColumn("k", F.xxhash64("doc_id")).orderBy("k", "doc_id", "x").limit(rows).select("x", "y").toArrow()
    if not sample.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    flat = sample.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return fit(flat, sample.column("y").to_numpy().astype(float))


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def op8_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1 where score >= threshold) of every row of docs(doc_id, text)."""
    x = written(feature_rows(docs), "features")
    held = docs.sparkSession.sparkContext.broadcast(train(x, labels))  # tables of 48 bins a feature, whatever the input

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield record(_OUT, b.column(0), held.value.score(flat))

    scored = x.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with their columns. The text is read once more for the scores of
    the rows that stay, rather than joined back.

    Cases: null texts are scored as empty and stay null; rows without id, repeated rows and rows with equal ids are each
    scored by their own text; without labels every score is 0.5 and all rows stay; an empty table stays empty; other columns
    may have any names."""
    x = written(feature_rows(docs), "features")
    held = docs.sparkSession.sparkContext.broadcast(train(x, labels))

    def good(series: Iterator) -> Iterator:
        import pandas as pd

        for texts in series:
            flat = np.array([features(t or "") for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(held.value.score(flat) >= threshold)

    return docs.where(F.pandas_udf(good, "boolean", F.PandasUDFType.SCALAR_ITER)(F.col("text")))
