"""Quality classifier: a generalised additive model with pairwise interactions, by cyclic boosting of shallow trees.

Each text becomes a few counts and ratios that no language decides. Features are cut into bins at quantiles of the
training rows; the trees that boosting adds for one feature, in turn, and later for one pair of features, sum up to a
lookup table. A score is the logistic of the intercept plus one table entry per feature and pair.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key, tidied, tidy

FEATURES = (
    "log_words", "word_bytes", "upper", "shouted", "symbols", "bars", "digits", "points", "blanks", "high_bytes",
    "distinct", "commonest", "stutter", "repeated_lines", "line_words", "word_symbols", "entropy", "squeezed",
)
#: Labelled rows that the model is fitted on at most; the ids with the smallest hashes are taken.
SAMPLE = 20_000
#: Documents with this remainder of crc32(doc_id) never train.
FOLDS, HELD = 5, 0
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 48, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST_ROWS = 160, 60, 0.12, 4, 8
_UPPER, _LOWER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_SYMBOL, _POINT = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#$%&*+<=>@\\^_`{}~[]|!/")], _POINT[list(b".,;:?'\"()-")] = True, True
#: Bytes of a text that are squeezed at once; of longer texts each such piece is, and the sizes are summed.
_SQUEEZE = 1 << 15


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; all are 0 for null and empty ones."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, m = len(raw), len(words)
    letters = max(1, int(counts[_UPPER | _LOWER].sum() + counts[128:].sum() // 2))
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = counts[counts > 0] / n
    odd = sum(c for w, c in seen.items() if not w.isalnum() and _SYMBOL[w[-1]])
    loud = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    return [
        float(np.log1p(m)), (n - int(counts[[32, 10, 9, 13]].sum())) / m, float(counts[_UPPER].sum()) / letters, loud / m,
        float(counts[_SYMBOL].sum()) / n, float(counts[124]) / m, float(counts[_DIGIT].sum()) / n, float(counts[_POINT].sum()) / n,
        float(counts[32]) / n, float(counts[128:].sum()) / n,
        len(seen) / m, max(seen.values()) / m, sum(map(bytes.__eq__, words, words[1:])) / m, 1 - len(set(lines)) / max(1, len(lines)), m / max(1, len(lines)), odd / m,
        float(-(p * np.log2(p)).sum()), sum(len(zlib.compress(raw[i : i + _SQUEEZE], 1)) for i in range(0, n, _SQUEEZE)) / n,
    ]


def features_of(texts: Iterable[str | None]) -> np.ndarray:
    """FEATURES of texts, by row; equal texts are measured once."""
    seen: dict = {}
    rows = []
    for t in texts:
        if (f := seen.get(t)) is None:
            f = seen[t] = features(t)
        rows.append(f)
    return np.array(rows, float).reshape(-1, len(FEATURES))


def fold(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string")) % of


def sample_ids(labels: DataFrame, column: str, train: Column, most: int) -> DataFrame:
    """At most ``most`` (doc_id, y) with a label, by the smallest hashes; of several labels of a doc_id the largest counts."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & train).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


@dataclass
class Additive:
    """cuts by feature; tables by feature; (i, j, cuts_i, cuts_j, table) by pair."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for i, (c, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += t[np.searchsorted(c, x[:, i], "right")]
        for i, j, a, b, t in self.pairs:
            z += t[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree of LEAVES leaves over one feature's bins, by gain: its value for each bin."""
    gs, hs, ns = (np.concatenate([[0.0], np.cumsum(v)]) for v in (g, h, n))
    worth = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + 1.0)
    parts = [(0, len(g))]
    for _ in range(LEAVES - 1):
        best = (1e-9, None, None)
        for p in parts:
            k = np.arange(p[0] + 1, p[1])
            k = k[(ns[k] - ns[p[0]] >= LEAST_ROWS) & (ns[p[1]] - ns[k] >= LEAST_ROWS)]
            if len(k):
                gain = worth(p[0], k) + worth(k, p[1]) - worth(*p)
                if gain[w := int(np.argmax(gain))] > best[0]:
                    best = (float(gain[w]), p, int(k[w]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + 1.0)
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree with one cut in a pair's first feature and one in each half's second: its values, and its gain."""
    value, gain = np.zeros_like(g), 0.0
    gr, hr = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    whole = gr[-1, -1] ** 2 / (hr[-1, -1] + 1)
    for k in range(1, g.shape[0]):
        made, sides = 0.0, []
        for a, b in ((0, k), (k, g.shape[0])):
            gl, hl = gr[b - 1] - (gr[a - 1] if a else 0), hr[b - 1] - (hr[a - 1] if a else 0)
            worth = gl[:-1] ** 2 / (hl[:-1] + 1) + (gl[-1] - gl[:-1]) ** 2 / (hl[-1] - hl[:-1] + 1)
            w = int(np.argmax(worth))
            made += worth[w]
            sides.append((a, b, w + 1, gl[w] / (hl[w] + 1), (gl[-1] - gl[w]) / (hl[-1] - hl[w] + 1)))
        if made - whole > gain:
            gain, value = made - whole, np.zeros_like(g)
            for a, b, cut, low, high in sides:
                value[a:b, :cut], value[a:b, cut:] = low, high
    return value, float(gain)


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """The model of rows x and labels y. With no row or only one label, the score is that base rate (0.5 without rows)."""
    rate = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    z = np.full(len(y), np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.zeros(0) for i in range(len(FEATURES))]
    model = Additive(float(np.log(rate / (1 - rate))), cuts, [np.zeros(len(c) + 1) for c in cuts], [])
    if not len(y) or y.min() == y.max():
        return model
    at = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(cuts)]
    sizes = [np.bincount(b, minlength=len(t)) for b, t in zip(at, model.tables, strict=True)]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for b, n, t in zip(at, sizes, model.tables, strict=True):
            g, h = slopes()
            add = RATE * _tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), n)
            t += add
            z += add[b]
    coarse = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for i in range(len(FEATURES))]
    cell = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(coarse)]

    def sums(i: int, j: int) -> list[np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        k = cell[i] * shape[1] + cell[j]
        return [np.bincount(k, v, shape[0] * shape[1]).reshape(shape) for v in slopes()]

    many = range(len(FEATURES))
    gains = sorted(((_tree2(*sums(i, j))[1], i, j) for i in many for j in many if i < j and len(coarse[i]) and len(coarse[j])), reverse=True)
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, _a, _b, t in model.pairs:
            add = RATE * _tree2(*sums(i, j))[0]
            t += add
            z += add[cell[i], cell[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """Fit on at most ``sample`` labelled doc_ids that aren't held out, one row of each; the driver gets only features of those."""
    chosen = sample_ids(labels, "quality", fold(F.col("doc_id"), FOLDS) != HELD, sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features_of(batch.column(1).to_pylist())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel())), batch.column(2)], ["doc_id", "x", "y"])

    # of rows with one doc_id, one trains: the sample bounds what the driver gets however often a row is repeated
    told = texts.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, x array<double>, y int")
    rows = told.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("k")).select("doc_id", "k.x", "k.y").toArrow().to_pydict()
    x, y = np.array(rows["x"], float).reshape(-1, len(FEATURES)), np.array(rows["y"], float)
    order = np.lexsort([*x.T, np.array(rows["doc_id"], np.int64)])  # the model must not depend on the order of rows
    return fit(x[order], y[order])


def scorer(model: Additive):
    """A function from a text column to its scores."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = pd.Series(model.score(features_of(texts)))
        tidy()
        return out

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text_key, held_out, score, predicted) of each row of ``docs(doc_id, text)``.

    Labels come from ``labels(doc_id, quality)``, from rows that aren't held out, at most ``sample`` of them. Null texts
    are empty, and empty ones are scored like others. A null doc_id counts as held out; repeated rows each get a row,
    with equal values; other columns are not read; an empty table gives no rows. Without labels every score is 0.5.
    """
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(True))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), held.alias("held_out"), scorer(train(docs, labels, sample))("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns; no row is moved to decide."""
    return docs.where(scorer(train(docs, labels))("text") >= threshold)
