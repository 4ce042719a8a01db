"""Toxicity by cumulative-link ordinal regression over sparse text features.

Severity has the grades 0 to GRADES - 1. A labelled clean document has grade 0; a labelled toxic one has grade 1 to
GRADES - 1 by how dense its strong terms are, in equal parts of the toxic training rows. The model is
P(grade <= k) = logistic(t_k - w.x): one weight vector for all ordered thresholds t_0 < t_1 < ... The expected severity
is the sum of P(grade > k).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, text_key, tidied, written
from .quality import fold, sample_ids

#: Labelled rows that the model is fitted on at most; those with the smallest hashes of their ids are taken.
SAMPLE = 20_000
FOLDS, HELD = 5, 0
GRADES = 4
#: Terms that get a weight at most; in how many training rows one must occur, how many standard errors more often in toxic
#: ones, and what share of its rows must be toxic. Words count, and their starts of so many characters.
TERMS, LEAST_ROWS, LEAST_Z, LEAST_SHARE, STARTS = 2_000, 4, 4.0, 0.6, (4, 5, 6, 7)
#: Terms this many standard errors more often in toxic rows are strong: that one occurs, and how densely, are terms too.
STRONG_Z = 8.0
#: A document is called toxic if grade 0 has a probability below this.
CLEAN = 0.5
_STEPS, _RATE, _L2 = 400, 0.1, 1e-5
#: Stands for all words without a weight, which only count towards density; no word can be this.
_OTHERS = b" "
_STRIP = b".,;:!?\"'()[]{}<>*#$%&|-_/\\=+~`^@"


def terms_of(text: str | None) -> Counter:
    """Counts of a text's words, A-Z lower-cased and without punctuation at their ends, and of their starts, with a star."""
    words: Counter = Counter()
    for x, n in Counter((text or "").encode("utf-8", "replace").lower().split()).items():
        if w := x.strip(_STRIP):
            words[w] += n
            if len(w) > STARTS[0]:
                u = w.decode("utf-8", "replace")
                for k in STARTS:
                    if len(u) > k:
                        words[u[:k].encode() + b"*"] += n
    return words


@dataclass
class Ordinal:
    """Weights by term, on whether it occurs; ascending thresholds; strong terms and the levels of their density."""

    weights: dict[bytes, float]
    thresholds: np.ndarray
    strong: frozenset[bytes] = frozenset()
    levels: tuple[float, ...] = ()

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, from w.x."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -35, 35)))

    def logit(self, terms: Counter) -> float:
        get = self.weights.get
        return math.fsum(w for t in [*terms, *marks(terms, self.strong, self.levels)] if (w := get(t)))


def density(terms: Counter, strong: frozenset[bytes]) -> float:
    """Occurrences of strong terms for each word."""
    return sum(terms[t] for t in terms.keys() & strong) / max(1, sum(n for t, n in terms.items() if t[-1:] != b"*"))


def marks(terms: Counter, strong: frozenset[bytes], levels: tuple[float, ...]) -> list[bytes]:
    """Terms of the whole text: how many of the levels the density of strong ones reaches; level 0 is that there is any."""
    d = density(terms, strong)
    return [b"\0%d" % k for k, level in enumerate((0.0, *levels)) if d > level]


def grades(y: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, tuple[float, ...]]:
    """Each row's grade, toxic ones cut into equal parts by density, and the levels of the cuts."""
    y, toxic = y.astype(int), dense[y > 0]
    levels = np.quantile(toxic, [k / (GRADES - 1) for k in range(1, GRADES - 1)])
    y[y > 0] = 1 + np.searchsorted(levels, toxic, "left")
    return y, tuple(levels.tolist())


def fit(rows: list[tuple[Counter, int]]) -> Ordinal:
    """The model of (terms, toxic) rows. Without rows of both labels it has no weights and calls nothing toxic."""
    n1 = sum(t for _, t in rows)
    n0 = len(rows) - n1
    if not n1 or not n0:
        return Ordinal({}, np.arange(GRADES - 1) + 4.0)
    with1, with0 = Counter(), Counter()
    for c, t in rows:
        (with1 if t else with0).update(c.keys())
    worth: dict[bytes, float] = {}
    for w in with1.keys() | with0.keys():
        a, b = with1[w], with0[w]
        p = (a + b) / len(rows)
        z = (a / n1 - b / n0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
        if a + b >= LEAST_ROWS and z >= LEAST_Z and a >= LEAST_SHARE * (a + b):
            worth[w] = z
    chosen = sorted(worth, key=lambda w: (-worth[w], w))[:TERMS]
    at = {w: i for i, w in enumerate(chosen)}
    strong = frozenset(w for w in chosen if worth[w] >= STRONG_Z)
    y, levels = grades(np.array([t for _, t in rows]), np.array([density(c, strong) for c, _ in rows]))
    for k in range(GRADES - 1):
        at[b"\0%d" % k] = len(at)
    hits = [(i, at[w]) for i, (cs, _) in enumerate(rows) for w in [*cs, *marks(cs, strong, levels)] if w in at]
    r, c = np.array(hits, np.int64).reshape(-1, 2).T
    weights, thresholds = _descend(r, c, y, list(at))
    return Ordinal(weights, thresholds, strong, levels)


def thresholds_of(free: np.ndarray) -> np.ndarray:
    """Thresholds from a first value and what their gaps come from; gaps are positive, so thresholds stay in order."""
    return free[0] + np.concatenate([[0.0], np.cumsum(np.logaddexp(0, free[1:]))])


def loss(w: np.ndarray, free: np.ndarray, r: np.ndarray, c: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of grades y, and its slopes by w and free; row r[i] has term c[i]."""
    n, m, t, top = len(y), len(w), thresholds_of(free), len(free)
    z = np.bincount(r, w[c], n)
    sig = 1 / (1 + np.exp(-np.clip(np.concatenate([np.full((n, 1), -40.0), t[None, :] - z[:, None], np.full((n, 1), 40.0)], 1), -40, 40)))
    k = np.arange(n)
    high, low = sig[k, y + 1], sig[k, y]
    p = np.maximum(high - low, 1e-12)
    dh, dl = high * (1 - high) / p, low * (1 - low) / p
    gt = np.array([(dl[y == j + 1].sum() - dh[y == j].sum()) / n for j in range(top)])
    gf = np.concatenate([[gt.sum()], [gt[j:].sum() / (1 + math.exp(-free[j])) for j in range(1, top)]])
    return -float(np.log(p).mean()), np.bincount(c, ((dh - dl) / n)[r], m), gf


def _descend(r: np.ndarray, c: np.ndarray, y: np.ndarray, chosen: list[bytes]) -> tuple[dict[bytes, float], np.ndarray]:
    """Projected Adam. Weights stay at 0 or above: every term was chosen as one that speaks for a higher grade."""
    m = len(chosen)
    w, free = np.zeros(m), np.array([2.0] + [0.0] * (GRADES - 2))
    moments = [np.zeros(m + GRADES - 1) for _ in range(2)]
    for step in range(1, _STEPS + 1):
        _, gw, gf = loss(w, free, r, c, y)
        g = np.concatenate([gw + _L2 * w, gf])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = _RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-7)
        w = np.maximum(w - move[:m], 0)
        free = free - move[m:]
    return {k: float(v) for k, v in zip(chosen, w, strict=True) if v}, thresholds_of(free)


COUNTS = "term binary, n long, n1 long"
ROWS = "doc_id long, terms array<binary>, counts array<long>, others long, y int"


@tidied
def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, n1 = Counter(), Counter()
        for t, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            terms = terms_of(t).keys()
            n.update(terms)
            if y:
                n1.update(terms)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([n1[w] for w in n], pa.int64())], ["term", "n", "n1"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Fit on at most ``sample`` labelled doc_ids that aren't held out, one row of each; the driver gets only chosen terms of those."""
    chosen = sample_ids(labels, "toxic", fold(F.col("doc_id"), FOLDS) != HELD, sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    # of rows with one doc_id, one trains: the sample bounds what is stored and sent however often a row is repeated
    texts = written(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")), "toxic-sample")
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1")).first()
    n1 = int(size.n1 or 0)
    n0 = int(size.n) - n1
    if not n1 or not n0:
        forget(texts)
        return fit([])
    some = texts.mapInArrow(_term_counts, COUNTS).groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).where(f"n >= {LEAST_ROWS}")
    share = F.col("n") / (n0 + n1)
    z = (F.col("n1") / n1 - (F.col("n") - F.col("n1")) / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    some = some.where((z >= LEAST_Z) & (F.col("n1") >= LEAST_SHARE * F.col("n")))
    top = {bytes(r.term) for r in some.orderBy(-z, "term").limit(TERMS).select("term").collect()}

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [terms_of(t) for t in batch.column(1).to_pylist()]
            kept = [{w: c[w] for w in c.keys() & top} for c in every]
            words = [sum(n for w, n in c.items() if w[-1:] != b"*" and w not in top) for c in every]
            cols = [batch.column(0), pa.array([sorted(c) for c in kept], pa.list_(pa.binary())), pa.array([[c[w] for w in sorted(c)] for c in kept], pa.list_(pa.int64())), pa.array(words, pa.int64()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in ROWS.split(", ")])

    rows = texts.mapInArrow(run, ROWS).toArrow().sort_by("doc_id").to_pylist()
    forget(texts)
    return fit([(Counter(dict(zip(r["terms"], r["counts"], strict=True)) | {_OTHERS: r["others"]}), r["y"]) for r in rows])


SCORES = "doc_id long, text_key long, severity double, p_toxic double, grade int"


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """SCORES of each row of ``docs(doc_id, text)``, with held_out and toxic (0 or 1) added.

    severity is the expected grade, grade the likeliest one, p_toxic the probability of any grade above 0. Null texts are
    empty; empty ones get what the thresholds alone say. A null doc_id counts as held out; repeated rows each get a row
    with equal values; other columns are not read; an empty table gives no rows. Without labels nothing is toxic.
    """
    model = train(docs, labels, sample)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict = {}
            texts = batch.column(2).to_pylist()
            for t in texts:
                if t not in seen:
                    seen[t] = model.logit(terms_of(t))
            above = model.above(np.array([seen[t] for t in texts], float))
            each = -np.diff(np.concatenate([np.ones((len(texts), 1)), above, np.zeros((len(texts), 1))], 1), axis=1)
            arrays = [batch.column(0), batch.column(1), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(each.argmax(1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SCORES.split(", ")])

    out = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("text_key"), "text").mapInArrow(run, SCORES)
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(True))
    return out.withColumn("held_out", held).withColumn("toxic", (F.col("p_toxic") >= 1 - CLEAN).cast("int"))
