"""LM scoring by class-based bigrams: exchange clustering deals words into classes.

Every word with at least a HEAD-th of all tokens has a class of its own choice. First the WORDS commonest words, and all
others in GROUPS units by their last three bytes, are exchanged between CLASSES classes while the likelihood of the
corpus's class bigrams grows. Then each other word leaves its group's class for the one that gains most by the classes
before and after it, which are counted by shuffle. Words rarer than that, of which no class could be told, stay in their
groups. A token's probability is that of its class after the class before it, times that of its word (or group) in the
class, and in a group times that of the word there, each smoothed. What the driver works on is bounded by HEAD, WORDS
and GROUPS; word counts are not, so words of groups meet their counts in a join.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied, words_of, written

FOLDS, HELD = 7, 2
WORDS, GROUPS, CLASSES, SWEEPS = 1024, 1024, 48, 40
#: A word with at least a 500,000th of all training tokens is one of its own; there are 500,000 at most.
HEAD = 500_000
#: Weight of a class's overall share when what follows a class is estimated, and what is added to each unit's count.
BACK, ADD = 20.0, 0.02
#: Bytes of text that are taken apart at once; a longer text goes alone.
CHUNK = 4 << 20
END = 0


@dataclass
class Tokens:
    """Texts taken apart: for each token its text and its word's place among `words`; place -1 is the end of a text."""

    words: list[bytes]
    place: np.ndarray
    text: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Tokens:
        local: dict[bytes, int] = {}
        put, place, sizes = local.setdefault, [], []
        for t in texts:
            w = words_of(t)
            place += [put(x, len(local)) for x in w]
            place.append(-1)
            sizes.append(len(w) + 1)
        return cls(list(local), np.array(place, np.int64), np.repeat(np.arange(len(sizes)), sizes))

    def hashes(self) -> np.ndarray:
        h = xxhash.xxh64_intdigest
        return np.array([h(w, 42) for w in self.words], np.uint64).astype(np.int64)


def chunks(texts: list[str | None]) -> Iterator[slice]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") < CHUNK):
            size += len(texts[to] or "")
            to += 1
        yield slice(at, to)
        at = to


@dataclass
class Vocabulary:
    """Ids of words: END, then words of their own by falling count, then groups of all others by their last bytes."""

    hashes: np.ndarray  # ascending
    ids: np.ndarray  # of these
    n: np.ndarray  # counts in training, by id of END and own words
    suffix: np.ndarray  # group that an own word would be in, by id
    tokens: int
    types: int

    @property
    def groups(self) -> int:
        """The first group's id."""
        return len(self.n)

    @property
    def size(self) -> int:
        return self.groups + GROUPS

    @functools.cached_property
    def own(self) -> dict[int, int]:
        return dict(zip(self.hashes.tolist(), self.ids.tolist(), strict=True))

    def of(self, tokens: Tokens, hashes: np.ndarray) -> np.ndarray:
        """An id for each of the tokens' words."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == hashes, self.ids[at], 0)
        rest = np.nonzero(out == 0)[0]
        crc, words, first = zlib.crc32, tokens.words, self.groups
        out[rest] = [first + crc(words[i][-3:]) % GROUPS for i in rest.tolist()]
        return out

    def units(self) -> np.ndarray:
        """The unit, in the first exchange, of each id: the WORDS commonest words have their own, others their group's."""
        head = min(WORDS, self.groups - 1) + 1
        of = np.concatenate([np.arange(head), head + self.suffix[head:], head + np.arange(GROUPS)])
        return of.astype(np.int64)


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """The WORDS commonest words, and all with at least a HEAD-th of all tokens, become own ones."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, types = int(total.n) + ends, int(total.v) + (ends > 0)
    top = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(WORDS).select("word").collect()]
    told = counts.where(own_word(tokens, top)).select("word", "n", "suffix").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    word, n, suffix = (told[c].to_numpy().astype(np.int64) for c in ("word", "n", "suffix"))
    order = np.argsort(word)
    out = Vocabulary(word[order], (order + 1).astype(np.int64), np.concatenate([[ends], n]), np.concatenate([[0], suffix]), tokens, types)
    out.top = top
    return out


def own_word(tokens: int, top: list[int]):
    return (F.col("n") * HEAD >= tokens) | F.col("word").isin(top)


def _emit(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "int": pa.int32()}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n, suffix) over all of ``texts(text)``: words by their XXH64; suffix is their group."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).to_pylist()
            for part in chunks(some):
                t = Tokens.of(some[part])
                n = np.bincount(t.place[t.place >= 0], minlength=len(t.words))
                suffix = np.fromiter((zlib.crc32(w[-3:]) % GROUPS for w in t.words), np.int64, len(t.words))
                yield _emit("word long, n long, suffix long", t.hashes(), n, suffix)

    return texts.mapInArrow(run, "word long, n long, suffix long").groupBy("word").agg(F.sum("n").alias("n"), F.min("suffix").alias("suffix"))


TOKENS = "doc_id long, held_out int, n_tokens long, known long, base double, ids array<int>, words array<long>, many array<long>"


def tokenised(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """TOKENS of each row of ``docs(doc_id, held_out, text)``: ids, the last of which is END.

    Words that are not own ones meet their counts later: their hashes are in ``words``, and how often they stand there in
    ``many``. ``known`` and ``base`` are about the others: how many occur in training, and their part of the base score.
    """
    grown = np.log10(v.n + 1.0)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for part in chunks(texts):
                rows = [batch.column(i).slice(part.start, part.stop - part.start) for i in (0, 1)]
                t = Tokens.of(texts[part])
                h, size = t.hashes(), part.stop - part.start
                ids = np.append(v.of(t, h), END)[t.place]
                own = ids < v.groups
                n = np.bincount(t.text, minlength=size)
                base = np.bincount(t.text, np.where(own, grown[np.where(own, ids, 0)], 0.0), size) - n * np.log10(v.tokens + v.types + 1)
                known = np.bincount(t.text, own & (v.n[np.where(own, ids, 0)] > 0), size).astype(np.int64)
                tail = np.nonzero(~own)[0]
                pair, many = np.unique(t.text[tail] * (len(h) + 1) + t.place[tail], return_counts=True)
                text, word = np.divmod(pair, len(h) + 1)
                cut = pa.array(np.searchsorted(text, np.arange(size + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(x, pa.int64())) for x in (h[word] if len(word) else np.zeros(0, np.int64), many)]
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield _emit(TOKENS, *rows, n, known, base, pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32))), *lists)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, TOKENS)


def _before(x: np.ndarray) -> np.ndarray:
    """What is before each token; texts end with END, which so stands before the first token of the next."""
    return np.concatenate([[END], x[:-1]])


def pair_counts(tokens: DataFrame, of: np.ndarray, size: int) -> np.ndarray:
    """How often each of ``size`` kinds follows each, over all of ``tokens(ids)``; ``of`` tells the kind of each id."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = of[batch.column(0).flatten().to_numpy()]
            pair, n = np.unique(_before(u) * size + u, return_counts=True)
            yield _emit("pair long, n long", pair, n)

    got = tokens.select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((size, size))
    out.reshape(-1)[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out


def exchange_rest(tokens: DataFrame, v: Vocabulary, own: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The class of each id after all own words beyond the commonest have been exchanged once, against the class bigrams.

    How often each class stands before and after each word is counted by shuffle, and each word goes to the class that
    gains most by it, to first order, its own share taken out of the class that it is in.
    """
    head, last = min(WORDS, v.groups - 1) + 1, v.groups
    if head >= last:
        return own

    @tidied
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).flatten().to_numpy().astype(np.int64)
            cls = own[ids]
            at = np.nonzero((ids >= head) & (ids < last))[0]
            sides = ids[at] * (2 * CLASSES) + _before(cls)[at], ids[at] * (2 * CLASSES) + CLASSES + cls[np.minimum(at + 1, len(cls) - 1)]
            key, n = np.unique(np.concatenate(sides), return_counts=True)
            yield _emit("key long, n long", key, n)

    f = np.log(np.maximum(grid, 0.5))
    rows, cols = (np.log(np.maximum(grid.sum(k), 0.5)) for k in (1, 0))

    @tidied
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column(1).to_pylist()
            ids = batch.column(0).to_numpy().astype(np.int64)
            x = np.zeros((len(ids), 2 * CLASSES))
            for i, pairs in enumerate(told):
                for p in pairs:
                    x[i, p["c"]] += p["n"]
            left, right = x[:, :CLASSES], x[:, CLASSES:]
            n = left.sum(1)
            gain = left @ f + right @ f.T - n[:, None] * (rows + cols)[None, :]
            a, i = own[ids], np.arange(len(ids))
            less = lambda y: np.log(np.maximum(y, 0.5))
            gain[i, a] = (left * less(grid.T[a] - left)).sum(1) + (right * less(grid[a] - right)).sum(1) - n * (less(grid.sum(1)[a] - n) + less(grid.sum(0)[a] - n))
            gain[:, 0] = -np.inf  # END is alone
            yield _emit("id long, c long", ids, gain.argmax(1))

    counted = tokens.select("ids").mapInArrow(contexts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    by_word = counted.groupBy(F.expr(f"key div {2 * CLASSES}").alias("id")).agg(F.collect_list(F.struct((F.col("key") % (2 * CLASSES)).alias("c"), "n")).alias("pairs"))
    got = by_word.mapInArrow(best, "id long, c long").toArrow()
    out = own.copy()
    out[got["id"].to_numpy()] = got["c"].to_numpy()
    return out


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each unit of a square matrix of bigram counts; END is alone in class 0.

    Units start in classes by frequency rank. Each, in order of frequency, goes to the class that gains most, until a
    sweep moves none. The likelihood is that of class bigrams: the sum of n log n over them, less that over their margins.
    """
    size = len(pairs)
    total = pairs.sum(0) + pairs.sum(1)
    order = [int(u) for u in np.argsort(-total, kind="stable") if u != END and total[u]]
    own = np.zeros(size, np.int64)
    own[[u for u in range(size) if u != END]] = 1
    for k, u in enumerate(order):
        own[u] = 1 + k % (classes - 1)
    member = np.zeros((size, classes))
    member[np.arange(size), own] = 1
    after, before = pairs @ member, pairs.T @ member  # by unit: counts to, and from, each class
    both = member.T @ after
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    for _ in range(sweeps):
        moved = 0
        for u in order:
            a, s = own[u], pairs[u, u]
            r, c = after[u].copy(), before[u].copy()
            r[a] -= s
            c[a] -= s
            both[a] -= r
            both[:, a] -= c
            both[a, a] -= s
            rows, cols, grid = both.sum(1), both.sum(0), f(both)
            gain = (f(both + r) - grid).sum(1) + (f(both + c[:, None]) - grid).sum(0)
            d = both.diagonal()
            gain += f(d + r + c + s) - f(d + r) - f(d + c) + f(d)
            gain -= f(rows + r.sum() + s) - f(rows) + f(cols + c.sum() + s) - f(cols)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            both[b] += r
            both[:, b] += c
            both[b, b] += s
            if b != a:
                moved += 1
                own[u] = b
                after[:, a] -= pairs[:, u]
                after[:, b] += pairs[:, u]
                before[:, a] -= pairs[u]
                before[:, b] += pairs[u]
        if not moved:
            break
    return own


@dataclass
class Model:
    """Logarithms to base 10: of a class after a class, of an id in its class, and of a group's words' common divisor."""

    units: Vocabulary
    own: np.ndarray
    follows: np.ndarray
    emits: np.ndarray
    divisor: np.ndarray

    def scores(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of texts that begin at ``starts``; sums of log10(n + 1) over words of groups, n their counts, are missing."""
        cls = self.own[ids]
        each = self.follows[_before(cls), cls] + (self.emits - self.divisor)[ids]
        return np.add.reduceat(each, starts) if len(starts) else np.zeros(0)


def learn(tokens: DataFrame, counts: DataFrame, v: Vocabulary) -> Model:
    """The model of all of ``tokens(ids)``, whose word_counts are given."""
    of = v.units()
    pairs = pair_counts(tokens, of, int(of.max()) + 1)
    member = exchange(pairs, CLASSES, SWEEPS)
    onehot = np.zeros((len(pairs), CLASSES))
    onehot[np.arange(len(pairs)), member] = 1
    own = exchange_rest(tokens, v, member[of], onehot.T @ pairs @ onehot)
    grid = pair_counts(tokens, own, CLASSES)
    n, divisor = np.concatenate([v.n, np.zeros(GROUPS)]), np.zeros(v.size)
    rest = counts.where(~own_word(v.tokens, v.top)).groupBy("suffix").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    for r in rest.collect():
        n[v.groups + r.suffix] = r.n
        divisor[v.groups + r.suffix] = np.log10(r.n + r.v + 1)
    size, many = np.bincount(own, n, CLASSES), np.bincount(own, minlength=CLASSES)
    share = (size + 1) / (size.sum() + CLASSES)
    follows = np.log10((grid + BACK * share) / (grid.sum(1, keepdims=True) + BACK))
    emits = np.log10((n + ADD) / (size + ADD * many)[own])
    return Model(v, own, follows, emits, divisor)


def train(docs: DataFrame, counts: DataFrame) -> Model:
    """The model of all of ``docs(doc_id, text)``, whose word_counts are given."""
    v = vocabulary(counts, docs.count())
    return learn(tokenised(docs.select(F.col("doc_id").cast("long"), F.lit(0).alias("held_out"), "text"), v), counts, v)


SCORED = "row long, doc_id long, held_out int, n_tokens long, known long, base double, score double"


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows whose crc32(doc_id) has not the held-out remainder. Null and empty texts are one token,
    the end. A null doc_id trains, as if not held out; repeated rows count each time and each get a row; other columns
    are not read; an empty table gives no rows. Words are told apart by 64-bit hashes. Texts are taken apart twice, for
    the word counts and then into ids, which are stored; all else reads these.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))
    known = docs.select("doc_id", "text").where(~held)
    counts = written(word_counts(known.select("text")), "words")
    v = vocabulary(counts, known.count())
    told = tokenised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.cast("int").alias("held_out"), "text"), v)
    tokens = written(told.withColumn("row", F.monotonically_increasing_id()), "tokens")
    model = learn(tokens.where("held_out = 0"), counts, v)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(6)
            starts = lists.offsets.to_numpy()[:-1].astype(np.int64)
            ids = lists.values.to_numpy()[starts[0] : lists.offsets[-1].as_py()] if len(starts) else np.zeros(0, np.int32)
            yield _emit(SCORED, *[batch.column(i) for i in range(6)], model.scores(ids, starts - starts[0] if len(starts) else starts))

    parts = tokens.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "ids").mapInArrow(run, SCORED)
    tails = tokens.select("row", F.explode(F.arrays_zip("words", "many")).alias("t")).select("row", F.col("t.words").alias("word"), "t.many")
    met = tails.join(counts.select("word", "n"), "word").groupBy("row")
    met = met.agg(F.sum(F.col("many") * F.log10(F.col("n") + 1)).alias("more"), F.sum("many").alias("met"))
    out = parts.join(met, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", (F.col("held_out") == 1).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
