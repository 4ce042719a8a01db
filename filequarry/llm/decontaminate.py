"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m bytes that stands in a text with e edits at most shares m + 1 - Q (1 + e) of its Q-grams with it, all within
e + 1 neighbouring diagonals. Diagonals are dealt into overlapping bands of twice that width, so one band has them all.
Bands with enough shared Q-grams are regions, and a semi-global alignment of the item within a region decides: it may
have more edits than the lemma allows for, since edits that stand together spoil few Q-grams. Texts are
compared as UTF-8 with A-Z lower-cased and each white-space byte as a blank.

Items go one way, whatever their length. Short ones, of less than SHORT bytes, get no edits beyond the lemma's and must
stand between word bounds, as such strings also occur inside of words. An item without a Q-gram says nothing about the
text around it, so it matches a text that is nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_key, tidied, tidy

Q = 9
#: Edits for each byte of an item up to which the lemma finds every place.
RATE = 0.09
#: Edits for each byte that a found region may have. Edits that stand together, as in changed words, spoil few Q-grams, so
#: most places with up to so many are found too.
ACCEPT = 0.2
#: Items shorter than this must stand between word bounds, with no more edits than the lemma allows for.
SHORT = 24
#: Bytes of items that one pass over the documents takes; larger benchmarks need more passes.
BLOCK_BYTES = 8 << 20
#: Bytes of documents that are hashed at once; a longer text goes alone.
CHUNK = 1 << 21
_B = np.uint64(0x9E3779B97F4A7C15)
_TABLE = 22
_BLANK = bytes(32 if i in (9, 10, 11, 12, 13) else i for i in range(256))
MATCHES = "doc_id long, text_key long, item_id long, start int, end int, edits int, shared int"


def plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower().translate(_BLANK)


def grams(raw: bytes) -> np.ndarray:
    """Hashes of all Q-grams, by doubling."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint64)
    if len(a) < Q:
        return a[:0]
    with np.errstate(over="ignore"):
        two = a[:-1] * _B + a[1:]
        four = two[:-2] * (_B * _B) + two[2:]
        eight = four[:-4] * (_B * _B * _B * _B) + four[4:]
        h = eight[: len(a) - Q + 1] * _B + a[Q - 1 :]
        return h ^ (h >> np.uint64(29))


def align(item: bytes, region: bytes, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the item's best place in a region, whose ends are free; None if it takes over ``most`` edits."""
    if (at := region.find(item)) >= 0:
        return 0, at, at + len(item)
    edits, end = _ends(item, region)
    if edits > most:
        return None
    back, size = _ends(item[::-1], region[:end][::-1])
    return edits, end - size, end


def _ends(item: bytes, region: bytes) -> tuple[int, int]:
    b, j = np.frombuffer(region, np.uint8), np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, c in enumerate(item, 1):
        cost = np.empty_like(row)
        cost[0] = i
        cost[1:] = np.minimum(row[:-1] + (b != c), row[1:] + 1)
        row = np.minimum.accumulate(cost - j) + j
    end = int(np.argmin(row))
    return int(row[end]), end


def _bounded(text: bytes, start: int, end: int) -> bool:
    """Whether no word goes on over either end of a stretch."""
    letter = lambda i: 0 <= i < len(text) and (text[i] >= 128 or text[i : i + 1].isalnum())
    return not (letter(start - 1) and letter(start)) and not (letter(end - 1) and letter(end))


class Index:
    """The Q-grams of items, and what each item's edit budget asks for."""

    def __init__(self, items: list[tuple[int, str]]):
        every = [(i, p) for i, t in items if (p := plain(t).strip())]
        self.tiny: dict[bytes, list[int]] = {}
        for i, p in every:
            if len(p) < Q:
                self.tiny.setdefault(p, []).append(i)
        self.items = [(i, p) for i, p in every if len(p) >= Q]
        sizes = np.array([len(p) for _, p in self.items], np.int64)
        edits = np.minimum((RATE * sizes).astype(np.int64), sizes // Q - 1)
        self.edits, self.least = edits, sizes + 1 - Q * (1 + edits)
        self.accept = np.where(sizes < SHORT, edits, np.maximum(edits, (ACCEPT * sizes).astype(np.int64)))
        h = [grams(p) for _, p in self.items]
        flat = np.concatenate([*h, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(h)), [len(x) for x in h])
        at = np.concatenate([*[np.arange(len(x)) for x in h], np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.owner, self.at = owner[order].astype(np.int32), at[order].astype(np.int32)
        self.grams, first, count = np.unique(flat[order], return_index=True, return_counts=True)
        self.first, self.count = first.astype(np.int32), count.astype(np.int32)
        self.hint = np.zeros(1 << _TABLE, bool)
        self.hint[(self.grams >> np.uint64(64 - _TABLE)).astype(np.int64)] = True

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, start, end, edits, shared Q-grams) of all matches, in bytes; the same place of an item once."""
        out = []
        if self.tiny:
            for k, t in enumerate(texts):
                if len(bare := t.strip()) < Q:
                    at = len(t) - len(t.lstrip())
                    out += [(k, i, at, at + len(bare), 0, 0) for i in self.tiny.get(bare, ())]
        if not self.items:
            return out
        sizes = np.array([len(t) + Q for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        h = grams((b"\0" * Q).join(texts) + b"\0" * Q)
        p = np.nonzero(self.hint[(h >> np.uint64(64 - _TABLE)).astype(np.int64)])[0]
        g = np.minimum(np.searchsorted(self.grams, h[p]), len(self.grams) - 1)
        ok = self.grams[g] == h[p]
        p, g = p[ok], g[ok]
        n = self.count[g].astype(np.int64)
        post = np.repeat(self.first[g] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        p, item = np.repeat(p, n), self.owner[post].astype(np.int64)
        text = np.searchsorted(starts, p, "right") - 1
        diagonal = p - starts[text] - self.at[post] + 1  # an item may start a few bytes before its text does
        wide = self.edits[item] + 1
        band = (diagonal + 4 * wide) // wide
        whole = band > 0  # of others, too much of the item would stand before the text
        text, item, band = text[whole], item[whole], band[whole]
        pairs, pair = np.unique(text * len(self.items) + item, return_inverse=True)
        key = pair << 32
        bands, shared = np.unique(np.concatenate([key | band, key | (band - 1)]), return_counts=True)
        owner = pairs[bands >> 32]
        enough = shared >= self.least[owner % len(self.items)]
        last: dict = {}
        for b, own, s in zip((bands[enough] & 0xFFFFFFFF).tolist(), owner[enough].tolist(), shared[enough].tolist(), strict=True):
            k, i = divmod(own, len(self.items))
            name, pattern = self.items[i]
            e, most = int(self.edits[i]), int(self.accept[i])
            low = (b - 4) * (e + 1) - 1
            a, z = max(0, low - most), max(0, low + 2 * (e + 1) + len(pattern) + most)
            had = last.get(own)
            if had and low <= had[2] < low + 2 * (e + 1):
                continue  # the band before has it
            if found := align(pattern, texts[k][a:z], most):
                cost, start, end = found
                if len(pattern) < SHORT and not _bounded(texts[k], start + a, end + a):
                    continue
                last[own] = (k, name, start + a, end + a, cost, s)
                out.append(last[own])
        return out


def _search(index: Index, texts: list[str | None]) -> tuple[list[tuple], dict]:
    """Matches as (text, item, start, end, edits, shared), in code points, and the rows of each text; equal texts are searched once."""
    where: dict = {}
    for k, t in enumerate(texts):
        where.setdefault(t or "", []).append(k)
    todo, found = list(where), []
    while todo:
        some, size = [], 0
        while todo and (not some or size + len(todo[-1]) < CHUNK):
            some.append(todo.pop())
            size += len(some[-1])
        raw = [plain(t) for t in some]
        for k, item, a, z, edits, shared in index.search(raw):
            a, z = (len(raw[k][:x].decode("utf-8", "ignore")) for x in (a, z))
            found.append((some[k], item, a, z, edits, shared))
    return found, where


def _matches(docs: DataFrame, index: Index) -> DataFrame:
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = (batch.column(i).to_pylist() for i in range(3))
            found, where = _search(index, texts)
            rows = [(ids[i], keys[i], *m) for t, *m in found for i in where[t]]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 3 + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in MATCHES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")), "text").mapInArrow(run, MATCHES)


def _holds(index: Index):
    """A function from a text column to whether it holds an item of the index."""

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        found, where = _search(index, texts.tolist())
        out = np.zeros(len(texts), bool)
        out[[i for t, *_ in found for i in where[t]]] = True
        tidy()
        return pd.Series(out)

    return holds


def _indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of blocks of items, of BLOCK_BYTES or so each; only one block is on the driver at a time."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 2 * (size // BLOCK_BYTES) + 1
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield Index([tuple(r) for r in block.orderBy("item_id", "text").collect()])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """MATCHES of ``benchmark(item_id, text)`` in ``docs(doc_id, text)``: spans in code points, end exclusive.

    Null and blank items match nothing, and so do null and empty texts. Rows with a null doc_id match like others;
    repeated rows each get their rows, repeated items too; other columns are not read; empty tables give no rows. A
    benchmark is taken in blocks of BLOCK_BYTES, by a pass over the documents for each.
    """
    out = None
    for index in _indexes(benchmark):
        found = _matches(docs, index)
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; no row is moved to decide."""
    for index in _indexes(benchmark):
        docs = docs.where(~_holds(index)("text"))
    return docs
