"""SimHash near-dedup: pigeonhole blocks find candidate fingerprints, Hamming distance decides.

A text's words are its runs of bytes other than ASCII white space, A-Z lower-cased; its features are all word shingles,
repeats included. A fingerprint bit is set if it is set in over half of the shingles' XXH64 hashes (seed 42).

near_dedup also links texts whose sets of shingles have at least a given Jaccard similarity, which fingerprints two bits
apart don't reach. Bands of minima over the same hashes (MinHash) find candidates there, exact similarity decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_id, text_key, tidy, unused, words_of, written
from .components import components

#: A block value shared by more fingerprints than this goes the way of :func:`_by_centres`, which is exact too.
LARGE = 64
_CHUNK = 1 << 16
#: Bands of a sketch, and minima in each: texts of similarity 0.8 share no band in 3 of 100,000 cases.
BANDS, ROWS = 20, 4
_MIX = np.array([xxhash.xxh64_intdigest(str(i).encode(), 7) | 1 for i in range(2 * BANDS * ROWS)], np.uint64).reshape(2, -1, 1)


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, in order, by parts. Fewer words than a shingle: the whole sequence is the one shingle; none: no part."""
    w = words_of(text)
    if not w:
        return
    joined, n = b" ".join(w), max(1, len(w) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        spans = zip(starts[at:to].tolist(), ends[min(shingle, len(w)) - 1 :][at:to].tolist(), strict=True)
        yield np.array([hashed(joined[i:j], 42) for i, j in spans], "<u8")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64 bits; of no words: 0."""
    return _majority(shingle_hashes(text, shingle))


def _majority(parts: Iterable[np.ndarray]) -> int:
    n, bits = 0, np.zeros(64, np.int64)
    for h in parts:
        n += len(h)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprint_udf(shingle: int):
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        seen: dict = {}
        out = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            if (f := seen.get(t)) is None:
                f = seen[t] = np.uint64(fingerprint(t, shingle)).astype(np.int64)
            out[i] = f
        tidy()
        return pd.Series(out)

    return run


def _blocks(distance: int) -> list[list[tuple[int, int]]]:
    """Choices of two among distance + 2 blocks of bits, as (shift, width): two blocks at least are free of changes."""
    m = distance + 2
    cuts = [64 * i // m for i in range(m + 1)]
    return [[(cuts[i], cuts[i + 1] - cuts[i]) for i in pair] for pair in combinations(range(m), 2)]


def _keys(fp: Column, distance: int) -> Column:
    """The block keys of a fingerprint: which choice it is, then the bits of its two blocks."""
    out = []
    for c, ((s1, w1), (s2, w2)) in enumerate(_blocks(distance)):
        a = F.shiftrightunsigned(fp, s1).bitwiseAND(F.lit((1 << w1) - 1))
        b = F.shiftrightunsigned(fp, s2).bitwiseAND(F.lit((1 << w2) - 1))
        out.append(F.lit(c << (w1 + w2)).cast("long").bitwiseOR(F.shiftleft(a, w2)).bitwiseOR(b))
    return F.array(*out)


def _by_centres(fps: DataFrame, distance: int) -> DataFrame:
    """Links of all ``fps(fp)`` within an even distance, as stars, with no pairs made.

    Two fingerprints are that close just if some 64-bit word lies within half the distance of both. So each is filed
    under all such words, and all that meet under one word are linked to the smallest there. A word meets few
    fingerprints (65 for distance 2), however many of them make up a dense group.
    """
    flips = [F.lit(0).cast("long")]
    for r in range(1, distance // 2 + 1):
        flips += [F.lit(sum(1 << b for b in bits) - ((1 << 64) if 63 in bits else 0)).cast("long") for bits in combinations(range(64), r)]
    at = fps.select("fp", F.explode(F.transform(F.array(*flips), lambda x: x.bitwiseXOR(F.col("fp")))).alias("centre"))
    low = at.groupBy("centre").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    met = at.join(low.select("centre", "low"), "centre").where("fp <> low")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= distance).select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b) of distinct ``fps(fp)`` that span every group of fingerprints linked at ``distance`` or fewer bits."""
    if distance % 2 or comb(distance + 2, 2) > 64:
        raise ValueError("the distance must be even and small")
    keys = fps.select("fp", F.explode(_keys(F.col("fp"), distance)).alias("block"))
    counts = keys.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(keys.join(counts, "block"), "blocks")
    few = shared.where(F.col("n") <= LARGE).select("block", "fp")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.block") == F.col("y.block")) & (F.col("x.fp") < F.col("y.fp")) & near)
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    return pairs.union(_by_centres(shared.where(F.col("n") > LARGE).select("fp").distinct(), distance)).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, text_key, fp (signed), group (a fingerprint), component_id.

    component_id is the smallest doc_id reachable over links of ``distance`` or fewer bits, itself included. Null and
    empty texts have fingerprint 0 and link like others. Rows with a null doc_id take part; a group of only such rows
    has a null component_id. Repeated rows stay, each with the same values. Other columns are not read. An empty table
    gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    prints = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), fingerprint_udf(shingle)(text).alias("fp")), "prints")
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    label = written(components(links(fps.select("fp"), distance)), "labels")
    named = fps.join(label, fps.fp == label.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("group"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "group").select("fp", "group", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "text_key", "fp", "group", "component_id")


def sketch(distinct: np.ndarray) -> np.ndarray:
    """One value for each band of a set of shingle hashes; two sets of similarity J share a band's with chance J ** ROWS."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), 1 << 12):
        low = np.minimum(low, ((distinct[at : at + (1 << 12)] ^ _MIX[0]) * _MIX[1]).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        out = (out ^ column) * _MIX[1, 0, 0]
        out ^= out >> np.uint64(29)
    return out.astype(np.int64)


def _sets_udf(shingle: int):
    """fp; of the set of shingles its hash, its size and its sketch; a text without words has no bands."""

    @F.pandas_udf("fp long, sid long, n long, bands array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        seen: dict = {}
        for t in texts:
            if t not in seen:
                parts = list(shingle_hashes(t, shingle))
                distinct = np.unique(np.concatenate([np.zeros(0, "<u8"), *parts]))
                sid = np.uint64(xxhash.xxh64_intdigest(distinct.tobytes(), 42)).astype(np.int64)
                seen[t] = (np.uint64(_majority(parts)).astype(np.int64), sid, len(distinct), sketch(distinct) if len(distinct) else [])
        out = pd.DataFrame([seen[t] for t in texts], columns=["fp", "sid", "n", "bands"])
        tidy()
        return out

    return run


def _shingles_udf(shingle: int):
    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(t, shingle)])).astype(np.int64) for t in texts], dtype=object)
        tidy()
        return out

    return run


def _similar(pairs: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b), as fingerprints, of those ``pairs(x, y)`` of sets whose Jaccard similarity is enough, by all their shingles."""
    pairs = written(pairs.distinct(), "candidates")
    used = pairs.select(F.col("x").alias("sid")).union(pairs.select("y")).distinct()
    held = sets.join(used, "sid", "left_semi").select("sid", "fp", "key").join(texts, "key")
    held = written(held.select("sid", "fp", _shingles_udf(shingle)(F.col("text")).alias("s")), "shingles")
    side = lambda c, d: held.select(F.col("sid").alias(c), F.col("fp").alias(d), F.col("s").alias(f"{d}s"))
    met = pairs.join(side("x", "a"), "x").join(side("y", "b"), "y").withColumn("both", F.size(F.array_intersect("as", "bs")))
    return met.where(F.col("both") >= similarity * (F.size("as") + F.size("bs") - F.col("both")) - 1e-9).select("a", "b")


def similar_links(prints: DataFrame, texts: DataFrame, near: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b) of fingerprints that, with the links ``near(a, b)``, span all groups linked by similar sets of shingles.

    ``prints(text_key, fp, sid, n, bands)`` are those of ``texts(key, text)``. Equal sets are one. Of the sets that share
    a band each is first held against the smallest; sets in different groups after that are held against each other in
    all pairs. So copies of one text, however many, need no pairs, and no candidate is left out.
    """
    sets = prints.groupBy("sid").agg(F.min(F.struct("fp", "text_key", "n", "bands")).alias("k"))
    sets = written(sets.select("sid", "k.fp", F.col("k.text_key").alias("key"), "k.n", "k.bands"), "sets")
    same = prints.select("sid", F.col("fp").alias("a")).join(sets.select("sid", F.col("fp").alias("b")), "sid").where("a <> b").select("a", "b")
    at = sets.select("sid", "fp", "n", F.explode("bands").alias("band"))
    low = at.groupBy("band").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low <> high").select("band", "low")
    shared = written(at.join(low, "band"), "bands")
    like = lambda n, m: F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9
    sized = shared.join(sets.select(F.col("sid").alias("low"), F.col("n").alias("m")), "low").where((F.col("sid") != F.col("low")) & like(F.col("n"), F.col("m")))
    found = near.union(same).union(_similar(sized.select(F.col("sid").alias("x"), F.col("low").alias("y")), sets, texts, shingle, similarity))
    found = written(found.distinct(), "links")
    label = written(components(found), "labels")
    named = shared.join(label, shared.fp == label.node, "left").withColumn("group", F.coalesce("label", "fp"))
    split = named.groupBy("band").agg(F.min("group").alias("g"), F.max("group").alias("z")).where("g <> z").select("band")
    rest = written(named.where("sid <> low").join(split, "band", "left_semi").select("band", "sid", "n", "group"), "rest")
    apart = (F.col("p.band") == F.col("q.band")) & (F.col("p.sid") < F.col("q.sid")) & (F.col("p.group") != F.col("q.group")) & like(F.col("p.n"), F.col("q.n"))
    pairs = rest.alias("p").join(rest.alias("q"), apart).select(F.col("p.sid").alias("x"), F.col("q.sid").alias("y"))
    return found.union(_similar(pairs, sets, texts, shingle, similarity)).distinct()


def near_dedup(docs: DataFrame, shingle: int = 5, distance: int = 2, similarity: float = 0.8) -> DataFrame:
    """The rows of docs with the smallest doc_id of their group, one for each group; all columns stay.

    A group is linked by fingerprints of ``distance`` or fewer differing bits and by sets of shingles of at least the
    Jaccard ``similarity``. Of rows with the same doc_id and group, the one with the smallest text key stays, and of
    repeated rows one. A group in which every doc_id is null is kept by its smallest text key. Row order is not kept.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    told = docs.select(row_id().alias("id"), F.col("doc_id").isNull().alias("unnamed"), text_key(F.col("text")).alias("text_key"), _sets_udf(shingle)(text).alias("s"))
    prints = written(told.select("id", "unnamed", "text_key", "s.*"), "prints")
    texts = docs.select(text_key(F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    near = written(links(prints.select("fp").distinct(), distance), "near")
    label = written(components(similar_links(prints, texts, near, shingle, similarity)), "labels")
    groups = prints.join(label, prints.fp == label.node, "left").select("id", "unnamed", "text_key", F.coalesce("label", "fp").alias("group"))
    first = groups.groupBy("group").agg(F.min(F.struct("unnamed", "id", "text_key")).alias("k"))
    i, k = unused(docs, "id", "text_key")
    keep = first.select(F.col("k.id").alias(i), F.col("k.text_key").alias(k))
    kept = docs.withColumn(i, row_id()).withColumn(k, text_key(F.col("text"))).join(keep, [i, k], "left_semi")
    return kept.dropDuplicates([i, k]).select(*[F.col(f"`{c}`") for c in docs.columns])
