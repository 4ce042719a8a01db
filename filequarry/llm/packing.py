"""Best-fit packing by length patterns: non-negative least squares fits how often each is used.

Documents become token pieces of at most LENGTH tokens. Only the histogram of piece lengths, LENGTH counts however many
documents there are, reaches the driver. There all patterns of up to three lengths that fill a sequence are enumerated,
their repeat counts are fitted to the histogram by non-negative least squares and rounded down, and what is left is packed
best-fit, again pattern by pattern. Pieces are then ranked among those of their length and take the plan's places.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_key, tidied, written

LENGTH = 1024
END_ID = 2
PIECES = "doc_id long, text_key long, piece int, start long, length long, ids_crc32 long"
#: Rows of a length that are ranked in one task, about.
RANKED_AT_ONCE = 256
MOST_SALTS = 1 << 16
#: Columns that join the fit in one step, and linear systems solved at most.
_AT_ONCE, _SOLVES = 48, 250
#: How byte-level BPE cuts text into words: a fixed value of that tokenizer family.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space as that pattern has it, and from what length on a run of it is cut out before.
BLANK, LONG_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000", 50_000


@functools.lru_cache(4)
def encoder(tokenizer_json: str):
    """A function from a text to its ids, equal to those of the `tokenizers` library for a byte-level BPE file.

    The file's vocabulary is loaded in `tiktoken`, whose merge loop is about three times as fast. Added tokens are cut out
    of the text first, as that library does by default. Other kinds of tokenizer files run in `tokenizers` itself.
    """
    import json
    import re

    import tiktoken

    told = json.loads(tokenizer_json)
    if told["model"].get("type") != "BPE" or (told.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or told.get("normalizer") or told["pre_tokenizer"].get("add_prefix_space"):
        from tokenizers import Tokenizer

        slow = Tokenizer.from_str(tokenizer_json)
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    added = {x["content"]: x["id"] for x in told.get("added_tokens", ())}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte[c] for c in word): i for word, i in told["model"]["vocab"].items() if word not in added}
    encoding = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    long_blank = re.compile(f"(?<![{BLANK}])[{BLANK}]{{{LONG_BLANK},}}")

    def plain(text: str) -> list[int]:
        if len(text) < LONG_BLANK or not long_blank.search(text):
            return encoding.encode_ordinary(text)
        # that library's pattern engine gives up on very long white space; such a run, but for a last blank that may
        # belong to the word after it, is one word of the pattern, and so goes to the merge loop as it is
        out, at = [], 0
        for run in long_blank.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += encoding.encode_ordinary(text[at : run.start()])
            out += encoding._core_bpe.encode_single_piece(text[run.start() : end].encode())
            at = end
        return out + encoding.encode_ordinary(text[at:])

    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def ids(text: str) -> list[int]:
        if not cut or not cut.search(text):
            return plain(text)
        return [i for part in cut.split(text) if part for i in ([added[part]] if part in added else plain(part))]

    return ids


def token_pieces(docs: DataFrame, tokenizer_json: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """PIECES of each row of ``docs(doc_id, text)``: its ids, then end_id, cut only if longer than a sequence.

    ``tokenizer_json`` is the content of a tokenizer file, which every task gets with its code. Of a text that is cut,
    the first piece is the short one. Null texts are empty: one piece with end_id only.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_json)
        for batch in batches:
            ids, keys, texts = (batch.column(i).to_pylist() for i in range(3))
            rows: list[tuple] = []
            for doc, key, text in zip(ids, keys, texts, strict=True):
                own = np.array([*encode(text or ""), end_id], "<u4")
                cuts = [0, *range((len(own) - 1) % length + 1, len(own) + 1, length)]
                rows += [(doc, key, p, a, b - a, zlib.crc32(own[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")), "text").mapInArrow(run, PIECES)


def patterns(lengths: np.ndarray, full: int) -> np.ndarray:
    """All multisets of two or three of the given lengths (ascending) that fill a sequence; rows padded with 0."""
    there = np.zeros(full + 1, bool)
    there[lengths] = True
    two = lengths[(2 * lengths <= full)]
    two = two[there[full - two]]
    out = [np.stack([np.zeros_like(two), two, full - two], 1)]
    for a in lengths[3 * lengths <= full]:
        b = lengths[(lengths >= a) & (2 * lengths <= full - a)]
        b = b[there[full - a - b]]
        out.append(np.stack([np.full_like(b, a), b, full - a - b], 1))
    return np.concatenate(out)


def weights(full: int) -> np.ndarray:
    """How much a length's misfit counts in the fit: long pieces more, as they find fewer partners among what is left."""
    out = (np.arange(full + 1) + full / 16) / (full + full / 16)
    out[0] = 0
    return out


def fit(cols: np.ndarray, want: np.ndarray) -> dict[int, float]:
    """Weighted non-negative least squares of pattern columns against the histogram, by an active-set method.

    Columns of the steepest gradients enter several at a time, each with lengths of its own, and those whose repeat count
    turns negative leave at once; fewer enter while that brings nothing. No more patterns than lengths stay.
    """
    weight = weights(len(want) - 1)
    target, scale = want * weight, float(want.sum()) or 1.0
    active: list[int] = []
    x = np.zeros(0)
    best: tuple[float, list[int], np.ndarray] = (np.inf, [], x)
    solves, width, idle = 0, _AT_ONCE, 0

    def dense(js: list[int]) -> np.ndarray:
        m = np.zeros((len(want), len(js)))
        for k in range(3):
            np.add.at(m, (cols[js, k], np.arange(len(js))), 1.0)
        return m * weight[:, None]

    while solves < _SOLVES and idle < 6:
        rest = target - (dense(active) @ x if active else 0)
        if (miss := float(rest @ rest)) < best[0] * (1 - 1e-9):
            best, idle = (miss, active, x), 0
        else:
            width, idle = max(1, width // 2), idle + 1
        grad = (weight * rest)[cols].sum(1)
        grad[active] = 0
        enter, taken = [], set()
        for j in np.argsort(-grad, kind="stable")[: 40 * width]:
            if grad[j] <= 1e-7 * scale or len(enter) >= width:
                break
            if not taken & set(cols[j].tolist()) - {0}:
                enter.append(int(j))
                taken |= set(cols[j].tolist())
        if not enter:
            break
        active, x = active + enter, np.zeros(0)
        while active:
            solves += 1
            m = dense(active)
            s = np.linalg.solve(m.T @ m + 1e-9 * np.eye(len(active)), m.T @ target)
            if (s > 0).all():
                x = s
                break
            active = [j for j, v in zip(active, s, strict=True) if v > 0]
    return dict(zip(best[1], best[2].tolist(), strict=True))


def plan(histogram: dict[int, int], full: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, descending; how often) that together hold just the pieces counted by length."""
    left = Counter({int(k): int(v) for k, v in histogram.items() if v > 0})
    out: list[tuple[tuple[int, ...], int]] = []
    if n := left.pop(full, 0):
        out.append(((full,), n))
    want = np.zeros(full + 1, np.int64)
    for k, v in left.items():
        want[k] = v
    cols = patterns(np.array(sorted(left), np.int64), full)
    for j, x in sorted(fit(cols, want).items(), key=lambda p: -p[1]) if len(cols) else ():
        lengths = Counter(k for k in cols[j].tolist() if k)
        if (n := min([int(x + 1e-6), *(left[k] // m for k, m in lengths.items())])) > 0:
            out.append((tuple(sorted(lengths.elements(), reverse=True)), n))
            for k, m in lengths.items():
                left[k] -= n * m
    return out + _residuals(+left, full)


def _residuals(left: Counter, full: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit over what is left: the longest first, then the one or two that close the gap, else the longest that fits."""
    out = []
    have = sorted(left)
    while have:
        free, took = full, Counter()

        def has(k: int, n: int = 1) -> bool:
            return left[k] - took[k] >= n  # noqa: B023

        def add(k: int) -> int:
            took[k] += 1  # noqa: B023
            return k

        free -= add(have[-1])
        while free:
            if has(free):
                free -= add(free)
                break
            at = bisect_right(have, free)
            two = next((k for k in have[max(0, at - 1) :: -1] if 2 * k >= free and k < free and has(k, 1 + (2 * k == free)) and has(free - k)), 0) if at else 0
            if two:
                add(two)
                free -= two + add(free - two)
                break
            one = next((k for k in have[at - 1 :: -1] if has(k)), 0) if at else 0
            if not one:
                break
            free -= add(one)
        n = min(left[k] // m for k, m in took.items())
        out.append((tuple(sorted(took.elements(), reverse=True)), n))
        for k, m in took.items():
            left[k] -= n * m
        have = [k for k in have if left[k]]
    return out


def pack(docs: DataFrame, tokenizer_json: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """PIECES of all rows of ``docs(doc_id, text)`` with sequence_id long and offset long.

    Each sequence holds at most ``length`` tokens, without gaps. Null texts are empty; rows with a null doc_id are packed
    like others; repeated rows each get places of their own; other columns are not read. An empty table gives no rows.
    """
    # rows that are equal in all else are told apart by their number, which is stored and so stays the same
    pieces = written(token_pieces(docs, tokenizer_json, length, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark, done, base, slots = docs.sparkSession, Counter(), 0, []
    for lengths, n in plan(counts, length):
        for k, m in Counter(lengths).items():
            # the pattern takes the ranks from done[k] on, m of them for each of its sequences
            slots.append((k, done[k], m * n, m, base, sum(x for x in lengths if x > k)))
            done[k] += m * n
        base += n
    schema = "length long, low long, wide long, many long, base long, at long"
    salts = max(1, min(MOST_SALTS, sum(counts.values()) // RANKED_AT_ONCE))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "salt", F.expr("sum(n) over (partition by length order by salt) - n").alias("before"))
    rank = F.expr("row_number() over (partition by length, salt order by row) - 1")
    ranked = salted.withColumn("own", rank).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    # a length meets at most a few thousand patterns, whatever the input: the plan's size is bounded by the lengths
    of = spark.createDataFrame(slots, schema).groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "wide", "many", "base", "at"))).alias("slots"))
    placed = ranked.join(F.broadcast(of), "length").withColumn("slot", F.expr("filter(slots, s -> rank >= s.low and rank < s.low + s.wide)[0]"))
    sequence = F.expr("slot.base + (rank - slot.low) div slot.many")
    offset = F.expr("slot.at + (rank - slot.low) % slot.many * length")
    return placed.select("doc_id", "text_key", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))
