"""Packing and GIF columns: exact round trips."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from filequarry.llm import gif, packing
from filequarry.llm.queries import byte_bpe

from .conftest import words


@pytest.fixture(scope="module")
def tokenizer():
    return byte_bpe()


def test_ids_are_those_of_the_tokenizers_library(tokenizer):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    slow, ours = Tokenizer.from_str(tokenizer), packing.encoder(tokenizer)
    texts = ["", " ", "a  b\n\n c\t", "Éclair日本語 　 x y", "<|endoftext|>a<|endoftext|>", "don't 12345 !!!", "x" * 3000, *(words(rng, 80, 0.5) for _ in range(30))]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1000), rng.randrange(0x3000, 0x3100), 10, 32, 0x1F600])) for _ in range(60)) for _ in range(60)]
    for t in texts:
        assert ours(t) == slow.encode(t, add_special_tokens=False).ids, t


def test_very_long_white_space(tokenizer):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    slow, ours = Tokenizer.from_str(tokenizer), packing.encoder(tokenizer)
    n = packing.LONG_BLANK
    texts = [" " * 5_000_000 + "a", "b" + "\n" * 5_000_000, " \n\t" * 400_000 + "<|endoftext|>" + "\r\n" * 400_000 + " é", "\u3000 " * n + "x  y", "\x1c" * (n + 1) + "a"]
    for k in (n - 1, n, n + 1):
        texts += [a + c * k + b for a in ("", "a", "é.") for b in ("", "b", "'s", "!", "\x1c") for c in (" ", "\n")]
        texts.append("x" + "".join(rng.choice(" \n\t\xa0") for _ in range(k)) + "y " * 20 + "\n" * k + " z")
    for t in texts:
        assert ours(t) == slow.encode(t, add_special_tokens=False).ids, (len(t), t[:5], t[-5:])


def test_equal_rows_are_dealt_out(make, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_AT_ONCE", 4)
    docs = [(None, "the same text")] * 90 + [(7, "the same text")] * 60
    rows = packing.pack(make(docs), tokenizer, 64).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 150
    for places in [sorted((r.offset, r.length) for r in rows if r.sequence_id == s) for s in {r.sequence_id for r in rows}]:
        assert [a for a, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]


def check(rows, docs, encode, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, t in docs:
        ids = [*encode(t or ""), 2]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert len(own) == -(-len(ids) // length)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            assert r.piece == 0 or r.length == length
            at += r.length
        assert at == len(ids)
    for places in by_sequence.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= length


@pytest.mark.parametrize("length", [64, 1024])
def test_every_token_has_a_place(make, tokenizer, length):
    rng = random.Random(2)
    texts = [words(rng, rng.choice([0, 1, 3, 10, 30, 400])) for _ in range(120)] + [words(rng, 9)] * 30 + [None, ""]
    docs = list(enumerate(texts))
    rows = packing.pack(make(docs), tokenizer, length).collect()
    check(rows, docs, packing.encoder(tokenizer), length)
    tokens, n = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert n <= 1.1 * tokens / length + 2


def first_fit_decreasing(sizes, full):
    free = []
    for s in sorted(sizes, reverse=True):
        for i, f in enumerate(free):
            if f >= s:
                free[i] -= s
                break
        else:
            free.append(full - s)
    return len(free)


@pytest.mark.parametrize("kind", ["even", "short", "one length", "two lengths", "long"])
def test_plans_hold_all_and_are_dense(kind):
    rng = np.random.default_rng(3)
    sizes = {"even": rng.integers(1, 257, 3000), "short": rng.integers(1, 20, 2000), "one length": np.full(999, 100), "two lengths": rng.choice([100, 57], 1500), "long": rng.integers(120, 257, 1500)}[kind]
    plan = packing.plan(Counter(sizes.tolist()), 256)
    held = Counter()
    for lengths, n in plan:
        assert n > 0 and sum(lengths) <= 256
        for x in lengths:
            held[x] += n
    assert held == Counter(sizes.tolist())
    assert sum(n for _, n in plan) <= 1.02 * first_fit_decreasing(sizes.tolist(), 256) + 1


def test_fit_is_the_non_negative_least_squares_solution():
    rng = np.random.default_rng(4)
    cols = packing.patterns(np.arange(1, 24), 24)
    assert all(sum(c) == 24 for c in cols.tolist()) and len({tuple(c) for c in cols.tolist()}) == len(cols)
    want = rng.integers(0, 50, 25)
    want[[0, 24]] = 0
    x = packing.fit(cols, want)
    a = np.zeros((25, len(cols)))
    for j, c in enumerate(cols.tolist()):
        for k in c:
            a[k, j] += k > 0
    full = np.zeros(len(cols))
    for j, v in x.items():
        full[j] = v
    grad = a.T @ (packing.weights(24) ** 2 * (want - a @ full))
    assert (full >= 0).all() and grad.max() < 1e-3 and abs(grad[full > 0]).max() < 1e-3


def test_awkward_packing(awkward, empty, tokenizer):
    rows = packing.pack(awkward, tokenizer).collect()
    whole = awkward.select("doc_id", "text").collect()
    encode = packing.encoder(tokenizer)
    assert sum(r.length for r in rows) == sum(len(encode(r.text or "")) + 1 for r in whole)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(empty, tokenizer).count() == 0


# ---- GIF


@pytest.mark.parametrize("bits", [2, 4, 8])
@pytest.mark.parametrize("n", [0, 1, 255, 256, 3837, 3838, 3839, 20_000])
def test_lzw_round_trip(bits, n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 1 << bits, n, dtype=np.uint8).tobytes(), bytes(n), bytes(i % 3 for i in range(n))):
        assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, n) == data


def test_late_clear_code():
    """A stream whose table fills up and that goes on without a clear code."""
    rng = np.random.default_rng(1)
    data = rng.integers(0, 4, 40_000, dtype=np.uint8).tobytes()
    table, codes, p = {bytes([i]): i for i in range(4)}, [4], b""
    widths = [3]
    for b in data:
        if (q := p + bytes([b])) in table:
            p = q
            continue
        codes.append(table[p])
        widths.append(max(3, min(12, int(len(table) + 1).bit_length())))
        if len(table) + 2 < 4096:
            table[q] = len(table) + 2
        p = bytes([b])
    codes += [table[p], 5]
    flat = [4] + codes[1:]
    wide = np.concatenate([[3], gif._widths(2, len(flat) - 1)])
    bits, stream = "", bytearray()
    for c, w in zip(flat, wide.tolist(), strict=True):
        bits = format(c, f"0{w}b") + bits
        while len(bits) >= 8:
            stream.append(int(bits[-8:], 2))
            bits = bits[:-8]
    stream.append(int(bits or "0", 2))
    assert len(table) == 4096 - 2 and gif.lzw_decode(bytes(stream), 2, len(data)) == data




def test_known_file():
    data = bytes.fromhex("474946383961" "0a000a0091" "0000" "ffffff" "ff0000" "0000ff" "000000" "21f904000000" "0000" "2c000000000a000a0000" "02" "16" "8c2d99872a1cdc33a00275ec95faa8de608c04914c01" "00" "3b")
    f = gif.read_gif(data).frames[0]
    want = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    assert ["".join(map(str, r)) for r in f.indices.tolist()] == want
    assert f.pixels[0, 0].tolist() == [255, 0, 0] and f.pixels[9, 0].tolist() == [0, 0, 255]


def test_disposal_and_transparency():
    pal = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0] + [0] * (256 * 3 - 9))
    one, two = np.full((4, 4), 1, np.uint8), np.array([[2, 0], [0, 2]], np.uint8)
    for disposal in range(4):
        data = gif.write_gif([one, two, two], pal, 7, disposal, transparent=0, size=(4, 4))
        a, b, c = gif.read_gif(data).frames
        assert a.pixels[0, 0].tolist() == [255, 0, 0] and a.covered.all() and a.delay == 7
        assert b.pixels[0, 0].tolist() == [0, 255, 0]
        under = {0: [255, 0, 0], 1: [255, 0, 0], 2: [0, 0, 0], 3: [0, 0, 0]}[disposal]
        assert b.pixels[0, 1].tolist() == under and b.covered[0, 1] == (disposal < 2)
        assert c.histogram().sum() == pytest.approx(1)


def test_interlaced_rows_and_bad_files():
    rows = np.arange(10, dtype=np.uint8)[:, None].repeat(3, 1)
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    data = bytearray(gif.write_gif([rows[order]]))
    data[data.index(b"\x2c\0\0\0\0") + 9] |= 0x40
    assert (gif.read_gif(bytes(data)).frames[0].indices == rows).all()
    for bad in (b"", b"GIF89a", b"PNG" * 10):
        with pytest.raises(ValueError):
            gif.read_gif(bad)
    whole = gif.write_gif([rows, rows])
    for n in range(13, len(whole), 7):
        assert len(gif.read_gif(whole[:n]).frames) <= 2


def test_text_media(make):
    rng = random.Random(5)
    texts = [None, "", "a", "é" * 96, "b" * 192, "c" * 193, words(rng, 8000), "a"]
    rows = {r.doc_id: r for r in gif.text_media(make(texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r, media = rows[i], gif.store(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert gif.read_back(media)[0] == p
    assert rows[2][1:] == rows[7][1:]


def test_frames(spark):
    data = gif.write_gif([np.zeros((2, 2), np.uint8), np.full((2, 2), 255, np.uint8)], delay=5)
    df = spark.createDataFrame([(1, data), (2, None), (3, b"no")], "k long, g binary")
    rows = gif.gif_frames(df, "k", "g").orderBy("frame").collect()
    assert [(r.id, r.frame, r.at_ms, r.delay_ms, r.width, r.height) for r in rows] == [(1, 0, 0, 50, 2, 2), (1, 1, 50, 50, 2, 2)]
    assert rows[0].histogram[0] == 1.0 and rows[1].histogram[-1] == 1.0


def test_awkward_media(awkward, empty):
    assert gif.text_media(awkward).count() == awkward.count()
    assert gif.text_media(empty).count() == 0
