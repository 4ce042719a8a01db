"""SimHash near-dedup and line dedup against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from filequarry.llm import linededup, simhash
from filequarry.llm.components import components

from .conftest import words


def slow_fingerprint(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_ends_all(p, r):
    """Edits of an item's best place in a text, by the plain recurrence over rows of the whole text."""
    row = np.zeros(len(r) + 1, int)
    b, j = np.frombuffer(r, np.uint8), np.arange(len(r) + 1)
    for i, c in enumerate(p, 1):
        cost = np.concatenate([[i], np.minimum(row[:-1] + (b != c), row[1:] + 1)])
        row = np.minimum.accumulate(cost - j) + j
    return int(row.min())


def slow_components(prints, distance=2):
    ids = list(range(len(prints)))
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids[:i]:
            if (prints[i] ^ prints[j]).bit_count() <= distance and root(i) != root(j):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in ids]


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one two", "a B c d É É", "x " * 3000, "tab\tnew\nline\x0bv\x0cf\rr end"])
def test_fingerprint(text):
    for k in (3, 5):
        assert simhash.fingerprint(text, k) == slow_fingerprint(text, k)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7)]
    up = {i: i for i in range(500)}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in {x for a, b in edges if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def signed(x):
    return int(np.uint64(x).astype(np.int64))


@pytest.mark.parametrize("large", [64, 2])  # 2: nearly all go by centres
def test_links_lose_nothing(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    some = {0, 1, 3, 7, 2**63, 2**64 - 1}
    for b in base:
        for _ in range(6):
            for n in (1, 2, 3):
                x = b
                for _ in range(n):
                    x ^= 1 << rng.randrange(64)
                some.add(x)
    some = sorted(some)
    fps = spark.createDataFrame([(signed(x),) for x in some], "fp long")
    edges = simhash.links(fps)
    assert edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    label = {r.node: r.label for r in components(edges).collect()}
    want = slow_components(some)
    got = [label.get(signed(x), signed(x)) for x in some]
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_groups(make):
    rng = random.Random(2)
    texts = [words(rng, 60) for _ in range(20)]
    texts += [t.replace(" ", "  ", 3).upper() for t in texts[:5]] + [texts[0]] * 4 + ["", None, " ", "ab", "a b"]
    rows = {r.doc_id: r for r in simhash.simhash_groups(make(texts)).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    assert [rows[i].fp for i in range(len(texts))] == [signed(p) for p in prints]
    assert [rows[i].component_id for i in range(len(texts))] == slow_components(prints)


def test_awkward_groups(awkward, empty):
    rows = simhash.simhash_groups(awkward).collect()
    assert len(rows) == awkward.count()
    by = {(r.doc_id, r.fp): r.component_id for r in rows}
    assert by[(1, 0)] == by[(2, 0)] == by[(3, 0)] == by[(None, 0)] == 1
    assert simhash.simhash_groups(empty).count() == 0


def test_near_dedup(awkward, empty, make):
    kept = simhash.near_dedup(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i) == [1, 4, 4, 5, 7, 8, 9]  # id 4 has two texts that differ, one of them thrice
    assert all(r[c] == "clash" for r in kept.collect() for c in kept.columns[5:])
    assert simhash.near_dedup(empty).count() == 0
    assert simhash.near_dedup(make([(None, "a b c"), (None, "a b c"), (None, "d e f g h i")])).count() == 2


def test_near_copies_of_similarity_from_08(make):
    rng = random.Random(12)
    shingles = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    alike = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    texts, want, seen = [], [], []
    for k in range(60):
        own = [f"{w}{i}" for i, w in enumerate(words(rng, 300).split())]
        other = list(own)
        for i in rng.sample(range(10, 290), rng.randrange(1, 9)):
            other[i] = f"new{i}"
        a, b = f"{k} " + " ".join(own), f"{k} " + " ".join(other)
        want += [2 * k] if alike(a, b) >= 0.8 else [2 * k, 2 * k + 1]
        seen.append(alike(a, b))
        texts += [a, b]
    assert sum(s >= 0.8 for s in seen) > 20 and min(seen) < 0.8 and sum(s < 0.9 for s in seen) > 20
    chain = [f"c{i}" for i in range(300)]
    crowd = [" ".join(chain)] + [" ".join(f"x{k}" if i == 20 + 3 * k else w for i, w in enumerate(chain)) for k in range(80)]
    kept = sorted(r.doc_id for r in simhash.near_dedup(make(texts + crowd)).select("doc_id").collect())
    assert kept == [*want, len(texts)]


# ---- lines


def cut(docs, noise=linededup.NOISE):
    return {(r.doc_id, r.n_chars): r for r in linededup.line_dedup(docs, noise).collect()}


def test_units_join_to_the_text(make):
    rng = random.Random(4)
    texts = ["", "one", "A b\n\n  C d\te F", "\n\n x\n", words(rng, 500, 0.3), None]
    for r in make(texts).select("text", linededup.units_of(F.col("text")).alias("u")).collect():
        assert "".join(r.u) == (r.text or "")


def test_repeated_passages_go(make):
    rng = random.Random(6)
    for trial in range(3):
        passage = "Passage " + words(rng, 60, 0.15) + "."
        texts = [words(rng, rng.randrange(5, 200)) + " " + passage + " " + words(rng, rng.randrange(5, 200)) for _ in range(12)]
        clean = [words(rng, 150) for _ in range(10)]
        out = linededup.line_dedup(make(texts + clean)).orderBy("doc_id").collect()
        assert out[0].text == texts[0]
        for i in range(1, 12):
            assert passage not in out[i].text
            assert len(out[i].text) >= len(texts[i]) - len(passage) - 60, (trial, i)
        assert [r.text for r in out[12:]] == clean


def test_guarantee(make):
    """After one pass no run of 2 * NOISE words stands at two places, whatever is shared with whom."""
    rng = random.Random(7)
    parts = [[words(rng, rng.randrange(1, 14), 0).capitalize() + "." for _ in range(rng.randrange(2, 12))] for _ in range(14)]
    texts = []
    for _ in range(40):
        chosen = [p if rng.random() < 0.6 else p[rng.randrange(len(p)) :] for p in rng.choices(parts, k=4)]
        texts.append("\n".join(" ".join(c) for c in chosen))
    out = [r.text for r in linededup.line_dedup(make(texts)).orderBy("doc_id").collect()]
    seen = {}
    for d, t in enumerate(out):
        kept = [u for u in re.split(r"(?<=[ \t\n])(?=[A-Z]|(?<=\n)\S)", t) if u.strip()]
        for i in range(len(kept)):
            n, j = 0, i
            while j < len(kept) and n < 2 * linededup.NOISE:
                n += len(kept[j].strip().split(" "))
                j += 1
            if n >= 2 * linededup.NOISE:
                # a run may also come from what deletion has put side by side; such runs stand in no input
                run = "".join(kept[i:j])
                key = tuple(u.strip() for u in kept[i:j])
                if any(run in x for x in texts):
                    assert seen.setdefault(key, (d, i)) == (d, i)


def test_copies_and_repeats(make):
    rng = random.Random(8)
    t = words(rng, 120)
    u = words(rng, 30) + "."
    out = linededup.line_dedup(make([t, t, f"{u}\n{u}\n{u}", "Der " * 4000])).orderBy("doc_id").collect()
    assert out[0].text == t and out[1].text == ""
    assert out[2].text.count(u) == 1
    assert len(out[3].text) < 200


def test_awkward_lines(awkward, empty):
    out = linededup.line_dedup(awkward)
    assert out.count() == awkward.count()
    assert set(out.columns) == set(awkward.columns)
    rows = out.collect()
    assert all(r[c] == "clash" for r in rows for c in awkward.columns[5:] if c not in ("n_units", "runs"))
    assert [r.text for r in rows if r.doc_id == 1] == [None] and [r.text for r in rows if r.doc_id == 2] == [""]
    assert sorted(len(r.text) for r in rows if r.doc_id in (5, 6))[0] == 0
    assert linededup.line_dedup(empty).count() == 0


def test_passages_inside_units(make):
    """Lower-case, indented and caseless passages inside lines."""
    rng = random.Random(13)
    lower = lambda n: words(rng, n, 0)
    caseless = lambda n: " ".join("".join(chr(rng.randrange(0x5D0, 0x5EA)) for _ in range(5)) for _ in range(n))
    code = "".join(f"\n        {lower(9)}" for _ in range(8))
    for around, passage in ((lower, lower(80)), (lower, lower(50)), (caseless, caseless(60)), (lambda n: "\n    " + lower(n), code.strip())):
        texts = [f"{around(25)} {passage} {around(25)}" for _ in range(4)]
        out = linededup.line_dedup(make(texts)).orderBy("doc_id").collect()
        assert out[0].text == texts[0]
        for i in (1, 2, 3):
            a, z = texts[i].split(passage)
            assert passage not in out[i].text and 46 <= len(out[i].text.split()) <= 50
    assert [r.text for r in linededup.line_dedup(make([" \n " + lower(100), " \x0c " + lower(19)])).orderBy("doc_id").collect()][1].startswith(" \x0c ")


def test_words_are_told_apart_by_any_white_space(make):
    rng = random.Random(14)
    cells = "\n".join("\t".join(words(rng, 8, 0).split()) for _ in range(12))
    few = "Begin   " + "   ".join(words(rng, 14, 0).split())
    out = linededup.line_dedup(make([cells, f"Before\n{cells}\nafter", f"One {few} Two", f"Three {few} Four"])).orderBy("doc_id").collect()
    assert out[0].text == cells and out[1].text.split() == ["Before", "after"]
    assert out[3].text == f"Three {few} Four"


def earlier_runs(texts, n):
    """By text: the places whose next n words stand at an earlier place too, by looking at every place."""
    seen, out = set(), []
    for t in texts:
        w, own = (t or "").split(), []
        for i in range(len(w) - n + 1):
            if (run := tuple(w[i : i + n])) in seen:
                own.append(i)
            seen.add(run)
        out.append(own)
    return out


@pytest.mark.parametrize("noise", [4, 7, 20])
def test_against_every_place(make, noise):
    """Runs of 2 * noise words that stand before lose noise words at least, all if two texts alone have them; of what goes, all stood before."""
    rng = random.Random(noise)
    vocabulary = [words(rng, 1, 0) + str(i) for i in range(300)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [some(rng.randrange(noise, 5 * noise)) for _ in range(12)]
    texts = []
    for k in range(60):
        w = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += some(rng.randrange(0, 2 * noise)) + (p if rng.random() < 0.5 else p[a:]) + some(rng.randrange(0, 2 * noise))
        texts.append(rng.choice(["", " "]) + rng.choice([" ", "\n", "\t "]).join(w))
    once = [some(2 * noise) for _ in range(5)]
    texts += [" ".join(some(9) + p + some(9)) for p in once * 2]
    texts += [texts[3], texts[3] + " ", " ".join(passages[0] * 3), " ".join(["same"] * 10 * noise)]
    rows = linededup.line_dedup(make(texts), noise).orderBy("doc_id").collect()
    gone = [{i for r in row.runs for i in range(r.s - 1, r.e)} for row in rows]
    for d, (row, t) in enumerate(zip(rows, texts, strict=True)):
        assert row.text.split() == [w for i, w in enumerate(t.split()) if i not in gone[d]]
    for d, places in enumerate(earlier_runs(texts, 2 * noise)):
        for i in places:
            assert len(gone[d] & set(range(i, i + 2 * noise))) >= noise, (d, i)
    for d in range(65, 70):
        assert set(range(9, 9 + 2 * noise)) <= gone[d] and len(gone[d]) < 9 + 2 * noise + 9
    for d, places in enumerate(earlier_runs(texts, noise)):
        assert gone[d] <= {j for i in places for j in range(i, i + noise)}, d


def test_a_very_long_text(make):
    import time

    rng = random.Random(15)
    long = " ".join(str(rng.getrandbits(30)) for _ in range(500_000))
    began = time.time()
    out = linededup.line_dedup(make(["few words", long + " x " + long, "so " * 400_000])).orderBy("doc_id").collect()
    assert out[0].text == "few words"
    assert out[1].text.split() == [*long.split(), "x"] and len(out[2].text.split()) <= 2
    assert time.time() - began < 200


def test_words_by_the_plain_and_the_odd_way(make):
    texts = ["a b\nc", "a  b", "a\n\nb", " a b", "a b\n", "a\tb", "a\rb c", "", " \n", None, "é\x0bß 日本", "one"]
    for r in make(texts).select("text", linededup.words_in(F.col("text")).alias("w")).collect():
        assert r.w == (re.split(r"[\x20\x09-\x0D]+", (r.text or "").strip(" \t\n\x0b\f\r")))


def test_words_are_compared_at_the_ends_of_runs_alone(make):
    """Of a passage of many fingerprints, only the first and the last need the words around them from the other text."""
    rng = random.Random(16)
    passage = words(rng, 1000, 0)
    texts = [f"{words(rng, 60, 0)} {passage} {words(rng, 60, 0)}" for _ in range(3)]
    found = linededup.repeats(make(texts)).collect()
    places = [f for r in found for f in r.far]
    assert len(places) > 150
    assert 4 <= sum(f.prior is not None or f.next is not None for f in places) <= 8
    for i, r in enumerate(linededup.line_dedup(make(texts)).orderBy("doc_id").collect()):
        assert r.text == (texts[i] if not i else texts[i].replace(passage + " ", ""))
