"""Line dedup against every place: of runs that stand twice nothing stays, whichever place has them."""

import random

import pytest

from filequarry.llm import linededup


def gone_of(row):
    return {i for r in row.runs for i in range(r.s - 1, r.e)}


def earlier(texts, n):
    """By text: the places whose next n words stand at an earlier place too."""
    seen, out = set(), []
    for t in texts:
        w, own = t.split(), []
        for i in range(len(w) - n + 1):
            if (run := tuple(w[i : i + n])) in seen:
                own.append(i)
            seen.add(run)
        out.append(own)
    return out


@pytest.mark.parametrize("noise, seed", [(4, 1), (7, 2), (20, 3)])
def test_whole_runs_go_whichever_place_has_them(make, noise, seed):
    rng = random.Random(seed)
    some = lambda n: [f"w{rng.getrandbits(20)}" for _ in range(n)]
    texts = []
    for _ in range(8):
        core = some(noise + rng.randrange(noise))
        sides = [(some(noise), some(noise)) for _ in range(3)]
        for _ in range(6):  # the same core in three surroundings, as many times as chance has it
            w = some(rng.randrange(5))
            for a, z in rng.choices(sides, k=rng.randrange(1, 4)):
                w += a[rng.randrange(noise) :] + core + z[: rng.randrange(noise)] + some(rng.randrange(3))
            texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = linededup.line_dedup(make(texts), noise).orderBy("doc_id").collect()
    long, short = earlier(texts, 2 * noise), earlier(texts, noise)
    assert sum(map(len, long)) > 100
    for d, row in enumerate(rows):
        gone = gone_of(row)
        assert {j for i in long[d] for j in range(i, i + 2 * noise)} <= gone, d
        assert gone <= {j for i in short[d] for j in range(i, i + noise)}, d
        assert row.text.split() == [w for i, w in enumerate(texts[d].split()) if i not in gone]


def test_the_place_that_reaches_is_neither_the_first_nor_the_last(make):
    rng = random.Random(9)
    some = lambda n: " ".join(f"w{rng.getrandbits(30)}" for _ in range(n))
    core, left, right = some(40), some(10), some(12)
    texts = [f"{some(30)} {core} {some(30)}", f"{some(30)} {left} {core} {right} {some(30)}", f"{some(30)} {core} {some(30)}", f"{some(30)} {left} {core} {right} {some(30)}"]
    out = linededup.line_dedup(make(texts)).orderBy("doc_id").collect()
    assert gone_of(out[1]) == set(range(40, 80)) and gone_of(out[2]) == set(range(30, 70))
    assert gone_of(out[3]) == set(range(30, 92))
