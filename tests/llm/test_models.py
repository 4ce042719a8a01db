"""Language model, quality and toxicity: brute force and held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from filequarry.llm import classlm, quality, toxicity

from .conftest import words


def held(i, folds, rest):
    return i is not None and zlib.crc32(str(i).encode()) % folds == rest


# ---- language model


def languages(rng, n):
    kinds = [[words(rng, 1) for _ in range(60)] for _ in range(3)]
    out = []
    for _ in range(n):
        kind = rng.choice(kinds)
        out.append(" ".join(rng.choice(kind) if rng.random() < 0.95 else words(rng, 1) for _ in range(rng.randrange(0, 40))))
    return out


def test_base_scores(make, monkeypatch):
    monkeypatch.setattr(classlm, "WORDS", 20)
    monkeypatch.setattr(classlm, "HEAD", 30)  # most words meet their counts in the join
    monkeypatch.setattr(classlm, "CHUNK", 300)
    rng = random.Random(1)
    texts = [*languages(rng, 500), None, "", "Éé \x0b UP up"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (3, texts[3]), (3, texts[3])]
    count, n = Counter(), 0
    for i, t in docs:
        if not held(i, 7, 2):
            count.update((t or "").encode().lower().split() + [b"\n"])
    n, v = sum(count.values()), len(count)
    rows = classlm.lm_scores(make(docs)).collect()
    assert len(rows) == len(docs)
    ours, base = 0.0, 0.0
    for r in rows:
        t = "a b" if r.doc_id is None else texts[r.doc_id]
        seq = (t or "").encode().lower().split() + [b"\n"]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id, 7, 2), len(seq), n)
        assert r.n_known == sum(count[w] > 0 for w in seq)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in seq), rel=1e-9)
        assert r.score < 0
        if r.held_out:
            ours, base = ours + r.score, base + r.base_score
    assert ours > base


def test_probabilities_sum_to_one(make):
    rng = random.Random(2)
    docs = make([(i, t) for i, t in enumerate(languages(rng, 80)) if not held(i, 7, 2)])
    counts = classlm.word_counts(docs.select("text"))
    m = classlm.train(docs.select("doc_id", "text"), counts)
    assert np.allclose((10**m.follows).sum(1), 1)
    total = np.zeros(classlm.CLASSES)
    np.add.at(total, m.own, 10**m.emits)
    assert np.allclose(total[np.unique(m.own)], 1)
    n = {r.word: (r.n, r.suffix) for r in counts.collect()}
    for g in range(classlm.GROUPS):
        own = [c for w, (c, s) in n.items() if s == g and w not in m.units.own]
        if own:  # known words, and one that is not
            assert sum(c + 1 for c in own) + 1 == pytest.approx(10 ** m.divisor[m.units.groups + g])


def test_exchange_never_loses_likelihood():
    rng = np.random.default_rng(3)
    pairs = rng.poisson(0.3, (40, 40)).astype(float)
    for a, b in ((slice(1, 20), slice(1, 20)), (slice(20, 40), slice(20, 40))):
        pairs[a, b] += rng.poisson(3, (pairs[a, b].shape))

    def likelihood(own):
        m = np.zeros((40, 4))
        m[np.arange(40), own] = 1
        g = m.T @ pairs @ m
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(g) - f(g.sum(0)) - f(g.sum(1))

    last = -np.inf
    for sweeps in range(5):
        now = likelihood(classlm.exchange(pairs, 4, sweeps))
        assert now >= last - 1e-6
        last = now
    own = classlm.exchange(pairs, 3, 10)
    assert own[0] == 0 and len(set(own[1:20])) == len(set(own[20:])) == 1 and own[1] != own[20]


def test_awkward_scores(awkward, empty):
    rows = classlm.lm_scores(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert classlm.lm_scores(empty).count() == 0


def test_nothing_to_learn_from(make):
    only = next(i for i in range(1000) if held(i, 7, 2))
    (r,) = classlm.lm_scores(make([(only, "a b")])).collect()
    assert (r.held_out, r.n_known, r.train_tokens, r.base_score) == (True, 0, 0, 0.0) and math.isfinite(r.score)


# ---- quality


@pytest.fixture(scope="module")
def judged(spark, make):
    rng = random.Random(4)
    texts, marks = [], []
    for _ in range(600):
        t = words(rng, rng.randrange(1, 120))
        good = rng.random() < 0.8
        if not good:
            t = rng.choice([t.upper().replace(" ", "!! "), t.replace(" ", " | "), " ".join(w + "$$$" for w in t.split()), (t.split()[0] + " ") * 80])
        texts.append(t)
        marks.append(int(good))
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(marks)], "doc_id long, quality int, toxic int")
    return make(texts), labels, marks


def test_held_out_quality(judged):
    docs, labels, marks = judged
    rows = quality.classify(docs, labels).collect()
    own = [r for r in rows if r.held_out]
    assert len(own) > 60 and all(r.held_out == held(r.doc_id, 5, 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == marks[r.doc_id] for r in own) / len(own) > 0.9


def test_keep_good(judged):
    docs, labels, marks = judged
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert sum(i in ids for i, q in enumerate(marks) if q) / sum(marks) > 0.97
    assert sum(i in ids for i, q in enumerate(marks) if not q) / (len(marks) - sum(marks)) < 0.2


def test_held_out_labels_are_never_read(judged):
    docs, labels, _ = judged
    wrong = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [{r.doc_id: r.score for r in quality.classify(docs, x).collect()} for x in (labels, wrong)]
    assert scores[0] == scores[1]


def test_pairs_matter():
    rng = np.random.default_rng(5)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert any({i, j} == {0, 1} for i, j, *_ in model.pairs)
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.85


def test_awkward_quality(spark, judged, awkward, empty):
    _, labels, _ = judged
    rows = quality.classify(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.text_key == rows[0].text_key}) == 1
    assert quality.classify(empty, labels).count() == 0
    nulls = spark.createDataFrame([(None, 1, 1), (4, None, None), (4, 1, 0), (4, 0, 1)], labels.schema)
    assert quality.classify(awkward, nulls).count() == awkward.count()
    assert {r.score for r in quality.classify(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(awkward, labels).columns == awkward.columns


# ---- toxicity


@pytest.fixture(scope="module")
def insulting(spark, make):
    rng = random.Random(6)
    bad = ["zzidiot", "qqmoron", "wwscum", "xxtrash"]
    texts, n = [], []
    for _ in range(700):
        w = words(rng, rng.randrange(5, 100)).split()
        k = rng.choice([0] * 7 + [1, 3, 9])
        for _ in range(k):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "s", ".", "!"]))
        texts.append(" ".join(w))
        n.append(k)
    labels = spark.createDataFrame([(i, 1, int(k > 0)) for i, k in enumerate(n)], "doc_id long, quality int, toxic int")
    return make(texts), labels, n


def test_held_out_toxicity(insulting):
    docs, labels, n = insulting
    rows = toxicity.toxicity(docs, labels).collect()
    own = [r for r in rows if r.held_out]
    assert len(own) > 80
    assert sum(r.toxic == (n[r.doc_id] > 0) for r in own) / len(own) > 0.95
    mean = lambda k: np.mean([r.severity for r in own if n[r.doc_id] == k])
    assert mean(0) < 0.2 < mean(1) < mean(9) <= toxicity.GRADES - 1


def test_severity_follows_what_was_planted(make, insulting):
    """An outside measure: how many insults a text was given, which neither the labels nor the model's grades tell."""
    docs, labels, _ = insulting
    rng = random.Random(8)
    texts = []
    for k in range(8):
        for _ in range(60):
            w = words(rng, 60).split()
            for _ in range(k):
                w.insert(rng.randrange(len(w)), rng.choice(["zzidiot", "qqmoron", "wwscum", "xxtrash"]))
            texts.append(" ".join(w))
    both = docs.union(make(texts, 10_000))
    got = {r.doc_id - 10_000: r.severity for r in toxicity.toxicity(both, labels).collect() if r.doc_id >= 10_000}
    pairs = [(i // 60, got[i]) for i in got]
    ordered = [(a < b) == (x < y) for a, x in pairs for b, y in pairs if a != b and x != y]
    mean = [np.mean([s for k, s in pairs if k == n]) for n in range(8)]
    assert np.mean(ordered) > 0.9 and mean[0] < mean[1] < mean[4] < mean[7]


def test_slopes_of_the_loss():
    rng = np.random.default_rng(9)
    n, m = 60, 7
    y = rng.integers(0, toxicity.GRADES, n)
    r, c = (x.ravel() for x in np.nonzero(rng.random((n, m)) < 0.4))
    w, free = rng.normal(size=m), rng.normal(size=toxicity.GRADES - 1)
    _, gw, gf = toxicity.loss(w, free, r, c, y)
    x, step = np.concatenate([w, free]), 1e-6
    for i, g in enumerate(np.concatenate([gw, gf])):
        up, down = x.copy(), x.copy()
        up[i] += step
        down[i] -= step
        slope = (toxicity.loss(up[:m], up[m:], r, c, y)[0] - toxicity.loss(down[:m], down[m:], r, c, y)[0]) / (2 * step)
        assert g == pytest.approx(slope, abs=1e-5)


def brute_score(m, texts, counts, n_group):
    """Scores by the definition, token by token: class after class, word in class, and in groups word in group."""
    out = []
    for t in texts:
        seq, cls, total = [*(t or "").encode().lower().split(), None], 0, 0.0
        for w in seq:
            h = None if w is None else classlm.Tokens([w], None, None).hashes()[0]
            i = 0 if w is None else m.units.own.get(int(h)) or m.units.groups + zlib.crc32(w[-3:]) % classlm.GROUPS
            total += m.follows[cls, m.own[i]] + m.emits[i]
            if i >= m.units.groups:
                total += math.log10((counts.get(int(h), 0) + 1) / n_group[i - m.units.groups])
            cls = m.own[i]
        out.append(total)
    return out


def test_scores_by_the_definition(spark, make, monkeypatch):
    monkeypatch.setattr(classlm, "WORDS", 20)
    monkeypatch.setattr(classlm, "HEAD", 400)
    rng = random.Random(4)
    texts = [*languages(rng, 300), None, "new wordsnever seenbefore"]
    docs = make(texts)
    known = docs.where(~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)))
    counts = classlm.word_counts(known.select("text"))
    m = classlm.train(known.select("doc_id", "text"), counts)
    told = {r.word: (r.n, r.suffix) for r in counts.collect()}
    n_group = {g: 1 for g in range(classlm.GROUPS)}
    for w, (n, g) in told.items():
        if w not in m.units.own:
            n_group[g] += n + 1
    assert 20 < len(m.units.own) < len(told)
    want = brute_score(m, texts, {w: n for w, (n, _) in told.items()}, n_group)
    got = {r.doc_id: r.score for r in classlm.lm_scores(docs).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-9)


def test_rarer_words_find_their_class(make, monkeypatch):
    """Words beyond the commonest, with endings at random, come to the classes of words used like them."""
    monkeypatch.setattr(classlm, "WORDS", 12)
    monkeypatch.setattr(classlm, "HEAD", 20_000)
    monkeypatch.setattr(classlm, "CLASSES", 6)
    rng = random.Random(5)
    name = lambda k, i: f"{'abc'[k]}{i}{''.join(rng.choice('xyzw') for _ in range(3))}"
    kinds = [[name(k, i) for i in range(40)] for k in range(3)]
    weight = [1 / (1 + i) for i in range(40)]
    texts = [" ".join(rng.choices(kinds[(i + j) % 3], weight)[0] for j in range(30)) for i in range(600)]
    docs = make(texts).select("doc_id", "text")
    m = classlm.train(docs, classlm.word_counts(docs.select("text")))
    of = {w: m.own[m.units.own[int(classlm.Tokens([w.encode()], None, None).hashes()[0])]] for k in kinds for w in k}
    main = [Counter(of[w] for w in k).most_common() for k in kinds]
    assert len({c for x in main for c, _ in x}) >= 3
    for k, x in enumerate(main):
        others = {c for j, y in enumerate(main) if j != k for c, _ in y}
        assert sum(n for c, n in x if c not in others) >= 0.9 * 40, main


def test_thresholds_and_weights():
    rng = random.Random(7)
    rows = []
    for _ in range(500):
        toxic = rng.random() < 0.3
        c = Counter({words(rng, 1).encode(): 1 for _ in range(20)})
        if toxic:
            c[b"bad"] = rng.randrange(1, 9)
        rows.append((c, int(toxic)))
    m = toxicity.fit(rows)
    assert (np.diff(m.thresholds) > 0).all() and all(w >= 0 for w in m.weights.values())
    above = m.above(np.array([m.logit(c) for c, _ in rows]))
    assert (np.diff(above, axis=1) <= 1e-12).all()
    assert np.mean((above[:, 0] > 0.5) == [t for _, t in rows]) > 0.98


def test_awkward_toxicity(spark, insulting, awkward, empty):
    _, labels, _ = insulting
    rows = toxicity.toxicity(awkward, labels).collect()
    assert len(rows) == awkward.count() and not any(r.toxic for r in rows)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert not any(r.toxic for r in toxicity.toxicity(awkward, labels.limit(0)).collect())
