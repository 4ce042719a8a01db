"""The pipeline, each stage against brute force on what the stage before it kept."""

import random

import pytest

import corpus_pipeline
from filequarry.llm import decontaminate, packing, quality
from filequarry.llm.queries import byte_bpe

from .conftest import words
from .test_pairs import slow_components, slow_ends_all, slow_fingerprint
from .test_storage import check


@pytest.fixture(scope="module")
def tables(spark, make, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(1)
    items = [words(rng, 30) for _ in range(6)]
    texts, marks = [], []
    for _ in range(260):
        t = ". ".join(words(rng, rng.randrange(3, 20), 0).capitalize() for _ in range(rng.randrange(1, 8)))
        good = rng.random() < 0.8
        if not good:
            t = t.upper().replace(" ", "!! ") + "!!"
        texts.append(t)
        marks.append(int(good))
    passage = words(rng, 60, 0).capitalize() + ". " + words(rng, 20, 0).capitalize() + "."
    for k in range(0, 40, 4):
        texts[k], marks[k] = f"{texts[k + 1]} {passage} {words(rng, 10)}", marks[k + 1]
    for k in (50, 60, 70):
        texts[k], marks[k] = f"{words(rng, 20)} {items[k % 6]} {words(rng, 20)}", 1
    texts += [texts[100]] * 3 + ["short one", "short one", "", "", None]
    make(texts).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in enumerate(marks)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, passage, items


def test_stages(spark, tables, tmp_path):
    d, passage, items = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [{r.doc_id: r for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
            seen.append({r.doc_id: r for r in docs.collect()})
        else:
            packed = docs.collect()
    whole, judged, trimmed, thinned, clean = seen
    good = {r.doc_id for r in quality.classify(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).where("predicted = 1").collect()}
    assert set(judged) == good and all(judged[i] == whole[i] for i in judged)
    with_passage = sorted(i for i, r in judged.items() if passage in (r.text or ""))
    assert len(with_passage) > 3 and [i for i, r in trimmed.items() if passage in (r.text or "")] == with_passage[:1]
    assert all(r.n_chars == len(r.text) for i, r in trimmed.items() if r.text is not None)
    assert {i for i, r in trimmed.items() if r.text != judged[i].text} | (set(judged) - set(trimmed)) <= {i for i in judged if i >= 40 or i % 4 < 2}
    ids = sorted(trimmed)
    groups = slow_components([slow_fingerprint(trimmed[i].text, 5) for i in ids])
    assert set(thinned) == {ids[g] for g in groups}
    held = {i for i, r in thinned.items() if any(slow_ends_all(decontaminate.plain(t), decontaminate.plain(r.text)) <= decontaminate.RATE * len(t) for t in items)}
    assert held and set(clean) == set(thinned) - held
    check(packed, [(i, r.text) for i, r in clean.items()], packing.encoder(byte_bpe()), packing.LENGTH)


def test_run_is_its_stages(spark, tables):
    d, *_ = tables
    rows = corpus_pipeline.run(spark, d).collect()
    assert rows and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert corpus_pipeline.run(spark, d).count() == len(rows)


def test_empty_tables(spark, tables, tmp_path):
    d, *_ = tables
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
