"""The five stages: what each drops, what it keeps, and rows that go wrong."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline
from quern.llm import pieces

from .conftest import prose, rows


@pytest.fixture(scope="module")
def folder(spark, docs, write_tables):
    items = [(1, "twice the same row"), (2, rows()[5][1]), (3, None)]
    return write_tables(documents=docs, benchmark=spark.createDataFrame(items, "item_id long, text string"))


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_clashing_names_and_empty_tables(spark, folder, clashing, nothing, name):
    got = stage(name)(spark, clashing, folder)
    assert got.columns[: len(clashing.columns)] == clashing.columns
    assert len(got.collect()) <= len(rows())
    assert stage(name)(spark, nothing, folder).collect() == []


def test_language_stage(spark, folder, docs):
    kept = {r["doc_id"] for r in stage("language")(spark, docs, folder).collect()}
    assert not kept & {140, 141, 142, 145}
    assert set(range(60)) <= kept


def test_near_copies_go_but_one(spark, folder):
    rng = random.Random(12)
    base = [prose(rng, 200).split() for _ in range(20)]
    data = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):  # one word of two hundred is another: a similarity of 0.95
        near = [*w]
        near[17] = "other"
        data.append((100 + i, " ".join(near)))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in stage("near_dedup")(spark, df, folder).collect()) == list(range(20))


def test_near_copies_are_those_of_a_similarity_of_four_fifths(spark, folder):
    """Pairs of 0.70 to 0.79 stay, those of 0.80 and more are linked, texts of 4 and 5 shingles too."""
    rng, data, gone = random.Random(14), [], set()
    for i in range(60):
        w = [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(104)]  # 100 shingles
        own = [*w]
        if i % 3 == 0:  # three words apart: 85 of 115 shingles are shared, 0.739
            for at in (10, 40, 70):
                own[at] = f"other{i}"
        elif i % 3 == 1:  # two words apart: 90 of 110 shingles are shared, 0.818
            for at in (10, 40):
                own[at] = f"other{i}"
            gone.add(100 + i)
        else:  # 4 shingles and 5: 0.8
            w, own = w[:8], w[:9]
            gone.add(100 + i)
        data += [(i, " ".join(w)), (100 + i, " ".join(own))]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in stage("near_dedup")(spark, df, folder).collect()} == {i for i, _ in data} - gone


def test_rows_that_share_an_id_are_told_apart(spark, folder):
    rng = random.Random(13)
    a, b, c = (prose(rng, 100) for _ in range(3))
    data = [(1, a), (2, a), (2, b), (None, b), (None, c), (None, c), (3, "twice the same row"), (3, c + " and on")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r["doc_id"], r["text"]) for r in stage("near_dedup")(spark, df, folder).collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (3, "twice the same row"), (3, c + " and on")], key=str)
    left = stage("decontaminate")(spark, df, folder).collect()
    assert len(left) == 7 and [r["text"] for r in left if r["doc_id"] == 3] == [c + " and on"]


def test_exact_copies_go_but_the_first(spark, folder, docs):
    kept = stage("exact_dedup")(spark, docs, folder).collect()
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in kept]
    assert len(texts) == len(set(texts)) and {r["doc_id"] for r in kept} >= {100, 150}


def test_benchmark_passages_go(spark, folder, docs):
    gone = {r[0] for r in rows()} - {r["doc_id"] for r in stage("decontaminate")(spark, docs, folder).collect()}
    assert gone == {5, 150}


def test_whole_pipeline_by_brute_force(spark, folder):
    """What run() returns is what the stages leave one after the other, with the library's tokens."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = corpus_pipeline.run(spark, folder).collect()
    ids = [r["doc_id"] for r in got]
    assert len(ids) == len(set(ids)) + 1 and ids.count(151) == 2 and set(range(60)) - {5} <= set(ids)  # 151 names two texts
    assert 100 in ids and not set(ids) & {101, 111, 120, 122, 140, 141, 150}
    for r in got:
        if len(r["text"]) < 10_000:
            assert r["token_ids"] == sp.encode(r["text"]) and r["decoded"] == sp.decode(r["token_ids"]) and r["n_tokens"] == len(r["token_ids"])
