"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, operator by operator."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, exact_dedup, language, lm, pieces, quality, secrets, simhash, substring, warc
from quern.llm.common import held_out

from .conftest import rows

WHITE = r"[\x20\x09-\x0D]+"


def benchmark(spark):
    return spark.createDataFrame([(1, "twice the same row"), (2, None), (3, ""), (None, "... !!")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "simhash": lambda d: simhash.near_groups(d).select("doc_id", "component_id"),
    "simhash_wide": lambda d: simhash.near_groups(d, 5, 18, 4, 44, distinct=True).select("doc_id", "component_id"),
    "secrets": lambda d: secrets.find_secrets(d).select("doc_id", F.size("found").alias("n")),
    "exact_dedup": lambda d: exact_dedup.exact_groups(d),
    "quality": lambda d: quality.score(d, quality.train(d, labels(d.sparkSession), ~held_out(5, 0))),
    "substring": lambda d: substring.remove_repeats(d).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept")),
    "pieces": lambda d: pieces.encode_decode(d, pieces.MODEL, "doc_id").select("doc_id", F.size("token_ids").alias("n"), F.sha2("decoded", 256).alias("back")),
    "decontaminate": lambda d: decontaminate.find_leaks(d, benchmark(d.sparkSession)).select("doc_id", F.concat_ws(",", F.col("item_ids").cast("array<string>")).alias("items"), "overlap"),
    "lm": lambda d: lm.score_texts(d, ~held_out(7, 2)).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base")),
    "language": lambda d: language.identify(d, language.train(d, ~held_out(5, 0)), "doc_id").select("doc_id", "lang_pred"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_each_row_and_clashing_names_change_nothing(docs, clashing, name):
    got = sorted(map(str, OPERATORS[name](docs).collect()))
    assert len(got) == len(rows())
    assert got == sorted(map(str, OPERATORS[name](clashing).collect()))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(nothing, name):
    assert OPERATORS[name](nothing).collect() == []


def test_exact_groups(docs):
    texts = [(r[0], re.sub(WHITE, " ", r[1] or "")) for r in rows()]
    want = {}
    for i, t in texts:
        if i is not None:
            want[t] = min(want.get(t, i), i)
    for r in exact_dedup.exact_groups(docs).collect():
        mine = [t for i, t in texts if i == r["doc_id"] and hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]]
        assert mine and r["keep_id"] == want.get(mine[0]) and r["group_size"] == sum(t == mine[0] for _, t in texts) and r["kept"] == (r["doc_id"] == r["keep_id"])


def test_index_takes_batches(spark, docs):
    """The anti-join leaves what is new; totals count all batches, whose later ones may have smaller ids; a batch counts once."""
    index = exact_dedup.fresh_index(spark)
    own = exact_dedup.digests(docs.where("doc_id IS NOT NULL"))
    first, second = own.where("doc_id >= 105"), own.where("doc_id < 130")
    index.append(first, "a")
    n = index.table().count()
    assert "LeftAnti" in index.new(index.groups(second))._jdf.queryExecution().toString()
    index.append(second, "b")
    all_ = first.unionByName(second)
    want = {r[0]: (r[1], r[2]) for r in all_.groupBy("text_sha256").agg(F.min("doc_id"), F.count("*")).collect()}
    totals = lambda: {r["text_sha256"]: (r["keep_id"], r["group_size"]) for r in index.totals().collect()}
    assert totals() == want and n < index.table().count() == len(want)
    index.append(second, "b")
    assert totals() == want
    index.drop()


def test_groups_with_an_index_count_earlier_batches(spark):
    index = exact_dedup.fresh_index(spark)
    make = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    exact_dedup.exact_groups(make((5, "a b"), (6, "c")), index).collect()
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(make((2, "a\tb"), (9, "d")), index).collect()}
    assert got == {2: (2, 2, True), 9: (9, 1, True)}
    index.drop()


def test_keep_first(clashing):
    kept = exact_dedup.keep_first(clashing)
    assert kept.columns == clashing.columns
    texts = [re.sub(WHITE, " ", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(WHITE, " ", r[1] or "") for r in rows()})


@pytest.mark.parametrize("many", [0, 2, 64])
def test_substring_by_brute_force(docs, monkeypatch, many):
    """With all anchors compared by their extensions' words, some, and none."""
    monkeypatch.setattr(substring, "MANY", many)
    from collections import Counter

    data = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows()]
    first: dict[tuple, int] = {}
    for i, w in data:
        if i is not None:
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, w in data:
        gone = set()
        if i is not None:
            for k in range(len(w) - 12):
                if first[tuple(w[k : k + 13])] < i:
                    gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect())
    assert got == want


def test_substring_anchor_repeated_in_few_documents(spark):
    """A phrase that is an anchor, as its hash is small, and that two documents repeat thousands of times in other surroundings, makes no run of pairs of all its occurrences."""
    rng = random.Random(5)
    texts = [" ".join(f"{rng.randrange(10**6)} {rng.randrange(10**6)} {rng.randrange(10**6)} once they been it said" for _ in range(4000)) for _ in range(2)]
    texts[1] = f"{texts[1]} {texts[0][:300]}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lists = substring._shared_seeds(substring._dealt(docs))
    most = lambda which: lists.select(F.explode(which).alias("s")).groupBy("s.h").count().agg(F.max("count")).first()[0] or 0
    assert most("few") <= substring.MANY < most("many")
    first, words = {tuple(w[k : k + 13]) for w in [texts[0].split()] for k in range(len(w) - 12)}, texts[1].split()
    gone = {j for k in range(len(words) - 12) if tuple(words[k : k + 13]) in first for j in range(k, k + 13)}
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substring.remove_repeats(docs).collect()}
    assert gone
    assert got == {0: (0, " ".join(texts[0].split())), 1: (len(gone), " ".join(w for j, w in enumerate(words) if j not in gone))}


PAGES = [(1, "http://a/", "x" * 2000), (2, "http://b/", "x" * 2000), (None, None, "x" * 2000), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u\r\nX: y", "é😀" * 40_000), (8, "u", "a\r\n0\r\n\r\nWARC/1.1\r\n" * 100), (2, "http://b/", "x" * 2000)]


def test_warc_round_trip(spark, write_tables):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("payload", F.lit("clash"))
    got = warc.op1_warc(spark, write_tables(pages=pages)).collect()
    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        target = max((p or -1 for p, _, h in PAGES if (h or "") == (html or "")), default=None)
        revisit = len(body) >= 1000 and i != target
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", target if revisit else None))
    assert sorted(map(str, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got))) == sorted(map(str, want))
    assert warc.op1_warc(spark, write_tables(pages=pages.where("false"))).collect() == []


def test_a_page_that_comes_back_otherwise_is_an_error(spark, write_tables, monkeypatch):
    read = warc.read_parts
    folder = write_tables(pages=spark.createDataFrame([(1, "u", "y" * 50_000)], "page_id long, url string, html string"))
    monkeypatch.setattr(warc, "read_parts", lambda *a: read(*a).where("number <> 2"))
    with pytest.raises(Exception, match="page 1 didn't come back"):
        warc.op1_warc(spark, folder).collect()


def test_broken_segments_are_told(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "y" * 50_000), (2, "v", "z" * 10)], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    parts = warc.read_parts(spark, str(tmp_path / "w")).cache()
    assert parts.count() == 5
    whole = {r["page_id"]: (r["whole"], r["payload_bytes"]) for r in warc.reassemble(parts).collect()}
    assert whole == {1: (True, 50_000), 2: (True, 10)}
    lacking = {r["page_id"]: r["whole"] for r in warc.reassemble(parts.where("number <> 2")).collect()}
    assert lacking == {1: False, 2: True}
    wrong = parts.withColumn("total", F.when(F.col("number") > 1, F.col("total") + 1).otherwise(F.col("total")))
    assert {r["page_id"]: r["whole"] for r in warc.reassemble(wrong).collect()}[1] is False
    with pytest.raises(ValueError, match="chunk"):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")
