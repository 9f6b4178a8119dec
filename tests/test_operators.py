"""Operators over small tables, with results worked out by hand or by plain Python."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import entities, queries, scoring, text, vectors
from quern.model import QueryError, valid_at
from quern.operators import diagnostics, evaluate, fusion, graph, knn, memory, portable, recall, search, timeseries
from quern.plans.parser import parse_path
from quern.sources import files, scip

NOW = "2024-02-01 00:00:00"


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    c = F.col("t")
    assert one(spark, text.tokens(c), t="Ab-cd  Été_9") == ["ab", "cd", "été", "9"]
    assert one(spark, text.code_tokens(c), t="HTTPClient load_auth2 getURL") == ["http", "client", "load", "auth2", "get", "url"]
    assert one(spark, text.keywords(c), t="How does the Login, flow work?!") == ["login", "flow", "work"] == text.query_keywords("How does the Login, flow work?!")
    assert one(spark, text.chunks(c, 4, 1), t="abcdefgh") == ["abcd", "defg", "gh"]
    assert one(spark, text.chunks(c, 10, 1), t="abc") == ["abc"]
    assert one(spark, text.jaccard(c, F.lit("b c d")), t="a b c") == 0.5
    assert one(spark, text.ngrams(F.split(c, " "), 3), t="a b c d") == ["a b c", "b c d"]
    assert "<b>needle</b>" in one(spark, text.snippet(c, "needle", 30), t="x" * 50 + " needle " + "y" * 50)
    assert one(spark, text.levenshtein_transposed(c, F.lit("hello"), 1), t="hlelo")
    assert not one(spark, text.levenshtein_transposed(c, F.lit("hello"), 1), t="hlleo x")


def test_simhash_is_fnv_over_grams(spark):
    def slow(s: str) -> int:
        s = " ".join(s.lower().split())
        if not s:
            return 0
        votes = [0] * 64
        for i in range(max(1, len(s) - 3)):
            h = 0xCBF29CE484222325
            for b in s[i : i + 4].encode():
                h = (h ^ b) * 0x100000001B3 % 2**64
            for k in range(64):
                votes[k] += 1 if h >> k & 1 else -1
        got = sum(1 << k for k in range(64) if votes[k] > 0)
        return got - 2**64 if got >> 63 else got

    samples = ["", "a", "abc", "Hello  World", "éàü 漢字 😀 text", "x" * 100]
    rows = spark.createDataFrame([(s,) for s in samples], "t string")
    assert [r[0] for r in rows.select(text.simhash("t")).collect()] == [slow(s) for s in samples]


def test_entities_and_captures(spark):
    found = {(e["name"], e["entity_type"]) for e in entities.entities("fixed `AuthModule` in ./src/auth/login.rs, HTTPClient calls auth_token; `./a/b.py` \"one two three\" fn load_it auth::login")}
    assert {("AuthModule", "code"), ("/src/auth/login.rs", "file"), ("http_client", "code"), ("auth_token", "code"), ("./a/b.py", "file"), ("one two three", "reference"), ("load_it", "symbol"), ("auth::login", "symbol")} <= found
    c = F.col("t")
    got = one(spark, entities.captures(c), t="start of it\nerror: cannot open the socket\nWe decided to retry with backoff")
    assert [(x["kind"], x["summary"]) for x in got] == [("error", "error: cannot open the socket"), ("decision", "We decided to retry with backoff")]
    for quiet in ("tests passed and the build failed with exit code 1", "short failed", "the plan failed to impress anyone at all", "a fatal flaw of the story was its ending"):
        assert one(spark, entities.captures(c), t=quiet) == []
    assert one(spark, entities.emails(c), t="to a.b+c@x-y.org, and d@e") == ["a.b+c@x-y.org"]
    assert one(spark, entities.ipv4(c), t="10.0.0.255 and 10.0.0.256") [:1] == ["10.0.0.255"]
    assert one(spark, entities.preferences(c), t="I prefer tabs.\nAlways write tests\nUse jq for JSON.") == ["I prefer tabs", "Always write tests", "Use jq for JSON"]
    assert entities.snake("HTTPClient") == "http_client"


@pytest.mark.parametrize(
    ("query", "kind"),
    [("550e8400-e29b-41d4-a716-446655440000", "uuid"), ("https://a.b/c", "hostname"), ("src/db.rs", "path"), ("./x", "path"), ("config.toml", "path"), ("api.example.com", "hostname"), ("Foo::bar", "symbol"), ("run()", "symbol"), ("1234567", "numeric-id"), ("2026", "natural-language"), ("01ARZ3NDEKTSV4RRFFQ69G5FAV", "numeric-id"), ("get_user", "symbol"), ("getUser", "symbol"), ("login", "natural-language"), ("fn login", "symbol"), ("how to log in", "natural-language"), ("", "natural-language")],
)
def test_query_class(spark, query, kind):
    assert queries.class_of(query) == kind
    assert one(spark, queries.query_class(F.col("t")), t=query) == kind


def test_temporal_phrases():
    now = dt.datetime(2026, 4, 10, 12, tzinfo=dt.UTC)
    at = lambda q: queries.parse_temporal(q, now)
    t, rest = at("errors 3 days ago in auth")
    assert (t.target, t.window_days, rest) == (now - dt.timedelta(days=3), 3.0, "errors in auth")
    assert at("2 weeks ago")[0].window_days == 7.0
    assert at("what broke yesterday")[1] == "what broke"
    assert at("on 2026-03-15 deploy")[0].target.date() == dt.date(2026, 3, 15)
    assert at("December 24 outage")[0].target.year == 2025
    assert at("nothing here") is None
    assert queries.duration_seconds("90d") == 7_776_000 and queries.duration_seconds("x") is None
    assert queries.intent("why did we switch") == "causality" and queries.intent("changes in the last 3 days") == "temporal" and queries.intent("login flow") == "combined"


def test_scores(spark):
    lit = F.lit
    assert one(spark, scoring.importance(lit("We made a decision about the security of the new login and it has more than twenty words in it so that it counts as long"), lit(4), lit(4), lit("decision"))) == 1.0
    assert one(spark, scoring.importance(lit(""), lit(4), lit(4), lit("x"))) == 0.5
    assert round(one(spark, scoring.effective_importance(lit(0.8), lit(90.0), lit(0), lit(False))), 6) == 0.4
    assert one(spark, scoring.tier(lit(0.5), lit(3.0), lit(0.6), lit(False))) == "hot"
    assert round(one(spark, scoring.recency_decay(lit("2024-01-25 00:00:00").cast("timestamp_ntz"), NOW)), 6) == 0.5
    assert one(spark, scoring.trust_tier(lit(None).cast("boolean"), lit(None).cast("boolean"), lit(None).cast("boolean"), lit(None).cast("string"), lit(None).cast("boolean"), lit(0.4))) == "suggested"
    assert one(spark, valid_at(lit(5), lit(5), lit(6))) and not one(spark, valid_at(lit(6), lit(5), lit(6)))


def test_search_syntax(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "quick fox runs"), (3, "brown bear"), (4, None), (5, "fox quick")], "id int, body string")
    hit = lambda q: sorted(r["id"] for r in search.bm25(docs, "id", "body", q).collect())
    assert hit("fox") == [1, 2, 5] and hit("+fox +brown") == [1] and hit("fox -brown") == [2, 5] and hit("fox AND brown") == [1]
    assert hit('"quick fox"') == [2] and hit('"quick fox"~1') == [1, 2] and hit("zebra") == []
    assert sorted(r[0] for r in search.phrase_rows(docs, "id", "body", "quick fox", 1).collect()) == [1, 2]
    for bad in ("id:5", "x" * 600):
        with pytest.raises(QueryError):
            search.parse_text_query(bad)
    near = {r["term"] for r in search.fuzzy_terms(docs, "body", "quikc", 1).collect()}
    assert near == {"quick"}


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 16)).astype(np.float32)
    return m, spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(m)], "id int, vector array<float>, g int")


def test_knn_against_brute_force(spark, vecs):
    m, df = vecs
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    order = np.argsort(-(u @ u[7]), kind="stable")
    assert [r["id"] for r in knn.search(df, "id", "vector", [m[7].tolist()], 10).collect()] == order[:10].tolist()
    assert [r["id"] for r in knn.by_id(df, "id", "vector", 7, 5).collect()] == order[1:6].tolist()
    hits = {r["id"] for r in knn.two_phase_int8(df, "id", "vector", m[7].tolist(), 10).collect()}
    assert len(hits & set(order[:10].tolist())) >= 9
    hits = {r["id"] for r in knn.two_phase_binary(df, "id", "vector", m[7].tolist(), 10).collect()}
    near = np.lexsort((np.arange(300), ((m > 0) != (m[7] > 0)).sum(axis=1)))[:80]
    assert hits == set(sorted(near.tolist(), key=lambda i: -(u[i] @ u[7]))[:10])
    sims = u @ u.T
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if i % 3 == j % 3 and sims[i, j] >= 0.5}
    for tile in (2048, 17):
        assert {(r["a"], r["b"]) for r in knn.similarity_join(df, "id", "vector", 0.5, "g", tile).collect()} == want
    assert one(spark, vectors.cosine01(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0


def test_fusion(spark):
    a = spark.createDataFrame([("x", 0.9), ("y", 0.5)], "id string, score double")
    b = spark.createDataFrame([("y", 3.0), ("z", 2.0)], "id string, score double")
    lists = [fusion.ranked(a, "a"), fusion.ranked(b, "b")]
    got = {r["id"]: round(r["score"], 6) for r in fusion.rrf(lists).collect()}
    assert got == {"x": round(1 / 60, 6), "y": round(1 / 61 + 1 / 60, 6), "z": round(1 / 61, 6)}
    assert fusion.widened_k(10, 0.3, 0.5) == 15 and fusion.widened_k(10, 0.4, 0.5) == 10
    near = spark.createDataFrame([("p", 0.9, "the same long text about the login flow"), ("q", 0.8, "The same  long text about the login flow"), ("r", 0.7, "something else entirely, about parsing of queries")], "id string, score double, text string")
    assert sorted(r["id"] for r in fusion.collapse_near(near, "text").collect()) == ["p", "r"]
    budget = spark.createDataFrame([("p", 3.0, "a" * 40), ("q", 2.0, "b" * 400), ("r", 1.0, "c" * 20)], "id string, score double, text string")
    assert sorted(r["id"] for r in fusion.within_budget(budget, "text", 20).collect()) == ["p", "r"]


def test_recall_filters_before_cut(spark):
    docs = spark.createDataFrame([(f"d{i}", "note about login", dt.datetime(2024, 1, 1 + i), "user" if i == 9 else None) for i in range(10)], "id string, text string, created_at timestamp_ntz, _scope string")
    vecs_ = spark.createDataFrame([(f"d{i}", [1.0, i / 10]) for i in range(10)], "id string, vector array<float>")
    got = recall.recall(docs, vecs_, recall.Recall("login", NOW, 3, scopes=("user",)), [1.0, 0.0]).collect()
    assert [r["id"] for r in got] == ["d9"] and {s["signal"] for s in got[0]["signals"]} >= {"vector_similarity", "recency", "keyword_match"}


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src string, edge_type string, dst string, valid_from timestamp_ntz, valid_until timestamp_ntz")


def test_graph(spark):
    e = edges_of(spark, [("a", "x", "b", None, None), ("b", "x", "c", None, None), ("c", "x", "a", None, None), ("c", "y", "d", dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)), ("a", "x", "a", None, None)])
    ids = lambda df: sorted(r["id"] for r in df.collect())
    start = spark.createDataFrame([("a",)], "id string")
    assert ids(graph.traverse(e, start, parse_path("->x->x->x"))) == ["a", "b", "c"]
    assert ids(graph.neighbors(e, start, "both")) == ["a", "b", "c"]
    c = spark.createDataFrame([("c",)], "id string")
    assert ids(graph.neighbors(e, c, "out", "y", "2024-01-31 00:00:00")) == ["d"]
    assert ids(graph.neighbors(e, c, "out", "y", "2024-02-01 00:00:00")) == []
    assert {(r["id"], r["hop"], r["parent"]) for r in graph.lineage(e, start, 5).collect()} == {("a", 0, None), ("b", 1, "a"), ("c", 2, "b"), ("d", 3, "c")}
    assert graph.connection(e, "a", "d").first()["nodes"] == ["a", "c", "d"]
    assert graph.connection(e, "a", "nobody").count() == 0
    got = graph.infer(edges_of(spark, [("m", "manages", "t", None, None), ("t", "part_of", "o", None, None), ("n", "supersedes", "k", None, None), ("n", "outdated", "k", None, None)]))
    assert [(r["src"], r["derived"], r["dst"]) for r in got.collect()] == [("m", "works_in", "o")]
    m = spark.createDataFrame([(1, "p"), (1, "q"), (2, "q"), (2, "p"), (2, "p"), (3, "p"), (3, "r")], "r int, e string")
    assert [(r["a"], r["b"], r["shared"]) for r in graph.co_mentions(m, "r", "e").collect()] == [("p", "q", 2)]


def test_pagerank_against_plain_python(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(30)]
    e = spark.createDataFrame(pairs, "src string, dst string")
    nodes = sorted({x for p in pairs for x in p})
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(7):
        new = dict.fromkeys(nodes, 0.15 / len(nodes))
        for s, d in pairs:
            new[d] += 0.85 * rank[s] / sum(p[0] == s for p in pairs)
        rank = new
    got = {r["id"]: r["rank"] for r in graph.pagerank(e, 0.85, 7).collect()}
    assert got.keys() == rank.keys() and all(abs(got[n] - rank[n]) < 1e-12 for n in nodes)
    assert graph.pagerank(e.where("false")).count() == 0


def test_memory(spark):
    rows = spark.createDataFrame([("a", "t", 1, False), ("b", "t", 2, False), ("c", "t", 3, True), ("d", "u", 9, False)], "id string, tab string, at int, _pinned boolean")
    v = spark.createDataFrame([(k, [1.0, 0.0]) for k in "abcd"], "id string, vector array<float>")
    assert [(r["old"], r["new"]) for r in memory.supersede_pairs(rows, v, "tab", "at").collect()] == [("a", "b")]
    pairs = spark.createDataFrame([("a", "b", 0.93, "the cache is used by login", "login does not use the cache any more", ["cache"])], "a string, b string, score double, a_text string, b_text string, shared array<string>")
    assert memory.conflicts(pairs).first()["confidence"] == "high"
    assert one(spark, memory.resolution(F.lit(0.96), F.lit(0.95))) == "duplicate" and one(spark, memory.resolution(F.lit(0.93), F.lit(0.1))) == "conflict_check"
    al = spark.createDataFrame([("DB", "global", "sqlite"), ("db", "project", "postgres")], "alias string, scope string, entity string")
    assert [tuple(r) for r in memory.narrowest_alias(al).collect()] == [("db", "postgres")]
    names = spark.createDataFrame([("Redis",), ("redis cache",), ("postgres",)], "n string")
    assert [(r["name"], r["auto"]) for r in memory.resolve_names(names, "n", "redis").collect()] == [("Redis", True), ("redis cache", False)]
    obs = spark.createDataFrame([("o1", "deploys always happen friday evening"), ("o2", "deploys never happen friday evening")], "id string, text string")
    bel = spark.createDataFrame([("b1", "deploys happen friday evening", 0.95)], "id string, statement string, confidence double")
    got = {r["observation"]: (r["action"], round(r["confidence"], 2)) for r in memory.revise_beliefs(obs, bel).collect()}
    assert got == {"o1": ("reinforce", 1.0), "o2": ("doubt", 0.95)}
    assert memory.fit_sections([("a", 1, 900), ("b", 4, 800), ("c", 5, 700)], 1800) == ["a", "b"]


def test_time_and_diagnostics(spark):
    daily = spark.createDataFrame([("t", "2024-01-01", 2, "daily_summary"), ("t", "2024-01-07", 3, "daily_summary"), ("t", "2024-01-08", 4, "daily_summary")], timeseries.SUMMARIES)
    assert {(r["period"], r["count"]) for r in timeseries.weekly_summaries(daily).collect()} == {("2024-01-01", 5), ("2024-01-08", 4)}
    assert {(r["period"], r["count"]) for r in timeseries.merge_summaries(daily.limit(1), daily, True).collect()} >= {("2024-01-07", 3)}
    nums = [random.Random(1).random() for _ in range(101)]
    got = diagnostics.percentiles(spark.createDataFrame([(x,) for x in nums], "v double"), "v").first()
    assert list(got) == [sorted(nums)[round(p * 100)] for p in (0.5, 0.95, 0.99)]
    ranked = spark.createDataFrame([(0, "a", 0), (0, "b", 1), (1, "c", 0)], "query int, id string, rank int")
    rel = spark.createDataFrame([(0, "b"), (0, "z"), (1, "q")], "query int, id string")
    per = {r["query"]: (r["recall"], r["hit"], r["reciprocal_rank"], r["false_positives"]) for r in evaluate.at_k(ranked, rel, 3).collect()}
    assert per == {0: (0.5, True, 0.5, 1), 1: (0.0, False, 0.0, 1)}


def records(spark, *rows):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, tab, data, t, t, None) for i, tab, data in rows], "id string, table string, data string, created_at timestamp_ntz, updated_at timestamp_ntz, metadata string")


def test_portable(spark, tmp_path):
    from quern.model import EDGES

    r = records(spark, ("r1", "notes", '{"a":1}'), ("r2", "notes", '{"b":2}'), ("r3", "_private", "{}"), ("r4", "_idx_x", "{}"))
    e = spark.createDataFrame([("e1", "r1", "x", "r2", None, None, None, None), ("e2", "r1", "x", "r3", None, None, None, None)], EDGES)
    portable.write_export(portable.export(r, e), str(tmp_path / "out"))
    back, links = portable.read_export(spark, str(tmp_path / "out"))
    assert sorted(x["id"] for x in back.collect()) == ["r1", "r2"] and [(x["src"], x["dst"]) for x in links.collect()] == [("r1", "r2")]
    new = records(spark, ("n1", "notes", '{"a":1}'), ("n2", "notes", '{"c":3}'))
    new_links = spark.createDataFrame([("f1", "n1", "y", "n2", None, None, None, None), ("f2", "n1", "y", "gone", None, None, None, None)], EDGES)
    all_, es = portable.import_(r, e, new, new_links)
    assert sorted(x["id"] for x in all_.collect()) == ["n2", "r1", "r2", "r3", "r4"]
    assert {(x["src"], x["dst"]) for x in es.collect()} == {("r1", "r2"), ("r1", "r3"), ("r1", "n2")}
    branch = records(spark, ("r1", "notes", '{"a":9}'), ("r5", "notes", "{}"))
    assert {x["id"]: x["data"] for x in portable.merge_branch(r, branch).collect()}["r1"] == '{"a":9}'
    assert {x["id"]: x["data"] for x in portable.merge_branch(r, branch, "main_wins").collect()}["r1"] == '{"a":1}'
    assert portable.merge_branch(r, branch, "keep_both").count() == 6
    left, es, _ = portable.delete_cascade(r, e, spark.createDataFrame([("r1", [1.0])], "id string, vector array<float>"), spark.createDataFrame([("r3",)], "id string"))
    assert left.count() == 3 and es.count() == 1


def test_sections_symbols_manifests(spark):
    md = "intro\n# A\ntext\n```\n# no\n```\n## B ##\nmore\n# C\n"
    assert [(s["path"], s["line_start"]) for s in files.markdown_sections(md)] == [("A", 2), ("A > B", 7), ("C", 9)]
    assert [s["heading"] for s in files.toml_sections("x = 1\n[a]\n[a.b]\ny=2\n[[c]]\n[[c]]\n")] == ["(root)", "a", "c", "c"]
    assert [s["heading"] for s in files.yaml_sections("a: 1\nb:\n  c: 2\n# no: x\n")] == ["a", "b"]
    assert [s["heading"] for s in files.json_sections('{"k": [1], "l": 2}')] == ["k", "l"]
    src = spark.createDataFrame([("m.py", "python", "import os\n\n# says hi\ndef hi(x):\n    pass\n\nclass A:\n    def go(self): ...\n"), ("lib.rs", "rust", "use a::b;\n/// Adds.\npub fn add(x: i32) -> i32 {\n}\n")], "path string, language string, text string")
    got = {(r["path"], r["kind"], r["name"], r["doc"]) for r in files.code_symbols(src).collect()}
    assert {("m.py", "function", "hi", "says hi"), ("m.py", "class", "A", None), ("m.py", "method", "go", None), ("m.py", "import", "os", None), ("lib.rs", "function", "add", "Adds."), ("lib.rs", "import", "a::b", None)} <= got
    assert {(d["name"], d["dev"]) for d in files.dependencies("x/Cargo.toml", '[dependencies]\na = "1"\nb = { version = "2" }\n[dev-dependencies]\nc = "3"')} == {("a", False), ("b", False), ("c", True)}
    assert [d["name"] for d in files.dependencies("requirements.txt", "x==1\n# no\ny[z]>=2")] == ["x", "y"]
    assert files.dependencies("package.json", "{broken") == []
    assert [d["requirement"] for d in files.dependencies("go.mod", "require (\n\tgithub.com/a/b v1.2.3\n)")] == ["v1.2.3"]


def _message(*parts) -> bytes:
    out = b""
    for n, v in parts:
        if isinstance(v, int):
            out += bytes([n << 3, v])
        else:
            v = v.encode() if isinstance(v, str) else bytes(v)
            out += bytes([n << 3 | 2, len(v)]) + v
    return out


def test_code_index():
    occ = lambda symbol, rng, roles=0, around=None: _message((1, rng), (2, symbol), (3, roles), *([(7, around)] if around else []))
    a = _message((1, "a.py"), (2, occ("f", [0, 4, 5], 1, [0, 0, 9, 0])), (2, occ("g", [2, 4, 5])), (2, occ("g", [1, 0, 3], 2)), (3, _message((1, "f"), (4, _message((1, "base"), (3, 1))))))
    b = _message((1, "b.py"), (2, occ("g", [0, 4, 5], 1)))
    got = {(e["src"], e["edge_type"], e["dst"], e["confidence"]) for e in scip.index_edges(_message((2, a), (2, b)))}
    assert got == {("f", "defined_in", "a.py", "direct"), ("g", "defined_in", "b.py", "direct"), ("f", "implements", "base", "direct"), ("f", "calls", "g", "heuristic"), ("a.py", "imports", "b.py", "heuristic")}
    with pytest.raises(ValueError, match="cut short"):
        list(scip.fields(b"\x12\x05ab"))


def test_streams(spark, tmp_path):
    from quern.streaming import changes

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, i % 2, t0 + dt.timedelta(minutes=4 * i)) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, k int, ts timestamp_ntz")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = changes.read_stream(spark, str(tmp_path / "in"), df.schema)
    got = changes.run_available(changes.activations(stream, "k", "ts"), "act", "update")
    assert {r["k"] for r in got.collect()} == {0, 1} and all(0.4 < r["activation"] <= 0.5 for r in got.collect())
    kept = sorted(r["id"] for r in changes.repeats_dropped(df, ["k"], "ts", "id", 600).collect())
    assert kept == [0, 1, 4, 5, 8, 9]
    visits = changes.session_windows(df, "k", "ts", "10 minutes")
    assert visits.count() == 2


def test_ask(spark):
    from quern.plans.ask import ask, plan
    from quern.plans.builder import Database
    from quern.sources.tables import Catalog

    t = dt.datetime(2024, 1, 31)
    docs = spark.createDataFrame([("d1", "we decided to use the new cache", t), ("d2", "the cache is slow", t - dt.timedelta(days=20))], "id string, body string, created_at timestamp_ntz")
    edges = spark.createDataFrame([("d1", "about", "d2")], "src string, edge_type string, dst string")
    db = Database(Catalog({"docs": docs}), edges, now=dt.datetime(2024, 2, 1, tzinfo=dt.UTC))
    assert plan(db, "why did we choose the cache").ways == ("text",)
    assert [r["id"] for r in ask(db, "what changed since yesterday in the cache").collect()][0] == "d1"
    assert {r["id"] for r in ask(db, "what depends on slow").collect()} == {"d1", "d2"}


def test_markdown_sections_take_whole_pages(spark, tmp_path):
    from quern.plans import catalog

    html = "<p>one</p>\n" * 100 + "# Late heading\nlast"
    spark.createDataFrame([(1, "http://a.org/x", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["heading"]: r for r in catalog.queries()["markdown_sections"](spark, str(tmp_path)).collect()}
    assert set(got) == {"a.org", "/x", "Late heading"} and got["Late heading"]["line_start"] == got["/x"]["line_end"] + 1 == 107


def test_failure_clusters_are_those_of_one_after_the_other(spark):
    """Seeds by brute force in the order of time; chains of near fingerprints, repeats, and failures without letters."""
    import random

    from quern.functions.text import _simhash

    rng = random.Random(21)
    vocabulary = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(40)]
        for _ in range(8):
            texts.append(" ".join(base) + f" {rng.randrange(100)}!")
            base = [*base]
            base[rng.randrange(40)] = rng.choice(vocabulary)
    texts += ["404", "405 !!"]
    rng.shuffle(texts)
    rows = [(i, t, "try again" if i % 5 == 0 else None, dt.datetime(2024, 1, 1) + dt.timedelta(hours=(i * 7) % 50)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, error string, fix string, created_at timestamp_ntz")
    import re

    prints = {i: _simhash(re.sub(r"[^a-z]+", " ", t.lower()).strip()) % 2**64 for i, t, *_ in rows}
    seeds, want = [], {}
    for i, _, _, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        want[i] = next((s for s in seeds if (s ^ prints[i]).bit_count() <= 8), None)
        if want[i] is None:
            seeds.append(prints[i])
            want[i] = prints[i]
    got = {r["id"]: r["seed"] % 2**64 for r in memory.failure_clusters(df).collect()}
    assert got == want and 1 < len(seeds) < len(texts)
    top = memory.distilled_failures(df, "2024-02-01 00:00:00").collect()
    assert top and all(r["fix"] == "try again" and r["frequency"] >= 2 for r in top)


def test_budget_beside_one_by_one(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(20)), None if i % 50 == 7 else "x" * rng.choice([0, 1, 3, 4, 9, 40, 90])) for i in range(400)]
    used, want = 0, []
    for i, _, said in sorted(rows, key=lambda r: (-r[1], r[0])):
        n = None if said is None else -(-len(said) // 4)
        if n is not None and used + n <= 57:
            used += n
            want.append(i)
    df = spark.createDataFrame(rows, "id int, score double, text string")
    assert sorted(r["id"] for r in fusion.within_budget(df, "text", 57).collect()) == sorted(want)
    assert fusion.within_budget(df.limit(0), "text", 57).count() == 0


def test_repeats_beside_one_by_one(spark):
    from quern.streaming import changes

    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["a", "b", None]) if i % 3 else "hot", t0 + dt.timedelta(seconds=rng.randrange(20_000)) if i % 40 else None) for i in range(900)]
    want, last = {i for i, _, ts in rows if ts is None}, {}
    for i, k, ts in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        if k not in last or (ts - last[k]).total_seconds() >= 300:
            last[k] = ts
            want.add(i)
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz")
    assert {r["id"] for r in changes.repeats_dropped(df, ["k"], "ts", "id").collect()} == want
    assert changes.repeats_dropped(df.limit(0), ["k"], "ts", "id").count() == 0


def test_phrases_beside_one_by_one(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(6), None if i == 4 else " ".join(rng.choice("abcd") for _ in range(rng.randrange(8)))) for i in range(60)]
    seen: dict = {}
    for s, said in rows:
        ws = (said or "").split()
        for i in range(len(ws) - 2):
            seen.setdefault(" ".join(ws[i : i + 3]), set()).add(s)
    df = spark.createDataFrame(rows, "s int, t string")
    assert {(r["phrase"], r["sessions"]) for r in memory.phrases(df, "s", "t").collect()} == {(p, len(x)) for p, x in seen.items() if len(x) > 1}


def test_cells(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(30, 16)).repeat(40, axis=0) + 0.3 * rng.normal(size=(1200, 16))
    rows = [(i, [float(x) for x in v] if i % 100 else None) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "id int, vector array<float>")
    asked = df.where("id % 20 = 1").select(F.col("id").alias("query"), "vector")
    centres = knn.fit_cells(df, "vector", 32, sample=500)
    index = knn.build_cells(df, "id", "vector", centres)
    assert index.count() == 1188 and index.where("cell IS NULL").count() == 0
    exact = knn.search_set(df, "id", "vector", asked, 10)
    assert knn.recall_of(knn.search_cells(index, "id", "vector", centres, asked, 10, 6, block=8), exact, "id").first()["recall"] >= 0.9
    assert knn.recall_of(knn.search_cells(index, "id", "vector", centres, asked, 10, len(centres)), exact, "id").first()["recall"] == 1
    assert knn.search_cells(index, "id", "vector", knn.fit_cells(df.limit(0), "vector"), asked, 10).count() == 0


def test_beliefs_beside_all_pairs(spark):
    rng = random.Random(11)
    some = lambda: " ".join(rng.choice(["orders", "often", "later", "never", "ports", "a", "of", "ship", "rates", "trade"]) for _ in range(rng.randrange(1, 8)))
    obs, bel = [(i, some()) for i in range(40)], [(i, some(), 0.5) for i in range(30)]
    want = set()
    for i, x in obs:
        for j, y, _ in bel:
            a, b = set(x.split()), set(y.split())
            if any(len(w) >= 5 for w in a & b) and len(a & b) / len(a | b) >= 0.3:
                want.add((i, j))
    got = memory.revise_beliefs(spark.createDataFrame(obs, "id int, text string"), spark.createDataFrame(bel, "id int, statement string, confidence double"))
    assert sorted((r["observation"], r["belief"]) for r in got.collect()) == sorted(want)


def test_recall_by_label_beside_sql(spark, tmp_path):
    """Relevant rows are counted by label, also where a label is missing or a query's own; they were pairs of all queries and rows of a label."""
    from quern.plans import catalog
    from tests.oracle import difference

    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v], None if i in (20, 33, 60) else i % 2 if i != 80 else 7) for i, v in enumerate(rng.normal(size=(150, 64)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    assert not difference(catalog.queries()["eval_recall_at_k"](spark, str(tmp_path)), str(tmp_path), catalog.oracle_sql()["eval_recall_at_k"])


def test_search_sets_beside_all_pairs(spark):
    """Blocks, slices and cells of every number give the exact best, with ties of equal vectors by key, and missing vectors left out."""
    rng = np.random.default_rng(8)
    m = np.concatenate([rng.normal(size=(150, 8)), np.tile(rng.normal(size=(30, 8)), (90, 1))])
    m = m[rng.permutation(len(m))]
    df = spark.createDataFrame([(i, [float(x) for x in v] if i % 50 != 9 else None) for i, v in enumerate(m)], "id int, vector array<float>")
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    there = np.array([i for i in range(len(m)) if i % 50 != 9])
    want = set()
    for q in there[::7].tolist():
        s = np.round((u[there] * u[q]).sum(1), 12)
        want |= {(q, int(there[j]), r) for r, j in enumerate(np.lexsort((there, -s))[:5])}
    asked = df.where(F.col("id").isin(there[::7].tolist()) | (F.col("id") == 9)).select(F.col("id").alias("query"), "vector")
    centres = knn.fit_cells(df, "vector", 6)
    index = knn.build_cells(df, "id", "vector", centres)
    for block in (16, 16_384):
        assert {(r["query"], r["id"], r["rank"]) for r in knn.search_set(df, "id", "vector", asked, 5, block).collect()} == want
        assert {(r["query"], r["id"], r["rank"]) for r in knn.search_cells(index, "id", "vector", centres, asked, 5, 6, block).collect()} == want


def test_search_moves_in_proportion(spark, monkeypatch):
    """What a search of cells moves goes by queries, rows and their work; each query went to as many slices of each of its cells as there are partitions."""

    def counted(*_):
        def run(batches):
            import pyarrow as pa

            n = sum(b.num_rows for b in batches)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([float(n)])], ["query", "id", "score"])

        return run

    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(4000, 4)))], "id long, vector array<float>")
    centres = knn.fit_cells(df, "vector", 8)
    index = knn.build_cells(df, "id", "vector", centres)
    asked = df.where("id % 20 = 0").select(F.col("id").alias("query"), "vector")
    monkeypatch.setattr(knn, "_block_best", counted)
    monkeypatch.setattr(spark.conf, "get", lambda k, *d, f=spark.conf.get: "64" if k == "spark.sql.shuffle.partitions" else f(k, *d), raising=False)
    moved = knn.search_cells(index, "id", "vector", centres, asked, 64, 4).agg(F.sum("score")).first()[0]
    assert 4000 + 200 * 4 <= moved <= 2 * (4000 + 200 * 4)


def test_failure_clusters_of_many_prints(spark, monkeypatch):
    """In batches of any size as one after the other, and no table of pairs is written, where hundreds of fingerprints are within reach of each other."""
    from quern.functions import text as texts

    rng = random.Random(12)
    prints = [[0, 0x0F0F, -1, 1 << 40][i % 4] ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for i in range(400)]
    prints = [p - 2**64 if p >= 2**63 else p for p in (p % 2**64 for p in prints)]
    monkeypatch.setattr(texts, "simhash", lambda c: F.get(F.array(*map(F.lit, prints)), F.length(c) - 1))
    rows = [(i, "x" * (i + 1), dt.datetime(2024, 1, 1) + dt.timedelta(hours=(i * 7) % 90) if i % 90 else None) for i in range(400)]
    seeds, want = [], {}
    for i, _, _ in sorted(rows, key=lambda r: (r[2] is not None, r[2] or dt.datetime.min, r[0])):
        want[i] = next((s for s in seeds if ((s ^ prints[i]) % 2**64).bit_count() <= 8), None)
        if want[i] is None:
            seeds.append(prints[i])
            want[i] = prints[i]
    df = spark.createDataFrame(rows, "id long, error string, created_at timestamp_ntz")
    written = []
    monkeypatch.setattr(memory, "settled", lambda d, name="step", f=memory.settled: written.append(f(d, name)) or written[-1])
    assert {r["id"]: r["seed"] for r in memory.failure_clusters(df).collect()} == want
    assert 1 < len(seeds) < 200 and max(w.count() for w in written) <= 400
    assert {r["id"]: r["seed"] for r in memory.failure_clusters(df, 8, 5).collect()} == want
    assert memory.failure_clusters(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_auto_links_beside_all_pairs(spark, kind):
    """Equal vectors, missing tables, times and vectors; no pair is kept that is not among a record's best, however many are over the threshold."""
    rng = np.random.default_rng(13)
    m = np.concatenate([rng.normal(size=(60, 6)), np.tile(rng.normal(size=(4, 6)), (40, 1))])
    m = m[rng.permutation(len(m))].astype(np.float32)
    name = (lambda i: i) if kind == "long" else (lambda i: f"r{i:04d}")
    t0 = dt.datetime(2024, 1, 1)
    recs = [(name(i), None if i % 17 == 3 else "xy"[i % 2], None if i % 19 == 5 else t0 + dt.timedelta(minutes=int(rng.integers(0, 200)))) for i in range(len(m))]
    vecs_ = [(name(i), [float(x) for x in v] if i % 23 != 7 else None) for i, v in enumerate(m)]
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    want = set()
    for i, (a, at, x) in enumerate(recs):
        found = []
        for j, (b, bt, y) in enumerate(recs):
            far = (at is not None and bt is not None and at != bt) or (x is not None and y is not None and abs(x - y) > dt.timedelta(hours=1))
            if i < j and far and i % 23 != 7 and j % 23 != 7 and (s := round(float((u[i] * u[j]).sum()), 12)) >= 0.4:
                found.append((-s, b))
        want |= {(a, b, -s) for s, b in sorted(found)[:7]}
    got = memory.auto_links(spark.createDataFrame(recs, f"id {kind}, tab string, at timestamp_ntz"), spark.createDataFrame(vecs_, f"id {kind}, vector array<float>"), "tab", "at", 0.4, 7)
    assert "SortMergeJoin" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin" not in plan  # pairs meet no table again
    assert {(r["a"], r["b"], round(r["score"], 12)) for r in got.collect()} == want
