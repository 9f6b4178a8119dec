"""The query language: lexing, parsing, errors and what queries return over small tables."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.model import QueryError, checked_id
from quern.operators.predicates import Condition
from quern.operators.relational import Metric, metric
from quern.plans.builder import Database
from quern.plans.compiler import run
from quern.plans.lexer import tokenize
from quern.plans.parser import Step, completions, parse, parse_path, where
from quern.sources.tables import Catalog


def test_tokens():
    kinds = [(t.kind, t.value) for t in tokenize("find 'a\\'b' -- note\n in-edge <-> x >= -1.5 3")]
    assert kinds == [("keyword", "FIND"), ("string", "a'b"), ("word", "in-edge"), ("arrow", "<->"), ("word", "x"), ("op", ">="), ("number", -1.5), ("number", 3), ("end", None)]


def test_parse_recall():
    q = parse('RECALL "slow login" TOP 5 WHERE kind = bug AND n >= 3 ->fixed_by ORDER BY n DESC LIMIT 7 OFFSET 2 BOOST recency 0.5 FROM notes PROFILE')
    c = q.clauses
    assert (q.verb, q.text, q.top, c.table, c.limit, c.offset, c.order_by, c.ascending, c.profile) == ("RECALL", "slow login", 5, "notes", 7, 2, "n", False, True)
    assert c.where == (Condition("kind", "=", "bug"), Condition("n", ">=", 3))
    assert c.path == (Step("out", "fixed_by"),) and c.boosts == (("recency", 0.5),)


def test_parse_others():
    assert parse("AGG count, AVG(x.y) FROM t GROUP BY k").metrics == (Metric("count"), Metric("avg", "x.y"))
    assert parse("GET 01ARZ3NDEKTSV4RRFFQ69G5FAV").source == "01ARZ3NDEKTSV4RRFFQ69G5FAV"
    assert parse("COUNT WHERE a CONTAINS 'x'").clauses.where == (Condition("a", "CONTAINS", "x"),)
    assert parse("EXPLAIN FIND 'x' IN body").explained.in_field == "body"
    assert parse_path("->a<-b<->c") == (Step("out", "a"), Step("in", "b"), Step("both", "c"))
    assert where("a = null AND b = TRUE") == (Condition("a", "=", None), Condition("b", "=", True))
    assert metric(" Sum ( fee ) ") == Metric("sum", "fee")


@pytest.mark.parametrize("query", ["SELECT foo FROM bar", "RECALL TOP 5", "RECALL 'x' TOP 0", "TRAVERSE ->modified", "TRAVERSE FROM items", "@@@ nonsense", "GET a b", "FIND 'open", "AGG avg FROM t", "COUNT FROM t LIMIT 3", "RECALL 'x' TOP 3 LIMIT -1", "RECALL 'x' TOP 3 BOOST luck 1", ""])
def test_errors(query):
    with pytest.raises(QueryError):
        parse(query)


def test_hints():
    with pytest.raises(QueryError, match="did you mean RECALL"):
        parse("RECAL 'x' TOP 5")
    with pytest.raises(QueryError, match="only read"):
        parse("DELETE x")
    assert completions("RE") == ["RECALL"] and "GROUP BY" in completions("AGG count ") and completions("GET x") == []
    with pytest.raises(QueryError):
        checked_id("not-an-id")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="RECALL FIND'\"->=<() 0123456789abc", max_size=60))
def test_parser_never_breaks(text):
    try:
        parse(text)
    except QueryError:
        pass


@pytest.fixture(scope="module")
def db(spark):
    docs = spark.createDataFrame(
        [("d1", "item alpha", 10, "alpha", ["rust", "db"]), ("d2", "item bravo", 20, "bravo", ["python"]), ("d3", "item charlie", 30, "charlie", ["rust"]), ("d4", "Item delta", 40, None, None)],
        "id string, body string, n int, name string, tags array<string>",
    )
    nodes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9)], "id string, n int")
    edges = spark.createDataFrame([("a", "created", "b"), ("a", "created", "c"), ("b", "modified", "c"), ("c", "created", "a")], "src string, edge_type string, dst string")
    vectors = spark.createDataFrame([("d1", [1.0, 0.0]), ("d2", [0.8, 0.6]), ("d3", [0.0, 1.0])], "id string, vector array<float>")
    return Database(Catalog({"docs": docs, "nodes": nodes}), edges, vectors, embed=lambda text: [1.0, 0.0] if "first" in text else [0.0, 1.0], text_fields={"docs": ["body"], "nodes": []})


def ids(df) -> list[str]:
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("FIND 'ALPHA'", ["d1"]),
        ("FIND 'item' FROM docs", ["d1", "d2", "d3", "d4"]),
        ("FIND 'nothing' FROM docs", []),
        ("FIND 'item' FROM docs WHERE name = charlie", ["d3"]),
        ("FIND 'item' FROM docs WHERE name != alpha", ["d2", "d3", "d4"]),
        ("FIND 'item' FROM docs WHERE n > 15 AND n <= 30", ["d2", "d3"]),
        ("FIND 'item' FROM docs WHERE name > bravo", ["d3"]),
        ("FIND 'item' FROM docs WHERE tags CONTAINS 'rust'", ["d1", "d3"]),
        ("FIND 'item' FROM docs WHERE body CONTAINS 'lph'", ["d1"]),
        ("FIND 'item' FROM docs WHERE nowhere = 'x'", []),
        ("FIND 'item' FROM docs WHERE name > 5", ["d1", "d2", "d3"]),
        ("FIND 'item' IN body FROM docs ORDER BY n DESC LIMIT 2 OFFSET 1", ["d3", "d2"]),
        ("FIND 'item' IN body FROM docs ORDER BY n OFFSET 10", []),
        ("FIND 'item' FROM docs ORDER BY name LIMIT 2", ["d4", "d1"]),
        ("TRAVERSE ->created FROM a", ["b", "c"]),
        ("TRAVERSE ->created->modified FROM a", ["c"]),
        ("TRAVERSE <-created FROM b", ["a"]),
        ("TRAVERSE <->created FROM a", ["b", "c"]),
        ("TRAVERSE ->nothing FROM a", []),
        ("TRAVERSE ->created FROM a WHERE n > 5", ["c"]),
        ("TRAVERSE ->created FROM nodes", ["a", "b", "c"]),
        ("RECALL 'the first' TOP 2", ["d1", "d2"]),
        ("RECALL 'other' TOP 1 FROM docs WHERE n < 30", ["d2"]),
        ("GET d2", ["d2"]),
        ("GET nobody", []),
    ],
)
def test_queries(db, query, expected):
    got = ids(run(db, query))
    assert (got if "ORDER" in query or "RECALL" in query else sorted(got)) == expected


def test_counts(db):
    assert run(db, "COUNT").first()[0] == 7
    assert run(db, "COUNT FROM docs").first()[0] == 4
    assert run(db, "COUNT FROM ghost").first()[0] == 0
    assert run(db, "COUNT FROM docs WHERE n >= 20").first()[0] == 3


def test_default_limit_and_explain(db):
    q = db.query("docs").search_text("item").where("n", ">", 5)
    assert q.most == 100 and [s[0] for s in q.steps()] == ["scan", "filter", "text_search", "page"]
    assert "text_search" in run(db, "EXPLAIN FIND 'item' FROM docs").first()[0]
    rows, times = q.profile()
    assert len(rows) == 4 and times["bottleneck"] in ("build", "run")


def test_fused_search(db):
    got = ids(db.query("docs").search_text("bravo").similar_to([1.0, 0.0], 3).frame())
    assert got[0] == "d2" and set(got) == {"d1", "d2", "d3"}


def test_aggregate_rules(spark):
    from quern.operators.relational import aggregate

    rows = spark.createDataFrame([('{"family":"a","decay":1}',), ('{"family":"a","decay":"2"}',), ('{"decay":4}',), ('{"family":null,"decay":6}',), ('{"family":"z","decay":9,"_archived":true}',)], "data string")
    got = {r["group"]: r.asDict() for r in aggregate(rows, ["count", "avg(decay)", "sum(decay)", "min(decay)"], "family").collect()}
    assert got[None] == {"group": None, "count": 2, "avg_decay": 5.0, "sum_decay": 10.0, "min_decay": 4.0, "skipped": 0}
    assert got['"a"']["count"] == 2 and got['"a"']["avg_decay"] == 1.0 and got['"a"']["skipped"] == 1
    assert len(got) == 2 and aggregate(rows, ["count"], "family", include_archived=True).count() == 3
    assert aggregate(rows.where("false"), ["count"]).count() == 0


@pytest.mark.parametrize(
    ("op", "value", "expected"),
    [("=", 1, ["i"]), ("=", 1.0, ["f"]), ("!=", 1, ["b", "f", "l", "m", "n", "s"]), (">", 0, ["f", "i", "l", "s"]), ("<", "b", ["b", "f", "i", "n", "s"]), ("=", None, ["n"]), ("CONTAINS", "x", ["l"]), (">=", True, ["b", "f", "i", "l", "s"])],
)
def test_schemaless_comparisons(spark, op, value, expected):
    from quern.operators.predicates import matching

    rows = spark.createDataFrame([("i", '{"v":1}'), ("f", '{"v":1.0}'), ("s", '{"v":"a"}'), ("b", '{"v":true}'), ("n", '{"v":null}'), ("l", '{"v":["x"]}'), ("m", "{}")], "id string, data string")
    assert sorted(ids(matching(rows, [Condition("v", op, value)]))) == expected
