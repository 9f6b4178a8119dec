"""Queries of what is done to records over their life, and of writes, links and texts that no other catalog has."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities, scoring, text
from ..operators import diagnostics, graph, lifecycle, memory, portable
from .catalog_graph import _E, edges
from .catalog_memory import _like_any
from .catalog_text import split
from .catalog_vectors import _COS, _Q, first, rows, rounded
from .registered import NOW, query


@query("select_fields", "SELECT o_orderkey AS id, o_totalprice, o_orderstatus FROM orders")
def _(t):
    return lifecycle.select_fields(t.orders.withColumnRenamed("o_orderkey", "id"), ["o_totalprice", "unknown", "o_orderstatus", "id"])


@query(
    "insert_batch",
    f"""WITH d AS (SELECT doc_id, text, lower(text) AS low, len({split('text')}) AS n FROM documents)
    SELECT doc_id AS id, round(CASE WHEN doc_id % 3 = 0 THEN NULL WHEN coalesce(text, '') = '' THEN 0.5 ELSE greatest(0.05, least(1.0, 0.5 + CASE WHEN {_like_any('low', scoring.HIGH_VALUE)} THEN 0.15 ELSE 0 END - CASE WHEN {_like_any('low', scoring.LOW_VALUE)} THEN 0.15 ELSE 0 END
    + CASE WHEN n >= 20 THEN 0.1 WHEN n >= 10 THEN 0.05 ELSE 0 END + 0.05)) END, 6)::DOUBLE AS importance, doc_id % 3 <> 0 AS stamped FROM d""",
)
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    got = lifecycle.insert_batch(docs.where("id % 3 = 0"), docs.where("id % 3 <> 0"), NOW, "text")
    return got.select("id", F.round("_importance", 6).alias("importance"), F.col("created_at").isNotNull().alias("stamped"))


@query("insert_raw", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    docs = t.documents.select("doc_id", "source")
    return lifecycle.insert_raw(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_RULES = (("in_nation", "in_region", "ships_from_region", 0.8), ("placed_by", None, "customer_of", 0.6))
_INFERRED = f"{_E}, i AS (SELECT DISTINCT a.src, 'ships_from_region' AS derived, b.dst, 0.8::DOUBLE AS confidence FROM e a JOIN e b ON a.dst = b.src AND b.edge_type = 'in_region' WHERE a.edge_type = 'in_nation' UNION SELECT src, 'customer_of', dst, 0.6::DOUBLE FROM e WHERE edge_type = 'placed_by')"


@query("inference_store", f"WITH {_INFERRED} SELECT src, derived, dst, confidence, 'pending' AS status FROM i WHERE src NOT LIKE 'customer:%' AND dst <> 'customer:1'")
def _(t):
    """The customers' inferences are edges already; those that lead to one customer were rejected before."""
    found = graph.infer(edges(t), _RULES)
    stored = found.where(F.startswith("src", F.lit("customer:"))).select("src", F.col("derived").alias("edge_type"), "dst")
    refused = found.where("dst = 'customer:1'").select("src", "derived", "dst")
    return lifecycle.pending_inferences(found, edges(t).select("src", "edge_type", "dst").unionByName(stored), refused)


@query("inference_decide", f"WITH {_INFERRED} SELECT CASE WHEN confidence > 0.7 THEN 'edge' ELSE 'rejected' END AS became, derived, count(*) AS n FROM i GROUP BY 1, 2")
def _(t):
    made, refused = lifecycle.decide(lifecycle.pending_inferences(graph.infer(edges(t), _RULES), edges(t)), F.col("confidence") > 0.7)
    both = made.select(F.lit("edge").alias("became"), F.col("edge_type").alias("derived")).unionByName(refused.select(F.lit("rejected").alias("became"), "derived"))
    return both.groupBy("became", "derived").agg(F.count(F.lit(1)).alias("n"))


@query(
    "mark_relevant",
    f"""WITH m AS (SELECT vec_id, label FROM embeddings WHERE vec_id BETWEEN 50 AND 149), p AS (SELECT m.vec_id AS mark, min(e.vec_id) AS entry FROM embeddings e JOIN m ON e.label = m.label JOIN embeddings x ON x.vec_id = m.vec_id WHERE e.vec_id < 100 AND list_cosine_similarity(e.embedding::DOUBLE[], x.embedding::DOUBLE[]) > 0.95 GROUP BY 1)
    SELECT vec_id AS entry_id, label AS record, CAST(1 + (SELECT count(*) FROM p WHERE entry = vec_id) AS BIGINT) AS count, CASE WHEN vec_id IN (SELECT entry FROM p) THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2024-01-01' END AS last_used FROM embeddings WHERE vec_id < 100
    UNION ALL SELECT 1000000 + vec_id, label, 1, TIMESTAMP '{NOW}' FROM m WHERE vec_id NOT IN (SELECT mark FROM p)""",
)
def _(t):
    own = t.embeddings.select("vec_id", F.col("label").alias("record"), "embedding")
    known = own.where("vec_id < 100").select(F.col("vec_id").alias("entry_id"), "record", "embedding", F.lit(1).cast("long").alias("count"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("last_used"))
    marks = own.where("vec_id BETWEEN 50 AND 149").select((F.col("vec_id") + 1_000_000).alias("mark_id"), "record", "embedding")
    return lifecycle.mark_relevant(known, marks, NOW).drop("embedding")


@query("how", f"WITH {_Q}, s AS (SELECT vec_id, label, {_COS} AS c FROM embeddings CROSS JOIN q ORDER BY c DESC, vec_id LIMIT 15) SELECT vec_id AS id, round(c * CASE WHEN label = 3 THEN 0.5 ELSE (label + 1) / 10.0 END, 6) AS score FROM s WHERE vec_id % 7 <> 0 ORDER BY c * CASE WHEN label = 3 THEN 0.5 ELSE (label + 1) / 10.0 END DESC, vec_id LIMIT 5")
def _(t):
    confidence = F.when(F.col("label") != 3, (F.col("label") + 1) / 10.0)
    return rounded(lifecycle.how(rows(t), first(t), 5, F.col("id") % 7 != 0, confidence))


@query("similar_episodes", f"WITH {_Q} SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings CROSS JOIN q WHERE label <> 4 AND vec_id % 5 <> 0 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def _(t):
    return rounded(lifecycle.similar_episodes(rows(t), first(t), 10, (F.col("label") == 4) | (F.col("id") % 5 == 0)))


@query("named_space", f"WITH {_Q} SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings CROSS JOIN q WHERE label = 2 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def _(t):
    from ..operators import knn

    return rounded(knn.search(lifecycle.in_space(rows(t).withColumnRenamed("label", "space"), 2, 64), "id", "vector", [first(t)], 10).select("id", "score"))


@query(
    "duplicates_of_latest",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r FROM embeddings), k AS (SELECT * FROM r WHERE r <= 50 AND vec_id % 40 >= 20)
    SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM k a JOIN k b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3""",
)
def _(t):
    df = rows(t).withColumns({"at": F.col("id"), "said": F.repeat(F.lit("x"), (F.col("id") % 40).cast("int"))})
    return lifecycle.duplicates_of_latest(df, "label", "at", "said", 0.3).withColumn("score", F.round("score", 6))


@query(
    "read_consent",
    "SELECT c_custkey FROM customer WHERE (c_nationkey = 3 AND c_mktsegment = 'BUILDING') OR c_custkey % 6 = 4 OR (c_custkey % 6 = 1 AND c_nationkey = 3) OR (c_custkey % 6 = 2 AND c_custkey % 5 < 2) OR (c_custkey % 6 = 3 AND c_custkey % 4 = 1)",
)
def _(t):
    kind = F.element_at(F.array(*map(F.lit, ("private", "workspace", "members", "roles", "public", "other"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    asked = F.when(F.col("c_custkey") % 5 < 2, F.array(F.lit("AUTOMOBILE"), F.lit("BUILDING"))).otherwise(F.array(F.lit("AUTOMOBILE")))
    roles = F.when(F.col("c_custkey") % 4 == 1, F.array(F.lit("auditor"))).otherwise(F.array(F.lit("owner")))
    df = t.customer.select("c_custkey", F.col("c_nationkey").alias("workspace"), F.col("c_mktsegment").alias("member"), kind.alias("consent"), asked.alias("members"), roles.alias("roles"))
    return lifecycle.readable(df, 3, "BUILDING", ("auditor", "reader")).select("c_custkey")


@query("stale_beliefs", "SELECT event_id FROM events WHERE epoch_us(TIMESTAMP '2024-03-15') - epoch_us(ts) > 60 * 86400000000")
def _(t):
    return lifecycle.stale_beliefs(t.events, "ts", "2024-03-15 00:00:00").select("event_id")


@query("checkpoint_latest", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'view') WHERE r = 1")
def _(t):
    return lifecycle.checkpoint_to_resume(t.events.where("event_type = 'view'"), "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@query("rules_in_force", "SELECT rule, value FROM (SELECT event_type || '/' || user_id % 3 AS rule, CASE WHEN event_id % 4 <> 0 THEN props END AS value, row_number() OVER (PARTITION BY event_type || '/' || user_id % 3 ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND value IS NOT NULL")
def _(t):
    log = t.events.select(F.concat_ws("/", "event_type", F.col("user_id") % 3).alias("rule"), F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("value"), "ts", "event_id")
    return lifecycle.rules_in_force(log, "rule", "value", "ts", "event_id")


@query("retention", f"SELECT event_type, count(*) AS n FROM events WHERE user_id % 10 = 0 OR event_type NOT IN ('click', 'view') OR (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0 <= CASE event_type WHEN 'click' THEN 7 ELSE 14 END GROUP BY 1")
def _(t):
    return lifecycle.retained(t.events, "event_type", "ts", NOW, {"click": 7, "view": 14}, F.col("user_id") % 10 == 0).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("string_array", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE len(string_split(p_name, ' ')) END AS INT) AS n, CASE WHEN p_partkey % 3 <> 0 THEN string_split(p_name, ' ')[1] END AS first FROM part")
def _(t):
    """A number among the strings is left out; a field that is no array has none."""
    data = F.when(F.col("p_partkey") % 3 == 0, '{"tags": 5}').otherwise(F.concat(F.lit('{"tags": [7, "'), F.replace("p_name", F.lit(" "), F.lit('", "')), F.lit('"]}')))
    got = t.part.select("p_partkey", lifecycle.string_array(data, "tags").alias("tags"))
    return got.select("p_partkey", F.size("tags").alias("n"), F.get("tags", F.lit(0)).alias("first"))


@query("legacy_text", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE p_brand || ' ' || p_name END AS said FROM part")
def _(t):
    as_json = lambda **kv: F.to_json(F.struct(*(F.col(v).alias(k) for k, v in kv.items())))
    k = F.col("p_partkey") % 3
    data = F.when(k == 0, as_json(summary="p_brand", error="p_name")).when(k == 1, as_json(summary="p_size", fact="p_type")).otherwise(as_json(a="p_brand", b="p_size", c="p_name"))
    return t.part.select("p_partkey", lifecycle.legacy_text(data).alias("said"))


@query("truncate_text", "SELECT doc_id, CASE WHEN strlen(text) <= 40 THEN text ELSE list_reduce(list_transform(range(1, 42), lambda i: CASE WHEN strlen(substring(text, 1, i - 1)) <= 40 THEN substring(text, 1, i - 1) ELSE '' END), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) END AS cut FROM documents")
def _(t):
    return t.documents.select("doc_id", lifecycle.truncated(F.col("text"), 40).alias("cut"))


@query(
    "reflection",
    """WITH a AS (SELECT CAST(l_partkey AS VARCHAR) AS name, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT CAST(o_custkey AS VARCHAR) AS name, count(*) AS n FROM orders GROUP BY 1)
    SELECT 'entities' AS section, * FROM (SELECT * FROM a ORDER BY n DESC, name LIMIT 3) UNION ALL SELECT 'outcomes', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'connected', * FROM (SELECT * FROM c ORDER BY n DESC, name LIMIT 2)""",
)
def _(t):
    return lifecycle.reflection(t.lineitem.select(F.col("l_partkey").alias("name")), t.events.select(F.col("event_type").alias("name")), t.orders.select(F.col("o_custkey").alias("name")))


@query("bridges", "SELECT 'nations' AS workspace, n_nationkey AS id, 'regions' AS other_workspace, n_regionkey AS other_id FROM nation UNION ALL SELECT 'regions', n_regionkey, 'nations', n_nationkey FROM nation WHERE n_regionkey < 2")
def _(t):
    pairs = t.nation.select(F.lit("nations").alias("a_workspace"), F.col("n_nationkey").alias("a_id"), F.lit("regions").alias("b_workspace"), F.col("n_regionkey").alias("b_id"))
    own = t.nation.select(F.lit("nations").alias("workspace"), F.col("n_nationkey").alias("id")).unionByName(t.region.where("r_regionkey < 2").select(F.lit("regions").alias("workspace"), F.col("r_regionkey").alias("id")))
    return lifecycle.equivalents(own, pairs)


@query("maintenance_due", f"SELECT user_id AS task FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(last) >= (user_id % 4 + 1) * 86400 * 1000000")
def _(t):
    tasks = t.events.groupBy(F.col("user_id").alias("task")).agg(F.max("ts").alias("last_run")).withColumn("every_seconds", (F.col("task") % 4 + 1) * 86_400)
    return lifecycle.due(tasks, NOW).select("task")


@query("cache_invalidate", "SELECT o_custkey AS query FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') = 0")
def _(t):
    cache = t.orders.groupBy(F.col("o_custkey").alias("query")).agg(F.collect_list("o_orderkey").alias("records"))  # an answer's own records
    changed = t.orders.where("o_orderdate >= timestamp_ntz'1998-01-01'").select(F.col("o_orderkey").alias("record"))
    return lifecycle.cache_after(cache, changed).select("query")


@query("unrelate", f"WITH {_E} SELECT edge_type, count(*) AS n FROM e WHERE NOT (edge_type = 'in_nation' AND dst = 'nation:3') GROUP BY 1")
def _(t):
    left = portable.unrelate(edges(t), edges(t).where("edge_type = 'in_nation' AND dst = 'nation:3'"))
    return left.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("relate", f"WITH {_E} SELECT edge_type, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT 'visited', count(*) FROM nation")
def _(t):
    none = F.lit(None).cast("timestamp_ntz")
    new = t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("src"), F.lit("visited").alias("edge_type"), F.lit("region:0").alias("dst"), none.alias("valid_from"), none.alias("valid_until"))
    return portable.relate(edges(t), new).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("delete_cascade", f"WITH {_E} SELECT 'edges' AS what, count(*) AS n FROM e WHERE src <> 'nation:3' AND dst <> 'nation:3' UNION ALL SELECT 'records', count(*) - 1 FROM nation UNION ALL SELECT 'vectors', count(*) FROM nation WHERE n_nationkey > 4")
def _(t):
    ids = t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), "n_nationkey")
    got = portable.delete_cascade(ids, edges(t), ids.where("n_nationkey > 2 AND n_nationkey <> 4"), ids.where("n_nationkey = 3"))
    n = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return n(got[0], "records").unionByName(n(got[1], "edges")).unionByName(n(got[2], "vectors"))


@query(
    "auto_links",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.3 AND (a.label <> b.label OR b.vec_id - a.vec_id > 60))
    SELECT a, b, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM p) WHERE r <= 20""",
)
def _(t):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))
    own = rows(t)
    return memory.auto_links(own.select("id", "label", at.alias("at")), own.select("id", "vector"), "label", "at", 0.3).withColumn("score", F.round("score", 6))


@query("normalized_text", r"SELECT doc_id, lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'))) AS said FROM documents WHERE text IS NOT NULL")
def _(t):
    return t.documents.where("text IS NOT NULL").select("doc_id", text.normalized(F.col("text")).alias("said"))


@query("searchable_text", "SELECT page_id, coalesce(nullif(html, ''), url) AS said FROM pages")
def _(t):
    rows_ = t.pages.select("page_id", F.col("html").alias("content"), F.col("url").alias("message"))
    return rows_.select("page_id", text.searchable(["content", "message"]).alias("said"))


@query("redact_field", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '[REDACTED]' ELSE c_name END AS name FROM customer")
def _(t):
    return t.customer.select("c_custkey", entities.redacted(F.col("c_name"), F.col("c_custkey") % 3 == 0).alias("name"))


@query("live_ratio", "SELECT round(avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END), 9) AS live_ratio FROM events")
def _(t):
    return diagnostics.live_ratio(t.events, F.col("event_type") == "error").withColumn("live_ratio", F.round("live_ratio", 9))


@query("ab_compare", "SELECT event_type AS variant, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def _(t):
    return diagnostics.ab(t.events.where("event_type IN ('click', 'view')"), "event_type", "value").withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@query("context_savings", "SELECT source AS \"group\", CAST(sum(n_chars) AS BIGINT) AS before, CAST(sum(n_chars // 4) AS BIGINT) AS after, round(CASE WHEN sum(n_chars) > 0 THEN 1 - sum(n_chars // 4) / sum(n_chars) END, 6) AS saved FROM documents GROUP BY 1")
def _(t):
    runs = t.documents.select(F.col("source").alias("group"), F.col("n_chars").alias("before"), F.expr("n_chars div 4").alias("after"))
    return diagnostics.savings(runs).withColumn("saved", F.round("saved", 6))
