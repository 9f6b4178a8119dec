"""Queries of what becomes of records: scores, tiers, expiry, supersession, patterns, recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import diagnostics, fusion, knn, memory, portable, recall, search
from ..streaming.changes import activations_of
from .catalog_text import bm25_sql, split
from .registered import NOW, query

_DAYS = f"((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0)"


def _like_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query(
    "importance",
    f"""WITH d AS (SELECT doc_id, text, lower(text) AS low, len({split('text')}) AS n FROM documents)
    SELECT doc_id, round(CASE WHEN text = '' THEN 0.5 ELSE greatest(0.05, least(1.0, 0.5 + CASE WHEN {_like_any('low', scoring.HIGH_VALUE)} THEN 0.15 ELSE 0 END - CASE WHEN {_like_any('low', scoring.LOW_VALUE)} THEN 0.15 ELSE 0 END
    + CASE WHEN n >= 20 THEN 0.1 WHEN n >= 10 THEN 0.05 ELSE 0 END + 0.1)) END, 6)::DOUBLE AS importance FROM d""",
)
def _(t):
    got = scoring.importance(F.col("text"), F.lit(0), F.lit(5), F.lit(None).cast("string"))
    return t.documents.select("doc_id", F.round(got, 6).alias("importance"))


_EFFECTIVE = f"CASE WHEN event_type = 'signup' THEN 1.0 ELSE greatest(0, least(1, value / 100.0 * exp(-{_DAYS} * ln(2) / 90.0) * (1 + ln(event_id % 10 + 1.0) * 0.1))) END"


def effective(t):
    days = scoring.age_days("ts", NOW)
    value = scoring.effective_importance(F.col("value") / 100.0, days, F.col("event_id") % 10, F.col("event_type") == "signup")
    return t.events.select("event_id", "event_type", "ts", "user_id", value.alias("effective"), days.alias("days"))


@query("effective_importance", f"SELECT event_id, round({_EFFECTIVE}, 6) AS effective FROM events")
def _(t):
    return effective(t).select("event_id", F.round("effective", 6).alias("effective"))


_TIER = f"CASE WHEN event_type = 'signup' THEN 'hot' WHEN {_EFFECTIVE} < 0.1 THEN 'archived' WHEN {_DAYS} <= 7 AND event_id % 10 / 10.0 >= 0.5 THEN 'hot' WHEN {_DAYS} <= 30 AND event_id % 10 / 10.0 >= 0.1 THEN 'warm' ELSE 'cold' END"


@query("tier_distribution", f"SELECT {_TIER} AS tier, count(*) AS count FROM events GROUP BY 1")
def _(t):
    tier = scoring.tier(F.col("effective"), F.col("days"), F.col("event_id") % 10 / 10.0, F.col("event_type") == "signup")
    return effective(t).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("count"))


@query(
    "activation_hist",
    f"""WITH a AS (SELECT user_id, sum(0.1 * pow(0.5, {_DAYS} / 30.0)) AS a FROM events GROUP BY 1)
    SELECT CAST(CASE WHEN a >= 8 THEN 4 WHEN a >= 6 THEN 3 WHEN a >= 4 THEN 2 WHEN a >= 2 THEN 1 ELSE 0 END AS INT) AS bin, count(*) AS count FROM a GROUP BY 1""",
)
def _(t):
    return diagnostics.histogram(activations_of(t.events, "user_id", "ts", NOW), "activation", [0, 2, 4, 6, 8])


@query("confidence_score", f"WITH u AS (SELECT user_id, count(*) AS n, max(ts) AS ts, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1) SELECT user_id, round(0.3 * least(ln(n) + 1, 2) / 2 + 0.4 * exp(-{_DAYS} / 30.0) + 0.3 * (1 - CASE WHEN e = 0 THEN 0 WHEN e = 1 THEN 0.2 WHEN e = 2 THEN 0.4 ELSE 0.6 END), 6) AS confidence FROM u")
def _(t):
    u = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts"), F.count(F.when(F.col("event_type") == "error", 1)).alias("e"))
    return u.select("user_id", F.round(scoring.confidence(F.col("n"), scoring.age_days("ts", NOW), F.col("e")), 6).alias("confidence"))


@query("procedure_confidence", "SELECT event_id, round(CASE event_type WHEN 'purchase' THEN least(1, value / 200.0 + 0.1) WHEN 'error' THEN greatest(0, value / 200.0 - 0.2) WHEN 'view' THEN greatest(0, value / 200.0 - 0.1) ELSE value / 200.0 END, 6) AS confidence FROM events")
def _(t):
    outcome = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "partial").otherwise("none")
    return t.events.select("event_id", F.round(scoring.procedure_confidence(F.col("value") / 200.0, outcome), 6).alias("confidence"))


_UNTIL = "ts + (event_id % 20) * INTERVAL 1 DAY"


def _expiring(t):
    return t.events.select("event_id", "ts", (F.col("ts") + F.make_interval(days=(F.col("event_id") % 20).cast("int"))).alias("valid_until"), (F.col("event_type") == "error").alias("_superseded"))


@query("ttl_active", f"SELECT event_id FROM events WHERE {_UNTIL} >= TIMESTAMP '{NOW}' AND event_type <> 'error'")
def _(t):
    return memory.active(_expiring(t), NOW).select("event_id")


@query("dead_records", f"SELECT CASE WHEN {_UNTIL} < TIMESTAMP '{NOW}' THEN 'expired' ELSE 'superseded' END AS reason, count(*) AS count FROM events WHERE {_UNTIL} < TIMESTAMP '{NOW}' OR event_type = 'error' GROUP BY 1")
def _(t):
    return memory.dead(_expiring(t), NOW)


@query("stale_records", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 90 DAY AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) AND o_orderkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 25)")
def _(t):
    links = t.lineitem.where("l_quantity > 25").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return memory.stale(t.orders.select("o_orderkey", "o_orderdate"), links, "o_orderdate", "2000-01-01 00:00:00", 90, "o_orderkey").select("o_orderkey")


_TRUST = "CASE WHEN event_type = 'error' THEN 'doubted' WHEN event_id % 11 = 0 THEN 'observed' WHEN user_id % 3 = 0 THEN CASE WHEN value / 100.0 >= 0.7 THEN 'derived' ELSE 'suggested' END WHEN user_id % 3 = 1 THEN CASE WHEN value / 100.0 >= 0.8 THEN 'derived' ELSE 'suggested' END WHEN value / 100.0 < 0.5 THEN 'suggested' ELSE 'observed' END"


@query("trust_tier", f"SELECT event_id, {_TRUST} AS trust FROM events")
def _(t):
    source = F.when(F.col("user_id") % 3 == 0, "inference").when(F.col("user_id") % 3 == 1, "llm")
    got = scoring.trust_tier(F.col("event_type") == "error", F.lit(False), F.col("event_id") % 11 == 0, source, F.lit(False), F.col("value") / 100.0)
    return t.events.select("event_id", got.alias("trust"))


@query("supersede_pairs", "SELECT CASE WHEN a.vec_id % 100 > b.vec_id % 100 OR (a.vec_id % 100 = b.vec_id % 100 AND a.vec_id > b.vec_id) THEN b.vec_id ELSE a.vec_id END AS old, CASE WHEN a.vec_id % 100 > b.vec_id % 100 OR (a.vec_id % 100 = b.vec_id % 100 AND a.vec_id > b.vec_id) THEN a.vec_id ELSE b.vec_id END AS new, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.32")
def _(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") % 100).alias("at"))
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return memory.supersede_pairs(rows, vectors, "label", "at", 0.32).withColumn("score", F.round("score", 6))


@query("hot_spot", "SELECT o_custkey AS entity, count(*) AS count, round(least(count(*) / 10.0, 1.0), 6) AS confidence FROM orders GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 5")
def _(t):
    return memory.hot_spots(t.orders, "o_custkey").withColumn("confidence", F.round(F.col("confidence").cast("double"), 6))


@query("knowledge_gap", "SELECT l_partkey AS entity, count(*) AS mentions FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 5")
def _(t):
    return memory.gaps(t.lineitem.select(F.col("l_partkey").alias("entity")), t.part.where("p_size > 10").select(F.col("p_partkey").alias("entity")))


@query("alias_resolution", "WITH a AS (SELECT lower(p_name) AS alias, p_partkey AS entity, p_size % 5 AS s FROM part) SELECT alias, entity FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY s, entity) AS r FROM a) WHERE r = 1")
def _(t):
    scope = F.element_at(F.array(*map(F.lit, memory.SCOPES)), (F.col("p_size") % 5 + 1).cast("int"))
    return memory.narrowest_alias(t.part.select(F.col("p_name").alias("alias"), F.col("p_partkey").alias("entity"), scope.alias("scope")))


@query("entity_resolve", "SELECT name, round(score, 6) AS score, score >= 0.8 AS auto FROM (SELECT DISTINCT p_name AS name, CASE WHEN p_name = 'red ring' THEN 1.0 WHEN contains(p_name, 'ring') AND p_name = 'ring' THEN 0.7 + 0.15 * 4 / 8 ELSE len(list_intersect(string_split(p_name, ' '), ['red', 'ring'])) / CAST(len(list_distinct(list_concat(string_split(p_name, ' '), ['red', 'ring']))) AS DOUBLE) END AS score FROM part) WHERE score >= 0.5 ORDER BY score DESC, name LIMIT 5")
def _(t):
    return memory.resolve_names(t.part, "p_name", "red ring").withColumn("score", F.round("score", 6))


@query("beliefs_auto", "SELECT p_name AS statement, CAST(max(p_size / 50.0) AS DOUBLE) AS confidence FROM part WHERE p_size / 50.0 >= 0.8 AND p_name NOT IN (SELECT p_name FROM part WHERE p_partkey < 20) GROUP BY 1")
def _(t):
    records = t.part.select(F.col("p_name").alias("statement"), (F.col("p_size") / 50.0).alias("importance"))
    known = t.part.where("p_partkey < 20").select(F.upper("p_name").alias("statement"))
    return memory.auto_beliefs(records, known)


@query(
    "memory_recall",
    f"""SELECT event_id AS id, round(0.8 * value / 100.0 + 0.2 * greatest(0, 1 - {_DAYS} / 30.0), 6) AS score FROM events ORDER BY 0.8 * value / 100.0 + 0.2 * greatest(0, 1 - {_DAYS} / 30.0) DESC, event_id LIMIT 20""",
)
def _(t):
    rows = t.events.select(F.col("event_id").alias("id"), recall.memory_blend(F.col("value") / 100.0, scoring.age_days("ts", NOW), "semantic").alias("score"))
    return fusion.top(rows, 20).withColumn("score", F.round("score", 6))


_KINDS = {"click": "working", "view": "semantic", "error": "episodic", "purchase": "procedural", "signup": "preference"}


@query(
    "remember_cross",
    "WITH s AS (SELECT event_id AS id, CASE event_type " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in _KINDS.items()) + " END AS memory_type, CASE event_type "
    + " ".join(f"WHEN '{e}' THEN {recall.ALPHA[k]} * value / 100.0 + (1 - {recall.ALPHA[k]}) * greatest(0, 1 - {_DAYS} / 30.0)" for e, k in _KINDS.items())
    + " END AS score FROM events) SELECT id, memory_type, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 15",
)
def _(t):
    pools = {k: t.events.where(F.col("event_type") == e).select(F.col("event_id").alias("id"), (F.col("value") / 100.0).alias("similarity"), scoring.age_days("ts", NOW).alias("days"), F.col("props").alias("text")) for e, k in _KINDS.items()}
    return recall.remember(pools, 15).select("id", "memory_type", F.round("score", 6).alias("score"))


@query("cache_lookup", "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3), s AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings CROSS JOIN q WHERE vec_id % 2 = 1 AND label <> 9 AND vec_id % 5 <> 0) SELECT id, round(score, 6) AS score FROM s WHERE s.score >= 0.92 ORDER BY s.score DESC, id LIMIT 1")
def _(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 2 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("expires_at"), ((F.col("label") == 9) | (F.col("vec_id") % 5 == 0)).alias("stale"))
    return recall.cached_answer(rows, knn.vector_of(rows, "id", "vector", 3), NOW).withColumn("score", F.round("score", 6))


@query(
    "recall_fused",
    f"""WITH {bm25_sql('documents', 'doc_id', 'text', ['erti', 'hath'])}, a AS (SELECT doc_id AS id, score / (score + 1) AS t, row_number() OVER (ORDER BY score / (score + 1) DESC, doc_id) - 1 AS rank FROM s ORDER BY score / (score + 1) DESC, doc_id LIMIT 160),
    q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), k AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], v) AS v FROM embeddings CROSS JOIN q), b AS (SELECT id, v FROM k ORDER BY v DESC, id LIMIT 160),
    f AS (SELECT coalesce(a.id, b.id) AS id, coalesce(v, 0) AS v, coalesce(t, 0) AS t FROM a FULL JOIN b ON a.id = b.id), c AS (SELECT doc_id AS id, CASE WHEN length(text) <= 1600 THEN [lower(text)] ELSE list_transform(range(0, CAST(floor((length(text) - 401) / 1200) AS BIGINT) + 1), lambda i: lower(substr(text, i * 1200 + 1, 1600))) END AS cs, TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 30) * INTERVAL 1 DAY AS ts FROM documents),
    z AS (SELECT id, 0.40 * v + 0.15 * exp(-ln(2) * greatest(0, {_DAYS} * 24) / 168.0) + 0.10 * greatest(t, list_max(list_transform(cs, lambda c: (contains(c, 'erti')::INT + contains(c, 'hath')::INT) / 2.0))) AS score FROM f JOIN c USING (id))
    SELECT id, round(score, 6) AS score FROM z ORDER BY z.score DESC, id LIMIT 10""",
)
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "text", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(days=(F.col("doc_id") % 30).cast("int"))).alias("created_at"))
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    ask = recall.Recall("erti hath", NOW)
    return recall.recall(docs, vectors, ask, knn.vector_of(vectors, "id", "vector", 0)).select("id", F.round("score", 6).alias("score"))


@query("feedback_boost", "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT label AS id, round(least(1, sum(CASE WHEN list_cosine_similarity(embedding::DOUBLE[], v) > 0.8 THEN list_cosine_similarity(embedding::DOUBLE[], v) * exp(-10 / 30.0) * least(greatest(ln(vec_id + 20), 1) / 5, 1) ELSE 0 END)), 6) AS feedback FROM embeddings CROSS JOIN q GROUP BY 1")
def _(t):
    entries = t.embeddings.select(F.col("embedding").alias("query_embedding"), F.col("label").alias("record_id"), (F.col("vec_id") + 20).alias("count"), F.lit("2024-01-21 00:00:00").cast("timestamp_ntz").alias("last_used"))
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    got = recall.feedback_signal(entries, knn.vector_of(vectors, "id", "vector", 0), NOW)
    return got.withColumn("feedback", F.round("feedback", 6))


@query("consolidated_facts", "SELECT user_id AS entity, string_agg(event_type, '; ' ORDER BY ts DESC, event_type DESC) AS summary, count(*) AS n FROM (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return memory.consolidated(t.events.select(F.col("user_id").alias("entity"), F.col("event_type").alias("fact"), F.col("ts").alias("created_at")))


@query("boot_sections", "SELECT 'orders' AS \"table\", o_orderkey::VARCHAR AS id, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey::VARCHAR) AS INT) AS place FROM orders ORDER BY place LIMIT 10")
def _(t):
    rows = t.orders.select(F.lit("orders").alias("table"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("importance"))
    return memory.boot_sections(rows, {"orders": (10, "importance")})


@query("stale_sessions", f"WITH s AS (SELECT user_id, min(ts) AS ts, CASE WHEN user_id % 2 = 0 THEN 'active' ELSE 'ended' END AS status FROM events GROUP BY 1) SELECT user_id FROM s WHERE status = 'active' AND {_DAYS} * 24 > 24")
def _(t):
    s = t.events.groupBy("user_id").agg(F.min("ts").alias("started_at")).withColumn("status", F.when(F.col("user_id") % 2 == 0, "active").otherwise("ended"))
    return memory.stale_sessions(s, NOW).select("user_id")


@query("query_patterns", "WITH r AS (SELECT event_type AS query, floor(hour(ts) / 3.0) AS slot, hour(ts) AS hour, dayofweek(ts) AS d FROM events), d AS (SELECT query, slot, d, count(*) AS n, min(hour) AS hour FROM r GROUP BY 1, 2, 3) SELECT query, CAST(min(hour) AS INT) AS hour, CAST(sum(n) AS BIGINT) AS n, max(n) / CAST(sum(n) AS DOUBLE) > 0.7 AS weekly FROM d GROUP BY query, slot HAVING sum(n) >= 3")
def _(t):
    return memory.query_patterns(t.events.select(F.col("event_type").alias("query"), F.col("ts").alias("timestamp")))


@query("sync_select", "SELECT event_type AS \"table\", event_id::VARCHAR AS id FROM events WHERE event_type IN ('purchase', 'signup') AND value / 100.0 >= 0.1")
def _(t):
    data = F.to_json(F.struct("value", (F.col("value") / 100.0).alias("_importance")))
    rows = t.events.select(F.col("event_type").alias("table"), F.col("event_id").cast("string").alias("id"), data.alias("data"))
    return portable.shared_selection(rows, ["purchase", "signup"]).select("table", "id")


@query("encryption_round_trip", "SELECT c_custkey, c_name AS back FROM customer")
def _(t):
    key = "0123456789abcdef"
    return t.customer.select("c_custkey", portable.opened(portable.sealed(F.col("c_name"), key), key).alias("back"))


@query("distill_failures")
def _(t):
    """Documents of low quality as reports of failures, with their source as the fix; the clusters are those of all of them."""
    stamp = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int")))
    rows = t.documents.join(t.labels.where("quality = 0").select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("text").alias("error"), F.col("source").alias("fix"), stamp.alias("created_at"))
    return memory.distilled_failures(rows, NOW).select(F.sha2("error", 256).alias("error"), "frequency", F.round("impact", 6).alias("impact"), "fix")


@query("search_then_boost", f"WITH {bm25_sql('documents', 'doc_id', 'text', ['hath'])} SELECT s.doc_id AS id, round(score / (score + 1) * (1 + ln(1 + coalesce(n, 0))), 6) AS score FROM s LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l ON l.doc_id = s.doc_id")
def _(t):
    from ..operators.graph import graph_boost

    hits = search.bm25(t.documents, "doc_id", "text", "hath")
    n = t.labels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return hits.join(n, "doc_id", "left").select(F.col("doc_id").alias("id"), F.round(scoring.saturated(F.col("score")) * graph_boost(F.coalesce("n", F.lit(0))), 6).alias("score"))
