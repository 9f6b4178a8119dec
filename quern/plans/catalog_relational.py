"""Queries of scans, filters, order, aggregates, time and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import diagnostics, fusion, relational, timeseries
from ..operators.predicates import Condition, json_field, json_number, matching
from ..sources.tables import Catalog, Tables, inferred_schema
from ..streaming import changes
from .builder import Database
from .compiler import run
from .registered import NOW, query


def database(t: Tables) -> Database:
    """The driver's tables as tables of a database, each with an id."""
    key = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "documents": "doc_id", "events": "event_id"}
    tables = {name: t.table(name).withColumn("id", F.col(k).cast("string")) for name, k in key.items()}
    tables["lineitem"] = t.lineitem
    return Database(Catalog(tables))


@query(
    "agg_flagship",
    """SELECT l_returnflag AS "group", count(*) AS count, round(avg(l_extendedprice), 4) AS avg_l_extendedprice, CAST(0 AS BIGINT) AS skipped
    FROM lineitem WHERE l_quantity > 25 GROUP BY 1""",
)
def _(t):
    got = run(database(t), "AGG count, avg(l_extendedprice) FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag")
    return got.withColumn("avg_l_extendedprice", F.round("avg_l_extendedprice", 4))


@query("scan_limit_offset", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 20")
def _(t):
    return relational.scan(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 50, 20)


@query("point_lookup", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def _(t):
    return relational.point(t.orders, "o_orderkey", 7).select("o_orderkey", "o_orderstatus")


@query("filter_eq", "SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#17'")
def _(t):
    return matching(t.part, [Condition("p_brand", "=", "Brand#17")]).select("p_partkey", "p_brand")


@query("filter_ne", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'")
def _(t):
    return matching(t.orders, [Condition("o_orderstatus", "!=", "F")]).select("o_orderkey", "o_orderstatus")


@query("filter_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12")
def _(t):
    return matching(t.lineitem, [Condition("l_quantity", ">=", 10), Condition("l_quantity", "<", 12)]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_contains_str", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
def _(t):
    return matching(t.part, [Condition("p_name", "CONTAINS", "ring")]).select("p_partkey", "p_name")


@query("filter_contains_arr", "SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'red')")
def _(t):
    return matching(t.part.withColumn("tags", F.split("p_name", " ")), [Condition("tags", "CONTAINS", "red")]).select("p_partkey", "p_name")


@query("filter_multi_and", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000 AND o_orderpriority = '1-URGENT'")
def _(t):
    cs = [Condition("o_orderstatus", "=", "F"), Condition("o_totalprice", ">", 300000), Condition("o_orderpriority", "=", "1-URGENT")]
    return matching(t.orders, cs).select("o_orderkey")


@query("filter_missing_field", "SELECT count(*) AS ne_rows, CAST(0 AS BIGINT) AS eq_rows FROM region")
def _(t):
    ne, eq = (matching(t.region, [Condition("nowhere", op, "x")]) for op in ("!=", "="))
    return ne.agg(F.count(F.lit(1)).alias("ne_rows")).crossJoin(eq.agg(F.count(F.lit(1)).alias("eq_rows")))  # one row each


@query("order_by_field", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def _(t):
    return relational.ordered(t.customer, "c_acctbal", False, "c_custkey").limit(100).select("c_custkey", "c_acctbal")


@query("order_by_time", "SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 100")
def _(t):
    return relational.ordered(t.events, "ts", True, "event_id").limit(100).select("event_id", "ts")


@query("count_table", "SELECT count(*) AS count FROM orders")
def _(t):
    return run(database(t), "COUNT FROM orders")


@query("count_all", "SELECT 'customer' AS \"table\", count(*) AS count FROM customer UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def _(t):
    return database(t).catalog.counts()


@query("count_where", "SELECT count(*) AS count FROM events WHERE event_type = 'purchase' AND value > 50")
def _(t):
    return run(database(t), "COUNT FROM events WHERE event_type = 'purchase' AND value > 50")


@query("agg_count_group", 'SELECT o_orderpriority AS "group", count(*) AS count, CAST(0 AS BIGINT) AS skipped FROM orders GROUP BY 1')
def _(t):
    return relational.aggregate(t.orders, ["count"], "o_orderpriority")


@query("agg_avg", 'SELECT c_mktsegment AS "group", count(*) AS count, round(avg(c_acctbal), 4) AS avg_c_acctbal, CAST(0 AS BIGINT) AS skipped FROM customer GROUP BY 1')
def _(t):
    return relational.aggregate(t.customer, ["avg(c_acctbal)"], "c_mktsegment").withColumn("avg_c_acctbal", F.round("avg_c_acctbal", 4))


@query("agg_sum", 'SELECT l_linestatus AS "group", count(*) AS count, round(sum(l_quantity), 2) AS sum_l_quantity, CAST(0 AS BIGINT) AS skipped FROM lineitem GROUP BY 1')
def _(t):
    return relational.aggregate(t.lineitem, ["sum(l_quantity)"], "l_linestatus").withColumn("sum_l_quantity", F.round("sum_l_quantity", 2))


@query("agg_minmax", 'SELECT p_brand AS "group", count(*) AS count, min(p_retailprice) AS min_p_retailprice, CAST(max(p_size) AS DOUBLE) AS max_p_size, CAST(0 AS BIGINT) AS skipped FROM part GROUP BY 1')
def _(t):
    return relational.aggregate(t.part, ["min(p_retailprice)", "max(p_size)"], "p_brand")


@query(
    "agg_multi",
    """SELECT l_returnflag AS "group", count(*) AS count, round(avg(l_discount), 6) AS avg_l_discount, min(l_tax) AS min_l_tax, max(l_quantity) AS max_l_quantity,
    round(sum(l_extendedprice), 2) AS sum_l_extendedprice, CAST(0 AS BIGINT) AS skipped FROM lineitem GROUP BY 1""",
)
def _(t):
    got = run(database(t), "AGG count, avg(l_discount), min(l_tax), max(l_quantity), sum(l_extendedprice) FROM lineitem GROUP BY l_returnflag")
    return got.withColumn("avg_l_discount", F.round("avg_l_discount", 6)).withColumn("sum_l_extendedprice", F.round("sum_l_extendedprice", 2))


@query("agg_global", 'SELECT CAST(NULL AS VARCHAR) AS "group", count(*) AS count, round(avg(value), 6) AS avg_value, CAST(0 AS BIGINT) AS skipped FROM events HAVING count(*) > 0')
def _(t):
    return relational.aggregate(t.events, ["avg(value)"]).withColumn("avg_value", F.round("avg_value", 6))


@query("agg_global_no_rows", "SELECT CAST(NULL AS VARCHAR) AS \"group\", count(*) AS count, CAST(NULL AS DOUBLE) AS avg_value, CAST(0 AS BIGINT) AS skipped FROM events WHERE event_type = 'none' HAVING count(*) > 0")
def _(t):
    return relational.aggregate(t.events.where("event_type = 'none'"), ["avg(value)"])


@query(
    "agg_skipped",
    """WITH e AS (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(props->>'k' AS DOUBLE) END AS k FROM events)
    SELECT '"' || event_type || '"' AS "group", count(*) AS count, round(avg(k), 6) AS avg_k, CAST(sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM e GROUP BY 1""",
)
def _(t):
    k = F.get_json_object("props", "$.k")  # a third of the rows has a string where others have a number
    data = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct("event_type", k.alias("k")))).otherwise(F.to_json(F.struct("event_type", k.cast("long").alias("k"))))
    return relational.aggregate(t.events.select(data.alias("data")), ["avg(k)"], "event_type").withColumn("avg_k", F.round("avg_k", 6))


@query("json_field", "SELECT event_type, count(*) AS count, round(sum(CAST(props->>'k' AS DOUBLE)), 2) AS total FROM events WHERE CAST(props->>'k' AS DOUBLE) > 50 GROUP BY 1")
def _(t):
    rows = matching(t.events.withColumnRenamed("props", "data"), [Condition("k", ">", 50)])
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("count"), F.round(F.sum(json_number(json_field("k"))), 2).alias("total"))


@query("inferred_schema", "SELECT 'k' AS field, 'BIGINT' AS type, count(*) AS count FROM events")
def _(t):
    return inferred_schema(t.events.withColumnRenamed("props", "data"))


@query("ts_range", "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-11 00:00:00'")
def _(t):
    return timeseries.time_range(t.events, "ts", "2024-01-10 00:00:00", "2024-01-11 00:00:00").select("event_id", "ts")


@query("since_seconds", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 172800 SECOND AND ts <= TIMESTAMP '{NOW}'")
def _(t):
    return timeseries.since(t.events, "ts", 172_800, NOW).select("event_id")


@query("latest_n", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 25")
def _(t):
    return relational.latest(t.events, "ts", 25, "event_id").select("event_id", "ts", "event_type")


for _unit in timeseries.UNITS:

    @query(f"bucket_{_unit}", f"SELECT date_trunc('{_unit}', ts)::TIMESTAMP AS bucket, count(*) AS count FROM events GROUP BY 1")
    def _(t, unit=_unit):
        return timeseries.bucket_counts(t.events, "ts", unit)


_DAILY = """daily AS (SELECT event_type AS "table", strftime(ts, '%Y-%m-%d') AS period, count(*) AS count, 'daily_summary' AS type FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1, 2)"""


def _event_records(t):
    return t.events.select(F.col("event_type").alias("table"), F.col("event_id").cast("string").alias("id"), F.col("ts").alias("created_at"))


@query("downsample_daily", f"WITH {_DAILY} SELECT * FROM daily")
def _(t):
    return timeseries.daily_summaries(_event_records(t), "2024-01-20 00:00:00")


@query("downsample_weekly", f"""WITH {_DAILY} SELECT "table", strftime(date_trunc('week', CAST(period AS DATE)), '%Y-%m-%d') AS period, CAST(sum(count) AS BIGINT) AS count, 'weekly_summary' AS type FROM daily GROUP BY 1, 2""")
def _(t):
    return timeseries.weekly_summaries(timeseries.daily_summaries(_event_records(t), "2024-01-20 00:00:00"))


@query(
    "downsample_heal",
    f"""WITH {_DAILY}, old AS (SELECT "table", period, count + 1 AS count, type FROM daily WHERE period < '2024-01-05' UNION ALL SELECT 'gone', '2023-12-30', 5, 'daily_summary'),
    both_ AS (SELECT coalesce(d."table", o."table") AS "table", coalesce(d.period, o.period) AS period, coalesce(d.count, o.count) AS count, 'daily_summary' AS type FROM daily d FULL JOIN old o ON d."table" = o."table" AND d.period = o.period)
    SELECT * FROM both_ UNION ALL SELECT "table", strftime(date_trunc('week', CAST(period AS DATE)), '%Y-%m-%d'), CAST(sum(count) AS BIGINT), 'weekly_summary' FROM both_ GROUP BY 1, 2""",
)
def _(t):
    records = _event_records(t)
    old = timeseries.daily_summaries(records, "2024-01-05 00:00:00").withColumn("count", F.col("count") + 1)
    gone = t.spark.range(1).select(F.lit("gone").alias("table"), F.lit("2023-12-30").alias("period"), F.lit(5).cast("long").alias("count"), F.lit("daily_summary").alias("type"))
    return timeseries.heal(records, old.select("table", "period", "count", "type").unionByName(gone), "2024-01-20 00:00:00")


@query(
    "trend",
    """SELECT user_id, arg_min(value, {'a': ts, 'b': event_id}) AS first, arg_max(value, {'a': ts, 'b': event_id}) AS last,
    round(CASE WHEN first <> 0 THEN last / first END, 6) AS ratio, coalesce(last / nullif(first, 0) < 0.7, false) AS alert FROM events GROUP BY 1""",
)
def _(t):
    return timeseries.trend(t.events, "user_id", "ts", "value", "event_id").withColumn("ratio", F.round("ratio", 6))


@query("recency_decay", f"SELECT event_id, round(exp(-ln(2) * greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3600000000.0 / 168.0), 8) AS recency FROM events")
def _(t):
    return t.events.select("event_id", F.round(scoring.recency_decay("ts", NOW), 8).alias("recency"))


@query("temporal_boost", "SELECT event_id, round(greatest(0, 0.4 * (1 - abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 00:00:00')) / 86400000000.0 / 7.0)), 8) AS boost FROM events")
def _(t):
    return t.events.select("event_id", F.round(scoring.temporal_boost("ts", "2024-01-15 00:00:00", 7.0), 8).alias("boost"))


@query(
    "recency_rank_score",
    """WITH c AS (SELECT event_id AS id, ts FROM events ORDER BY ts DESC, event_id LIMIT 200)
    SELECT id, round(1 - (row_number() OVER (ORDER BY ts DESC, id) - 1) / CAST(count(*) OVER () AS DOUBLE), 8) AS score FROM c""",
)
def _(t):
    latest = relational.latest(t.events.select(F.col("event_id").alias("id"), "ts"), "ts", 200)
    return fusion.recency_rank(latest, "ts").withColumn("score", F.round("score", 8))


@query(
    "latest_per_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
)
def _(t):
    return relational.latest_per_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey").drop("o_orderdate")


@query(
    "dedup_keep_best",
    """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1""",
)
def _(t):
    return relational.best_per_key(t.events.select("user_id", "event_id", "value"), "user_id", "value", "event_id")


@query(
    "union_first_wins",
    """WITH a AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS rank FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100),
    b AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS rank FROM customer ORDER BY c_custkey LIMIT 100), u AS (SELECT id, 0 AS source_order, rank FROM a UNION ALL SELECT id, 1, rank FROM b)
    SELECT id, CAST(source_order AS INT) AS source_order, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source_order, rank) AS r FROM u) WHERE r = 1""",
)
def _(t):
    base = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    a = fusion.ranked(fusion.top(base, 100), "best").select("id", "rank")
    b = fusion.ranked(base.orderBy("id").limit(100).withColumn("score", -F.col("id")), "first").select("id", "rank")
    return relational.union_first_wins(a, b)


@query("latency_percentiles", "SELECT " + ", ".join(f"(list_sort(list(value)))[CAST(round({p} * (count(value) - 1)) AS INT) + 1] AS {n}" for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))) + " FROM events")
def _(t):
    return diagnostics.percentiles(t.events, "value")


@query("query_analytics", "SELECT event_type AS query_type, count(*) AS queries, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS tokens, CAST(sum(CASE WHEN CAST(props->>'k' AS BIGINT) % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty FROM events GROUP BY 1")
def _(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return diagnostics.query_log_summary(t.events.select(F.col("event_type").alias("query_type"), k.alias("tokens_served"), (k % 10).alias("results_count")))


@query("hot_table_share", "WITH c AS (SELECT event_type, count(*) AS count FROM events GROUP BY 1) SELECT event_type, count, round(count / CAST(sum(count) OVER () AS DOUBLE), 8) AS share FROM c")
def _(t):
    return relational.share_of_total(t.events, "event_type").withColumn("share", F.round("share", 8))


@query("branch_diff", """WITH m AS (SELECT o_orderpriority AS "table", count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS "table", count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
    SELECT coalesce(m."table", b."table") AS "table", coalesce(m.n, 0) AS main_count, coalesce(b.n, 0) AS branch_count, coalesce(b.n, 0) - coalesce(m.n, 0) AS delta FROM m FULL JOIN b ON m."table" = b."table" WHERE coalesce(b.n, 0) <> coalesce(m.n, 0)""")
def _(t):
    from ..operators.portable import branch_diff

    rows = t.orders.select(F.col("o_orderpriority").alias("table"), "o_orderstatus")
    return branch_diff(rows, rows.where("o_orderstatus <> 'P'"))


@query("branch_merge", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'b' ELSE 'm' END AS data FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 5 = 0""")
def _(t):
    from ..operators.portable import merge_branch

    base = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"))
    main = base.where("id % 7 <> 0").withColumn("data", F.lit("m"))
    branch = base.where("id % 5 = 0").withColumn("data", F.lit("b"))
    return merge_branch(main, branch, "branch_wins").select("id", "data")


@query("upsert", "SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN 0.0 ELSE c_acctbal END AS balance FROM customer")
def _(t):
    from ..operators.portable import upsert

    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return upsert(rows, t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("id"), F.lit(0.0).alias("balance")))


@query("content_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(coalesce(text, ''))")
def _(t):
    return t.documents.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("stream_bucket_hour", "SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, count(*) AS count FROM events GROUP BY 1")
def _(t):
    stream = changes.read_stream(t.spark, t.path("events"), t.events.schema)
    return changes.run_available(changes.window_counts(stream, "ts"), "stream_bucket_hour", "complete")


def _change_rows(events):
    table = F.element_at(F.array(F.lit("_checkpoint_records"), F.lit("_beliefs"), F.lit("errors"), F.lit("decisions")), (F.col("event_id") % 4 + 1).cast("int"))
    k = F.get_json_object("props", "$.k").cast("long")
    after = F.to_json(F.struct((k > 50).alias("doubted"), (k % 2 == 0).alias("_superseded"), F.when(k % 3 == 0, "patched").alias("fix")))
    op = F.when(F.col("event_id") % 5 == 0, "update").otherwise("insert")
    return events.select(F.col("event_id").alias("change_id"), op.alias("op"), table.alias("table"), F.col("user_id").alias("record_id"), after.alias("after"))


@query(
    "event_classify",
    """WITH e AS (SELECT event_id, user_id, ['_checkpoint_records', '_beliefs', 'errors', 'decisions'][event_id % 4 + 1] AS tab, CASE WHEN event_id % 5 = 0 THEN 'update' ELSE 'insert' END AS op, CAST(props->>'k' AS BIGINT) AS k FROM events),
    c AS (SELECT event_id AS change_id, CASE WHEN tab = '_checkpoint_records' AND op = 'insert' THEN 'checkpoint_written' WHEN tab = '_beliefs' AND k > 50 THEN 'belief_revised' WHEN k % 2 = 0 THEN 'decision_superseded' WHEN tab = 'errors' AND k % 3 = 0 THEN 'error_fixed' END AS kind, tab AS "table", user_id AS record_id FROM e)
    SELECT * FROM c WHERE kind IS NOT NULL""",
)
def _(t):
    stream = changes.read_stream(t.spark, t.path("events"), t.events.schema)
    return changes.run_available(changes.semantic_events(_change_rows(stream)), "event_classify")


@query("cdc_since", "SELECT event_id AS change_id, user_id AS record_id FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 500")
def _(t):
    return changes.changes_since(_change_rows(t.events), 100, 500).select("change_id", "record_id")


@query(
    "cdc_replay",
    """WITH l AS (SELECT user_id AS id, max(event_id) AS e FROM events GROUP BY 1), x AS (SELECT id, event_type FROM l JOIN events ON e = event_id AND id = user_id) SELECT id, event_type AS data FROM x WHERE event_type <> 'error'""",
)
def _(t):
    from ..operators.portable import replay

    log = t.events.select(F.col("event_id").alias("change_id"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"), F.lit("users").alias("table"), F.col("user_id").alias("record_id"), F.col("event_type").alias("after"), F.col("ts").alias("created_at"))
    main = t.events.where("user_id < 20").select(F.col("user_id").alias("id"), F.lit("users").alias("table"), F.lit("old").alias("data"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.lit(None).cast("string").alias("metadata")).dropDuplicates(["id"])
    return replay(main, log).select("id", "data")


@query(
    "dedup_5min",
    """WITH RECURSIVE o AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
    w AS (SELECT *, t AS last, true AS kept FROM o WHERE r = 1 UNION ALL SELECT o.*, CASE WHEN o.t - w.last >= 300000000 THEN o.t ELSE w.last END, o.t - w.last >= 300000000 FROM w JOIN o ON o.user_id = w.user_id AND o.event_type = w.event_type AND o.r = w.r + 1)
    SELECT event_id FROM w WHERE kept""",
)
def _(t):
    return changes.repeats_dropped(t.events, ["user_id", "event_type"], "ts", "event_id").select("event_id")


@query("stream_dedup_within")
def _(t):
    """Rows alone are checked: which rows of one batch are dropped depends on the order in which files bring them."""
    stream = changes.read_stream(t.spark, t.path("events"), t.events.schema)
    return changes.run_available(changes.first_within(stream.select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts"), "stream_dedup").select("event_id")


@query(
    "session_rollup",
    """WITH o AS (SELECT user_id, ts, event_id, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000, true) THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM o)
    SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 3) AS seconds FROM s GROUP BY 1, 2""",
)
def _(t):
    from ..operators.memory import episodes, sessionize

    return episodes(sessionize(t.events, "user_id", "ts", "event_id"), ["user_id", "session"], "ts").withColumn("seconds", F.round("seconds", 3))


@query("activation_state", f"SELECT user_id, round(sum(0.1 * pow(0.5, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0 / 30.0)), 6) AS activation FROM events GROUP BY 1")
def _(t):
    return changes.activations_of(t.events, "user_id", "ts", NOW).withColumn("activation", F.round("activation", 6))
