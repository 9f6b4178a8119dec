"""Queries of records in motion: imports, files, histories, conflicts, beliefs and what texts say about time and preference."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import entities, queries
from ..model import EDGES
from ..operators import diagnostics, fusion, graph, memory, portable, recall, timeseries
from ..shared import new_path
from ..sources import files
from .registered import query


@query("changed_since", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01'")
def _(t):
    return timeseries.time_range(t.orders, "o_orderdate", "1997-03-01 00:00:00").select("o_orderkey")


@query(
    "jsonl_import",
    """WITH known AS (SELECT * FROM events WHERE event_id % 2 = 0), fresh AS (SELECT DISTINCT event_type, props FROM events WHERE event_id % 2 = 1 AND (event_type, props) NOT IN (SELECT (event_type, props) FROM known))
    SELECT "table", count(*) AS n FROM (SELECT event_type AS "table" FROM known UNION ALL SELECT event_type FROM fresh) GROUP BY 1""",
)
def _(t):
    """Half of the events go out as JSON Lines and come in again beside the other half; equal contents of a table are one."""
    own = t.events.select(F.col("event_id"), F.col("event_type").alias("table"), F.concat(F.lit("e"), "event_id").alias("id"), F.col("props").alias("data"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.lit(None).cast("string").alias("metadata"))
    none = t.spark.createDataFrame([], EDGES)
    path = new_path(t.spark, "export")
    portable.write_export(portable.export(own.where("event_id % 2 = 1").drop("event_id"), none), path)
    records, edges = portable.read_export(t.spark, path)
    got, _ = portable.import_(own.where("event_id % 2 = 0").drop("event_id"), none, records, edges)
    return got.groupBy("table").agg(F.count(F.lit(1)).alias("n"))


@query("content_hash", """SELECT event_id, sha256('[{"key":"k","value":"' || json_extract_string(props, '$.k') || '"}]') AS hash FROM events""")
def _(t):
    return t.events.select("event_id", portable.content_hash(F.col("props")).alias("hash"))


@query("snapshot_restore", "SELECT o_orderstatus, count(*) AS n, sum(CAST(o_orderkey AS BIGINT))::BIGINT AS keys FROM orders GROUP BY 1")
def _(t):
    path = new_path(t.spark, "snapshot")
    portable.snapshot(t.orders, path)
    return portable.restore(t.spark, path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("directory_ingest", "SELECT sha256(string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10)) AS digest FROM nation")
def _(t):
    """One file of names beside one that is known already."""
    path = new_path(t.spark, "tree")
    for i, df in enumerate((t.nation.select(F.col("n_nationkey").alias("k"), "n_name"), t.region.select(F.col("r_regionkey").alias("k"), "r_name"))):
        df.coalesce(1).sortWithinPartitions("k").drop("k").write.text(f"{path}/part{i}")
    found = files.source_files(t.spark, path, ["txt"])
    return files.changed_files(found, found.where(F.contains("path", F.lit("/part1/")))).select("digest")


@query(
    "code_symbols",
    """WITH p AS (SELECT p_partkey::VARCHAR AS k FROM part), s AS (SELECT k, 'import' AS kind, 'std::io' AS name, 1 AS line, 'use std::io' AS signature, NULL AS doc FROM p
    UNION ALL SELECT k, 'function', 'load_' || k, 3, 'pub fn load_' || k || '(x: u32)', 'Loads ' || k || '.' FROM p UNION ALL SELECT k, 'struct', 'Part' || k, 5, 'pub struct Part' || k, NULL FROM p)
    SELECT 'src/p' || k || '.rs' AS path, 'rust' AS language, kind, name, CAST(line AS INT) AS line, signature, doc FROM s""",
)
def _(t):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("use std::io\n/// Loads "), k, F.lit(".\npub fn load_"), k, F.lit("(x: u32) {\n}\npub struct Part"), k, F.lit(" {\n"))
    return files.code_symbols(t.part.select(F.concat(F.lit("src/p"), k, F.lit(".rs")).alias("path"), F.lit("rust").alias("language"), text.alias("text")))


_DECLARED = """WITH d AS (SELECT 'p' || p_partkey || '/requirements.txt' AS path, 'spark' AS name, '==' || p_size AS requirement, p_size FROM part UNION ALL SELECT 'p' || p_partkey || '/requirements.txt', 'numpy', '>=1.' || p_size, p_size FROM part)"""


def _declared(t):
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("spark=="), size, F.lit("\n# note\nnumpy>=1."), size, F.lit("\n"))
    return files.manifests(t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/requirements.txt")).alias("path"), text.alias("text")))


@query("manifests", f"{_DECLARED} SELECT path, 'python' AS ecosystem, name, requirement, false AS dev FROM d")
def _(t):
    return _declared(t)


@query("dependencies_resolved", f"{_DECLARED} SELECT path, name, CASE WHEN name = 'numpy' THEN '2.1.0' END AS version FROM d")
def _(t):
    locked = t.spark.createDataFrame([("numpy", "2.0.9"), ("numpy", "2.1.0"), ("pandas", "2.2")], "name string, version string")
    return files.resolved(_declared(t), locked).select("path", "name", "version")


def _tree(t):
    """Events as a binary tree: each follows the one of half its number."""
    return t.events.where("event_id > 0").select(F.col("event_id").alias("src"), F.lit("supersedes").alias("edge_type"), F.floor(F.col("event_id") / 2).alias("dst"))


def _from(t, start):
    return t.events.where(F.col("event_id") == start).select(F.col("event_id").alias("id"))


@query("lineage_deltas", "SELECT e.event_id AS id, CAST(h AS INT) AS hop, p.event_id AS parent, e.value, e.value - p.value AS delta_value FROM range(0, 5) r(h) JOIN events e ON e.event_id = 37 >> h LEFT JOIN events p ON h > 0 AND p.event_id = 37 >> (h - 1)")
def _(t):
    found = graph.lineage(_tree(t), _from(t, 37), 4)
    return graph.lineage_deltas(found, t.events.select(F.col("event_id").alias("id"), "value"), ["value"])


@query("supersede_chain", "SELECT 60 >> h AS id, CAST(h AS INT) AS hop FROM range(0, 7) r(h)")
def _(t):
    return memory.supersede_history(_tree(t), _from(t, 60))


@query("conflicts", "SELECT event_id AS a, event_id + 1 AS b, CASE WHEN event_id % 3 = 0 THEN 'high' WHEN event_id % 10 >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM events WHERE event_id % 3 < 2 AND event_id % 10 >= 2")
def _(t):
    """Of three kinds: one side denies, both assert, nothing is named by both."""
    n = F.col("event_id")
    other = F.when(n % 3 == 0, "we never use the cache for reads now").otherwise("the cache serves writes only")
    shared = F.when(n % 3 < 2, F.array(F.lit("cache"))).otherwise(F.array().cast("array<string>"))
    return memory.conflicts(t.events.select(n.alias("a"), (n + 1).alias("b"), ((n % 10 * 10 + 905) / 1000.0).alias("score"), F.lit("we use the cache for reads").alias("a_text"), other.alias("b_text"), shared.alias("shared")))


@query("resolve_on_write", "SELECT event_id, CASE WHEN event_id % 10 >= 5 AND event_id % 7 = 6 THEN 'duplicate' WHEN event_id % 10 >= 2 THEN 'conflict_check' ELSE 'distinct' END AS action FROM events")
def _(t):
    n = F.col("event_id")
    return t.events.select(n, memory.resolution((n % 10 * 10 + 905) / 1000.0, n % 7 / 6.0).alias("action"))


@query("entity_merge", "SELECT CASE event_type WHEN 'click' THEN 'view' ELSE event_type END AS event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return memory.merge_entity(t.events, "event_type", "click", "view").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("relations_discovered", "SELECT n_name AS entity, r_name AS mentions FROM nation JOIN region ON n_regionkey = r_regionkey WHERE regexp_full_match(r_name, '\\w+') AND r_name <> n_name")
def _(t):
    """Names of two words are no whole word."""
    facts = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), F.concat("n_name", F.lit(" lies, they say, in "), "r_name", F.lit(".")).alias("fact"))
    return memory.discovered_relations(facts, t.region.select(F.col("r_name").alias("entity")))


@query("beliefs_revised", "SELECT n_nationkey AS observation, r_regionkey AS belief, CASE n_nationkey % 3 WHEN 0 THEN 'reinforce' ELSE 'doubt' END AS action, CASE n_nationkey % 3 WHEN 0 THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence FROM nation CROSS JOIN region WHERE n_nationkey % 3 < 2")
def _(t):
    said = F.when(F.col("n_nationkey") % 3 == 0, "orders from abroad arrive quickly").when(F.col("n_nationkey") % 3 == 1, "orders never arrive quickly in winter").otherwise("nothing else")
    beliefs = t.region.select(F.col("r_regionkey").alias("id"), F.concat(F.lit("orders from region"), "r_regionkey", F.lit(" arrive quickly")).alias("statement"), F.lit(0.5).alias("confidence"))
    return memory.revise_beliefs(t.nation.select(F.col("n_nationkey").alias("id"), said.alias("text")), beliefs)


@query("scope_filter", "SELECT c_custkey FROM customer WHERE c_custkey % 4 IN (0, 2) AND c_custkey % 5 <> 1 AND c_acctbal >= 500")
def _(t):
    """No scope means project, no confidence a half."""
    n = F.col("c_custkey")
    rows = t.customer.select(n, F.when(n % 4 == 0, "project").when(n % 4 == 1, "user").when(n % 4 == 3, "global").alias("_scope"), F.when(n % 5 == 1, 0.4).when(n % 5 > 1, 0.9).alias("_confidence"), F.col("c_acctbal").alias("_importance"))
    return recall.allowed(rows, ("project",), 0.5, 500.0).select("c_custkey")


@query("identifier_parts", "SELECT p_partkey, ['read', 'part' || p_size, 'http', 'server'] AS parts FROM part")
def _(t):
    return t.part.select("p_partkey", recall.identifier_parts(F.concat(F.lit("readPart"), F.col("p_size").cast("string"), F.lit("_HTTPServer read"))).alias("parts"))


@query("preferences", "SELECT n_nationkey, ['I prefer ' || n_name, 'Always test first', 'Use spark for scans'] AS said FROM nation")
def _(t):
    text = F.concat(F.lit("I prefer "), "n_name", F.lit(".\nAlways test first. Never mind.\nUse spark for scans."))
    return t.nation.select("n_nationkey", entities.preferences(text).alias("said"))


@query("negation_near", "SELECT n_nationkey, n_nationkey % 3 = 1 AS denied FROM nation")
def _(t):
    """No denial, one close to the name, one over 80 characters away."""
    n = F.col("n_nationkey") % 3
    text = F.concat(F.lit("The port of "), "n_name", F.lit(" is "), F.when(n == 1, "never ").when(n == 2, F.repeat(F.lit("very "), F.lit(40))).otherwise(""), F.lit("open"), F.when(n == 2, ", others are not").otherwise(""))
    return t.nation.select("n_nationkey", memory.negated_near(text, F.col("n_name")).alias("denied"))


@query(
    "temporal_phrases",
    """SELECT * FROM (VALUES ('errors 3 days ago', TIMESTAMP '2026-04-07 12:00:00', 3.0::DOUBLE, 'errors'), ('2 weeks ago builds', TIMESTAMP '2026-03-27 12:00:00', 7.0, 'builds'), ('what broke last week', TIMESTAMP '2026-04-03 12:00:00', 7.0, 'what broke'),
    ('changed yesterday', TIMESTAMP '2026-04-09 12:00:00', 1.5, 'changed'), ('release 2026-01-15 notes', TIMESTAMP '2026-01-15 12:00:00', 3.0, 'release notes'), ('plan of december 24', TIMESTAMP '2025-12-24 12:00:00', 3.0, 'plan of'), ('no time here', NULL, NULL, NULL)) v(query, target, window_days, rest)""",
)
def _(t):
    now = dt.datetime(2026, 4, 10, 12)
    asked = ("errors 3 days ago", "2 weeks ago builds", "what broke last week", "changed yesterday", "release 2026-01-15 notes", "plan of december 24", "no time here")
    found = [(q, queries.parse_temporal(q, now)) for q in asked]
    return t.spark.createDataFrame([(q, f[0].target, f[0].window_days, f[1]) if f else (q, None, None, None) for q, f in found], "query string, target timestamp_ntz, window_days double, rest string")


@query(
    "storage_growth",
    """WITH s AS (SELECT date_trunc('day', ts)::TIMESTAMP AS d, count(*)::DOUBLE AS mb FROM events GROUP BY 1), r AS (SELECT *, (mb - lag(mb) OVER (ORDER BY d)) / ((epoch_us(d) - lag(epoch_us(d)) OVER (ORDER BY d)) / 86400000000.0) AS mb_per_day FROM s)
    SELECT d AS "at", mb, mb_per_day, coalesce(mb_per_day > 10, false) AS alert FROM r""",
)
def _(t):
    sizes = timeseries.bucket_counts(t.events, "ts", "day").select(F.col("bucket").alias("at"), F.col("count").cast("double").alias("mb"))
    return diagnostics.growth(sizes)


@query(
    "best_rank",
    """WITH a AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS r FROM customer), b AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) - 1 AS r FROM customer)
    SELECT id, CAST(min(r) AS INT) AS best_rank FROM (SELECT * FROM a WHERE r < 40 UNION ALL SELECT * FROM b WHERE r < 40) GROUP BY 1""",
)
def _(t):
    lists = [fusion.ranked(fusion.top(t.customer.select(F.col("c_custkey").alias("id"), F.col(c).cast("double").alias("score")), 40), c) for c in ("c_acctbal", "c_nationkey")]
    return fusion.rrf(lists).select("id", "best_rank")
