"""Queries over the foreign keys as typed, timed edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics, graph
from .parser import parse_path
from .registered import query


def edges(t):
    """nation in_region region, customer and supplier in_nation nation, order placed_by customer (from its date on for 90 days)."""
    none = F.lit(None).cast("timestamp_ntz")

    def part(df, src, a, kind, dst, b, since=none, until=none):
        return df.select(F.concat(F.lit(f"{src}:"), F.col(a)).alias("src"), F.lit(kind).alias("edge_type"), F.concat(F.lit(f"{dst}:"), F.col(b)).alias("dst"), since.alias("valid_from"), until.alias("valid_until"))

    day = F.col("o_orderdate")
    out = part(t.nation, "nation", "n_nationkey", "in_region", "region", "n_regionkey")
    out = out.unionByName(part(t.customer, "customer", "c_custkey", "in_nation", "nation", "c_nationkey"))
    out = out.unionByName(part(t.supplier, "supplier", "s_suppkey", "in_nation", "nation", "s_nationkey"))
    return out.unionByName(part(t.orders, "order", "o_orderkey", "placed_by", "customer", "o_custkey", day, day + F.expr("interval 90 days")))


_E = """e AS (SELECT 'nation:' || n_nationkey AS src, 'in_region' AS edge_type, 'region:' || n_regionkey AS dst, CAST(NULL AS TIMESTAMP) AS vf, CAST(NULL AS TIMESTAMP) AS vu FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'in_nation', 'nation:' || c_nationkey, NULL, NULL FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'in_nation', 'nation:' || s_nationkey, NULL, NULL FROM supplier
    UNION ALL SELECT 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey, o_orderdate, o_orderdate + INTERVAL 90 DAY FROM orders)"""


def _ids(t, *ids):
    return t.spark.range(1).select(F.explode(F.array(*map(F.lit, ids))).alias("id"))


@query("neighbors", f"WITH {_E} SELECT DISTINCT id FROM (SELECT dst AS id FROM e WHERE src = 'nation:3' UNION ALL SELECT src FROM e WHERE dst = 'nation:3')")
def _(t):
    return graph.neighbors(edges(t), _ids(t, "nation:3"), "both")


@query("neighbors_typed", f"WITH {_E} SELECT DISTINCT src AS id FROM e WHERE dst = 'customer:5' AND edge_type = 'placed_by'")
def _(t):
    return graph.neighbors(edges(t), _ids(t, "customer:5"), "in", "placed_by")


@query("traverse_1hop", f"WITH {_E} SELECT DISTINCT dst AS id FROM e WHERE edge_type = 'in_nation' AND src IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    seeds = t.customer.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"))
    return graph.traverse(edges(t), seeds, parse_path("->in_nation"))


@query("traverse_2hop", f"WITH {_E} SELECT DISTINCT b.dst AS id FROM e a JOIN e b ON a.dst = b.src AND b.edge_type = 'in_region' WHERE a.edge_type = 'in_nation' AND a.src IN (SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def _(t):
    seeds = t.supplier.where("s_acctbal > 5000").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"))
    return graph.traverse(edges(t), seeds, parse_path("->in_nation->in_region"))


@query(
    "traverse_3hop",
    f"""WITH {_E}, n AS (SELECT DISTINCT src AS id FROM e WHERE edge_type = 'in_region' AND dst = 'region:2'), c AS (SELECT DISTINCT src AS id FROM e JOIN n ON dst = id WHERE edge_type = 'in_nation')
    SELECT DISTINCT src AS id FROM e JOIN c ON dst = id WHERE edge_type = 'placed_by'""",
)
def _(t):
    return graph.traverse(edges(t), _ids(t, "region:2"), parse_path("<-in_region<-in_nation<-placed_by"))


@query("edge_as_of", f"WITH {_E} SELECT src, dst FROM e WHERE edge_type = 'placed_by' AND vf <= TIMESTAMP '1997-06-01 00:00:00' AND TIMESTAMP '1997-06-01 00:00:00' < vu")
def _(t):
    return graph.as_of(edges(t).where("edge_type = 'placed_by'"), "1997-06-01 00:00:00").select("src", "dst")


@query("degree", f"WITH {_E}, x AS (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) + sum(i) AS BIGINT) AS degree FROM x GROUP BY 1")
def _(t):
    return graph.degree(edges(t))


@query(
    "lineage_bfs",
    f"""WITH RECURSIVE {_E}, w AS (SELECT 'region:1' AS id, 0 AS hop UNION SELECT e.src, w.hop + 1 FROM w JOIN e ON e.dst = w.id WHERE w.hop < 3),
    f AS (SELECT id, min(hop) AS hop FROM w GROUP BY 1)
    SELECT f.id, CAST(f.hop AS INT) AS hop, min(p.id) AS parent FROM f LEFT JOIN e ON e.src = f.id AND f.hop > 0 LEFT JOIN f p ON p.id = e.dst AND p.hop = f.hop - 1 GROUP BY 1, 2""",
)
def _(t):
    return graph.lineage(edges(t), _ids(t, "region:1"), 3, "in")


@query("impact_closure", f"WITH {_E}, n AS (SELECT src AS id FROM e WHERE edge_type = 'in_nation' AND dst = 'nation:7') SELECT id, CAST(1 AS INT) AS hop, true AS direct FROM n")
def _(t):
    return graph.impact(edges(t), _ids(t, "nation:7"), 3, "in_nation")


@query("impact_risk", f"WITH {_E}, n AS (SELECT src AS id FROM e WHERE edge_type = 'in_nation' AND dst = 'nation:7') SELECT count(*) AS direct, CAST(0 AS BIGINT) AS transitive, CASE WHEN count(*) > 10 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS risk FROM n")
def _(t):
    return graph.impact_risk(graph.impact(edges(t), _ids(t, "nation:7"), 3, "in_nation"))


@query("why_connected", "SELECT 'customer:1>nation:' || c_nationkey || '>region:' || n_regionkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1")
def _(t):
    end = t.customer.where("c_custkey = 1").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey").first()[0]
    return graph.connection(edges(t), "customer:1", f"region:{end}").select(F.concat_ws(">", "nodes").alias("path"))


@query(
    "infer_two_hop",
    f"""WITH {_E} SELECT DISTINCT a.src, 'ships_from_region' AS derived, b.dst, 0.8::DOUBLE AS confidence FROM e a JOIN e b ON a.dst = b.src AND b.edge_type = 'in_region' WHERE a.edge_type = 'in_nation'
    UNION SELECT src, 'customer_of', dst, 0.6::DOUBLE FROM e WHERE edge_type = 'placed_by'""",
)
def _(t):
    return graph.infer(edges(t), (("in_nation", "in_region", "ships_from_region", 0.8), ("placed_by", None, "customer_of", 0.6)))


@query(
    "co_mention",
    """WITH m AS (SELECT DISTINCT l_orderkey AS r, l_suppkey AS e FROM lineitem) SELECT a.e AS a, b.e AS b, count(*) AS shared, CASE WHEN count(*) >= 5 THEN 'strongly_related_to' ELSE 'related_to' END AS relation
    FROM m a JOIN m b ON a.r = b.r AND a.e < b.e GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def _(t):
    return graph.co_mentions(t.lineitem, "l_orderkey", "l_suppkey")


@query("export_closed_edges", f"WITH {_E}, n AS (SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey < 3) SELECT src, edge_type, dst FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def _(t):
    nodes = t.customer.where("c_acctbal > 0").select(F.concat(F.lit("customer:"), "c_custkey").alias("id")).unionByName(t.nation.where("n_regionkey < 3").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id")))
    return graph.closed_edges(edges(t), nodes).select("src", "edge_type", "dst")


@query("orphans", f"WITH {_E}, n AS (SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'region:' || r_regionkey FROM region) SELECT src, edge_type, dst FROM e WHERE src NOT IN (SELECT id FROM n) OR dst NOT IN (SELECT id FROM n)")
def _(t):
    one = lambda df, name, key: df.select(F.concat(F.lit(f"{name}:"), key).alias("id"))
    nodes = one(t.customer.where("c_acctbal > 0"), "customer", "c_custkey").unionByName(one(t.nation, "nation", "n_nationkey")).unionByName(one(t.region, "region", "r_regionkey"))
    return graph.orphan_edges(edges(t), nodes).select("src", "edge_type", "dst")


@query(
    "graph_proximity",
    f"""WITH {_E}, c AS (SELECT 'nation:' || n_nationkey AS id FROM nation UNION ALL SELECT 'region:' || r_regionkey FROM region UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_suppkey < 20),
    b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst AND src IN (SELECT id FROM c) AND dst IN (SELECT id FROM c)), k AS (SELECT src, count(*) AS n FROM b GROUP BY 1)
    SELECT id, round(coalesce(n, 0) / CAST((SELECT count(*) - 1 FROM c) AS DOUBLE), 8) AS graph_proximity FROM c LEFT JOIN k ON id = src""",
)
def _(t):
    one = lambda df, name, key: df.select(F.concat(F.lit(f"{name}:"), key).alias("id"))
    c = one(t.nation, "nation", "n_nationkey").unionByName(one(t.region, "region", "r_regionkey")).unionByName(one(t.supplier.where("s_suppkey < 20"), "supplier", "s_suppkey"))
    return graph.proximity(edges(t), c).withColumn("graph_proximity", F.round("graph_proximity", 8))


_ROUND = "r{k} AS (SELECT n.id, 0.15 / t.n + 0.85 * coalesce(s.got, 0) AS rank FROM n CROSS JOIN t LEFT JOIN (SELECT l.dst, sum(p.rank / f.fan) AS got FROM l JOIN r{j} p ON p.id = l.src JOIN f ON f.src = l.src GROUP BY 1) s ON s.dst = n.id)"


@query(
    "pagerank",
    f"WITH {_E}, l AS (SELECT src, dst FROM e), n AS (SELECT src AS id FROM l UNION SELECT dst FROM l), t AS (SELECT count(*)::DOUBLE AS n FROM n), f AS (SELECT src, count(*) AS fan FROM l GROUP BY 1), r0 AS (SELECT id, 1 / t.n AS rank FROM n CROSS JOIN t), "
    + ", ".join(_ROUND.format(k=k, j=k - 1) for k in range(1, 7))
    + " SELECT id, round(rank, 9) AS rank FROM r6",
)
def _(t):
    return graph.pagerank(edges(t), 0.85, 6).withColumn("rank", F.round("rank", 9))


@query("doctor", """SELECT 'repeated_ids' AS "check", CAST(0 AS BIGINT) AS problems, true AS ok
    UNION ALL SELECT 'records_without_vector', count(*), count(*) = 0 FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT 'vectors_without_record', count(*), count(*) = 0 FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'edge_ends_without_record', count(*), count(*) = 0 FROM labels WHERE doc_id + 500 NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'wasted_space', 0, true""")
def _(t):
    link = t.labels.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 500).alias("dst"))
    docs = t.documents.select(F.col("doc_id").alias("id"))
    return diagnostics.doctor(docs, t.embeddings.select(F.col("vec_id").alias("id")), link)


@query(
    "drift",
    """WITH a AS (SELECT p_partkey AS path, sha256(p_name) AS digest FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS path, sha256(CASE WHEN p_size > 40 THEN p_name || '!' ELSE p_name END) AS digest FROM part WHERE p_partkey % 4 <> 0)
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.path = b.path WHERE a.digest IS DISTINCT FROM b.digest""",
)
def _(t):
    digest = lambda c: F.sha2(c, 256).alias("digest")
    a = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("path"), digest(F.col("p_name")))
    b = t.part.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("path"), digest(F.when(F.col("p_size") > 40, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))))
    return diagnostics.drift(a, b)
