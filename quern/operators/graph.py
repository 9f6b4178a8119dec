"""Typed, timed edges: neighbours, paths, closures, inference and PageRank as joins over (src, edge_type, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import valid_at
from ..shared import bucketed, settled


def as_of(edges: DataFrame, at: object) -> DataFrame:
    """Edges that hold at a time."""
    at = at if isinstance(at, Column) else F.lit(at).cast("timestamp_ntz")
    return edges.where(valid_at(at, F.col("valid_from"), F.col("valid_until")))


def hops(edges: DataFrame, direction: str = "out", edge_type: str | None = None, at: object = None) -> DataFrame:
    """(src, dst) pairs of one step in a direction."""
    if at is not None:
        edges = as_of(edges, at)
    if edge_type is not None:
        edges = edges.where(F.col("edge_type") == edge_type)
    out, back = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": out, "in": back}[direction] if direction != "both" else out.unionByName(back)


def neighbors(edges: DataFrame, nodes: DataFrame, direction: str = "out", edge_type: str | None = None, at: object = None) -> DataFrame:
    """Distinct ids one step away from any of nodes (id)."""
    return hops(edges, direction, edge_type, at).join(nodes.select("id"), F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct()


def traverse(edges: DataFrame, seeds: DataFrame, path, at: object = None) -> DataFrame:
    """Ids at the end of a path from seeds (id), once each. Each step starts from distinct ids, so cycles do no harm."""
    now = seeds.select("id").distinct()
    for step in path:
        now = neighbors(edges, now, step.direction, step.edge_type, at)
    return now


def degree(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, degree."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree")).withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def lineage(edges: DataFrame, start: DataFrame, depth: int, direction: str = "out", edge_type: str | None = None) -> DataFrame:
    """id, hop, parent: breadth-first from start (id) up to depth; an id is reached once, from its smallest parent.

    A frontier is joined with the edges and stripped of what was visited. It is read twice, by the next hop and by the
    result, so each is written to the shared folder: plans stay short, and a lost executor costs no more than its tasks.
    """
    step = hops(edges, direction, edge_type)
    seen = start.select("id", F.lit(0).alias("hop"), F.lit(None).cast(start.schema["id"].dataType).alias("parent")).distinct()
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.select(F.col("id").alias("parent")).join(step, F.col("parent") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("parent").alias("parent"))
        frontier = reached.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"), "parent")
        if hop < depth:
            frontier = settled(frontier, "frontier")
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen


def lineage_deltas(found: DataFrame, records: DataFrame, fields: list[str]) -> DataFrame:
    """Lineage with each numeric field and its difference to the parent's."""
    own = records.select("id", *fields)
    up = records.select(F.col("id").alias("parent"), *(F.col(f).alias(f"parent_{f}") for f in fields))
    return found.join(own, "id", "left").join(up, "parent", "left").select("id", "hop", "parent", *fields, *((F.col(f) - F.col(f"parent_{f}")).alias(f"delta_{f}") for f in fields))


def impact(edges: DataFrame, start: DataFrame, depth: int, edge_type: str = "depends_on") -> DataFrame:
    """id, hop, direct: what depends on start, at most depth steps away."""
    return lineage(edges, start, depth, "in", edge_type).where("hop > 0").select("id", "hop", (F.col("hop") == 1).alias("direct"))


def impact_risk(found: DataFrame) -> DataFrame:
    """direct, transitive, risk: high over 10 dependents, medium from 3, else low."""
    n = F.count(F.lit(1))
    return found.agg(F.coalesce(F.sum(F.col("direct").cast("long")), F.lit(0)).alias("direct"), F.coalesce(F.sum((~F.col("direct")).cast("long")), F.lit(0)).alias("transitive"), F.when(n > 10, "high").when(n >= 3, "medium").otherwise("low").alias("risk"))


def connection(edges: DataFrame, a, b, depth: int = 5) -> DataFrame:
    """nodes: the shortest path from a to b over edges in either direction, of equals the smallest; no row without one."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    start = spark.range(1).select(F.lit(a).cast(kind).alias("id"))
    found = settled(lineage(edges, start, depth, "both"), "paths")
    path = found.where(F.col("id") == F.lit(b).cast(kind)).select(F.col("id").alias("at"), "parent", "hop", F.array("id").alias("nodes"))
    done = []
    for _ in range(depth + 1):
        done.append(path.where(F.col("hop") == 0).select("nodes"))
        up = found.select(F.col("id").alias("up_id"), F.col("parent").alias("up_parent"), F.col("hop").alias("up_hop"))
        path = path.where(F.col("hop") > 0).join(up, F.col("parent") == F.col("up_id")).select(F.col("up_id").alias("at"), F.col("up_parent").alias("parent"), F.col("up_hop").alias("hop"), F.concat(F.array("up_id"), "nodes").alias("nodes"))
    return reduce(DataFrame.unionByName, done)


#: (first edge type, second or None, derived edge type, confidence)
RULES = (("manages", "part_of", "works_in", 0.8), ("depends_on", "has_issue", "may_be_affected", 0.6), ("supersedes", None, "outdated", 0.9))


def infer(edges: DataFrame, rules=RULES) -> DataFrame:
    """src, derived, dst, confidence: edges that rules derive from one or two steps, without loops or ones that exist.

    A rule's two sides are filtered by type before they meet, and pairs are distinct before they are compared with
    what exists.
    """
    parts = []
    for first, second, derived, confidence in rules:
        one = edges.where(F.col("edge_type") == first).select("src", F.col("dst").alias("mid"))
        if second is None:
            pairs = one.select("src", F.col("mid").alias("dst"))
        else:
            two = edges.where(F.col("edge_type") == second).select(F.col("src").alias("mid"), "dst")
            pairs = one.join(two, "mid").select("src", "dst")
        parts.append(pairs.where("src <> dst").distinct().select("src", F.lit(derived).alias("derived"), "dst", F.lit(confidence).alias("confidence")))
    found = reduce(DataFrame.unionByName, parts)
    there = edges.select("src", F.col("edge_type").alias("derived"), "dst")
    return found.join(there, ["src", "derived", "dst"], "left_anti")


def co_mentions(mentions: DataFrame, record: str, entity: str, least: int = 2, strong: int = 5) -> DataFrame:
    """a, b, shared, relation of entity pairs (a < b) that at least so many records mention.

    The pairs are those of one record, so the join is by record; entities of a record are made distinct first, and a
    pair's count is a partial aggregate.
    """
    once = mentions.select(F.col(record).alias("r"), F.col(entity).alias("e")).where("r IS NOT NULL AND e IS NOT NULL").distinct()
    often = once.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("e")  # others can't reach `least`
    once = once.join(often, "e", "left_semi")
    lists = once.groupBy("r").agg(F.sort_array(F.collect_set("e")).alias("es")).where(F.size("es") > 1)
    left = lists.select("es", F.posexplode("es").alias("i", "a")).select("a", F.explode(F.slice("es", F.col("i") + 2, F.size("es"))).alias("b"))
    pairs = left.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    return pairs.withColumn("relation", F.when(F.col("shared") >= strong, "strongly_related_to").otherwise("related_to"))


def closed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are among nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, F.col("src") == ids.id, "left_semi").join(ids, F.col("dst") == ids.id, "left_semi")


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is missing from nodes (id)."""
    ids = nodes.select("id").distinct()
    no_src = edges.join(ids, F.col("src") == ids.id, "left_anti")
    no_dst = edges.join(ids, F.col("src") == ids.id, "left_semi").join(ids, F.col("dst") == ids.id, "left_anti")
    return no_src.unionByName(no_dst)


def proximity(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """id, graph_proximity: the share of the other candidates (id) that are neighbours in either direction."""
    ids = candidates.select("id").distinct()
    n = ids.agg((F.count(F.lit(1)) - 1).alias("others"))
    near = hops(edges, "both").where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").distinct()
    counts = near.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("near"))
    got = ids.join(counts, "id", "left").crossJoin(n)  # n is one row
    return got.select("id", F.when(F.col("others") > 0, F.coalesce("near", F.lit(0)) / F.col("others")).otherwise(0.0).alias("graph_proximity"))


def graph_boost(n: Column) -> Column:
    """1 + ln(1 + n) for n neighbours."""
    return 1 + F.log1p(n)


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 10, nodes: DataFrame | None = None, settle_every: int = 5) -> DataFrame:
    """id, rank after so many rounds of power iteration; what nodes without a way out hold is lost, as is each round's (1 - d).

    Edges lie bucketed by src and nodes by id, in as many buckets as shuffles have partitions, so a round moves nothing
    but the shares after their partial aggregation; a node with very many edges in sends a row a task. Parallel edges
    count each.
    """
    links = bucketed(edges.select("src", "dst"), "src", "links")
    ids = (nodes.select("id") if nodes is not None else links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id")))).distinct()
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("fan"))
    ids = bucketed(ids.join(out, F.col("id") == F.col("src"), "left").select("id", "fan"), "id", "nodes")
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    ranks = ids.select("id", "fan", F.lit(1.0 / n).alias("rank"))
    for k in range(1, rounds + 1):
        sent = ranks.where("fan IS NOT NULL").select("id", (F.col("rank") / F.col("fan")).alias("share")).join(links, F.col("id") == F.col("src"))
        got = sent.groupBy(F.col("dst").alias("to")).agg(F.sum("share").alias("got"))
        ranks = ids.join(got, F.col("id") == F.col("to"), "left").select("id", "fan", (F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % settle_every == 0 and k < rounds:
            ranks = settled(ranks, "ranks")
    return ranks.select("id", "rank")


def pagerank_update(edges: DataFrame, ranks: DataFrame, changed: DataFrame, depth: int = 2, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """Ranks after edges changed around some nodes (id): those within depth steps are iterated, the rest stay.

    Where over a fifth of all nodes are affected, everything is computed anew. Rounds go by the ranks of the round before.
    """
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    near = settled(lineage(edges, changed, depth, "both").select("id").join(nodes, "id", "left_semi"), "affected")
    n = nodes.count()
    if not n or near.count() > 0.2 * n:
        return pagerank(edges, damping, rounds)
    fan = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("fan"))
    base = nodes.join(ranks, "id", "left").join(fan, "id", "left").select("id", "fan", F.coalesce("rank", F.lit(1.0 / n)).alias("rank"))
    into = edges.select("src", "dst").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi")
    now = settled(base, "ranks")
    mark = near.withColumn("near", F.lit(True))
    for k in range(1, rounds + 1):
        got = into.join(now.select(F.col("id").alias("src"), (F.col("rank") / F.col("fan")).alias("share")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        now = now.join(mark, "id", "left").join(got, "id", "left").select("id", "fan", F.when(F.col("near"), F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).otherwise(F.col("rank")).alias("rank"))
        if k % 4 == 0:
            now = settled(now, "ranks")
    return now.select("id", "rank")
