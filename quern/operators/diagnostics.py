"""The state of a database: counts that disagree, growth, percentiles, tiers and what queries cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(df: DataFrame, value: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99), names: tuple[str, ...] = ("p50", "p95", "p99")) -> DataFrame:
    """The value at round(p * (n - 1)) of the sorted values, exact: a range-partitioned sort, not one task's list.

    Each partition's size gives the global place of its rows, so no window runs over all of them.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    counts = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    sort = counts.repartitionByRange(F.col("v")).withColumn("p", F.spark_partition_id())
    from ..shared import settled

    sort = settled(sort, "percentiles")
    before = sort.groupBy("p").agg(F.sum("n").alias("pn")).withColumn("before", F.sum("pn").over(Window.orderBy("p")) - F.col("pn")).select("p", "before")  # a row a partition
    placed = sort.join(F.broadcast(before), "p").withColumn("last", F.col("before") + F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("first", F.col("last") - F.col("n"))
    both = placed.crossJoin(F.broadcast(total))
    at = [F.round(F.lit(p) * (F.col("total") - 1)) for p in ps]
    return both.agg(*(F.max(F.when((F.col("first") <= k) & (k < F.col("last")), F.col("v"))).alias(n) for k, n in zip(at, names, strict=True)))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """bin, count: how many values lie from each edge up to the next; the last bin has no end. Bins without values are left out."""
    bin_ = F.lit(0)
    for i, e in enumerate(edges[1:], 1):
        bin_ = F.when(F.col(value) >= e, i).otherwise(bin_)
    return df.where(F.col(value).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def query_log_summary(log: DataFrame) -> DataFrame:
    """query_type, queries, tokens, empty: how many of each type, what they served and how many found nothing."""
    return log.groupBy("query_type").agg(F.count(F.lit(1)).alias("queries"), F.sum("tokens_served").alias("tokens"), F.sum((F.col("results_count") == 0).cast("long")).alias("empty"))


def top_terms(log: DataFrame, text: str = "query", n: int = 5, longer_than: int = 2) -> DataFrame:
    terms = log.select(F.explode(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > longer_than)).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "term").limit(n)


def hot_tables(counts: DataFrame, share: float = 0.9, least: int = 100) -> DataFrame:
    """Tables (table, count) that hold over `share` of more than `least` rows."""
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("total", total).where((F.col("total") > least) & (F.col("count") / F.col("total") > share)).select("table", (F.col("count") / F.col("total")).alias("share"))


def growth(sizes: DataFrame, limit_mb: float = 10.0) -> DataFrame:
    """at, mb, mb_per_day, alert from successive sizes (at, mb)."""
    order = Window.orderBy("at")  # one row a measurement
    days = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.lag("at").over(order).cast("timestamp"))) / 86_400_000_000.0
    rate = (F.col("mb") - F.lag("mb").over(order)) / days
    return sizes.withColumn("mb_per_day", rate).withColumn("alert", F.coalesce(F.col("mb_per_day") > limit_mb, F.lit(False)))


def doctor(records: DataFrame, vectors: DataFrame, edges: DataFrame, size_mb: float = 0.0) -> DataFrame:
    """check, problems, ok: records without vectors and vectors without records, edges without ends, repeated ids, wasted space."""
    ids = records.select("id")

    def row(name: str, df: DataFrame, limit: int = 0) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("problems")).select(F.lit(name).alias("check"), "problems", (F.col("problems") <= limit).alias("ok"))

    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    wasted = records.limit(100).agg(F.when((F.count(F.lit(1)) < 100) & F.lit(size_mb > 10), 1).otherwise(0).cast("long").alias("problems"))
    checks = [
        row("repeated_ids", ids.groupBy("id").count().where("count > 1")),
        row("records_without_vector", ids.join(vectors.select("id"), "id", "left_anti")),
        row("vectors_without_record", vectors.select("id").join(ids, "id", "left_anti")),
        row("edge_ends_without_record", ends.join(ids, "id", "left_anti")),
        wasted.select(F.lit("wasted_space").alias("check"), "problems", (F.col("problems") == 0).alias("ok")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def drift(known: DataFrame, found: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """key, state: added, removed or changed between two lists of digests."""
    a, b = known.select(key, F.col(digest).alias("a")), found.select(key, F.col(digest).alias("b"))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where("state IS NOT NULL")


def savings(runs: DataFrame) -> DataFrame:
    """group, before, after, saved of paired token counts (group, before, after)."""
    got = runs.groupBy("group").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    return got.withColumn("saved", F.when(F.col("before") > 0, 1 - F.col("after") / F.col("before")))


def ab(df: DataFrame, variant: str, value: str) -> DataFrame:
    """variant, n, mean, best share: two variants side by side."""
    return df.groupBy(F.col(variant).alias("variant")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))


def live_ratio(df: DataFrame, dead: Column) -> DataFrame:
    return df.agg(F.avg(F.when(F.coalesce(dead, F.lit(False)), 0.0).otherwise(1.0)).alias("live_ratio"))
