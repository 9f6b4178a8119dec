"""Fusing ranked lists (id, score): reciprocal ranks of several kinds, weights, chunks, near copies, budgets.

Ranked lists are top-k results, so ranks come from windows over bounded rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunks, simhash, token_estimate

CLASSIC_K = 60


def ranked(hits: DataFrame, source: str, key: str = "id") -> DataFrame:
    """key, score, rank (from 0 by falling score, ties by key), source."""
    order = Window.partitionBy(F.lit(source)).orderBy(F.col("score").desc(), F.col(key).asc())
    return hits.select(key, "score", (F.row_number().over(order) - 1).alias("rank"), F.lit(source).alias("source"))


def union(lists: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, lists)


def rrf(lists: list[DataFrame], k: int = CLASSIC_K, offset: int = 0, weights: dict[str, float] | None = None, key: str = "id") -> DataFrame:
    """key, score: the sum over lists of weight / (k + rank + offset)."""
    weight: Column = F.lit(1.0)
    for source, w in (weights or {}).items():
        weight = F.when(F.col("source") == source, w).otherwise(weight)
    return union(lists).groupBy(key).agg(F.sum(weight / (k + F.col("rank") + offset)).alias("score"), F.min("rank").alias("best_rank"))


def adaptive_k(n: Column, deviation: Column) -> Column:
    """Evenly scored lists count less by rank: 120 under a deviation of 0.05, 20 over 0.3, else in between; 60 of under two."""
    between = F.floor(120 - 100 * (deviation - 0.05) / 0.25)
    return F.when(n < 2, 60).when(deviation < 0.05, 120).when(deviation > 0.3, 20).otherwise(between).cast("int")


def rrf_adaptive(lists: list[DataFrame], key: str = "id") -> DataFrame:
    """key, score: reciprocal ranks with each list's own k."""
    all_ = union(lists)
    ks = all_.groupBy("source").agg(adaptive_k(F.count(F.lit(1)), F.coalesce(F.stddev_pop("score"), F.lit(0.0))).alias("k"))
    return all_.join(ks, "source").groupBy(key).agg(F.sum(1.0 / (F.col("k") + F.col("rank") + 1)).alias("score"), F.min("rank").alias("best_rank"))


def recency_rank(df: DataFrame, time: str, key: str = "id") -> DataFrame:
    """key, score: 1 - place / n, newest first, over a bounded set of candidates."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col(time).desc(), F.col(key).asc())
    everything = Window.partitionBy(F.lit(0))
    return df.select(key, (1 - (F.row_number().over(order) - 1) / F.count(F.lit(1)).over(everything)).alias("score"))


def top(df: DataFrame, k: int, key: str = "id", score: str = "score") -> DataFrame:
    return df.orderBy(F.col(score).desc(), F.col(key).asc()).limit(k)


def federated(members: dict[str, DataFrame], k: int, local: str | None = None, boost: float = 0.1, key: str = "id") -> DataFrame:
    """key, score, member: the best score of a key over members, with its reciprocal rank and more for the local one."""
    parts = [ranked(df, name, key).withColumn("score", F.col("score") + 1.0 / (CLASSIC_K + F.col("rank")) + (boost if name == local else 0.0)) for name, df in members.items()]
    best = union(parts).groupBy(key).agg(F.max("score").alias("score"), F.min_by("source", F.struct(-F.col("score"), "source")).alias("member"))
    return top(best, k, key)


def chunk_rerank(candidates: DataFrame, query: Column, embed_chunks: Column | None = None, alpha: float = 0.7, key: str = "id") -> DataFrame:
    """key, score: alpha of the best chunk's score and the rest of the fused one; candidates have chunk_scores and score."""
    best = F.coalesce(F.array_max("chunk_scores"), F.col("score"))
    return candidates.select(key, (alpha * best + (1 - alpha) * F.col("score")).alias("score"))


def text_chunks(df: DataFrame, key: str, text: str, size: int = 1600, overlap: int = 400) -> DataFrame:
    """key, chunk, content of texts longer than a chunk."""
    long = df.where(F.length(text) > size).select(key, F.posexplode(chunks(F.col(text), size, overlap)).alias("chunk", "content"))
    return long


def collapse_near(hits: DataFrame, text: str, table: str | None = None, bits: int = 3, least: int = 24, key: str = "id", k: int = 1000) -> DataFrame:
    """Of the best k of a result (key, score, text) each row unless a better one of its table is within `bits` of its SimHash.

    Greedy in order of rank: kept rows are folded into an array, of k entries at most.
    """
    own = top(hits, k, key).withColumn("_h", F.when(F.length(text) >= least, simhash(F.col(text)))).withColumn("_t", F.col(table) if table else F.lit(""))
    entry = F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"), F.col("_h").alias("h"), F.col("_t").alias("t"))
    rows = own.groupBy().agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    kind = rows.schema["rows"].dataType.simpleString()

    def keep(acc: Column, x: Column) -> Column:
        near = F.exists(acc, lambda y: (y["t"] == x["t"]) & F.coalesce(F.bit_count(y["h"].bitwiseXOR(x["h"])) <= bits, F.lit(False)))
        return F.when(near, acc).otherwise(F.concat(acc, F.array(x)))

    kept = rows.select(F.explode(F.aggregate("rows", F.array().cast(kind), keep)).alias("x"))
    return hits.join(kept.select(F.col("x.k").alias(key)), key, "left_semi")


def within_budget(hits: DataFrame, text: str, budget: int, key: str = "id") -> DataFrame:
    """Rows by falling score as long as their tokens fit; one that doesn't fit is passed over, later ones may still fit.

    Once a row of n tokens is passed over, so are all later ones of n tokens. So of each n the first budget / n rows
    alone are folded, about budget * ln(budget) in all, however large the result is. Rows of no tokens always fit,
    rows without text never do.
    """
    sized = hits.select(key, "score", token_estimate(F.col(text)).alias("_n")).where(F.col("_n") <= budget)
    place = F.row_number().over(Window.partitionBy("_n").orderBy(F.col("score").desc(), F.col(key).asc()))
    may = sized.where("_n > 0").withColumn("_p", place).where(F.col("_p") <= budget).where(F.col("_p") * F.col("_n") <= budget)
    entry = F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"), F.col("_n").alias("n"))
    rows = may.groupBy().agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    kind = hits.schema[key].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("keys"))

    def add(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["n"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["n"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["keys"], F.array(x["k"]))).otherwise(acc["keys"]).alias("keys"))

    kept = rows.select(F.explode(F.aggregate("rows", start, add)["keys"]).alias(key)).unionByName(sized.where("_n = 0").select(key))
    return hits.join(kept, key, "left_semi")


def widened_k(k: int, kept_ratio: float, pool_ratio: float, gap: float = 0.15) -> int:
    """Half as many more where what is kept compresses much better than the pool: the cut lost variety."""
    return -(-3 * k // 2) if pool_ratio - kept_ratio > gap else k
