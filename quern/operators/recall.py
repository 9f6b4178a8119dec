"""Retrieval by several signals: candidates from vectors and words, one weighted score, and why it is what it is."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.queries import PLAIN, TemporalTarget, class_of
from ..functions.scoring import at, feedback_boost, recency_decay, saturated, temporal_boost
from ..functions.text import keyword_overlap, query_keywords
from . import fusion, graph, knn, search


@dataclass(frozen=True)
class Weights:
    vector: float = 0.40
    recency: float = 0.15
    graph: float = 0.15
    keyword: float = 0.10
    feedback: float = 0.05
    temporal: float = 0.10
    preference: float = 0.05
    activation: float = 0.0
    importance: float = 0.0
    rrf: float = 0.0


@dataclass(frozen=True)
class Recall:
    """What a recall asks for; now is given, so that results can be repeated."""

    query: str
    now: object
    k: int = 10
    weights: Weights = field(default_factory=Weights)
    target: TemporalTarget | None = None
    scopes: tuple[str, ...] = ()
    least_confidence: float | None = None
    least_importance: float | None = None
    half_life_hours: float = 168.0


def candidates(vector_hits: DataFrame, text_hits: DataFrame) -> DataFrame:
    """id, vector_similarity, keyword, best_rank, fts_rank, rrf from two ranked lists."""
    both = vector_hits.select("id", F.col("score").alias("v"), F.lit(None).cast("double").alias("t"), "rank", F.lit(None).cast("int").alias("fts_rank")).unionByName(text_hits.select("id", F.lit(None).cast("double").alias("v"), F.col("score").alias("t"), "rank", F.col("rank").alias("fts_rank")))
    return both.groupBy("id").agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("vector_similarity"), F.coalesce(F.max("t"), F.lit(0.0)).alias("keyword"), F.min("rank").alias("best_rank"), F.min("fts_rank").alias("fts_rank"), F.sum(1.0 / (fusion.CLASSIC_K + F.col("rank"))).alias("rrf"))


def allowed(records: DataFrame, scopes: tuple[str, ...] = (), least_confidence: float | None = None, least_importance: float | None = None) -> DataFrame:
    """Records in scope (project where none is given) with confidence and importance (0.5 where not given) over a floor."""
    has = set(records.columns)
    value = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in has else F.lit(d)
    if scopes:
        records = records.where(value("_scope", "project").isin(*scopes))
    if least_confidence is not None:
        records = records.where(value("_confidence", 0.5) >= least_confidence)
    return records if least_importance is None else records.where(value("_importance", 0.5) >= least_importance)


def fused(records: DataFrame, found: DataFrame, ask: Recall, edges: DataFrame | None = None, feedback: DataFrame | None = None, text: str = "text", time: str = "created_at") -> DataFrame:
    """id, score, signals, summary of the k best candidates.

    found: as candidates() gives it; records: id, text, time and whatever filters look at. The filter comes before the
    cut, so k rows come back where there are as many. feedback: id, feedback (0 to 1). Ties are broken by id.
    """
    w = ask.weights
    pool = allowed(records, ask.scopes, ask.least_confidence, ask.least_importance).join(found, "id")
    if edges is not None:
        pool = pool.join(graph.proximity(edges, found.select("id")), "id", "left")
    if feedback is not None:
        pool = pool.join(feedback.select("id", "feedback"), "id", "left")
    has = set(pool.columns)
    num = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in has else F.lit(0.0)
    signals = {
        "vector_similarity": (w.vector, F.col("vector_similarity")),
        "recency": (w.recency, recency_decay(time, ask.now, ask.half_life_hours)),
        "graph_proximity": (w.graph, num("graph_proximity")),
        "keyword_match": (w.keyword, F.greatest(F.col("keyword"), keyword_overlap(F.col(text), query_keywords(ask.query)))),
        "feedback_boost": (w.feedback, num("feedback")),
        "temporal_proximity": (w.temporal, temporal_boost(time, ask.target.target, ask.target.window_days) if ask.target else F.lit(0.0)),
        "preference_match": (w.preference, F.lit(0.0)),
        "activation": (w.activation, num("activation")),
        "importance": (w.importance, F.coalesce(F.col("_importance"), F.lit(0.5)) if "_importance" in has else F.lit(0.5)),
        "rrf": (w.rrf, F.col("rrf")),
    }
    score = F.lit(0.0)
    for weight, value in signals.values():
        if weight:
            score = score + weight * value
    if class_of(ask.query) != PLAIN:  # an identifier is meant literally: the text index's order counts more
        score = score + F.coalesce(1.0 / (10 + F.col("fts_rank")), F.lit(0.0))
    shown = [(n, v) for n, (weight, v) in signals.items() if weight]
    entries = F.filter(F.array(*(F.struct(F.lit(n).alias("signal"), v.cast("double").alias("value")) for n, v in shown)), lambda s: (s["value"] > 0) | s["signal"].isin("vector_similarity", "recency"))
    scored = pool.select("id", score.alias("score"), entries.alias("signals"))
    best = F.array_max(F.transform("signals", lambda s: F.struct(s["value"].alias("value"), s["signal"].alias("signal"))))["signal"]
    return fusion.top(scored, ask.k).withColumn("summary", F.concat(F.lit("mostly "), best))


def recall(records: DataFrame, vectors: DataFrame, ask: Recall, query_vector: list[float], edges: DataFrame | None = None, feedback: DataFrame | None = None, text: str = "text", time: str = "created_at") -> DataFrame:
    """The whole retrieval: nearest vectors and best texts, merged, filtered, scored and cut."""
    pool = max(8 * ask.k, 40) * 2
    near = fusion.ranked(knn.search(vectors, "id", "vector", [query_vector], pool).select("id", "score"), "vector")
    hits = search.bm25(records, "id", text, " ".join(query_keywords(ask.query)) or ask.query).select("id", saturated(F.col("score")).alias("score"))
    found = candidates(near, fusion.ranked(fusion.top(hits, pool), "text"))
    return fused(records, found, ask, edges, feedback, text, time)


def feedback_signal(entries: DataFrame, query_vector: list[float], now: object) -> DataFrame:
    """id, feedback from earlier marks (query_embedding, record_id, count, last_used)."""
    from ..functions.vectors import cosine

    sim = cosine(F.col("query_embedding"), F.array(*(F.lit(float(x)) for x in query_vector)))
    days = (F.unix_micros(at(now).cast("timestamp")) - F.unix_micros(F.col("last_used").cast("timestamp"))) / 86_400_000_000.0
    return entries.groupBy(F.col("record_id").alias("id")).agg(F.least(F.lit(1.0), F.sum(feedback_boost(sim, days, F.col("count")))).alias("feedback"))


#: How much similarity counts against freshness for each type of memory.
ALPHA = {"working": 0.3, "semantic": 0.8, "episodic": 0.5, "procedural": 0.7, "preference": 0.9}


def memory_blend(similarity: Column, days: Column, kind: str) -> Column:
    a = ALPHA[kind]
    return a * similarity + (1 - a) * F.greatest(F.lit(0.0), 1 - days / 30.0)


def remember(pools: dict[str, DataFrame], k: int, budget: int | None = None) -> DataFrame:
    """id, memory_type, score over all types of memory: the best k, as far as their texts (text) fit a budget of tokens.

    pools: id, similarity, days, text of each type.
    """
    parts = [fusion.top(df.select("id", F.lit(kind).alias("memory_type"), memory_blend(F.col("similarity"), F.col("days"), kind).alias("score"), "text"), k) for kind, df in pools.items()]
    best = fusion.top(fusion.union(parts), k)
    return best if budget is None else fusion.within_budget(best, "text", budget)


def identifier_parts(text: Column) -> Column:
    """The distinct lower-cased parts of the identifiers in a text."""
    from ..functions.text import code_tokens

    return F.array_distinct(code_tokens(F.coalesce(text, F.lit(""))))


def expansions(query: str, synonyms: dict[str, str] | None = None) -> list[str]:
    """The query, its words as one identifier, and its words with synonyms."""
    words = query.split()
    out = [query]
    if len(words) > 1:
        out.append("".join(w[:1].upper() + w[1:] for w in words))
    swapped = " ".join((synonyms or {}).get(w.lower(), w) for w in words)
    return list(dict.fromkeys([*out, swapped]))


def code_search(df: DataFrame, query: str, k: int, path: str = "path", symbol: str | None = None, text: str = "text", key: str = "id", synonyms: dict[str, str] | None = None) -> DataFrame:
    """key, score: reciprocal ranks of the query and its expansions, more where path or symbol name what is asked for."""
    pool, lists, weights = max(5 * k, 40), [], {}
    for i, q in enumerate(expansions(query, synonyms)):
        name = f"q{i}"
        lists.append(fusion.ranked(fusion.top(search.bm25(df, key, text, q), pool, key), name, key))
        weights[name] = 1.0 if i == 0 else 0.6
    fused_ = fusion.rrf(lists, 60, 1, weights, key).select(key, F.col("score").alias("_rrf"))
    names = [path, *([symbol] if symbol else [])]
    terms = sorted({t for t in (p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+[0-9]*|[0-9]+", query)) if len(t) >= 3})
    rows = df.select(key, *names).join(fused_, key)
    q = query.strip().lower()
    exact, token = F.lit(False), F.lit(False)
    for c in names:
        low = F.lower(F.coalesce(F.col(c), F.lit("")))
        exact = exact | (low == q)
        token = token | F.array_contains(F.split(low, r"[^a-z0-9_]+"), q)
    own = F.array_distinct(F.flatten(F.array(*(identifier_parts(F.col(c)) for c in names))))
    matched = F.size(F.array_intersect(own, F.array(*map(F.lit, terms)))) if terms else F.lit(0)
    score = F.col("_rrf") + F.when(exact, 0.10).otherwise(0.0) + F.least(0.045 * matched, F.lit(0.18)) + F.when(token & ~exact & F.lit(len(q) >= 4), 0.05).otherwise(0.0)
    return fusion.top(rows.select(key, score.alias("score")), k, key)


def cached_answer(cache: DataFrame, query_vector: list[float], now: object, least: float = 0.92) -> DataFrame:
    """id, score of the nearest live entry of an answer cache (id, vector, expires_at, stale), if it is near enough."""
    live = cache.where((F.col("expires_at").isNull() | (F.col("expires_at") > at(now))) & ~F.coalesce(F.col("stale"), F.lit(False)))
    return knn.search(live, "id", "vector", [query_vector], 1, least).select("id", "score")


def signal_names() -> list[str]:
    return [f.name for f in fields(Weights)]
