"""Questions in plain words: an intent picks one or several ways of search, whose lists are fused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.queries import intent, parse_temporal
from ..functions.scoring import temporal_boost
from ..functions.text import query_keywords
from ..operators import fusion
from .builder import Database

#: Which searches an intent leads to, in order.
WAYS = {"text": ("text",), "causality": ("text", "vector"), "graph": ("text", "graph"), "temporal": ("time", "text"), "rules": ("text",), "vector": ("vector",), "combined": ("text", "vector")}
#: Where each intent looks first, if there is such a table.
TABLES = {"causality": "decisions", "rules": "rules"}


@dataclass(frozen=True)
class Plan:
    intent: str
    ways: tuple[str, ...]
    table: str | None
    words: str


def plan(db: Database, question: str) -> Plan:
    kind = intent(question)
    ways = tuple(w for w in WAYS[kind] if (w != "vector" or (db.vectors is not None and db.embed is not None)) and (w != "graph" or db.edges is not None)) or ("text",)
    table = TABLES.get(kind)
    return Plan(kind, ways, table if table in db.catalog.tables else None, " ".join(query_keywords(question)) or question)


def ask(db: Database, question: str, k: int = 10) -> DataFrame:
    """id, score over all ways of the plan: reciprocal ranks with k = 60, ties by id, rounded to 4 places."""
    p, lists = plan(db, question), []
    q = db.query(p.table).limit(None)
    when = parse_temporal(question, db.now) if db.now is not None else None
    words = " ".join(query_keywords(when[1])) or p.words if when else p.words
    text = q.search_text(words)
    for way in p.ways:
        if way == "text":
            hits = text.frame().select("id", "score")
        elif way == "vector":
            hits = q.similar_to(question, 5 * k).frame().select("id", "score")
        elif way == "graph":
            seeds = fusion.top(text.frame().select("id", "score"), k)
            both = db.edges.select(F.col("src").cast("string").alias("id"), F.col("dst").cast("string").alias("to")).unionByName(db.edges.select(F.col("dst").cast("string").alias("id"), F.col("src").cast("string").alias("to")))
            hits = seeds.join(both, "id").groupBy(F.col("to").alias("id")).agg(F.max("score").alias("score"))
        elif when:
            rows = db.catalog.records(*([p.table] if p.table else []))
            hits = rows.where(F.col("created_at").isNotNull()).select("id", temporal_boost("created_at", when[0].target.replace(tzinfo=None), when[0].window_days).alias("score")).where("score > 0")
        else:
            continue
        lists.append(fusion.ranked(fusion.top(hits, 5 * k), way))
    fused = fusion.rrf(lists, 60, 1).select("id", F.round("score", 4).alias("score"))
    return fusion.top(fused, k)
