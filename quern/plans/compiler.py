"""Query text to a DataFrame."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import QueryError
from ..operators import relational
from ..operators.predicates import matching
from .builder import Database, Query
from .parser import Query as Tree
from .parser import parse


def _clauses(q: Query, tree: Tree) -> Query:
    c = tree.clauses
    q = replace(q, conditions=c.where, boosts=c.boosts, skip=c.offset)
    if c.table:
        q = q.table(c.table)
    if c.path:
        q = q.traverse(c.path, q.seeds)
    if c.order_by:
        q = q.order_by(c.order_by, c.ascending)
    return q.limit(c.limit) if c.limit is not None else q


def builder(db: Database, tree: Tree) -> Query:
    """The lazy query of a tree that returns records."""
    q = db.query()
    if tree.verb == "RECALL":
        return _clauses(q.similar_to(tree.text, tree.top), tree)
    if tree.verb == "FIND":
        return _clauses(q.search_text(tree.text, tree.in_field), tree)
    if tree.verb == "TRAVERSE":
        known = tree.source in db.catalog.tables
        q = _clauses(q.table(tree.source) if known else q, tree)
        return replace(q, path=(*tree.path, *tree.clauses.path), seeds=None if known else (tree.source,))
    raise QueryError(f"{tree.verb} returns no records to build on")


def compile_(db: Database, tree: Tree) -> DataFrame:
    tables = db.catalog.tables
    spark = next(iter(tables.values())).sparkSession
    if tree.verb == "EXPLAIN":
        inner = tree.explained
        text = builder(db, inner).explain() if inner.verb in ("RECALL", "FIND", "TRAVERSE") else compile_(db, inner)._jdf.queryExecution().simpleString()
        return spark.range(1).select(F.lit(text).alias("plan"))
    if tree.verb == "GET":
        return db.catalog.records().where(F.col("id") == tree.source)
    if tree.verb == "COUNT":
        if tree.source is None and not tree.clauses.where:
            return db.catalog.total()
        if tree.source is not None and tree.source not in tables:
            return spark.range(1).select(F.lit(0).cast("long").alias("count"))
        rows = db.catalog.records() if tree.source is None else tables[tree.source]
        return matching(rows, tree.clauses.where).agg(F.count(F.lit(1)).alias("count"))
    if tree.verb == "AGG":
        if tree.source not in tables:
            raise QueryError(f"there is no table {tree.source!r}")
        return relational.aggregate(matching(tables[tree.source], tree.clauses.where), list(tree.metrics), tree.group_by)
    return builder(db, tree).frame()


def run(db: Database, query: str) -> DataFrame:
    """The result of a query; QueryError where it can't be read."""
    return compile_(db, parse(query))
