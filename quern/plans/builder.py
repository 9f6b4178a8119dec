"""A lazy query: what it asks for is collected step by step and becomes one DataFrame."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import saturated
from ..model import DEFAULT_LIMIT, QueryError
from ..operators import fusion, graph, knn, relational, search, timeseries
from ..operators.predicates import Condition, matching
from ..sources.tables import Catalog
from .parser import Step, parse_path

#: A text hit this good makes the search by vectors needless.
SURE = 0.95


@dataclass
class Database:
    """What queries run on: tables with an id column, edges, vectors (id, vector) and an embedding model.

    text_fields: which fields of a table are searched, all of its strings by default; now: for times relative to it.
    """

    catalog: Catalog
    edges: DataFrame | None = None
    vectors: DataFrame | None = None
    embed: object = None  # text -> vector
    text_fields: dict[str, list[str]] = field(default_factory=dict)
    rerank: object = None  # (query, DataFrame) -> DataFrame
    now: object = None

    def query(self, table: str | None = None) -> Query:
        return Query(self, table)

    def fields_of(self, table: str) -> list[str]:
        if table in self.text_fields:
            return self.text_fields[table]
        return [f.name for f in self.catalog.tables[table].schema.fields if f.dataType.simpleString() == "string" and f.name not in ("id", "table") and not f.name.startswith("_")]

    def vector(self, text: str) -> list[float]:
        if self.embed is None:
            raise QueryError("there is no embedding model to recall by meaning")
        return [float(x) for x in self.embed(text)]


@dataclass(frozen=True)
class Query:
    db: Database
    name: str | None = None
    conditions: tuple[Condition, ...] = ()
    similar: tuple[float, ...] | None = None
    meaning: str | None = None
    top: int = 10
    text: str | None = None
    text_field: str | None = None
    seeds: tuple | None = None
    path: tuple[Step, ...] = ()
    start: object = None
    end: object = None
    time: str = "created_at"
    order: str | None = None
    ascending: bool = True
    most: int | None = DEFAULT_LIMIT
    skip: int = 0
    boosts: tuple[tuple[str, float], ...] = ()

    def table(self, name: str) -> Query:
        return replace(self, name=name)

    def where(self, field_: str, op: str, value: object) -> Query:
        return replace(self, conditions=(*self.conditions, Condition(field_, op, value)))

    def similar_to(self, what: str | list[float], k: int) -> Query:
        return replace(self, meaning=what, top=k) if isinstance(what, str) else replace(self, similar=tuple(what), top=k)

    def search_text(self, text: str, field_: str | None = None) -> Query:
        return replace(self, text=text, text_field=field_)

    def traverse(self, path: str | tuple[Step, ...], seeds: tuple | None = None) -> Query:
        return replace(self, path=parse_path(path) if isinstance(path, str) else path, seeds=seeds)

    def between(self, start: object = None, end: object = None, time: str = "created_at") -> Query:
        return replace(self, start=start, end=end, time=time)

    def order_by(self, field_: str, ascending: bool = True) -> Query:
        return replace(self, order=field_, ascending=ascending)

    def order_by_time(self, ascending: bool = False) -> Query:
        return replace(self, order=self.time, ascending=ascending)

    def limit(self, n: int | None) -> Query:
        return replace(self, most=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def boost(self, signal: str, weight: float) -> Query:
        return replace(self, boosts=(*self.boosts, (signal, weight)))

    def steps(self) -> list[tuple[str, str, str]]:
        """(step, what, cost) in the order in which the DataFrame is built."""
        timed, lists = self.start is not None or self.end is not None, []
        lists += [("text_search", f"{self.text!r} in {self.text_field or 'all fields'}", "medium")] if self.text is not None else []
        lists += [("vector_search", f"best {self.top}", "high")] if self.similar or self.meaning else []
        out = [("scan", self.name or "all tables", "high" if not (timed or lists) else "low")]
        out += [("time_range", f"{self.start} to {self.end}", "low")] if timed else []
        out += [("filter", " AND ".join(f"{c.field} {c.op} {c.value!r}" for c in self.conditions), "low")] if self.conditions and not self.path else []
        out += lists
        out += [("fuse", "reciprocal ranks", "low")] if len(lists) > 1 else []
        out += [("traverse", "".join({"out": "->", "in": "<-", "both": "<->"}[s.direction] + s.edge_type for s in self.path), "medium")] if self.path else []
        out += [("filter", " AND ".join(f"{c.field} {c.op} {c.value!r}" for c in self.conditions), "low")] if self.conditions and self.path else []
        out += [("sort", f"{self.order} {'asc' if self.ascending else 'desc'}", "medium")] if self.order else []
        out += [("page", f"limit {self.most}, offset {self.skip}", "low")] if self.most is not None or self.skip else []
        return out

    def _tables(self) -> list[str]:
        if self.name is not None:
            return [self.name] if self.name in self.db.catalog.tables else []
        return [t for t in sorted(self.db.catalog.tables) if not t.startswith("_")]

    def _rows(self, table: str, conditions: bool = True) -> DataFrame:
        df = self.db.catalog.tables[table]
        if (self.start is not None or self.end is not None) and self.time in df.columns:
            df = timeseries.time_range(df, self.time, self.start, self.end)
        return matching(df, self.conditions) if conditions else df

    def _text_hits(self, table: str) -> DataFrame:
        fields = [self.text_field] if self.text_field else self.db.fields_of(table)
        df = self.db.catalog.tables[table]
        fields = [f for f in fields if f in df.columns]
        if not fields:
            return df.select(F.col("id").cast("string").alias("id"), F.lit(0.0).alias("score")).limit(0)
        if self.text_field:
            got = search.bm25(df, "id", fields[0], self.text).select("id", saturated(F.col("score")).alias("score"))
        else:
            got = search.search_fields(df, "id", fields, self.text).select("id", "score")
        return got.select(F.col("id").cast("string").alias("id"), "score")

    def _hits(self) -> DataFrame | None:
        """id, score from whichever searches were asked for; rows that conditions rule out don't use up places."""
        lists, tables = [], self._tables()
        ids = None
        if self.conditions and not self.path or self.start is not None or self.end is not None:
            for t in tables:
                part = self._rows(t, not self.path).select(F.col("id").cast("string").alias("id"))
                ids = part if ids is None else ids.unionByName(part)
        allowed = lambda df: df if ids is None else df.join(ids, "id", "left_semi")
        if self.text is not None:
            found = None
            for t in tables:
                part = self._text_hits(t)
                found = part if found is None else found.unionByName(part)
            if found is not None:
                lists.append(("text", allowed(found)))
        wanted = list(self.similar) if self.similar else self.db.vector(self.meaning) if self.meaning is not None else None
        if wanted is not None:
            if self.db.vectors is None:
                raise QueryError("there are no vectors to search")
            sure = lists and (best := lists[0][1].agg(F.max("score")).first()[0]) is not None and best > SURE
            if not sure:
                vectors = self.db.vectors.select(F.col("id").cast("string").alias("id"), "vector")
                if self.name is not None:
                    own = self.db.catalog.tables[self.name].select(F.col("id").cast("string").alias("id")) if tables else vectors.select("id").limit(0)
                    vectors = vectors.join(own, "id", "left_semi")
                lists.append(("vector", knn.search(allowed(vectors), "id", "vector", [wanted], self.top).select("id", "score")))
        if not lists:
            return None
        if len(lists) == 1:
            return lists[0][1]
        pool = max(4 * self.top, 4 * (self.most or DEFAULT_LIMIT))
        return fusion.rrf_adaptive([fusion.ranked(fusion.top(df, pool), name) for name, df in lists]).select("id", "score")

    def _records(self, conditions: bool = True) -> DataFrame | None:
        """Rows of the tables asked for, with id as a string; over several tables as schemaless records."""
        tables = self._tables()
        if not tables:
            return None
        if len(tables) == 1:
            df = self._rows(tables[0], conditions)
            return df.withColumn("id", F.col("id").cast("string"))
        return matching(self.db.catalog.records(*tables), self.conditions if conditions else ())

    def frame(self) -> DataFrame:
        """The result. Without an order, search results come by falling score and others by id."""
        spark = next(iter(self.db.catalog.tables.values())).sparkSession
        hits = self._hits()
        if self.path:
            if self.db.edges is None:
                raise QueryError("there are no edges to traverse")
            if self.seeds is not None:
                seeds = spark.range(1).select(F.explode(F.array(*(F.lit(str(s)) for s in self.seeds))).alias("id"))
            elif hits is not None:
                seeds = fusion.top(hits, self.top if self.similar or self.meaning else (self.most or DEFAULT_LIMIT) + self.skip)
            else:
                rows = self._records(False)
                seeds = spark.range(0).select(F.col("id").cast("string")) if rows is None else rows.select("id")
            ends = graph.traverse(self.db.edges.select(F.col("src").cast("string").alias("src"), "edge_type", F.col("dst").cast("string").alias("dst"), *[c for c in ("valid_from", "valid_until") if c in self.db.edges.columns]), seeds, self.path)
            rows = matching(self.db.catalog.records(), self.conditions).join(ends, "id", "left_semi")
        else:
            rows = self._records()
            if rows is None:
                return spark.range(0).select(F.col("id").cast("string"))
            if hits is not None:
                if self.text is None or (self.similar or self.meaning):
                    hits = fusion.top(hits, max(self.top, 0) if self.text is None else max(self.top, self.most or self.top))
                rows = rows.join(hits, "id")
        if self.db.rerank is not None and hits is not None and not self.path:
            rows = self.db.rerank(self.text or self.meaning, rows)
        if self.order:
            rows = relational.ordered(rows, self.order, self.ascending)
        elif hits is not None and not self.path:
            rows = rows.orderBy(F.col("score").desc(), "id")
        else:
            rows = rows.orderBy("id")
        return relational.page(rows, self.most, self.skip)

    def count(self) -> DataFrame:
        return replace(self, most=None).frame().agg(F.count(F.lit(1)).alias("count"))

    def explain(self) -> str:
        df = self.frame()
        plan = df._jdf.queryExecution().simpleString()
        return "\n".join(f"{i}. {s}: {what} [{cost}]" for i, (s, what, cost) in enumerate(self.steps(), 1)) + "\n" + plan

    def profile(self) -> tuple[list, dict]:
        """Rows, and milliseconds of building and of running the plan, with its longest part."""
        began = time.perf_counter()
        df = self.frame()
        built = time.perf_counter()
        rows = df.collect()
        done = time.perf_counter()
        times = {"build_ms": 1000 * (built - began), "run_ms": 1000 * (done - built), "rows": len(rows)}
        return rows, times | {"bottleneck": "run" if times["run_ms"] >= times["build_ms"] else "build"}
