"""Scans, points, order, pages, counts and grouped aggregates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import QueryError
from .predicates import NUMBER, json_field, json_number, kind_of_type

FUNCTIONS = ("count", "avg", "min", "max", "sum")


def scan(df: DataFrame, key: str = "id", limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of a table in the order of its key: a top-k per task, never a full sort."""
    return page(df.orderBy(key), limit, offset)


def page(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with that key; no row where there is none. The filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def ordered(df: DataFrame, field: str, ascending: bool = True, key: str = "id") -> DataFrame:
    """By a field, missing values below all others; ties by ascending key in either direction."""
    col = F.col(field) if field in df.columns else json_field(field)
    return df.orderBy(col.asc_nulls_first() if ascending else col.desc_nulls_last(), F.col(key).asc())


def latest(df: DataFrame, time: str, n: int, key: str = "id") -> DataFrame:
    """The n newest rows, newest first."""
    return df.orderBy(F.col(time).desc_nulls_last(), F.col(key).asc()).limit(n)


def best_per_key(df: DataFrame, by: str | list[str], score: Column | str, *ties: str) -> DataFrame:
    """Of the rows of each key the one with the greatest score; ties by the ascending columns.

    A partial aggregate, not a window: a key of any size sends one row a task.
    """
    by = [by] if isinstance(by, str) else list(by)
    rest = [c for c in df.columns if c not in by]
    score = F.col(score) if isinstance(score, str) else score
    tie = [F.struct(*ties)] if ties else []
    if not tie:
        return df.groupBy(*by).agg(F.max_by(F.struct(*rest), score).alias("_best")).select(*by, "_best.*").select(*df.columns)
    low = df.groupBy(*by).agg(F.min(F.struct((-score).alias("_s"), *ties, F.struct(*rest).alias("_row"))).alias("_best"))
    return low.select(*by, "_best._row.*").select(*df.columns)


def latest_per_key(df: DataFrame, by: str | list[str], time: str, key: str) -> DataFrame:
    """Of each key the newest row, of equally new ones that with the greatest id."""
    by = [by] if isinstance(by, str) else list(by)
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(time, key)).alias("_best"))
    return best.select(*by, "_best.*").select(*df.columns)


def union_first_wins(*lists: DataFrame, key: str = "id", order: str = "rank") -> DataFrame:
    """Rows of several lists; of a key that is in several, the row of the first list, there the one of least rank."""
    out = None
    for i, df in enumerate(lists):
        part = df.withColumn("source_order", F.lit(i))
        out = part if out is None else out.unionByName(part)
    rest = [c for c in out.columns if c not in (key, "source_order")]
    first = out.groupBy(key).agg(F.min(F.struct("source_order", order, F.struct(*rest).alias("_row"))).alias("_first"))
    return first.select(key, "_first.source_order", "_first._row.*")


@dataclass(frozen=True)
class Metric:
    function: str
    field: str | None = None

    def __post_init__(self):
        if self.function not in FUNCTIONS:
            raise QueryError(f"unknown aggregate {self.function!r}; there are {', '.join(FUNCTIONS)}")
        if (self.field is None) != (self.function == "count"):
            raise QueryError("count takes no field, other aggregates take one")

    @property
    def name(self) -> str:
        return "count" if self.field is None else f"{self.function}_{self.field}"


def metric(text: str) -> Metric:
    """avg(price) or count, in either case."""
    m = re.fullmatch(r"\s*([A-Za-z]+)\s*(?:\(\s*([^()\s]*)\s*\))?\s*", text)
    if not m:
        raise QueryError(f"not an aggregate: {text!r}")
    return Metric(m[1].lower(), m[2] or None)


def _number(df: DataFrame, field: str) -> Column:
    """A field as a double where it is a number, else null."""
    if field in df.columns:
        return F.col(f"`{field}`").cast("double") if kind_of_type(df.schema[field].dataType) == NUMBER else F.lit(None).cast("double")
    return json_number(json_field(field)) if "data" in df.columns else F.lit(None).cast("double")


def aggregate(df: DataFrame, metrics: list[Metric | str], group_by: str | None = None, include_archived: bool = False, sort: bool = True) -> DataFrame:
    """group, count, <function>_<field>..., skipped for each value of a field, in its order with null first.

    All rows count. Without a field there is one group with a null key, or none over no rows. skipped: rows in
    which a field of some metric isn't a number; an aggregate of no numbers is null. Archived rows don't count.
    Null and missing keys are one group. Functions are partial aggregates, so a group of any size is a row a task.
    """
    wanted = [metric(m) if isinstance(m, str) else m for m in metrics]
    if not include_archived:
        if "_archived" in df.columns:
            df = df.where(~F.coalesce(F.col("_archived"), F.lit(False)))
        elif "data" in df.columns:
            df = df.where(~F.coalesce(F.try_variant_get(json_field("_archived"), "$", "boolean"), F.lit(False)))
    if group_by is None:
        key = F.lit(None).cast("string")
    elif group_by in df.columns:
        key = F.col(f"`{group_by}`")
    elif "data" in df.columns:
        v = json_field(group_by)
        key = F.when(F.try_variant_get(v, "$", "string").isNotNull(), F.to_json(v))
    else:
        key = F.lit(None).cast("string")
    fields = list(dict.fromkeys(m.field for m in wanted if m.field))
    numbers = {f: f"_n{i}" for i, f in enumerate(fields)}
    rows = df.select(key.alias("group"), *(_number(df, f).alias(n) for f, n in numbers.items()))
    any_missing = F.lit(False)
    for n in numbers.values():
        any_missing = any_missing | F.col(n).isNull()
    out = [getattr(F, m.function)(F.col(numbers[m.field])).alias(m.name) for m in dict.fromkeys(wanted) if m.field]
    got = rows.groupBy("group").agg(F.count(F.lit(1)).alias("count"), *out, F.sum(F.when(any_missing, 1).otherwise(0)).cast("long").alias("skipped"))
    return got.orderBy(F.col("group").asc_nulls_first()) if sort else got


def share_of_total(df: DataFrame, by: str) -> DataFrame:
    """by, count, share: how rows are spread over the values of a column."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))
