"""Conditions on records: seven comparisons, joined by AND, on typed columns or on fields of JSON data.

A missing field makes every comparison false but `!=`, which it makes true. Values of different kinds are never equal
and are ordered null < bool < number < string < array < object.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import QueryError

OPS = ("=", "!=", ">", "<", ">=", "<=", "CONTAINS")
NULL, BOOL, NUMBER, STRING, ARRAY, OBJECT = range(6)


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: object

    def __post_init__(self):
        if self.op not in OPS:
            raise QueryError(f"unknown comparison {self.op!r}")


def kind_of_value(value: object) -> int:
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, int | float):
        return NUMBER
    return ARRAY if isinstance(value, list | tuple) else OBJECT if isinstance(value, dict) else STRING


def kind_of_type(t: T.DataType) -> int:
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, T.NumericType):
        return NUMBER
    if isinstance(t, T.ArrayType):
        return ARRAY
    return OBJECT if isinstance(t, T.StructType | T.MapType) else NULL if isinstance(t, T.NullType) else STRING


def _compare(left: Column, op: str, right: Column) -> Column:
    return {"=": left == right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[op]


def _typed(df: DataFrame, c: Condition) -> Column:
    col, t = F.col(f"`{c.field}`"), df.schema[c.field].dataType
    kind, given = kind_of_type(t), kind_of_value(c.value)
    if c.op == "CONTAINS":
        if kind == STRING and given == STRING:
            return F.coalesce(col.contains(c.value), F.lit(False))
        return F.coalesce(F.array_contains(col, c.value), F.lit(False)) if kind == ARRAY and given == kind_of_type(t.elementType) else F.lit(False)
    if c.value is None:
        return {"=": col.isNull(), "!=": col.isNotNull()}.get(c.op, F.lit(False) if c.op in ("<",) else col.isNotNull() if c.op == ">" else F.lit(c.op in (">=",)))
    if kind != given:
        if c.op in ("=", "!="):
            return F.lit(c.op == "!=")
        return col.isNotNull() if (kind > given) == (c.op in (">", ">=")) else F.lit(False)
    value = F.lit(c.value).cast(t) if isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType) else F.lit(c.value)
    if c.op == "!=":
        return ~F.coalesce(col == value, F.lit(False))
    return F.coalesce(_compare(col, c.op, value), F.lit(False))


def json_field(field: str, data: str = "data") -> Column:
    """A top-level field of a JSON column as a variant; null where it is missing."""
    return F.expr(f"try_variant_get(try_parse_json({data}), '$[\"{_plain(field)}\"]', 'variant')")


def _plain(field: str) -> str:
    if '"' in field or "'" in field or "\\" in field:
        raise QueryError(f"not a field name: {field!r}")
    return field


def variant_kind(v: Column) -> Column:
    """The rank of a variant's kind; null for a missing one."""
    s = F.schema_of_variant(v)
    return F.when(v.isNull(), None).when(s == "VOID", NULL).when(s == "BOOLEAN", BOOL).when(s == "STRING", STRING).when(s.startswith("ARRAY"), ARRAY).when(s.startswith("OBJECT"), OBJECT).otherwise(NUMBER)


def json_number(v: Column) -> Column:
    """The number that a variant is; null for other kinds: strings are not parsed."""
    return F.when(variant_kind(v) == NUMBER, F.try_variant_get(v, "$", "double"))


def _schemaless(c: Condition, data: str) -> Column:
    v, given = json_field(c.field, data), kind_of_value(c.value)
    kind = variant_kind(v)
    text = F.try_variant_get(v, "$", "string")
    if c.op == "CONTAINS":
        inside = F.try_variant_get(v, "$", {NUMBER: "array<double>", BOOL: "array<boolean>"}.get(given, "array<string>"))
        in_array = F.array_contains(inside, float(c.value) if given == NUMBER else c.value) if c.value is not None else F.lit(False)
        in_text = text.contains(c.value) if given == STRING else F.lit(False)
        return F.coalesce(F.when(kind == STRING, in_text).when(kind == ARRAY, in_array), F.lit(False))
    own = {NUMBER: F.try_variant_get(v, "$", "double"), BOOL: F.try_variant_get(v, "$", "boolean")}.get(given, text)
    same = F.lit(c.op in ("=", ">=", "<=", "!=")) if given == NULL else _compare(own, "=" if c.op == "!=" else c.op, F.lit(float(c.value) if given == NUMBER else c.value))
    if c.op in ("=", "!="):
        equal = F.coalesce((kind == given) & same, F.lit(False))
        if given == NUMBER:  # 1 and 1.0 differ in JSON
            whole = F.schema_of_variant(v).isin("BIGINT", "TINYINT", "SMALLINT", "INT")
            equal = equal & F.coalesce(whole == F.lit(isinstance(c.value, int)), F.lit(False))
        return equal if c.op == "=" else ~equal
    above = c.op in (">", ">=")
    return F.coalesce(F.when(kind == given, same).otherwise(kind > given if above else kind < given), F.lit(False))


def predicate(df: DataFrame, c: Condition, data: str = "data") -> Column:
    """The condition as a column of df: on the column of that name, else on a field of the JSON column."""
    if c.field in df.columns:
        return _typed(df, c)
    if data in df.columns:
        return _schemaless(c, data)
    return F.lit(c.op == "!=")


def matching(df: DataFrame, conditions: list[Condition] | tuple[Condition, ...]) -> DataFrame:
    """Rows for which all conditions hold."""
    return df.where(reduce(lambda a, b: a & b, (predicate(df, c) for c in conditions))) if conditions else df
