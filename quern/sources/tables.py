"""Parquet tables by name, with missing ones told apart from unreadable ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Tables of a folder: tables.orders reads <folder>/orders.parquet when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(self.path(name))
        return self._read[name]


class Catalog:
    """Named tables of a database: typed DataFrames, each with an id column, and what is derived from all of them."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = dict(tables)

    def counts(self) -> DataFrame:
        """table, count: a row for each table that has rows; counting reads no column."""
        parts = [df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("table"), "count") for name, df in sorted(self.tables.items())]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.where(F.col("count") > 0)

    def total(self) -> DataFrame:
        return self.counts().agg(F.coalesce(F.sum("count"), F.lit(0).cast("long")).alias("count"))

    def records(self, *names: str) -> DataFrame:
        """table, id and data (JSON of the other columns) over several tables: the schemaless view."""
        out = None
        for name in names or sorted(self.tables):
            df = self.tables[name]
            fields = [c for c in df.columns if c not in ("id", "created_at", "updated_at")]
            stamp = F.col("created_at") if "created_at" in df.columns else F.lit(None).cast("timestamp_ntz")
            part = df.select(F.lit(name).alias("table"), F.col("id").cast("string").alias("id"), F.to_json(F.struct(*fields)).alias("data"), stamp.alias("created_at"))
            out = part if out is None else out.unionByName(part)
        return out




def inferred_schema(df: DataFrame) -> DataFrame:
    """field, type, count over the top-level fields of JSON data: one pass with a partial aggregate, no driver loop."""
    v = F.expr("try_parse_json(data)")
    keys = df.select(v.alias("v"), F.explode(F.expr("json_object_keys(data)")).alias("field"))
    kind = F.expr("schema_of_variant(try_variant_get(v, concat('$[\"', field, '\"]'), 'variant'))")
    return keys.select("field", kind.alias("type")).groupBy("field", "type").agg(F.count(F.lit(1)).alias("count"))
