"""Moving records: JSON Lines out and in, branches, snapshots, what is shared with others, writes as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGES, RECORDS
from .graph import closed_edges

FORMAT, VERSION = "quern", 1
STRATEGIES = ("branch_wins", "main_wins", "keep_both")


def content_hash(data: Column) -> Column:
    """SHA-256 of a JSON object in canonical form: keys sorted, no blanks."""
    return F.sha2(_canonical(data), 256)


def _canonical(data: Column) -> Column:
    entries = F.array_sort(F.map_entries(F.from_json(data, "map<string,string>")))
    return F.coalesce(F.to_json(entries), data, F.lit(""))


def dropped_fields(data: Column, prefix: str = "_") -> Column:
    """A JSON object without the fields that start with a prefix."""
    fields = F.from_json(data, "map<string,string>")
    return F.to_json(F.map_filter(fields, lambda k, v: ~F.startswith(k, F.lit(prefix))))


def export(records: DataFrame, edges: DataFrame, include_system: bool = False, since: object = None) -> DataFrame:
    """line, place: a header, then records by id, then the edges whose ends both are among them, as JSON objects.

    Index tables (_idx_) never go; other system tables only if asked for.
    """
    own = records.where(~F.startswith("table", F.lit("_idx_")))
    own = own if include_system else own.where(~F.startswith("table", F.lit("_")))
    own = own if since is None else own.where(F.col("updated_at") >= F.lit(since).cast("timestamp_ntz"))
    ends = closed_edges(edges, own)
    head = own.agg(F.count(F.lit(1)).alias("record_count")).crossJoin(ends.agg(F.count(F.lit(1)).alias("edge_count")))  # one row each
    line = lambda kind, cols: F.to_json(F.struct(F.lit(kind).alias("kind"), *cols))
    a = head.select(line("header", [F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("format_version"), F.col("record_count"), F.col("edge_count")]).alias("line"), F.lit(0).alias("part"), F.lit("").alias("place"))
    b = own.select(line("record", [F.col(c) for c in ("table", "id", "data", "created_at", "updated_at", "metadata")]).alias("line"), F.lit(1).alias("part"), F.col("id").alias("place"))
    c = ends.select(line("edge", [F.col("src").alias("from"), F.col("edge_type"), F.col("dst").alias("to"), F.col("props"), F.col("created_at")]).alias("line"), F.lit(2).alias("part"), F.concat_ws(":", "src", "edge_type", "dst").alias("place"))
    return a.unionByName(b).unionByName(c)


def write_export(lines: DataFrame, path: str) -> None:
    """Text files in order: a range-partitioned sort, so no task holds all."""
    lines.orderBy("part", "place").select("line").write.text(path)


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and edges of an export; ValueError where the header isn't one."""
    lines = spark.read.text(path)
    head = lines.where(F.get_json_object("value", "$.kind") == "header").first()
    if head is None or f'"format":"{FORMAT}"' not in head[0]:
        raise ValueError("not an export")
    kind = F.get_json_object("value", "$.kind")
    r = lines.where(kind == "record").select(F.from_json("value", RECORDS).alias("r")).select("r.*")
    e = lines.where(kind == "edge").select(F.from_json("value", "`from` string, edge_type string, `to` string, props string, created_at timestamp_ntz").alias("e"))
    edges = e.select(F.sha2(F.concat_ws("\x00", "e.from", "e.edge_type", "e.to"), 256).alias("id"), F.col("e.from").alias("src"), "e.edge_type", F.col("e.to").alias("dst"), "e.props", "e.created_at", F.lit(None).cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_until"))
    return r, edges


def import_(records: DataFrame, edges: DataFrame, new_records: DataFrame, new_edges: DataFrame, dedup: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records and edges after an import: ids stay; with dedup, records whose table and content are known are not added and edges point to what was known.

    Edges that are there already or lack an end are skipped.
    """
    fresh = new_records.join(records.select("id"), "id", "left_anti")
    if dedup:
        known = records.select("table", content_hash(F.col("data")).alias("h"), F.col("id").alias("same")).groupBy("table", "h").agg(F.min("same").alias("same"))
        hashed = fresh.withColumn("h", content_hash(F.col("data"))).join(known, ["table", "h"], "left")
        first = hashed.where("same IS NULL").groupBy("table", "h").agg(F.min("id").alias("first"))
        placed = hashed.join(first, ["table", "h"], "left").withColumn("goes_to", F.coalesce("same", "first", "id"))
        moved = placed.where("goes_to <> id").select(F.col("id").alias("old"), "goes_to")
        fresh = placed.where("goes_to = id").select(*records.columns)
        for end in ("src", "dst"):
            new_edges = new_edges.join(moved.withColumnRenamed("old", end), end, "left").withColumn(end, F.coalesce("goes_to", end)).drop("goes_to")
    all_ = records.unionByName(fresh.select(*records.columns))
    kept = closed_edges(new_edges.dropDuplicates(["src", "edge_type", "dst"]), all_).join(edges.select("src", "edge_type", "dst"), ["src", "edge_type", "dst"], "left_anti")
    return all_, edges.unionByName(kept.select(*edges.columns))


def branch_diff(main: DataFrame, branch: DataFrame) -> DataFrame:
    """table, main_count, branch_count, delta of the tables whose counts differ."""
    count = lambda df, n: df.groupBy("table").agg(F.count(F.lit(1)).alias(n))
    both = count(main, "main_count").join(count(branch, "branch_count"), "table", "full_outer").fillna(0, ["main_count", "branch_count"])
    return both.withColumn("delta", F.col("branch_count") - F.col("main_count")).where("delta <> 0")


def merge_branch(main: DataFrame, branch: DataFrame, strategy: str = "branch_wins") -> DataFrame:
    """Records after a merge. What main lacks is added; equal records stay; of others the strategy decides, keep_both adds the branch's under a new id.

    Records that only main has stay as they are.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"a strategy is one of {', '.join(STRATEGIES)}")
    new = branch.join(main.select("id"), "id", "left_anti")
    if strategy == "main_wins":
        return main.unionByName(new)
    same = main.select("id", F.col("data").alias("m_data"), F.col("updated_at").alias("m_at"))
    changed = branch.join(same, "id").where(~(F.col("data").eqNullSafe(F.col("m_data")) & F.col("updated_at").eqNullSafe(F.col("m_at")))).select(*branch.columns)
    if strategy == "branch_wins":
        return main.join(changed.select("id"), "id", "left_anti").unionByName(changed).unionByName(new)
    copies = changed.withColumn("id", F.upper(F.substring(F.sha2(F.concat_ws("\x00", "id", "data", F.col("updated_at").cast("string")), 256), 1, 26)))
    return main.unionByName(copies).unionByName(new)


def snapshot(df: DataFrame, path: str) -> None:
    """A version of a table: its own folder, never written twice."""
    df.write.mode("errorifexists").parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def shared_selection(records: DataFrame, tables: list[str], least: float = 0.1) -> DataFrame:
    """op_id, table, id, data: what is worth sending to others, without private fields."""
    weight = F.coalesce(F.get_json_object("data", "$._importance").cast("double"), F.lit(0.5))
    chosen = records.where(F.col("table").isin(tables) & (weight >= least)).withColumn("data", dropped_fields(F.col("data")))
    return chosen.select(F.sha2(F.concat_ws("\x00", "table", "id", _canonical(F.col("data"))), 256).alias("op_id"), "table", "id", "data")


def upsert(df: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """df with new rows in place of those with their keys."""
    return df.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def delete_cascade(records: DataFrame, edges: DataFrame, vectors: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, edges and vectors without some records and whatever hangs on them."""
    gone = ids.select("id").distinct()
    left = edges.join(gone, F.col("src") == gone.id, "left_anti").join(gone, F.col("dst") == gone.id, "left_anti")
    return delete(records, gone), left, delete(vectors, gone)


def relate(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new.select(*edges.columns))


def unrelate(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "edge_type", "dst"), ["src", "edge_type", "dst"], "left_anti")


def replay(main: DataFrame, changes: DataFrame) -> DataFrame:
    """Records after a list of changes (CHANGES): of each record the last change holds."""
    last = changes.groupBy("record_id").agg(F.max_by(F.struct("op", "table", "after", "created_at"), "change_id").alias("c"), F.min("created_at").alias("first_at"))
    alive = last.where("c.op <> 'delete'").select(F.col("record_id").alias("id"), F.col("c.table").alias("table"), F.col("c.after").alias("data"), F.col("first_at").alias("created_at"), F.col("c.created_at").alias("updated_at"), F.lit(None).cast("string").alias("metadata"))
    return main.join(last.select(F.col("record_id").alias("id")), "id", "left_anti").unionByName(alive.select(*main.columns))


def sealed(column: Column, key: str) -> Column:
    """Encrypted with AES-GCM, as text."""
    return F.base64(F.aes_encrypt(column, F.lit(key), F.lit("GCM")))


def opened(column: Column, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(column), F.lit(key), F.lit("GCM")).cast("string")


EDGE_COLUMNS = [f.split()[0] for f in EDGES.split(", ")]
