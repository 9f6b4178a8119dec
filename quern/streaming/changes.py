"""Changes and events as streams: classification, windows, duplicates, running state; each also over a finished table."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shared import new_path


def event_kind(op: Column, table: Column, doubted: Column, superseded: Column, fix: Column) -> Column:
    """checkpoint_written, belief_revised, decision_superseded, error_fixed, or null for a change that is no event."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when((table == "_checkpoint_records") & (op == "insert"), "checkpoint_written")
        .when((table == "_beliefs") & op.isin("insert", "update") & yes(doubted), "belief_revised")
        .when(yes(superseded), "decision_superseded")
        .when((table == "errors") & (F.coalesce(fix, F.lit("")) != ""), "error_fixed")
    )


def semantic_events(changes: DataFrame) -> DataFrame:
    """change_id, kind, table, record_id of the changes (CHANGES) that mean something to others; works on streams."""
    after = lambda f, t: F.get_json_object("after", f"$.{f}").cast(t)
    doubt = F.coalesce(after("doubted", "boolean"), F.lit(False)) | after("_doubt_reason", "string").isNotNull()
    kind = event_kind(F.col("op"), F.col("table"), doubt, after("_superseded", "boolean"), after("fix", "string"))
    return changes.select("change_id", kind.alias("kind"), "table", "record_id").where("kind IS NOT NULL")


def changes_since(changes: DataFrame, cursor: str | None = None, limit: int | None = None, key: str = "change_id", exclude_agent: str | None = None) -> DataFrame:
    """Changes strictly after a cursor in its order."""
    rows = changes if cursor is None else changes.where(F.col(key) > cursor)
    if exclude_agent is not None:
        rows = rows.where(~F.coalesce(F.col("agent_id") == exclude_agent, F.lit(False)))
    rows = rows.orderBy(key)
    return rows if limit is None else rows.limit(limit)


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as they come, or those whose name is the last part of the path."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else reader.parquet(path)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now and returns what it wrote to the shared folder.

    The offset log and the output are there, so a restarted query goes on where it ended, each row once.
    """
    spark = stream.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"))
    query = writer.option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(stream.schema)
    return found.parquet(out) if mode == "append" else found.option("recursiveFileLookup", "true").parquet(out)


def window_counts(events: DataFrame, time: str, width: str = "1 hour", late: str = "1 day", by: list[str] | None = None) -> DataFrame:
    """bucket, by..., count of tumbling windows; rows later than the watermark are dropped by a stream, never by a table."""
    rows = events.withColumn("_at", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_at", late) if events.isStreaming else rows
    got = rows.groupBy(F.window("_at", width), *(by or [])).agg(F.count(F.lit(1)).alias("count"))
    return got.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), *(by or []), "count")


def session_windows(events: DataFrame, by: str, time: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """by, started_at, ended_at, count of visits that end after a gap (ended_at: the last row's time plus the gap)."""
    rows = events.withColumn("_at", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_at", late) if events.isStreaming else rows
    got = rows.groupBy(F.col(by), F.session_window("_at", gap)).agg(F.count(F.lit(1)).alias("count"))
    return got.select(by, F.col("session_window.start").cast("timestamp_ntz").alias("started_at"), F.col("session_window.end").cast("timestamp_ntz").alias("ended_at"), "count")


def first_within(events: DataFrame, keys: list[str], time: str, window: str = "5 minutes") -> DataFrame:
    """A stream without rows whose keys came within the window before; state is kept for the window alone."""
    rows = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", window)
    return rows.dropDuplicatesWithinWatermark(keys).drop("_at")


def repeats_dropped(rows: DataFrame, keys: list[str], time: str, key: str, seconds: int = 300) -> DataFrame:
    """A table without rows that follow one of equal keys by less than so many seconds: each kept row opens a window anew.

    A row that comes so long after the one before it stays whatever came earlier; between two such rows the next to
    stay is found by jumps over sorted times. One window sorts times and keys of rows (a frequent key spills, and its
    rows stream through one task); nothing is gathered. Rows without a time stay.
    """
    width = seconds * 1_000_000
    order = Window.partitionBy(*keys).orderBy("_t", key)
    timed = rows.select(*dict.fromkeys([*keys, key]), F.unix_micros(F.col(time).cast("timestamp")).alias("_t"))
    opens = F.coalesce(F.col("_t") - F.lag("_t").over(order) >= width, F.lit(True))
    sorted_ = timed.where("_t IS NOT NULL").select(key, "_t", opens.alias("_opens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0
        for batch in batches:
            t, opens = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            ends, kept, i = [*np.flatnonzero(opens).tolist(), len(t)], [], 0
            while i < len(t):
                if opens[i] or t[i] - last >= width:
                    kept.append(i)
                    last = t[i]
                    i += 1
                else:
                    end = ends[bisect.bisect_right(ends, i)]
                    i += int(np.searchsorted(t[i:end], last + width))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64()))], [key])

    kept = sorted_.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}")
    return rows.join(kept.unionByName(rows.where(F.col(time).isNull()).select(key)), key, "left_semi")


def activations(events: DataFrame, key: str, time: str, bump: float = 0.1, cap: float = 10.0, half_life_days: float = 30.0) -> DataFrame:
    """key, activation, last: a counter that halves in 30 days and grows with each access, kept as a stream's state."""
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, last = state.get if state.exists else (0.0, None)
        for t in sorted(x for pdf in batches for x in pdf["_at"]):
            t = t.timestamp()
            if last is not None:
                value *= 0.5 ** (max(0.0, t - last) / 86_400 / half_life_days)
            value, last = min(cap, value + bump), t
        state.update((value, last))
        yield pd.DataFrame({key: [k[0]], "activation": [value], "last": [last]})

    rows = events.select(key, F.col(time).cast("timestamp").alias("_at"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, activation double, last double", "value double, last double", "update", GroupStateTimeout.NoTimeout)


def activations_of(rows: DataFrame, key: str, time: str, now: object, bump: float = 0.1, half_life_days: float = 30.0) -> DataFrame:
    """key, activation at now, over a table: each access decays by its own age, so a sum will do (without the cap)."""
    from ..functions.scoring import age_days

    return rows.groupBy(key).agg(F.sum(bump * F.pow(F.lit(0.5), age_days(time, now) / half_life_days)).alias("activation"))
