"""Time ranges, calendar buckets and downsampling into summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = ("hour", "day", "week", "month")
SUMMARIES = "table string, period string, count long, type string"


def as_time(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp_ntz")


def time_range(df: DataFrame, time: str, start: object = None, end: object = None) -> DataFrame:
    """Rows from start to end, both included; the comparison reaches the scan's statistics."""
    if start is not None:
        df = df.where(F.col(time) >= as_time(start))
    return df if end is None else df.where(F.col(time) <= as_time(end))


def since(df: DataFrame, time: str, seconds: int, now: object) -> DataFrame:
    """Rows of the last seconds up to now."""
    return time_range(df, time, as_time(now) - F.expr(f"interval {int(seconds)} seconds"), now)


def bucket(time: str | Column, unit: str) -> Column:
    """The start of the hour, day, week (from Monday) or month."""
    if unit not in UNITS:
        raise ValueError(f"a bucket is one of {', '.join(UNITS)}")
    return F.date_trunc(unit, F.col(time) if isinstance(time, str) else time).cast("timestamp_ntz")


def bucket_counts(df: DataFrame, time: str, unit: str, start: object = None, end: object = None) -> DataFrame:
    """bucket, count of the buckets that have rows."""
    return time_range(df, time, start, end).groupBy(bucket(time, unit).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def daily_summaries(records: DataFrame, cutoff: object, time: str = "created_at") -> DataFrame:
    """A daily summary (SUMMARIES) of each table and day of the rows before cutoff; system tables are left out."""
    old = records.where((F.col(time) < as_time(cutoff)) & ~F.startswith("table", F.lit("_")))
    day = F.date_format(time, "yyyy-MM-dd").alias("period")
    return old.groupBy("table", day).agg(F.count(F.lit(1)).alias("count")).withColumn("type", F.lit("daily_summary"))


def weekly_summaries(daily: DataFrame) -> DataFrame:
    """Daily counts added up by the Monday of their week."""
    monday = F.date_format(F.date_trunc("week", F.to_date("period")), "yyyy-MM-dd").alias("period")
    return daily.where("type = 'daily_summary'").groupBy("table", monday).agg(F.sum("count").alias("count")).withColumn("type", F.lit("weekly_summary"))


def merge_summaries(old: DataFrame, new: DataFrame, purged: bool) -> DataFrame:
    """Old summaries brought up to date: where both have a period, counts add up if the rows behind the old one were purged, else the new one holds."""
    both = old.unionByName(new) if purged else None
    if both is not None:
        return both.groupBy("table", "period", "type").agg(F.sum("count").alias("count"))
    left = old.withColumnRenamed("count", "old_count")
    return left.join(new, ["table", "period", "type"], "full_outer").select("table", "period", "type", F.coalesce("count", "old_count").alias("count"))


def heal(records: DataFrame, summaries: DataFrame, cutoff: object, purged: bool = False) -> DataFrame:
    """Daily summaries of what is older than cutoff, then weekly ones from all daily summaries."""
    daily = merge_summaries(summaries.where("type = 'daily_summary'"), daily_summaries(records, cutoff), purged)
    return daily.unionByName(weekly_summaries(daily).select(daily.columns))


def trend(df: DataFrame, by: str, time: str, value: str, key: str, alert_below: float = 0.7) -> DataFrame:
    """by, first, last, ratio, alert: the oldest and newest value of each group."""
    at = F.struct(time, key)
    got = df.groupBy(by).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))
    ratio = F.when(F.col("first") != 0, F.col("last") / F.col("first"))
    return got.select(by, "first", "last", ratio.alias("ratio"), F.coalesce(ratio < alert_below, F.lit(False)).alias("alert"))
