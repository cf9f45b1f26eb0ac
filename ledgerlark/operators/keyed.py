"""Rows by key: duplicates, latest rows, windows of time, sessions, marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import seconds_between


def deduplicated(df: DataFrame, key: str, event_time: str, watermark: str = "10 minutes", order: list[Column] | None = None) -> DataFrame:
    """One row for each key. Streams forget a key one watermark after it; batches keep the first by time, then by ``order``."""
    if df.isStreaming:
        return df.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([key])
    return first_by(df, [key], [F.col(event_time).asc_nulls_last(), *(order or [])])


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__turn", turn).where("__turn = 1").drop("__turn")


def time_windows(df: DataFrame, keys: list[str], event_time: str, length: str, slide: str | None, aggregates: list[Column], watermark: str = "10 minutes") -> DataFrame:
    """window_start, window_end, keys and aggregates over sliding (or, without ``slide``, tumbling) windows."""
    timed = df.withWatermark(event_time, watermark) if df.isStreaming else df
    span = F.window(event_time, length, slide) if slide else F.window(event_time, length)
    grouped = timed.groupBy(span.alias("__span"), *keys).agg(*aggregates)
    rest = [c for c in grouped.columns if c not in ("__span", *keys)]
    return grouped.select(F.col("__span.start").alias("window_start"), F.col("__span.end").alias("window_end"), *keys, *rest)


def merchant_risk_windows(scored: DataFrame, length: str = "5 minutes", slide: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """Volume, distinct users (approximate) and flags of each merchant in sliding windows."""
    usd = F.col("amount_usd").cast("decimal(14,2)")
    made = [
        F.count("*").alias("txn_count"),
        F.sum(usd).cast("decimal(16,2)").alias("total_amount_usd"),
        F.max(usd).cast("decimal(14,2)").alias("max_amount_usd"),
        F.approx_count_distinct("user_key").alias("approx_distinct_users"),
        F.count(F.when(F.col("is_flagged"), F.lit(1))).alias("flagged_count"),
        F.avg("fraud_score").cast("decimal(6,4)").alias("avg_fraud_score"),
    ]
    return time_windows(scored, ["merchant_key"], "event_ts", length, slide, made, watermark)


def marked(df: DataFrame, other: DataFrame, key: str, mark: str) -> DataFrame:
    """``df`` with a boolean: whether ``key`` is in ``other`` (an existence join); no row is dropped or doubled."""
    there = other.select(F.col(key).alias("__key")).where("__key IS NOT NULL").distinct()
    return df.join(there, df[key] == there["__key"], "left").withColumn(mark, F.col("__key").isNotNull()).drop("__key")


def islands(df: DataFrame, keys: list[str], event_time: str, gap_seconds: float, number: str, order: list[Column] | None = None) -> DataFrame:
    """``df`` with the number of the run that each row is in: a run goes on while the gap is at most ``gap_seconds``."""
    turn = Window.partitionBy(*keys).orderBy(event_time, *(order or []))
    gap = seconds_between(F.col(event_time), F.lag(event_time).over(turn))
    return df.withColumn("__new", F.when(gap <= gap_seconds, 0).otherwise(1)).withColumn(number, F.sum("__new").over(turn.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def valid_at(facts: DataFrame, versions: DataFrame, key: str, at: str, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Facts with the columns of the version in force at their time (null if none): from <= at < to, an open end being null.

    The versions of a key are gathered into one sorted array and the last one that has
    begun is taken, so a key with many versions doesn't multiply its facts.
    """
    extra = [c for c in versions.columns if c != key]
    history = versions.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(valid_from).alias("__from"), *extra))).alias("__history"))
    begun = F.filter("__history", lambda v: v["__from"] <= F.col(at))
    last = F.try_element_at(begun, F.lit(-1))
    joined = facts.join(history, key, "left").withColumn("__version", last)
    live = F.when(F.col(f"__version.{valid_to}").isNull() | (F.col(at) < F.col(f"__version.{valid_to}")), F.col("__version"))
    return joined.withColumn("__version", live).select(*facts.columns, *[F.col(f"__version.{c}").alias(c) for c in extra])
