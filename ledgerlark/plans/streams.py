"""Queries that run the streaming operators over replayed files; each is compared with its batch twin's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import count_if
from ..operators.keyed import deduplicated, time_windows
from ..scratch import scratch
from ..sources.tables import Upsert, Warehouse
from ..streaming.card_state import stateful_features
from .contracts import TRANSACTION
from .flows import FEATURES
from .star import SWIPES, query, swipes, table


def _replayed(df: DataFrame, name: str, files: int = 4) -> DataFrame:
    """``df`` written as files in order of time, and read back as a stream of them.

    A range partition by time makes the files; one at a time is then a micro-batch.
    """
    spark = df.sparkSession
    folder = scratch(spark, name)
    timed = df.withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    for k in range(files):
        timed.where(F.pmod(F.xxhash64("transaction_id"), F.lit(files)) == k).write.mode("append").parquet(folder)
    return spark.readStream.schema(timed.schema).parquet(folder)


def _finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives, run to the end of its input, as a batch table."""
    spark = stream.sparkSession
    out, checkpoint = scratch(spark, name), scratch(spark, f"{name}-checkpoint")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT event_id AS transaction_id, user_id, ts AS event_ts FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which some arrive twice, through the streaming deduplication."""
    e = swipes(spark, sf_dir).select("transaction_id", "user_id", "event_ts")
    twice = _replayed(e.unionByName(e.where("transaction_id % 7 = 0")), "dedup-in", 1)
    done = _finished(deduplicated(twice, "transaction_id", "event_ts", "40 days"), "dedup-out")
    return done.withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


@query(f"""WITH {SWIPES}, w AS (SELECT merchant_key, unnest(generate_series(date_trunc('hour', event_ts) - INTERVAL 4 HOUR, date_trunc('hour', event_ts), INTERVAL 1 HOUR)) AS window_start, amount_usd, is_flagged FROM swipes) SELECT window_start, merchant_key, count(*) AS n, CAST(sum(amount_usd) AS DOUBLE) AS usd, count(*) FILTER (WHERE is_flagged) AS flagged FROM w GROUP BY ALL""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows in update mode, upserted into a keyed table: the last update of each window stays."""
    e = swipes(spark, sf_dir).select("transaction_id", "merchant_key", "event_ts", "amount_usd", "is_flagged")
    made = time_windows(_replayed(e, "windows-in"), ["merchant_key"], "event_ts", "5 hours", "1 hour", [F.count("*").alias("n"), F.sum("amount_usd").cast("double").alias("usd"), count_if(F.col("is_flagged")).alias("flagged")], "40 days").drop("window_end")
    warehouse = Warehouse(spark, scratch(spark, "windows-out"))
    spec = Upsert("windows", ("window_start", "merchant_key", "n", "usd", "flagged"), ("window_start", "merchant_key"), ("n", "usd", "flagged"), day="window_start")
    q = made.writeStream.outputMode("update").option("checkpointLocation", scratch(spark, "windows-checkpoint")).foreachBatch(lambda df, _: warehouse.upsert(df, spec)).trigger(availableNow=True).start()
    q.awaitTermination()
    return warehouse.read("windows").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(14,2))) AS DOUBLE) AS usd FROM events GROUP BY 1")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exactly-once append of a stream to a table, then a batch aggregate over it."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("transaction_id"), F.col("ts").alias("event_ts"), "event_type", "value")
    done = _finished(_replayed(e, "totals-in"), "totals-out")
    return done.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(14,2)")).cast("double").alias("usd"))


def _in_order(df: DataFrame, name: str, files: int) -> DataFrame:
    """``df`` as a stream of ``files`` micro-batches by time."""
    spark, folder = df.sparkSession, scratch(df.sparkSession, name)
    at = F.unix_micros("event_ts")
    first, last = df.agg(F.min(at), F.max(at)).first()
    if first is not None:
        part = F.least(F.floor((at - first) * files / (last - first + 1)), F.lit(files - 1))
        for k in range(files):
            df.where(part == k).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


_MINUTES = FEATURES.replace("21599999", "59999").replace("86399999", "299999")


@query(f"""WITH {SWIPES}, {_MINUTES} SELECT transaction_id, CAST(c1 AS BIGINT) AS n_1m, CAST(c5 AS BIGINT) AS n_5m, round(CAST(usd5 AS DOUBLE), 2) AS usd_5m, CAST(m5 AS BIGINT) AS merchants_5m, CAST(s5 AS BIGINT) AS small_5m, secs AS seconds_since_prev, round(km, 3) AS km_from_prev, round(km / (greatest(secs, 60) / 3600), 3) AS implied_speed_kmh, round(z, 6) AS amount_zscore, CAST(n AS BIGINT) AS history_count FROM feats""")
def stream_card_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful operator over four micro-batches: a card's state goes from each to the next."""
    made = {"transaction_id": F.col("transaction_id").cast("string"), "event_ts": F.col("event_ts").cast("timestamp"), "event_date": F.to_date("event_ts"), "user_id": F.col("user_id").cast("string"), "merchant_id": F.col("merchant_key").cast("string"), "amount": F.col("amount_usd"), "amount_usd": F.col("amount_usd"), "location_lat": F.col("lat"), "location_lon": F.col("lon")}
    silver = swipes(spark, sf_dir).select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TRANSACTION])
    done = _finished(stateful_features(_in_order(silver, "cards-in", 4), 400 * 86_400_000, "400 days"), "cards-out")
    c = F.col
    whole = {"n_1m": "txn_count_1m", "n_5m": "txn_count_5m", "merchants_5m": "distinct_merchants_5m", "small_5m": "small_txn_count_5m"}
    return done.select(c("transaction_id").cast("long").alias("transaction_id"), *[c(x).cast("long").alias(n) for n, x in whole.items()], F.round("amount_usd_5m", 2).alias("usd_5m"), "seconds_since_prev", F.round("km_from_prev", 3).alias("km_from_prev"), F.round("implied_speed_kmh", 3).alias("implied_speed_kmh"), F.round("amount_zscore", 6).alias("amount_zscore"), "history_count")
