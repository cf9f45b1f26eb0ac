"""Dashboard queries and telemetry reports. The look-back and bucket are parameters; the registered ones use days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, percent, ratio, time_bucket
from ..operators.keyed import first_by
from .kpis import HITS, SLIDES, _reasons, _slides
from .star import DISPUTES, FACT, LABELLED, REASONS, SWIPES, TELEMETRY, back, chargebacks, labelled, lines, newest, query, swipes, table, telemetry

_D = "double"
#: Look-backs of the dashboard with their buckets.
TIME_WINDOWS = (("15 minutes", "1 minute"), ("1 hour", "5 minutes"), ("6 hours", "30 minutes"), ("24 hours", "1 hour"))


@query(f"""WITH {FACT}, {DISPUTES}, {REASONS}, t AS (SELECT count(*) AS txn_count, CAST(coalesce(sum(amount_usd), 0) AS DOUBLE) AS volume_usd, count(*) FILTER (WHERE is_flagged) AS alert_count, CAST(coalesce(sum(amount_usd) FILTER (WHERE is_flagged), 0) AS DOUBLE) AS flagged_usd FROM fact, now WHERE event_ts >= t0 - INTERVAL 90 DAY),
c AS (SELECT count(*) FILTER (WHERE is_fraud) AS fraud_chargebacks, CAST(coalesce(sum(amount_usd) FILTER (WHERE is_fraud), 0) AS DOUBLE) AS fraud_chargeback_usd FROM cb JOIN reasons USING (reason_code), now WHERE reported_ts >= t0 - INTERVAL 90 DAY)
SELECT t.*, c.*, CASE WHEN txn_count > 0 THEN alert_count / txn_count END AS alert_rate FROM t, c""")
def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of transactions and chargebacks; two one-row aggregates side by side."""
    at = newest(spark, sf_dir)
    usd, flagged = F.col("amount_usd"), F.col("is_flagged")
    t = lines(spark, sf_dir).where(F.col("event_ts") >= back(at, days=90)).agg(F.count("*").alias("txn_count"), F.coalesce(F.sum(usd), F.lit(0)).cast(_D).alias("volume_usd"), count_if(flagged).alias("alert_count"), F.coalesce(F.sum(F.when(flagged, usd)), F.lit(0)).cast(_D).alias("flagged_usd"))
    fraud = F.col("reason_code").startswith("10.")
    c = chargebacks(spark, sf_dir).where(F.col("reported_ts") >= back(at, days=90)).agg(count_if(fraud).alias("fraud_chargebacks"), F.coalesce(F.sum(F.when(fraud, usd)), F.lit(0)).cast(_D).alias("fraud_chargeback_usd"))
    return t.crossJoin(F.broadcast(c)).withColumn("alert_rate", ratio(F.col("alert_count"), F.col("txn_count")))


@query(f"""WITH {TELEMETRY} SELECT coalesce(sum(num_input_rows), 0) / 3600.0::DOUBLE AS events_per_second FROM progress, now WHERE query_name = 'bronze_transactions' AND progress_ts >= t0 - INTERVAL 1 HOUR""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = newest(spark, sf_dir, "events", "ts")
    p = telemetry(spark, sf_dir).where((F.col("query_name") == "bronze_transactions") & (F.col("progress_ts") >= back(at, hours=1)))
    return p.agg((F.coalesce(F.sum("num_input_rows"), F.lit(0)) / F.lit(3600.0)).alias("events_per_second"))


def _cont(q: float, by: str = "batch_duration_ms", where: str | None = None):
    return F.expr(f"percentile_cont({q}) WITHIN GROUP (ORDER BY {by})" + (f" FILTER (WHERE {where})" if where else ""))


@query(f"""WITH {TELEMETRY} SELECT count(*) AS sample_rows, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY load_seconds), 4) AS p50_s, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY load_seconds), 4) AS p95_s FROM progress, now WHERE progress_ts >= t0 - INTERVAL 12 HOUR""")
def end_to_end_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = newest(spark, sf_dir, "events", "ts")
    return telemetry(spark, sf_dir).where(F.col("progress_ts") >= back(at, hours=12)).agg(F.count("*").alias("sample_rows"), F.round(_cont(0.5, "load_seconds"), 4).alias("p50_s"), F.round(_cont(0.95, "load_seconds"), 4).alias("p95_s"))


@query(f"""WITH {TELEMETRY} SELECT round(percentile_cont(0.5) WITHIN GROUP (ORDER BY batch_duration_ms) / 1000.0::DOUBLE, 6) AS p50_s, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY batch_duration_ms) / 1000.0::DOUBLE, 6) AS p95_s, count(*) AS batches FROM progress, now WHERE query_name = 'gold_transactions' AND num_input_rows > 0 AND progress_ts >= t0 - INTERVAL 24 HOUR""")
def micro_batch_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = newest(spark, sf_dir, "events", "ts")
    p = telemetry(spark, sf_dir).where((F.col("query_name") == "gold_transactions") & (F.col("num_input_rows") > 0) & (F.col("progress_ts") >= back(at, hours=24)))
    return p.agg(F.round(_cont(0.5) / F.lit(1000.0), 6).alias("p50_s"), F.round(_cont(0.95) / F.lit(1000.0), 6).alias("p95_s"), F.count("*").alias("batches"))


@query(f"""WITH {SWIPES}, b AS (SELECT unnest(generate_series(time_bucket(INTERVAL 30 MINUTE, t0 - INTERVAL 24 HOUR, TIMESTAMP '2000-01-01'), t0, INTERVAL 30 MINUTE)) AS bucket FROM now), a AS (SELECT time_bucket(INTERVAL 30 MINUTE, event_ts, TIMESTAMP '2000-01-01') AS bucket, count(*) AS n, count(*) FILTER (WHERE is_flagged) AS k FROM swipes, now WHERE event_ts >= t0 - INTERVAL 24 HOUR GROUP BY 1)
SELECT bucket, coalesce(n, 0) AS txn_count, coalesce(k, 0) AS alert_count, round(100.0::DOUBLE * (k / nullif(n, 0)), 3) AS alert_rate_pct FROM b LEFT JOIN a USING (bucket)""")
def timeseries_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by half-hour, with a row for each bucket even if nothing happened."""
    at = newest(spark, sf_dir, "events", "ts")
    bucket = lambda c: time_bucket(c, "30 minutes").cast("timestamp_ntz")
    a = swipes(spark, sf_dir).where(F.col("event_ts") >= back(at, hours=24)).groupBy(bucket(F.col("event_ts")).alias("bucket")).agg(F.count("*").alias("n"), count_if(F.col("is_flagged")).alias("k"))
    b = spark.range(1).select(F.explode(F.sequence(bucket(back(at, hours=24)), back(at), F.expr("INTERVAL 30 MINUTES"))).alias("bucket"))
    return b.join(a, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("txn_count"), F.coalesce("k", F.lit(0)).alias("alert_count"), percent(F.col("k"), F.col("n"), 3).alias("alert_rate_pct"))


@query(f"""WITH {FACT}, r AS (SELECT *, array_to_string(list_filter([CASE WHEN quantity >= 40 THEN 'BIG_BASKET' END, CASE WHEN discount >= 0.08 THEN 'DEEP_DISCOUNT' END, CASE WHEN tax <= 0.01 THEN 'LOW_TAX' END], lambda x: x IS NOT NULL), ', ') AS reasons FROM fact)
SELECT transaction_id, event_ts, CAST(score AS DOUBLE) AS fraud_score, CAST(amount_usd AS DOUBLE) AS amount_usd, reasons, c_name AS user_name, s_name AS merchant_name, p_type AS category_name FROM r JOIN customer ON c_custkey = user_key JOIN supplier ON s_suppkey = merchant_key JOIN part ON p_partkey = part_key, now WHERE is_flagged AND event_ts >= t0 - INTERVAL 365 DAY ORDER BY event_ts DESC, fraud_score DESC, transaction_id LIMIT 50""")
def alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 alerts with names. The top rows are chosen before the dimensions are joined."""
    at = newest(spark, sf_dir)
    top = lines(spark, sf_dir, True).where(F.col("is_flagged") & (F.col("event_ts") >= back(at, days=365))).orderBy(F.desc("event_ts"), F.desc("score"), "transaction_id").limit(50)
    c, s, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    joined = top.join(c, F.col("user_key") == c["c_custkey"]).join(s, F.col("merchant_key") == s["s_suppkey"]).join(p, F.col("part_key") == p["p_partkey"])
    return joined.select("transaction_id", "event_ts", F.col("score").cast(_D).alias("fraud_score"), F.col("amount_usd").cast(_D).alias("amount_usd"), F.array_join(_reasons(), ", ").alias("reasons"), F.col("c_name").alias("user_name"), F.col("s_name").alias("merchant_name"), F.col("p_type").alias("category_name")).orderBy(F.desc("event_ts"), F.desc("fraud_score"), "transaction_id")


@query(f"""WITH {SWIPES} SELECT time_bucket(INTERVAL 1 HOUR, event_ts, TIMESTAMP '2000-01-01') AS bucket, event_type AS category_name, count(*) AS txn_count, count(*) FILTER (WHERE is_flagged) AS alert_count, round(100.0::DOUBLE * (count(*) FILTER (WHERE is_flagged) / count(*)), 3) AS alert_rate_pct FROM swipes, now WHERE event_ts >= t0 - INTERVAL 72 HOUR GROUP BY 1, 2""")
def category_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = newest(spark, sf_dir, "events", "ts")
    t = swipes(spark, sf_dir).where(F.col("event_ts") >= back(at, hours=72))
    per = t.groupBy(time_bucket(F.col("event_ts"), "1 hour").cast("timestamp_ntz").alias("bucket"), F.col("event_type").alias("category_name")).agg(F.count("*").alias("txn_count"), count_if(F.col("is_flagged")).alias("alert_count"))
    return per.select("*", percent(F.col("alert_count"), F.col("txn_count"), 3).alias("alert_rate_pct"))


_TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"""WITH {SWIPES} SELECT CAST(hour(event_ts) AS BIGINT) AS hour_utc, """ + ", ".join(f"count(*) FILTER (WHERE is_flagged AND event_type = '{t}') AS {t}" for t in _TYPES) + """ FROM swipes GROUP BY 1""")
def category_heatmap_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heat map turned: hours by types; the values of the pivot are given, so no extra pass finds them."""
    t = swipes(spark, sf_dir).groupBy(F.hour("event_ts").cast("long").alias("hour_utc")).pivot("event_type", list(_TYPES)).agg(count_if(F.col("is_flagged")))
    return t.na.fill(0)


@query(f"""WITH {FACT}, {DISPUTES}, {LABELLED}, {HITS}, t AS (SELECT count(*) FILTER (WHERE is_fraud) AS total FROM labelled, now WHERE event_ts >= t0 - INTERVAL 365 DAY AND event_ts < t0 - INTERVAL 7 DAY)
SELECT rule, count(*) AS hits, count(*) FILTER (WHERE is_fraud) AS true_positives, round(count(*) FILTER (WHERE is_fraud) / count(*), 4) AS precision, round(count(*) FILTER (WHERE is_fraud) / nullif(any_value(total), 0), 4) AS recall FROM hits, now, t WHERE event_ts >= t0 - INTERVAL 365 DAY AND event_ts < t0 - INTERVAL 7 DAY GROUP BY rule""")
def rule_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over a year, less the newest week whose labels aren't mature."""
    at = newest(spark, sf_dir)
    t = labelled(spark, sf_dir).where((F.col("event_ts") >= back(at, days=365)) & (F.col("event_ts") < back(at, days=7)))
    total = t.agg(count_if(F.col("is_fraud")).alias("total"))
    per = t.select("is_fraud", F.explode(_reasons()).alias("rule")).groupBy("rule").agg(F.count("*").alias("hits"), count_if(F.col("is_fraud")).alias("true_positives"))
    return per.crossJoin(F.broadcast(total)).select("rule", "hits", "true_positives", F.round(ratio(F.col("true_positives"), F.col("hits")), 4).alias("precision"), F.round(ratio(F.col("true_positives"), F.col("total")), 4).alias("recall"))


@query(f"""WITH {FACT}, {DISPUTES}, {LABELLED}, c AS (SELECT count(*) FILTER (WHERE is_flagged AND is_fraud) AS tp, count(*) FILTER (WHERE is_flagged AND NOT is_fraud) AS fp, count(*) FILTER (WHERE NOT is_flagged AND is_fraud) AS fn, count(*) FILTER (WHERE NOT is_flagged AND NOT is_fraud) AS tn FROM labelled, now WHERE event_ts >= t0 - INTERVAL 365 DAY AND event_ts < t0 - INTERVAL 7 DAY)
SELECT *, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(fp / nullif(fp + tn, 0), 6) AS false_positive_rate FROM c""")
def model_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = newest(spark, sf_dir)
    t = labelled(spark, sf_dir).where((F.col("event_ts") >= back(at, days=365)) & (F.col("event_ts") < back(at, days=7)))
    a, b, c = F.col("is_flagged"), F.col("is_fraud"), F.col
    m = t.agg(count_if(a & b).alias("tp"), count_if(a & ~b).alias("fp"), count_if(~a & b).alias("fn"), count_if(~a & ~b).alias("tn"))
    return m.select("*", F.round(ratio(c("tp"), c("tp") + c("fp")), 4).alias("precision"), F.round(ratio(c("tp"), c("tp") + c("fn")), 4).alias("recall"), F.round(ratio(c("fp"), c("fp") + c("tn")), 6).alias("false_positive_rate"))


@query(f"""WITH {SWIPES}, {SLIDES}, r AS (SELECT *, avg(txns) OVER (PARTITION BY merchant_key ORDER BY window_start ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS base, row_number() OVER (PARTITION BY merchant_key ORDER BY window_start DESC) AS rn FROM slides, now WHERE window_start >= t0 - INTERVAL 45 HOUR AND window_start + INTERVAL 5 HOUR <= t0 + INTERVAL 1 HOUR)
SELECT merchant_key, window_start, txns AS txn_count, round(base, 2) AS baseline_txn_count, round(txns / nullif(base, 0), 2) AS spike_ratio, flagged AS flagged_count, round(avg_value, 6) AS avg_value, CAST(usd AS DOUBLE) AS total_amount_usd FROM r WHERE rn = 1 ORDER BY flagged DESC, spike_ratio DESC NULLS LAST, merchant_key LIMIT 15""")
def merchant_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchants whose latest window deviates most from the windows before."""
    at = newest(spark, sf_dir, "events", "ts")
    t = _slides(spark, sf_dir).where((F.col("window_start") >= back(at, hours=45)) & (F.col("window_start") <= back(at, hours=4)))
    by = Window.partitionBy("merchant_key").orderBy("window_start")
    r = t.select("*", F.avg("txns").over(by.rowsBetween(-30, -1)).alias("base"), F.lead("window_start").over(by).isNull().alias("latest")).where("latest")
    return r.select("merchant_key", "window_start", F.col("txns").alias("txn_count"), F.round("base", 2).alias("baseline_txn_count"), F.round(ratio(F.col("txns"), F.col("base")), 2).alias("spike_ratio"), F.col("flagged").alias("flagged_count"), F.round("avg_value", 6).alias("avg_value"), F.col("usd").cast(_D).alias("total_amount_usd")).orderBy(F.desc("flagged_count"), F.desc_nulls_last("spike_ratio"), "merchant_key").limit(15)


@query(f"""WITH {SWIPES} SELECT transaction_id, lat, lon, event_ts, CAST(amount_usd AS DOUBLE) AS amount_usd FROM swipes, now WHERE is_flagged AND event_ts >= t0 - INTERVAL 20 DAY ORDER BY event_ts DESC, transaction_id LIMIT 3000""")
def flagged_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = newest(spark, sf_dir, "events", "ts")
    t = swipes(spark, sf_dir).where(F.col("is_flagged") & (F.col("event_ts") >= back(at, days=20)))
    return t.select("transaction_id", "lat", "lon", "event_ts", F.col("amount_usd").cast(_D).alias("amount_usd")).orderBy(F.desc("event_ts"), "transaction_id").limit(3000)


@query(f"""WITH {TELEMETRY}, latest AS (SELECT DISTINCT ON (query_name) query_name, progress_ts, watermark, state_rows_total, max_offsets_behind_latest FROM progress ORDER BY query_name, progress_ts DESC, state_rows_total DESC),
p AS (SELECT query_name, count(*) FILTER (WHERE num_input_rows > 0) AS batches, CAST(sum(num_input_rows) AS BIGINT) AS rows_in, round(avg(processed_rows_per_second) FILTER (WHERE num_input_rows > 0), 0) AS avg_rows_per_s, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY batch_duration_ms) FILTER (WHERE num_input_rows > 0), 4) AS p50_batch_ms, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY batch_duration_ms) FILTER (WHERE num_input_rows > 0), 4) AS p95_batch_ms, CAST(coalesce(sum(rows_dropped_by_watermark), 0) AS BIGINT) AS dropped_late_rows FROM progress, now WHERE progress_ts >= t0 - INTERVAL 7 DAY GROUP BY 1)
SELECT p.*, max_offsets_behind_latest AS kafka_lag, state_rows_total, watermark, progress_ts AS last_progress FROM p JOIN latest USING (query_name)""")
def pipeline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's week with its latest state; the latest row is a maximum by time, in the same grouping."""
    at = newest(spark, sf_dir, "events", "ts")
    p = telemetry(spark, sf_dir)
    latest = p.groupBy("query_name").agg(F.max_by(F.struct("max_offsets_behind_latest", "state_rows_total", "watermark", "progress_ts"), F.struct("progress_ts", "state_rows_total")).alias("l"))
    per = p.where(F.col("progress_ts") >= back(at, days=7)).groupBy("query_name").agg(count_if(F.col("num_input_rows") > 0).alias("batches"), F.sum("num_input_rows").alias("rows_in"), F.round(F.avg(F.when(F.col("num_input_rows") > 0, F.col("processed_rows_per_second"))), 0).alias("avg_rows_per_s"), F.round(_cont(0.5, where="num_input_rows > 0"), 4).alias("p50_batch_ms"), F.round(_cont(0.95, where="num_input_rows > 0"), 4).alias("p95_batch_ms"), F.coalesce(F.sum("rows_dropped_by_watermark"), F.lit(0)).alias("dropped_late_rows"))
    return per.join(latest, "query_name").select(*per.columns, F.col("l.max_offsets_behind_latest").alias("kafka_lag"), F.col("l.state_rows_total"), F.col("l.watermark"), F.col("l.progress_ts").alias("last_progress"))


@query(f"""WITH {TELEMETRY} SELECT query_name, count(*) AS batches, CAST(sum(num_input_rows) AS BIGINT) AS rows_processed, round(avg(num_input_rows), 2) AS avg_rows_per_batch, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY batch_duration_ms), 1) AS p50_batch_ms, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY batch_duration_ms), 1) AS p95_batch_ms, max(batch_duration_ms) AS max_batch_ms, round(avg(processed_rows_per_second), 2) AS avg_processing_rows_per_s, round(100.0::DOUBLE * (count(*) FILTER (WHERE batch_duration_ms < 2000) / count(*)), 1) AS pct_under_2s, max(max_offsets_behind_latest) AS max_kafka_lag, CAST(coalesce(sum(rows_dropped_by_watermark), 0) AS BIGINT) AS late_rows_dropped FROM progress, now WHERE num_input_rows > 0 AND progress_ts >= t0 - INTERVAL 15 DAY GROUP BY 1""")
def report_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = newest(spark, sf_dir, "events", "ts")
    p = telemetry(spark, sf_dir).where((F.col("num_input_rows") > 0) & (F.col("progress_ts") >= back(at, days=15)))
    return p.groupBy("query_name").agg(F.count("*").alias("batches"), F.sum("num_input_rows").alias("rows_processed"), F.round(F.avg("num_input_rows"), 2).alias("avg_rows_per_batch"), F.round(_cont(0.5), 1).alias("p50_batch_ms"), F.round(_cont(0.95), 1).alias("p95_batch_ms"), F.max("batch_duration_ms").alias("max_batch_ms"), F.round(F.avg("processed_rows_per_second"), 2).alias("avg_processing_rows_per_s"), percent(count_if(F.col("batch_duration_ms") < 2000), F.count("*"), 1).alias("pct_under_2s"), F.max("max_offsets_behind_latest").alias("max_kafka_lag"), F.coalesce(F.sum("rows_dropped_by_watermark"), F.lit(0)).alias("late_rows_dropped"))


@query(f"""WITH {TELEMETRY} SELECT date_trunc('minute', progress_ts) AS minute, CAST(sum(num_input_rows) AS BIGINT) AS events, round(sum(num_input_rows) / 60.0::DOUBLE, 2) AS events_per_second FROM progress, now WHERE query_name = 'bronze_transactions' AND progress_ts >= t0 - INTERVAL 15 DAY GROUP BY 1""")
def report_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = newest(spark, sf_dir, "events", "ts")
    p = telemetry(spark, sf_dir).where((F.col("query_name") == "bronze_transactions") & (F.col("progress_ts") >= back(at, days=15)))
    return p.groupBy(time_bucket(F.col("progress_ts"), "1 minute").cast("timestamp_ntz").alias("minute")).agg(F.sum("num_input_rows").alias("events"), F.round(F.sum("num_input_rows") / F.lit(60.0), 2).alias("events_per_second"))


@query(f"""WITH {TELEMETRY} SELECT count(*) AS rows_loaded, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY load_seconds), 2) AS p50_s, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY load_seconds), 2) AS p95_s, round(percentile_cont(0.99) WITHIN GROUP (ORDER BY load_seconds), 2) AS p99_s FROM progress, now WHERE progress_ts >= t0 - INTERVAL 10 DAY""")
def report_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = newest(spark, sf_dir, "events", "ts")
    p = telemetry(spark, sf_dir).where(F.col("progress_ts") >= back(at, days=10))
    return p.agg(F.count("*").alias("rows_loaded"), *[F.round(_cont(q, "load_seconds"), 2).alias(n) for q, n in ((0.5, "p50_s"), (0.95, "p95_s"), (0.99, "p99_s"))])


@query(f"""WITH {FACT}, {DISPUTES} SELECT (SELECT count(*) FROM fact) AS transactions, (SELECT count(*) FROM fact WHERE is_flagged) AS alerts, (SELECT count(*) FROM cb) AS chargebacks, (SELECT count(*) FROM (SELECT DISTINCT merchant_key, date_trunc('month', event_ts) FROM fact)) AS merchant_months""")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the warehouse's tables; transactions and alerts share one pass."""
    t = lines(spark, sf_dir)
    first = t.agg(F.count("*").alias("transactions"), count_if(F.col("is_flagged")).alias("alerts"))
    second = chargebacks(spark, sf_dir).agg(F.count("*").alias("chargebacks"))
    third = t.select("merchant_key", F.trunc(F.to_date("event_ts"), "month").alias("m")).distinct().agg(F.count("*").alias("merchant_months"))
    return first.crossJoin(F.broadcast(second)).crossJoin(F.broadcast(third))


@query(f"""WITH {SWIPES} SELECT transaction_id, user_id, event_ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_ts DESC, transaction_id DESC) AS rn FROM swipes) WHERE rn = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each card."""
    return first_by(swipes(spark, sf_dir).select("transaction_id", "user_id", "event_ts", "event_type", "value"), ["user_id"], [F.desc("event_ts"), F.desc("transaction_id")])
