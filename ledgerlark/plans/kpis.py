"""Analytic models over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import count_if, haversine_km, percent, ratio, seconds_between, shrunk_rate, speed_kmh, time_bucket, wilson_lower
from ..functions.fixed_values import EARTH_RADIUS_KM, dispute_reasons
from ..operators.dimensions import calendar
from ..operators.keyed import islands
from ..scratch import scratch
from .star import DISPUTES, FACT, LABELLED, REASONS, SWIPES, TELEMETRY, back, chargebacks, fraud_chargebacks, labelled, lines, newest, query, swipes, table, telemetry

_D = "double"


def _money(c: str):
    """A decimal total as a double, as both engines keep different precisions."""
    return F.sum(c).cast(_D)


@query(f"""WITH {FACT}, {DISPUTES}, first AS (SELECT transaction_id, min(chargeback_id) AS id, arg_min(amount_usd, chargeback_id) AS loss FROM cb WHERE reason_code IN ('10.1', '10.3', '10.4') GROUP BY 1),
l AS (SELECT f.*, first.id IS NOT NULL AS is_fraud, coalesce(loss, 0) AS loss, event_ts > t0 - INTERVAL 30 DAY AS cur FROM fact f CROSS JOIN now LEFT JOIN first USING (transaction_id) WHERE event_ts > t0 - INTERVAL 60 DAY),
a AS (SELECT count(*) FILTER (WHERE cur) AS n, count(*) FILTER (WHERE NOT cur) AS pn, CAST(sum(amount_usd) FILTER (WHERE cur) AS DOUBLE) AS v, CAST(sum(amount_usd) FILTER (WHERE NOT cur) AS DOUBLE) AS pv, count(*) FILTER (WHERE cur AND is_flagged) AS alerts, count(*) FILTER (WHERE cur AND is_fraud) AS fraud, CAST(sum(loss) FILTER (WHERE cur) AS DOUBLE) AS loss FROM l)
SELECT n AS txn_count, v AS volume_usd, round(v / nullif(n, 0), 2) AS avg_ticket_usd, round(100.0::DOUBLE * (alerts / nullif(n, 0)), 3) AS alert_rate_pct, round(10000.0::DOUBLE * (fraud / nullif(n, 0)), 2) AS fraud_rate_bps, round(10000.0::DOUBLE * (loss / nullif(v, 0)), 2) AS fraud_loss_bps, round(100.0::DOUBLE * ((n - pn) / nullif(pn, 0)), 1) AS txn_change_pct, round(100.0::DOUBLE * ((v - pv) / nullif(pv, 0)), 1) AS volume_change_pct FROM a""")
def kpi_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 30 days against the 30 before, in one pass: both periods are conditional aggregates."""
    at = newest(spark, sf_dir)
    first = fraud_chargebacks(spark, sf_dir).groupBy("transaction_id").agg(F.min_by("amount_usd", "chargeback_id").alias("loss"))
    t = lines(spark, sf_dir).where(F.col("event_ts") > back(at, days=60)).join(first, "transaction_id", "left")
    cur = F.col("event_ts") > back(at, days=30)
    usd = F.col("amount_usd")
    a = t.agg(count_if(cur).alias("n"), count_if(~cur).alias("pn"), F.sum(F.when(cur, usd)).cast(_D).alias("v"), F.sum(F.when(~cur, usd)).cast(_D).alias("pv"), count_if(cur & F.col("is_flagged")).alias("alerts"), count_if(cur & F.col("loss").isNotNull()).alias("fraud"), F.sum(F.when(cur, F.coalesce("loss", F.lit(0)))).cast(_D).alias("loss"))
    c = F.col
    return a.select(c("n").alias("txn_count"), c("v").alias("volume_usd"), F.round(ratio(c("v"), c("n")), 2).alias("avg_ticket_usd"), percent(c("alerts"), c("n"), 3).alias("alert_rate_pct"), percent(c("fraud"), c("n"), 2, 10_000.0).alias("fraud_rate_bps"), percent(c("loss"), c("v"), 2, 10_000.0).alias("fraud_loss_bps"), percent(c("n") - c("pn"), c("pn"), 1).alias("txn_change_pct"), percent(c("v") - c("pv"), c("pv"), 1).alias("volume_change_pct"))


@query(f"""WITH {FACT}, {DISPUTES}, {LABELLED}, daily AS (SELECT user_key, CAST(event_ts AS DATE) AS day, count(*) AS txns, count(*) FILTER (WHERE is_fraud) AS fraud FROM labelled, now WHERE event_ts >= t0 - INTERVAL 60 DAY GROUP BY 1, 2),
r AS (SELECT user_key, day, CAST(sum(txns) OVER w AS BIGINT) AS txns_30d, CAST(sum(fraud) OVER w AS BIGINT) AS fraud_30d FROM daily WINDOW w AS (PARTITION BY user_key ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW))
SELECT user_key, c_mktsegment AS segment, day AS as_of_day, txns_30d, fraud_30d, round(100.0::DOUBLE * (fraud_30d / txns_30d), 2) AS fraud_rate_pct FROM r JOIN customer ON c_custkey = user_key WHERE day >= (SELECT max(day) FROM daily) - 30 AND fraud_30d > 0 ORDER BY fraud_rate_pct DESC, fraud_30d DESC, user_key, as_of_day LIMIT 25""")
def trailing_customer_fraud_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cardholders with the highest fraud rate of a trailing 30-day window, in the last month's days."""
    at = newest(spark, sf_dir)
    daily = labelled(spark, sf_dir, True).where(F.col("event_ts") >= back(at, days=60)).groupBy("user_key", F.to_date("event_ts").alias("day")).agg(F.count("*").alias("txns"), count_if(F.col("is_fraud")).alias("fraud"))
    w = Window.partitionBy("user_key").orderBy(F.unix_date("day")).rangeBetween(-29, 0)
    rolled = daily.select("user_key", "day", F.sum("txns").over(w).alias("txns_30d"), F.sum("fraud").over(w).alias("fraud_30d"))
    recent = rolled.where((F.col("day") >= F.date_sub(F.lit(at.date()), 30)) & (F.col("fraud_30d") > 0))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_key"), F.col("c_mktsegment").alias("segment"))
    done = recent.join(users, "user_key").select("user_key", "segment", F.col("day").alias("as_of_day"), "txns_30d", "fraud_30d", percent(F.col("fraud_30d"), F.col("txns_30d")).alias("fraud_rate_pct"))
    return done.orderBy(F.desc_nulls_last("fraud_rate_pct"), F.desc("fraud_30d"), "user_key", "as_of_day").limit(25)


@query(f"""WITH {FACT}, {DISPUTES}, d AS (SELECT DISTINCT transaction_id AS id FROM cb WHERE reason_code IN ('10.1', '10.3', '10.4')), per AS (SELECT p_type AS category, count(*) AS txns, count(id) AS hits FROM fact JOIN part ON p_partkey = part_key LEFT JOIN d ON id = transaction_id GROUP BY 1),
g AS (SELECT CAST(sum(hits) AS DOUBLE) / sum(txns) AS prior FROM per),
s AS (SELECT *, (hits + 1000.0::DOUBLE * prior) / (txns + 1000.0::DOUBLE) AS smooth, hits / txns AS p, CAST(txns AS DOUBLE) AS m FROM per, g),
w AS (SELECT *, (p + 1.96::DOUBLE * 1.96::DOUBLE / (2 * m) - 1.96::DOUBLE * sqrt((p * (1 - p) + 1.96::DOUBLE * 1.96::DOUBLE / (4 * m)) / m)) / (1 + 1.96::DOUBLE * 1.96::DOUBLE / m) AS lower FROM s)
SELECT CAST(rank() OVER (ORDER BY round(smooth, 12) DESC, category) AS BIGINT) AS risk_rank, category, txns, hits AS fraud_chargebacks, round(100 * p, 4) AS raw_pct, round(100 * smooth, 4) AS smoothed_pct, round(100 * greatest(lower, 0), 4) AS wilson_lower_pct FROM w ORDER BY risk_rank LIMIT 5""")
def riskiest_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by shrunk fraud rate, with Wilson's lower bound. Ranks only see a row for each category."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), F.col("p_type").alias("category"))
    per = labelled(spark, sf_dir).join(parts, "part_key").groupBy("category").agg(F.count("*").alias("txns"), count_if(F.col("is_fraud")).alias("hits"))
    prior = per.agg(ratio(F.sum("hits"), F.sum("txns")).alias("prior"))
    c = F.col
    scored = per.crossJoin(F.broadcast(prior)).select("*", shrunk_rate(c("hits"), c("txns"), c("prior")).alias("smooth"), wilson_lower(c("hits"), c("txns")).alias("lower"))
    rank = F.rank().over(Window.orderBy(F.desc(F.round("smooth", 12)), "category")).cast("long")
    return scored.select(rank.alias("risk_rank"), "category", "txns", c("hits").alias("fraud_chargebacks"), F.round(100 * ratio(c("hits"), c("txns")), 4).alias("raw_pct"), F.round(100 * c("smooth"), 4).alias("smoothed_pct"), F.round(100 * F.greatest("lower", F.lit(0.0)), 4).alias("wilson_lower_pct")).orderBy("risk_rank").limit(5)


@query(f"""WITH {SWIPES}, legs AS (SELECT *, lag(event_ts) OVER w AS prev_ts, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(merchant_key) OVER w AS prev_m, lead(value) OVER w AS next_value FROM swipes WINDOW w AS (PARTITION BY user_id ORDER BY event_ts, transaction_id)),
k AS (SELECT *, (epoch_us(event_ts) - epoch_us(prev_ts)) / 1e6 AS s, sqrt(sin(radians(lat - plat) / 2) * sin(radians(lat - plat) / 2) + cos(radians(plat)) * cos(radians(lat)) * sin(radians(lon - plon) / 2) * sin(radians(lon - plon) / 2)) AS ch FROM legs WHERE prev_ts IS NOT NULL),
d AS (SELECT *, asin(CASE WHEN ch > 1 THEN 1.0 ELSE ch END) * 2 * {EARTH_RADIUS_KM}::DOUBLE AS km FROM k)
SELECT transaction_id, user_id, prev_ts, event_ts, next_value, round(km, 1) AS km, round(s / 60, 1) AS minutes, round(km / (greatest(s, 60) / 3600), 0) AS implied_kmh FROM d WHERE km > 300 AND km / (greatest(s, 60) / 3600) > 900 ORDER BY implied_kmh DESC, transaction_id LIMIT 50""")
def velocity_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive swipes of a card that no jet could make."""
    w = Window.partitionBy("user_id").orderBy("event_ts", "transaction_id")
    t = swipes(spark, sf_dir).select("transaction_id", "user_id", "event_ts", "lat", "lon", "value")
    legs = t.select("*", F.lag("event_ts").over(w).alias("prev_ts"), F.lag("lat").over(w).alias("plat"), F.lag("lon").over(w).alias("plon"), F.lead("value").over(w).alias("next_value")).where("prev_ts IS NOT NULL")
    c = F.col
    far = legs.select("*", haversine_km(c("plat"), c("plon"), c("lat"), c("lon")).alias("d"), seconds_between(c("event_ts"), c("prev_ts")).alias("s")).withColumn("v", speed_kmh(c("d"), c("s")))
    return far.where("d > 300 AND v > 900").select("transaction_id", "user_id", "prev_ts", "event_ts", "next_value", F.round("d", 1).alias("km"), F.round(c("s") / 60, 1).alias("minutes"), F.round("v", 0).alias("implied_kmh")).orderBy(F.desc("implied_kmh"), "transaction_id").limit(50)


def _reasons():
    return F.array_compact(F.array(F.when(F.col("quantity") >= 40, "BIG_BASKET"), F.when(F.col("discount") >= 0.08, "DEEP_DISCOUNT"), F.when(F.col("tax") <= 0.01, "LOW_TAX")))


HITS = """hits AS (SELECT l.*, unnest(list_filter([CASE WHEN quantity >= 40 THEN 'BIG_BASKET' END, CASE WHEN discount >= 0.08 THEN 'DEEP_DISCOUNT' END, CASE WHEN tax <= 0.01 THEN 'LOW_TAX' END], lambda x: x IS NOT NULL)) AS rule FROM labelled l)"""


@query(f"""WITH {FACT}, {DISPUTES}, {LABELLED}, {HITS}, b AS (SELECT count(*) AS n, count(*) FILTER (WHERE is_fraud) AS pos FROM labelled), per AS (SELECT rule, count(*) AS fired, count(*) FILTER (WHERE is_fraud) AS tp FROM hits GROUP BY 1)
SELECT rule, fired, tp, fired - tp AS fp, round(tp / fired, 4) AS precision, round(tp / nullif(pos, 0), 4) AS recall, round(2.0::DOUBLE * (tp / nullif(fired + pos, 0)), 4) AS f1, round((tp / fired) / nullif(pos / n, 0), 1) AS lift FROM per, b""")
def rule_effectiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and lift of each rule; reasons are exploded from an array."""
    t = labelled(spark, sf_dir)
    base = t.agg(F.count("*").alias("n"), count_if(F.col("is_fraud")).alias("pos"))
    per = t.select("is_fraud", F.explode(_reasons()).alias("rule")).groupBy("rule").agg(F.count("*").alias("fired"), count_if(F.col("is_fraud")).alias("tp"))
    c = F.col
    return per.crossJoin(F.broadcast(base)).select("rule", "fired", "tp", (c("fired") - c("tp")).alias("fp"), F.round(ratio(c("tp"), c("fired")), 4).alias("precision"), F.round(ratio(c("tp"), c("pos")), 4).alias("recall"), F.round(2.0 * ratio(c("tp"), c("fired") + c("pos")), 4).alias("f1"), F.round(ratio(ratio(c("tp"), c("fired")), ratio(c("pos"), c("n"))), 1).alias("lift"))


@query(f"""WITH {FACT}, {DISPUTES}, {LABELLED}, t AS (SELECT CAST(i * 0.05 AS DECIMAL(4,2)) AS threshold FROM generate_series(4, 19) AS g(i)),
a AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS alerts, count(*) FILTER (WHERE score >= threshold AND is_fraud) AS tp, count(*) FILTER (WHERE is_fraud) AS pos, count(*) FILTER (WHERE NOT is_fraud) AS neg FROM t, labelled GROUP BY 1)
SELECT CAST(threshold AS DOUBLE) AS threshold, alerts, tp AS true_positives, round(tp / nullif(alerts, 0), 4) AS precision, round(tp / nullif(pos, 0), 4) AS recall, round((alerts - tp) / nullif(neg, 0), 6) AS false_positive_rate FROM a""")
def threshold_tuning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert threshold from 0.20 to 0.95. Transactions are summed by score first, so the sweep joins 16 thresholds with a few scores, not with all rows."""
    per = labelled(spark, sf_dir).groupBy("score").agg(F.count("*").alias("n"), count_if(F.col("is_fraud")).alias("fraud"))
    all_ = per.agg(F.sum("fraud").alias("pos"), F.sum(F.col("n") - F.col("fraud")).alias("neg"))
    thresholds = spark.range(4, 20).select((F.col("id") * F.lit(0.05)).cast("decimal(4,2)").alias("threshold"))
    swept = per.crossJoin(F.broadcast(thresholds)).groupBy("threshold").agg(F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("n")).otherwise(0)).alias("alerts"), F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("fraud")).otherwise(0)).alias("tp"))
    c = F.col
    return swept.crossJoin(F.broadcast(all_)).select(c("threshold").cast(_D).alias("threshold"), "alerts", c("tp").alias("true_positives"), F.round(ratio(c("tp"), c("alerts")), 4).alias("precision"), F.round(ratio(c("tp"), c("pos")), 4).alias("recall"), F.round(ratio(c("alerts") - c("tp"), c("neg")), 6).alias("false_positive_rate"))


@query(f"""WITH {SWIPES}, m AS (SELECT *, CASE WHEN event_ts - lag(event_ts) OVER (PARTITION BY user_id ORDER BY event_ts, transaction_id) <= INTERVAL 24 HOUR THEN 0 ELSE 1 END AS s FROM swipes WHERE is_fraud),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_ts, transaction_id ROWS UNBOUNDED PRECEDING) AS no FROM m),
f AS (SELECT *, min(CASE WHEN is_flagged THEN event_ts END) OVER (PARTITION BY user_id, no) AS alert FROM i),
p AS (SELECT user_id, no, count(*) AS n, sum(amount_usd) AS usd, min(alert) AS alert, (epoch_us(min(alert)) - epoch_us(min(event_ts))) / 1e6 AS secs, sum(amount_usd) FILTER (WHERE alert IS NULL OR event_ts < alert) AS lost FROM f GROUP BY 1, 2)
SELECT count(*) AS incidents, count(alert) AS detected, round(100.0::DOUBLE * (count(alert) / nullif(count(*), 0)), 1) AS detection_rate_pct, round(avg(n), 2) AS avg_txns, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY secs), 4) AS p50_seconds, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY secs), 4) AS p90_seconds, CAST(sum(coalesce(lost, 0)) AS DOUBLE) AS usd_lost, CAST(sum(usd) AS DOUBLE) AS usd_total FROM p""")
def incidents_time_to_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of fraud with gaps of at most a day: how many are detected, how fast, and what is lost before. The loss before the alert is a conditional sum over a window, not a correlated subquery."""
    runs = islands(swipes(spark, sf_dir).where("is_fraud"), ["user_id"], "event_ts", 86_400, "no", [F.col("transaction_id")])
    alert = F.min(F.when(F.col("is_flagged"), F.col("event_ts"))).over(Window.partitionBy("user_id", "no"))
    per = runs.withColumn("alert", alert).groupBy("user_id", "no").agg(F.count("*").alias("n"), F.sum("amount_usd").alias("usd"), F.min("alert").alias("alert"), seconds_between(F.min("alert"), F.min("event_ts")).alias("secs"), F.sum(F.when(F.col("alert").isNull() | (F.col("event_ts") < F.col("alert")), F.col("amount_usd"))).alias("lost"))
    return per.agg(F.count("*").alias("incidents"), F.count("alert").alias("detected"), percent(F.count("alert"), F.count("*"), 1).alias("detection_rate_pct"), F.round(F.avg("n"), 2).alias("avg_txns"), F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY secs)"), 4).alias("p50_seconds"), F.round(F.expr("percentile_cont(0.9) WITHIN GROUP (ORDER BY secs)"), 4).alias("p90_seconds"), F.sum(F.coalesce("lost", F.lit(0))).cast(_D).alias("usd_lost"), _money("usd").alias("usd_total"))


@query(f"""WITH {FACT}, h AS (SELECT merchant_key, date_trunc('month', event_ts) AS month, count(*) AS txns, count(*) FILTER (WHERE is_flagged) AS flagged FROM fact GROUP BY 1, 2),
s AS (SELECT *, avg(txns) OVER w AS base, stddev_samp(txns) OVER w AS std, count(*) OVER w AS n FROM h WINDOW w AS (PARTITION BY merchant_key ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT s_name AS merchant_name, CAST(month AS DATE) AS month, txns, flagged, round(base, 2) AS baseline_avg, round((txns - base) / nullif(std, 0), 2) AS zscore FROM s JOIN supplier ON s_suppkey = merchant_key WHERE n >= 3 ORDER BY zscore DESC NULLS LAST, merchant_name, month LIMIT 20""")
def spike_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchants' months against the twelve months before."""
    per = lines(spark, sf_dir).groupBy("merchant_key", F.trunc(F.to_date("event_ts"), "month").alias("month")).agg(F.count("*").alias("txns"), count_if(F.col("is_flagged")).alias("flagged"))
    w = Window.partitionBy("merchant_key").orderBy("month").rowsBetween(-12, -1)
    s = per.select("*", F.avg("txns").over(w).alias("base"), F.stddev_samp("txns").over(w).alias("std"), F.count("*").over(w).alias("n")).where("n >= 3")
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("merchant_key"), F.col("s_name").alias("merchant_name"))
    return s.join(names, "merchant_key").select("merchant_name", "month", "txns", "flagged", F.round("base", 2).alias("baseline_avg"), F.round(ratio(F.col("txns") - F.col("base"), F.col("std")), 2).alias("zscore")).orderBy(F.desc_nulls_last("zscore"), "merchant_name", "month").limit(20)


SLIDES = """slides AS (SELECT merchant_key, ws AS window_start, count(*) AS txns, count(*) FILTER (WHERE is_flagged) AS flagged, sum(amount_usd) AS usd, max(amount_usd) AS most, avg(value) AS avg_value FROM (SELECT *, unnest(generate_series(date_trunc('hour', event_ts) - INTERVAL 4 HOUR, date_trunc('hour', event_ts), INTERVAL 1 HOUR)) AS ws FROM swipes) GROUP BY 1, 2)"""


def _slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.window("event_ts", "5 hours", "1 hour")
    per = swipes(spark, sf_dir).groupBy("merchant_key", span.alias("w")).agg(F.count("*").alias("txns"), count_if(F.col("is_flagged")).alias("flagged"), F.sum("amount_usd").alias("usd"), F.max("amount_usd").alias("most"), F.avg("value").alias("avg_value"))
    return per.select("merchant_key", F.col("w.start").alias("window_start"), "txns", "flagged", "usd", "most", "avg_value")


@query(f"""WITH {SWIPES}, {SLIDES} SELECT merchant_key, window_start, txns, flagged, round(100.0::DOUBLE * (flagged / nullif(txns, 0)), 2) AS flagged_pct, flagged - lag(flagged) OVER w AS flagged_delta, round(avg(txns) OVER (PARTITION BY merchant_key ORDER BY window_start ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 2) AS txns_ma6, first_value(window_start) OVER w AS first_window FROM slides WHERE merchant_key % 5 = 0 WINDOW w AS (PARTITION BY merchant_key ORDER BY window_start)""")
def window_risk_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change, moving average and first window of high-risk merchants' sliding windows."""
    w = Window.partitionBy("merchant_key").orderBy("window_start")
    t = _slides(spark, sf_dir).where("merchant_key % 5 = 0")
    return t.select("merchant_key", "window_start", "txns", "flagged", percent(F.col("flagged"), F.col("txns")).alias("flagged_pct"), (F.col("flagged") - F.lag("flagged").over(w)).alias("flagged_delta"), F.round(F.avg("txns").over(w.rowsBetween(-5, 0)), 2).alias("txns_ma6"), F.first("window_start").over(w).alias("first_window"))


@query(f"""WITH {FACT}, s AS (SELECT user_key, sum(amount_usd) AS spend, count(*) AS txns, count(*) FILTER (WHERE is_flagged) AS alerts FROM fact GROUP BY 1), d AS (SELECT *, ntile(10) OVER (ORDER BY spend, user_key) AS decile FROM s),
a AS (SELECT decile, count(*) AS holders, CAST(sum(spend) AS DOUBLE) AS spend, CAST(sum(txns) AS BIGINT) AS txns, CAST(sum(alerts) AS BIGINT) AS alerts FROM d GROUP BY 1)
SELECT CAST(decile AS BIGINT) AS spend_decile, holders AS cardholders, spend AS spend_usd, round(100.0::DOUBLE * (spend / sum(spend) OVER ()), 2) AS share_pct, round(100.0::DOUBLE * (sum(spend) OVER (ORDER BY decile DESC) / sum(spend) OVER ()), 2) AS share_from_top_pct, round(100.0::DOUBLE * (alerts / nullif(txns, 0)), 3) AS alert_rate_pct FROM a""")
def spend_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cardholders by tenths of spend.

    Tenths need global ranks. Rows are ranked within range partitions, and each is
    shifted by the number of rows in the partitions before, so no task holds all
    customers as ``ntile`` over everything would.
    """
    per = lines(spark, sf_dir, True).groupBy("user_key").agg(F.sum("amount_usd").alias("spend"), F.count("*").alias("txns"), count_if(F.col("is_flagged")).alias("alerts"))
    ranked = globally_ranked(per, ["spend", "user_key"])
    size, left = F.floor(F.col("all") / 10), F.col("all") % 10
    turn = F.col("rank") - 1
    big = left * (size + 1)  # the first tenths take one row more each
    decile = F.when(turn < big, F.floor(turn / (size + 1))).otherwise(left + F.floor((turn - big) / F.greatest(size, F.lit(1)))) + 1
    agg = ranked.groupBy(decile.cast("long").alias("spend_decile")).agg(F.count("*").alias("cardholders"), F.sum("spend").cast(_D).alias("spend_usd"), F.sum("txns").alias("txns"), F.sum("alerts").alias("alerts"))
    whole, top = Window.partitionBy(), Window.orderBy(F.desc("spend_decile"))
    return agg.select("spend_decile", "cardholders", "spend_usd", F.round(100.0 * (F.col("spend_usd") / F.sum("spend_usd").over(whole)), 2).alias("share_pct"), F.round(100.0 * (F.sum("spend_usd").over(top) / F.sum("spend_usd").over(whole)), 2).alias("share_from_top_pct"), percent(F.col("alerts"), F.col("txns"), 3).alias("alert_rate_pct"))


def globally_ranked(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with ``rank`` (from 1, by columns that are unique together) and ``all``, without a single-task sort.

    A range partitioning by all of ``by`` deals the rows out evenly, ties of the first column
    included; adaptive execution joins neighbouring parts that are small. Each part is
    ranked by itself and shifted by the sizes of the parts before, which are all the driver
    sees. The parts are written first: sampled bounds could differ between two evaluations.
    """
    spark = df.sparkSession
    path = scratch(spark, "ranked")
    df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()).write.mode("overwrite").parquet(path)
    placed = spark.read.schema(StructType([*df.schema]).add("__part", "integer")).parquet(path)
    sizes = {r["__part"]: r["count"] for r in placed.groupBy("__part").count().collect()}
    total, shift = 0, []
    for k in sorted(sizes):
        shift += [F.lit(k), F.lit(total).cast("long")]
        total += sizes[k]
    before = F.create_map(*shift)[F.col("__part")] if shift else F.lit(0)
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*by))
    return placed.select(*df.columns, (inner + before).cast("long").alias("rank"), F.lit(total).cast("long").alias("all"))


@query(f"""WITH {FACT} SELECT CASE WHEN grouping(r_name) = 1 THEN 'ALL' ELSE r_name END AS country, CASE WHEN grouping(n_name) = 0 THEN n_name WHEN grouping(r_name) = 1 THEN 'Grand total' ELSE 'Country total' END AS city, CAST(grouping(r_name) + grouping(n_name) AS BIGINT) AS level, count(*) AS txns, CAST(sum(amount_usd) AS DOUBLE) AS volume_usd, round(100.0::DOUBLE * (count(*) FILTER (WHERE is_flagged) / count(*)), 3) AS alert_rate_pct FROM fact JOIN supplier ON s_suppkey = merchant_key JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def geography_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and alerts by region and nation, with subtotals and the grand total. Facts are summed by merchant before they meet the dimensions."""
    per = lines(spark, sf_dir).groupBy("merchant_key").agg(F.count("*").alias("n"), F.sum("amount_usd").alias("usd"), count_if(F.col("is_flagged")).alias("flagged"))
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    joined = per.join(s, F.col("merchant_key") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    up = joined.rollup("r_name", "n_name").agg(F.grouping("r_name").alias("g1"), F.grouping("n_name").alias("g2"), F.sum("n").alias("txns"), F.sum("usd").cast(_D).alias("volume_usd"), F.sum("flagged").alias("flagged"))
    return up.select(F.when(F.col("g1") == 1, "ALL").otherwise(F.col("r_name")).alias("country"), F.when(F.col("g2") == 0, F.col("n_name")).when(F.col("g1") == 1, "Grand total").otherwise("Country total").alias("city"), (F.col("g1") + F.col("g2")).cast("long").alias("level"), "txns", "volume_usd", percent(F.col("flagged"), F.col("txns"), 3).alias("alert_rate_pct"))


@query(f"""WITH {FACT}, {DISPUTES}, {REASONS} SELECT cb.reason_code, description, is_fraud, count(*) AS chargebacks, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY (epoch_us(reported_ts) - epoch_us(f.event_ts)) / 1e6), 1) AS p50_seconds, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY (epoch_us(reported_ts) - epoch_us(f.event_ts)) / 1e6), 1) AS p95_seconds, CAST(sum(cb.amount_usd) AS DOUBLE) AS disputed_usd FROM cb JOIN reasons USING (reason_code) JOIN fact f USING (transaction_id) GROUP BY 1, 2, 3""")
def label_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long disputes take, by reason; exact percentiles."""
    t = lines(spark, sf_dir).select("transaction_id", "event_ts")
    cb = chargebacks(spark, sf_dir).join(t, "transaction_id").withColumn("s", seconds_between(F.col("reported_ts"), F.col("event_ts")))
    per = cb.groupBy("reason_code").agg(F.count("*").alias("chargebacks"), F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY s)"), 1).alias("p50_seconds"), F.round(F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY s)"), 1).alias("p95_seconds"), _money("amount_usd").alias("disputed_usd"))
    return per.join(dispute_reasons(spark), "reason_code").select("reason_code", "description", "is_fraud", "chargebacks", "p50_seconds", "p95_seconds", "disputed_usd")


@query(f"""WITH {SWIPES} SELECT dayname(event_ts) AS day_name, CAST(isodow(event_ts) AS BIGINT) AS day_of_week, CAST(hour(event_ts) AS BIGINT) AS hour_utc, count(*) AS txns, count(*) FILTER (WHERE is_flagged) AS alerts, round(100.0::DOUBLE * (count(*) FILTER (WHERE is_flagged) / count(*)), 3) AS alert_rate_pct FROM swipes, now WHERE event_ts >= t0 - INTERVAL 28 DAY GROUP BY 1, 2, 3""")
def weekday_hour_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts by weekday and hour; weekdays come from the calendar dimension, after summing by date."""
    at = newest(spark, sf_dir, "events", "ts")
    per = swipes(spark, sf_dir).where(F.col("event_ts") >= back(at, days=28)).groupBy(F.to_date("event_ts").alias("full_date"), F.hour("event_ts").cast("long").alias("hour_utc")).agg(F.count("*").alias("n"), count_if(F.col("is_flagged")).alias("flagged"))
    days = calendar(spark).select("full_date", "day_name", F.col("day_of_week").cast("long").alias("day_of_week"))
    grouped = per.join(days, "full_date").groupBy("day_name", "day_of_week", "hour_utc").agg(F.sum("n").alias("txns"), F.sum("flagged").alias("alerts"))
    return grouped.select("*", percent(F.col("alerts"), F.col("txns"), 3).alias("alert_rate_pct"))


VERSIONS = """changes AS (SELECT user_id, event_ts, transaction_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_ts, transaction_id) AS was FROM swipes), versions AS (SELECT user_id, event_type AS tier, event_ts AS valid_from, lead(event_ts) OVER (PARTITION BY user_id ORDER BY event_ts, transaction_id) AS valid_to FROM changes WHERE was IS NULL OR was <> event_type)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a card's tier: runs of one event type."""
    w = Window.partitionBy("user_id").orderBy("event_ts", "transaction_id")
    t = swipes(spark, sf_dir).select("user_id", "event_ts", "transaction_id", "event_type").withColumn("was", F.lag("event_type").over(w))
    starts = t.where("was IS NULL OR was <> event_type")
    return starts.select("user_id", F.col("event_type").alias("tier"), F.col("event_ts").alias("valid_from"), F.lead("event_ts").over(w).alias("valid_to"))


@query(f"""WITH {SWIPES}, {VERSIONS} SELECT v.user_id, tier, lead(tier) OVER (PARTITION BY v.user_id ORDER BY valid_from) AS next_tier, valid_from, valid_to, valid_to IS NULL AS is_current, count(transaction_id) AS txns, count(transaction_id) FILTER (WHERE is_flagged) AS alerts FROM versions v LEFT JOIN swipes s ON s.user_id = v.user_id AND s.event_ts >= valid_from AND (valid_to IS NULL OR s.event_ts < valid_to) WHERE v.user_id IN (SELECT user_id FROM versions GROUP BY 1 HAVING count(*) > 1) GROUP BY v.user_id, tier, valid_from, valid_to ORDER BY v.user_id, valid_from LIMIT 100""")
def scd2_tier_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards whose tier changed, with what happened under each version; facts find their version by time."""
    versions = _versions(spark, sf_dir)
    # Facts and version starts in one order: a fact belongs to the last start at or before it, so no interval join is needed.
    facts = swipes(spark, sf_dir).select("user_id", F.col("event_ts").alias("at"), "is_flagged", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("tier"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    starts = versions.select("user_id", F.col("valid_from").alias("at"), F.lit(None).cast("boolean").alias("is_flagged"), F.lit(0).alias("kind"), "tier", "valid_to")
    w = Window.partitionBy("user_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = facts.unionByName(starts).withColumn("v", F.last(F.when(F.col("kind") == 0, F.struct("tier", F.col("at").alias("valid_from"), "valid_to")), ignorenulls=True).over(w))
    per = both.groupBy("user_id", "v").agg(count_if(F.col("kind") == 1).alias("txns"), count_if((F.col("kind") == 1) & F.col("is_flagged")).alias("alerts")).select("user_id", "v.*", "txns", "alerts")
    named = per.select("user_id", "tier", F.lead("tier").over(Window.partitionBy("user_id").orderBy("valid_from")).alias("next_tier"), "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"), "txns", "alerts", F.count("*").over(Window.partitionBy("user_id")).alias("versions"))
    return named.where("versions > 1").drop("versions").orderBy("user_id", "valid_from").limit(100)


@query(f"""WITH {TELEMETRY} SELECT query_name, time_bucket(INTERVAL 5 MINUTE, progress_ts, TIMESTAMP '2000-01-01') AS bucket, count(*) AS batches, CAST(sum(num_input_rows) AS BIGINT) AS rows_processed, round(sum(num_input_rows) / 300.0::DOUBLE, 1) AS avg_rows_per_second, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY batch_duration_ms), 4) AS p50_ms, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY batch_duration_ms), 4) AS p95_ms, round(percentile_cont(0.99) WITHIN GROUP (ORDER BY batch_duration_ms), 4) AS p99_ms, round(100.0::DOUBLE * (count(*) FILTER (WHERE batch_duration_ms < 2000) / count(*)), 2) AS slo_pct FROM progress, now WHERE progress_ts >= t0 - INTERVAL 24 HOUR AND num_input_rows > 0 GROUP BY 1, 2""")
def pipeline_slo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency percentiles and the share of batches under two seconds, by query and five minutes."""
    at = newest(spark, sf_dir, "events", "ts")
    p = telemetry(spark, sf_dir).where((F.col("progress_ts") >= back(at, hours=24)) & (F.col("num_input_rows") > 0))
    cont = lambda q: F.round(F.expr(f"percentile_cont({q}) WITHIN GROUP (ORDER BY batch_duration_ms)"), 4)
    return p.groupBy("query_name", time_bucket(F.col("progress_ts"), "5 minutes").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("batches"), F.sum("num_input_rows").alias("rows_processed"), F.round(F.sum("num_input_rows") / F.lit(300.0), 1).alias("avg_rows_per_second"), cont(0.5).alias("p50_ms"), cont(0.95).alias("p95_ms"), cont(0.99).alias("p99_ms"), percent(count_if(F.col("batch_duration_ms") < 2000), F.count("*")).alias("slo_pct"))
