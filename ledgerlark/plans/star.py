"""The card star schema over the driver's tables, and the registry of named queries.

Transactions are line items with their orders (users are customers, merchants
suppliers, categories part types); returned items have fraud chargebacks, accepted ones
other disputes. ``events`` are the card stream: users' swipes at merchants by user id,
errors being fraud. Telemetry rows follow from events too. Every look-back counts from
the newest row, never from the clock.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import DISPUTE_REASONS, FRAUD_REASONS
from ..operators.keyed import marked


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name with its SQL twin."""

    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        key = name or build.__name__
        REGISTRY[key] = Query(key, build, sql)
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(14,2)")


def lines(spark: SparkSession, sf_dir: str, with_user: bool = False) -> DataFrame:
    """Transactions; the user costs a join with orders and is only there if asked for."""
    li = table(spark, sf_dir, "lineitem")
    made = {
        "transaction_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")),
        "event_ts": F.col("l_shipdate"),
        "merchant_key": F.col("l_suppkey"),
        "part_key": F.col("l_partkey"),
        "amount_usd": money("l_extendedprice"),
        "is_flagged": F.col("l_discount") >= 0.08,
        "score": F.round(F.col("l_discount") * 10, 2).cast("decimal(4,2)"),
        "flag": F.col("l_returnflag"),
        "quantity": F.col("l_quantity"),
        "discount": F.col("l_discount"),
        "tax": F.col("l_tax"),
    }
    if with_user:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        li = li.join(orders, li["l_orderkey"] == orders["o_orderkey"])
        made["user_key"] = F.col("o_custkey")
    return li.select(*[c.alias(n) for n, c in made.items()])


def chargebacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disputes: one for each returned or accepted item, a second one for some."""
    t = lines(spark, sf_dir).where(F.col("flag").isin("R", "A"))
    pick = F.pmod("part_key", F.lit(3))
    code = lambda a: F.when(pick == 0, a[0]).when(pick == 1, a[1]).otherwise(a[2])
    fraud, other = [c for c, _, f in DISPUTE_REASONS if f], [c for c, _, f in DISPUTE_REASONS if not f]
    suffixes = F.when((F.col("flag") == "R") & (F.col("part_key") % 10 == 0), F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return t.select(
        F.explode(suffixes).alias("suffix"), "transaction_id", "event_ts", "amount_usd",
        F.when(F.col("flag") == "R", code(fraud)).otherwise(code(other)).alias("reason_code"),
        (F.col("event_ts") + F.make_dt_interval(days=F.col("quantity").cast("int"))).alias("reported_ts"),
    ).select(F.concat_ws("/", "transaction_id", "suffix").alias("chargeback_id"), "transaction_id", "reason_code", "amount_usd", "reported_ts")


def fraud_chargebacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chargebacks(spark, sf_dir).where(F.col("reason_code").isin(*FRAUD_REASONS))


def labelled(spark: SparkSession, sf_dir: str, with_user: bool = False, since: datetime | None = None) -> DataFrame:
    """Transactions with is_fraud: whether a fraud chargeback exists (a mark join on distinct keys)."""
    t = lines(spark, sf_dir, with_user)
    return marked(t.where(F.col("event_ts") >= since) if since else t, fraud_chargebacks(spark, sf_dir), "transaction_id", "is_fraud")


def newest(spark: SparkSession, sf_dir: str, name: str = "lineitem", column: str = "l_shipdate") -> datetime:
    """The newest time of a table: a constant in later plans, so that look-backs reach the Parquet scan."""
    return table(spark, sf_dir, name).agg(F.max(column)).first()[0]


def back(at: datetime, **kw: float) -> Column:
    """A time before ``at``, without zone."""
    return F.lit(at - timedelta(**kw)).cast("timestamp_ntz")


def swipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as card swipes with made-up places."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("transaction_id"), F.col("ts").alias("event_ts"), F.col("user_id"),
        (F.col("user_id") % 25).alias("merchant_key"), money("value").alias("amount_usd"), "event_type", "value", "props",
        (F.col("event_type") == "error").alias("is_fraud"), (F.col("value") >= 150).alias("is_flagged"),
        ((F.col("event_id") * 7919) % 13_000 / 100.0 - 65).alias("lat"), ((F.col("event_id") * 104_729) % 36_000 / 100.0 - 180).alias("lon"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress rows of three streaming queries."""
    e = table(spark, sf_dir, "events")
    pick = F.col("user_id") % 3
    return e.select(
        F.when(pick == 0, "bronze_transactions").when(pick == 1, "silver_transactions").otherwise("gold_transactions").alias("query_name"),
        F.col("ts").alias("progress_ts"), F.floor("value").alias("num_input_rows"), F.floor(F.col("value") * 10).alias("batch_duration_ms"),
        (F.col("value") * 2).alias("processed_rows_per_second"), F.col("event_id").alias("state_rows_total"), (F.col("event_id") % 3).alias("rows_dropped_by_watermark"),
        (F.col("event_id") % 50).alias("max_offsets_behind_latest"), (F.col("ts") - F.expr("INTERVAL 10 MINUTES")).alias("watermark"), F.col("value").alias("load_seconds"),
    )


# ---- the same in SQL, for the twins

_FRAUD = "('10.1', '10.3', '10.4')"
FACT = """fact AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS transaction_id, l_shipdate AS event_ts, o_custkey AS user_key, l_suppkey AS merchant_key, l_partkey AS part_key, CAST(l_extendedprice AS DECIMAL(14,2)) AS amount_usd, l_discount >= 0.08 AS is_flagged, CAST(round(l_discount * 10, 2) AS DECIMAL(4,2)) AS score, l_returnflag AS flag, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey), now AS (SELECT max(l_shipdate) AS t0 FROM lineitem)"""
DISPUTES = """cb AS (SELECT transaction_id || '/' || s.x AS chargeback_id, transaction_id, event_ts, amount_usd, event_ts + to_days(CAST(floor(quantity) AS INTEGER)) AS reported_ts, CASE WHEN flag = 'R' THEN CASE part_key % 3 WHEN 0 THEN '10.1' WHEN 1 THEN '10.3' ELSE '10.4' END ELSE CASE part_key % 3 WHEN 0 THEN '12.6' WHEN 1 THEN '13.1' ELSE '13.3' END END AS reason_code FROM fact, (VALUES ('a'), ('b')) s(x) WHERE flag IN ('R', 'A') AND (s.x = 'a' OR (flag = 'R' AND part_key % 10 = 0)))"""
LABELLED = f"""labelled AS (SELECT f.*, EXISTS (SELECT 1 FROM cb WHERE cb.transaction_id = f.transaction_id AND cb.reason_code IN {_FRAUD}) AS is_fraud FROM fact f)"""
SWIPES = """swipes AS (SELECT event_id AS transaction_id, ts AS event_ts, user_id, user_id % 25 AS merchant_key, CAST(value AS DECIMAL(14,2)) AS amount_usd, event_type, value, props, event_type = 'error' AS is_fraud, value >= 150 AS is_flagged, (event_id * 7919) % 13000 / 100.0::DOUBLE - 65 AS lat, (event_id * 104729) % 36000 / 100.0::DOUBLE - 180 AS lon FROM events), now AS (SELECT max(ts) AS t0 FROM events)"""
TELEMETRY = """progress AS (SELECT CASE user_id % 3 WHEN 0 THEN 'bronze_transactions' WHEN 1 THEN 'silver_transactions' ELSE 'gold_transactions' END AS query_name, ts AS progress_ts, CAST(floor(value) AS BIGINT) AS num_input_rows, CAST(floor(value * 10) AS BIGINT) AS batch_duration_ms, value * 2 AS processed_rows_per_second, event_id AS state_rows_total, event_id % 3 AS rows_dropped_by_watermark, event_id % 50 AS max_offsets_behind_latest, ts - INTERVAL 10 MINUTE AS watermark, value AS load_seconds FROM events), now AS (SELECT max(ts) AS t0 FROM events)"""
REASONS = "reasons(reason_code, description, is_fraud) AS (VALUES " + ", ".join(f"('{c}', '{d}', {f})" for c, d, f in DISPUTE_REASONS) + ")"
