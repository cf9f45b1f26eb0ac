"""Nightly reconciliation of the lake with the warehouse."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_if
from ..functions.fixed_values import FRAUD_REASONS
from ..sources.tables import FACT_ALERTS, FACT_TRANSACTIONS, HOURLY_MERCHANTS, Warehouse
from .intake import reason_counts
from .keyed import first_by

RUN = "run_id string, run_date string, status string, started_at timestamp, ended_at timestamp, lake_rows long, missing long, orphans long, quarantined long, error string"


def missing(lake: DataFrame, warehouse: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Lake rows whose key the warehouse lacks."""
    return lake.join(warehouse.select(key), key, "left_anti")


def orphans(lake: DataFrame, warehouse: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Warehouse rows whose key the lake lacks."""
    return missing(warehouse, lake, key)


def one_per_transaction(chargebacks: DataFrame) -> DataFrame:
    """A transaction's first chargeback by id, so that a label doesn't depend on the order of rows."""
    return first_by(chargebacks, ["transaction_id"], [F.col("chargeback_id")])


def hourly_merchant_risk(gold: DataFrame, chargebacks: DataFrame) -> DataFrame:
    """Volume, flags, disputes and confirmed fraud of each merchant and hour; a transaction's first chargeback by id counts."""
    labels = one_per_transaction(chargebacks).select("transaction_id", F.lit(True).alias("is_disputed"), F.col("reason_code").isin(*FRAUD_REASONS).alias("is_fraud"), F.col("amount_usd").alias("disputed_usd"))
    joined = gold.join(labels, "transaction_id", "left")
    return joined.groupBy(F.date_trunc("hour", "event_ts").alias("hour_ts"), "date_key", "merchant_key", "mcc").agg(
        F.count("*").alias("txn_count"),
        F.sum("amount_usd").cast("decimal(16,2)").alias("total_amount_usd"),
        count_if(F.col("is_flagged")).alias("flagged_count"),
        count_if(F.col("is_fraud")).alias("fraud_count"),
        F.avg("fraud_score").cast("decimal(6,4)").alias("avg_fraud_score"),
        F.max("fraud_score").cast("decimal(6,4)").alias("max_fraud_score"),
        count_if(F.col("is_disputed")).alias("chargeback_count"),
        F.coalesce(F.sum("disputed_usd"), F.lit(0)).cast("decimal(16,2)").alias("chargeback_amount_usd"),
    )


def resolved_alerts(alerts: DataFrame, chargebacks: DataFrame, as_of: str, maturity_hours: float = 24) -> DataFrame:
    """Alerts with their status: a fraud chargeback confirms; open, mature and without any chargeback is a false positive.

    ``status_updated_at``, if there is such a column, becomes ``as_of`` where the status changes.
    """
    per = chargebacks.groupBy("transaction_id").agg(F.bool_or(F.col("reason_code").isin(*FRAUD_REASONS)).alias("__fraud"))
    joined = alerts.join(per, "transaction_id", "left")
    old = F.col("event_ts") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(maturity_hours).cast("int"))
    status = F.when(F.col("__fraud"), "CONFIRMED_FRAUD").when((F.col("status") == "OPEN") & old & F.col("__fraud").isNull(), "FALSE_POSITIVE").otherwise(F.col("status"))
    settled = joined.withColumn("__new", status)
    if "status_updated_at" in alerts.columns:
        settled = settled.withColumn("status_updated_at", F.when(F.col("__new") != F.col("status"), F.lit(as_of).cast("timestamp")).otherwise(F.col("status_updated_at")))
    return settled.withColumn("status", F.col("__new")).select(alerts.columns)


def changing(alerts: DataFrame, chargebacks: DataFrame, as_of: str, maturity_hours: float = 24) -> DataFrame:
    """Alerts whose status ``resolved_alerts`` changes."""
    after = resolved_alerts(alerts, chargebacks, as_of, maturity_hours).select("transaction_id", F.col("status").alias("__after"))
    return alerts.join(after, "transaction_id").where("status <> __after").select(alerts.columns)


def reconcile(warehouse: Warehouse, gold: DataFrame, quarantine: DataFrame, day: str, as_of: str, maturity_hours: float = 24, maintain: Callable[[], None] | None = None) -> dict:
    """A day's run: backfills what the warehouse lacks, counts orphans, recomputes hours, settles alerts, keeps an audit row.

    The audit row says FAILED with the error if a step raises, which is raised again.
    """
    run = {"run_id": uuid.uuid4().hex, "run_date": day, "started_at": datetime.now(UTC), "error": None, "lake_rows": None, "missing": None, "orphans": None, "quarantined": None}
    spark = warehouse.spark

    def audit(status: str) -> None:
        row = {**run, "status": status, "ended_at": datetime.now(UTC)}
        new = spark.createDataFrame([tuple(row[c.split()[0]] for c in RUN.split(", "))], RUN)
        warehouse.append("reconciliation_runs", new)

    try:
        mine = first_by(gold.where(F.col("event_date") == F.lit(day).cast("date")), ["transaction_id"], [F.col("event_ts"), F.col("kafka_partition"), F.col("kafka_offset")]).persist()
        theirs = warehouse.read(FACT_TRANSACTIONS.table, [day])
        run["lake_rows"] = mine.count()
        lacking = missing(mine, theirs).persist()
        run["missing"] = lacking.count()
        run["orphans"] = orphans(mine, theirs).count()
        if run["missing"]:
            named = lacking.withColumns({"currency_code": F.col("currency"), "txn_lat": F.col("location_lat"), "txn_lon": F.col("location_lon"), "status": F.lit("OPEN"), "created_at": F.current_timestamp(), "status_updated_at": F.lit(None).cast("timestamp")})
            warehouse.upsert(named, FACT_TRANSACTIONS)
            warehouse.upsert(named.where("is_flagged"), FACT_ALERTS)
        chargebacks = warehouse.read("fact_chargebacks")
        warehouse.upsert(hourly_merchant_risk(mine, chargebacks), HOURLY_MERCHANTS)
        if warehouse.exists(FACT_ALERTS.table):
            warehouse.update(FACT_ALERTS.table, lambda alerts: resolved_alerts(alerts, chargebacks, as_of, maturity_hours), lambda alerts: changing(alerts, chargebacks, as_of, maturity_hours))
        of_day = quarantine.where(F.col("quarantine_date") == F.lit(day).cast("date"))
        run["quarantined"] = of_day.count()
        run["reasons"] = {r["reason"]: r["records"] for r in reason_counts(of_day).collect()}
        if maintain:
            maintain()
        lacking.unpersist()
        mine.unpersist()
    except Exception as e:
        run["error"] = str(e)[:1000]
        audit("FAILED")
        raise
    audit("SUCCEEDED")
    return run
