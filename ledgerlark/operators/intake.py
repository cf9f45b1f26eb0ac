"""From raw messages to typed, checked records and a quarantine.

Everything here works on batch and streaming frames alike.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import to_usd, usd_rate
from ..functions.fixed_values import CHANNELS, DISPUTE_REASONS
from ..plans.contracts import BRONZE, CHARGEBACK, CORRUPT, QUARANTINE, TRANSACTION, WIRE_CHARGEBACK, WIRE_TRANSACTION, WIRE_VERSIONS, wire

# Limits of plausible records.
MOST_AMOUNT = 1_000_000
FUTURE_SLACK = "5 minutes"
_REQUIRED_TRANSACTION = ("transaction_id", "event_ts", "user_id", "merchant_id", "amount", "currency")
_REQUIRED_CHARGEBACK = ("chargeback_id", "transaction_id", "user_id", "reason_code", "amount", "currency")


def to_bronze(log: DataFrame) -> DataFrame:
    """Log records as text; partition columns come from the log's own time, so that a replay lands in the same place."""
    taken = {
        "message_key": F.col("key").cast("string"),
        "raw_payload": F.col("value").cast("string"),
        "topic": F.col("topic"),
        "kafka_partition": F.col("partition"),
        "kafka_offset": F.col("offset"),
        "kafka_ts": F.col("timestamp"),
        "ingest_ts": F.current_timestamp(),
        "ingest_date": F.to_date("timestamp"),
        "ingest_hour": F.hour("timestamp"),
    }
    return log.select(*[taken[f.name].alias(f.name) for f in BRONZE])


def parsed(bronze: DataFrame, schema: StructType, checks: Mapping[str, Column], derived: Mapping[str, Column]) -> DataFrame:
    """Bronze columns, the payload's fields, ``derived`` ones, and dq_errors: the names of checks that hold, in order.

    Each text meets the parser a single time in the plan: ``from_json`` stands below a
    Generate node, and its fields are plain columns to everything above.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    fields = bronze.select("*", F.inline(F.array(F.from_json("raw_payload", wire(schema), options))))
    failed = [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]
    return fields.withColumns(dict(derived)).withColumn("dq_errors", F.array_compact(F.array(*failed)))


def _missing(names: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.col(n).isNull()
    return out


def parse_transactions(bronze: DataFrame, zero_amounts: bool = False) -> DataFrame:
    """Transactions with ``parsed_ts`` and up to nine reasons against each; an amount of 0 is one unless ``zero_amounts`` are let through."""
    at, amount = F.col("parsed_ts"), F.col("amount")
    checks = {
        "MALFORMED_JSON": F.col(CORRUPT).isNotNull(),
        "UNSUPPORTED_SCHEMA_VERSION": F.col("schema_version").isNull() | ~F.col("schema_version").isin(*WIRE_VERSIONS),
        "MISSING_REQUIRED_FIELD": _missing(_REQUIRED_TRANSACTION),
        "INVALID_TIMESTAMP": F.col("event_ts").isNotNull() & at.isNull(),
        "FUTURE_TIMESTAMP": at > F.col("kafka_ts") + F.expr(f"INTERVAL {FUTURE_SLACK}"),
        "INVALID_AMOUNT": (amount < 0 if zero_amounts else amount <= 0) | (amount > MOST_AMOUNT),
        "UNKNOWN_CURRENCY": F.col("currency").isNotNull() & usd_rate(F.col("currency")).isNull(),
        "INVALID_COORDINATES": ~F.col("location_lat").between(-90, 90) | ~F.col("location_lon").between(-180, 180),
        "INVALID_CHANNEL": F.col("channel").isNotNull() & ~F.col("channel").isin(*CHANNELS),
    }
    return parsed(bronze, WIRE_TRANSACTION, checks, {"parsed_ts": F.try_to_timestamp("event_ts")})


def parse_chargebacks(bronze: DataFrame) -> DataFrame:
    """Chargebacks with ``parsed_ts`` and up to six reasons; versions and large amounts aren't checked, and absent times and currencies are invalid."""
    codes = [code for code, _, _ in DISPUTE_REASONS]
    checks = {
        "MALFORMED_JSON": F.col(CORRUPT).isNotNull(),
        "MISSING_REQUIRED_FIELD": _missing(_REQUIRED_CHARGEBACK),
        "INVALID_TIMESTAMP": F.col("parsed_ts").isNull(),
        "UNKNOWN_REASON_CODE": ~F.col("reason_code").isin(*codes),
        "INVALID_AMOUNT": F.col("amount") <= 0,
        "UNKNOWN_CURRENCY": usd_rate(F.col("currency")).isNull(),
    }
    return parsed(bronze, WIRE_CHARGEBACK, checks, {"parsed_ts": F.try_to_timestamp("reported_ts")})


def _valid(parsed_rows: DataFrame, contract: StructType, made: Mapping[str, Column]) -> DataFrame:
    return parsed_rows.where(F.size("dq_errors") == 0).select(*[made.get(f.name, F.col(f.name)).alias(f.name) for f in contract])


def valid_transactions(parsed_rows: DataFrame) -> DataFrame:
    """The transaction contract, of rows without reasons against them."""
    at = F.col("parsed_ts")
    return _valid(parsed_rows, TRANSACTION, {"event_ts": at, "event_date": F.to_date(at), "currency": F.upper("currency"), "country_code": F.upper("country_code"), "amount_usd": to_usd(F.col("amount"), F.upper("currency"))})


def valid_chargebacks(parsed_rows: DataFrame) -> DataFrame:
    """The chargeback contract, of rows without reasons against them."""
    return _valid(parsed_rows, CHARGEBACK, {"currency": F.upper("currency"), "amount_usd": to_usd(F.col("amount"), F.upper("currency")), "reported_ts": F.col("parsed_ts")})


def quarantined(parsed_rows: DataFrame) -> DataFrame:
    """The other rows with their payload and reasons; for chargebacks as well as for transactions."""
    made = {"quarantined_at": F.current_timestamp(), "quarantine_date": F.current_date()}
    return parsed_rows.where(F.size("dq_errors") > 0).select(*[made.get(f.name, F.col(f.name)).alias(f.name) for f in QUARANTINE])


def reason_counts(quarantine: DataFrame) -> DataFrame:
    """(reason, records): a record counts once for each of its reasons."""
    return quarantine.select(F.explode("dq_errors").alias("reason")).groupBy("reason").agg(F.count("*").alias("records"))
