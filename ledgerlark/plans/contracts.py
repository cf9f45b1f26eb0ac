"""Declared schemas; nothing is inferred. Timestamps arrive as text so that bad ones get a reason."""

from __future__ import annotations

import re

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, DecimalType, DoubleType, IntegerType, LongType, StringType, StructType, TimestampType

_TYPES: dict[str, DataType] = {"string": StringType(), "int": IntegerType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType(), "date": DateType(), "timestamp": TimestampType(), "binary": BinaryType(), "array<string>": ArrayType(StringType()), "decimal(14,2)": DecimalType(14, 2)}


def _ddl(text: str) -> StructType:
    """A schema from "name type, ..."; Spark's own parser needs a session, which importing a module mustn't."""
    schema = StructType()
    for field in re.split(r",\s+", text):
        name, kind = field.split(" ", 1)
        schema = schema.add(name, _TYPES[kind])
    return schema


MONEY = "decimal(14,2)"
CORRUPT = "_corrupt_record"
WIRE_VERSIONS = (1,)

WIRE_TRANSACTION = _ddl(f"schema_version int, transaction_id string, event_ts string, user_id string, card_id string, merchant_id string, amount {MONEY}, currency string, channel string, entry_mode string, location_lat double, location_lon double, city string, country_code string")
WIRE_CHARGEBACK = _ddl(f"schema_version int, chargeback_id string, transaction_id string, user_id string, reason_code string, amount {MONEY}, currency string, reported_ts string")
LOG_RECORD = _ddl("key binary, value binary, topic string, partition int, offset long, timestamp timestamp")
BRONZE = _ddl("message_key string, raw_payload string, topic string, kafka_partition int, kafka_offset long, kafka_ts timestamp, ingest_ts timestamp, ingest_date date, ingest_hour int")
TRANSACTION = _ddl(f"transaction_id string, event_ts timestamp, event_date date, user_id string, card_id string, merchant_id string, amount {MONEY}, currency string, amount_usd {MONEY}, channel string, entry_mode string, location_lat double, location_lon double, city string, country_code string, kafka_partition int, kafka_offset long, kafka_ts timestamp")
CHARGEBACK = _ddl(f"chargeback_id string, transaction_id string, user_id string, reason_code string, amount {MONEY}, currency string, amount_usd {MONEY}, reported_ts timestamp, kafka_ts timestamp")
QUARANTINE = _ddl("raw_payload string, dq_errors array<string>, topic string, kafka_partition int, kafka_offset long, kafka_ts timestamp, quarantined_at timestamp, quarantine_date date")
CARD_FEATURES = _ddl("txn_count_1m int, txn_count_5m int, amount_usd_5m double, distinct_merchants_5m int, small_txn_count_5m int, seconds_since_prev double, km_from_prev double, implied_speed_kmh double, amount_zscore double, baseline_txn_per_min double, history_count long")
ENRICHMENT = _ddl("user_key long, merchant_key long, location_key int, date_key int, mcc string, category_risk_tier string, has_chip_card boolean, account_age_days int, distance_from_home_km double, fraud_score double, reason_codes array<string>, risk_level string, is_flagged boolean, rules_version string, processed_at timestamp")
GOLD = StructType([*TRANSACTION, *CARD_FEATURES, *ENRICHMENT])
PROGRESS = _ddl("run_id string, batch_id long, query_id string, query_name string, progress_ts timestamp, num_input_rows long, input_rows_per_second double, processed_rows_per_second double, batch_duration_ms long, trigger_execution_ms long, add_batch_ms long, get_batch_ms long, query_planning_ms long, wal_commit_ms long, watermark timestamp, state_rows_total long, state_memory_bytes long, rows_dropped_by_watermark long, max_offsets_behind_latest long, progress_json string")


def wire(schema: StructType) -> StructType:
    """A wire schema with the column that takes what can't be parsed."""
    return StructType([*schema]).add(CORRUPT, "string")
