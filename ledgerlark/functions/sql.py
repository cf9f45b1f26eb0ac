"""The column functions under names for SQL text; they are expanded into plans, not called."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .fixed_values import EARTH_RADIUS_KM

_CHORD = "sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))"
FUNCTIONS = {
    "haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)": ("DOUBLE", f"asin(CASE WHEN {_CHORD} > 1 THEN 1D ELSE {_CHORD} END) * {2 * EARTH_RADIUS_KM}D"),
    "to_date_key(at TIMESTAMP)": ("INT", "year(at) * 10000 + month(at) * 100 + day(at)"),
    "date_bin_seconds(every BIGINT, at TIMESTAMP)": ("TIMESTAMP", "timestamp_micros(unix_micros(at) - pmod(unix_micros(at) - 946684800000000, every * 1000000))"),
    "implied_speed_kmh(km DOUBLE, seconds DOUBLE)": ("DOUBLE", "km / (CASE WHEN seconds < 60 THEN 60 ELSE seconds END / 3600)"),
}


def register(spark: SparkSession) -> None:
    """Makes FUNCTIONS known to the session."""
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
