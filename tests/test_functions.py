import math

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import columns as C
from ledgerlark.functions.fixed_values import CATEGORIES, CITIES, DISPUTE_REASONS, USD_PER_UNIT
from ledgerlark.functions.sql import register


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) or v is None else 'string' if isinstance(v, str) else 'long'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_haversine_and_nulls(spark):
    km = C.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    assert abs(one(spark, km, a=40.7128, b=-74.006, c=51.5074, d=-0.1278) - 5570) < 10
    assert one(spark, km, a=10.0, b=20.0, c=10.0, d=20.0) == 0
    assert abs(one(spark, km, a=0.0, b=0.0, c=0.0, d=180.0) - math.pi * 6371.0088) < 1e-6
    for missing in "abcd":
        assert one(spark, km, **{k: None if k == missing else 1.0 for k in "abcd"}) is None


def test_speed_has_a_floor(spark):
    v = C.speed_kmh(F.col("km"), F.col("s"))
    assert one(spark, v, km=10.0, s=1.0) == pytest.approx(600) and one(spark, v, km=10.0, s=3600.0) == pytest.approx(10)
    assert one(spark, v, km=None, s=1.0) is None and one(spark, v, km=1.0, s=None) is None


def test_money(spark):
    usd = C.to_usd(F.col("a").cast("decimal(14,2)"), F.col("c"))
    assert float(one(spark, usd, a=100.0, c="EUR")) == 109.0 and float(one(spark, usd, a=20.0, c="GBP")) == 25.4
    assert one(spark, usd, a=1.0, c="XXX") is None


def test_time(spark):
    at = F.col("t").cast("timestamp")
    bucket = C.time_bucket(at, "5 minutes").cast("string")
    assert one(spark, bucket, t="2024-01-31 23:59:59") == "2024-01-31 23:55:00"
    assert one(spark, bucket, t="1999-12-31 23:58:00") == "1999-12-31 23:55:00"
    assert one(spark, C.date_key(at), t="2024-02-09 01:00:00") == 20240209
    assert C.duration_ms("10 minutes") == 600_000 and C.duration_ms("250ms") == 250 and C.duration_ms("2h") == 7_200_000
    assert C.byte_size("16m") == 16 << 20 and C.byte_size(77) == 77 and C.byte_size("1kb") == 1024
    for bad in ("soon", "10", "3 fortnights"):
        with pytest.raises(ValueError):
            C.duration_ms(bad)


def test_rates(spark):
    assert one(spark, C.ratio(F.col("a"), F.col("b")), a=1, b=0) is None
    assert one(spark, C.shrunk_rate(F.col("a"), F.col("n"), F.lit(0.01)), a=10, n=0) == pytest.approx(0.02)
    p, n, z = 0.1, 50, 1.96
    want = (p + z * z / (2 * n) - z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    assert one(spark, C.wilson_lower(F.col("a"), F.col("n")), a=5, n=50) == pytest.approx(want)


def test_fixed_values():
    assert (len(CITIES), len(CATEGORIES), len(USD_PER_UNIT), len(DISPUTE_REASONS)) == (36, 18, 17, 6)
    assert {c[4] for c in CITIES} <= set(USD_PER_UNIT) and abs(sum(c[3] for c in CATEGORIES) - 1) < 0.2


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT haversine_km(40.7128, -74.006, 51.5074, -0.1278) AS km, haversine_km(NULL, 1, 1, 1) AS none, to_date_key(TIMESTAMP '2024-02-09 01:00:00') AS k, date_bin_seconds(300, TIMESTAMP '2024-01-31 23:59:59') AS b, implied_speed_kmh(10, 1) AS v").first()
    assert abs(r.km - 5570) < 10 and r.none is None and r.k == 20240209 and str(r.b) == "2024-01-31 23:55:00" and r.v == pytest.approx(600)
