"""Per-card features of each transaction from those before it, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import haversine_km, speed_kmh

# Fixed values, shared with the streaming operator.
SHORT_MS, LONG_MS = 60_000, 300_000
SMALL_USD = 5.0
LEAST_FOR_ZSCORE, LEAST_FOR_BASELINE = 5, 10
STD_FLOOR = 0.25
ALPHA, GAP_FLOOR_S, GAP_CEILING_S = 0.1, 1.0, 3600.0


#: Rows of a block of the running average: what lies two blocks back weighs less than a double's last bit.
_BLOCK = 256


def ewma(values: Column, alpha: float = ALPHA) -> Column:
    """Exponentially weighted mean of an array in order, beginning with its first value; null if empty."""
    step = lambda a, x: F.when(a.isNull(), x).otherwise(F.lit(alpha) * x + F.lit(1 - alpha) * a)
    return F.aggregate(values, F.lit(None).cast("double"), step)


def running_ewma(df: DataFrame, value: str, keys: list[str], order: list[str], into: str, alpha: float = ALPHA) -> DataFrame:
    """``df`` with the mean, up to each row, of ``value`` (null on a key's first row only) in time linear in the rows.

    With q = 1 - alpha the mean after row m is alpha * sum(q ** (m - i) * y(i)), y being the
    value, over alpha for the first. The sum is split by blocks of rows: within a block the
    terms y(i) * q ** -i are summed up cumulatively, and the sums of two whole blocks before
    suffice, as q ** 512 is 4e-24.
    """
    q = 1 - alpha
    all_ = Window.partitionBy(*keys)
    numbered = df.withColumn("__i", F.row_number().over(all_.orderBy(*order)) - 1)
    blocked = numbered.withColumns({"__b": F.floor(F.col("__i") / _BLOCK).cast("long"), "__j": F.col("__i") % _BLOCK})
    y = F.when(F.col("__i") == 1, F.col(value) / alpha).otherwise(F.col(value)) * F.pow(F.lit(1 / q), F.col("__j"))
    weighed = blocked.withColumn("__y", y)
    inside = Window.partitionBy(*keys, "__b").orderBy("__j").rowsBetween(Window.unboundedPreceding, 0)
    before = lambda k: F.coalesce(F.sum("__y").over(all_.orderBy("__b").rangeBetween(-k, -k)), F.lit(0.0)) * q ** (k * _BLOCK)
    mean = alpha * F.pow(F.lit(q), F.col("__j")) * (F.sum("__y").over(inside) + before(1) + before(2))
    return weighed.withColumn(into, F.when(F.col("__i") > 0, mean)).drop("__i", "__b", "__j", "__y")


def card_features(df: DataFrame, short_ms: int = SHORT_MS, long_ms: int = LONG_MS) -> DataFrame:
    """``df`` (user_id, transaction_id, event_ts, amount_usd, merchant_id, location_lat, location_lon) with the card features.

    Trailing windows are (ts - length, ts] with the row itself; of rows at the same
    millisecond only those up to it in (event_ts, transaction_id) order count. Baselines
    use prior rows only. Equals the streaming operator's result for rows in order, while
    neither its idle timeout nor its cap on buffered rows takes effect.

    A card's frame is one task's. Baselines are running sums, so time is linear in a card's
    rows, but for the trailing windows, whose rows are looked at again for each row.
    """
    ms = F.unix_millis(F.col("event_ts").cast("timestamp"))
    order = ["event_ts", "transaction_id"]
    card = Window.partitionBy("user_id")
    turn = card.orderBy(*order)
    prior = turn.rowsBetween(Window.unboundedPreceding, -1)
    base = df.withColumns({"__ms": ms, "__usd": F.col("amount_usd").cast("double")}).withColumn("__log", F.log(F.greatest("__usd", F.lit(0.01))))
    # Rows of the same millisecond that come later are in a range frame: those are taken off again.
    same = Window.partitionBy("user_id", "__ms").orderBy(*order)
    later = same.rowsBetween(1, Window.unboundedFollowing)
    span = lambda n: card.orderBy("__ms").rangeBetween(-(n - 1), 0)
    small = F.when(F.col("__usd") < SMALL_USD, 1).otherwise(0)
    count = lambda x, n: F.coalesce(F.sum(x).over(span(n)), F.lit(0)) - F.coalesce(F.sum(x).over(later), F.lit(0))
    seen = F.collect_list(F.struct("__ms", "event_ts", "transaction_id", "merchant_id")).over(span(long_ms))
    mine = F.struct("event_ts", "transaction_id")
    merchants = F.size(F.array_distinct(F.transform(F.filter(seen, lambda x: F.struct(x["event_ts"], x["transaction_id"]) <= mine), lambda x: x["merchant_id"])))
    before = lambda c: F.lag(c).over(turn)
    first = base.withColumns(
        {
            "txn_count_1m": count(F.lit(1), short_ms).cast("int"),
            "txn_count_5m": count(F.lit(1), long_ms).cast("int"),
            "amount_usd_5m": F.round(count(F.col("__usd"), long_ms), 2),
            "distinct_merchants_5m": merchants.cast("int"),
            "small_txn_count_5m": count(small, long_ms).cast("int"),
            "seconds_since_prev": (F.col("__ms") - before("__ms")) / 1000,
            "km_from_prev": F.when(before("__ms").isNotNull(), haversine_km(before("location_lat"), before("location_lon"), F.col("location_lat"), F.col("location_lon"))),
            "__n": F.count("*").over(prior),
            "__mean": F.avg("__log").over(prior),
            "__std": F.stddev_samp("__log").over(prior),
        }
    )
    gap = F.greatest(F.lit(GAP_FLOOR_S), F.least(F.lit(GAP_CEILING_S), F.col("seconds_since_prev")))
    second = first.withColumns(
        {
            "implied_speed_kmh": speed_kmh(F.col("km_from_prev"), F.col("seconds_since_prev")),
            "amount_zscore": F.when(F.col("__n") >= LEAST_FOR_ZSCORE, (F.col("__log") - F.col("__mean")) / F.greatest("__std", F.lit(STD_FLOOR))),
            "__gap": F.when(F.col("seconds_since_prev").isNotNull(), gap),
            "history_count": F.col("__n"),
        }
    )
    averaged = running_ewma(second, "__gap", ["user_id"], order, "__usual").withColumn("__usual", F.lag("__usual").over(turn))
    rate = F.when(F.col("__n") >= LEAST_FOR_BASELINE, F.lit(60.0) / F.nullif(F.col("__usual"), F.lit(0.0)))
    names = ["txn_count_1m", "txn_count_5m", "amount_usd_5m", "distinct_merchants_5m", "small_txn_count_5m", "seconds_since_prev", "km_from_prev", "implied_speed_kmh", "amount_zscore", "baseline_txn_per_min", "history_count"]
    return averaged.withColumn("baseline_txn_per_min", rate).select(*df.columns, *names)
