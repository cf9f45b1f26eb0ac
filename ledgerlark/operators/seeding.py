"""Seeds the warehouse's dimensions: reference tables, merchants (type 1), users (type 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import currencies, dispute_reasons, locations, merchant_categories
from ..sources.tables import FACT_TRANSACTIONS, Warehouse
from ..sources.traffic import Population
from .dimensions import Dimensions, calendar, merge_latest, merge_versions, row_hash, transactions_view

TRACKED = ["card_id", "city", "country_code", "home_lat", "home_lon", "card_tier", "segment", "has_chip_card"]
_USER = "user_id string, card_id string, city string, country_code string, home_lat double, home_lon double, card_tier string, segment string, has_chip_card boolean, opened_days int"
_MERCHANT = "merchant_id string, mcc string, city string, country_code string"


def _keyed(df: DataFrame, id_: str, key: str) -> DataFrame:
    """A surrogate key that depends on the row's identity only, so that a new run gives old rows their old keys."""
    return df.withColumn(key, F.xxhash64(*id_.split(",")).bitwiseAND(0x7FFFFFFFFFFFFFFF))


def seed(warehouse: Warehouse, people: Population, at: str, users: list[dict] | None = None) -> dict[str, tuple[int, int]]:
    """Writes all dimensions; returns (inserted, expired) of users and (inserted, updated) of merchants. A second run changes nothing."""
    spark = warehouse.spark
    for name, df in (("dim_location", locations(spark)), ("dim_merchant_category", merchant_categories(spark)), ("dim_currency", currencies(spark)), ("dim_dispute_reason", dispute_reasons(spark)), ("dim_date", calendar(spark))):
        warehouse.replace(name, df)
    columns = [c.split()[0] for c in _MERCHANT.split(", ")]
    merchants = spark.createDataFrame([tuple(m[c] for c in columns) for m in people.merchants], _MERCHANT)
    if not warehouse.exists("dim_merchants"):
        warehouse.replace("dim_merchants", merchants.limit(0))
    merged, counts = merge_latest(warehouse.read("dim_merchants"), merchants, "merchant_id", ["mcc", "city", "country_code"])
    told = {"merchants": tuple(counts.first())}
    warehouse.replace("dim_merchants", merged)
    columns = [c.split()[0] for c in _USER.split(", ")]
    seen = spark.createDataFrame([tuple(u[c] for c in columns) for u in users or people.users], _USER).withColumn("account_open_date", F.date_sub(F.to_date(F.lit(at)), F.col("opened_days"))).drop("opened_days")
    tracked = [*TRACKED, "account_open_date"]
    if not warehouse.exists("dim_users"):
        empty = seen.limit(0).withColumn("row_hash", row_hash(tracked)).withColumns({"valid_from": F.lit(None).cast("timestamp"), "valid_to": F.lit(None).cast("timestamp"), "is_current": F.lit(True)})
        warehouse.replace("dim_users", empty)
    # An account's age counts from when it is first seen; later runs keep the date.
    known = warehouse.read("dim_users").where("is_current").select("user_id", F.col("account_open_date").alias("__opened"))
    incoming = seen.join(known, "user_id", "left").withColumn("account_open_date", F.coalesce("__opened", "account_open_date")).drop("__opened")
    state, counts = merge_versions(warehouse.read("dim_users"), incoming, "user_id", tracked, at)
    told["users"] = tuple(counts.first())
    warehouse.replace("dim_users", state)
    return told


def current_dimensions(warehouse: Warehouse) -> Dimensions:
    """What scoring looks up: users' current versions, merchants with their tiers, places."""
    users = _keyed(warehouse.read("dim_users").where("is_current"), "user_id,valid_from", "user_key")
    merchants = _keyed(warehouse.read("dim_merchants").join(warehouse.read("dim_merchant_category"), "mcc", "left"), "merchant_id", "merchant_key")
    return Dimensions(users, merchants, warehouse.read("dim_location").where("location_key > 0"))


def enriched_transactions(warehouse: Warehouse) -> DataFrame:
    """The view ``transactions_view`` over the warehouse's tables; a fact keeps the version of its cardholder that it was scored with."""
    users = _keyed(warehouse.read("dim_users"), "user_id,valid_from", "user_key")
    merchants = _keyed(warehouse.read("dim_merchants"), "merchant_id", "merchant_key")
    return transactions_view(warehouse.read(FACT_TRANSACTIONS.table), warehouse.read("dim_date"), users, merchants, warehouse.read("dim_merchant_category"), warehouse.read("dim_location"))
