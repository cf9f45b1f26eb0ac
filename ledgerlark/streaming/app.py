"""The streaming application: messages to bronze, silver and gold, and on to the warehouse."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from ..functions.fixed_values import FRAUD_REASONS
from ..operators.dimensions import Dimensions, enriched, sized
from ..operators.intake import parse_chargebacks, parse_transactions, quarantined, to_bronze, valid_chargebacks, valid_transactions
from ..operators.keyed import deduplicated, merchant_risk_windows
from ..operators.rules import RuleSet, load_rules, scored
from ..plans.contracts import BRONZE, CHARGEBACK, GOLD, QUARANTINE, TRANSACTION
from ..sources.logs import read_table_stream
from ..sources.tables import FACT_ALERTS, FACT_CHARGEBACKS, FACT_TRANSACTIONS, MERCHANT_WINDOWS, Store, Warehouse, append_batch, query_id
from .card_state import stateful_features

LAYERS = ("bronze", "silver", "gold")
#: The lake's tables: columns and the one that divides them by day.
LAKE = {
    "bronze_transactions": (BRONZE, "ingest_date"),
    "bronze_chargebacks": (BRONZE, "ingest_date"),
    "silver_transactions": (TRANSACTION, "event_date"),
    "silver_chargebacks": (StructType([*CHARGEBACK]).add("reported_date", "date"), "reported_date"),
    "quarantine_transactions": (QUARANTINE, "quarantine_date"),
    "quarantine_chargebacks": (QUARANTINE, "quarantine_date"),
    "gold_transactions": (GOLD, "event_date"),
}


def facts(gold: DataFrame) -> DataFrame:
    """Gold rows with the columns that the warehouse names otherwise, as new, open alerts have them."""
    made = {"currency_code": F.col("currency"), "txn_lat": F.col("location_lat"), "txn_lon": F.col("location_lon"), "status": F.lit("OPEN"), "created_at": F.current_timestamp(), "status_updated_at": F.lit(None).cast("timestamp")}
    return gold.withColumns(made)


def keyed_disputes(chargebacks: DataFrame, users: DataFrame) -> DataFrame:
    """Chargebacks with their user's key, -1 if there is none, and the warehouse's name of the currency."""
    known = chargebacks.join(sized(users.select("user_id", "user_key")), "user_id", "left")
    return known.withColumns({"user_key": F.coalesce("user_key", F.lit(-1)).cast("long"), "currency_code": F.col("currency")})


def confirmed(alerts: DataFrame, chargebacks: DataFrame) -> DataFrame:
    """Alerts, of which those with a fraud chargeback are confirmed, with the time of the change."""
    fraud = chargebacks.where(F.col("reason_code").isin(*FRAUD_REASONS)).select("transaction_id").distinct().withColumn("__fraud", F.lit(True))
    turns = F.coalesce(F.col("__fraud") & (F.col("status") != "CONFIRMED_FRAUD"), F.lit(False))
    changed = alerts.join(fraud, "transaction_id", "left").withColumns({"status": F.when(turns, "CONFIRMED_FRAUD").otherwise(F.col("status")), "status_updated_at": F.when(turns, F.current_timestamp()).otherwise(F.col("status_updated_at"))})
    return changed.select(alerts.columns)


@dataclass
class App:
    """Where the tables are and how the queries run. ``trigger`` are the arguments of ``DataStreamWriter.trigger``; ``slow_trigger``, if given, those of the gold layer."""

    spark: SparkSession
    lake: str
    warehouse: Warehouse
    dims: Callable[[], Dimensions]
    rules: RuleSet = field(default_factory=load_rules)
    trigger: dict = field(default_factory=lambda: {"availableNow": True})
    slow_trigger: dict | None = None
    watermark: str = "10 minutes"
    window: tuple[str, str] = ("5 minutes", "1 minute")
    idle_ms: int = 3_600_000
    most_bytes: str = "16m"

    def table(self, name: str) -> str:
        return f"{self.lake}/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.lake}/_checkpoints/{name}"

    def ensure(self) -> None:
        """Folders and tables that queries read before anything has been written to them."""
        store = Store(self.spark, self.lake)
        for name in LAKE:
            store.fs.mkdirs(store.path(self.table(name)))
        empty = facts(self.spark.createDataFrame([], GOLD))
        for spec in (FACT_TRANSACTIONS, FACT_ALERTS):
            self.warehouse.ensure(spec.table, empty.select(*spec.columns).schema, spec.day)
        disputes = self.spark.createDataFrame([], CHARGEBACK).withColumns({"user_key": F.lit(-1).cast("long"), "currency_code": F.col("currency")})
        self.warehouse.ensure(FACT_CHARGEBACKS.table, disputes.select(*FACT_CHARGEBACKS.columns).schema, FACT_CHARGEBACKS.day)

    def _writer(self, df: DataFrame, name: str, mode: str = "append") -> DataStreamWriter:
        layer = name.split("_")[0]
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", layer)
        trigger = self.slow_trigger if layer == "gold" and self.slow_trigger else self.trigger
        return df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", self.checkpoint(name)).trigger(**trigger)

    def _to_table(self, df: DataFrame, name: str, by: str) -> StreamingQuery:
        return self._writer(df, name).format("parquet").partitionBy(by).option("path", self.table(name)).start()

    def _from_table(self, name: str, schema) -> DataFrame:
        return read_table_stream(self.spark, self.table(name), schema, self.most_bytes)

    def bronze(self, logs: dict[str, DataFrame]) -> list[StreamingQuery]:
        """``logs``: a stream of log records for "transactions" and for "chargebacks"."""
        return [self._to_table(to_bronze(df), f"bronze_{topic}", "ingest_date") for topic, df in logs.items()]

    def silver(self) -> list[StreamingQuery]:
        """Valid rows without duplicates, and the rest with reasons; both topics have a quarantine."""
        made = []
        for topic, parse, valid, key, at, by in (("transactions", parse_transactions, valid_transactions, "transaction_id", "event_ts", "event_date"), ("chargebacks", parse_chargebacks, valid_chargebacks, "chargeback_id", "reported_ts", "reported_date")):
            rows = parse(self._from_table(f"bronze_{topic}", BRONZE))
            good = deduplicated(valid(rows), key, at, self.watermark)
            good = good if by in good.columns else good.withColumn(by, F.to_date(at))
            made.append(self._to_table(good, f"silver_{topic}", by))
            made.append(self._to_table(quarantined(rows), f"quarantine_{topic}", "quarantine_date"))
        return made

    def score(self, df: DataFrame) -> DataFrame:
        done = scored(enriched(df, self.dims()), self.rules).withColumn("processed_at", F.current_timestamp())
        return done.select(*[f.name for f in GOLD])

    def gold_batch(self, df: DataFrame, batch_id: int) -> None:
        """A batch to the lake, then facts and alerts. Each step can be repeated: a replay after a crash in between heals it."""
        rows = self.score(df).persist()
        try:
            if rows.isEmpty():
                return
            append_batch(rows, self.table("gold_transactions"), query_id(self.spark, self.checkpoint("gold_transactions")), batch_id, ("event_date",))
            new = facts(rows)
            self.warehouse.upsert(new, FACT_TRANSACTIONS)
            self.warehouse.upsert(new.where("is_flagged"), FACT_ALERTS)
        finally:
            rows.unpersist()

    def chargeback_batch(self, df: DataFrame, batch_id: int) -> None:
        """Chargebacks with their user's key; a fraud chargeback confirms the alert on its transaction, in the days that have such alerts."""
        rows = keyed_disputes(df, self.dims().users).persist()
        try:
            self.warehouse.upsert(rows, FACT_CHARGEBACKS)
            fraud = rows.where(F.col("reason_code").isin(*FRAUD_REASONS)).select("transaction_id")
            open_ = lambda alerts: alerts.where("status <> 'CONFIRMED_FRAUD'").join(fraud, "transaction_id", "left_semi")
            self.warehouse.update(FACT_ALERTS.table, lambda alerts: confirmed(alerts, rows), open_)
        finally:
            rows.unpersist()

    def gold(self) -> list[StreamingQuery]:
        features = stateful_features(self._from_table("silver_transactions", TRANSACTION), self.idle_ms, self.watermark)
        return [
            self._writer(features, "gold_transactions").foreachBatch(self.gold_batch).start(),
            self._writer(self._from_table("silver_chargebacks", CHARGEBACK), "gold_chargebacks").foreachBatch(self.chargeback_batch).start(),
        ]

    def windows(self) -> StreamingQuery:
        """Sliding windows over gold rows, upserted as they change."""
        rows = self.spark.readStream.schema(GOLD).option("recursiveFileLookup", "true").parquet(self.table("gold_transactions"))
        made = merchant_risk_windows(rows.withColumn("event_date", F.to_date("event_ts")), *self.window, self.watermark)
        return self._writer(made, "gold_windows", "update").foreachBatch(lambda df, _: self.warehouse.upsert(df, MERCHANT_WINDOWS)).start()

    def run(self, logs: dict[str, DataFrame], layers: Iterable[str] = LAYERS) -> None:
        """All layers, each to the end of what is there (for ``availableNow``); the first error is raised."""
        chosen = list(layers)
        if unknown := set(chosen) - set(LAYERS):
            raise ValueError(f"unknown layers: {sorted(unknown)}")
        self.ensure()
        steps: list[Callable[[], list[StreamingQuery]]] = []
        if "bronze" in chosen:
            steps.append(lambda: self.bronze(logs))
        if "silver" in chosen:
            steps.append(self.silver)
        if "gold" in chosen:
            steps += [self.gold, lambda: [self.windows()]]
        for start in steps:
            for query in start():
                query.awaitTermination()
                if query.exception():
                    raise query.exception()
