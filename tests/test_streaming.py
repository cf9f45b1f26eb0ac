import json
import os
from datetime import UTC, datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions.fixed_values import CATEGORIES, locations
from ledgerlark.operators.card_features import card_features
from ledgerlark.operators.dimensions import Dimensions, enriched
from ledgerlark.operators.intake import parse_transactions, valid_transactions
from ledgerlark.operators.keyed import deduplicated, time_windows
from ledgerlark.operators.rules import CONDITIONS, load_rules, scored
from ledgerlark.plans.contracts import QUARANTINE, TRANSACTION
from ledgerlark.sources.logs import read_drops
from ledgerlark.sources.tables import FACT_ALERTS, FACT_CHARGEBACKS, FACT_TRANSACTIONS, MERCHANT_WINDOWS, Warehouse
from ledgerlark.sources.traffic import Population, drop_files, transactions, upgraded
from ledgerlark.streaming.app import App
from ledgerlark.streaming.card_state import stateful_features
from ledgerlark.streaming.progress import ProgressListener, progress_rows

SCHEMA = "transaction_id string, user_id string, event_ts timestamp, amount_usd double"


def drop(folder, name, rows):
    temporary = folder / f".{name}"
    temporary.write_text("\n".join(json.dumps(r) for r in rows))
    os.rename(temporary, folder / f"{name}.json")


def event(tid, at, usd=10.0):
    return {"transaction_id": tid, "user_id": "u", "event_ts": f"2026-09-24T{at}Z", "amount_usd": usd}


def test_duplicates_go_across_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    stream = deduplicated(spark.readStream.schema(SCHEMA).json(str(folder)), "transaction_id", "event_ts")
    q = stream.writeStream.format("memory").queryName("dups").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        drop(folder, "a", [event("a", "10:00:00"), event("b", "10:01:00"), event("a", "10:00:00")])
        q.processAllAvailable()
        drop(folder, "b", [event("a", "10:00:00"), event("c", "10:02:00")])
        q.processAllAvailable()
        assert sorted(r.transaction_id for r in spark.table("dups").collect()) == ["a", "b", "c"]
    finally:
        q.stop()


def test_windows_close_and_late_rows_are_counted(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    made = time_windows(spark.readStream.schema(SCHEMA).json(str(folder)), ["user_id"], "event_ts", "5 minutes", "1 minute", [F.count("*").alias("n"), F.sum("amount_usd").alias("usd")], "2 minutes")
    q = made.writeStream.format("memory").outputMode("append").queryName("wins").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        drop(folder, "a", [event("a", "10:00:30"), event("b", "10:01:30"), event("c", "10:02:30")])
        q.processAllAvailable()
        assert spark.table("wins").count() == 0
        drop(folder, "b", [event("d", "10:20:00")])
        q.processAllAvailable()
        drop(folder, "c", [event("late", "10:01:00", 999.0), event("e", "10:20:30")])
        q.processAllAvailable()
        got = {r.window_start.strftime("%H:%M"): (r.n, r.usd) for r in spark.table("wins").collect()}
        assert got["10:00"] == (3, 30.0) and got["10:01"] == (2, 20.0) and got["09:56"] == (1, 10.0) and "10:16" not in got
        assert sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in json.loads(p.json)["stateOperators"]) >= 1
    finally:
        q.stop()


def silver(tid, at, lat, lon):
    return {"transaction_id": tid, "event_ts": f"2026-09-24T{at}Z", "event_date": "2026-09-24", "user_id": "u", "merchant_id": "m", "amount": 10.0, "currency": "USD", "amount_usd": 10.0, "location_lat": lat, "location_lon": lon}


def test_card_state_lasts_across_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    made = stateful_features(spark.readStream.schema(TRANSACTION).json(str(folder)))
    q = made.writeStream.format("memory").queryName("cards").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        drop(folder, "a", [silver("t1", "10:00:00", 40.7, -74.0), silver("t2", "10:00:30", 40.7, -74.0)])
        q.processAllAvailable()
        drop(folder, "b", [silver("t3", "10:05:10", 51.5, -0.1)])
        q.processAllAvailable()
        rows = {r.transaction_id: r for r in spark.table("cards").collect()}
        assert rows["t2"].txn_count_1m == 2 and rows["t3"].history_count == 2 and rows["t3"].txn_count_5m == 2
        assert rows["t3"].seconds_since_prev == 280 and rows["t3"].implied_speed_kmh > 50_000
        assert float(rows["t3"].amount_usd) == 10.0 and rows["t3"].currency == "USD" and list(rows["t3"].asDict())[: len(TRANSACTION)] == TRANSACTION.names
    finally:
        q.stop()


def test_traffic_is_deterministic(tmp_path):
    people = Population.make(50, 20)
    start = datetime(2026, 1, 1, tzinfo=UTC)
    one, two = list(transactions(people, start, 3000, fraud=0.05)), list(transactions(people, start, 3000, fraud=0.05))
    assert one == two and people == Population.make(50, 20)
    topics = [t for _, t, _, _ in one]
    payloads = [p for _, t, _, p in one if t == "transactions"]
    assert topics.count("chargebacks") > 50 and len(payloads) > len(set(payloads)) > 2900
    assert sum(a != b for a, b in zip(people.users, upgraded(people.users, 10), strict=True)) == 10


@pytest.fixture
def app(spark, tmp_path):
    people = Population.make(40, 15)
    counts = drop_files(transactions(people, datetime(2026, 1, 1, tzinfo=UTC), 1500, rate=20, fraud=0.08), str(tmp_path / "drops"), files=2)
    users = spark.createDataFrame([(k, u["user_id"], u["home_lat"], u["home_lon"], u["has_chip_card"]) for k, u in enumerate(people.users, 1)], "user_key long, user_id string, home_lat double, home_lon double, has_chip_card boolean").withColumn("account_open_date", F.to_date(F.lit("2020-01-01")))
    merchants = spark.createDataFrame([(k, m["merchant_id"], m["mcc"], "LOW") for k, m in enumerate(people.merchants, 1)], "merchant_key long, merchant_id string, mcc string, category_risk_tier string")
    made = App(spark, str(tmp_path / "lake"), Warehouse(spark, str(tmp_path / "dw")), lambda: Dimensions(users, merchants, locations(spark)))
    return made, counts, {t: read_drops(spark, str(tmp_path / "drops" / t), t) for t in counts}


def test_from_drops_to_the_warehouse(spark, app):
    made, counts, logs = app
    made.run(logs)
    bronze = spark.read.parquet(made.table("bronze_transactions"))
    good, bad = spark.read.parquet(made.table("silver_transactions")), spark.read.schema(QUARANTINE).parquet(made.table("quarantine_transactions"))
    assert bronze.count() == counts["transactions"]
    distinct = bronze.join(bad.select("raw_payload").distinct(), "raw_payload", "left_anti").select("raw_payload").distinct().count()
    assert good.count() == distinct == good.select("transaction_id").distinct().count()
    facts = made.warehouse.read(FACT_TRANSACTIONS.table)
    assert facts.count() == good.count() and facts.where("user_key = -1 OR merchant_key = -1").count() == 0
    alerts = made.warehouse.read(FACT_ALERTS.table)
    assert alerts.count() == facts.where("is_flagged").count() > 0
    assert made.warehouse.read(FACT_CHARGEBACKS.table).count() == counts["chargebacks"]
    windows = made.warehouse.read(MERCHANT_WINDOWS.table)
    assert windows.agg(F.sum("txn_count")).first()[0] == 5 * facts.count() and windows.groupBy("merchant_key", "window_start").count().where("count > 1").count() == 0
    before = facts.count()
    made.run(logs)  # nothing new: nothing changes
    assert made.warehouse.read(FACT_TRANSACTIONS.table).count() == before


def test_unknown_layers_are_errors(app):
    with pytest.raises(ValueError):
        app[0].run({}, ["bronze", "platinum"])


DOC = {"id": "q", "runId": "r", "name": "gold", "timestamp": "2026-09-24T10:00:00.000Z", "batchId": 3, "batchDuration": 1200, "numInputRows": 10, "inputRowsPerSecond": "NaN", "processedRowsPerSecond": 8.5, "durationMs": {"triggerExecution": 1200, "addBatch": 900}, "eventTime": {"watermark": "1970-01-01T00:00:00.000Z"}, "stateOperators": [{"numRowsTotal": 4, "memoryUsedBytes": 100, "numRowsDroppedByWatermark": 2}, {"numRowsTotal": 1}], "sources": [{"metrics": {"maxOffsetsBehindLatest": "17"}}, {"metrics": None}]}


def test_progress_rows(spark):
    bare = {"id": "q", "runId": "r", "timestamp": "2026-09-24T10:00:00Z", "batchId": 0, "numInputRows": 1, "sources": [{"metrics": None}]}
    idle = {**DOC, "numInputRows": 0, "stateOperators": []}
    texts = [json.dumps(d) for d in (DOC, bare, idle)] + ["no json", "", "{}"]
    r, b = progress_rows(spark.createDataFrame([(t,) for t in texts], "doc string")).orderBy("batch_id", ascending=False).collect()
    assert (r.query_name, r.batch_id, r.state_rows_total, r.rows_dropped_by_watermark, r.max_offsets_behind_latest) == ("gold", 3, 5, 2, 17)
    assert r.watermark is None and r.input_rows_per_second is None and r.processed_rows_per_second == 8.5 and r.get_batch_ms is None and r.add_batch_ms == 900
    assert r.progress_ts == datetime(2026, 9, 24, 10) and json.loads(r.progress_json) == DOC
    assert b.query_name == "q" and b.state_rows_total is None and b.max_offsets_behind_latest is None and b.num_input_rows == 1


def test_the_listener_keeps_what_a_failing_sink_was_given():
    got, failures = [], [RuntimeError("down")]

    def sink(texts):
        if failures:
            raise failures.pop()
        got.extend(texts)

    listener = ProgressListener(sink, seconds=3600, most=3)
    for k in range(5):
        listener.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(json=str(k))))
    listener.onQueryProgress(None)  # never raises into Spark
    with pytest.warns(UserWarning):
        assert listener.flush() is False
    assert got == [] and listener.flush() and got == ["2", "3", "4"]
    listener.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(json="5")))
    listener.close()
    assert got == ["2", "3", "4", "5"]


def test_all_layers_start_on_an_empty_lake(spark, tmp_path):
    drops = tmp_path / "drops"
    for t in ("transactions", "chargebacks"):
        (drops / t).mkdir(parents=True)
    users = spark.createDataFrame([], "user_key long, user_id string, home_lat double, home_lon double, has_chip_card boolean, account_open_date date")
    merchants = spark.createDataFrame([], "merchant_key long, merchant_id string, mcc string, category_risk_tier string")
    made = App(spark, str(tmp_path / "lake"), Warehouse(spark, str(tmp_path / "dw")), lambda: Dimensions(users, merchants, locations(spark)))
    logs = {t: read_drops(spark, str(drops / t), t) for t in ("transactions", "chargebacks")}
    made.ensure()
    started = [*made.bronze(logs), *made.silver(), *made.gold(), made.windows()]
    for q in started:
        q.awaitTermination()
        assert q.exception() is None
    assert made.warehouse.read(FACT_TRANSACTIONS.table).count() == made.warehouse.read(FACT_ALERTS.table).count() == 0
    drop(drops / "transactions", "a", [{"key": "u", "value": json.dumps(event("t1", "10:00:00")), "timestamp": "2026-09-24T10:00:00Z", "partition": 0, "offset": 0}])
    made.run(logs)  # a broken first message: gold stays empty
    assert spark.read.parquet(made.table("quarantine_transactions")).count() == 1 and made.warehouse.read(FACT_TRANSACTIONS.table).count() == 0


def test_each_rule_fires_on_generated_traffic(spark, tmp_path):
    people = Population.make(400, 150)
    begin = datetime(2026, 1, 1, tzinfo=UTC)
    drop_files(transactions(people, begin, 6000, rate=2, fraud=0.05), str(tmp_path))
    raw = spark.read.json(str(tmp_path / "transactions")).select(F.lit("t").alias("topic"), F.col("value").alias("raw_payload"), F.col("timestamp").cast("timestamp").alias("kafka_ts"), F.col("partition").cast("int").alias("kafka_partition"), F.col("offset").alias("kafka_offset"))
    users = spark.createDataFrame([(k, u["user_id"], u["home_lat"], u["home_lon"], u["has_chip_card"], begin.date() - timedelta(days=u["opened_days"])) for k, u in enumerate(people.users, 1)], "user_key long, user_id string, home_lat double, home_lon double, has_chip_card boolean, account_open_date date")
    tiers = {c[0]: c[2] for c in CATEGORIES}
    merchants = spark.createDataFrame([(k, m["merchant_id"], m["mcc"], tiers[m["mcc"]]) for k, m in enumerate(people.merchants, 1)], "merchant_key long, merchant_id string, mcc string, category_risk_tier string")
    good = deduplicated(valid_transactions(parse_transactions(raw)), "transaction_id", "event_ts")
    done = scored(enriched(card_features(good), Dimensions(users, merchants, locations(spark))), load_rules())
    fired = {r.reason: r.n for r in done.select(F.explode("reason_codes").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert set(fired) == set(CONDITIONS)
    told = spark.read.json(str(tmp_path / "chargebacks")).count()
    assert done.where("is_flagged").count() > 100 and told > 300
