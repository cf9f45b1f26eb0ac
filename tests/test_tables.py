import threading
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators.dimensions import calendar, merge_latest, merge_versions, row_hash, sized
from ledgerlark.operators.keyed import deduplicated, islands, marked, merchant_risk_windows, valid_at
from ledgerlark.operators.reconcile import hourly_merchant_risk, one_per_transaction, reconcile, resolved_alerts
from ledgerlark.operators.keyed import first_by
from ledgerlark.plans.contracts import BRONZE, GOLD, QUARANTINE
from ledgerlark.plans.kpis import globally_ranked
from ledgerlark.sources.logs import hour_slices, read_day, read_query, read_slices, series
from ledgerlark.sources.tables import FACT_ALERTS, FACT_TRANSACTIONS, HOURLY_MERCHANTS, Upsert, Warehouse, append_batch, compact_day, lake_day

T = datetime(2026, 9, 24, 10)


def test_upserts_can_be_repeated(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    ignore, update = Upsert("i", ("k", "v"), ("k",)), Upsert("u", ("k", "v"), ("k",), ("v",), "touched")
    for _ in range(2):
        w.upsert(batch, ignore)
        w.upsert(batch, update)
    newer = spark.createDataFrame([(2, "B"), (3, None)], "k int, v string")
    w.upsert(newer, ignore)
    w.upsert(newer, update)
    assert sorted(map(tuple, w.read("i").collect())) == [(1, "a"), (2, "b"), (3, None)]
    got = {r.k: r.v for r in w.read("u").collect()}
    assert got == {1: "a", 2: "B", 3: None} and w.read("u").where("touched IS NULL").count() == 0
    with pytest.raises(FileNotFoundError):
        w.read("none")


def test_ensure_makes_an_empty_nullable_table_once(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    w.ensure("b", BRONZE)
    w.replace("b", w.read("b").unionByName(spark.createDataFrame([tuple([None] * len(BRONZE))], BRONZE)))
    w.ensure("b", BRONZE)
    assert w.read("b").count() == 1


def test_appends_are_exactly_once_and_land_in_their_day(spark, tmp_path):
    df = spark.createDataFrame([(1, "2026-01-01"), (2, "2031-05-05")], "k int, d string").withColumn("event_date", F.to_date("d"))
    for _ in range(2):
        append_batch(df, str(tmp_path), "q", 0, ("event_date",))
    append_batch(df.limit(0), str(tmp_path), "q", 1, ("event_date",))
    assert spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path)).count() == 2
    late = read_day(spark, f"{tmp_path}/app=q/batch=0", "2031-05-05")
    assert [r.k for r in late.collect()] == [2]
    assert "PartitionFilters: [isnotnull(event_date" in late._jdf.queryExecution().executedPlan().toString()


DAYS = Upsert("d", ("k", "at", "v"), ("k", "at"), ("v",), day="at")


def _dated(spark, rows):
    return spark.createDataFrame([(k, datetime(2026, 1, d), v) for k, d, v in rows], "k int, at timestamp, v string")


def test_upserts_touch_their_days_only(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    w.upsert(_dated(spark, [(1, 1, "a"), (2, 2, "b"), (3, 3, "c")]), DAYS)
    before = w.version("d").segments
    w.upsert(_dated(spark, [(2, 2, "B"), (4, 2, "d")]), DAYS)
    after = w.version("d").segments
    assert after["2026-01-01"] == before["2026-01-01"] and after["2026-01-03"] == before["2026-01-03"] and after["2026-01-02"] != before["2026-01-02"]
    assert sorted((r.k, r.v) for r in w.read("d").collect()) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    assert [r.k for r in w.read("d", ["2026-01-03", "2026-01-09"]).collect()] == [3]
    ignore = Upsert("i", ("k", "at", "v"), ("k", "at"), day="at")
    for v in "ab":
        w.upsert(_dated(spark, [(1, 1, v)]), ignore)
    w.upsert(_dated(spark, [(1, 2, "a")]), ignore)
    assert len(w.version("i").segments["2026-01-01"]) == 1 and w.read("i").count() == 2
    w.upsert(_dated(spark, []), ignore)
    w.upsert(spark.createDataFrame([(9, None, "z")], "k int, at timestamp, v string"), ignore)
    assert w.read("i").where("at IS NULL").count() == 1


def test_the_first_of_equal_keys_counts_in_any_order(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    rows = [(1, 1, v) for v in "cab"]
    for name, some in (("x", rows), ("y", rows[::-1])):
        w.upsert(_dated(spark, some).repartition(3), Upsert(name, ("k", "at", "v"), ("k", "at"), day="at"))
    assert w.read("x").first().v == w.read("y").first().v == "a"


@pytest.mark.parametrize("update", [(), ("v",)])
def test_writers_beside_each_other_lose_nothing(spark, tmp_path, update):
    w, failed = Warehouse(spark, str(tmp_path)), []
    spec = Upsert("t", ("k", "at", "v"), ("k", "at"), update, day="at")

    def write(side):
        try:
            for n in range(4):
                w.upsert(_dated(spark, [(10 * n + side, 1 + n % 2, f"{side}"), (100 + n, 3, "both")]), spec)
                assert w.read("t").count() > 0
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert sorted(r.k for r in w.read("t").collect()) == sorted([10 * n + k for n in range(4) for k in range(2)] + [100 + n for n in range(4)])


def test_a_crash_before_publishing_changes_nothing(spark, tmp_path, monkeypatch):
    w = Warehouse(spark, str(tmp_path))
    w.upsert(_dated(spark, [(1, 1, "a")]), DAYS)
    monkeypatch.setattr(w.store, "publish", lambda *a: (_ for _ in ()).throw(OSError("power")))
    with pytest.raises(OSError):
        w.upsert(_dated(spark, [(1, 1, "b"), (2, 2, "b")]), DAYS)
    monkeypatch.undo()
    assert [r.v for r in w.read("d").collect()] == ["a"]
    assert w.vacuum("d", 1) == 0 and w.vacuum("d", -1) == 1 and w.read("d").count() == 1
    w.upsert(_dated(spark, [(2, 2, "c")]), DAYS)
    assert w.read("d").count() == 2


def test_compaction_and_vacuum_of_a_versioned_table(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    spec = Upsert("t", ("k", "at", "v"), ("k", "at"), day="at")
    for n in range(3):
        w.upsert(_dated(spark, [(n, 1, "a"), (n, 2, "a")]), spec)
    old = w.read("t")
    assert w.compact("t", ["2026-01-01"]) == 3 and w.compact("t", ["2026-01-01"]) == 0
    assert len(w.version("t").segments["2026-01-01"]) == 1 and len(w.version("t").segments["2026-01-02"]) == 3
    assert old.count() == w.read("t").count() == 6  # readers of the old version go on
    # The folders of batches stay: they hold the other day as well.
    assert w.vacuum("t", 1) == 0 and w.vacuum("t", -1) == 0 and w.compact("t") == 3 and w.vacuum("t", -1) == 3
    assert w.read("t").count() == 6 and w.exists("t") and not w.exists("none")


def test_days_of_stream_written_tables_are_compacted(spark, tmp_path):
    source, path, copies = tmp_path / "in", str(tmp_path / "lake" / "t"), Warehouse(spark, str(tmp_path / "copies"))
    schema = spark.createDataFrame([], "k long, event_date date").schema
    rows = lambda a, b: spark.range(a, b).selectExpr("id AS k", "date_add(DATE'2026-01-01', cast(id % 2 as int)) AS event_date")

    def arrive(a, b):
        rows(a, b).repartition(4).write.mode("append").parquet(str(source))
        q = spark.readStream.schema(schema).parquet(str(source)).writeStream.format("parquet").partitionBy("event_date").option("path", path).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    arrive(0, 30)
    assert compact_day(spark, path, schema, "event_date", "2026-01-01", copies) > 1
    arrive(30, 40)
    day = lake_day(spark, path, schema, "event_date", "2026-01-01", copies)
    assert sorted(r.k for r in day.collect()) == list(range(0, 40, 2)) and {r.event_date for r in day.collect()} == {date(2026, 1, 1)}
    assert lake_day(spark, path, schema, "event_date", "2026-01-02", copies).count() == 20
    assert spark.read.parquet(path).count() == 40  # the table itself stays readable
    compact_day(spark, path, schema, "event_date", "2026-01-01", copies)
    assert lake_day(spark, path, schema, "event_date", "2026-01-01", copies).count() == 20 and copies.vacuum("t", -1) == 1
    assert lake_day(spark, path, schema, "event_date", "2026-01-01", copies).count() == 20


def test_days_of_batches_are_pruned(spark, tmp_path):
    path, copies = str(tmp_path / "g"), Warehouse(spark, str(tmp_path / "copies"))
    schema = spark.createDataFrame([], "k long, event_date date").schema
    for n in range(2):
        append_batch(spark.range(10).selectExpr("id AS k", "date_add(DATE'2026-01-01', cast(id % 2 as int)) AS event_date"), path, "q", n, ("event_date",))
    day = lake_day(spark, path, schema, "event_date", "2026-01-02", copies)
    assert day.columns == ["k", "event_date"] and day.count() == 10
    assert "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().executedPlan().toString()
    assert compact_day(spark, path, schema, "event_date", "2026-01-02", copies) >= 2
    assert lake_day(spark, path, schema, "event_date", "2026-01-02", copies).count() == 10


def test_global_ranks_with_a_heavy_tie(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id < 900 THEN 7.0 ELSE CAST(id AS DOUBLE) END AS v", "id")
    got = [(r["rank"], r["all"]) for r in globally_ranked(df, ["v", "id"]).orderBy("v", "id").collect()]
    assert got == [(k, 1000) for k in range(1, 1001)]
    assert globally_ranked(df.limit(0), ["v", "id"]).count() == 0


def test_first_by(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (2, None)], "k int, v int")
    assert sorted((r.k, r.v) for r in first_by(df, ["k"], [F.col("v")]).collect()) == [(1, 1), (2, None)]


def test_versions_merge(spark):
    schema = "user_id string, tier string, row_hash string, valid_from timestamp, valid_to timestamp, is_current boolean"
    state = spark.createDataFrame([(f"u{k}", "GOLD", None, T, None, True) for k in range(10)], schema).withColumn("row_hash", row_hash(["tier"]))
    new = spark.createDataFrame([(f"u{k}", "PLATINUM" if k < 5 else "GOLD") for k in range(10)], "user_id string, tier string")
    once, counts = merge_versions(state, new, "user_id", ["tier"], "2026-10-01")
    assert tuple(counts.first()) == (5, 5) and once.count() == 15 and once.where("is_current").count() == 10
    twice, counts = merge_versions(once, new, "user_id", ["tier"], "2026-10-02")
    assert tuple(counts.first()) == (0, 0) and twice.count() == 15
    first, counts = merge_versions(state.limit(0), new, "user_id", ["tier"], "2026-10-01")
    assert tuple(counts.first()) == (10, 0) and first.where("valid_to IS NULL").count() == 10
    facts = spark.createDataFrame([(1, "u1", datetime(2026, 9, 30)), (2, "u1", datetime(2026, 10, 1)), (3, "u1", datetime(2020, 1, 1)), (4, "u?", T)], "id int, user_id string, at timestamp")
    found = {r.id: r.tier for r in valid_at(facts, once.drop("row_hash"), "user_id", "at").collect()}
    assert found == {1: "GOLD", 2: "PLATINUM", 3: None, 4: None}


def test_latest_merge_counts_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "k int, v string")
    merged, counts = merge_latest(old, new, "k", ["v"])
    assert {r.k: r.v for r in merged.collect()} == {1: "a", 2: "x", 3: None} and tuple(counts.first()) == (1, 1)


def test_keyed_operators(spark):
    df = spark.createDataFrame([(1, datetime(2026, 1, 1)), (1, datetime(2025, 1, 1)), (2, None)], "k int, t timestamp")
    assert sorted((r.k, r.t and r.t.year) for r in deduplicated(df, "k", "t").collect()) == [(1, 2025), (2, None)]
    runs = spark.createDataFrame([("u", datetime(2026, 1, 1, 0, m)) for m in (0, 30, 59)] + [("u", datetime(2026, 1, 1, 1, 30))], "u string, t timestamp")
    assert [r.no for r in islands(runs, ["u"], "t", 1800, "no").orderBy("t").collect()] == [1, 1, 1, 2]
    m = marked(df, spark.createDataFrame([(1,), (1,), (None,)], "k int"), "k", "there")
    assert m.count() == 3 and m.where("there").count() == 2
    rows = [(1, T.replace(minute=2), 10.0, 1, True, 0.9), (1, T.replace(minute=3), 5.0, 2, False, 0.1)]
    w = merchant_risk_windows(spark.createDataFrame(rows, "merchant_key long, event_ts timestamp, amount_usd double, user_key long, is_flagged boolean, fraud_score double"))
    assert w.count() == 6 and w.agg(F.max("txn_count")).first()[0] == 2


def test_calendar_and_series(spark):
    days = calendar(spark)
    assert days.count() == 5844
    d = days.where("date_key = 20260101").first()
    assert (d.day_of_week, d.day_name, d.iso_week, d.quarter, d.is_weekend) == (4, "Thursday", 1, 1, False)
    assert [float(r.x) for r in series(spark, 4, 19, 0.05).collect()][::5] == [0.2, 0.45, 0.7, 0.95]
    assert "isBroadcastable=true" in str(sized(days)._jdf.queryExecution().analyzed().toString()) or "ResolvedHint" in sized(days)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in sized(days, 10)._jdf.queryExecution().analyzed().toString()


def test_database_scans(spark):
    url = "jdbc:derby:memory:ledger;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(k, datetime(2026, 1, 1, k % 24, 59, 59)) for k in range(48)], "id int, ts timestamp")
    rows.write.jdbc(url, "facts", properties=driver)
    assert read_query(spark, url, 'SELECT "id" FROM facts WHERE "id" < 7', options=driver).count() == 7
    parts = read_slices(spark, url, "facts", hour_slices('"ts"', "2026-01-01"), driver)
    assert parts.rdd.getNumPartitions() == 24 and parts.count() == 48


def _gold(spark, n=6):
    row = dict.fromkeys(GOLD.names)
    rows = [{**row, "transaction_id": f"t{k}", "event_ts": T, "event_date": T.date(), "user_key": 1, "merchant_key": k % 2, "mcc": "5411", "is_flagged": k < 2, "fraud_score": 0.9 if k < 2 else 0.1, "reason_codes": [], "date_key": 20260924} for k in range(n)]
    return spark.createDataFrame([tuple(r[c] for c in GOLD.names) for r in rows], GOLD).withColumn("amount_usd", F.lit(10).cast("decimal(14,2)"))


def test_hours_and_alerts(spark):
    cb = spark.createDataFrame([("b", "t0", "12.6", 9.0), ("a", "t0", "10.4", 10.0), ("c", "t1", "13.1", 2.5)], "chargeback_id string, transaction_id string, reason_code string, amount_usd double")
    assert {r.transaction_id: r.reason_code for r in one_per_transaction(cb).collect()} == {"t0": "10.4", "t1": "13.1"}
    hours = {r.merchant_key: r for r in hourly_merchant_risk(_gold(spark), cb).collect()}
    assert (hours[0].txn_count, hours[0].fraud_count, hours[0].flagged_count, float(hours[1].total_amount_usd)) == (3, 1, 1, 30.0)
    assert [(hours[k].date_key, hours[k].chargeback_count, hours[k].fraud_count, float(hours[k].chargeback_amount_usd)) for k in (0, 1)] == [(20260924, 1, 1, 10.0), (20260924, 1, 0, 2.5)]
    alerts = spark.createDataFrame([("t0", T, "OPEN"), ("t1", T, "OPEN"), ("t2", T, "OPEN"), ("t3", datetime(2026, 9, 25, 12), "OPEN"), ("t4", T, "CONFIRMED_FRAUD")], "transaction_id string, event_ts timestamp, status string")
    got = {r.transaction_id: r.status for r in resolved_alerts(alerts, cb, "2026-09-25 13:00:00").collect()}
    assert got == {"t0": "CONFIRMED_FRAUD", "t1": "OPEN", "t2": "FALSE_POSITIVE", "t3": "OPEN", "t4": "CONFIRMED_FRAUD"}


def test_reconciliation_backfills_and_audits(spark, tmp_path):
    w, gold = Warehouse(spark, str(tmp_path)), _gold(spark)
    named = gold.withColumns({"currency_code": F.col("currency"), "txn_lat": F.col("location_lat"), "txn_lon": F.col("location_lon"), "status": F.lit("OPEN"), "created_at": F.current_timestamp(), "status_updated_at": F.lit(None).cast("timestamp")})
    extra = named.where("transaction_id = 't5'").withColumn("transaction_id", F.lit("orphan"))
    w.upsert(named.where("transaction_id > 't1'").unionByName(extra), FACT_TRANSACTIONS)
    quarantine = spark.createDataFrame([], QUARANTINE)
    with pytest.raises(FileNotFoundError):
        reconcile(w, gold, quarantine, "2026-09-24", "2026-09-25")
    w.replace("fact_chargebacks", spark.createDataFrame([("c", "t0", "10.4", 10.0)], "chargeback_id string, transaction_id string, reason_code string, amount_usd double"))
    for k in range(2):
        run = reconcile(w, gold, quarantine, "2026-09-24", "2026-09-26 12:00:00")
        assert (run["lake_rows"], run["missing"], run["orphans"]) == (6, 0, 1)
    assert w.read(FACT_TRANSACTIONS.table).count() == 7 and w.read(HOURLY_MERCHANTS.table).count() == 2
    assert {r.transaction_id: r.status for r in w.read(FACT_ALERTS.table).collect()} == {"t0": "CONFIRMED_FRAUD", "t1": "FALSE_POSITIVE"}
    assert {r.status_updated_at for r in w.read(FACT_ALERTS.table).collect()} == {datetime(2026, 9, 26, 12)}
    assert [r.status for r in w.read("reconciliation_runs").orderBy("started_at").collect()] == ["FAILED", "SUCCEEDED", "SUCCEEDED"]
