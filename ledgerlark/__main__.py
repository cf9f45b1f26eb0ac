"""Command line: ``python -m ledgerlark stream | reconcile | generate | seed``."""

from __future__ import annotations

import argparse
import itertools
import os
import signal
import sys
import threading
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .functions.columns import duration_ms
from .operators.dimensions import DimensionCache
from .operators.reconcile import reconcile
from .operators.rules import DEFAULT_FILE, load_rules
from .operators.seeding import current_dimensions, seed
from .plans.contracts import GOLD, QUARANTINE
from .session import build_session
from .settings import Settings
from .sources.logs import read_drops, read_kafka
from .sources.tables import FACT_ALERTS, FACT_CHARGEBACKS, FACT_TRANSACTIONS, HOURLY_MERCHANTS, MERCHANT_WINDOWS, Warehouse, compact_day, lake_day
from .sources.traffic import Population, generated, upgraded
from .streaming.app import LAKE, LAYERS, App
from .streaming.progress import ProgressListener, append_progress

#: The warehouse's tables that grow by batches.
FACTS = tuple(spec.table for spec in (FACT_TRANSACTIONS, FACT_ALERTS, FACT_CHARGEBACKS, MERCHANT_WINDOWS, HOURLY_MERCHANTS))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerlark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("stream", help="run the streaming layers")
    s.add_argument("--layers", default=",".join(LAYERS), help="of bronze, silver, gold")
    s.add_argument("--no-metrics", action="store_true")
    s.add_argument("--once", action="store_true", help="process what is there and end")
    r = sub.add_parser("reconcile", help="a day's reconciliation")
    r.add_argument("--date", required=True)
    r.add_argument("--as-of", default=None)
    r.add_argument("--label-maturity-hours", type=float, default=24)
    r.add_argument("--vacuum-retain-hours", type=float, default=168)
    r.add_argument("--skip-maintenance", action="store_true")
    g = sub.add_parser("generate", help="drop synthetic traffic as files")
    g.add_argument("--rate", type=float, default=1000.0)
    g.add_argument("--duration", type=float, default=60.0, help="seconds of traffic")
    g.add_argument("--fraud-rate", type=float, default=None)
    g.add_argument("--files", type=int, default=4, help="files of each topic and worker")
    g.add_argument("--workers", type=int, default=1, help="processes that share the rate")
    g.add_argument("--report-interval", type=float, default=5.0, help="seconds between counts")
    g.add_argument("--dry-run", action="store_true", help="count only")
    d = sub.add_parser("seed", help="fill the dimensions")
    d.add_argument("--simulate-upgrades", type=int, default=0)
    return p


def layers_of(text: str) -> list[str]:
    chosen = [x for x in text.split(",") if x]
    if not chosen or set(chosen) - set(LAYERS):
        raise SystemExit(f"layers are {', '.join(LAYERS)}: {text!r}")
    return chosen


def application(spark: SparkSession, s: Settings, once: bool) -> App:
    warehouse = Warehouse(spark, s.warehouse)
    cache = DimensionCache(lambda: current_dimensions(warehouse), s.dimension_refresh_s)
    fast, slow = ({"availableNow": True},) * 2 if once else ({"processingTime": s.trigger}, {"processingTime": s.slow_trigger})
    return App(spark, s.lake, warehouse, cache.get, load_rules(s.rules or DEFAULT_FILE), fast, slow, s.watermark, (s.window, s.slide), duration_ms(s.idle_timeout), s.bytes_per_trigger)


def logs_of(spark: SparkSession, s: Settings) -> dict:
    """A stream of log records for each topic."""
    names = {"transactions": s.transactions_topic, "chargebacks": s.chargebacks_topic}
    if s.drops:
        return {t: read_drops(spark, f"{s.drops}/{t}", name) for t, name in names.items()}
    return {t: read_kafka(spark, s.kafka_servers, name, s.starting_offsets, s.offsets_per_trigger) for t, name in names.items()}


def stream(spark: SparkSession, s: Settings, layers: list[str], metrics: bool, once: bool) -> int:
    """Runs until a query fails or a signal asks to stop; 1 if a query failed. The ready file, if one is named, is there while all queries run."""
    listener = None
    if s.ready_file and os.path.exists(s.ready_file):
        os.remove(s.ready_file)
    if metrics:
        listener = ProgressListener(append_progress(spark, f"{s.lake}/ops_progress"))
        spark.streams.addListener(listener)
    app, logs = application(spark, s, once), logs_of(spark, s)
    try:
        if once:
            app.run(logs, layers)
            return 0
        stopping = threading.Event()
        for name in (signal.SIGTERM, signal.SIGINT):
            signal.signal(name, lambda *_: stopping.set())
        app.ensure()
        started = {"bronze": lambda: app.bronze(logs), "silver": app.silver, "gold": lambda: [*app.gold(), app.windows()]}
        queries = list(itertools.chain.from_iterable(started[x]() for x in LAYERS if x in layers))
        if s.ready_file:
            open(s.ready_file, "w").close()
        while not stopping.wait(1.0) and all(q.isActive for q in queries):
            pass
        if s.ready_file:
            os.remove(s.ready_file)
        failed = [q for q in queries if q.exception()]
        for q in queries:
            q.stop()
        return int(bool(failed) and not stopping.is_set())
    finally:
        if listener:
            spark.streams.removeListener(listener)
            listener.close()


def main(argv: list[str] | None = None, spark: SparkSession | None = None, settings: Settings | None = None) -> int:
    a, s = parser().parse_args(argv), settings or Settings.load()
    if a.command == "generate":
        people = Population.make(s.users, s.merchants, s.seed)
        rate = s.fraud_rate if a.fraud_rate is None else a.fraud_rate
        print(generated(people, datetime.now(UTC), a.duration, a.rate, rate, s.seed, None if a.dry_run else s.drops or "drops", a.files, max(1, a.workers), a.report_interval))
        return 0
    layers = layers_of(a.layers) if a.command == "stream" else []
    spark = spark or build_session()
    warehouse = Warehouse(spark, s.warehouse)
    if a.command == "stream":
        return stream(spark, s, layers, not a.no_metrics, a.once)
    if a.command == "seed":
        people = Population.make(s.users, s.merchants, s.seed)
        print(seed(warehouse, people, datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"), upgraded(people.users, a.simulate_upgrades, s.seed)))
        return 0
    copies = Warehouse(spark, f"{s.lake}/_compacted")

    def maintain() -> None:
        for name, (schema, column) in LAKE.items():
            compact_day(spark, f"{s.lake}/{name}", schema, column, a.date, copies)
            copies.vacuum(name, a.vacuum_retain_hours)
        for name in FACTS:
            warehouse.compact(name, [a.date])
            warehouse.vacuum(name, a.vacuum_retain_hours)

    application(spark, s, True).ensure()
    gold = lake_day(spark, f"{s.lake}/gold_transactions", GOLD, "event_date", a.date, copies)
    quarantine = lake_day(spark, f"{s.lake}/quarantine_transactions", QUARANTINE, "quarantine_date", a.date, copies)
    run = reconcile(warehouse, gold, quarantine, a.date, a.as_of or datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"), a.label_maturity_hours, None if a.skip_maintenance else maintain)
    print(run)
    return 0


if __name__ == "__main__":
    sys.exit(main())
