"""Keyed Parquet tables: versions, upserts in proportion to the batch, compaction.

A table is a folder of data and a log. Version n of the log (``_log/<n>.json``) names
the folders of rows, ``segments``, by the day they belong to. A writer puts its rows
into a folder of its own and then publishes the next version under a name that only one
writer can take; who comes second reads the new version and merges again. Nothing that
another reader or writer may use is deleted but by ``vacuum``, after its retention.

Publishing needs a store whose rename doesn't replace a file (HDFS) or a local folder; on
a store without that, give each table one writer.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.keyed import first_by

_LOG, _DAY = "_log", "__day"
#: Times that a writer merges anew before it gives up.
ATTEMPTS = 20


@dataclass(frozen=True)
class Upsert:
    """How rows meet a table: ``keys`` identify; ``update`` columns are overwritten on conflict (none: the old row stays); ``touch`` is set to the time of writing; ``day`` is the column by whose date the table is divided."""

    table: str
    columns: tuple[str, ...]
    keys: tuple[str, ...]
    update: tuple[str, ...] = ()
    touch: str | None = None
    day: str | None = None


# The warehouse's tables.
FACT_TRANSACTIONS = Upsert(
    "fact_transactions",
    ("transaction_id", "event_ts", "date_key", "user_key", "merchant_key", "location_key", "amount", "currency_code", "amount_usd", "channel", "entry_mode", "txn_lat", "txn_lon", "distance_from_home_km", "km_from_prev", "seconds_since_prev", "implied_speed_kmh", "txn_count_1m", "txn_count_5m", "amount_usd_5m", "distinct_merchants_5m", "small_txn_count_5m", "amount_zscore", "fraud_score", "risk_level", "is_flagged", "reason_codes", "kafka_partition", "kafka_offset", "kafka_ts", "processed_at"),
    ("transaction_id", "event_ts"),
    touch="loaded_at",
    day="event_ts",
)
FACT_ALERTS = Upsert("fact_fraud_alerts", ("transaction_id", "event_ts", "date_key", "user_key", "merchant_key", "amount_usd", "fraud_score", "risk_level", "reason_codes", "status", "created_at", "status_updated_at"), ("transaction_id",), day="event_ts")
FACT_CHARGEBACKS = Upsert("fact_chargebacks", ("chargeback_id", "transaction_id", "user_key", "reason_code", "amount", "currency_code", "amount_usd", "reported_ts"), ("chargeback_id",), day="reported_ts")
_WINDOW = ("window_end", "txn_count", "total_amount_usd", "max_amount_usd", "approx_distinct_users", "flagged_count", "avg_fraud_score")
MERCHANT_WINDOWS = Upsert("agg_merchant_window_risk", ("merchant_key", "window_start", *_WINDOW), ("merchant_key", "window_start"), _WINDOW, "updated_at", "window_start")
_HOURLY = ("date_key", "mcc", "txn_count", "total_amount_usd", "flagged_count", "avg_fraud_score", "max_fraud_score", "chargeback_count", "fraud_count", "chargeback_amount_usd")
HOURLY_MERCHANTS = Upsert("agg_hourly_merchant_risk", ("hour_ts", "merchant_key", *_HOURLY), ("hour_ts", "merchant_key"), _HOURLY, "computed_at", "hour_ts")


class Conflict(RuntimeError):
    """Other writers were faster ``ATTEMPTS`` times."""


@dataclass(frozen=True)
class Version:
    """A state of a table: its columns, and for each day ("" if it has none) folders of rows below the table's."""

    number: int
    schema: StructType
    day: str | None
    segments: dict[str, list[str]]
    #: By day: names of the lake's files that a compacted copy holds.
    covers: dict[str, list[str]]


class Store:
    """Small files and folders through Hadoop's file system interface."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        self.fs = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        """What is in a folder; nothing if there is none."""
        return [s.getPath().getName() for s in self.statuses(folder)]

    def statuses(self, folder: str) -> list:
        p = self.path(folder)
        return list(self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)

    def publish(self, name: str, text: str) -> bool:
        """``text`` as a file, whole or not at all; False if the name is taken."""
        folder, _, last = name.rpartition("/")
        temporary = self.path(f"{folder}/.{last}-{uuid.uuid4().hex}")
        out = self.fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.getUri().getScheme() != "file":
            done = not self.fs.exists(self.path(name)) and self.fs.rename(temporary, self.path(name))
        else:
            # A local rename replaces what is there; a link doesn't.
            try:
                os.link(temporary.toUri().getPath(), self.path(name).toUri().getPath())
                done = True
            except FileExistsError:
                done = False
        if self.fs.exists(temporary):
            self.fs.delete(temporary, False)
        return done


class Warehouse:
    """Tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = Store(spark, self.root)

    def _versions(self, table: str) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.store.names(f"{self.root}/{table}/{_LOG}") if n.endswith(".json") and not n.startswith("."))

    def _load(self, table: str, number: int) -> Version:
        doc = json.loads(self.store.read(f"{self.root}/{table}/{_LOG}/{number:010d}.json"))
        return Version(number, StructType.fromJson(doc["schema"]), doc["day"], doc["segments"], doc["covers"])

    def version(self, table: str) -> Version | None:
        """The current state; None if there is no such table."""
        known = self._versions(table)
        return self._load(table, known[-1]) if known else None

    def exists(self, table: str) -> bool:
        return bool(self._versions(table))

    def _rows(self, table: str, v: Version, days: Iterable[str] | None = None) -> DataFrame:
        wanted = v.segments if days is None else [d for d in days if d in v.segments]
        paths = [f"{self.root}/{table}/{s}" for d in wanted for s in v.segments[d]]
        return self.spark.read.schema(v.schema).parquet(*paths) if paths else self.spark.createDataFrame([], v.schema)

    def read(self, table: str, days: Iterable[str] | None = None) -> DataFrame:
        """The current rows; of ``days`` ("2026-01-31") only, if given: other folders aren't opened."""
        v = self.version(table)
        if v is None:
            raise FileNotFoundError(f"no table {table}")
        return self._rows(table, v, days)

    def _written(self, table: str, df: DataFrame, day: str | None) -> dict[str, list[str]]:
        """``df`` as new segments, by day; nobody sees them yet."""
        name = f"data/{uuid.uuid4().hex}"
        path = f"{self.root}/{table}/{name}"
        if day is None:
            df.write.parquet(path)
            return {"": [name]}
        # Rebalancing gives a small batch one file a day and shares a large day out.
        df.withColumn(_DAY, F.to_date(day)).hint("rebalance", _DAY).write.partitionBy(_DAY).parquet(path)
        found = [n for n in self.store.names(path) if n.startswith(f"{_DAY}=")]
        return {"" if n.endswith("__HIVE_DEFAULT_PARTITION__") else n.split("=", 1)[1]: [f"{name}/{n}"] for n in found}

    def _commit(self, table: str, base: Version | None, schema: StructType, day: str | None, segments: dict[str, list[str]], covers: dict[str, list[str]]) -> bool:
        number = base.number + 1 if base else 0
        folder = f"{self.root}/{table}/{_LOG}"
        self.store.fs.mkdirs(self.store.path(folder))
        doc = {"schema": schema.jsonValue(), "day": day, "segments": {d: s for d, s in segments.items() if s}, "covers": covers}
        return self.store.publish(f"{folder}/{number:010d}.json", json.dumps(doc))

    def _change(self, table: str, step: Callable[[Version | None], tuple | None]) -> None:
        """Publishes what ``step`` makes of the current version (None: nothing to do), again if another writer was faster."""
        for attempt in range(ATTEMPTS):
            base = self.version(table)
            made = step(base)
            if made is None or self._commit(table, base, *made):
                return
            time.sleep(random.uniform(0, 0.05 * (attempt + 1)))
        raise Conflict(table)

    def replace(self, table: str, df: DataFrame, day: str | None = None) -> None:
        """All rows anew. ``df`` may read the table; it must not depend on what others write meanwhile (see ``update``)."""
        made = self._written(table, df, day)
        self._change(table, lambda base: (_nullable(df.schema), day, made, {}))

    def append(self, table: str, df: DataFrame) -> None:
        """Further rows of a table that may not exist yet."""
        made: dict[str, list[str]] = {}

        def step(base: Version | None) -> tuple:
            if not made:
                made.update(self._written(table, df, base.day if base else None))
            old = base.segments if base else {}
            return _nullable(base.schema if base else df.schema), base.day if base else None, _joined(old, made), base.covers if base else {}

        self._change(table, step)

    def ensure(self, table: str, schema: StructType, day: str | None = None) -> None:
        """An empty table, all columns nullable, unless there is one."""
        self._change(table, lambda base: None if base else (_nullable(schema), day, {}, {}))

    def upsert(self, df: DataFrame, spec: Upsert) -> None:
        """Merges a batch; the same batch again changes nothing but ``touch``.

        Of rows with one key in a batch the first by the other columns counts. New rows of
        a table whose old rows stay are appended: of the old ones only keys are read, and
        those of the batch's days only if the day is a key. With columns to update, the
        days that the batch touches are written anew if the day is a key, else all are.
        """
        other = [F.col(c) for c in spec.columns if c not in spec.keys]
        rows = first_by(df.select(*spec.columns), list(spec.keys), other or [F.lit(0)])
        if spec.touch:
            rows = rows.withColumn(spec.touch, F.current_timestamp())
        rows = rows.persist()
        try:
            found = rows.select(F.to_date(spec.day).cast("string").alias("d")).distinct().collect() if spec.day else []
            touched = [r["d"] or "" for r in found]
            if spec.day and not touched:
                self.ensure(spec.table, rows.schema, spec.day)
                return

            def step(base: Version | None) -> tuple | None:
                if base is None:
                    return _nullable(rows.schema), spec.day, self._written(spec.table, rows, spec.day), {}
                days = touched if spec.day in spec.keys and base.day == spec.day else None
                current = self._rows(spec.table, base, days)
                schema = _nullable(StructType([*base.schema, *[f for f in rows.schema if f.name not in base.schema.names]]))
                if not spec.update:
                    new = rows.join(current.select(*spec.keys), list(spec.keys), "left_anti").persist()
                    try:
                        if new.isEmpty():
                            return None
                        return schema, base.day, _joined(base.segments, self._written(spec.table, new, base.day)), base.covers
                    finally:
                        new.unpersist()
                kept = {} if days is None else {d: s for d, s in base.segments.items() if d not in days}
                return schema, base.day, _joined(kept, self._written(spec.table, merged(current, rows, spec), base.day)), base.covers

            self._change(spec.table, step)
        finally:
            rows.unpersist()

    def update(self, table: str, change: Callable[[DataFrame], DataFrame], touched: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Rows as ``change`` makes them of the current ones. ``touched`` gives the rows that can change: only their days are written anew."""

        def step(base: Version | None) -> tuple | None:
            if base is None:
                raise FileNotFoundError(f"no table {table}")
            current, days = self._rows(table, base), None
            if touched and base.day:
                days = [r["d"] or "" for r in touched(current).select(F.to_date(base.day).cast("string").alias("d")).distinct().collect()]
                if not days:
                    return None
                current = self._rows(table, base, days)
            made = change(current)
            kept = {} if days is None else {d: s for d, s in base.segments.items() if d not in days}
            return _nullable(made.schema), base.day, _joined(kept, self._written(table, made, base.day)), base.covers

        self._change(table, step)

    def compact(self, table: str, days: Iterable[str] | None = None) -> int:
        """Each day's segments (of all ``days`` if none are given) as one; returns how many there were. Readers and writers go on."""
        was = 0

        def step(base: Version | None) -> tuple | None:
            nonlocal was
            if base is None:
                return None
            wanted = [d for d in (base.segments if days is None else days) if len(base.segments.get(d, [])) > 1]
            was = sum(len(base.segments[d]) for d in wanted)
            if not wanted:
                return None
            made = self._written(table, self._rows(table, base, wanted), base.day)
            return base.schema, base.day, {**{d: s for d, s in base.segments.items() if d not in wanted}, **made}, base.covers

        self._change(table, step)
        return was

    def hold_day(self, table: str, rows: DataFrame, day: str, files: Sequence[str]) -> None:
        """``rows`` in place of what the table has of ``day``; ``files`` are the lake's that they come from."""
        name = f"data/{uuid.uuid4().hex}"
        rows.hint("rebalance").write.parquet(f"{self.root}/{table}/{name}")

        def step(base: Version | None) -> tuple:
            segments = {**(base.segments if base else {}), day: [name]}
            return _nullable(rows.schema), base.day if base else None, segments, {**(base.covers if base else {}), day: list(files)}

        self._change(table, step)

    def vacuum(self, table: str, retain_hours: float) -> int:
        """Deletes versions that were replaced ``retain_hours`` ago and folders that only they name, or nobody; returns how many folders."""
        bound = self.spark._jvm.System.currentTimeMillis() - int(retain_hours * 3_600_000)
        log, known = f"{self.root}/{table}/{_LOG}", self._versions(table)
        at = {s.getPath().getName(): s.getModificationTime() for s in self.store.statuses(log)}
        # A version is read until the next one replaces it.
        gone = [n for n, after in zip(known, known[1:], strict=False) if at[f"{after:010d}.json"] < bound]
        live = {s.split("/")[1] for n in known if n not in gone for parts in self._load(table, n).segments.values() for s in parts}
        deleted = 0
        for status in self.store.statuses(f"{self.root}/{table}/data"):
            if status.getPath().getName() not in live and status.getModificationTime() < bound:
                deleted += self.store.delete(status.getPath().toString())
        for n in gone:
            self.store.delete(f"{log}/{n:010d}.json")
        return deleted


def _nullable(schema: StructType) -> StructType:
    return StructType([type(f)(f.name, f.dataType, True) for f in schema])


def _joined(one: dict[str, list[str]], two: dict[str, list[str]]) -> dict[str, list[str]]:
    return {d: [*one.get(d, []), *two.get(d, [])] for d in {**one, **two}}


def merged(current: DataFrame, rows: DataFrame, spec: Upsert) -> DataFrame:
    """The state after an upsert of ``rows``, which are distinct by key."""
    keys = list(spec.keys)
    if not spec.update:
        new = rows.join(current.select(*keys), keys, "left_anti")
        return current.unionByName(new, allowMissingColumns=True)
    written = {*spec.update, *([spec.touch] if spec.touch else [])}
    incoming = rows.select(*[F.col(k) for k in keys], F.struct(*[c for c in rows.columns if c not in keys]).alias("__new"))
    both = current.withColumn("__old", F.lit(True)).join(incoming, keys, "full")

    def value(c: str) -> Column:
        if c not in rows.columns:
            return F.col(c)
        fresh = F.col(f"__new.{c}")
        if c in written:
            return F.when(F.col("__new").isNotNull(), fresh).otherwise(F.col(c))
        return F.when(F.col("__old").isNull(), fresh).otherwise(F.col(c))

    extra = [c for c in rows.columns if c not in current.columns]
    return both.select(*[F.col(c) if c in keys else value(c).alias(c) for c in current.columns], *[F.col(f"__new.{c}").alias(c) for c in extra])


def append_batch(df: DataFrame, path: str, app: str, batch_id: int, partition_by: Sequence[str] = ()) -> None:
    """Appends a micro-batch exactly once: a replay overwrites the folder that belongs to the query and batch."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/app={app}/batch={batch_id}")


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the streaming query that a checkpoint belongs to; a reset checkpoint has another."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def lake_day(spark: SparkSession, path: str, schema: StructType, column: str, day: str, copies: Warehouse | None = None) -> DataFrame:
    """A day of a lake table that is partitioned by ``column``, below folders of batches or not.

    Where ``copies`` has a compacted copy of the day, that is read in place of the files
    that it covers, with what has come since.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    store = Store(spark, path)
    layered = any(n.startswith("app=") for n in store.names(path))
    whole = StructType([*[f for f in schema if f.name != column], *([StructType.fromDDL("app string")[0], StructType.fromDDL("batch long")[0]] if layered else []), schema[column]])
    rows = spark.read.schema(whole).parquet(path).where(F.col(column) == F.lit(day).cast("date"))
    held = copies.version(name) if copies else None
    if held is None or day not in held.segments:
        return rows.select(*schema.names)
    later = rows.where(~F.col("_metadata.file_name").isin(*held.covers.get(day, [])))
    return copies._rows(name, held, [day]).select(*schema.names).unionByName(later.select(*schema.names))


def compact_day(spark: SparkSession, path: str, schema: StructType, column: str, day: str, copies: Warehouse) -> int:
    """A copy of a day of a lake table in few files; returns how many files it stands for.

    The lake's own files stay: streams that read or write the table keep track of them by
    name, so they are the record and the copy is what batch jobs read (``lake_day``).
    """
    raw = lake_day(spark, path, schema, column, day)
    files = [r["f"] for r in raw.select(F.col("_metadata.file_name").alias("f")).distinct().collect()]
    if files:
        copies.hold_day(path.rstrip("/").rsplit("/", 1)[-1], raw, day, files)
    return len(files)
