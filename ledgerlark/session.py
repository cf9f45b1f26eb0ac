"""A session set up for this library."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

#: UTC everywhere; adaptive execution sizes shuffles and splits skewed joins; state lives in RocksDB.
DEFAULTS: Mapping[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.scheduler.mode": "FAIR",
}


def build_session(name: str = "ledgerlark", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; keyword arguments are further settings, "__" standing for a dot."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
