"""Scans: message logs, lake tables as streams, databases."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import byte_size
from ..plans.contracts import LOG_RECORD


def read_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", most_offsets: int = 50_000) -> DataFrame:
    """A Kafka topic as a stream; needs the connector on the class path. Lost data is an error."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "maxOffsetsPerTrigger": most_offsets, "failOnDataLoss": "true"}
    return spark.readStream.format("kafka").options(**options).load()


def read_drops(spark: SparkSession, folder: str, topic: str, most_files: int = 100) -> DataFrame:
    """JSON files of (key, value, timestamp, partition, offset) dropped into a folder, in the shape of a topic's records."""
    raw = spark.readStream.schema("key string, value string, timestamp timestamp, partition int, offset long").option("maxFilesPerTrigger", most_files).json(folder)
    made = {"key": F.col("key").cast("binary"), "value": F.col("value").cast("binary"), "topic": F.lit(topic)}
    return raw.select(*[made.get(f.name, F.col(f.name)).alias(f.name) for f in LOG_RECORD])


def read_table_stream(spark: SparkSession, path: str, schema: StructType, most_bytes: str | int = "16m") -> DataFrame:
    """A Parquet table as a stream of its new files; ``most_bytes`` a trigger, as "16m" or a number."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(byte_size(most_bytes))).parquet(path)


def read_day(spark: SparkSession, path: str, day: str, column: str = "event_date") -> DataFrame:
    """One day of a table partitioned by date; other partitions aren't listed into the scan."""
    return spark.read.parquet(path).where(F.col(column) == F.lit(day).cast("date"))


def read_query(spark: SparkSession, url: str, query: str, fetch: int = 10_000, options: Mapping[str, str] | None = None) -> DataFrame:
    """The result of a database query."""
    return spark.read.format("jdbc").options(url=url, query=query, fetchsize=fetch, **(options or {})).load()


def hour_slices(column: str, day: str) -> list[str]:
    """24 conditions that share a day out among partitions."""
    return [f"{column} >= TIMESTAMP('{day} {h:02d}:00:00') AND {column} < " + (f"TIMESTAMP('{day} {h + 1:02d}:00:00')" if h < 23 else f"TIMESTAMP('{day} 23:59:59.999999999')") for h in range(24)]


def read_slices(spark: SparkSession, url: str, table: str, slices: list[str], properties: Mapping[str, str] | None = None) -> DataFrame:
    """A database table with one partition for each condition."""
    return spark.read.jdbc(url, table, predicates=slices, properties=dict(properties or {}))


def series(spark: SparkSession, first: int, last: int, step: float, name: str = "x", digits: int = 2) -> DataFrame:
    """first * step, ..., last * step as decimals: whole numbers are counted, since decimal sequences aren't."""
    return spark.range(first, last + 1).select((F.col("id") * F.lit(step)).cast(f"decimal(10,{digits})").alias(name))
