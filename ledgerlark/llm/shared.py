"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders made by this thread, in order.
_MADE = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a session in one process (``local[...]``, as in tests) gets a
    temporary folder; on a cluster that is an error, as executors wouldn't share it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ledgerlark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    _MADE.__dict__.setdefault("paths", []).append(path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a path that no later plan reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read back, and the folder.

    This cuts the lineage, survives lost executors, and forgets how the rows were
    dealt out, so that a later join shuffles both of its sides and adaptive
    execution can split the partitions of a hot key.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as ``stored_at`` gives it back."""
    return stored_at(df, name)[0]


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` gives, stored; the folders that it made on the way are deleted.

    Spark deletes shuffle files once the driver's heap has let go of the plans that made
    them, which a roomy heap may not do for long; so the driver is asked to look.
    """
    made = _MADE.__dict__.setdefault("paths", [])
    before = len(made)
    out = stored(build(), name)
    for path in made[before:-1]:
        drop_folder(spark, path)
    del made[before:-1]
    gc.collect()
    spark._jvm.System.gc()
    return out


def open_file(path: str, mode: str) -> BinaryIO:
    """A file of a local or mounted folder, or of any store that pyarrow knows."""
    if path.startswith("file:") or "://" not in path:
        return open("/" + path.split(":", 1)[-1].lstrip("/"), mode)
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_output_stream(name) if "w" in mode else store.open_input_stream(name)


def only(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)`` for a condition on costly columns of the row.

    The optimiser would push a filter below the projections that make them, and compute
    each anew for every mention; it leaves a generator where it is.
    """
    return df.select("*", F.explode(F.when(condition, F.array(F.lit(True)))).alias("__only")).drop("__only")


#: Rows that go to Python at once, as whole texts make them large; operators cut them by bytes (``textblocks``).
ARROW_ROWS = 1000


def mapped(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches small enough for whole texts.

    The size of a batch is a setting of the session that counts when a plan runs, so it is
    lowered for all that follows, unless the session has chosen one itself.
    """
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(conf) == "10000":
        df.sparkSession.conf.set(conf, str(ARROW_ROWS))
    return df.mapInArrow(run, schema)
