"""Telemetry of streaming queries: progress documents are gathered as text and become rows in a DataFrame."""

from __future__ import annotations

import contextlib
import threading
import warnings
from collections import deque
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..plans.contracts import PROGRESS

#: What is read of a progress document.
DOCUMENT = (
    "id string, runId string, name string, timestamp string, batchId long, batchDuration long, numInputRows long, inputRowsPerSecond string, processedRowsPerSecond string, "
    "durationMs map<string,long>, eventTime map<string,string>, stateOperators array<struct<numRowsTotal:long,memoryUsedBytes:long,numRowsDroppedByWatermark:long>>, "
    "sources array<struct<metrics:map<string,string>>>"
)


def _instant(text: Column) -> Column:
    """A time; the epoch, which stands for no watermark yet, is none."""
    at = F.try_to_timestamp(text)
    return F.when(F.unix_micros(at) != 0, at)


def _rate(text: Column) -> Column:
    """A finite number, or null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _state(name: str) -> Column:
    """A sum over state operators; null without any."""
    each = F.transform("d.stateOperators", lambda s: F.coalesce(s[name], F.lit(0).cast("long")))
    return F.when(F.size("d.stateOperators") > 0, F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x))


def progress_rows(documents: DataFrame) -> DataFrame:
    """Rows of PROGRESS from ``documents`` (doc string); what isn't a document, and idle triggers of queries without state, give none."""
    spent = {f"{k}_ms": F.col("d.durationMs")[v] for k, v in (("trigger_execution", "triggerExecution"), ("add_batch", "addBatch"), ("get_batch", "getBatch"), ("query_planning", "queryPlanning"), ("wal_commit", "walCommit"))}
    behind = F.array_max(F.transform("d.sources", lambda s: s["metrics"]["maxOffsetsBehindLatest"].try_cast("double")))
    made = {
        **spent,
        "run_id": F.col("d.runId"),
        "batch_id": F.col("d.batchId"),
        "query_id": F.col("d.id"),
        "query_name": F.coalesce("d.name", "d.id"),
        "progress_ts": _instant(F.col("d.timestamp")),
        "num_input_rows": F.coalesce("d.numInputRows", F.lit(0).cast("long")),
        "input_rows_per_second": _rate(F.col("d.inputRowsPerSecond")),
        "processed_rows_per_second": _rate(F.col("d.processedRowsPerSecond")),
        "batch_duration_ms": F.col("d.batchDuration"),
        "watermark": _instant(F.col("d.eventTime")["watermark"]),
        "state_rows_total": _state("numRowsTotal"),
        "state_memory_bytes": _state("memoryUsedBytes"),
        "rows_dropped_by_watermark": _state("numRowsDroppedByWatermark"),
        "max_offsets_behind_latest": F.floor(behind),
        "progress_json": F.col("doc"),
    }
    read = documents.select("doc", F.from_json("doc", DOCUMENT).alias("d")).where("d.runId IS NOT NULL AND (d.numInputRows > 0 OR size(d.stateOperators) > 0)")
    return read.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in PROGRESS])


def append_progress(spark: SparkSession, path: str) -> Callable[[Sequence[str]], None]:
    """A sink for ``ProgressListener`` that appends rows to a Parquet table."""
    return lambda texts: progress_rows(spark.createDataFrame([(t,) for t in texts], "doc string")).coalesce(1).write.mode("append").parquet(path)


class ProgressListener(StreamingQueryListener):
    """Keeps the newest ``most`` documents until ``sink`` has taken them, every ``seconds`` and at the end.

    Spark's threads only ever append to a queue in memory. What a failing sink was given
    stays for its next turn; a queue that is full loses its oldest document.
    """

    def __init__(self, sink: Callable[[Sequence[str]], None], seconds: float = 5.0, most: int = 10_000):
        self._sink, self._seconds = sink, seconds
        self._texts: deque[str] = deque(maxlen=most)
        self._turn, self._ended = threading.Lock(), threading.Event()
        self._clock = threading.Thread(target=self._tick, name="telemetry", daemon=True)
        self._clock.start()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        """Not recorded."""

    def onQueryProgress(self, event) -> None:  # noqa: N802
        with contextlib.suppress(Exception):
            self._texts.append(event.progress.json)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        """Not recorded."""

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        """Not recorded; whoever awaits the query sees its error."""

    def flush(self) -> bool:
        """Hands over what is there; False if the sink failed and it stays."""
        with self._turn:
            taken = [self._texts.popleft() for _ in range(len(self._texts))]
            if not taken:
                return True
            try:
                self._sink(taken)
            except Exception as e:
                self._texts.extendleft(reversed(taken))
                warnings.warn(f"telemetry waits: {e}", stacklevel=2)
                return False
            return True

    def _tick(self) -> None:
        while not self._ended.wait(self._seconds):
            self.flush()

    def close(self) -> None:
        """Ends the clock and hands over the rest."""
        self._ended.set()
        self._clock.join()
        self.flush()
