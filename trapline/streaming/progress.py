"""Progress of a running stream (T3, A13): a query listener that feeds a table of progress rows.

``recorded(spark, path, total_rows)`` listens while its block runs.  Each micro-batch
that read rows gives one row: rows of the batch and so far, seconds, rate, percent and
remaining seconds.  Rows are appended as the batches end, so another session can watch
a job by reading the table.  Spark reports a batch's rows as often as its source is
read; the ingest jobs read it once.  A batch replayed after a failure is counted once,
by its last report.
"""
from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from trapline.plans.detect import progress_metrics

PROGRESS_SCHEMA = ("run_id string, batch_id long, batch_rows long, rows_done long, total_rows long, batch_seconds double, "
                   "rate double, percent double, eta_seconds double, recorded_at timestamp")


class ProgressListener(StreamingQueryListener):
    """Appends a progress row for each micro-batch of the queries it follows (all, or those named)."""

    def __init__(self, spark: SparkSession, path: str, total_rows: int = 0, run_id: str | None = None, name: str | None = None):
        self.spark, self.path, self.total, self.name = spark, path.rstrip("/"), total_rows, name
        self.run_id = run_id or uuid.uuid4().hex
        self.batches: dict[int, int] = {}
        self.seconds = 0.0
        self.failed: list[str] = []
        self.ended = threading.Event()
        self._query = None

    def onQueryStarted(self, event) -> None:
        if self._query is None and self.name in (None, event.name):
            self._query = str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.id) != self._query or not p.numInputRows:
            return
        self.batches[p.batchId] = int(p.numInputRows)
        took = p.batchDuration / 1000.0
        self.seconds += took
        done = sum(self.batches.values())
        m = progress_metrics(done, self.total, self.seconds)
        row = (self.run_id, p.batchId, int(p.numInputRows), done, self.total, took, m["rate"], m["percent"], m["eta_seconds"])
        try:  # a progress row must not end the job that it reports
            (self.spark.createDataFrame([row], PROGRESS_SCHEMA.rsplit(", ", 1)[0]).withColumn("recorded_at", F.current_timestamp())
             .coalesce(1).write.mode("append").parquet(self.path))
        except Exception as e:  # noqa: BLE001
            self.failed.append(f"batch {p.batchId}: {type(e).__name__}: {e}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self._query:
            self.ended.set()


@contextmanager
def recorded(spark: SparkSession, path: str, total_rows: int = 0, run_id: str | None = None, name: str | None = None,
             wait_seconds: float = 30.0) -> Iterator[ProgressListener]:
    """Listens to the (named) query started in the block; events come late, so its end is waited for."""
    listener = ProgressListener(spark, path, total_rows, run_id, name)
    spark.streams.addListener(listener)
    try:
        yield listener
        began = time.monotonic()
        while listener._query is None and time.monotonic() - began < 1:  # a block without a query
            time.sleep(0.05)
        if listener._query is not None:
            listener.ended.wait(wait_seconds)
    finally:
        spark.streams.removeListener(listener)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row a run and batch: the last report of each."""
    rows = spark.read.schema(PROGRESS_SCHEMA).parquet(path)
    last = Window.partitionBy("run_id", "batch_id").orderBy(F.desc("recorded_at"), F.desc("rows_done"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def latest_progress(spark: SparkSession, path: str) -> DataFrame:
    """Each run as it stands: its furthest row."""
    rows = spark.read.schema(PROGRESS_SCHEMA).parquet(path)
    columns = [c for c in rows.columns if c != "run_id"]
    return rows.groupBy("run_id").agg(F.max_by(F.struct(*columns), F.struct("rows_done", "recorded_at")).alias("r")).select("run_id", "r.*")
