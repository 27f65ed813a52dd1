"""Incremental ingestion as Structured Streaming.

A file-source stream (new image files, or model-output files) is processed in
micro-batches of at most ``max_files_per_trigger`` files.  Each micro-batch
is shaped by a caller-supplied function and written with
:func:`trapline.sinks.tables.write_batch` to its own ``batch_id=`` folder,
so a replayed batch overwrites itself (T6).  Progress lives in the
checkpoint: a later run with the same checkpoint only sees new files (T2).
``trigger(availableNow=True)`` processes what is there and stops.

Circuit breaker (T5/W3): a batch in which every row carries an ``error`` is a
failed batch; ``limit`` consecutive failed batches stop the query.  Stop on
request (T4): :meth:`IngestControl.request_stop` ends the query after the
current micro-batch.
"""
from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.constants import DEFAULT_CONSECUTIVE_ERROR_LIMIT
from trapline.session import materialize
from trapline.sinks.tables import write_batch
from trapline.sources.images import list_images
from trapline.streaming.progress import recorded


class BreakerTripped(RuntimeError):
    pass


class StopRequested(RuntimeError):
    pass


@dataclass
class IngestControl:
    limit: int = DEFAULT_CONSECUTIVE_ERROR_LIMIT
    consecutive_failed: int = 0
    batches: list[dict] = field(default_factory=list)
    _stop: threading.Event = field(default_factory=threading.Event)

    def request_stop(self) -> None:
        self._stop.set()

    @property
    def stop_requested(self) -> bool:
        return self._stop.is_set()


def ingest_stream(spark: SparkSession, source_dir: str, schema, shape: Callable[[DataFrame], DataFrame],
                  table_path: str, checkpoint: str, source_format: str = "parquet",
                  max_files_per_trigger: int = 1, control: IngestControl | None = None,
                  error_col: str | None = "error",
                  on_progress: Callable[[dict], None] | None = None,
                  progress_path: str | None = None, total_rows: int = 0) -> dict:
    """Run the stream until the available files are done; returns a run summary.

    ``shape(batch) -> rows`` turns one micro-batch of source rows into table
    rows (it may score, parse, pick the best detection...).  When the batch
    frame has ``error_col``, failed rows are counted for the breaker.  The source is
    read once a batch.  With ``progress_path`` a listener keeps a table of progress rows
    (see :mod:`trapline.streaming.progress`); ``total_rows`` makes percent and ETA known.
    """
    control = control or IngestControl()

    def on_batch(source: DataFrame, batch_id: int) -> None:
        batch = source.persist()
        try:
            one_batch(batch, batch_id)
        finally:
            batch.unpersist()

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        if control.stop_requested:
            raise StopRequested()
        if error_col and error_col in batch.columns:
            stats = batch.agg(F.count(F.lit(1)).alias("n"),
                              F.count_if(F.col(error_col).isNotNull()).alias("bad")).first()
            all_failed = stats["n"] > 0 and stats["bad"] == stats["n"]
        else:
            all_failed = False
        control.consecutive_failed = control.consecutive_failed + 1 if all_failed else 0
        rows = shape(batch)
        write_batch(rows, table_path, batch_id)
        info = {"batch_id": batch_id, "failed": all_failed}
        control.batches.append(info)
        if on_progress is not None:  # T3: per-chunk progress
            on_progress(dict(info, batches_done=len(control.batches)))
        if control.consecutive_failed >= control.limit:
            raise BreakerTripped(f"{control.limit} consecutive failed batches")

    stream = (spark.readStream.format(source_format).schema(schema)
              .option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir))
    stopped, reason = _run(spark, stream, on_batch, checkpoint, progress_path, total_rows)
    return {"batches": len(control.batches), "stopped": stopped, "reason": reason,
            "consecutive_failed": control.consecutive_failed}


def _run(spark: SparkSession, stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str,
         progress_path: str | None, total_rows: int) -> tuple[bool, str | None]:
    """Runs the stream over what is there; (stopped, reason), with progress rows if a path is given."""
    name = f"ingest-{uuid.uuid4().hex}"
    with recorded(spark, progress_path, total_rows, name=name) if progress_path else nullcontext():
        q = (stream.writeStream.queryName(name).foreachBatch(on_batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        try:
            q.awaitTermination()
        except Exception as e:  # noqa: BLE001 - the query ends with the raised reason
            text = str(e)
            if "BreakerTripped" in text or "StopRequested" in text:
                return True, ("breaker" if "BreakerTripped" in text else "stop")
            raise
    return False, None


def _unhandled(spark: SparkSession, queue: str, table_path: str, failed_path: str) -> int:
    """Rows of the queue that no finished batch has written or put down as failed (counts of Parquet footers)."""
    def rows(path: str) -> int:
        try:
            t = spark.read.parquet(path)
        except AnalysisException:  # nothing there yet
            return 0
        return t.where("batch_id IS NOT NULL").count() if "batch_id" in t.columns else t.count()

    return max(rows(queue) - rows(table_path) - rows(failed_path), 0)


def queue_new_images(spark: SparkSession, root: str, queue: str, failed: str, files_per_trigger: int,
                     state_path: str | None = None) -> None:
    """Appends the images of ``root`` that were never queued, and those whose last attempt failed, to the queue.

    The queue is a Parquet table of paths, ``files_per_trigger`` rows a file, in
    path order: what a micro-batch of the image stream reads.  With ``state_path`` the
    walk opens only folders that changed since the last run.
    """
    listing = list_images(spark, root, state_path=state_path).select("path", "modificationTime")
    try:
        queued = spark.read.parquet(queue).groupBy("path").agg(F.count(F.lit(1)).alias("tries"))
    except AnalysisException:  # the first run
        queued = spark.createDataFrame([], "path string, tries long")
    try:
        fails = spark.read.parquet(failed).groupBy("path").agg(F.count(F.lit(1)).alias("fails"))
    except AnalysisException:
        fails = spark.createDataFrame([], "path string, fails long")
    new = (listing.join(queued, "path", "left").join(fails, "path", "left")
           .where("tries IS NULL OR tries <= fails").select("path", "modificationTime"))
    new = materialize(new)  # decided before the queue grows
    if not new.isEmpty():
        new.orderBy("path").write.mode("append").option("maxRecordsPerFile", files_per_trigger).parquet(queue)


def ingest_images(spark: SparkSession, root: str, factory, names: DataFrame, table_path: str, checkpoint: str,
                  options=None, control: IngestControl | None = None,
                  on_progress: Callable[[dict], None] | None = None,
                  files_per_trigger: int | None = None, progress_path: str | None = None) -> dict:
    """New image files under ``root`` -> scorer -> detections table, chunk by chunk.

    Each run walks the folders, opening those that changed since the last run, and queues what is new (see
    :func:`queue_new_images`); the stream reads the queue, so every regular file
    is seen whatever its name, and the scorer opens the files itself.  A
    micro-batch is at most ``files_per_trigger`` files (default: one model chunk,
    ``options.chunk_size``, so the breaker counts chunks as a sequential run
    would); larger triggers write fewer, larger files, and the scorer still
    works in chunks of ``options.chunk_size`` inside each task.  The capture date
    is read from each file as in the batch job.  Images of a failed chunk go to
    a table beside the checkpoint and are queued again by the next run; ``limit``
    failed chunks in a row stop the stream.  With ``progress_path`` a listener keeps a
    table of progress rows (images so far, rate, percent, ETA).
    """
    from pyspark.sql import Observation

    from trapline.operators.scoring import ScoringOptions, score_images
    from trapline.plans.detect import _observed, image_rows
    from trapline.sources.exif import capture_dates

    options = options or ScoringOptions()
    control = control or IngestControl()

    size = files_per_trigger or options.chunk_size
    queue, failed_path = f"{checkpoint.rstrip('/')}-queue", f"{checkpoint.rstrip('/')}-failed"
    queue_new_images(spark, root, queue, failed_path, size, f"{checkpoint.rstrip('/')}-folders")

    def on_batch(source: DataFrame, batch_id: int) -> None:
        batch = source.persist()  # a few paths, read several times below
        try:
            one_batch(batch, batch_id)
        finally:
            batch.unpersist()

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        if control.stop_requested:
            raise StopRequested()
        images = batch.select(F.col("path").alias("image_path"), "modificationTime")
        preds = score_images(images, factory, options)
        # one pass over the scorer output: the breaker's counts ride along with the write
        rows = image_rows(images, preds, names, options.confidence_threshold, keep_failed=True)
        rows = (rows.join(capture_dates(batch).withColumnRenamed("capture_date", "_taken"), "image_path", "left")
                .withColumn("image_date", F.coalesce("_taken", F.date_format("modificationTime", "yyyy-MM-dd"), F.lit(""))).drop("_taken"))
        obs = Observation()
        rows = rows.observe(obs, F.count(F.lit(1)).alias("n"), F.count_if(F.col("_failed")).alias("bad"))
        write_batch(rows.filter(~F.col("_failed")).drop("_failed"), table_path, batch_id)
        stats = _observed(obs)
        n, bad = int(stats.get("n", 0)), int(stats.get("bad", 0))
        all_failed = n > 0 and bad == n
        control.consecutive_failed = control.consecutive_failed + 1 if all_failed else 0
        info = {"batch_id": batch_id, "failed": all_failed, "images": n}
        control.batches.append(info)
        if on_progress is not None:
            on_progress(dict(info, batches_done=len(control.batches)))
        if control.consecutive_failed >= control.limit:
            raise BreakerTripped(f"{control.limit} consecutive failed chunks")  # the next run replays this chunk
        # what is not in the table now failed: known without a second run of the model
        written = spark.read.parquet(f"{table_path.rstrip('/')}/batch_id={batch_id}")
        (images.join(written, "image_path", "left_anti").select(F.col("image_path").alias("path"))
         .write.mode("overwrite").parquet(f"{failed_path}/batch_id={batch_id}"))

    stream = (spark.readStream.format("parquet").schema("path string, modificationTime timestamp")
              .option("maxFilesPerTrigger", 1).load(queue))
    total = _unhandled(spark, queue, table_path, failed_path) if progress_path else 0
    stopped, reason = _run(spark, stream, on_batch, checkpoint, progress_path, total)
    return {"batches": len(control.batches), "stopped": stopped, "reason": reason,
            "images": sum(b.get("images", 0) for b in control.batches)}
