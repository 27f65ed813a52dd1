"""Incremental runs: resume, append, run summary, circuit breaker."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.constants import DEFAULT_CONSECUTIVE_ERROR_LIMIT
from trapline.functions.text import empty_if_null, ustrip
from trapline.operators.ordinal import with_ordinal
from trapline.sinks.archive import Archive


def processed_paths(done: DataFrame, key: str = "image_path") -> DataFrame:
    """O1: trimmed, non-empty paths of an existing detections table.

    No ``distinct``: the anti join below does not care about duplicates, and
    skipping it saves a shuffle.
    """
    p = ustrip(empty_if_null(F.col(key)))
    return done.select(p.alias(key)).filter(F.col(key) != "")


def pending_images(images: DataFrame, done: DataFrame | Archive | None, key: str = "image_path") -> DataFrame:
    """Images not yet in the table (exact string match); duplicates kept.

    A frame is joined by a shuffle of both sides; a bucketed ``Archive`` stays where it lies.
    """
    if done is None:
        return images
    if isinstance(done, Archive):
        return done.pending(images, key)
    return images.join(processed_paths(done, key), key, "left_anti")


def resume_union(existing: DataFrame, new_rows: DataFrame) -> DataFrame:
    """O2: existing rows plus the new ones, aligned by column name."""
    return existing.unionByName(new_rows, allowMissingColumns=True)


def run_summary(images: DataFrame, pending: DataFrame, scored: DataFrame,
                stopped: bool = False) -> DataFrame:
    """A2/A13 (clock-free part): processed, successful, failed, skipped, stopped, percent.

    ``scored`` is image grain with ``n_detections`` (detections above the
    threshold, blanks included, Q3).  ``failed`` means "nothing detected" (Q4).
    """
    tagged = (images.select(F.lit(0).alias("_t"), F.lit(0).alias("_d"))
              .unionByName(pending.select(F.lit(1).alias("_t"), F.lit(0).alias("_d")))
              .unionByName(scored.select(F.lit(2).alias("_t"), F.col("n_detections").cast("int").alias("_d"))))
    row = tagged.agg(  # one pass over the three inputs, no join
        F.count_if(F.col("_t") == 0).cast("long").alias("total_images"),
        F.count_if(F.col("_t") == 1).cast("long").alias("pending_images"),
        F.count_if(F.col("_t") == 2).cast("long").alias("total_processed"),
        F.count_if((F.col("_t") == 2) & (F.col("_d") > 0)).cast("long").alias("successful"))
    return (row.withColumn("failed", F.col("total_processed") - F.col("successful"))
            .withColumn("skipped", F.col("total_images") - F.col("pending_images"))
            .withColumn("stopped", F.lit(stopped))
            .withColumn("progress_pct", F.coalesce(
                F.try_divide(F.col("total_processed") * 100.0, F.col("pending_images")), F.lit(0.0)))
            .select("total_images", "skipped", "total_processed", "successful", "failed", "stopped",
                    "progress_pct"))


def failure_streaks(chunk_log: DataFrame, limit: int = DEFAULT_CONSECUTIVE_ERROR_LIMIT,
                    chunk_col: str = "chunk_no", failed_col: str = "failed") -> DataFrame:
    """Runs of consecutive failed chunks (gaps and islands) and where the breaker trips.

    ``island = chunk_no - position among failed chunks`` is constant along a
    run.  Positions come from :func:`with_ordinal` (no single-partition
    window).  A run of ``limit`` or more trips the breaker at its
    ``limit``-th chunk; ``first_trip`` marks the run that stops the job.
    """
    failed = chunk_log.filter(F.col(failed_col)).select(chunk_col)
    pos = with_ordinal(failed, [], chunk_col, "_pos")
    runs = (pos.groupBy((F.col(chunk_col) - F.col("_pos")).alias("_island"))
            .agg(F.min(chunk_col).alias("run_start"), F.max(chunk_col).alias("run_end"),
                 F.count(F.lit(1)).alias("run_length")))
    runs = (runs.withColumn("tripped", F.col("run_length") >= limit)
            .withColumn("trip_chunk", F.when(F.col("tripped"), F.col("run_start") + (limit - 1))))
    # where the breaker first trips: one number, fetched by a small aggregate job
    # (a window without partitioning would move every run into one task)
    first = runs.agg(F.min("trip_chunk")).first()[0]
    flag = F.lit(False) if first is None else F.coalesce(F.col("trip_chunk") == F.lit(first), F.lit(False))
    return runs.withColumn("first_trip", flag).drop("_island")
