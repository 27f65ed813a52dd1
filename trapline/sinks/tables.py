"""The detections table (K1, O2, T6): Parquet, append-only, replay-safe."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.constants import DETECTION_COLUMNS

TABLE_EXTRA = ("seen_order", "bbox", "source")


def table_rows(df: DataFrame) -> DataFrame:
    """Project to the table layout: the ten DETECTION columns plus the extra kept ones."""
    cols = [F.col(c) if c in df.columns else F.lit("").alias(c) for c in DETECTION_COLUMNS]
    extra = [c for c in TABLE_EXTRA if c in df.columns]
    return df.select(*cols, *extra)


def append_detections(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """K1/O2: append rows to the Parquet table (columns aligned by name on read)."""
    w = table_rows(df).write.mode("append")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch to its own ``batch_id=`` folder, overwriting a replay.

    A replayed batch (after a driver failure) rewrites the same folder, so the
    table never holds its rows twice.
    """
    table_rows(df).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def read_table(spark, path: str) -> DataFrame:
    """The table as written by :func:`append_detections` / :func:`write_batch`."""
    return spark.read.option("mergeSchema", "true").parquet(path)


RUN_SCHEMA = ("run_id string, total_processed bigint, successful bigint, failed bigint, skipped bigint, "
              "stopped boolean, output_path string, recorded_at timestamp")


def record_run(spark, summary: dict, runs_path: str, run_id: str | None = None) -> None:
    """Append one row of run statistics to the ``runs`` table."""
    import datetime
    import uuid

    row = (run_id or uuid.uuid4().hex, int(summary.get("total_processed") or 0), int(summary.get("successful") or 0),
           int(summary.get("failed") or 0), int(summary.get("skipped") or 0), bool(summary.get("stopped")),
           summary.get("table_path") or summary.get("output_path"), datetime.datetime.now())
    spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(runs_path)


def read_dates(spark, path: str, start: str, end: str) -> DataFrame:
    """Rows with ``start <= image_date <= end`` (ISO text) from a table written with
    ``partition_by="image_date"``: the filter is a partition filter, so only the
    matching date folders are listed and read."""
    t = spark.read.parquet(path)
    return t.filter((F.col("image_date") >= start) & (F.col("image_date") <= end))
