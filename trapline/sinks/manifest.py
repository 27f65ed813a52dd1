"""Routing manifest (K7) in a scalable long form.

Instead of one JSON document holding every file name, the manifest is a
folder of JSON lines: ``summary`` (one line), ``folders`` (one line per
folder: key and file count) and ``files`` (one line per file), so a folder
holding a third of all files is never collected into one row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.operators.routing import folder_counts


def write_manifest(routed: DataFrame, path: str) -> None:
    """``routed`` has ``folder_key, dest_name`` (status rows of executed copies, or the plan)."""
    base = path.rstrip("/")
    counts = folder_counts(routed)
    (counts.agg(F.current_timestamp().cast("string").alias("created_at"),
                F.count(F.lit(1)).alias("total_folders"),
                F.coalesce(F.sum("file_count"), F.lit(0)).alias("total_files"))
     .coalesce(1).write.mode("overwrite").json(f"{base}/summary"))
    counts.select("folder_key", "file_count").write.mode("overwrite").json(f"{base}/folders")
    routed.select("folder_key", F.col("dest_name").alias("file")).write.mode("overwrite").json(f"{base}/files")
