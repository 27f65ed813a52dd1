"""Image listing and explicit file lists.

The folder tree is walked by the executors (``sources/folders.py``), one level of folders
a job, so every regular file is found (also names and folders that start with ``_`` or
``.``, which Spark's own file sources skip) and the driver holds no file index, only the
number of folders of a level.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.constants import IMAGE_EXTENSIONS
from trapline.sources.folders import absolute, file_system, scan_tree

LISTING_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), True),
    T.StructField("length", T.LongType(), True),
])


def strip_scheme(path_col) -> F.Column:
    """``file:/a/b`` and ``file:///a/b`` -> ``/a/b``; other schemes (``s3a://``, ``hdfs://``) are kept."""
    return F.regexp_replace(path_col, r"^file:/*(?=/)", "")


def list_images(spark: SparkSession, root: str, exts=IMAGE_EXTENSIONS, with_content: bool = False,
                state_path: str | None = None) -> DataFrame:
    """Every image file under ``root`` (recursive), extension matched case-insensitively (``exts=None``: every file).

    Returns ``path, modificationTime, length`` (plus ``content`` on request).  A
    missing folder gives an empty frame, an unreadable one is left out (``scan_tree``
    names it).  With ``state_path`` folders unchanged since the last run are not opened.
    The walk runs when the listing is made, and its levels are written tables.
    """
    return images_among(scan_tree(spark, root, state_path).files, exts, with_content)


def images_among(files: DataFrame, exts=IMAGE_EXTENSIONS, with_content: bool = False) -> DataFrame:
    """The listing of a scan's files with one of the extensions (``None``: all)."""
    if exts is not None:
        files = files.where(F.lower("path").rlike("(" + "|".join(re.escape(e.lower()) for e in exts) + ")$"))
    found = files.select("path", F.timestamp_seconds("mtime").alias("modificationTime"), "length")
    return with_file_content(found) if with_content else found


def with_file_content(listing: DataFrame) -> DataFrame:
    """The listing with each file's bytes in ``content`` (null if it can't be read)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):  # a file at a time keeps the output small
                yield pdf.iloc[i:i + 1].assign(content=[_content(pdf["path"].iloc[i])])

    return listing.mapInPandas(run, T.StructType([*listing.schema.fields, T.StructField("content", T.BinaryType())]))


def _content(path: str) -> bytes | None:
    try:
        if "://" in path:
            system, inner = file_system(path)
            with system.open_input_file(inner) as f:
                return f.read()
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def file_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """An explicit list of image paths (one row each, order kept in ``seen_order``)."""
    return spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, seen_order long")


__all__ = ["LISTING_SCHEMA", "absolute", "file_list", "file_system", "images_among", "list_images", "strip_scheme", "with_file_content"]
