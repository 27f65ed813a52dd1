"""Detections table as CSV (S2): header-named, BOM-tolerant, three layouts.

CSV is the exchange format; the table of record is Parquet (K1).  Columns are
bound by header name, missing ones read as ``''`` and nulls become ``''``.
Files of different layouts are read one by one and aligned by name.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.constants import DETECTION_COLUMNS
from trapline.functions.numbers import safe_double
from trapline.functions.text import ustrip


def _read_one(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("header", True).option("multiLine", True)
            .option("encoding", "UTF-8").option("escape", '"').csv(path))


def read_detections_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All-string DETECTION columns (``''`` for absent values), plus any extra columns.

    Each given path is read on its own and the results are aligned by column
    name, so files of different layouts can be mixed.  A folder is read as
    one source and must therefore hold files of a single layout.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    frames = [_read_one(spark, p) for p in paths]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f, allowMissingColumns=True)
    # a BOM that survived in the first header cell
    for c in df.columns:
        if c.startswith("\ufeff"):
            df = df.withColumnRenamed(c, c.lstrip("\ufeff"))
    # Q18: values are stripped once here, so every report groups the same strings
    df = df.withColumns({c: ustrip(F.coalesce(F.col(f"`{c}`"), F.lit(""))) if c in df.columns else F.lit("")
                         for c in DETECTION_COLUMNS})
    extra = [c for c in df.columns if c not in DETECTION_COLUMNS]
    return df.select(*DETECTION_COLUMNS, *extra)


def typed_detections(df: DataFrame) -> DataFrame:
    """Confidence as a double (P15: non-numeric -> 0)."""
    return df.withColumn("confidence", safe_double(F.col("confidence")))
