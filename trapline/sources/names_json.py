"""Name dictionary JSON (S3): ``{"species": {...}, "genus": {...}, "category": {...}}``.

A missing or unreadable file degrades to an empty dictionary with a warning.
"""
from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.operators.names import NAMES_SCHEMA

_log = logging.getLogger(__name__)

_MAP = T.MapType(T.StringType(), T.StringType())
NAMES_FILE_SCHEMA = T.StructType([T.StructField(k, _MAP, True) for k in ("species", "genus", "category")])


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """NAMES rows ``(kind, name_key, name_value)`` from a dictionary file."""
    try:
        raw = (spark.read.schema(NAMES_FILE_SCHEMA).option("multiLine", True)
               .option("mode", "FAILFAST").json(path))
        parts = [raw.select(F.lit(kind).alias("kind"), F.explode_outer(kind).alias("name_key", "name_value"))
                 for kind in ("species", "genus", "category")]
        names = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(F.col("name_key").isNotNull())
        names.agg(F.count("name_value")).collect()  # read once now: a corrupt file degrades here, not inside a later job
    except Exception as e:  # noqa: BLE001
        _log.warning("name dictionary %s unreadable (%s); vernacular names stay empty", path, e)
        return spark.createDataFrame([], NAMES_SCHEMA)
    return names.select("kind", "name_key", F.coalesce("name_value", F.lit("")).alias("name_value"))
