"""A detections table bucketed by path, for resumes that leave it where it lies.

Rows are written in buckets of the hash of their trimmed path, sorted inside a bucket.
A new listing is dealt out to the same buckets, and "not yet in the table" is an anti join
of bucket with bucket: only the listing is exchanged, however large the archive is.

The bucket number is fixed when the archive is made and kept beside it, with the schema,
so any session can open it (the catalog entry is only a name for the folder).  Choose
it for the archive's final size, as a task reads one bucket.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.functions.text import empty_if_null, ustrip

KEY = "path_key"


def path_key(column) -> F.Column:
    """What a stored path is compared by (O1): trimmed, null as empty."""
    return ustrip(empty_if_null(column))


@dataclass(frozen=True)
class Archive:
    """A bucketed table below ``path``."""
    spark: SparkSession
    path: str
    buckets: int
    schema: T.StructType

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, buckets: int) -> Archive:
        """An empty archive for rows of ``schema`` (with ``image_path``)."""
        fields = [f for f in schema.fields if f.name != KEY]
        out = cls(spark, path.rstrip("/"), buckets, T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField(KEY, T.StringType())]))
        spark.createDataFrame([(buckets, out.schema.json())], "buckets int, schema string").coalesce(1).write.json(f"{out.path}-spec")
        out._register()
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Archive | None:
        """The archive made at ``path`` by any session, or None."""
        try:
            spec = spark.read.schema("buckets int, schema string").json(f"{path.rstrip('/')}-spec").first()
        except AnalysisException:
            return None
        import json

        out = cls(spark, path.rstrip("/"), spec["buckets"], T.StructType.fromJson(json.loads(spec["schema"])))
        out._register()
        return out

    @property
    def name(self) -> str:
        return "trapline_archive_" + hashlib.sha1(self.path.encode()).hexdigest()[:16]

    def _register(self) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        where = self.path.replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet OPTIONS (path '{where}') "
                       f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {self.buckets} BUCKETS")

    def append(self, rows: DataFrame) -> None:
        """Adds rows (columns by name, missing ones null), one file a bucket."""
        columns = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
                   for f in self.schema.fields if f.name != KEY]
        keyed = rows.select(*columns, path_key(F.col("image_path")).alias(KEY))
        (keyed.repartition(self.buckets, KEY).write.format("parquet").bucketBy(self.buckets, KEY).sortBy(KEY)
         .option("path", self.path).mode("append").saveAsTable(self.name))

    def rows(self) -> DataFrame:
        """All rows, with their key; the scan knows the buckets."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def done(self) -> DataFrame:
        """(path_key) of the stored paths (O1)."""
        return self.rows().select(KEY).where(F.col(KEY) != "")

    def pending(self, images: DataFrame, key: str = "image_path") -> DataFrame:
        """The images whose path is not stored yet (J2, O3); duplicates stay.  Only the images are exchanged."""
        return images.join(self.done().hint("merge"), F.col(key) == F.col(KEY), "left_anti")
