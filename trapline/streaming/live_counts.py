"""Counts that follow the table as it grows (A6, A7 over T1).

A stateful aggregation in update mode: each trigger emits only the groups whose count
changed, with their new counts, and the state store under the checkpoint remembers the
rest.  Changes are written by upsert: a batch's changed groups go to their own folder (a
replay overwrites it), the latest count of a group holds, and every ``compact_every``
batches the latest counts become a new base, so a read stays small.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPACT_EVERY = 16


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _latest(spark: SparkSession, target: str, keys: list[str], upto: int | None = None) -> DataFrame | None:
    """The newest counts: the last base and the changes after it (to ``upto``)."""
    base, changes = _read(spark, f"{target}/base"), _read(spark, f"{target}/changes")
    last = base.agg(F.max("upto")).first()[0] if base is not None else None
    parts = []
    if last is not None:
        parts.append(base.where(F.col("upto") == last).select(*keys, "n", F.lit(-1).cast("long").alias("version")))
    if changes is not None:
        news = changes.where(F.col("batch_id") > (-1 if last is None else last))
        news = news if upto is None else news.where(F.col("batch_id") <= upto)
        parts.append(news.select(*keys, "n", F.col("batch_id").cast("long").alias("version")))
    if not parts:
        return None
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy(*keys).agg(F.max_by("n", "version").alias("n"))


def read_counts(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """(keys, n) as of the last finished trigger."""
    got = _latest(spark, target.rstrip("/"), keys)
    if got is None:
        raise FileNotFoundError(f"no counts at {target}")
    return got


def count_stream(spark: SparkSession, source: str, schema, shape: Callable[[DataFrame], DataFrame], keys: list[str],
                 target: str, checkpoint: str, max_files_per_trigger: int = 100, compact_every: int = COMPACT_EVERY) -> int:
    """Counts the table's new files by ``keys`` until all there are counted; the number of triggers.

    ``shape`` turns stored rows into rows with the keys, one by one (lookups in static tables are fine).
    """
    target, triggers = target.rstrip("/"), []

    def upsert(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/changes/batch_id={batch_id}")
        triggers.append(batch_id)
        if (batch_id + 1) % compact_every == 0:
            _latest(changed.sparkSession, target, keys, batch_id).write.mode("overwrite").parquet(f"{target}/base/upto={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)
    counts = shape(stream).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    query = (counts.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return len(triggers)


def with_totals(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The counts with the totals of the first key and of the second, and ``grouping_id`` as in the batch report."""
    one, two = keys
    return (counts.groupingSets([(one, two), (one,), (two,)], one, two)
            .agg(F.sum("n").cast("long").alias("n"), F.grouping_id(one, two).cast("int").alias("grouping_id")))
