"""Exact row positions inside (possibly huge) groups without one task per group.

``row_number()`` over ``partitionBy(group)`` sorts a whole group in one task.
A group may hold a third of all rows, so positions are computed in two steps:

1. rows are split into ``(group, bucket)`` slices, ``bucket = floor(order / bucket_rows)``,
   and numbered inside each slice;
2. per-slice counts (one row per slice, pre-aggregated) are prefix-summed per
   group and added as an offset.

The prefix sum runs over the small slice-count table (a hot group contributes
``rows / bucket_rows`` rows to it), and the join back is on the slice key the
numbered rows are already partitioned by.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.session import materialize

DEFAULT_BUCKET_ROWS = 1 << 20


def with_ordinal(df: DataFrame, group_cols: list[str], order_col: str, out_col: str = "ordinal",
                 bucket_rows: int = DEFAULT_BUCKET_ROWS, ties: tuple[str, ...] = ()) -> DataFrame:
    """1-based position of each row inside its group, ordered by numeric ``order_col``.

    ``order_col`` must be unique inside a group, or the columns ``ties`` tell
    its equal rows apart (else they are numbered arbitrarily, as with
    ``row_number``).  Buckets follow the order key, so a
    bucket holds at most ``bucket_rows`` distinct order values of one group.
    """
    bucket = "_ord_bucket"
    sliced = df.withColumn(bucket, F.floor(F.col(order_col) / F.lit(bucket_rows)).cast("long"))
    slice_cols = [*group_cols, bucket]
    local = sliced.withColumn(
        "_ord_local", F.row_number().over(Window.partitionBy(*slice_cols).orderBy(order_col, *ties)))
    # slice sizes from the numbered rows themselves: same exchange, so the input
    # is computed once, and the aggregate needs no new shuffle
    counts = local.groupBy(*slice_cols).agg(F.max("_ord_local").alias("_ord_n"))
    prior = Window.partitionBy(*group_cols).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_ord_off", F.coalesce(F.sum("_ord_n").over(prior), F.lit(0))).drop("_ord_n")
    joined = local.join(offsets, slice_cols, "inner") if group_cols else local.join(offsets, [bucket])
    return (joined.withColumn(out_col, (F.col("_ord_off") + F.col("_ord_local")).cast("long"))
            .drop(bucket, "_ord_local", "_ord_off"))


def with_marks_passed(df: DataFrame, marks: DataFrame, group_cols: list[str], order_col: str, out_col: str = "passed",
                      bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """How many ``marks`` of a row's group lie at or before the row, by the ``order_col`` that both frames have.

    As in :func:`with_ordinal`, rows and marks are counted inside ``(group, bucket)`` slices, and the
    slices' own counts are prefix-summed.  Marks of one place are summed first.  Rows with a null in
    ``group_cols`` or ``order_col`` are left out.
    """
    bucket = "_ord_bucket"
    slice_cols = [*group_cols, bucket]
    at = F.floor(F.col(order_col) / F.lit(bucket_rows)).cast("long")
    rows = df.withColumn(bucket, at)
    places = marks.groupBy(*group_cols, order_col).agg(F.count(F.lit(1)).alias("_ord_marks")).withColumn(bucket, at)
    running = (Window.partitionBy(*slice_cols).orderBy(order_col, F.col("_ord_marks").desc())
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = (rows.withColumn("_ord_marks", F.lit(0).cast("long")).withColumn("_ord_row", F.lit(True))
             .unionByName(places, allowMissingColumns=True)
             .withColumn("_ord_local", F.sum("_ord_marks").over(running)).filter("_ord_row"))
    # slices that have rows or marks: one row each
    counts = (rows.groupBy(*slice_cols).agg(F.lit(0).cast("long").alias("_ord_n"))
              .unionByName(places.groupBy(*slice_cols).agg(F.sum("_ord_marks").alias("_ord_n")))
              .groupBy(*slice_cols).agg(F.sum("_ord_n").alias("_ord_n")))
    prior = Window.partitionBy(*group_cols).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_ord_off", F.coalesce(F.sum("_ord_n").over(prior), F.lit(0))).drop("_ord_n")
    return (local.join(offsets, slice_cols).withColumn(out_col, F.col("_ord_off") + F.col("_ord_local"))
            .drop(bucket, "_ord_marks", "_ord_row", "_ord_local", "_ord_off"))


def with_rank(df: DataFrame, order: list, out_col: str = "rank", group: str | None = None) -> DataFrame:
    """1-based position (int) of each row in the whole frame by ``order``, or in its ``group``, without a one-task window.

    A range sort is written with each row's (sort partition, position inside it); the
    partitions' sizes, at most one row a partition and group, give the offsets.  ``group``
    is a column of a few values (a report's sections) and may span many partitions.
    It must not be null, and ``order`` must tell all its rows apart.  The result reads the written rows, so
    ranks are the same at every read.
    """
    spark, at, part, inside = df.sparkSession, "_rank_at", "_rank_part", "_rank_inside"
    keys = [group] if group else []
    placed = materialize(df.orderBy(*keys, *order).withColumn(at, F.monotonically_increasing_id()))
    # monotonically_increasing_id: the partition above bit 33, the position below
    placed = placed.withColumns({part: F.shiftright(at, 33), inside: F.col(at).bitwiseAND((1 << 33) - 1)}).drop(at)
    sizes = (placed.groupBy(part, *keys).agg(F.count(F.lit(1)).alias("n"), F.min(inside).alias("first")).collect())
    before, offsets = {}, []
    for r in sorted(sizes, key=lambda r: (r[part], r["first"])):
        g = r[group] if group else None
        offsets.append((r[part], *([g] if group else []), before.get(g, 0) + 1 - r["first"]))
        before[g] = before.get(g, 0) + r["n"]
    if group is None and len(offsets) <= 1:
        return placed.withColumn(out_col, (F.col(inside) + 1).cast("int")).drop(part, inside)
    # one row a sort partition and group
    schema = T.StructType([placed.schema[c] for c in (part, *keys)] + [T.StructField("_rank_off", T.LongType())])
    offsets = F.broadcast(spark.createDataFrame(offsets, schema))
    return (placed.join(offsets, [part, *keys]).withColumn(out_col, (F.col(inside) + F.col("_rank_off")).cast("int"))
            .drop(part, inside, "_rank_off"))


def with_path_order(df: DataFrame, order_cols: list[str], out_col: str = "seen_order") -> DataFrame:
    """Adds a number that rises in the order of ``order_cols``, over a range-partitioned sort (no single task).

    The numbers have gaps between the sort's partitions; only their order counts.
    The sorted rows are written once, so every reader sees the same numbers.
    """
    return materialize(df.orderBy(*order_cols).withColumn(out_col, F.monotonically_increasing_id()))
