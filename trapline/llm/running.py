"""Running totals inside groups of any size, without a group in one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.llm.tables import materialize

_EMPTY = {"sum": lambda: F.lit(0).cast("long"), "xor": lambda: F.lit(0).cast("long")}
_MERGE = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}
_TOTAL = {"sum": F.sum, "xor": F.bit_xor}


def running(df: DataFrame, group: list[str], order: list[str], **totals: tuple[str, Column]) -> DataFrame:
    """``df`` with one more column for each of ``totals``: the inclusive running "sum" or "xor" of an expression.

    Rows are range-partitioned by group and order (which must be a total order of a
    group's rows, nulls first) and written with their range's number; totals run
    inside a range, and a group that spans ranges adds those of its ranges before,
    a table of at most a row or two a range.
    """
    parts = df.repartitionByRange(*group, *order) if group or order else df
    parts = materialize(parts.withColumn("_part", F.spark_partition_id()))
    keys = ["_part", *group]
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = parts.withColumns({name: _TOTAL[kind](x).over(here) for name, (kind, x) in totals.items()})
    whole = parts.groupBy(*keys).agg(*[_TOTAL[kind](x).alias(f"_{name}") for name, (kind, x) in totals.items()])
    # one row a range and group: a group has at most as many as there are ranges
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (whole.withColumns({f"_{name}": _TOTAL[kind](f"_{name}").over(before) for name, (kind, _) in totals.items()})
               .withColumn("_ranges", F.count(F.lit(1)).over(before)).where("_ranges > 0").drop("_ranges"))
    both = inside.join(F.broadcast(materialize(offsets)), keys, "left")
    return both.withColumns({name: _MERGE[kind](F.col(name), F.coalesce(f"_{name}", _EMPTY[kind]()))
                             for name, (kind, _) in totals.items()}).drop("_part", *[f"_{name}" for name in totals])
