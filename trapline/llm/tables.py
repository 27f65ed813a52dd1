"""Reading the tables and cutting lineage for the operators of this subpackage."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline import session

#: Spark's setting that frees a query's shuffle files when the query has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """A written table under spark.checkpoint.dir, read again; the shuffles that made it are freed.

    Nothing reads those shuffles later, and the table outlives lost executors.
    """
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, "false")
    conf.set(FREE_SHUFFLES, "true")
    try:
        return session.materialize(df)
    finally:
        conf.set(FREE_SHUFFLES, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table through Spark's reader (any store that Spark reaches)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")



#: Bytes up to which a table may be broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """A written (materialized) table of fixed-width rows with a broadcast hint if they fit the bound, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def packed(df: DataFrame, **more) -> DataFrame:
    """The rows as one struct column ``row``, and the given columns: no name of the frame can clash with an operator's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(name) for name, c in more.items()])


def unpacked(columns: list[str], added: tuple[str, ...] = ()) -> list:
    """The struct's columns again, without those that the operator's own columns replace."""
    return [F.col("row")[c].alias(c) for c in columns if c not in added]
