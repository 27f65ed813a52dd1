"""A detections table whose rows are numbered when written.

A batch is sorted by its own order once and its rows get the next numbers: the position
in the batch after the last number of the batches before.  A file holds a contiguous
run of numbers, and an index (a row a file) says which.  So a page reads only the files
that it lies in, first-seen order is a stored column, and no report sorts the table.

Each batch also leaves one row of counters with a mergeable sketch of its species, and its
distinct species, so that the table's metadata comes from a few rows a batch.

A batch counts once its index is written, last of all; a batch that failed before
is written again under its number.  One writer at a time.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trapline.constants import RESULTS_PER_PAGE
from trapline.session import materialize

SEQ = "seen_order"
INDEX = "file string, first_seq long, last_seq long, n long, batch int"
ROWS_A_FILE = 1 << 20


def with_position(df: DataFrame, order_cols: list[str], out_col: str, after: int = 0) -> DataFrame:
    """Exact positions ``after + 1 ...`` in the order of ``order_cols``: a range-partitioned sort and a prefix sum over its ranges."""
    at = materialize(df.orderBy(*order_cols).withColumn("_at", F.monotonically_increasing_id()))
    sizes = at.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    # one row a range of the sort
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (at.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_range")
            .withColumn(out_col, F.col("_before") + inside + (after + 1)).drop("_range", "_before", "_at"))


def _part(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{path.rstrip('/')}-{name}")
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], schema)


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, first_seq, last_seq, n, batch), one row a file."""
    return _part(spark, path, "index", INDEX)


def is_sequenced(spark: SparkSession, path: str) -> bool:
    return not index_of(spark, path).isEmpty()


def append_batch(rows: DataFrame, path: str, order_cols: list[str], rows_a_file: int = ROWS_A_FILE) -> int:
    """Appends a batch in its order; the batch's number.  ``order_cols`` should tell all rows apart."""
    spark, path = rows.sparkSession, path.rstrip("/")
    last = index_of(spark, path).agg(F.max("last_seq").alias("seq"), F.max("batch").alias("batch")).first()
    after, batch = last["seq"] or 0, 0 if last["batch"] is None else last["batch"] + 1
    numbered = with_position(rows.drop(SEQ), order_cols, SEQ, after)
    folder = f"{path}/batch={batch}"
    numbered = materialize(numbered)
    files = max(1, -(-numbered.count() // rows_a_file))
    numbered.repartitionByRange(files, SEQ).sortWithinPartitions(SEQ).write.mode("overwrite").parquet(folder)
    written = spark.read.parquet(folder)
    species = F.when(F.col("species") != "", F.col("species"))
    kinds = materialize(written.groupBy(species.alias("species")).agg(F.count(F.lit(1)).alias("n")))
    kinds.where("species IS NOT NULL").write.mode("overwrite").parquet(f"{path}-species/batch={batch}")
    state = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("species").isNotNull(), F.col("n"))), F.lit(0)).alias("detected"),
                      F.hll_sketch_agg("species").alias("sketch"))
    state.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{path}-states/batch={batch}")
    index = (written.groupBy(F.col("_metadata.file_path").alias("file"))
             .agg(F.min(SEQ).alias("first_seq"), F.max(SEQ).alias("last_seq"), F.count(F.lit(1)).alias("n")))
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}-index/batch={batch}")
    return batch


def read_sequenced(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the finished batches with their number; nothing is sorted."""
    last = index_of(spark, path).agg(F.max("batch")).first()[0]
    if last is None:
        raise FileNotFoundError(f"no finished batch at {path}")
    return spark.read.option("mergeSchema", "true").parquet(path.rstrip("/")).where(F.col("batch") <= last).drop("batch")


def read_page(spark: SparkSession, path: str, page: int, size: int = RESULTS_PER_PAGE) -> DataFrame:
    """Rows ``page * size + 1 ...`` in order, read from the files that hold them."""
    first, last = page * size + 1, (page + 1) * size
    hit = index_of(spark, path).where((F.col("last_seq") >= first) & (F.col("first_seq") <= last)).select("file").collect()  # at most size files
    if not hit:
        return read_sequenced(spark, path).limit(0)
    return spark.read.parquet(*sorted(r["file"] for r in hit)).where(F.col(SEQ).between(first, last)).orderBy(SEQ)


def table_metadata(spark: SparkSession, path: str, size: int = RESULTS_PER_PAGE) -> DataFrame:
    """A12, A13 from a few rows a batch: rows, detected rows, batches, pages, distinct species, and their sketch's estimate."""
    base = path.rstrip("/")
    done = index_of(spark, path).agg(F.max("batch")).first()[0]
    done = -1 if done is None else done
    states = _part(spark, base, "states", "rows long, detected long, sketch binary, written_at timestamp, batch int").where(F.col("batch") <= done)
    species = _part(spark, base, "species", "species string, n long, batch int").where(F.col("batch") <= done)
    # one pass over both: batch rows carry counters and a sketch, species rows only count
    rows = (states.select("rows", "detected", "sketch", F.lit(1).alias("b"), F.lit(0).alias("s"))
            .unionByName(species.select("species").distinct().select(F.lit(1).alias("s")), allowMissingColumns=True))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return (rows.agg(total("rows").alias("total_rows"), total("detected").alias("detected_rows"), total("b").alias("batches"),
                     F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("species_estimate"),
                     total("s").alias("distinct_species"))
            .withColumn("page_count", F.greatest(F.lit(1), F.ceil(F.col("total_rows") / size)).cast("long")))
