"""Registered queries through written files: CSV table, model output, dates of files, a stream's progress."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.fixtures import fixture, oracle
from trapline.operators import detections as det
from trapline.operators import labels as lab
from trapline.plans import catalog as base
from trapline.session import scratch_dir
from trapline.sinks.csv_excel import write_excel_csv
from trapline.sources.detections_csv import read_detections_csv, typed_detections
from trapline.sources.predictions import read_predictions
from trapline.streaming.ingest import ingest_stream
from trapline.streaming.progress import latest_progress

RUNS = 2


def q_csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections table exported as CSV (K2, K9) and read again; a column that the file lacks is empty."""
    path = scratch_dir(spark, "csv-table")
    write_excel_csv(base.detections_table(spark, sf_dir).select(*[c for c in base.TABLE_OUT if c != "common_name"]), path)
    return typed_detections(read_detections_csv(spark, path)).select(*base.TABLE_OUT)


SQL_CSV_TABLE = oracle(base.ORACLE_TABLE + f"""
select {', '.join("'' as common_name" if c == 'common_name' else f'confidence' if c == 'confidence' else f"coalesce({c}, '') as {c}"
                  for c in base.TABLE_OUT)} from dtable
""")


def q_predictions_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's output as JSON lines, read and parsed."""
    path = scratch_dir(spark, "model-output")
    (fixture(spark, sf_dir, "predictions")
     .select(F.col("image_path").alias("filepath"), "prediction", "prediction_score").write.json(path))
    shaped = det.parse_predictions(read_predictions(spark, path), base.names(spark, sf_dir), threshold=base.THRESHOLD)
    return shaped.select("image_path", "prediction", "species", "scientific_name", "confidence", "category")


SQL_PREDICTIONS_SOURCE = oracle(base.ORACLE_PARSED + """
select image_path, prediction, species, scientific_name, confidence, category from parsed
""")


def q_dates_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images without a stored date take their file's, where it has one."""
    table = base.images(spark, sf_dir)
    files = (table.where(F.col("img") % 2 == 0)
             .select("image_path", F.format_string("2019-%02d-01", F.col("img") % 12 + 1).alias("capture_date")))
    return lab.with_report_date(table, files).select("image_path", "report_date")


SQL_DATES_OF_FILES = oracle("""
select image_path, case when image_date <> '' then image_date
                        when img % 2 = 0 then '2019-' || lpad(cast(img % 12 + 1 as varchar), 2, '0') || '-01'
                        else 'unknown-date' end as report_date from images
""")


def q_stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a stream on one checkpoint; what the listener wrote of each, with the table's rows."""
    work = scratch_dir(spark, "progress")
    source, table, checkpoint, progress = (f"{work}/{n}" for n in ("source", "table", "checkpoint", "progress"))
    rows = base.images(spark, sf_dir).select("img", "image_path", "image_name", "image_date")
    for k in range(RUNS):
        part = rows.where(F.col("img") % RUNS == k)
        part.repartition(4).write.mode("append").parquet(source)
        ingest_stream(spark, source, rows.schema, lambda batch: batch, table, checkpoint, max_files_per_trigger=2,
                      progress_path=progress, total_rows=part.count())
    written = spark.read.parquet(table).agg(F.count(F.lit(1)).alias("table_rows"), F.countDistinct("image_path").alias("paths")).first()
    runs = latest_progress(spark, progress).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("rows_done").alias("rows_done"), F.min("percent").alias("percent"), F.max("eta_seconds").alias("eta"))
    return runs.withColumns({c: F.lit(written[c]).cast("long") for c in ("table_rows", "paths")})


SQL_STREAM_PROGRESS = oracle(f"""
select cast({RUNS} as bigint) as runs, cast(count(*) as bigint) as rows_done, cast(100 as double) as percent, cast(0 as double) as eta,
       cast(count(*) as bigint) as table_rows, cast(count(distinct image_path) as bigint) as paths from images
""")

QUERIES = {
    "csv_table": (q_csv_table, SQL_CSV_TABLE),
    "predictions_source": (q_predictions_source, SQL_PREDICTIONS_SOURCE),
    "dates_of_files": (q_dates_of_files, SQL_DATES_OF_FILES),
    "stream_progress": (q_stream_progress, SQL_STREAM_PROGRESS),
}
