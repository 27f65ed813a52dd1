"""Registered queries over tables that grow: bucketed archive, numbered table, live counts."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.constants import RESULTS_PER_PAGE
from trapline.fixtures import fixture, oracle
from trapline.operators import labels as lab
from trapline.plans import catalog as base
from trapline.session import scratch_dir
from trapline.sinks import sequenced
from trapline.sinks.archive import Archive
from trapline.streaming.live_counts import count_stream, read_counts, with_totals

BUCKETS = 16
PAGE = 3
KEYS = ["image_date", "label"]


def stored(table: DataFrame) -> DataFrame:
    """The detections table's columns as they are stored."""
    return table.select("img", "image_path", "image_name", "species", "scientific_name", "common_name", "japanese_name", "category",
                        "confidence", "image_date")


def q_resume_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 against a bucketed archive filled by two runs."""
    done = fixture(spark, sf_dir, "processed").select("image_path")
    archive = Archive.create(spark, scratch_dir(spark, "archive"), done.schema, BUCKETS)
    odd = F.pmod(F.crc32("image_path"), F.lit(2)) == 1
    archive.append(done.where(odd))
    archive.append(done.where(~odd).select(F.concat(F.lit(" "), "image_path", F.lit("\t")).alias("image_path")))
    return archive.pending(base.images(spark, sf_dir)).select("image_path", "img")


def _sequenced(spark: SparkSession, sf_dir: str) -> str:
    """The detections table appended in three batches, each in path order."""
    path = scratch_dir(spark, "sequenced")
    rows = base.materialize(stored(base.detections_table(spark, sf_dir)))
    for k in range(3):
        sequenced.append_batch(rows.where(F.col("img") % 3 == k), path, ["image_path", "img"], rows_a_file=2000)
    return path


def q_page_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5 from the numbered table: the page's files only."""
    page = sequenced.read_page(spark, _sequenced(spark, sf_dir), PAGE)
    return page.select(F.col(sequenced.SEQ).alias("row_no"), "image_path", "species", "confidence")


def q_live_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 from the batches' counters; the sketch must be within 5 % of the exact number."""
    got = sequenced.table_metadata(spark, _sequenced(spark, sf_dir))
    near = F.abs(F.col("species_estimate") - F.col("distinct_species")) <= 0.05 * F.col("distinct_species") + 0.5
    return got.select("total_rows", "detected_rows", "batches", "distinct_species", "page_count", near.alias("estimate_near"))


def q_live_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, A7 kept by a stream over the stored table, in several triggers and two runs."""
    work = scratch_dir(spark, "live")
    source, target, checkpoint = f"{work}/table", f"{work}/counts", f"{work}/checkpoint"
    rows = base.materialize(stored(base.detections_table(spark, sf_dir)))
    names = base.names(spark, sf_dir)

    def shape(t: DataFrame) -> DataFrame:
        return lab.with_report_label(lab.with_report_date(t), names).select(F.col("report_date").alias("image_date"), "label")

    for k in range(2):  # the second run goes on from the checkpoint
        rows.where(F.col("img") % 2 == k).repartition(4).write.mode("append").parquet(source)
        count_stream(spark, source, rows.schema, shape, KEYS, target, checkpoint, max_files_per_trigger=2, compact_every=3)
    return with_totals(read_counts(spark, target, KEYS), KEYS).withColumnRenamed("n", "n_images")


SQL_PAGE_BY_INDEX = oracle(base.ORACLE_TABLE + f"""
select * from (select cast(row_number() over (order by img % 3, image_path, img) as bigint) as row_no, image_path, species, confidence from dtable) r
where row_no > {PAGE * RESULTS_PER_PAGE} and row_no <= {(PAGE + 1) * RESULTS_PER_PAGE}
""")

SQL_LIVE_METADATA = oracle(base.ORACLE_TABLE + f"""
select cast(count(*) as bigint) as total_rows, cast(count(case when species <> '' then 1 end) as bigint) as detected_rows,
       cast(3 as bigint) as batches, cast(count(distinct case when species <> '' then species end) as bigint) as distinct_species,
       cast(greatest(1, ceil(count(*) / {RESULTS_PER_PAGE}.0)) as bigint) as page_count, true as estimate_near
from dtable
""")

QUERIES = {
    "resume_archive": (q_resume_archive, base.SQL_RESUME_PENDING),
    "page_by_index": (q_page_by_index, SQL_PAGE_BY_INDEX),
    "live_metadata": (q_live_metadata, SQL_LIVE_METADATA),
    "live_daily_counts": (q_live_daily_counts, base.SQL_DAILY_LABEL_COUNTS),
}
