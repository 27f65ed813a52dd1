"""Job-level entry points over a stored detections table (§3.2-§3.4 of the survey).

Each job reads the table (Parquet, or the CSV exchange format), runs the
relational plan and writes its report; the only driver-side values are
single-row totals and the pivot's date list.
"""
from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.constants import SUMMARY_TOTAL_IMAGES
from trapline.operators import labels as lab
from trapline.operators import reports as rep
from trapline.operators import routing as rt
from trapline.operators.names import names_frame
from trapline.operators.ordinal import with_path_order
from trapline.session import materialize, scratch_dir
from trapline.sinks.csv_excel import write_pivot, write_species_list, write_summary_report
from trapline.sinks.files import DONE, execute_routing
from trapline.sinks.manifest import write_manifest
from trapline.sinks.manifest_document import write_manifest_document
from trapline.sinks.sequenced import is_sequenced, read_sequenced
from trapline.sources.detections_csv import read_detections_csv, typed_detections
from trapline.sources.images import absolute, list_images


def load_table(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    """The detections table from Parquet or from CSV (by extension), with a ``seen_order``.

    CSV rows keep file order as ``seen_order`` (single file: row position);
    tables numbered when written (``sinks/sequenced.py``) and others that carry the
    column are read as they are.  Else it is the row's position in path order (then by
    species, confidence and time, for rows of one path), the same at every read however
    the files are split, which sorts and writes the table once; not if ``ordered`` is false.
    """
    if not path.endswith(".csv") and is_sequenced(spark, path):
        return read_sequenced(spark, path)
    if path.endswith(".csv"):
        t = typed_detections(read_detections_csv(spark, path))
        return t.withColumn("seen_order", F.monotonically_increasing_id())
    t = spark.read.parquet(path)
    if ordered and "seen_order" not in t.columns:
        ties = [c for c in ("species", "confidence", "timestamp", "image_name") if c in t.columns]
        t = with_path_order(t, ["image_path", *ties])
    return t


def pivot_report(spark: SparkSession, table_path: str, out_path: str, names: DataFrame | None = None,
                 image_root: str | None = None) -> DataFrame:
    """§3.2: date x label pivot (K6).  Dates missing from the table are read from the
    image files under ``image_root`` (EXIF, then file time) when given (J6)."""
    names = names if names is not None else names_frame(spark)
    table = load_table(spark, table_path, ordered=False)  # counts only
    caps = _missing_dates(table) if image_root else None
    labeled = lab.with_report_label(lab.with_report_date(table, caps), names)
    pivot = rep.daily_label_pivot(lab.daily_label_counts(labeled))
    write_pivot(pivot, out_path)
    return pivot


def _missing_dates(table: DataFrame) -> DataFrame:
    """Capture dates read from the files of rows without a stored date (J6), and only those."""
    from trapline.functions.text import empty_if_null, ustrip
    from trapline.sources.exif import capture_dates_for

    return capture_dates_for(table.filter(ustrip(empty_if_null(F.col("image_date"))) == ""))


def summary_report_job(spark: SparkSession, table_path: str, out_path: str,
                       names: DataFrame | None = None) -> DataFrame:
    """§3.4: the multi-section summary (K3)."""
    names = names if names is not None else names_frame(spark)
    began = time.monotonic()
    report = materialize(rep.summary_report(load_table(spark, table_path), names))
    images = report.filter(F.col("item") == SUMMARY_TOTAL_IMAGES).first()["n"]
    write_summary_report(report, out_path, source=table_path, seconds=time.monotonic() - began, images=images)
    return report


def species_list_job(spark: SparkSession, detections: DataFrame, out_path: str,
                     names: DataFrame | None = None) -> DataFrame:
    """K5 over a detection-grain frame (every detection counts)."""
    names = names if names is not None else names_frame(spark)
    out = rep.species_list(detections, names)
    write_species_list(out, out_path)
    return out


def route_images(spark: SparkSession, table_path: str, image_root: str, out_base: str,
                 mode: str = "copy", by_date: bool = False, names: DataFrame | None = None,
                 status_path: str | None = None, manifest_path: str | None = None, document_path: str | None = None) -> dict:
    """§3.3: plan (J5, J7, P19-P24), unique names against files already in ``out_base`` (W2),
    copy or move (K8), manifest (K7; ``document_path``: as one JSON document in pieces) and statistics (A11)."""
    names = names if names is not None else names_frame(spark)
    out_base = absolute(out_base)
    listing = list_images(spark, image_root)
    table = load_table(spark, table_path)
    caps = _missing_dates(table) if by_date else None
    plan = rt.routing_plan(table, names, out_base, by_date=by_date, listing=listing, capture_dates=caps)
    # every name in the target folders counts, images or not
    present = list_images(spark, out_base, exts=None).select(
        F.regexp_replace("path", r"/[^/]*$", "").alias("target_dir"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"))
    routed = rt.dedup_destinations(plan, present)
    # the status rows are written once (shared scratch folder by default), so the
    # files are handled exactly once however many reports read them
    status = execute_routing(routed, mode=mode, status_path=status_path or scratch_dir(spark, "route-status"))
    done = status.filter(F.col("status").isin(*DONE))
    if manifest_path:
        write_manifest(done, manifest_path)
    if document_path:
        write_manifest_document(done, document_path)
    stats = rt.routing_stats(rt.folder_counts(done)).first()
    failed = status.filter(~F.col("status").isin(*DONE)).count()
    return {**stats.asDict(), "failed_files": failed}
