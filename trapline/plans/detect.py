"""The detection job: list -> resume -> score -> shape -> best -> dates -> table (§3.1).

``detect_images`` builds one lazy plan; ``run_detection`` executes it once
and returns the run summary (A2) from the written rows.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from trapline.operators import detections as det
from trapline.operators.breaker import SharedBreaker
from trapline.operators.incremental import pending_images
from trapline.functions.paths import normal_path
from trapline.operators.scoring import BREAKER, ScorerFactory, ScoringOptions, score_images
from trapline.sinks.archive import Archive
from trapline.sinks.tables import append_detections, table_rows
from trapline.sources.predictions import best_box


def shape_predictions(predictions: DataFrame, names: DataFrame, threshold: float,
                      keep_col: str | None = None) -> DataFrame:
    """P1-P10 over scorer output.

    Without ``keep_col``, error rows and sub-threshold predictions are dropped;
    with it, every row stays and ``keep_col`` marks the kept ones.
    """
    if keep_col:
        usable = F.col("error").isNull()  # every row without an error is a prediction, blank if it says nothing
        shaped = det.parse_predictions(predictions, names, threshold=threshold, class_col="class",
                                       class_name_col="class_name", genus_col="genus", species_col="species",
                                       common_col="common_name", keep_col=keep_col)
        shaped = shaped.withColumn(keep_col, F.col(keep_col) & usable)
    else:
        ok = predictions.filter(F.col("error").isNull())
        shaped = det.parse_predictions(ok, names, threshold=threshold, class_col="class",
                                       class_name_col="class_name", genus_col="genus", species_col="species",
                                       common_col="common_name")
    shaped = shaped.withColumn("source", F.coalesce(F.col("prediction_source"), F.lit("classifier")))
    return shaped.withColumn("bbox", best_box(F.col("detections"))) if "detections" in shaped.columns else shaped


def image_rows(images: DataFrame, predictions: DataFrame, names: DataFrame, threshold: float,
               keep_failed: bool = False) -> DataFrame:
    """One detections-table row per scored image.

    One pass over the scorer output (the model runs once): a single aggregate
    per image gives the best kept detection, the number of kept detections
    and whether the image's chunk failed.  Images of failed chunks are left
    out (not marked done, Q13); ``keep_failed`` keeps them with ``_failed`` set
    (for callers that count them in the same pass).
    """
    # both sides name a file the same way
    images = images.withColumn("image_path", normal_path("image_path"))
    predictions = predictions.withColumn("image_path", normal_path("image_path"))
    shaped = shape_predictions(predictions, names, threshold, keep_col="_kept")
    extra = [c for c in ("source", "bbox") if c in shaped.columns]
    best = det.best_per_image(shaped, fields=(*det.DETECTION_FIELDS, *extra), count_col="n_detections",
                              keep_col="_kept",
                              extra_aggs=(F.max(F.col("error").isNotNull()).alias("_failed"),))
    rows = det.detections_table(images, best.drop("det_index")).withColumn(
        "_failed", F.coalesce(F.col("_failed"), F.lit(False)))
    if not keep_failed:
        rows = rows.filter(~F.col("_failed")).drop("_failed")
    return (rows.withColumn("n_detections", F.coalesce("n_detections", F.lit(0)))
            .withColumn("image_name", det.image_name(F.col("image_path")))
            .withColumn("timestamp", F.current_timestamp()))


@dataclass
class DetectionRun:
    rows: DataFrame          # image grain, ready for the table
    pending: DataFrame       # images to score after the resume filter
    observation: Observation | None = None  # listed / pending counts, filled by the write
    breaker: Observation | None = None  # images left alone by the breaker, filled by the write
    failures: SharedBreaker | None = None  # the job's log of failed chunks


def detect_images(listing: DataFrame, factory: ScorerFactory, names: DataFrame,
                  options: ScoringOptions | None = None, done: DataFrame | Archive | None = None,
                  capture_dates: DataFrame | None = None, read_exif: bool = True) -> DetectionRun:
    """Lazy plan for a folder listing (``path, modificationTime``) -> table rows.

    The capture date is stored once per image (P18): EXIF tags read from
    each pending file, else the file time.  ``capture_dates`` overrides
    it; ``read_exif=False`` uses the file time only.  Failed chunks in a row are
    counted over all tasks (``SharedBreaker``).
    """
    options = options or ScoringOptions()
    shared = SharedBreaker.of(listing.sparkSession, options.consecutive_error_limit)
    images = listing.select(normal_path("path").alias("image_path"), "modificationTime")
    pending = pending_images(images, done)
    obs = Observation()
    # counts ride along with the scoring job instead of separate count jobs
    pending = pending.observe(obs, F.count(F.lit(1)).alias("pending_images"))
    broken = Observation()
    preds = score_images(pending, factory, options, breaker=shared).observe(
        broken, F.count_if(F.col("error").startswith(BREAKER)).alias("not_scored"))
    rows = image_rows(pending, preds, names, options.confidence_threshold)
    if capture_dates is None and read_exif:
        from trapline.sources.exif import capture_dates_for

        capture_dates = capture_dates_for(pending)
    if capture_dates is not None:
        rows = rows.join(capture_dates.withColumnRenamed("capture_date", "image_date"), "image_path", "left")
        rows = rows.withColumn("image_date", F.coalesce(F.col("image_date"),
                                                        F.date_format("modificationTime", "yyyy-MM-dd")))
    else:
        rows = rows.withColumn("image_date", F.date_format("modificationTime", "yyyy-MM-dd"))
    rows = rows.withColumn("image_date", F.coalesce(F.col("image_date"), F.lit("")))
    return DetectionRun(rows=rows, pending=pending, observation=obs, breaker=broken, failures=shared)


def run_detection(run: DetectionRun, table_path: str | Archive, total_images: int | None = None) -> dict:
    """Execute the plan once: append the rows (K1) and return the run summary (A2).

    The rows go to a Parquet folder, or to the buckets of an ``Archive``.
    ``successful`` counts images with any detection above the threshold,
    blanks included (Q3); ``failed`` the others (Q4).  ``stopped`` is true when
    the breaker left images unscored (a resume takes them up again).  With ``total_images``
    (the listing size) ``skipped`` is the number filtered out by the resume.
    """
    obs = Observation()
    rows = run.rows.observe(obs, F.count(F.lit(1)).alias("total_processed"),
                            F.count_if(F.col("n_detections") > 0).alias("successful"))
    if isinstance(table_path, Archive):
        table_path.append(table_rows(rows))
        table_path = table_path.path
    else:
        append_detections(rows, table_path)
    m = _observed(obs)
    pending = _observed(run.observation).get("pending_images", 0) if run.observation is not None else None
    out = {"total_processed": int(m.get("total_processed", 0)), "successful": int(m.get("successful", 0)),
           "stopped": bool(_observed(run.breaker).get("not_scored", 0)) if run.breaker is not None else False, "csv_path": None, "table_path": table_path}
    out["failed"] = out["total_processed"] - out["successful"]
    out["skipped"] = (total_images - pending) if (total_images is not None and pending is not None) else None
    return out


def _observed(obs: Observation) -> dict:
    """Observed metrics; an empty relation may be pruned from the plan by AQE, and
    then its metrics never arrive - they are all zero in that case."""
    try:
        return obs.get or {}
    except Exception:  # noqa: BLE001
        return {}


def progress_metrics(processed: int, total: int, elapsed_seconds: float) -> dict:
    """Images per second, percent done and remaining seconds (0 when undefined)."""
    rate = processed / elapsed_seconds if elapsed_seconds > 0 else 0.0
    pct = processed * 100.0 / total if total > 0 else 0.0
    eta = (total - processed) / rate if rate > 0 and total > 0 else 0.0
    return {"rate": rate, "percent": pct, "eta_seconds": eta}


def first_images(listing: DataFrame, n: int) -> DataFrame:
    """The first ``n`` image paths in path order (a top-n, not a full sort)."""
    return listing.orderBy("path").limit(n)


__all__ = ["detect_images", "run_detection", "image_rows", "shape_predictions", "DetectionRun",
           "progress_metrics", "first_images"]
