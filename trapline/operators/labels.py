"""Report dates and report labels over the detections table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.constants import NO_DETECTION_LABELS, PIVOT_NO_DETECTION_LABEL, UNKNOWN_DATE
from trapline.functions.text import empty_if_null, is_no_detection, ustrip
from trapline.operators.names import with_resolved_vernacular


def with_report_date(df: DataFrame, capture_dates: DataFrame | None = None,
                     date_col: str = "image_date", key: str = "image_path",
                     out_col: str = "report_date") -> DataFrame:
    """Stored date, else the capture date of the file, else ``unknown-date``.

    ``capture_dates`` is ``(image_path, capture_date)``, e.g. from
    :func:`trapline.sources.exif.capture_dates`.  Only rows without a stored
    date are joined to it; the rest bypass the join.
    """
    stored = ustrip(empty_if_null(F.col(date_col)))
    df = df.withColumn("_stored_date", stored)
    if capture_dates is None:
        return df.withColumn(out_col, F.when(F.col("_stored_date") != "", F.col("_stored_date"))
                             .otherwise(F.lit(UNKNOWN_DATE))).drop("_stored_date")
    have = df.filter(F.col("_stored_date") != "").withColumn(out_col, F.col("_stored_date"))
    dates = capture_dates.select(F.col(key).alias("_cd_key"), F.col("capture_date").alias("_cd"))
    missing = (df.filter(F.col("_stored_date") == "")
               .join(dates, F.col(key) == F.col("_cd_key"), "left")
               .withColumn(out_col, F.coalesce(F.col("_cd"), F.lit(UNKNOWN_DATE)))
               .drop("_cd_key", "_cd"))
    return have.unionByName(missing).drop("_stored_date")


def no_detection_row(species, common_name, labels=NO_DETECTION_LABELS):
    """Table rule: empty species, or species and common name both no-detection labels."""
    s = ustrip(empty_if_null(species))
    return (s == "") | (is_no_detection(s, labels) & is_no_detection(common_name, labels))


def with_report_label(df: DataFrame, names: DataFrame, out_col: str = "label",
                      labels=NO_DETECTION_LABELS) -> DataFrame:
    """P20: no-detection label, else vernacular (resolved late, J7), else common, else species."""
    resolved = with_resolved_vernacular(df, names, out_col="_vern")
    resolved = resolved.withColumns({"_lab_sp": ustrip(empty_if_null(F.col("species"))),
                                     "_lab_cm": ustrip(empty_if_null(F.col("common_name")))})
    species, common = F.col("_lab_sp"), F.col("_lab_cm")
    label = (F.when(no_detection_row(species, common, labels), F.lit(PIVOT_NO_DETECTION_LABEL))
             .when(F.col("_vern") != "", F.col("_vern"))
             .when(~is_no_detection(common, labels), common)
             .otherwise(species))
    return resolved.withColumn(out_col, label).drop("_vern", "_lab_sp", "_lab_cm")


def daily_label_counts(labeled: DataFrame, date_col: str = "report_date",
                       label_col: str = "label") -> DataFrame:
    """Images per (date, label) plus date totals and label totals.

    One grouping-sets aggregate (partial aggregation before the shuffle, so a
    hot label does not skew it).  ``grouping_id``: 0 cell, 1 date total,
    2 label total.
    """
    d, lab = F.col(date_col), F.col(label_col)
    return (labeled.groupingSets([[d, lab], [d], [lab]], d, lab)
            .agg(F.count(F.lit(1)).alias("n_images"), F.grouping_id().cast("int").alias("grouping_id"))
            .withColumnRenamed(date_col, "image_date"))
