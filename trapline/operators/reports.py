"""Reports over the detections table (image grain) or the detection grain.

A1 totals, A3 species and A4 category frequency, A5 confidence bands, K3 the
tidy summary report, A9 species list, A8 the date x label pivot, A12 result
metadata and L5 result pages.  All are partial + final hash aggregates; ranks
over labels (free text makes them many) are positions in a range sort, never a
window without partitions.  The only driver-side values are the pivot's date list
(bounded, checked), single-row totals and the sort partitions' sizes.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.constants import (
    CONFIDENCE_BANDS,
    PIVOT_NO_DETECTION_LABEL,
    PIVOT_TOTAL_IMAGES_LABEL,
    PIVOT_TOTAL_LABEL,
    RESULT_PAGE_EMPTY_SPECIES,
    RESULTS_PER_PAGE,
    SUMMARY_BASIC_SECTION,
    SUMMARY_CATEGORY_SECTION,
    SUMMARY_CONFIDENCE_SECTION,
    SUMMARY_DETECTED_IMAGES,
    SUMMARY_SPECIES_SECTION,
    SUMMARY_SUCCESS_RATE,
    SUMMARY_TOTAL_DETECTIONS,
    SUMMARY_TOTAL_IMAGES,
    SUMMARY_UNDETECTED_IMAGES,
    UNKNOWN_DATE,
)
from trapline.functions.numbers import band_index, percent
from trapline.functions.text import empty_if_null
from trapline.operators.names import with_category_label, with_resolved_vernacular
from trapline.operators.ordinal import with_ordinal, with_rank
from trapline.session import materialize

# widest pivot made of the data's own dates; later dates share the last column, and
# the long form (date, label, count) of sinks.csv_excel has no limit
MAX_PIVOT_DATES = 10_000
PIVOT_OTHER_DATES = "other-dates"


def _detected(df: DataFrame):
    return empty_if_null(F.col("species")) != ""


# ---------------------------------------------------------------------------
# A1 / A3 / A4 / A5 (table form: best detection per image)
# ---------------------------------------------------------------------------

def summary_totals(table: DataFrame) -> DataFrame:
    """A1: images, detected (non-empty species), undetected, detections, success %."""
    agg = table.agg(F.count(F.lit(1)).alias("total_images"),
                    F.count_if(_detected(table)).cast("long").alias("detected_images"))
    return (agg.withColumn("undetected_images", F.col("total_images") - F.col("detected_images"))
            .withColumn("total_detections", F.col("detected_images"))
            .withColumn("success_rate", percent("detected_images", "total_images")))


def frequency(df: DataFrame, key: str, order_col, out_count: str = "n") -> DataFrame:
    """Counts per ``key`` with % of all counted rows and a stable rank.

    ``rank`` orders by count descending, ties by first appearance (smallest
    ``order_col``; a tuple of columns orders lexicographically), like a stable
    sort over first-seen order, then by key.
    """
    return _ranked(_counted(df, F.col(key).alias(key), order_col, out_count), key, out_count)


def _counted(df: DataFrame, key, order_col, out_count: str = "n") -> DataFrame:
    cols = (order_col,) if isinstance(order_col, str) else tuple(order_col)
    seen = F.struct(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(out_count), F.min(seen).alias("_first_seen"))


def _ranked(counts: DataFrame, key: str, out_count: str = "n", listed=None) -> DataFrame:
    """Rank and % of all counted rows; with ``listed`` the rows where it holds, ranked among themselves."""
    order = [F.desc(out_count), F.col("_first_seen"), F.col(key)]
    if listed is None:
        ranked = with_rank(counts, order)
    else:
        ranked = with_rank(counts.withColumn("_listed", F.coalesce(listed, F.lit(False))), order, group="_listed")
    total = ranked.agg(F.sum(out_count).alias("n")).first()["n"]  # all rows, listed or not
    shown = ranked if listed is None else ranked.where("_listed")
    return (shown.withColumn("pct", percent(F.col(out_count), F.lit(total).cast("long")))
            .select(*[c for c in counts.columns if c != "_first_seen"], "pct", "rank"))


def species_frequency(table: DataFrame, order_col: str = "seen_order") -> DataFrame:
    """A3: species of detected images with % of detections."""
    return frequency(table.filter(_detected(table)), "species", order_col)


def category_frequency(table: DataFrame, names: DataFrame, order_col: str = "seen_order") -> DataFrame:
    """A4: non-empty categories of detected images, % of detections, translated label."""
    detected = table.filter(_detected(table))
    counts = _counted(detected, empty_if_null(F.col("category")).alias("category"), order_col)
    # % of all detections: the empty category counts there
    return with_category_label(_ranked(counts, "category", listed=F.col("category") != ""), F.col("category"), names)


def bands_frame(spark) -> DataFrame:
    rows = [(i, label) for i, (label, _) in enumerate(CONFIDENCE_BANDS)]
    return spark.createDataFrame(rows, "band int, band_label string")


def confidence_bands(table: DataFrame, confidence_col: str = "confidence",
                     only_detected: bool = True) -> DataFrame:
    """A5: always five bands, zero-filled; NaN lands in the lowest band."""
    src = table.filter(_detected(table)) if only_detected else table
    counts = src.groupBy(band_index(F.col(confidence_col)).alias("band")).agg(
        F.count(F.lit(1)).alias("n"))
    bands = F.broadcast(bands_frame(table.sparkSession))  # literal, five rows
    return (bands.join(counts, "band", "left")
            .select("band", "band_label", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def summary_report(table: DataFrame, names: DataFrame, order_col: str = "seen_order") -> DataFrame:
    """K3: one tidy frame ``(section, ord, item, n, pct)`` of A1, A3, A4, A5.

    One pass: a grouping-sets aggregate over ``(), (species), (category),
    (band)`` (partial aggregation before a single shuffle); ranks are positions
    in a range sort of that aggregate, by section.
    """
    det = _detected(table)
    t = table.select(empty_if_null(F.col("species")).alias("species"),
                     empty_if_null(F.col("category")).alias("category"),
                     band_index(F.col("confidence")).alias("band"),
                     det.alias("_det"), F.col(order_col).alias("_seen"))
    agg = (t.groupingSets([[], [F.col("species")], [F.col("category")], [F.col("band")]],
                          "species", "category", "band")
           .agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("_det")).alias("_n"),
                F.min(F.when(F.col("_det"), F.col("_seen"))).alias("_first"),
                F.grouping_id().alias("_gid")))
    # _gid bits (species, category, band): 7 = grand total, 3 = species, 5 = category, 6 = band
    item_col = F.when(F.col("_gid") == 3, F.col("species")).when(F.col("_gid") == 5, F.col("category"))
    listed = F.coalesce((item_col != "") & (F.col("_n") > 0), F.lit(False))
    agg = with_rank(agg.withColumn("_section", F.when(listed, F.col("_gid")).otherwise(F.lit(0))),
                    [F.desc("_n"), F.col("_first"), F.col("_gid"), item_col, F.col("band")], "_rank", group="_section")
    totals = agg.filter(F.col("_gid") == 7)
    grand = totals.select("_n").first()
    total_det = F.lit(grand["_n"] if grand else None).cast("long")

    def item(ord_, label, n, pct):
        return F.struct(F.lit(ord_).alias("ord"), F.lit(label).alias("item"),
                        n.cast("long").alias("n"), pct.cast("double").alias("pct"))

    none = F.lit(None)
    basic = totals.select(F.explode(F.array(
        item(1, SUMMARY_TOTAL_IMAGES, F.col("_all"), none),
        item(2, SUMMARY_DETECTED_IMAGES, F.col("_n"), none),
        item(3, SUMMARY_UNDETECTED_IMAGES, F.col("_all") - F.col("_n"), none),
        item(4, SUMMARY_TOTAL_DETECTIONS, F.col("_n"), none),
        item(5, SUMMARY_SUCCESS_RATE, none, percent(F.col("_n"), F.col("_all"))),
    )).alias("r")).select(F.lit(SUMMARY_BASIC_SECTION).alias("section"), "r.*")

    species = (agg.filter(F.col("_section") == 3)
               .select(F.lit(SUMMARY_SPECIES_SECTION).alias("section"), F.col("_rank").alias("ord"),
                       F.col("species").alias("item"), F.col("_n").cast("long").alias("n"),
                       percent(F.col("_n"), total_det).alias("pct")))
    category = (agg.filter(F.col("_section") == 5)
                .select("category", F.col("_rank").alias("ord"), F.col("_n").cast("long").alias("n"),
                        percent(F.col("_n"), total_det).alias("pct")))
    category = with_category_label(category, F.col("category"), names).select(
        F.lit(SUMMARY_CATEGORY_SECTION).alias("section"), "ord", F.col("category_label").alias("item"), "n", "pct")
    band_counts = agg.filter(F.col("_gid") == 6).select("band", F.col("_n").alias("n"))
    bands = (F.broadcast(bands_frame(table.sparkSession)).join(band_counts, "band", "left")  # five rows
             .select(F.lit(SUMMARY_CONFIDENCE_SECTION).alias("section"), (F.col("band") + 1).alias("ord"),
                     F.col("band_label").alias("item"), F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
                     F.lit(None).cast("double").alias("pct")))
    return basic.unionByName(species).unionByName(category).unionByName(bands)


# ---------------------------------------------------------------------------
# A1 / A3 / A4 / A5 over every detection (the in-memory form, Q21)
# ---------------------------------------------------------------------------

def detection_totals(images: DataFrame, dets: DataFrame, key: str = "image_path") -> DataFrame:
    """A1 array form: images, images with any detection (blanks included), all detections, %."""
    per_image = dets.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    joined = images.select(key).join(per_image, key, "left")
    agg = joined.agg(F.count(F.lit(1)).alias("total_images"),
                     F.count_if(F.col("_n") > 0).cast("long").alias("detected_images"),
                     F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("total_detections"))
    return (agg.withColumn("undetected_images", F.col("total_images") - F.col("detected_images"))
            .withColumn("success_rate", percent("detected_images", "total_images")))


def detection_species_frequency(dets: DataFrame, order_cols=("seen_order", "det_index")) -> DataFrame:
    """A3 over every detection: empty species (blank detections) are counted too."""
    return frequency(dets.withColumn("species", empty_if_null(F.col("species"))), "species", order_cols)


def detection_category_frequency(dets: DataFrame, names: DataFrame,
                                 order_cols=("seen_order", "det_index")) -> DataFrame:
    """A4 over every detection, translated after counting."""
    counted = frequency(dets.withColumn("category", empty_if_null(F.col("category"))), "category", order_cols)
    return with_category_label(counted, F.col("category"), names)


# ---------------------------------------------------------------------------
# A9 species list (detection grain: every detection counts)
# ---------------------------------------------------------------------------

def species_list(dets: DataFrame, names: DataFrame, order_cols=("seen_order", "det_index")) -> DataFrame:
    """Per species count, max (floored at 0) and mean confidence, first-seen attributes."""
    seen = F.struct(*[F.col(c) for c in order_cols])
    attrs = F.struct("common_name", "japanese_name", "scientific_name", "category")
    agg = (dets.groupBy("species")
           .agg(F.count(F.lit(1)).alias("detection_count"),
                F.greatest(F.max("confidence"), F.lit(0.0)).alias("max_confidence"),
                F.avg("confidence").alias("avg_confidence"),
                F.min_by(attrs, seen).alias("_first"),
                F.min(seen).alias("_seen")))
    ranked = with_rank(agg, [F.desc("detection_count"), F.col("_seen"), F.col("species")])
    out = ranked.select("species", "_first.*", "detection_count", "max_confidence", "avg_confidence", "rank")
    out = with_resolved_vernacular(out, names)
    return with_category_label(out, F.col("category"), names).drop("category")


# ---------------------------------------------------------------------------
# A8 pivot, L3/L4 ordering
# ---------------------------------------------------------------------------

def pivot_dates(counts: DataFrame, date_col: str = "image_date") -> list[str]:
    """L3: the first distinct dates in ascending order, ``unknown-date`` last, at most :data:`MAX_PIVOT_DATES`."""
    known = counts.select(date_col).where(F.col(date_col).isNotNull()).distinct()
    dates = [r[0] for r in known.where(F.col(date_col) != UNKNOWN_DATE).orderBy(date_col).limit(MAX_PIVOT_DATES).collect()]
    return dates + [UNKNOWN_DATE] * (not known.where(F.col(date_col) == UNKNOWN_DATE).isEmpty())


def daily_label_pivot(counts: DataFrame, dates: list[str] | None = None, other: str | None = None) -> DataFrame:
    """A8/L4 from :func:`trapline.operators.labels.daily_label_counts` output.

    Rows: image totals, the no-detection label, labels by (-total, label),
    then totals again; ``row_order`` numbers them.  One column per date,
    zero-filled.  The input is already aggregated (dates x labels), so the
    pivot runs on a small frame.

    ``dates`` are taken from the data unless given.  Every other date is counted
    in a last column ``other`` (there if it is named, or if a date falls into it),
    so label totals, row sums and the grand total always agree.
    """
    counts = materialize(counts)  # small (dates x labels), read several times below
    dates = pivot_dates(counts) if dates is None else list(dates)
    cells = counts.filter(F.col("grouping_id") == 0)
    if dates:
        cells = cells.withColumn("image_date", F.when(F.col("image_date").isin(dates), F.col("image_date")))
    else:
        cells = cells.withColumn("image_date", F.lit(None).cast("string"))
    if other is None and not cells.filter(F.col("image_date").isNull()).isEmpty():
        other = PIVOT_OTHER_DATES
    columns = dates + [other] * (other is not None)
    if other is not None:
        cells = cells.withColumn("image_date", F.coalesce("image_date", F.lit(other)))
    wide = cells.groupBy("label").pivot("image_date", columns).agg(F.sum("n_images"))
    total = lambda c: sum((F.coalesce(F.col(f"`{d}`"), F.lit(0)) for d in c), F.lit(0)).cast("long")
    block = F.when(F.col("label") == PIVOT_NO_DETECTION_LABEL, F.lit(1)).otherwise(F.lit(2))
    labels = wide.select("label", block.alias("block"), total(columns).alias("total"),
                         *[F.coalesce(F.col(f"`{d}`"), F.lit(0)).cast("long").alias(d) for d in columns])
    sums = [F.coalesce(F.sum(F.col(f"`{d}`")), F.lit(0)).cast("long").alias(d) for d in columns]
    # one pass over the label rows gives both total rows
    totals = labels.agg(F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total"), *sums)
    ends = totals.select(F.explode(F.array(F.struct(F.lit(PIVOT_TOTAL_IMAGES_LABEL).alias("label"), F.lit(0).alias("block")),
                                           F.struct(F.lit(PIVOT_TOTAL_LABEL).alias("label"), F.lit(3).alias("block")))).alias("r"),
                         "total", *[F.col(f"`{d}`") for d in columns]).select("r.label", "r.block", "total", *[F.col(f"`{d}`") for d in columns])
    rows = labels.unionByName(ends)
    return with_rank(rows, [F.col("block"), F.desc("total"), F.col("label")], "row_order").select(
        "row_order", "block", "label", "total", *[F.col(f"`{d}`") for d in columns])


# ---------------------------------------------------------------------------
# A12 / L5
# ---------------------------------------------------------------------------

def result_metadata(table: DataFrame, page_size: int = RESULTS_PER_PAGE, approx_rsd: float | None = None) -> DataFrame:
    """Total rows, distinct non-empty species, page count ``max(1, ceil(n/size))``.

    ``approx_rsd`` switches the distinct count to a HyperLogLog++ sketch with
    that relative standard deviation (one partial aggregate, no shuffle of
    the species values); exact by default.
    """
    sp = empty_if_null(F.col("species"))
    nonempty = F.when(sp != "", sp)
    distinct = (F.countDistinct(nonempty) if approx_rsd is None
                else F.approx_count_distinct(nonempty, approx_rsd))
    return (table.agg(F.count(F.lit(1)).alias("total_rows"), distinct.cast("long").alias("distinct_species"))
            .withColumn("page_count", F.greatest(F.lit(1), F.ceil(F.col("total_rows") / page_size)).cast("long")))


# pages up to this depth use a top-n (which gathers that many rows); deeper ones a distributed
# ordinal.  Both follow the same order, ties included, so the rows are the same on either side.
TOPK_PAGE_DEPTH = 100_000


def result_page(table: DataFrame, page: int, order_col: str = "seen_order",
                page_size: int = RESULTS_PER_PAGE) -> DataFrame:
    """Rows ``page*size+1 .. (page+1)*size`` in table order; empty species shown as a marker.

    Rows of equal order are told apart by path, name and species.
    """
    start = page * page_size
    ties = [c for c in ("image_path", "image_name", "species") if c in table.columns and c != order_col]
    if start + page_size <= TOPK_PAGE_DEPTH:
        rows = table.orderBy(order_col, *ties).offset(start).limit(page_size)
        w = Window.orderBy(order_col, *ties)  # over at most page_size rows
        rows = rows.withColumn("row_no", (F.row_number().over(w) + F.lit(start)).cast("long"))
    else:
        ranked = with_ordinal(table, [], order_col, "row_no", ties=tuple(ties))
        rows = ranked.filter((F.col("row_no") > start) & (F.col("row_no") <= start + page_size))
    sp = empty_if_null(F.col("species"))
    return rows.withColumn("species_display", F.when(sp != "", sp).otherwise(F.lit(RESULT_PAGE_EMPTY_SPECIES)))
