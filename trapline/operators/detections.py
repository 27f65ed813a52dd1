"""Prediction shaping and best-detection selection.

Two grains:

* detection grain - one row per kept prediction (``image_path``, ``det_index``);
* image grain     - one row per image, the detections table (D5).

Ties always go to the earliest ``det_index`` (model order), like a stable
``max`` over a list.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.constants import DEFAULT_CONFIDENCE_THRESHOLD, NO_DETECTION_LABELS
from trapline.functions.numbers import nan_low
from trapline.functions.taxonomy import KIND_BUILD, display_species, with_taxonomy
from trapline.functions.text import col_
from trapline.operators.names import with_vernacular

DETECTION_FIELDS = ("species", "scientific_name", "confidence", "category", "common_name",
                    "japanese_name")


def score_as_double(df: DataFrame, score_col: str) -> tuple[DataFrame, Column]:
    """Numeric score; text that is present but not numeric marks a malformed row."""
    dtype = df.schema[score_col].dataType
    raw = F.col(score_col)
    if isinstance(dtype, T.StringType):
        parsed = raw.try_cast("double")
        malformed = raw.isNotNull() & parsed.isNull()
    else:
        parsed = raw.cast("double")
        malformed = F.lit(False)
    return df, F.when(~malformed, F.coalesce(parsed, F.lit(0.0)))


def parse_predictions(df: DataFrame, names: DataFrame,
                      threshold: float = DEFAULT_CONFIDENCE_THRESHOLD,
                      score_col: str = "prediction_score",
                      prediction_col: str = "prediction",
                      class_col: str | None = None, class_name_col: str | None = None,
                      genus_col: str | None = None, species_col: str | None = None,
                      common_col: str | None = None,
                      labels=NO_DETECTION_LABELS, keep_col: str | None = None) -> DataFrame:
    """Threshold, parse, vernacular lookup, display name.

    Keeps every input column and adds the detection fields.  Malformed scores
    are dropped; a missing score counts as 0.  With ``keep_col`` nothing is
    dropped: the column says whether a row passes (for single-pass callers
    that also need the other rows).
    """
    df, score = score_as_double(df, score_col)
    passes = F.col("confidence").isNotNull() & (F.col("confidence") >= F.lit(threshold))
    if keep_col:
        kept = df.withColumn("confidence", score).withColumn(keep_col, F.coalesce(passes, F.lit(False)))
    else:
        kept = df.withColumn("confidence", score).filter(passes)

    shaped = with_taxonomy(kept, prediction_col, class_col, class_name_col, genus_col, species_col, common_col,
                           labels, prefix="_tx_")
    shaped = with_vernacular(shaped, F.col("_tx_scientific_name"), names, out_col="japanese_name",
                             when=F.col("_tx_kind") == KIND_BUILD)
    return (shaped
            .withColumns({"species": display_species(F.col("_tx_kind"), F.col("_tx_scientific_name"),
                                                     F.col("_tx_common_name"), F.col("japanese_name"),
                                                     F.col("_tx_raw")),
                          "scientific_name": F.col("_tx_scientific_name"),
                          "category": F.col("_tx_category"),
                          "common_name": F.col("_tx_common_name")})
            .drop("_tx_kind", "_tx_scientific_name", "_tx_category", "_tx_common_name", "_tx_raw"))


def best_per_image(detections: DataFrame, key: str = "image_path", order_col: str = "det_index",
                   value_col: str = "confidence", fields=DETECTION_FIELDS,
                   count_col: str | None = None, extra_aggs: tuple = (),
                   keep_col: str | None = None) -> DataFrame:
    """P11 relational form: the highest ``value_col`` per ``key``, earliest ``order_col`` on ties.

    ``max_by`` over ``struct(value, -order)`` is a partial (map-side) aggregate:
    no window, one shuffle on ``key``.  NaN ranks lowest.  ``count_col`` adds
    the number of rows per key from the same aggregate; ``extra_aggs`` are
    further aggregate columns computed in the same pass.  With ``keep_col``
    only rows where it is true compete and are counted (``max_by`` skips
    null orderings); a key without such rows gets null fields.
    """
    rank = F.struct(nan_low(F.coalesce(F.col(value_col), F.lit(0.0))).alias("v"),
                    (-F.col(order_col)).alias("o"))
    if keep_col:
        rank = F.when(F.col(keep_col), rank)
    payload = F.struct(*[F.col(c) for c in (order_col, *fields)])
    aggs = [F.max_by(payload, rank).alias("_best")]
    if count_col:
        aggs.append((F.count_if(F.col(keep_col)) if keep_col else F.count(F.lit(1))).cast("long").alias(count_col))
    aggs.extend(extra_aggs)
    best = detections.groupBy(key).agg(*aggs)
    extra = [c for c in best.columns if c not in (key, "_best")]
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in (order_col, *fields)], *extra)


def detections_table(images: DataFrame, best: DataFrame, key: str = "image_path",
                     fields=DETECTION_FIELDS) -> DataFrame:
    """One row per image; images without a detection get ``'' … 0 … ''``."""
    joined = images.join(best, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0) if c == "confidence" else F.lit(""))
                               for c in fields})


def image_name(path) -> Column:
    """Basename of a ``/`` or ``\\`` separated path."""
    return F.element_at(F.split(col_(path), r"[/\\]"), -1)


# ---------------------------------------------------------------------------
# array form (one row per image, detections in model order)
# ---------------------------------------------------------------------------

def detections_array(detections: DataFrame, key: str = "image_path", order_col: str = "det_index",
                     fields=DETECTION_FIELDS) -> DataFrame:
    """Per image: the detections as an array of structs in model order.

    The array of one image is bounded by what the model returns for one image.
    """
    item = F.struct(F.col(order_col).alias("_o"), *[F.col(c) for c in fields])
    return (detections.groupBy(key)
            .agg(F.array_sort(F.collect_list(item)).alias("detections")))


def best_in_array(arr, value_field: str = "confidence") -> Column:
    """P10/P11 array form: element with the strict maximum value, first on ties; null if empty."""
    arr = col_(arr)
    first = F.get(arr, 0)

    def pick(acc, x):
        better = nan_low(F.coalesce(x[value_field], F.lit(0.0))) > nan_low(
            F.coalesce(acc[value_field], F.lit(0.0)))
        return F.when(better, x).otherwise(acc)

    return F.when(F.size(arr) > 0, F.aggregate(arr, first, pick))


def has_detections(arr) -> Column:
    """P12."""
    return F.coalesce(F.size(col_(arr)), F.lit(0)) > 0


def distinct_species_count(arr) -> Column:
    """Distinct ``species`` values among the detections of one image."""
    return F.size(F.array_distinct(F.transform(col_(arr), lambda x: x["species"])))


def top_n_wide(df: DataFrame, arr: str = "detections", n: int = 3,
               fields=("species", "common_name", "japanese_name", "scientific_name", "confidence",
                       "category")) -> DataFrame:
    """First ``n`` detections in model order, side by side, plus count and overflow."""
    cols = [F.size(F.col(arr)).alias("detection_count")]
    for i in range(n):
        for f in fields:
            cols.append(F.get(F.col(arr), i)[f].alias(f"{f}_{i + 1}"))
    cols.append(F.greatest(F.size(F.col(arr)) - F.lit(n), F.lit(0)).alias("more_count"))
    keep = [c for c in df.columns if c != arr]
    return df.select(*keep, *cols)


def detail_remark(count) -> Column:
    """P14 remark: none detected / ``n`` more than shown / empty."""
    from trapline.constants import DETAIL_REMARK_MORE, DETAIL_REMARK_NONE

    n = F.coalesce(col_(count), F.lit(0))
    head, tail = DETAIL_REMARK_MORE.split("{n}")
    return (F.when(n == 0, F.lit(DETAIL_REMARK_NONE))
            .when(n > 3, F.concat(F.lit(head), (n - 3).cast("string"), F.lit(tail)))
            .otherwise(F.lit("")))


# ---------------------------------------------------------------------------
# relational forms (no per-image arrays: a hot image never becomes one row)
# ---------------------------------------------------------------------------

def image_detection_counts(detections: DataFrame, key: str = "image_path") -> DataFrame:
    """Detections and distinct species per image (partial aggregates)."""
    return detections.groupBy(key).agg(F.count(F.lit(1)).alias("n_detections"),
                                       F.countDistinct("species").alias("n_species"))


def first_n_wide(detections: DataFrame, n: int = 3, key: str = "image_path", order_col: str = "det_index",
                 fields=("species", "common_name", "japanese_name", "scientific_name", "confidence",
                         "category")) -> DataFrame:
    """The first ``n`` detections of each image in model order, side by side.

    An image holds what the model returns for it, so its rows are numbered by a
    plain window: one exchange by image, one sort, and the aggregate needs no
    other exchange.
    """
    ranked = detections.select(key, order_col, *fields).withColumn(
        "_pos", F.row_number().over(Window.partitionBy(key).orderBy(order_col)).cast("long"))
    cols = [F.max(F.when(F.col("_pos") == i + 1, F.col(f))).alias(f"{f}_{i + 1}")
            for i in range(n) for f in fields]
    # the last position is the count, the first n fill the slots
    return ranked.groupBy(key).agg(F.max("_pos").alias("detection_count"), *cols)


def best_detections(images: DataFrame, detections: DataFrame, key: str = "image_path",
                    fields=DETECTION_FIELDS) -> DataFrame:
    """J1 + P11 + P13: the detections table rows for ``images`` from detection-grain rows."""
    best = best_per_image(detections, key=key, fields=fields).drop("det_index")
    return detections_table(images, best, key=key, fields=fields)
