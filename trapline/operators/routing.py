"""Routing plan: where each image goes.

The plan is a pure DataFrame (inspectable, testable); copying the files is a
separate job (:mod:`trapline.sinks.files`).
"""
from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.constants import DUPLICATE_SUFFIX_MAX, NO_DETECTION_FOLDER, NO_DETECTION_LABELS
from trapline.functions.paths import (
    file_stem,
    file_suffix,
    numbered_name,
    routed_folder,
    safe_folder_name,
    target_parent,
)
from trapline.functions.text import is_no_detection
from trapline.operators.labels import no_detection_row, with_report_date
from trapline.operators.names import with_resolved_vernacular
from trapline.operators.ordinal import DEFAULT_BUCKET_ROWS, with_marks_passed, with_ordinal
from trapline.session import materialize


def existing_sources(table: DataFrame, listing: DataFrame, key: str = "image_path",
                     listing_key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(rows whose source file is listed, rows whose source is missing).

    Semi and anti joins ignore duplicate listing keys, so no ``distinct`` (and
    its shuffle) is needed.
    """
    lk = listing.select(F.col(listing_key).alias(key))
    return table.join(lk, key, "left_semi"), table.join(lk, key, "left_anti")


def routing_plan(table: DataFrame, names: DataFrame, base: str, by_date: bool = False,
                 listing: DataFrame | None = None, capture_dates: DataFrame | None = None,
                 labels=NO_DETECTION_LABELS, rule: str = "table") -> DataFrame:
    """P19-P24 over the detections table.

    Adds ``folder_name`` (P21 or the no-detection folder), ``target_dir``
    (P22/P23) and ``folder_key`` (P24, relative to ``base``).  With
    ``listing``, rows whose source file is not listed are left out (J5).

    ``rule="table"`` (default) routes a row from a stored table: an empty
    species is no detection, a blank vernacular name is resolved late (J7),
    the stored date wins.  ``rule="results"`` routes fresh results (image
    grain with ``n_detections``): no detection when there is none or both
    species and common name are no-detection labels (Q24), the vernacular name
    is used as given, and the date always comes from ``capture_dates``.
    """
    if listing is not None:
        table, _missing = existing_sources(table, listing)
    if rule == "results":
        t = table.withColumn("_vern", F.coalesce(F.col("japanese_name"), F.lit("")))
        nodet = ((F.coalesce(F.col("n_detections"), F.lit(0)) == 0)
                 | (is_no_detection(F.col("species"), labels) & is_no_detection(F.col("common_name"), labels)))
        if by_date:
            t = t.withColumn("image_date", F.lit(""))  # the file decides
    else:
        t = with_resolved_vernacular(table, names, out_col="_vern")
        nodet = no_detection_row(F.col("species"), F.col("common_name"), labels)
    folder = (F.when(nodet, F.lit(NO_DETECTION_FOLDER))
              .otherwise(safe_folder_name(F.col("species"), F.col("common_name"), F.col("_vern"))))
    t = t.withColumn("folder_name", folder).drop("_vern")
    if by_date:
        t = with_report_date(t, capture_dates, out_col="_route_date")
        parent = target_parent(base, F.col("_route_date"))
        rel_parent = F.concat(F.col("_route_date"), F.lit("/"))
    else:
        parent = target_parent(base)
        rel_parent = F.lit("")
    seg = routed_folder(parent, F.col("folder_name"))
    t = t.withColumn("_seg", seg).withColumns({"target_dir": F.concat(parent, F.lit("/"), F.col("_seg")),
                                               "folder_key": F.concat(rel_parent, F.col("_seg"))})
    return t.drop("_seg", "_route_date")


def dedup_destinations(plan: DataFrame, existing: DataFrame | None = None,
                       order_col: str = "seen_order", name_col: str = "image_name",
                       run_stamp: str | None = None, bucket_rows: int = DEFAULT_BUCKET_ROWS,
                       materialize_input: bool = True) -> DataFrame:
    """A unique destination name per target folder, clear of existing files.

    Set form of sequential collision numbering: the first row of each
    ``(target_dir, name)`` group keeps its name unless a file of that name
    exists; every other row takes, in ``order_col`` order, the next number
    whose ``stem_NNN.ext`` is neither an existing file nor a kept name.
    Numbers above 9999 become ``stem_{run_stamp}_{n}.ext``; the stamp is the
    run's time unless given, and a final name that exists all the same gets a
    second stamp.

    ``existing`` is ``(target_dir, file_name)``.  No step joins all rows on
    the group key (a hot name would meet in one task): positions come from
    :func:`with_ordinal`, the "name already taken" check joins first rows
    only, and what holds for a group reaches its rows by ``(group, slice)``,
    slices of ``bucket_rows`` of the order.  In a group without claimed
    numbers (nearly all) a row's number follows from its position; in groups
    with claims, from its position and the claims before it, counted slice by
    slice (:func:`with_marks_passed`); no numbers are generated or matched.
    """
    spark = plan.sparkSession
    run_stamp = run_stamp or datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S%f")
    if existing is None:
        existing = spark.createDataFrame([], "target_dir string, file_name string")
    existing = existing.select("target_dir", "file_name").distinct()
    g = ["target_dir", name_col]
    p = with_ordinal(plan, g, order_col, "_k", bucket_rows)
    p = p.withColumns({"_stem": file_stem(F.col(name_col)), "_ext": file_suffix(F.col(name_col)),
                       "_slice": F.floor(F.col(order_col) / F.lit(bucket_rows)).cast("long")})
    if materialize_input:
        p = materialize(p)  # positioned rows: read by first rows, group sizes and requests
    taken = existing.select("target_dir", F.col("file_name").alias(name_col), F.lit(True).alias("_exists"))
    firsts = (p.filter(F.col("_k") == 1).join(taken, g, "left")
              .withColumn("_kept", F.col("_exists").isNull()).drop("_exists"))
    kept = firsts.filter("_kept")

    # claimed numbered names: existing files and kept names of the form stem_NNN.ext
    claimed = existing.unionByName(kept.select("target_dir", F.col(name_col).alias("file_name")))
    c_stem, c_ext = file_stem(F.col("file_name")), file_suffix(F.col("file_name"))
    claims = (claimed
              .withColumn("_digits", F.regexp_extract(c_stem, r"^(.*)_([0-9]+)$", 2))
              .filter(F.col("_digits") != "")
              .withColumn("_n", F.col("_digits").try_cast("long"))
              .filter(F.col("_n").isNotNull()
                      & (F.format_string("%03d", F.col("_n")) == F.col("_digits")))
              .select("target_dir",
                      F.concat(F.regexp_extract(c_stem, r"^(.*)_([0-9]+)$", 1), c_ext).alias(name_col),
                      "_n").distinct())

    requests = (p.filter(F.col("_k") > 1).withColumn("_shift", F.lit(None).cast("int"))
                .unionByName(firsts.filter(~F.col("_kept")).drop("_kept").withColumn("_shift", F.lit(0))))
    # whether a group's first row keeps its name: few groups lose it (their name exists already)
    lost = firsts.filter(~F.col("_kept")).select(*g, F.lit(0).alias("_lost"))
    claimed_groups = claims.select(*g).distinct().withColumn("_claimed", F.lit(True))
    # both facts of a group go to its slices first (a row a slice), and from a slice to its rows
    marked = p.groupBy(*g, "_slice").agg(F.lit(0).alias("_z")).drop("_z").join(lost.join(claimed_groups, g, "full"), g)
    requests = (requests.join(marked, [*g, "_slice"], "left").withColumn("_shift", F.coalesce("_shift", "_lost", F.lit(1)))
                .drop("_lost", "_slice"))
    if materialize_input:
        requests = materialize(requests)
    plain = requests.filter(F.col("_claimed").isNull()).withColumn("_n", F.col("_k").cast("long") - F.col("_shift"))
    hard = requests.filter(F.col("_claimed"))

    # groups with claims: before the i-th claimed number c lie c - i free ones, so the claim moves up the requests from
    # the (c - i + 1)-th on; a request's number is its position among the requests plus the claims that move it
    moves = (with_ordinal(claims.filter(F.col("_n") > 0), g, "_n", "_i", bucket_rows)
             .select(*g, (F.col("_n") - F.col("_i") + 1).alias("_r")))
    moved = with_marks_passed(hard.withColumn("_r", F.col("_k").cast("long") - F.col("_shift")), moves, g, "_r", "_passed", bucket_rows)
    numbered = plain.unionByName(moved.withColumn("_n", F.col("_r") + F.col("_passed")).select(*plain.columns))

    over = F.concat(F.col("_stem"), F.lit(f"_{run_stamp}_"), F.col("_n").cast("string"), F.col("_ext"))
    again = F.concat(F.col("_stem"), F.lit(f"_{run_stamp}_{run_stamp}_"), F.col("_n").cast("string"), F.col("_ext"))
    few = numbered.filter(F.col("_n") <= DUPLICATE_SUFFIX_MAX).withColumn(
        "dest_name", numbered_name(F.col("_stem"), F.col("_n"), F.col("_ext")))
    taken_over = claimed.select("target_dir", F.col("file_name").alias("_over"), F.lit(True).alias("_taken"))
    many = (numbered.filter(F.col("_n") > DUPLICATE_SUFFIX_MAX).withColumn("_over", over)
            .join(taken_over, ["target_dir", "_over"], "left")
            .withColumn("dest_name", F.when(F.col("_taken"), again).otherwise(F.col("_over"))).drop("_over", "_taken"))
    out = (kept.drop("_kept", "_slice").withColumn("dest_name", F.col(name_col))
           .unionByName(few.unionByName(many.select(*few.columns)).drop("_n", "_shift", "_claimed")))
    return (out.withColumn("dest_path", F.concat(F.col("target_dir"), F.lit("/"), F.col("dest_name")))
            .drop("_k", "_stem", "_ext"))


def folder_counts(routed: DataFrame, order_col: str = "seen_order") -> DataFrame:
    """A10: files per folder key (count, first/last destination name, first-seen order)."""
    return routed.groupBy("folder_key").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.min("dest_name").alias("first_file"),
        F.max("dest_name").alias("last_file"),
        F.min(order_col).alias("first_seen"))


def routing_stats(counts: DataFrame) -> DataFrame:
    """Folders, files, mean files per folder, largest folder (first-seen wins ties)."""
    return counts.agg(
        F.count(F.lit(1)).alias("total_folders"),
        F.coalesce(F.sum("file_count"), F.lit(0)).cast("long").alias("total_files"),
        F.coalesce(F.avg("file_count"), F.lit(0.0)).alias("average_files_per_folder"),
        F.max_by("folder_key", F.struct(F.col("file_count"), -F.col("first_seen"))).alias("largest_folder"),
        F.max("file_count").alias("largest_folder_files"))
