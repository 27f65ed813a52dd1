"""Excel-readable CSV (K2) and the report files built on it (K3-K6).

Files are UTF-8 with a byte-order mark: the first header cell carries
``\\ufeff``, which makes ``EF BB BF`` the first bytes.  A report is written by a
range sort as parts whose concatenation, in the order of their names, is the file
(:func:`join_report` makes it); only the first part has the header.  Exports of
tables keep their partitions, a header in each (``write_excel_csv``).
"""
from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.constants import (
    DETAIL_HEADER,
    PIVOT_HEADER_LABEL,
    SPECIES_LIST_HEADER,
    SUMMARY_BASIC_HEADER,
    SUMMARY_BASIC_SECTION,
    SUMMARY_CATEGORY_HEADER,
    SUMMARY_CATEGORY_SECTION,
    SUMMARY_CONFIDENCE_HEADER,
    SUMMARY_CONFIDENCE_SECTION,
    SUMMARY_RATE,
    SUMMARY_SECONDS,
    SUMMARY_SPECIES_HEADER,
    SUMMARY_SPECIES_SECTION,
    SUMMARY_SUCCESS_RATE,
    SUMMARY_TITLE,
)
from trapline.sinks.manifest_document import join_pieces


# quotes inside a cell are doubled, as spreadsheets and read_detections_csv expect
CSV_OPTIONS = {"emptyValue": "", "nullValue": "", "escape": '"'}


def write_excel_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """K2: CSV with a BOM in front of the header (all values written as text), a header in every part."""
    cols = df.columns
    out = df.select(*[F.col(f"`{c}`").cast("string").alias(("\ufeff" + c) if i == 0 else c)
                      for i, c in enumerate(cols)])
    out.write.mode("overwrite").option("header", header).options(**CSV_OPTIONS).csv(path)


def write_report_csv(df: DataFrame, path: str, order: list[str], captions: list[str] | None = None) -> None:
    """K2 for reports: rows in ``order`` (columns that are not written), as parts of one file with one header.

    ``captions`` name the other columns in the header (default: their own names).
    No task holds the whole report: the header is a row of the range sort, the first.
    """
    cols = [c for c in df.columns if c not in order]
    line = lambda values: F.to_csv(F.struct(*[v.cast("string").alias(f"c{i}") for i, v in enumerate(values)]), CSV_OPTIONS)
    captions = captions or cols
    head = df.sparkSession.range(1).select(line([F.lit(c) for c in captions]).alias("value"))
    keys = [f"_k{i}" for i in range(len(order))]
    rows = df.select(F.lit(1).alias("_body"), *[F.col(f"`{c}`").alias(k) for c, k in zip(order, keys)],
                     line([F.col(f"`{c}`") for c in cols]).alias("value"))
    first = head.select(F.lit(0).alias("_body"), *[F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys],
                        F.concat(F.lit("\ufeff"), F.col("value")).alias("value"))
    _write_lines(first.unionByName(rows).orderBy("_body", *keys).select("value"), path)


def _write_lines(lines: DataFrame, path: str, end: str = "\n") -> None:
    """The ordered lines as text parts, without a gather into one task."""
    lines.write.mode("overwrite").option("lineSep", end).text(path)


def join_report(path: str, out: str) -> None:
    """One file of a report's parts, copied one after the other, a block at a time."""
    join_pieces(path, out)


def fmt(c, digits: int) -> F.Column:
    """Fixed-point text with ``digits`` decimals, exactly as Python's ``f"{x:.Nf}"``.

    ``format_number`` rounds the exact binary value half to even, as Python does;
    its thousands separators are taken out.  Below one unit of the last digit it
    does not look at the exact value, so those numbers are compared with the half.
    """
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    unit, half = Decimal(10) ** -digits, Decimal(5) * Decimal(10) ** -(digits + 1)
    edge = float(half)  # the nearest double, on one side of the half
    up = F.abs(c) >= edge if Decimal(edge) > half else F.abs(c) > edge
    small = F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), F.when(up, F.lit(f"{unit:f}")).otherwise(F.lit(f"{0:.{digits}f}")))
    return (F.when(F.isnan(c), F.lit("nan")).when(F.abs(c) < float(unit), small)
            .otherwise(F.replace(F.format_number(c, digits), F.lit(","))))


def write_detail_export(wide: DataFrame, path: str) -> None:
    """K4: the per-image wide export (first three detections), captioned columns."""
    fields = ("species", "common_name", "japanese_name", "scientific_name", "confidence", "category_label")
    cols = [F.col("image_name"), F.col("image_path"),
            F.date_format(F.coalesce(F.col("timestamp"), F.current_timestamp()), "yyyy-MM-dd HH:mm:ss")
            if "timestamp" in wide.columns else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"),
            F.col("detection_count")]
    for i in (1, 2, 3):
        for f in fields:
            c = F.col(f"{f}_{i}")
            cols.append(fmt(c, 4) if f == "confidence" else c)
    cols.append(F.col("remark"))
    write_excel_csv(wide.select(*[c.alias(h) for c, h in zip(cols, DETAIL_HEADER)]), path)


def write_species_list(species: DataFrame, path: str) -> None:
    """K5: species list in rank order, confidences with four decimals."""
    out = species.select(
        "rank", "species", "common_name", "japanese_name", "scientific_name", "category_label", "detection_count",
        fmt("max_confidence", 4).alias("max_confidence"), fmt("avg_confidence", 4).alias("avg_confidence"))
    write_report_csv(out, path, ["rank"], list(SPECIES_LIST_HEADER))


_SECTIONS = (SUMMARY_BASIC_SECTION, SUMMARY_SPECIES_SECTION, SUMMARY_CATEGORY_SECTION, SUMMARY_CONFIDENCE_SECTION)
_HEADERS = {SUMMARY_BASIC_SECTION: SUMMARY_BASIC_HEADER, SUMMARY_SPECIES_SECTION: SUMMARY_SPECIES_HEADER,
            SUMMARY_CATEGORY_SECTION: SUMMARY_CATEGORY_HEADER, SUMMARY_CONFIDENCE_SECTION: SUMMARY_CONFIDENCE_HEADER}


def summary_lines(report: DataFrame, source: str = "", generated: str | None = None, seconds: float = 0.0,
                  images: int | None = None) -> DataFrame:
    """K3 as the rows of its file: ``(part, ord, a, b, c)`` with title, source, section headers and blank rows.

    A section without rows is left out, but for the basic and the confidence section.
    """
    spark = report.sparkSession
    part = F.array_position(F.array(*[F.lit(x) for x in _SECTIONS]), F.col("section")).cast("int")
    pct = fmt("pct", 1)
    rate = SUMMARY_SUCCESS_RATE
    basic = F.col("section") == SUMMARY_BASIC_SECTION
    value = F.when(basic & (F.col("item") == rate), F.coalesce(pct, F.lit("0"))).otherwise(F.col("n").cast("string"))
    third = F.when(~basic & F.col("pct").isNotNull(), pct)
    body = report.select(part.alias("part"), F.col("ord").cast("int").alias("ord"), F.col("item").alias("a"), value.alias("b"), third.alias("c"))
    filled = {r["part"] for r in body.select("part").distinct().collect()} | {1, 4}
    generated = generated or datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    lines = [(0, 0, SUMMARY_TITLE, None, None), (0, 1, "Generated:", generated, None), (0, 2, "Source CSV:", source, None)]
    for i, name in enumerate(_SECTIONS, 1):
        if i in filled:
            lines += [(i, -3, None, None, None), (i, -2, name, None, None), (i, -1, *(list(_HEADERS[name]) + [None])[:3])]
    per_second = images / seconds if images and seconds > 0 else 0.0
    lines += [(1, 1 << 30, SUMMARY_SECONDS, f"{seconds:.1f}", None), (1, (1 << 30) + 1, SUMMARY_RATE, f"{per_second:.2f}", None)]
    return body.unionByName(spark.createDataFrame(lines, "part int, ord int, a string, b string, c string"))


def write_summary_report(report: DataFrame, path: str, source: str = "", generated: str | None = None,
                         seconds: float = 0.0, images: int | None = None) -> None:
    """K3: the summary as one text of lines, sections in their order, percentages at one decimal."""
    rows = summary_lines(report, source, generated, seconds, images).orderBy("part", "ord")
    quoted = lambda c: F.when(F.col(c).rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    line = F.concat_ws(",", *[quoted(c) for c in ("a", "b", "c")])  # skips what a row hasn't
    first = (F.col("part") == 0) & (F.col("ord") == 0)
    _write_lines(rows.select(F.when(first, F.concat(F.lit("\ufeff"), line)).otherwise(line).alias("value")), path, "\r\n")


def write_pivot_long(counts: DataFrame, path: str) -> None:
    """K6 in long form: (date, label, images), one row a cell, partitions kept: no limit to dates or labels."""
    cells = counts.filter(F.col("grouping_id") == 0).select("image_date", "label", "n_images")
    write_excel_csv(cells.orderBy("image_date", "label"), path)


def write_pivot(pivot: DataFrame, path: str) -> None:
    """K6: ``日付`` header of dates, then the pivot rows in ``row_order``."""
    dates = [c for c in pivot.columns if c not in ("row_order", "block", "label", "total")]
    out = pivot.select("row_order", "label", *[F.col(f"`{d}`") for d in dates])
    write_report_csv(out, path, ["row_order"], [PIVOT_HEADER_LABEL, *dates])


def export_table_csv(spark, table_path: str, out_path: str) -> None:
    """K9: the detections table as an Excel-readable CSV copy (ten columns, table order).

    The table keeps its partitioning (one CSV part per partition): it can be
    large, and a single-file write would funnel it through one task.
    """
    from trapline.constants import DETECTION_COLUMNS
    from trapline.sinks.tables import read_table

    t = read_table(spark, table_path)
    cols = [F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) if c == "timestamp" else F.col(c)
            for c in DETECTION_COLUMNS]
    order = [c for c in ("seen_order", "image_path") if c in t.columns][:1]
    write_excel_csv(t.orderBy(*order).select(*cols), out_path)
