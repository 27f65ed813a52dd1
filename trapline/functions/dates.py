"""Capture dates from EXIF text and file times."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trapline.functions.text import col_


def exif_date(raw) -> Column:
    """``YYYY:MM:DD HH:MM:SS`` -> ``YYYY-MM-DD``; null unless the result has the shape
    ``....-..-..`` (ten characters, dashes at 5 and 8).  Empty input -> null."""
    r = col_(raw)
    d = F.translate(F.split_part(r, F.lit(" "), F.lit(1)), ":", "-")
    ok = (F.length(d) == 10) & (F.substring(d, 5, 1) == "-") & (F.substring(d, 8, 1) == "-")
    return F.when((F.coalesce(r, F.lit("")) != "") & ok, d)


def file_time_date(ts) -> Column:
    """Local date of a file time (session time zone)."""
    return F.date_format(col_(ts), "yyyy-MM-dd")


def capture_date(original, digitized, datetime_, mtime) -> Column:
    """DateTimeOriginal, DateTimeDigitized, DateTime, then the file time."""
    return F.coalesce(exif_date(original), exif_date(digitized), exif_date(datetime_), file_time_date(mtime))
