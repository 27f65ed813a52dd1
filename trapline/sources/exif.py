"""EXIF date tags from image files (U2) and capture dates.

The tag reader walks the file's structure by position: JPEG segments, PNG chunks,
WebP chunks or the TIFF directory, wherever it lies.  It asks for the few bytes it
needs, so only those are read from a file, and a directory at the end of a large
file is found like one at its start.  The reader is a small per-file helper in
``mapInPandas``: Spark partitions the files.  Anything unexpected inside a file
yields nulls, and the date falls back to the file time; a storage scheme that can't
be opened is an error.
"""
from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.constants import (
    EXIF_IFD_POINTER,
    EXIF_TAG_DATETIME,
    EXIF_TAG_DATETIME_DIGITIZED,
    EXIF_TAG_DATETIME_ORIGINAL,
)
from trapline.functions.dates import capture_date

Read = Callable[[int, int], bytes]  # (position, length) -> up to so many bytes
Dates = tuple[str | None, str | None, str | None]
NONE: Dates = (None, None, None)


def _directory(read: Read, base: int, offset: int, endian: str) -> dict[int, tuple[int, int, bytes]]:
    """Entries of one TIFF directory: tag -> (type, count, 4-byte value field)."""
    head = read(base + offset, 2)
    if offset < 8 or len(head) < 2:
        return {}
    (n,) = struct.unpack(endian + "H", head)
    body, out = read(base + offset + 2, 12 * n), {}
    for i in range(len(body) // 12):
        tag, typ, count = struct.unpack_from(endian + "HHI", body, 12 * i)
        out[tag] = (typ, count, body[12 * i + 8:12 * i + 12])
    return out


def _text(read: Read, base: int, entry: tuple[int, int, bytes], endian: str) -> str | None:
    typ, count, field = entry
    if typ != 2 or not 0 < count <= 1024:  # a date is 20 bytes
        return None
    raw = field[:count] if count <= 4 else read(base + struct.unpack(endian + "I", field)[0], count)
    return raw.split(b"\x00", 1)[0].decode("ascii", "replace") if len(raw) == count else None


def _tiff(read: Read, base: int) -> Dates:
    head = read(base, 8)
    if len(head) < 8 or head[:2] not in (b"II", b"MM"):
        return NONE
    endian = "<" if head[:2] == b"II" else ">"
    magic, first = struct.unpack(endian + "HI", head[2:])
    if magic != 42:
        return NONE
    main = _directory(read, base, first, endian)
    sub = {}
    if EXIF_IFD_POINTER in main and main[EXIF_IFD_POINTER][0] in (4, 13):
        sub = _directory(read, base, struct.unpack(endian + "I", main[EXIF_IFD_POINTER][2])[0], endian)
    get = lambda entries, tag: _text(read, base, entries[tag], endian) if tag in entries else None
    return get(sub, EXIF_TAG_DATETIME_ORIGINAL), get(sub, EXIF_TAG_DATETIME_DIGITIZED), get(main, EXIF_TAG_DATETIME)


def _jpeg(read: Read) -> Dates:
    at = 2
    while len(head := read(at, 4)) == 4 and head[0] == 0xFF and head[1] not in (0xD9, 0xDA):
        if head[1] == 0xE1 and read(at + 4, 6) == b"Exif\x00\x00":
            return _tiff(read, at + 10)
        at += 2 + struct.unpack(">H", head[2:])[0]
    return NONE


def _png(read: Read) -> Dates:
    at = 8
    while len(head := read(at, 8)) == 8 and head[4:] != b"IEND":
        if head[4:] == b"eXIf":
            return _tiff(read, at + 8)
        at += 12 + struct.unpack(">I", head[:4])[0]
    return NONE


def _webp(read: Read) -> Dates:
    at = 12
    while len(head := read(at, 8)) == 8:
        size = struct.unpack("<I", head[4:])[0]
        if head[:4] == b"EXIF":
            return _tiff(read, at + 8 + (6 if read(at + 8, 6) == b"Exif\x00\x00" else 0))
        at += 8 + size + size % 2
    return NONE


def _dates(read: Read) -> Dates:
    """(DateTimeOriginal, DateTimeDigitized, DateTime) of an image read by position."""
    try:
        head = read(0, 12)
        if head[:2] == b"\xff\xd8":
            return _jpeg(read)
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(read)
        if head[:4] == b"RIFF" and head[8:] == b"WEBP":
            return _webp(read)
        return _tiff(read, 0)
    except (struct.error, IndexError, ValueError):
        return NONE


def exif_dates(data: bytes | None) -> Dates:
    """(DateTimeOriginal, DateTimeDigitized, DateTime) of a JPEG, TIFF, PNG or WebP file's bytes."""
    return _dates(lambda at, n: bytes(data[at:at + n])) if data else NONE


def _file_dates(path: str) -> tuple[float | None, Dates]:
    """(modification time, dates) of a file; nulls if there is no such file."""
    import os

    from trapline.sources.images import file_system

    try:
        if "://" in path:
            system, inner = file_system(path)
            mtime = system.get_file_info(inner).mtime
            with system.open_input_file(inner) as f:
                return mtime.timestamp() if mtime else None, _dates(lambda at, n: f.read_at(min(n, max(f.size() - at, 0)), at) if at < f.size() else b"")
        with open(path, "rb", buffering=0) as f:
            def read(at: int, n: int) -> bytes:
                f.seek(at)
                return f.read(n)
            return os.fstat(f.fileno()).st_mtime, _dates(read)
    except OSError:
        return None, NONE


def exif_columns(df: DataFrame, content_col: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """U2 over any binary column: ``keep`` columns plus ``dt_original, dt_digitized, dt`` (whole values, no prefix)."""
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep)
    out_schema = (out_schema + ", " if out_schema else "") + "dt_original string, dt_digitized string, dt string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tags = [exif_dates(b) for b in pdf[content_col]]
            out = pdf[list(keep)].copy()
            out["dt_original"] = [t[0] for t in tags]
            out["dt_digitized"] = [t[1] for t in tags]
            out["dt"] = [t[2] for t in tags]
            yield out

    return df.select(*keep, content_col).mapInPandas(run, out_schema)


def read_exif(listing: DataFrame) -> DataFrame:
    """``(path, modificationTime, dt_original, dt_digitized, dt)`` of listed files, opened by the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tags = [_file_dates(p)[1] for p in pdf["path"]]
            yield pdf.assign(dt_original=[t[0] for t in tags], dt_digitized=[t[1] for t in tags], dt=[t[2] for t in tags])

    return listing.select("path", "modificationTime").mapInPandas(
        run, "path string, modificationTime timestamp, dt_original string, dt_digitized string, dt string")


def capture_dates(listing: DataFrame, key: str = "image_path") -> DataFrame:
    """``(image_path, capture_date)``; EXIF first, then the listing's file time.  One pass, no join."""
    return read_exif(listing).select(
        F.col("path").alias(key),
        capture_date("dt_original", "dt_digitized", "dt", "modificationTime").alias("capture_date"))


_PATH_DATES_SCHEMA = "path string, mtime double, dt_original string, dt_digitized string, dt string"


def _path_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [_file_dates(p) for p in pdf["path"]]
        yield pd.DataFrame({"path": pdf["path"], "mtime": [m for m, _ in found], "dt_original": [t[0] for _, t in found],
                            "dt_digitized": [t[1] for _, t in found], "dt": [t[2] for _, t in found]}).astype({"mtime": "float64"})


def capture_dates_for(rows: DataFrame, path_col: str = "image_path", key: str = "image_path") -> DataFrame:
    """P18 for the files named in ``rows`` only: ``(image_path, capture_date)``.

    Each task opens its files directly; a missing file
    gives a null date (the caller falls back to ``unknown-date``).  Used when
    a table lacks dates for some rows, so the other files are never read.
    """
    paths = rows.select(F.col(path_col).alias("path")).distinct()
    tags = paths.mapInPandas(_path_batches, _PATH_DATES_SCHEMA)
    mtime = F.timestamp_seconds(F.col("mtime"))
    return tags.select(F.col("path").alias(key),
                       capture_date("dt_original", "dt_digitized", "dt", mtime).alias("capture_date"))
