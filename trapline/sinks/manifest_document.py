"""The routing manifest as one JSON document, written in pieces (K7).

    {"created_at", "total_folders", "total_files", "folders": {key: {"file_count", "files": [name, ...]}}}

The document is cut into text files: a header, the folders' lines in ranges of (folder,
order), and a footer.  Read one after the other, in the order of their paths, they are
the document.  A line is a folder's opening or one file, so a folder with a third of all
files is never one row, and ranges may cut it anywhere: an opening has the same sort
key as its folder's first file, so both are in one range, and every other file line
starts with its comma.  An opening also closes the folder before it.
"""
from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.operators.routing import folder_counts
from trapline.session import materialize
from trapline.sources.folders import file_system

HEADER, BODY, FOOTER = "0-header", "1-folders", "2-footer"


def write_manifest_document(routed: DataFrame, path: str, created_at: str | None = None) -> None:
    """``routed`` has ``folder_key, dest_name, seen_order``; folders in key order, files in seen order (then by name)."""
    base, spark = path.rstrip("/"), routed.sparkSession
    folders = materialize(folder_counts(routed).select("folder_key", "file_count", "first_seen"))
    total = folders.agg(F.count(F.lit(1)).alias("folders"), F.coalesce(F.sum("file_count"), F.lit(0)).alias("files"),
                        F.min("folder_key").alias("first")).first()
    head = {"created_at": created_at or datetime.now().isoformat(), "total_folders": total["folders"], "total_files": total["files"]}
    _write(spark.createDataFrame([(json.dumps(head)[:-1] + ', "folders": {',)], "value string"), f"{base}/{HEADER}")
    first = total["first"]
    opening = folders.select("folder_key", F.col("first_seen").alias("seen_order"), F.lit(0).alias("kind"), F.lit("").alias("name"), F.col("file_count").alias("n"))
    files = routed.select("folder_key", "seen_order", F.lit(1).alias("kind"), F.col("dest_name").alias("name"), F.lit(0).cast("long").alias("n"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after_opening = False  # a range never starts with a folder's first file
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    close = "" if row["folder_key"] == first else "]}, "
                    out.append(f'{close}{json.dumps(row["folder_key"], ensure_ascii=False)}: {{"file_count": {row["n"]}, "files": [')
                else:
                    out.append(("" if after_opening else ", ") + json.dumps(row["name"], ensure_ascii=False))
                after_opening = row["kind"] == 0
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    body = opening.unionByName(files).repartitionByRange("folder_key", "seen_order").sortWithinPartitions("folder_key", "seen_order", "kind", "name")
    body.mapInArrow(lines, "value string").write.mode("overwrite").text(f"{base}/{BODY}")
    _write(spark.createDataFrame([("]}}}" if first is not None else "}}",)], "value string"), f"{base}/{FOOTER}")


def _write(one: DataFrame, path: str) -> None:
    one.coalesce(1).write.mode("overwrite").text(path)


def join_pieces(path: str, out: str) -> None:
    """Copies the pieces one after the other into one file, a block at a time."""
    from pyarrow import fs

    def at(p: str):
        return file_system(p) if "://" in p else (fs.LocalFileSystem(), p)

    store, base = at(path.rstrip("/"))
    target, file = at(out)
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    pieces = sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.startswith("part-"))
    with target.open_output_stream(file) as sink:
        for piece in pieces:
            with store.open_input_stream(piece) as source:
                while block := source.read(8 << 20):
                    sink.write(block)
