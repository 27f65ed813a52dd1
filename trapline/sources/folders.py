"""Walking folder trees on the executors, with a memory of what was seen.

The tree is walked one level of folders a job.  A folder or file that can't be read,
or that vanishes meanwhile, is a row among the problems, and the walk goes on.

With a state table, a folder whose modification time is the one remembered is not
opened again: its files and subfolders come from the table (subfolders are still
looked at, each by its own time).  A time counts as settled only if the folder was
read at least SETTLED_NS after it, as a later change may fall into the same tick.
The table is append-only: a run writes the rows of the folders it opened, and the last
run that opened a folder holds.  A file rewritten in place does not change its folder's
time, so its size and time stay those of the last visit; stores without folder times
(``s3://`` and the like) are listed each run.
"""
from __future__ import annotations

import hashlib
import os
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.session import materialize

SETTLED_NS = 2_000_000_000
#: kind: file, sub (folder), folder (one row for each opened), same (not opened), gone, error
VISIT = "folder string, kind string, path string, mtime double, length long, folder_ns long, seen_ns long, detail string"
_COLUMNS = [c.split()[0] for c in VISIT.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
_ROWS = 10_000


def absolute(path: str) -> str:
    """A local path made absolute and normal (its ``file:`` dropped); paths with another scheme as they are."""
    path = re.sub(r"^file:/*(?=/)", "", path)
    return path if "://" in path else os.path.abspath(path)


def file_system(path: str):
    """(pyarrow file system, path in it) of a path with a scheme; an unknown scheme is an error, not an empty result."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))


def visit(folder: str, known_ns: int | None = None, known_at: int | None = None) -> Iterator[tuple]:
    """The rows of one folder: its entries and itself, or that it is unchanged, gone or unreadable."""
    if "://" in folder:
        yield from _visit_remote(folder)
        return
    now = time.time_ns()
    digest = hashlib.sha1()
    try:
        folder_ns = os.stat(folder).st_mtime_ns  # before its entries: a change meanwhile shows in the next run
        if known_ns == folder_ns and known_at is not None and known_at - known_ns >= SETTLED_NS:
            yield folder, "same", folder, None, None, folder_ns, now, None
            return
        with os.scandir(folder) as found:
            for e in sorted(found, key=lambda e: e.name):
                try:
                    if e.is_dir(follow_symlinks=False):
                        row = (folder, "sub", e.path, None, None, None, now, None)
                    elif e.is_file():
                        st = e.stat()
                        row = (folder, "file", e.path, st.st_mtime, st.st_size, None, now, None)
                    else:
                        continue
                except OSError as x:
                    yield _problem(folder, e.path, now, x)
                    continue
                digest.update(f"{row[1]}\0{e.name}\0".encode("utf-8", "surrogateescape"))
                yield row
    except OSError as x:
        yield _problem(folder, folder, now, x)
        return
    yield folder, "folder", folder, None, None, folder_ns, now, digest.hexdigest()


def _problem(folder: str, path: str, now: int, x: OSError) -> tuple:
    kind = "gone" if isinstance(x, FileNotFoundError) else "error"
    return folder, kind, path, None, None, None, now, f"{type(x).__name__}: {x}"


def _visit_remote(folder: str) -> Iterator[tuple]:
    from pyarrow import fs

    now = time.time_ns()
    system, inner = file_system(folder)
    try:
        found = system.get_file_info(fs.FileSelector(inner))
    except OSError as x:
        yield _problem(folder, folder, now, x)
        return
    for e in found:
        kind = "sub" if e.type == fs.FileType.Directory else "file"
        yield folder, kind, f"{folder.rstrip('/')}/{e.base_name}", e.mtime.timestamp() if e.mtime else None, e.size, None, now, None
    yield folder, "folder", folder, None, None, None, now, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], names=_COLUMNS)


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for asked in batch.to_pylist():  # Arrow keeps the nanoseconds whole
            for row in visit(asked["path"], asked["known_ns"], asked["known_at"]):
                rows.append(row)
                if len(rows) >= _ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


@dataclass
class TreeScan:
    files: DataFrame     # path, mtime, length, folder
    problems: DataFrame  # folder, kind (gone, error), path, detail
    visited: DataFrame   # the visits of this run

    def counts(self) -> dict[str, int]:
        """Visits by kind: folder (opened), same (not opened), file, sub, gone, error."""
        return {r["kind"]: r["count"] for r in self.visited.groupBy("kind").count().collect()}


def _remembered(spark: SparkSession, state_path: str) -> DataFrame:
    """The last visits of every remembered folder."""
    try:
        visits = spark.read.schema(f"{VISIT}, run long").parquet(f"{state_path.rstrip('/')}/visits")
    except AnalysisException:  # the first run
        return spark.createDataFrame([], VISIT)
    latest = visits.where("kind = 'folder'").groupBy("folder").agg(F.max("run").alias("run"))
    return visits.join(latest, ["folder", "run"]).select(*_COLUMNS)


def scan_tree(spark: SparkSession, root: str, state_path: str | None = None) -> TreeScan:
    """All regular files under ``root``.  The walk runs when this is called; its levels are written tables.

    With ``state_path`` only folders that changed since the last run are opened (see the module).
    """
    none = F.lit(None).cast("long")
    if state_path:
        before = _remembered(spark, state_path)
        known = before.where("kind = 'folder'").select(F.col("folder").alias("path"), F.col("folder_ns").alias("known_ns"), F.col("seen_ns").alias("known_at"))
    folders = spark.createDataFrame([(absolute(root),)], "path string")
    levels = []
    while True:
        asked = folders.join(known, "path", "left") if state_path else folders.withColumns({"known_ns": none, "known_at": none})
        n = 1 if not levels else count
        asked = asked.repartition(max(1, min(n, spark.sparkContext.defaultParallelism * 4)))
        level = materialize(asked.select("path", "known_ns", "known_at").mapInArrow(_visits, VISIT))
        levels.append(level)
        folders = level.where("kind = 'sub'").select("path")
        if state_path:
            same = level.where("kind = 'same'").select("folder")
            folders = materialize(folders.union(before.where("kind = 'sub'").join(same, "folder", "left_semi").select("path")))
        count = folders.count()
        if not count:
            break
    visited = levels[0]
    for level in levels[1:]:
        visited = visited.unionByName(level)
    files = visited.where("kind = 'file'")
    if state_path:
        kept = before.where("kind = 'file'").join(visited.where("kind = 'same'").select("folder"), "folder", "left_semi")
        files = files.unionByName(kept.select(*_COLUMNS))
        # a folder that could not be read is no news of it: only opened ones are written
        opened = visited.where("kind IN ('file', 'sub', 'folder')")
        if not opened.isEmpty():
            opened.write.parquet(f"{state_path.rstrip('/')}/visits/run={time.time_ns()}")
    problems = visited.where("kind IN ('gone', 'error')").select("folder", "kind", "path", "detail")
    return TreeScan(files.select("path", "mtime", "length", "folder"), problems, visited)
