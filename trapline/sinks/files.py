"""Executing a routing plan: copy or move image files.

Each task handles its share of files and *returns* one status row per file
``(image_path, dest_path, folder_key, dest_name, seen_order, status, error)``; a
failing file is reported, not fatal.

No destination is ever written over: a copy goes to a temporary name of its own
and then gets the destination's name by a hard link, which fails if that name
exists.  A destination that exists counts as done (``exists``) only if its
content is the source's, as after a retried task; otherwise the file fails and
its source stays.  Moving is two jobs: place (a link on the same file system, a
copy across two), then delete the sources whose destination is the same file or
has the same content.  The status rows of both jobs are written tables, so no
file is handled twice because a frame is read twice.  Paths without a scheme must be on
storage every executor sees as a file system; ``scheme://`` paths go through
:mod:`trapline.sinks.stores`, by digests.
"""
from __future__ import annotations

import errno
import hashlib
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.session import scratch_dir
from trapline.sinks import stores

STATUS_SCHEMA = ("image_path string, dest_path string, folder_key string, dest_name string, seen_order long, "
                 "status string, error string")
DONE = ("copied", "linked", "exists", "moved")
_COLUMNS = ("image_path", "dest_path", "folder_key", "dest_name", "seen_order")


def _digest(path: str) -> bytes:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").digest()


def _same(src: str, dest: str) -> bool:
    """One file under two names, or equal content."""
    if os.path.samefile(src, dest):
        return True
    return os.path.getsize(src) == os.path.getsize(dest) and _digest(src) == _digest(dest)


def _claim(tmp: str, dest: str) -> None:
    """Gives a finished temporary file the destination's name; ``FileExistsError`` if that is taken."""
    try:
        os.link(tmp, dest)
    except OSError as e:
        if e.errno not in (errno.EPERM, errno.EOPNOTSUPP, errno.ENOSYS, errno.EMLINK):
            raise
        # no hard links here: take the name first, then fill it
        try:
            with open(dest, "xb") as out, open(tmp, "rb") as f:
                shutil.copyfileobj(f, out)
        except FileExistsError:
            raise
        except OSError:  # an own part file must not stand under the final name
            os.remove(dest)
            raise
        shutil.copystat(tmp, dest)


def _place(src: str, dest: str, move: bool) -> tuple[str, str | None]:
    try:
        if stores.is_remote(src, dest):
            return stores.place(src, dest)
        os.makedirs(os.path.dirname(dest), exist_ok=True)
        if os.path.lexists(dest):
            return ("exists", None) if _same(src, dest) else ("failed", "FileExistsError: destination has other content")
        if move:
            try:
                os.link(src, dest)
                return "linked", None
            except FileExistsError:
                return ("exists", None) if _same(src, dest) else ("failed", "FileExistsError: destination has other content")
            except OSError:  # another file system, or no hard links: copy
                pass
        tmp = f"{dest}.part-{uuid.uuid4().hex}"
        try:
            shutil.copy2(src, tmp)
            _claim(tmp, dest)
        except FileExistsError:
            return ("exists", None) if _same(src, dest) else ("failed", "FileExistsError: destination has other content")
        finally:
            if os.path.lexists(tmp):
                os.remove(tmp)
        return "copied", None
    except (OSError, ValueError) as e:  # ValueError: a scheme that no file system here knows
        return "failed", f"{type(e).__name__}: {e}"


def _remove(src: str, dest: str) -> tuple[str, str | None]:
    try:
        if stores.is_remote(src, dest):
            return _remove_remote(src, dest)
        if not os.path.exists(src):  # a retried task already removed it
            return ("moved", None) if os.path.exists(dest) else ("failed", "source and destination are missing")
        if not _same(src, dest):
            return "failed", "destination not verified"
        if os.path.realpath(src) == os.path.realpath(dest):
            return "exists", None  # already in place
        os.remove(src)
        return "moved", None
    except (OSError, ValueError) as e:
        return "failed", f"{type(e).__name__}: {e}"


def _remove_remote(src: str, dest: str) -> tuple[str, str | None]:
    if not stores.exists(src):
        return ("moved", None) if stores.exists(dest) else ("failed", "source and destination are missing")
    if stores.same_place(src, dest):
        return "exists", None  # already in place
    if not stores.exists(dest) or not stores.same_content(src, dest):
        return "failed", "destination not verified"
    stores.remove(src)
    return "moved", None


def _each(act: Callable[[str, str], tuple[str, str | None]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            res = [act(s, d) for s, d in zip(pdf["image_path"], pdf["dest_path"])]
            yield pdf[list(_COLUMNS)].assign(status=[r[0] for r in res], error=[r[1] for r in res])
    return run


def place_files(plan: DataFrame, move: bool = False, partitions: int | None = None) -> DataFrame:
    """K8: status rows for every planned file (lazy; run with an action or a write).

    Files are spread by a hash of the destination path, not by folder, so a
    hot folder does not end up in one task.
    """
    spark = plan.sparkSession
    n = partitions or max(spark.sparkContext.defaultParallelism,
                          int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    if "seen_order" not in plan.columns:
        plan = plan.withColumn("seen_order", F.lit(None).cast("long"))
    return (plan.select(*_COLUMNS).repartition(n, F.xxhash64("dest_path"))
            .mapInPandas(_each(lambda s, d: _place(s, d, move)), STATUS_SCHEMA))


def delete_moved_sources(status: DataFrame) -> DataFrame:
    """K8 move, second job: delete the sources of verified destinations only."""
    ok = status.filter(F.col("status").isin(*DONE))
    return ok.mapInPandas(_each(_remove), STATUS_SCHEMA)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def execute_routing(plan: DataFrame, mode: str = "copy", status_path: str | None = None) -> DataFrame:
    """Copy (or move) the planned files.

    The status rows are a written table (of the scratch folder, without
    ``status_path``), so the files are handled once however often the rows are read;
    moving requires the path (a new one: an earlier run's status is never replaced).
    """
    if mode not in ("copy", "move"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "move" and not status_path:
        raise ValueError("moving files needs a status_path: the deletions are fed by written status rows")
    status_path = status_path or scratch_dir(plan.sparkSession, "route-status")
    status = _written(place_files(plan, move=mode == "move"), status_path)
    if mode == "copy":
        return status
    moved = delete_moved_sources(status)
    out = moved.unionByName(status.filter(~F.col("status").isin(*DONE)))
    return _written(out, f"{status_path.rstrip('/')}-moved")
