"""A circuit breaker that all tasks of a job share.

Chunks are scored in many tasks at once, so failures in a row are counted over the job:
every chunk's outcome is one small file in a folder that all executors reach, named by
the time it ended.  A failed chunk looks at the failures after the job's last success;
with ``limit`` of them it writes the trip mark.  Every task looks for the mark before a
chunk and leaves its remaining images alone once it is there.  What was scored before
stays in the job's result; images left alone are not done, so a resume takes them up.

The log stays small: a success replaces one file, and failures before it are deleted by
the next failure.  Outcomes are ordered by the executors' clocks; their differences only
matter if they exceed a chunk's time.  A retried task's chunks count again.
"""
from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from trapline.constants import DEFAULT_CONSECUTIVE_ERROR_LIMIT
from trapline.session import scratch_dir
from trapline.sources.folders import file_system

LOG_SCHEMA = "ended_ns long, outcome string, detail string"


@dataclass(frozen=True)
class SharedBreaker:
    """The folder of the log and the number of failures in a row that trips; small, and sent to tasks as it is."""
    path: str
    limit: int = DEFAULT_CONSECUTIVE_ERROR_LIMIT

    @classmethod
    def of(cls, spark: SparkSession, limit: int = DEFAULT_CONSECUTIVE_ERROR_LIMIT) -> SharedBreaker:
        """A breaker with a new log below the cluster's shared folder."""
        return cls(scratch_dir(spark, "breaker"), limit)

    def _store(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            return file_system(self.path if "://" in self.path else "file://" + self.path.removeprefix("file:"))
        return fs.LocalFileSystem(), self.path

    def _files(self) -> tuple[int, list[tuple[int, str]]]:
        """(time of the last success, failures as (time, path) in order)."""
        from pyarrow import fs

        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        ok = max((int(f.base_name.split("-")[1]) for f in found if f.base_name.startswith("ok-")), default=0)
        return ok, sorted((int(f.base_name.split("-")[1]), f.path) for f in found if f.base_name.startswith("fail-"))

    def _write(self, name: str, text: str = "") -> None:
        store, root = self._store()
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write(text.encode("utf-8", "replace"))

    def _delete(self, path: str) -> None:
        try:
            self._store()[0].delete_file(path)
        except OSError:
            pass  # another task was first

    def tripped(self) -> bool:
        from pyarrow import fs

        store, root = self._store()
        return store.get_file_info([f"{root}/tripped"])[0].type == fs.FileType.File

    def succeeded(self, task: int) -> None:
        """Records that a chunk of the task was scored now: one file a task, renamed to the new time."""
        store, root = self._store()
        from pyarrow import fs

        self._write(f"ok-{time.time_ns()}-{task}")
        mine = [f for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("ok-") and f.base_name.endswith(f"-{task}")]
        for f in sorted(mine, key=lambda f: f.base_name)[:-1]:
            self._delete(f.path)

    def failed(self, detail: str) -> bool:
        """Records a failed chunk; whether the job's breaker has tripped."""
        self._write(f"fail-{time.time_ns()}-{uuid.uuid4().hex[:8]}", detail[:500])
        ok, failures = self._files()
        for at, path in failures:
            if at < ok:
                self._delete(path)
        if sum(at > ok for at, _ in failures) >= self.limit:
            self._write("tripped", detail[:500])
        return self.tripped()

    def log(self, spark: SparkSession) -> DataFrame:
        """(ended_ns, outcome, detail) of what the log still holds, for the driver: a few rows a task."""
        ok, failures = self._files()
        store, _ = self._store()
        rows = [(ok, "ok", None)] if ok else []
        for at, path in failures:
            with store.open_input_stream(path) as f:
                rows.append((at, "failed", f.read().decode()))
        return spark.createDataFrame(sorted(rows), LOG_SCHEMA)
