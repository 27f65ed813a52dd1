"""Placing single files where there is no mounted file system (object stores), through ``pyarrow.fs``.

A store has no hard links and no create-if-absent, so a copy goes to a name of its own
beside the destination, its digest is read back and compared with the source's, the
destination is looked at once more, and only then does the copy get its name (one
rename, or the store's own server-side copy).  Planned destinations are unique, so the
only other writer of a name is a retry of the same task, which brings the same content:
a destination that exists is done if its digest is the source's, else the file fails.
A retry's leftovers never have a destination's name.
"""
from __future__ import annotations

import hashlib
import os
import uuid

from pyarrow import fs

from trapline.sources.folders import file_system

BLOCK = 4 << 20


def is_remote(*paths: str) -> bool:
    return any("://" in p for p in paths)


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return file_system(path) if is_remote(path) else (fs.LocalFileSystem(), os.path.abspath(path))


def _info(at: tuple[fs.FileSystem, str]) -> fs.FileInfo:
    return at[0].get_file_info(at[1])


def _digest(at: tuple[fs.FileSystem, str]) -> bytes:
    seen = hashlib.sha256()
    with at[0].open_input_stream(at[1]) as f:
        while block := f.read(BLOCK):
            seen.update(block)
    return seen.digest()


def _copy(src: tuple[fs.FileSystem, str], dest: tuple[fs.FileSystem, str]) -> bytes:
    """Copies a block at a time; the digest of what was read."""
    seen = hashlib.sha256()
    with src[0].open_input_stream(src[1]) as f, dest[0].open_output_stream(dest[1]) as out:
        while block := f.read(BLOCK):
            seen.update(block)
            out.write(block)
    return seen.digest()


def same_content(src: str, dest: str) -> bool:
    a, b = _at(src), _at(dest)
    return _info(a).size == _info(b).size and _digest(a) == _digest(b)


def exists(path: str) -> bool:
    return _info(_at(path)).type != fs.FileType.NotFound


def same_place(src: str, dest: str) -> bool:
    a, b = _at(src), _at(dest)
    return a[1] == b[1] and a[0].equals(b[0])


def remove(path: str) -> None:
    store, name = _at(path)
    store.delete_file(name)


def place(src: str, dest: str) -> tuple[str, str | None]:
    """``(status, error)`` of one copy, as the mounted form gives them."""
    a, b = _at(src), _at(dest)
    if _info(a).type != fs.FileType.File:
        raise FileNotFoundError(src)
    taken = "FileExistsError: destination has other content"
    if exists(dest):
        return ("exists", None) if same_content(src, dest) else ("failed", taken)
    parent = b[1].rsplit("/", 1)[0]
    if parent and parent != b[1]:
        b[0].create_dir(parent, recursive=True)
    part = (b[0], f"{b[1]}.part-{uuid.uuid4().hex}")
    try:
        if _copy(a, part) != _digest(part):
            return "failed", "OSError: the copy differs from its source"
        if exists(dest):  # a retry was faster
            return ("exists", None) if same_content(src, dest) else ("failed", taken)
        b[0].move(part[1], b[1])
        return "copied", None
    finally:
        if _info(part).type != fs.FileType.NotFound:
            b[0].delete_file(part[1])
