"""Routing names and paths as Column expressions."""
from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from trapline.constants import (
    FOLDER_INVALID_CHARS,
    FOLDER_NAME_MAX,
    LONG_PATH_THRESHOLD,
    SHORT_FOLDER_DIGEST,
    SHORT_FOLDER_PREFIX,
    UNKNOWN_SPECIES_FOLDER,
)
from trapline.functions.text import col_, empty_if_null, ustrip


def safe_folder_name(species, common_name, vernacular) -> Column:
    """``{vernacular or common}_{species}`` (else species), invalid characters -> ``_``,
    at most 100 characters, blank -> ``Unknown_Species``."""
    sp, cm, vn = (empty_if_null(col_(c)) for c in (species, common_name, vernacular))
    display = (F.when((vn != "") & (vn != sp), vn)
               .when((cm != "") & (cm != sp), cm)
               .otherwise(F.lit("")))
    main = F.when(display != "", F.concat(display, F.lit("_"), sp)).otherwise(sp)
    safe = F.translate(main, FOLDER_INVALID_CHARS, "_" * len(FOLDER_INVALID_CHARS))
    safe = F.substring(safe, 1, FOLDER_NAME_MAX)
    return F.when(ustrip(safe) == "", F.lit(UNKNOWN_SPECIES_FOLDER)).otherwise(safe)


def target_parent(base: str, date=None) -> Column:
    """``base`` or ``base/date``."""
    b = F.lit(base.rstrip("/") or "/")
    return b if date is None else F.concat(b, F.lit("/"), col_(date))


def shortened_folder(folder) -> Column:
    """First 40 characters + ``_`` + 8 hex digits of SHA-1 (UTF-8)."""
    f = col_(folder)
    return F.concat(F.substring(f, 1, SHORT_FOLDER_PREFIX), F.lit("_"),
                    F.substring(F.sha1(f), 1, SHORT_FOLDER_DIGEST))


def routed_folder(parent, folder) -> Column:
    """The last path segment, shortened when ``parent/folder`` reaches 240 characters."""
    p, f = col_(parent), col_(folder)
    full = F.concat(p, F.lit("/"), f)
    return F.when(F.length(full) >= LONG_PATH_THRESHOLD, shortened_folder(f)).otherwise(f)


def file_stem(name) -> Column:
    """Path.stem: everything before the last ``.suffix`` (a leading dot is not a suffix)."""
    return F.regexp_extract(col_(name), r"^(.+?)(\.[^.]+)?$", 1)


def file_suffix(name) -> Column:
    return F.regexp_extract(col_(name), r"^(.+?)(\.[^.]+)?$", 2)


def numbered_name(stem, n, suffix) -> Column:
    """``stem_NNN.ext`` with at least three digits."""
    return F.concat(col_(stem), F.lit("_"), F.format_string("%03d", col_(n)), col_(suffix))


def normal_path(path) -> Column:
    """One name for one file: no ``file:``, no empty, ``.`` and ``..`` segments; a relative path is taken from the
    working folder of the job.  The part of a URI before its path stays."""
    p = F.regexp_replace(col_(path), r"^file:/*(?=/)", "")
    scheme = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    local = F.substr(p, F.length(scheme) + 1)
    local = F.when((scheme == "") & ~local.startswith("/"), F.concat(F.lit(os.getcwd() + "/"), local)).otherwise(local)
    none = F.array().cast("array<string>")
    parts = F.aggregate(F.split(local, "/"), none, lambda done, x: F.when((x == "") | (x == "."), done)
                        .when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
                        .otherwise(F.concat(done, F.array(x))))
    tidy = F.concat(scheme, F.lit("/"), F.array_join(parts, "/"))
    # nearly all paths are tidy already
    return F.when(p.rlike(r"^/") & ~p.rlike(r"//|/\.{1,2}(/|$)|/$"), p).otherwise(tidy)
