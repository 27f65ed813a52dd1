"""Text helpers as Column expressions (JVM-side, codegen friendly)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trapline.constants import NO_DETECTION_LABELS

# Characters Python's str.strip()/str.split() treat as whitespace.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
              + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
# the same set as a Java regex character class
_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Strip leading/trailing Unicode whitespace (SQL ``trim`` only removes U+0020).

    ``btrim`` with an explicit character set: no regular expression per row.
    """
    return F.btrim(col_(c), F.lit(WHITESPACE))


def first_token(c) -> Column:
    """First whitespace-separated token of an already stripped string."""
    return F.split(col_(c), f"{_WS}+", 2).getItem(0)


def empty_if_null(c) -> Column:
    return F.coalesce(col_(c), F.lit(""))


def py_capitalize(c) -> Column:
    """First character upper, the rest lower (not ``initcap``: that title-cases every word)."""
    c = col_(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def is_no_detection(c, labels=NO_DETECTION_LABELS) -> Column:
    """Empty, or trimmed lower-case value in the "nothing detected" label set.

    Emptiness is tested before stripping, so a whitespace-only value is not a
    no-detection label.
    """
    c = col_(c)
    return (F.coalesce(c, F.lit("")) == "") | F.lower(ustrip(c)).isin(*labels)


def nonempty(c) -> Column:
    return F.coalesce(col_(c), F.lit("")) != ""
