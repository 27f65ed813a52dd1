"""Taxonomy parsing as Column expressions.

A model prediction is either a ``uuid;class;order;family;genus;species;common``
string or a set of structured keys.  Parsing yields a struct with a ``kind``:

* ``nodet`` - nothing detected: every text field ``''``, category ``no_detection``;
* ``raw``   - unparseable string: the raw string is species and scientific name,
  category ``unknown``, no vernacular lookup;
* ``build`` - regular taxonomy: scientific name built from genus/species, the
  vernacular name is looked up by it (a join, see ``operators.names``), and the
  display name is finished with :func:`display_species`.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trapline.constants import (
    CATEGORY_MAP,
    NO_DETECTION_CATEGORY,
    NO_DETECTION_LABELS,
    UNKNOWN_CATEGORY,
    UNKNOWN_SCIENTIFIC_NAME,
)
from trapline.functions.text import col_, empty_if_null, is_no_detection, py_capitalize, ustrip

KIND_NODET = "nodet"
KIND_RAW = "raw"
KIND_BUILD = "build"

TAXONOMY_FIELDS = ("kind", "category", "scientific_name", "common_name", "raw")


def category_of(class_name) -> Column:
    """P5: class -> category; unmapped -> lower-cased class; empty -> ``unknown``."""
    low = F.lower(col_(class_name))
    mapped = None
    for key, value in CATEGORY_MAP.items():
        mapped = F.when(low == key, value) if mapped is None else mapped.when(low == key, value)
    return mapped.when(low != "", low).otherwise(F.lit(UNKNOWN_CATEGORY))


def _nodet_nonempty(v: Column, labels) -> Column:
    # v is already stripped and non-empty where this matters
    return F.lower(v).isin(*labels)


def _build(cls: Column, genus: Column, species: Column, common: Column, fallback: Column,
           labels) -> Column:
    """P5-P8 for stripped parts; returns the taxonomy struct."""
    values = [cls, genus, species, common]
    any_nonempty = reduce(lambda a, b: a | b, [v != "" for v in values])
    all_blank = any_nonempty & reduce(
        lambda a, b: a & b, [(v == "") | _nodet_nonempty(v, labels) for v in values])
    common_is_label = (common == "") | _nodet_nonempty(common, labels)
    sci = (F.when((genus != "") & (species != ""), F.concat(py_capitalize(genus), F.lit(" "), species))
            .when(genus != "", py_capitalize(genus))
            .when(~common_is_label, common)
            .otherwise(F.coalesce(F.nullif(fallback, F.lit("")), F.lit(UNKNOWN_SCIENTIFIC_NAME))))
    built = F.struct(
        F.lit(KIND_BUILD).alias("kind"),
        category_of(cls).alias("category"),
        sci.alias("scientific_name"),
        F.when(common_is_label, F.lit("")).otherwise(common).alias("common_name"),
        fallback.alias("raw"),
    )
    return F.when(all_blank, nodet_struct(fallback)).otherwise(built)


def nodet_struct(raw: Column) -> Column:
    return F.struct(
        F.lit(KIND_NODET).alias("kind"),
        F.lit(NO_DETECTION_CATEGORY).alias("category"),
        F.lit("").alias("scientific_name"),
        F.lit("").alias("common_name"),
        raw.alias("raw"),
    )


def raw_struct(raw: Column) -> Column:
    return F.struct(
        F.lit(KIND_RAW).alias("kind"),
        F.lit(UNKNOWN_CATEGORY).alias("category"),
        raw.alias("scientific_name"),
        F.lit("").alias("common_name"),
        raw.alias("raw"),
    )


def parse_prediction_string(prediction, labels=NO_DETECTION_LABELS) -> Column:
    """Parse ``uuid;class;order;family;genus;species;common`` (extra parts ignored)."""
    s = empty_if_null(prediction)
    parts = F.split(s, ";", -1)

    def part(i: int) -> Column:
        return ustrip(F.coalesce(F.get(parts, i), F.lit("")))

    return (F.when(is_no_detection(s, labels), nodet_struct(s))
            .when(~s.contains(";") | (F.size(parts) < 7), raw_struct(s))
            .otherwise(_build(part(1), part(4), part(5), part(6), s, labels)))


def species_info(prediction, class_=None, class_name=None, genus=None, species=None,
                 common_name=None, labels=NO_DETECTION_LABELS) -> Column:
    """Structured keys win when any of them is non-empty, else parse the string.

    ``class`` is preferred over ``class_name`` before stripping, as a value that
    is present but blank still shadows the other key.
    """
    def opt(c):
        return F.lit("") if c is None else empty_if_null(c)

    cls = ustrip(F.coalesce(F.nullif(opt(class_), F.lit("")), F.nullif(opt(class_name), F.lit("")),
                            F.lit("")))
    g, sp, cm = ustrip(opt(genus)), ustrip(opt(species)), ustrip(opt(common_name))
    structured = (cls != "") | (g != "") | (sp != "") | (cm != "")
    fallback = F.coalesce(col_(prediction), F.lit("")) if prediction is not None else F.lit("")
    return (F.when(structured, _build(cls, g, sp, cm, fallback, labels))
            .otherwise(parse_prediction_string(prediction, labels)))


def display_species(kind, scientific_name, common_name, vernacular, raw) -> Column:
    """``sci (common / vernacular)``, omitting empty or duplicate parts."""
    sci, common, vern = col_(scientific_name), col_(common_name), col_(vernacular)
    p1 = F.when((common != "") & (F.lower(common) != F.lower(sci)), common)
    p2 = F.when((vern != "") & (vern != common), vern)
    built = F.when(p1.isNull() & p2.isNull(), sci).otherwise(
        F.concat(sci, F.lit(" ("), F.concat_ws(" / ", p1, p2), F.lit(")")))
    k = col_(kind)
    return F.when(k == KIND_BUILD, built).when(k == KIND_RAW, col_(raw)).otherwise(F.lit(""))


def with_taxonomy(df, prediction_col: str = "prediction", class_col: str | None = None,
                  class_name_col: str | None = None, genus_col: str | None = None,
                  species_col: str | None = None, common_col: str | None = None,
                  labels=NO_DETECTION_LABELS, prefix: str = "_tx_"):
    """P3-P8 as staged projections: parts, then kind, then fields.

    Same result as :func:`species_info`, but each intermediate is a column
    computed once per row (the optimizer keeps non-cheap expressions that are
    referenced several times in their own projection), which keeps generated
    code small.  Adds ``{prefix}kind, {prefix}category, {prefix}scientific_name,
    {prefix}common_name, {prefix}raw``.
    """
    p = prefix

    def opt(name):
        return F.lit("") if name is None else empty_if_null(F.col(name))

    raw = empty_if_null(F.col(prediction_col))
    s_cls = ustrip(F.coalesce(F.nullif(opt(class_col), F.lit("")), F.nullif(opt(class_name_col), F.lit("")),
                              F.lit("")))
    # stage 1: raw string, its parts, stripped structured keys (one projection)
    df = df.withColumns({f"{p}raw": raw, f"{p}parts": F.split(raw, ";", -1), f"{p}s_cls": s_cls,
                         f"{p}s_gen": ustrip(opt(genus_col)), f"{p}s_sp": ustrip(opt(species_col)),
                         f"{p}s_cm": ustrip(opt(common_col))})
    structured = ((F.col(f"{p}s_cls") != "") | (F.col(f"{p}s_gen") != "") | (F.col(f"{p}s_sp") != "")
                  | (F.col(f"{p}s_cm") != ""))

    def part(i):
        return ustrip(F.coalesce(F.get(F.col(f"{p}parts"), i), F.lit("")))

    # stage 2: the four taxonomy fields from the structured keys or the string
    df = df.withColumn(f"{p}structured", structured)
    st = F.col(f"{p}structured")
    df = df.withColumns({f"{p}cls": F.when(st, F.col(f"{p}s_cls")).otherwise(part(1)),
                         f"{p}gen": F.when(st, F.col(f"{p}s_gen")).otherwise(part(4)),
                         f"{p}sp": F.when(st, F.col(f"{p}s_sp")).otherwise(part(5)),
                         f"{p}cm": F.when(st, F.col(f"{p}s_cm")).otherwise(part(6))})
    cls, gen, sp, cm = (F.col(f"{p}{n}") for n in ("cls", "gen", "sp", "cm"))
    s = F.col(f"{p}raw")
    values = [cls, gen, sp, cm]
    any_nonempty = reduce(lambda a, b: a | b, [v != "" for v in values])
    all_blank = any_nonempty & reduce(lambda a, b: a & b,
                                      [(v == "") | _nodet_nonempty(v, labels) for v in values])
    string_route = ~st
    kind = (F.when(string_route & is_no_detection(s, labels), F.lit(KIND_NODET))
            .when(string_route & (~s.contains(";") | (F.size(F.col(f"{p}parts")) < 7)), F.lit(KIND_RAW))
            .when(all_blank, F.lit(KIND_NODET))
            .otherwise(F.lit(KIND_BUILD)))
    # stage 3: kind; stage 4: the output fields
    df = df.withColumn(f"{p}kind", kind)
    k = F.col(f"{p}kind")
    common_is_label = (cm == "") | _nodet_nonempty(cm, labels)
    sci = (F.when((gen != "") & (sp != ""), F.concat(py_capitalize(gen), F.lit(" "), sp))
           .when(gen != "", py_capitalize(gen))
           .when(~common_is_label, cm)
           .otherwise(F.coalesce(F.nullif(s, F.lit("")), F.lit(UNKNOWN_SCIENTIFIC_NAME))))
    df = df.withColumns({
        f"{p}category": F.when(k == KIND_BUILD, category_of(cls)).when(k == KIND_RAW, F.lit(UNKNOWN_CATEGORY))
        .otherwise(F.lit(NO_DETECTION_CATEGORY)),
        f"{p}scientific_name": F.when(k == KIND_BUILD, sci).when(k == KIND_RAW, s).otherwise(F.lit("")),
        f"{p}common_name": F.when((k == KIND_BUILD) & ~common_is_label, cm).otherwise(F.lit("")),
    })
    return df.drop(*[f"{p}{n}" for n in ("parts", "s_cls", "s_gen", "s_sp", "s_cm", "structured", "cls", "gen",
                                         "sp", "cm")])
