"""Vernacular-name and category-label lookups.

The name dictionary is a long DataFrame ``(kind, name_key, name_value)`` with
``kind`` in ``species | genus | category``.  Lookups are left joins against the
per-kind slice.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.constants import SEED_NAMES
from trapline.functions.text import col_, empty_if_null, first_token, ustrip

NAMES_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType(), False),
    T.StructField("name_key", T.StringType(), False),
    T.StructField("name_value", T.StringType(), False),
])


def names_frame(spark: SparkSession, data: dict | None = None) -> DataFrame:
    """NAMES rows from a ``{kind: {key: value}}`` dictionary (the seed by default)."""
    data = SEED_NAMES if data is None else data
    rows = [(kind, k, v) for kind in ("species", "genus", "category")
            for k, v in (data.get(kind) or {}).items()]
    columns = {f.name: pa.array([r[i] for r in rows], pa.string()) for i, f in enumerate(NAMES_SCHEMA.fields)}
    return spark.createDataFrame(pa.table(columns), NAMES_SCHEMA)  # a local relation: Spark knows its bytes


def _dimension(names: DataFrame, kind: str, prefix: str) -> DataFrame:
    """One value per key of one kind: the largest, a missing one as ``''``.

    One plan whatever the dictionary's size: an aggregate in Spark, without a
    broadcast hint.  Spark broadcasts the result if its bytes are below its own
    threshold (AQE measures them), else the lookup is a shuffle join.
    """
    return (names.filter((F.col("kind") == kind) & F.col("name_key").isNotNull())
            .groupBy("name_key").agg(F.max(F.coalesce("name_value", F.lit(""))).alias("name_value"))
            .toDF(f"{prefix}_key", f"{prefix}_value"))


def vernacular_key(scientific_name) -> tuple[Column, Column]:
    """(exact key, genus key) for a scientific name; nulls when it is blank."""
    key = ustrip(empty_if_null(scientific_name))
    exact = F.when(key != "", key)
    genus = F.when(key.contains(" "), first_token(key)).otherwise(exact)
    return exact, genus


def with_vernacular(df: DataFrame, scientific_name, names: DataFrame,
                    out_col: str = "japanese_name", when: Column | None = None) -> DataFrame:
    """Exact scientific name, else its first token as genus, else ``''``.

    ``when`` restricts the lookup to some rows (others get ``''``).
    """
    exact, genus = vernacular_key(scientific_name)
    if when is not None:
        exact, genus = F.when(when, exact), F.when(when, genus)
    sp = _dimension(names, "species", "_sp")
    ge = _dimension(names, "genus", "_ge")
    out = (df.withColumns({"_sp_lookup": exact, "_ge_lookup": genus})
           .join(sp, F.col("_sp_lookup") == F.col("_sp_key"), "left")
           .join(ge, F.col("_ge_lookup") == F.col("_ge_key"), "left")
           .withColumn(out_col, F.coalesce(F.col("_sp_value"), F.col("_ge_value"), F.lit(""))))
    return out.drop("_sp_lookup", "_ge_lookup", "_sp_key", "_sp_value", "_ge_key", "_ge_value")


def with_category_label(df: DataFrame, category, names: DataFrame,
                        out_col: str = "category_label") -> DataFrame:
    """Category -> label; unknown categories pass through; empty stays empty."""
    cat = empty_if_null(category)
    dim = _dimension(names, "category", "_cat")
    out = (df.withColumn("_cat_lookup", F.when(cat != "", cat))
           .join(dim, F.col("_cat_lookup") == F.col("_cat_key"), "left")
           .withColumn(out_col, F.coalesce(F.col("_cat_value"), F.col("_cat_lookup"), F.lit(""))))
    return out.drop("_cat_lookup", "_cat_key", "_cat_value")


def with_resolved_vernacular(df: DataFrame, names: DataFrame, japanese_col: str = "japanese_name",
                             scientific_col: str = "scientific_name",
                             out_col: str = "japanese_name") -> DataFrame:
    """Keep a stored vernacular name; resolve it from the scientific name when blank."""
    stored = ustrip(empty_if_null(col_(japanese_col)))
    need = (stored == "") & (ustrip(empty_if_null(col_(scientific_col))) != "")
    out = with_vernacular(df.withColumn("_stored_vern", stored), scientific_col, names,
                          out_col="_looked_up_vern", when=need)
    return (out.withColumn(out_col, F.when(F.col("_stored_vern") != "", F.col("_stored_vern"))
                           .otherwise(F.col("_looked_up_vern")))
            .drop("_stored_vern", "_looked_up_vern"))


def with_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """J7 + J4: the vernacular name (stored, else looked up) and the category label."""
    return with_category_label(with_resolved_vernacular(df, names), F.col("category"), names)
