"""Vernacular names and category labels."""
import json

from pyspark.sql import functions as F

from trapline.operators.names import with_category_label, with_resolved_vernacular, with_vernacular
from trapline.sources.names_json import read_names


def vern(spark, names, values):
    df = spark.createDataFrame([(v,) for v in values], "sci string")
    return [r.v for r in with_vernacular(df, F.col("sci"), names, "v").orderBy("sci").collect()]


def test_exact_and_genus_fallback(spark, seed_names):
    df = spark.createDataFrame([("Corvus macrorhynchos",), ("Corvus unknown",), ("Corvus",), ("corvus",),
                                ("  Felis  catus ",), ("",), (None,)], "sci string")
    out = {r.sci: r.v for r in with_vernacular(df, F.col("sci"), seed_names, "v").collect()}
    assert out["Corvus macrorhynchos"] == "ハシブトガラス"
    assert out["Corvus unknown"] == "カラス属"
    assert out["Corvus"] == "カラス属"
    assert out["corvus"] == ""  # case-sensitive (Q22)
    assert out["  Felis  catus "] == "ネコ属"  # stripped; "Felis  catus" is not a species key
    assert out[""] == "" and out[None] == ""


def test_category_pass_through(spark, seed_names):
    df = spark.createDataFrame([("bird",), ("arachnida",), ("",)], "c string")
    out = {r.c: r.l for r in with_category_label(df, F.col("c"), seed_names, "l").collect()}
    assert out == {"bird": "鳥類", "arachnida": "arachnida", "": ""}


def test_late_resolution_keeps_stored_name(spark, seed_names):
    df = spark.createDataFrame([("Corvus corone", "stored"), ("Corvus corone", ""), ("", "")],
                               "scientific_name string, japanese_name string")
    out = sorted((r.scientific_name, r.japanese_name) for r in with_resolved_vernacular(df, seed_names).collect())
    assert out == [("", ""), ("Corvus corone", "stored"), ("Corvus corone", "ハシボソガラス")]


def test_read_names_valid_missing_corrupt(spark, tmp_path):
    good = tmp_path / "names.json"
    good.write_text(json.dumps({"species": {"A b": "x"}, "genus": {"A": "y"}, "category": {"bird": "z"}}),
                    encoding="utf-8")
    rows = sorted(tuple(r) for r in read_names(spark, str(good)).collect())
    assert rows == [("category", "bird", "z"), ("genus", "A", "y"), ("species", "A b", "x")]
    assert read_names(spark, str(tmp_path / "missing.json")).count() == 0
    bad = tmp_path / "bad.json"
    bad.write_text("{not json", encoding="utf-8")
    assert read_names(spark, str(bad)).count() == 0


def test_with_names_and_best_detections(spark, seed_names):
    from trapline import best_detections, with_names

    d = spark.createDataFrame([("/a", 0, "S", "Corvus corone", 0.5, "bird", "", ""),
                               ("/a", 1, "T", "", 0.9, "mammal", "", "")],
                              "image_path string, det_index int, species string, scientific_name string, "
                              "confidence double, category string, common_name string, japanese_name string")
    named = {r.det_index: (r.japanese_name, r.category_label) for r in with_names(d, seed_names).collect()}
    assert named == {0: ("ハシボソガラス", "鳥類"), 1: ("", "哺乳類")}
    imgs = spark.createDataFrame([("/a",), ("/b",)], "image_path string")
    rows = {r.image_path: (r.species, r.confidence) for r in best_detections(imgs, d).collect()}
    assert rows == {"/a": ("T", 0.9), "/b": ("", 0.0)}
