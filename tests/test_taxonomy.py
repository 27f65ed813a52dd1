"""Prediction parsing (P1-P9): literal cases carried over from the reference's parser tests."""
import pytest
from pyspark.sql import functions as F

from trapline.operators.detections import best_in_array, best_per_image, parse_predictions


def parse(spark, names, rows, **kw):
    df = spark.createDataFrame(rows, "image_path string, det_index int, prediction string, prediction_score double")
    return {r.det_index: r for r in parse_predictions(df, names, threshold=0.1, **kw).collect()}


def one(spark, names, prediction, score=0.9):
    out = parse(spark, names, [("/a.jpg", 0, prediction, score)])
    return out.get(0)


def test_full_string_with_vernacular(spark, seed_names):
    r = one(spark, seed_names, "uuid-real;aves;passeriformes;corvidae;corvus;macrorhynchos;large-billed crow")
    assert r.scientific_name == "Corvus macrorhynchos"
    assert r.category == "bird"
    assert r.japanese_name == "ハシブトガラス"
    assert r.species == "Corvus macrorhynchos (large-billed crow / ハシブトガラス)"


def test_unknown_species_has_no_vernacular(spark, seed_names):
    r = one(spark, seed_names, "uuid-x;aves;x;y;foo;bar;fictional foo")
    assert r.species == "Foo bar (fictional foo)"
    assert r.japanese_name == ""


def test_unmapped_class_is_lowercased(spark, seed_names):
    assert one(spark, seed_names, "uuid-arachnid;arachnida;araneae;araneidae;argiope;bruennichi;").category == "arachnida"


@pytest.mark.parametrize("pred", ["", "blank", "no cv result", "no_cv_result", "  Blank  ", "u03;;;;;;blank"])
def test_no_detection_labels(spark, seed_names, pred):
    r = one(spark, seed_names, pred)
    assert (r.species, r.category, r.scientific_name, r.common_name) == ("", "no_detection", "", "")


def test_too_few_parts_keeps_raw(spark, seed_names):
    r = one(spark, seed_names, "not;enough;parts")
    assert (r.species, r.scientific_name, r.category) == ("not;enough;parts", "not;enough;parts", "unknown")


def test_no_separator_keeps_raw(spark, seed_names):
    r = one(spark, seed_names, "just a label")
    assert (r.species, r.category, r.japanese_name) == ("just a label", "unknown", "")


def test_common_name_only(spark, seed_names):
    assert one(spark, seed_names, "uuid-5;aves;passeriformes;corvidae;;;カラス類").species == "カラス類"


def test_all_empty_fields_use_raw_string(spark, seed_names):
    r = one(spark, seed_names, "u;;;;;;")
    assert (r.species, r.category) == ("u;;;;;;", "unknown")


def test_extra_parts_are_ignored(spark, seed_names):
    r = one(spark, seed_names, "u;mammalia;o;f;felis;catus;cat;extra;more")
    assert r.scientific_name == "Felis catus"
    assert r.species == "Felis catus (cat / イエネコ)"


def test_no_cv_is_not_a_label(spark, seed_names):
    r = one(spark, seed_names, "u12;no cv;;;no cv;no cv;no cv")
    assert (r.species, r.category) == ("No cv no cv (no cv)", "no cv")


def test_genus_only_uses_python_capitalize(spark, seed_names):
    r = one(spark, seed_names, "u;mammalia;o;f;FELIS;;cat genus")
    assert r.scientific_name == "Felis"
    assert r.japanese_name == "ネコ属"
    assert r.species == "Felis (cat genus / ネコ属)"


def test_threshold_and_missing_score(spark, seed_names):
    out = parse(spark, seed_names, [("/a.jpg", 0, "blank", 0.05), ("/a.jpg", 1, "blank", None),
                                    ("/a.jpg", 2, "blank", 0.1)])
    assert sorted(out) == [2]


def test_nan_score_passes_threshold(spark, seed_names):
    assert one(spark, seed_names, "blank", float("nan")) is not None


def test_malformed_text_score_is_dropped(spark, seed_names):
    df = spark.createDataFrame([("/a.jpg", 0, "blank", "not_a_number"), ("/a.jpg", 1, "blank", "0.9"),
                                ("/a.jpg", 2, "blank", None)],
                               "image_path string, det_index int, prediction string, prediction_score string")
    out = parse_predictions(df, seed_names, threshold=0.1).collect()
    assert [r.det_index for r in out] == [1]


def test_structured_keys_win(spark, seed_names):
    df = spark.createDataFrame(
        [("/a.jpg", 0, "u;aves;o;f;corvus;corone;carrion crow", 0.9, "mammalia", None, "vulpes", "vulpes", "red fox"),
         ("/a.jpg", 1, "u;aves;o;f;corvus;corone;carrion crow", 0.9, " ", "aves", "", "", "")],
        "image_path string, det_index int, prediction string, prediction_score double, class string, "
        "class_name string, genus string, species string, common_name string")
    out = {r.det_index: r for r in parse_predictions(
        df, seed_names, class_col="class", class_name_col="class_name", genus_col="genus",
        species_col="species", common_col="common_name").collect()}
    assert out[0].scientific_name == "Vulpes vulpes"
    assert out[0].category == "mammal"
    assert out[0].species == "Vulpes vulpes (red fox / アカギツネ)"
    # a blank "class" shadows class_name, and with nothing else structured the string is parsed
    assert out[1].scientific_name == "Corvus corone"


def test_best_detection_first_wins_ties(spark):
    df = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.9), ("a", 2, 0.9), ("b", 0, None), ("c", 0, float("nan")),
                                ("c", 1, 0.2)], "image_path string, det_index int, confidence double")
    best = {r.image_path: r.det_index for r in best_per_image(df, fields=("confidence",)).collect()}
    assert best == {"a": 1, "b": 0, "c": 1}


def test_best_box_array_form(spark):
    df = spark.createDataFrame([([(0.3, [1.0, 2.0, 3.0, 4.0]), (0.8, [5.0, 6.0, 7.0, 8.0]), (0.8, [0.0] * 4)],),
                                ([],)], "boxes array<struct<conf:double, bbox:array<double>>>")
    out = df.select(best_in_array(F.col("boxes"), "conf")["bbox"].alias("b")).collect()
    assert out[0].b == [5.0, 6.0, 7.0, 8.0]
    assert out[1].b is None


def test_struct_and_staged_forms_agree(spark):
    from trapline.functions.taxonomy import species_info, with_taxonomy

    preds = ["u;aves;o;f;corvus;corone;crow", "blank", "  ", "", "not;enough", "u;;;;;;", "x;no cv;;;no cv;no cv;no cv",
             "u;MAMMALIA;o;f;;;fox", "u;aves;o;f;;;blank", "u;insecta;o;f;trypoxylus;dichotomus;beetle;extra", None]
    rows = [(p, c, cm) for p in preds for c, cm in ((None, None), ("aves", ""), ("", "owl"), (" ", "blank"))]
    df = spark.createDataFrame(rows, "prediction string, cls string, cm string")
    a = df.withColumn("t", species_info(F.col("prediction"), F.col("cls"), None, None, None, F.col("cm")))
    b = with_taxonomy(a, "prediction", class_col="cls", common_col="cm")
    for r in b.collect():
        assert (r.t.kind, r.t.category, r.t.scientific_name, r.t.common_name) == (
            r._tx_kind, r._tx_category, r._tx_scientific_name, r._tx_common_name), r
