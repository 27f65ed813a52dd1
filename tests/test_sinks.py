"""Report writers (K3-K7), model-output reader (S4), detail remarks (P14) and page/first-n helpers."""
import glob
import json
import os

from pyspark.sql import functions as F

from trapline.operators import reports as rep
from trapline.operators.detections import detail_remark, parse_predictions, top_n_wide
from trapline.sinks.csv_excel import join_report, write_pivot, write_report_csv, write_species_list, write_summary_report
from trapline.sinks.manifest import write_manifest
from trapline.sources.predictions import best_box, read_predictions


def read_csv_text(path):
    join_report(path, path + ".csv")
    with open(path + ".csv", encoding="utf-8-sig") as f:
        return f.read().splitlines()


def test_report_parts_join_to_one_file(spark, tmp_path):
    """Many parts, one header: quoted, empty and null cells, lines in order whatever the parts."""
    import csv

    rows = [(i, None if i % 7 == 0 else f'n"{i}, x' if i % 5 == 0 else "" if i % 3 == 0 else f"two\nlines {i}", i * 2) for i in range(500)]
    df = spark.createDataFrame(rows, "at int, name string, n long").repartition(9)
    out = str(tmp_path / "report")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_report_csv(df, out, ["at"], ["名前", "n"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{out}/part-*")) > 3
    join_report(out, str(tmp_path / "one.csv"))
    data = (tmp_path / "one.csv").read_bytes()
    assert data.startswith(b"\xef\xbb\xbf") and data.count(b"\xef\xbb\xbf") == 1
    got = list(csv.reader((tmp_path / "one.csv").open(encoding="utf-8-sig", newline="")))
    assert got == [["名前", "n"]] + [[name or "", str(n)] for _, name, n in rows]


def test_pivot_file_layout(spark, tmp_path):
    pivot = spark.createDataFrame(
        [(1, 0, "合計撮影枚数", 4, 3, 1), (2, 1, "撮影無し", 1, 1, 0), (3, 2, "ハシブトガラス", 3, 2, 1),
         (4, 3, "合計", 4, 3, 1)],
        "row_order int, block int, label string, total long, `2024-11-21` long, `2024-11-22` long")
    out = str(tmp_path / "pivot")
    write_pivot(pivot, out)
    assert read_csv_text(out) == ["日付,2024-11-21,2024-11-22", "合計撮影枚数,3,1", "撮影無し,1,0",
                                  "ハシブトガラス,2,1", "合計,3,1"]


def test_species_list_and_summary_files(spark, seed_names, tmp_path):
    d = spark.createDataFrame([("S", "c", "", "Sus scrofa", 0.5, "mammal", 0, 0)],
                              "species string, common_name string, japanese_name string, scientific_name string, "
                              "confidence double, category string, seen_order long, det_index int")
    out = str(tmp_path / "species")
    write_species_list(rep.species_list(d, seed_names), out)
    lines = read_csv_text(out)
    assert lines[0] == "種名,一般名,和名,学名,カテゴリ,検出回数,最高信頼度,平均信頼度"
    assert lines[1] == "S,c,イノシシ,Sus scrofa,哺乳類,1,0.5000,0.5000"
    t = spark.createDataFrame([("/a", "S", "mammal", 0.95, 0)],
                              "image_path string, species string, category string, confidence double, "
                              "seen_order long")
    out2 = str(tmp_path / "summary")
    write_summary_report(rep.summary_report(t, seed_names), out2, source="x.csv", generated="2024-01-02 03:04:05", seconds=2.0, images=1)
    data = b"".join(open(f, "rb").read() for f in glob.glob(f"{out2}/part-*"))
    assert data.decode("utf-8").split("\r\n") == [
        "\ufeffWildlife Detection Summary Report", "Generated:,2024-01-02 03:04:05", "Source CSV:,x.csv", "",
        "基本統計", "項目,値", "総画像数,1", "検出成功画像数,1", "検出失敗画像数,0", "総検出数,1", "成功率 (%),100.0",
        "処理時間 (秒),2.0", "処理速度 (画像/秒),0.50", "",
        "検出種別統計", "種名,検出回数,割合 (%)", "S,1,100.0", "",
        "カテゴリ別統計", "カテゴリ,検出回数,割合 (%)", "哺乳類,1,100.0", "",
        "信頼度統計", "信頼度範囲,検出数", "0.9-1.0 (非常に高い),1", "0.7-0.9 (高い),0", "0.5-0.7 (中程度),0", "0.3-0.5 (低い),0",
        "0.0-0.3 (非常に低い),0", ""]


def test_numbers_are_rounded_as_in_python(spark):
    from trapline.sinks.csv_excel import fmt

    values = [0.15, 0.25, 0.35, 2.675, 0.00005, 0.12345, 0.5, 99.95, 100.0, 0.0, -0.25, 1234567.125, 1 / 3, 0.99995]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for d in (1, 2, 4):
        assert [r[0] for r in df.select(fmt("v", d)).collect()] == [f"{v:.{d}f}" for v in values]


def test_pivot_counts_every_date(spark, tmp_path):
    """Dates outside the list share the last column; label totals, row sums and the grand total agree."""
    from trapline.sinks.csv_excel import write_pivot_long

    rows = [("2024-01-01", "a", 5), ("2025-06-07", "a", 2), ("2025-06-07", "b", 3)]
    counts = spark.createDataFrame([(d, x, n, 0) for d, x, n in rows], "image_date string, label string, n_images long, grouping_id int")
    for dates in (["2024-01-01"], None, []):
        got = rep.daily_label_pivot(counts, dates).collect()
        by = {r["label"]: r for r in got}
        assert by["a"]["total"] == 7 and by["b"]["total"] == 3 and got[0]["total"] == got[-1]["total"] == 10
        assert all(sum(r[c] for c in r.asDict() if c not in ("row_order", "block", "label", "total")) == r["total"] for r in got)
    write_pivot_long(counts, str(tmp_path / "long"))
    assert sum(len(open(f, encoding="utf-8-sig").readlines()) - 1 for f in glob.glob(str(tmp_path / "long" / "part-*.csv"))) == 3


def test_manifest_long_form(spark, tmp_path):
    routed = spark.createDataFrame([("A", "x.jpg", 0), ("A", "y.jpg", 1), ("B", "z.jpg", 2)],
                                   "folder_key string, dest_name string, seen_order long")
    out = str(tmp_path / "manifest")
    write_manifest(routed, out)
    summary = [json.loads(line) for f in glob.glob(f"{out}/summary/part-*") for line in open(f)]
    assert summary[0]["total_folders"] == 2 and summary[0]["total_files"] == 3
    folders = {json.loads(line)["folder_key"]: json.loads(line)["file_count"]
               for f in glob.glob(f"{out}/folders/part-*") for line in open(f)}
    assert folders == {"A": 2, "B": 1}
    files = sorted(json.loads(line)["file"] for f in glob.glob(f"{out}/files/part-*") for line in open(f))
    assert files == ["x.jpg", "y.jpg", "z.jpg"]


def test_read_predictions_nested_document(spark, seed_names, tmp_path):
    doc = {"predictions": [
        {"filepath": "/a.jpg", "prediction": "u;aves;o;f;corvus;corone;carrion crow", "prediction_score": 0.8,
         "detections": [{"conf": 0.2, "bbox": [0, 0, 1, 1]}, {"conf": 0.7, "bbox": [0.1, 0.2, 0.3, 0.4]}]},
        {"filepath": "/a.jpg", "prediction": "blank", "prediction_score": 0.95, "detections": []},
        {"filepath": "/b.jpg", "prediction": "u;mammalia;o;f;;;", "prediction_score": "oops"},
    ]}
    p = tmp_path / "preds.json"
    p.write_text(json.dumps(doc), encoding="utf-8")
    rows = read_predictions(spark, str(p), nested=True)
    assert rows.count() == 3
    shaped = parse_predictions(rows, seed_names).withColumn("bbox", best_box(F.col("detections")))
    got = {(r.image_path, r.det_index): r for r in shaped.collect()}
    assert set(got) == {("/a.jpg", 0), ("/a.jpg", 1)}  # the malformed score is dropped
    assert got[("/a.jpg", 0)].bbox == [0.1, 0.2, 0.3, 0.4]
    assert got[("/a.jpg", 1)].bbox == []


def test_detail_remarks_and_overflow(spark):
    df = spark.createDataFrame([(0,), (3,), (5,)], "n int")
    got = [r.r for r in df.select(detail_remark(F.col("n")).alias("r")).orderBy("n").collect()]
    assert got == ["野生生物が検出されませんでした", "", "追加で2個の検出があります"]
    arr = spark.createDataFrame([([("s1", 0.5), ("s2", 0.4), ("s3", 0.3), ("s4", 0.2)],)],
                                "detections array<struct<species:string, confidence:double>>")
    w = top_n_wide(arr, fields=("species", "confidence")).first()
    assert (w.detection_count, w.species_1, w.species_3, w.more_count) == (4, "s1", "s3", 1)


def test_detail_export_and_table_export(spark, seed_names, tmp_path):
    from trapline.constants import DETAIL_HEADER
    from trapline.sinks.csv_excel import export_table_csv, write_detail_export
    from trapline.sinks.tables import append_detections
    from trapline.sources.detections_csv import read_detections_csv
    from trapline.sources.images import file_list

    wide = spark.createDataFrame([("/p/a.jpg", "a.jpg", 1, "S", "c", "j", "Sus scrofa", 0.123456, "哺乳類", 0)],
                                 "image_path string, image_name string, detection_count long, species_1 string, "
                                 "common_name_1 string, japanese_name_1 string, scientific_name_1 string, "
                                 "confidence_1 double, category_label_1 string, more_count int")
    for i in (2, 3):
        for f, t in (("species", "string"), ("common_name", "string"), ("japanese_name", "string"),
                     ("scientific_name", "string"), ("confidence", "double"), ("category_label", "string")):
            wide = wide.withColumn(f"{f}_{i}", F.lit(None).cast(t))
    wide = wide.withColumn("remark", detail_remark(F.col("detection_count")))
    out = str(tmp_path / "detail")
    write_detail_export(wide, out)
    back = spark.read.option("header", True).csv(out)
    assert [c.lstrip("\ufeff") for c in back.columns] == list(DETAIL_HEADER)
    row = back.first()
    assert row["信頼度_1"] == "0.1235" and row["備考"] is None and row["種名_1"] == "S"

    paths = file_list(spark, ["/z.jpg", "/a.jpg"]).collect()
    assert [(r.path, r.seen_order) for r in paths] == [("/z.jpg", 0), ("/a.jpg", 1)]

    table = str(tmp_path / "table")
    rows = spark.createDataFrame([("/a.jpg", "a.jpg", "2024-01-01", "S", "S", 0.5, "bird", "", "", 0)],
                                 "image_path string, image_name string, image_date string, species string, "
                                 "scientific_name string, confidence double, category string, common_name string, "
                                 "japanese_name string, seen_order long").withColumn("timestamp", F.current_timestamp())
    append_detections(rows, table)
    export_table_csv(spark, table, str(tmp_path / "export"))
    got = read_detections_csv(spark, str(tmp_path / "export")).first()
    assert (got.image_path, got.species, got.confidence) == ("/a.jpg", "S", "0.5")


def test_fixed_point_text_matches_python(spark):
    from trapline.sinks.csv_excel import fmt

    values = [0.25, 0.15, 0.35, 2.5, 66.66666666666667, 0.12345, 1e-05, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [(r.a, r.b) for r in df.select(fmt("v", 1).alias("a"), fmt("v", 4).alias("b")).collect()]
    want = [(None, None) if v is None else (f"{v:.1f}", f"{v:.4f}") for v in values]
    assert got == want
