"""Job-level flows over a stored table: pivot (§3.2), summary, routing with real files (§3.3)."""
import glob
import json
import os

from trapline.plans import jobs
from trapline.sinks.csv_excel import join_report

HEADER = "image_path,image_name,image_date,species,scientific_name,confidence,category,common_name,japanese_name,timestamp\n"


def write_table_csv(path, rows):
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write(HEADER)
        for r in rows:
            f.write(",".join(r) + "\n")


def test_pivot_and_summary_jobs(spark, tmp_path):
    src = tmp_path / "imgs"
    src.mkdir()
    for n in ("a.jpg", "b.jpg", "c.jpg"):
        (src / n).write_bytes(b"x")
    os.utime(src / "c.jpg", (1700000000, 1700000000))  # 2023-11-14 (UTC)
    table = str(tmp_path / "det.csv")
    write_table_csv(table, [
        (str(src / "a.jpg"), "a.jpg", "2024-11-21", "Corvus corone", "Corvus corone", "0.9", "bird", "", "", "t"),
        (str(src / "b.jpg"), "b.jpg", "2024-11-21", "", "", "0", "", "", "", "t"),
        (str(src / "c.jpg"), "c.jpg", "", "Corvus corone", "Corvus corone", "0.8", "bird", "", "", "t"),
    ])
    pivot = jobs.pivot_report(spark, table, str(tmp_path / "pivot"), image_root=str(src))
    rows = {r.label: r for r in pivot.collect()}
    assert rows["ハシボソガラス"]["2024-11-21"] == 1 and rows["ハシボソガラス"]["2023-11-14"] == 1
    assert rows["撮影無し"]["2024-11-21"] == 1
    rep = {(r.section, r.item): (r.n, r.pct) for r in jobs.summary_report_job(spark, table, str(tmp_path / "s")).collect()}
    assert rep[("基本統計", "総画像数")][0] == 3 and rep[("検出種別統計", "Corvus corone")] == (2, 100.0)


def test_route_images_copy_with_collisions(spark, tmp_path):
    src = tmp_path / "imgs"
    (src / "cam1").mkdir(parents=True)
    (src / "cam2").mkdir(parents=True)
    for d in ("cam1", "cam2"):
        (src / d / "IMG_1.JPG").write_bytes(d.encode())
    out = tmp_path / "sorted"
    (out / "crow_Corvus corone").mkdir(parents=True)
    (out / "crow_Corvus corone" / "IMG_1.JPG").write_bytes(b"old")
    table = str(tmp_path / "det.csv")
    write_table_csv(table, [
        (str(src / "cam1" / "IMG_1.JPG"), "IMG_1.JPG", "", "Corvus corone", "", "0.9", "bird", "crow", "", "t"),
        (str(src / "cam2" / "IMG_1.JPG"), "IMG_1.JPG", "", "Corvus corone", "", "0.9", "bird", "crow", "", "t"),
        (str(src / "cam2" / "missing.JPG"), "missing.JPG", "", "", "", "0", "", "", "", "t"),
    ])
    stats = jobs.route_images(spark, table, str(src), str(out), manifest_path=str(tmp_path / "manifest"))
    assert stats["total_files"] == 2 and stats["failed_files"] == 0
    names = sorted(os.listdir(out / "crow_Corvus corone"))
    assert names == ["IMG_1.JPG", "IMG_1_001.JPG", "IMG_1_002.JPG"]
    assert (out / "crow_Corvus corone" / "IMG_1.JPG").read_bytes() == b"old"  # never overwritten
    folders = [json.loads(l) for f in glob.glob(str(tmp_path / "manifest" / "folders" / "part-*")) for l in open(f)]
    assert folders == [{"folder_key": "crow_Corvus corone", "file_count": 2}]


def test_route_by_date_reads_missing_dates_from_files(spark, tmp_path):
    from tests.test_files import jpeg, tiff_block

    src = tmp_path / "imgs"
    src.mkdir()
    (src / "a.jpg").write_bytes(jpeg(tiff_block("II", {306: "2022:03:14 09:26:53"}, {})))
    (src / "b.jpg").write_bytes(b"plain")
    os.utime(src / "b.jpg", (1700000000, 1700000000))
    table = str(tmp_path / "det.csv")
    write_table_csv(table, [
        (str(src / "a.jpg"), "a.jpg", "", "Corvus corone", "", "0.9", "bird", "crow", "", "t"),
        (str(src / "b.jpg"), "b.jpg", "", "", "", "0", "", "", "", "t"),
    ])
    out = tmp_path / "sorted"
    stats = jobs.route_images(spark, table, str(src), str(out), by_date=True)
    assert stats["total_files"] == 2
    assert (out / "2022-03-14" / "crow_Corvus corone" / "a.jpg").exists()
    assert (out / "2023-11-14" / "未検出_No_Detection" / "b.jpg").exists()


def test_command_line_detect_and_summary(spark, tmp_path):
    from trapline.__main__ import main

    src = tmp_path / "imgs"
    src.mkdir()
    for n in ("a.jpg", "b.jpg"):
        (src / n).write_bytes(b"x")
    table = str(tmp_path / "table")
    main(["detect", str(src), table, "--scorer", "tests.test_jobs:crow_factory", "--runs", str(tmp_path / "runs")])
    main(["detect", str(src), table, "--scorer", "tests.test_jobs:crow_factory", "--resume"])
    assert spark.read.parquet(table).count() == 2  # the second run skipped both images
    main(["summary", table, str(tmp_path / "summary")])
    assert glob.glob(str(tmp_path / "summary" / "part-*"))


def crow_factory(options):
    from trapline.operators.scoring import fixed_factory

    return fixed_factory("u;aves;o;f;corvus;corone;carrion crow")(options)


def test_command_line_pivot_and_route(spark, tmp_path):
    from trapline.__main__ import main

    src = tmp_path / "imgs"
    src.mkdir()
    (src / "a.jpg").write_bytes(b"x")
    table = str(tmp_path / "det.csv")
    write_table_csv(table, [(str(src / "a.jpg"), "a.jpg", "2024-11-21", "Corvus corone", "Corvus corone", "0.9",
                             "bird", "", "", "t")])
    main(["pivot", table, str(tmp_path / "pivot")])
    join_report(str(tmp_path / "pivot"), str(tmp_path / "pivot.csv"))
    lines = open(tmp_path / "pivot.csv", encoding="utf-8-sig").read().splitlines()
    assert lines[0] == "日付,2024-11-21" and "ハシボソガラス,1" in lines
    main(["route", table, str(src), str(tmp_path / "out"), "--by-date"])
    assert (tmp_path / "out" / "2024-11-21" / "ハシボソガラス_Corvus corone" / "a.jpg").exists()
