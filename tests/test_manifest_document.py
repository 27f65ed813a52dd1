"""The manifest as one JSON document, whatever the ranges (K7)."""
import json

import pytest

from trapline.operators.routing import dedup_destinations
from trapline.sinks.manifest_document import join_pieces, write_manifest_document


def document(path, out):
    join_pieces(path, out)
    with open(out, encoding="utf-8") as f:
        return json.load(f)


@pytest.mark.parametrize("ranges", [1, 3, 13])
def test_document(spark, tmp_path, ranges):
    """A hot folder cut by ranges, quotes and other scripts in names, a folder of one file."""
    rows = [("ハシブトガラス_Corvus", f"IMG_{i:03d}.jpg", 2 * i) for i in range(200)]
    rows += [('say "hi"\\', "a\tb.jpg", 7), ("one", "x.jpg", 8), ("zwei", "ü.jpg", 9), ("zwei", "a.jpg", 11)]
    routed = spark.createDataFrame(rows, "folder_key string, dest_name string, seen_order long").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        write_manifest_document(routed, str(tmp_path / "m"), created_at="2024-01-01T00:00:00")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = document(str(tmp_path / "m"), str(tmp_path / "m.json"))
    folders = {}
    for key, name, _ in sorted(rows, key=lambda r: r[2]):
        folders.setdefault(key, []).append(name)
    assert got == {"created_at": "2024-01-01T00:00:00", "total_folders": 4, "total_files": 204,
                   "folders": {k: {"file_count": len(v), "files": v} for k, v in folders.items()}}


def test_document_without_files(spark, tmp_path):
    routed = spark.createDataFrame([], "folder_key string, dest_name string, seen_order long")
    write_manifest_document(routed, str(tmp_path / "m"))
    got = document(f"file://{tmp_path}/m", str(tmp_path / "m.json"))
    assert got["folders"] == {} and (got["total_folders"], got["total_files"]) == (0, 0)


def test_numbering_joins_no_rows_on_the_group_alone(spark):
    """A group's facts reach its rows by (group, slice)."""
    plan = spark.createDataFrame([(f"/s/{i}", "/out/a", "x.jpg", i) for i in range(40)] + [(f"/t/{i}", "/out/a", "y.jpg", 40 + i) for i in range(5)],
                                 "image_path string, target_dir string, image_name string, seen_order long")
    existing = spark.createDataFrame([("/out/a", "x.jpg"), ("/out/a", "x_003.jpg"), ("/out/a", "y_001.jpg")], "target_dir string, file_name string")
    got = dedup_destinations(plan, existing, bucket_rows=8)
    names = {r.image_path: r.dest_name for r in got.collect()}
    free = [n for n in range(1, 60) if n != 3]
    assert [names[f"/s/{i}"] for i in range(40)] == [f"x_{free[i]:03d}.jpg" for i in range(40)]
    assert [names[f"/t/{i}"] for i in range(5)] == ["y.jpg", "y_002.jpg", "y_003.jpg", "y_004.jpg", "y_005.jpg"]
    lazy = dedup_destinations(plan, existing, bucket_rows=8, materialize_input=False)
    text = lazy._jdf.queryExecution().analyzed().toString()
    assert "_slice" in text and {r.image_path: r.dest_name for r in lazy.collect()} == names
