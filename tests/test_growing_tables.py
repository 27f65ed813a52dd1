"""Tables that grow: bucketed archive (J2), numbered table (W1, L5, A12), live counts."""
import re

import pytest
from pyspark.sql import functions as F

from trapline.operators.incremental import pending_images
from trapline.operators.scoring import ScoringOptions, fixed_factory
from trapline.plans.detect import detect_images, run_detection
from trapline.plans.jobs import load_table
from trapline.sinks import sequenced
from trapline.sinks.archive import Archive
from trapline.sinks.tables import table_rows
from trapline.streaming.live_counts import count_stream, read_counts, with_totals

CROW = "u;aves;passeriformes;corvidae;corvus;macrorhynchos;large-billed crow"


def paths(spark, values):
    return spark.createDataFrame([(v,) for v in values], "image_path string")


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


# ---- archive

def test_resume_leaves_the_archive_in_place(spark, tmp_path):
    archive = Archive.create(spark, str(tmp_path / "t"), paths(spark, []).schema, 6)
    archive.append(paths(spark, [f"/a/{i}.jpg" for i in range(300)]))
    archive.append(paths(spark, [" /a/300.jpg\t", "", None, "/a/1.jpg"]))
    listing = paths(spark, [f"/a/{i}.jpg" for i in range(295, 310)] + ["/a/305.jpg", "/a/1.jpg", ""])
    pending = archive.pending(listing)
    want = sorted([f"/a/{i}.jpg" for i in range(301, 310)] + ["/a/305.jpg", ""])
    assert sorted(r.image_path for r in pending.collect()) == want
    plan = plan_of(pending)
    # one exchange, that of the listing; the table's scan is bucketed and is joined by merging
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "BroadcastExchange" not in plan
    assert "SortMergeJoin" in plan and "SelectedBucketsCount: 6 out of 6" in plan
    table_side = plan[plan.index("SelectedBucketsCount") - 2000:]
    assert "Exchange" not in table_side[table_side.rindex("Filter", 0, table_side.index("SelectedBucketsCount")):]


def test_another_session_opens_the_archive(spark, tmp_path):
    path = str(tmp_path / "t")
    assert Archive.open(spark, path) is None
    Archive.create(spark, path, paths(spark, []).withColumn("n", F.lit(1)).schema, 4).append(paths(spark, ["/a", "/b"]).withColumn("n", F.lit(1)))
    spark.sql(f"DROP TABLE {Archive.open(spark, path).name}")  # as in a session that never saw it; the files stay
    again = Archive.open(spark, path)
    again.append(paths(spark, ["/c"]))
    assert sorted((r.image_path, r.n) for r in again.rows().collect()) == [("/a", 1), ("/b", 1), ("/c", None)]
    assert [r.image_path for r in pending_images(paths(spark, ["/b", "/c", "/d"]), again).collect()] == ["/d"]


def test_detection_job_over_an_archive(spark, seed_names, tmp_path):
    def listing(n):
        return spark.createDataFrame([(f"/x/{i}.jpg", None) for i in range(n)], "path string, modificationTime timestamp")

    run = detect_images(listing(5), fixed_factory(CROW), seed_names, ScoringOptions(), read_exif=False)
    archive = Archive.create(spark, str(tmp_path / "t"), table_rows(run.rows).schema, 3)
    assert run_detection(run, archive, 5)["total_processed"] == 5
    run = detect_images(listing(9), fixed_factory(CROW), seed_names, done=archive, read_exif=False)
    assert run_detection(run, archive, 9) | {"table_path": None} == {
        "total_processed": 4, "successful": 4, "stopped": False, "csv_path": None, "table_path": None, "failed": 0, "skipped": 5}
    assert archive.rows().count() == 9


# ---- numbered table

def detections(spark, n, start=0):
    return spark.createDataFrame([(f"/a/{i:05d}.jpg", f"{i:05d}.jpg", ["", "Crow", "Deer", "Fox"][i % 4], float(i)) for i in range(start, start + n)],
                                 "image_path string, image_name string, species string, confidence double")


def test_pages_read_only_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    for k, n in enumerate((250, 1, 333)):
        assert sequenced.append_batch(detections(spark, n, 1000 * k).orderBy(F.rand(3)).repartition(5), path, ["image_path"], 40) == k
    want = [f"/a/{1000 * k + i:05d}.jpg" for k, n in enumerate((250, 1, 333)) for i in range(n)]
    everything = sequenced.read_sequenced(spark, path)
    assert {r.seen_order: r.image_path for r in everything.collect()} == dict(enumerate(want, 1))
    files = len(everything.inputFiles())
    for page in (0, 3, 11):
        got = sequenced.read_page(spark, path, page, 50)
        assert [r.image_path for r in got.collect()] == want[50 * page:50 * page + 50]
        assert len(got.inputFiles()) <= 4 < files
    assert sequenced.read_page(spark, path, 12, 50).count() == 0
    table = load_table(spark, path)
    assert not re.search(r"\bSort\b|Exchange", plan_of(table)) and table.count() == len(want)
    meta = sequenced.table_metadata(spark, path, 50).first()
    assert (meta.total_rows, meta.detected_rows, meta.batches, meta.page_count, meta.distinct_species) == (584, sum(int(p[3:8]) % 4 > 0 for p in want), 3, 12, 3)
    assert meta.species_estimate == 3


def test_a_batch_without_its_index_is_written_again(spark, tmp_path):
    path = str(tmp_path / "t")
    sequenced.append_batch(detections(spark, 10), path, ["image_path"])
    detections(spark, 7, 50).withColumn("seen_order", F.lit(99).cast("long")).write.parquet(f"{path}/batch=1")  # a run that died
    assert sequenced.read_sequenced(spark, path).count() == 10
    assert sequenced.append_batch(detections(spark, 3, 50), path, ["image_path"]) == 1
    assert [r.seen_order for r in sequenced.read_sequenced(spark, path).orderBy("seen_order").collect()] == list(range(1, 14))


def test_empty_batches_and_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sequenced.table_metadata(spark, path).first().total_rows == 0
    with pytest.raises(FileNotFoundError):
        sequenced.read_sequenced(spark, path)
    sequenced.append_batch(detections(spark, 0), path, ["image_path"])
    sequenced.append_batch(detections(spark, 2), path, ["image_path"])
    assert sequenced.table_metadata(spark, path).first().page_count == 1
    assert [r.image_name for r in sequenced.read_page(spark, path, 0).collect()] == ["00000.jpg", "00001.jpg"]


def test_species_sketch_over_many_labels(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(2):
        rows = detections(spark, 6000, 3000 * k).withColumn("species", F.concat(F.lit("sp"), F.substring("image_name", 1, 5)))
        sequenced.append_batch(rows, path, ["image_path"])
    meta = sequenced.table_metadata(spark, path).first()
    assert meta.distinct_species == 9000 and abs(meta.species_estimate - 9000) <= 450


# ---- live counts

def test_counts_after_triggers_and_a_restart(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("rows", "counts", "ckpt"))
    rows = spark.createDataFrame([(i, f"2024-01-{i % 5 + 1:02d}", ["crow", "deer", "none"][i % 3]) for i in range(900)], "i int, image_date string, label string")
    keys = ["image_date", "label"]

    def feed(part, files):
        part.repartition(files).write.mode("append").parquet(source)
        return count_stream(spark, source, rows.schema, lambda t: t, keys, target, checkpoint, max_files_per_trigger=1, compact_every=2)

    assert feed(rows.where("i < 600"), 3) == 3
    want = lambda df: sorted((r.image_date, r.label, r["n"]) for r in df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect())
    got = lambda: sorted((r.image_date, r.label, r.n) for r in read_counts(spark, target, keys).collect())
    assert got() == want(rows.where("i < 600"))
    assert feed(rows.where("i >= 600 AND label = 'crow'"), 2) == 2  # a restart: old counts go on, unchanged groups stay
    now = rows.where("i < 600 OR label = 'crow'")
    assert got() == want(now)
    # a replay of the last batch overwrites its folder
    last = spark.read.parquet(f"{target}/changes").where("batch_id = 4").select(*keys, "n").collect()
    spark.createDataFrame(last).write.mode("overwrite").parquet(f"{target}/changes/batch_id=4")
    assert got() == want(now)
    totals = with_totals(read_counts(spark, target, keys), keys)
    assert totals.where("grouping_id = 1").agg(F.sum("n")).first()[0] == now.count() == totals.where("grouping_id = 2").agg(F.sum("n")).first()[0]
    changed = {r.batch_id: r["count"] for r in spark.read.parquet(f"{target}/changes").groupBy("batch_id").count().collect()}
    assert changed[4] <= 5  # only the groups that changed are emitted
