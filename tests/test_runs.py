"""Scoring (U1), resume (J2), run summary (A2) and streaming ingestion."""
import os

from pyspark.sql import functions as F

from trapline.operators.incremental import run_summary
from trapline.operators.scoring import ScoringOptions, fixed_factory, score_images
from trapline.plans.detect import detect_images
from trapline.sinks.tables import append_detections, read_table
from trapline.sources.images import list_images
from trapline.streaming.ingest import IngestControl, ingest_stream

CROW = "u;aves;passeriformes;corvidae;corvus;macrorhynchos;large-billed crow"


def make_images(root, names):
    os.makedirs(root, exist_ok=True)
    for n in names:
        with open(os.path.join(root, n), "wb") as f:
            f.write(b"img")


def test_options_ignore_unknown_keys():
    o = ScoringOptions.from_dict({"confidence_threshold": 0.3, "theme": "dark"})
    assert o.confidence_threshold == 0.3 and o.chunk_size == 500


def test_scorer_errors_become_rows(spark):
    imgs = spark.createDataFrame([("/a.jpg",), ("/b.jpg",)], "image_path string")
    ok = score_images(imgs, fixed_factory(CROW)).collect()
    assert {r.image_path for r in ok} == {"/a.jpg", "/b.jpg"} and all(r.error is None for r in ok)
    # a failure fails the whole batch (both images in one partition here)
    bad = score_images(imgs.coalesce(1), fixed_factory(CROW, fail_paths=frozenset({"/a.jpg"}))).collect()
    assert all(r.error and r.prediction is None for r in bad)
    # with one image per chunk only the failing image is affected
    one = score_images(imgs.coalesce(1), fixed_factory(CROW, fail_paths=frozenset({"/a.jpg"})),
                       ScoringOptions(chunk_size=1)).collect()
    assert {r.image_path: r.error is not None for r in one} == {"/a.jpg": True, "/b.jpg": False}


def test_detect_resume_and_summary(spark, seed_names, tmp_path):
    root = str(tmp_path / "imgs")
    make_images(root, [f"{i}.jpg" for i in range(5)])
    listing = list_images(spark, root)
    table = str(tmp_path / "table")
    # a first run processed three images
    first = detect_images(listing.filter(F.col("path").rlike(r"/[012]\.jpg$")), fixed_factory(CROW), seed_names)
    append_detections(first.rows, table)
    done = read_table(spark, table)
    run = detect_images(listing, fixed_factory("blank"), seed_names, done=done)
    rows = run.rows.cache()
    assert rows.count() == 2
    summary = run_summary(listing.select(F.col("path").alias("image_path")), run.pending, rows).first()
    # a "blank" prediction is a detection for the run summary (Q3) but an empty species in the table
    assert (summary.total_images, summary.skipped, summary.total_processed, summary.successful) == (5, 3, 2, 2)
    assert {r.species for r in rows.collect()} == {""}
    append_detections(rows, table)
    assert read_table(spark, table).count() == 5
    crow = read_table(spark, table).filter(F.col("species") != "").first()
    assert crow.species == "Corvus macrorhynchos (large-billed crow / ハシブトガラス)"


def test_failed_chunk_images_are_not_marked_done(spark, seed_names, tmp_path):
    root = str(tmp_path / "imgs")
    make_images(root, ["a.jpg", "b.jpg"])
    listing = list_images(spark, root)
    fail = frozenset(r.path for r in listing.collect())
    run = detect_images(listing, fixed_factory(CROW, fail_paths=fail), seed_names)
    assert run.rows.count() == 0


def test_stream_resume_replay_and_breaker(spark, tmp_path):
    src = str(tmp_path / "src")
    table, ckpt = str(tmp_path / "table"), str(tmp_path / "ckpt")
    schema = "image_path string, error string"

    def drop(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{src}/{name}")

    def shape(batch):
        return batch.filter(F.col("error").isNull()).select("image_path")

    drop("p1", [("/a", None), ("/b", None)])
    r1 = ingest_stream(spark, f"{src}/*", schema, shape, table, ckpt)
    drop("p2", [("/c", None)])
    r2 = ingest_stream(spark, f"{src}/*", schema, shape, table, ckpt)
    assert r1["batches"] == 1 and r2["batches"] == 1  # the second run saw only the new file
    assert sorted(r.image_path for r in read_table(spark, table).collect()) == ["/a", "/b", "/c"]
    for i in range(3):
        drop(f"f{i}", [(f"/x{i}", "model failure")])
    r3 = ingest_stream(spark, f"{src}/*", schema, shape, table, ckpt, control=IngestControl(limit=2))
    assert r3["stopped"] and r3["reason"] == "breaker"


def test_stop_after_current_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    for i in range(3):
        spark.createDataFrame([(f"/s{i}", None)], "image_path string, error string").coalesce(1).write.parquet(
            f"{src}/p{i}")
    control = IngestControl()
    seen = []

    def progress(info):
        seen.append(info["batch_id"])
        control.request_stop()  # ask to stop once the first batch is written

    out = ingest_stream(spark, f"{src}/*", "image_path string, error string", lambda b: b.select("image_path"),
                        str(tmp_path / "t"), str(tmp_path / "c"), control=control, on_progress=progress)
    assert out["stopped"] and out["reason"] == "stop" and seen == [0]
    assert read_table(spark, str(tmp_path / "t")).count() == 1


def test_run_detection_observed_summary(spark, seed_names, tmp_path):
    from trapline.plans.detect import first_images, progress_metrics, run_detection

    root = str(tmp_path / "imgs")
    make_images(root, [f"{i}.jpg" for i in range(4)])
    listing = list_images(spark, root)
    assert [os.path.basename(r.path) for r in first_images(listing, 2).collect()] == ["0.jpg", "1.jpg"]
    table = str(tmp_path / "table")
    done = spark.createDataFrame([(os.path.join(root, "0.jpg"),)], "image_path string")
    run = detect_images(listing, fixed_factory(CROW), seed_names, done=done)
    s = run_detection(run, table, total_images=4)
    assert (s["total_processed"], s["successful"], s["failed"], s["skipped"]) == (3, 3, 0, 1)
    from trapline.sinks.tables import record_run

    record_run(spark, s, str(tmp_path / "runs"), run_id="r1")
    r = spark.read.parquet(str(tmp_path / "runs")).first()
    assert (r.run_id, r.total_processed, r.skipped, r.stopped) == ("r1", 3, 1, False)
    m = progress_metrics(3, 4, 1.5)
    assert m["rate"] == 2.0 and m["percent"] == 75.0 and m["eta_seconds"] == 0.5
    assert progress_metrics(0, 0, 0)["eta_seconds"] == 0.0


def test_ingest_images_stream_resume(spark, seed_names, tmp_path):
    from trapline.streaming.ingest import ingest_images

    root = str(tmp_path / "imgs")
    make_images(root, ["a.jpg", "b.JPG", "notes.txt"])
    table, ckpt = str(tmp_path / "table"), str(tmp_path / "ckpt")
    opts = ScoringOptions(chunk_size=1)
    r1 = ingest_images(spark, root, fixed_factory(CROW), seed_names, table, ckpt, opts)
    assert (r1["batches"], r1["images"], r1["stopped"]) == (2, 2, False)
    make_images(root, ["c.jpeg"])
    r2 = ingest_images(spark, root, fixed_factory(CROW), seed_names, table, ckpt, opts)
    assert (r2["batches"], r2["images"]) == (1, 1)  # only the new file
    t = read_table(spark, table)
    assert t.count() == 3
    assert {r.species for r in t.collect()} == {"Corvus macrorhynchos (large-billed crow / ハシブトガラス)"}
    make_images(root, ["d.jpg", "e.jpg", "f.jpg"])
    fail = frozenset(os.path.join(root, n) for n in ("d.jpg", "e.jpg", "f.jpg"))
    r3 = ingest_images(spark, root, fixed_factory(CROW, fail_paths=fail), seed_names, table, ckpt, opts,
                       control=IngestControl(limit=2))
    assert r3["stopped"] and r3["reason"] == "breaker"
    assert read_table(spark, table).count() == 3  # failed chunks are not written
    # a good model later: the failed images and those after the stop are taken up again, none is missing or twice
    r4 = ingest_images(spark, root, fixed_factory(CROW), seed_names, table, ckpt, opts)
    assert not r4["stopped"]
    r5 = ingest_images(spark, root, fixed_factory(CROW), seed_names, table, ckpt, opts)
    assert r5["batches"] == 0
    assert sorted(os.path.basename(r.image_path) for r in read_table(spark, table).collect()) == [
        "a.jpg", "b.JPG", "c.jpeg", "d.jpg", "e.jpg", "f.jpg"]


def test_stream_and_batch_store_equal_dates(spark, seed_names, tmp_path):
    from tests.test_files import jpeg, tiff_block
    from trapline.streaming.ingest import ingest_images

    root = tmp_path / "imgs"
    (root / "_raw").mkdir(parents=True)
    (root / "_raw" / "_DSC0001.JPG").write_bytes(jpeg(tiff_block("MM", {}, {36867: "2020:05:06 07:08:09"})))
    (root / "b.jpg").write_bytes(b"plain")
    os.utime(root / "b.jpg", (1700000000, 1700000000))
    ingest_images(spark, str(root), fixed_factory(CROW), seed_names, str(tmp_path / "t"), str(tmp_path / "c"))
    dates = lambda df: {os.path.basename(r.image_path): r.image_date for r in df.collect()}
    batch = detect_images(list_images(spark, str(root)), fixed_factory(CROW), seed_names)
    assert dates(read_table(spark, str(tmp_path / "t"))) == dates(batch.rows) == {"_DSC0001.JPG": "2020-05-06", "b.jpg": "2023-11-14"}


def test_scorer_contract(spark, seed_names):
    """Structured-only, empty, text, NaN and boxed predictions, and paths that need tidying."""
    import pandas as pd

    from trapline.plans.detect import image_rows

    def factory(options):
        def run(pdf):
            rows = []
            for p in pdf["image_path"]:
                n = os.path.basename(p)
                base = {"image_path": "/p/../p/./" + n, "prediction_score": 0.9}
                if n == "s.jpg":
                    rows.append({**base, "class": "mammalia", "genus": "sus", "species": "scrofa", "common_name": "wild boar"})
                elif n == "t.jpg":
                    rows.append({**base, "prediction": CROW, "prediction_score": "oops"})
                elif n == "n.jpg":
                    rows.append({**base, "prediction": CROW, "prediction_score": float("nan")})
                elif n == "x.jpg":
                    rows.append({**base, "prediction": CROW, "detections": [{"conf": 0.2, "bbox": [1.0]}, {"conf": 0.8, "bbox": [2.0, 3.0]}]})
                else:
                    rows.append(base)
            return pd.DataFrame(rows)
        return run

    imgs = spark.createDataFrame([(f"/p/{n}.jpg", ) for n in "stnxe"], "image_path string")
    got = {r.image_path: r for r in image_rows(imgs, score_images(imgs, factory), seed_names, 0.0).collect()}
    assert got["/p/s.jpg"].scientific_name == "Sus scrofa" and got["/p/s.jpg"].n_detections == 1
    assert got["/p/t.jpg"].n_detections == 0  # malformed, not zero
    assert got["/p/n.jpg"].n_detections == 1
    assert got["/p/x.jpg"].bbox == [2.0, 3.0]
    assert got["/p/e.jpg"].n_detections == 1 and got["/p/e.jpg"].species == ""


def test_batch_breaker_and_resume(spark, seed_names, tmp_path):
    from trapline.plans.detect import run_detection

    root, table = str(tmp_path / "imgs"), str(tmp_path / "t")
    make_images(root, [f"{i}.jpg" for i in range(6)])
    listing = list_images(spark, root).coalesce(1)
    fail = frozenset(r.path for r in listing.collect())
    opts = ScoringOptions(chunk_size=1, consecutive_error_limit=3)
    s = run_detection(detect_images(listing, fixed_factory(CROW, fail_paths=fail), seed_names, opts), table)
    assert s["stopped"] and s["total_processed"] == 0
    s = run_detection(detect_images(listing, fixed_factory(CROW), seed_names, opts, done=read_table(spark, table)), table)
    assert not s["stopped"] and read_table(spark, table).count() == 6


def test_normal_paths(spark):
    from trapline.functions.paths import normal_path

    cases = {"/a/b.jpg": "/a/b.jpg", "file:/a/b": "/a/b", "file:///a//b/./c": "/a/b/c", "/p/../p/a.jpg": "/p/a.jpg", "/../x": "/x",
             "s3a://k/a/../b": "s3a://k/b", "x/y.jpg": os.getcwd() + "/x/y.jpg"}
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", normal_path("p").alias("n"))
    assert {r.p: r.n for r in df.collect()} == cases


def test_detect_stores_exif_capture_date(spark, seed_names, tmp_path):
    from tests.test_files import jpeg, tiff_block

    root = tmp_path / "imgs"
    root.mkdir()
    (root / "a.jpg").write_bytes(jpeg(tiff_block("MM", {306: "2001:01:01 00:00:00"}, {36867: "2020:05:06 07:08:09"})))
    (root / "b.jpg").write_bytes(b"plain")
    os.utime(root / "b.jpg", (1700000000, 1700000000))
    run = detect_images(list_images(spark, str(root)), fixed_factory(CROW), seed_names)
    got = {os.path.basename(r.image_path): r.image_date for r in run.rows.collect()}
    assert got == {"a.jpg": "2020-05-06", "b.jpg": "2023-11-14"}


def test_replayed_batch_is_not_duplicated(spark, tmp_path):
    from trapline.sinks.tables import write_batch

    rows = spark.createDataFrame([("/a.jpg", "a.jpg")], "image_path string, image_name string")
    table = str(tmp_path / "t")
    write_batch(rows, table, 7)
    write_batch(rows, table, 7)  # the same micro-batch replayed after a failure
    write_batch(rows.selectExpr("'/b.jpg' as image_path", "'b.jpg' as image_name"), table, 8)
    assert sorted(r.image_path for r in read_table(spark, table).collect()) == ["/a.jpg", "/b.jpg"]


def test_date_partitioned_table_prunes(spark, tmp_path):
    from trapline.sinks.tables import read_dates

    rows = spark.createDataFrame([(f"/{i}.jpg", f"{i}.jpg", f"2024-01-0{1 + i % 3}") for i in range(9)],
                                 "image_path string, image_name string, image_date string")
    table = str(tmp_path / "t")
    append_detections(rows, table, partition_by="image_date")
    sel = read_dates(spark, table, "2024-01-02", "2024-01-02")
    assert sel.count() == 3
    plan = sel._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "image_date" in plan.split("PartitionFilters")[1][:200]


def counting_factory(marker_dir):
    """Scorer that leaves one marker file per scored image (to count model calls across workers)."""
    def factory(options):
        def run(pdf):
            import uuid as _uuid

            for p in pdf["image_path"]:
                open(os.path.join(marker_dir, f"{os.path.basename(p)}-{_uuid.uuid4().hex}"), "w").close()
            return pd_frame(pdf["image_path"])
        return run
    return factory


def pd_frame(paths):
    import pandas as pd

    return pd.DataFrame({"image_path": paths, "prediction": CROW, "prediction_score": 0.9})


def test_model_runs_once_per_image(spark, seed_names, tmp_path):
    from trapline.plans.detect import run_detection

    root = str(tmp_path / "imgs")
    make_images(root, [f"{i}.jpg" for i in range(6)])
    markers = tmp_path / "markers"
    markers.mkdir()
    run = detect_images(list_images(spark, root), counting_factory(str(markers)), seed_names)
    s = run_detection(run, str(tmp_path / "table"), total_images=6)
    assert s["total_processed"] == 6
    assert len(os.listdir(markers)) == 6  # each image scored exactly once


def test_stream_scores_each_image_once(spark, seed_names, tmp_path):
    from trapline.streaming.ingest import ingest_images

    root = str(tmp_path / "imgs")
    make_images(root, [f"{i}.jpg" for i in range(5)])
    markers = tmp_path / "markers"
    markers.mkdir()
    out = ingest_images(spark, root, counting_factory(str(markers)), seed_names, str(tmp_path / "t"),
                        str(tmp_path / "c"), ScoringOptions(chunk_size=2))
    assert out["images"] == 5 and len(os.listdir(markers)) == 5
