"""The breaker over all tasks of a detection job."""
import os
import time

from trapline.operators.breaker import SharedBreaker
from trapline.operators.scoring import BREAKER, ScoringOptions, score_images
from trapline.plans.detect import detect_images, run_detection

CROW = "u;aves;passeriformes;corvidae;corvus;macrorhynchos;large-billed crow"


def counting(marks, fails, wait=0.05):
    """A scorer that leaves a mark a call and fails where ``fails(path)``."""
    import pandas as pd

    def factory(options):
        def score(pdf):
            path = pdf["image_path"].iloc[0]
            open(os.path.join(marks, path.strip("/").replace("/", "_")), "w").close()
            time.sleep(wait)
            if fails(path):
                raise RuntimeError("no model")
            return pd.DataFrame({"image_path": pdf["image_path"], "prediction": CROW, "prediction_score": 0.9})
        return score
    return factory


def test_failures_in_different_tasks_stop_the_job(spark, tmp_path):
    images = spark.createDataFrame([(f"/a/{i:03d}.jpg",) for i in range(160)], "image_path string").repartition(8)
    options = ScoringOptions(chunk_size=1, consecutive_error_limit=5)
    shared = SharedBreaker(str(tmp_path / "log"), 5)
    got = score_images(images, counting(str(tmp_path), lambda p: True), options, breaker=shared).collect()
    assert len(got) == 160 and all(r.error for r in got)
    asked = len([f for f in os.listdir(tmp_path) if f.endswith(".jpg")])
    # four tasks run at once: each can have one chunk under way when the fifth failure ends
    assert asked <= 5 + 4 and shared.tripped()
    assert sum(r.error.startswith(BREAKER) for r in got) == 160 - asked
    assert shared.log(spark).count() >= 5


def test_a_success_in_any_task_starts_the_count_again(spark, tmp_path):
    images = spark.createDataFrame([(f"/a/{i:03d}.jpg",) for i in range(60)], "image_path string").coalesce(1)
    options = ScoringOptions(chunk_size=1, consecutive_error_limit=3)
    shared = SharedBreaker(str(tmp_path / "log"), 3)
    fails = lambda p: int(p[3:6]) % 3 != 0  # noqa: E731 - two in a row, then a success
    got = score_images(images, counting(str(tmp_path), fails, 0), options, breaker=shared).collect()
    assert not shared.tripped() and sum(r.error is None for r in got) == 20
    assert shared.log(spark).count() <= 4  # old outcomes are deleted


def test_nothing_scored_is_lost(spark, seed_names, tmp_path):
    """What was scored before the trip is in the table; the next run takes up the rest."""
    marks, table = tmp_path / "marks", str(tmp_path / "table")
    marks.mkdir()
    listing = spark.createDataFrame([(f"/a/{i:03d}.jpg", None) for i in range(40)], "path string, modificationTime timestamp").coalesce(1)
    options = ScoringOptions(chunk_size=2, consecutive_error_limit=3)
    run = detect_images(listing, counting(str(marks), lambda p: int(p[3:6]) >= 10, 0), seed_names, options, read_exif=False)
    summary = run_detection(run, table, 40)
    assert summary["stopped"] and summary["total_processed"] == 10 and run.failures.tripped()
    done = spark.read.parquet(table)
    assert sorted(r.image_path for r in done.collect()) == [f"/a/{i:03d}.jpg" for i in range(10)]
    again = detect_images(listing, counting(str(marks), lambda p: False, 0), seed_names, options, done=done, read_exif=False)
    assert run_detection(again, table, 40)["total_processed"] == 30
    assert spark.read.parquet(table).select("image_path").distinct().count() == 40


def test_log_through_a_store_with_a_scheme(tmp_path):
    shared = SharedBreaker(f"file://{tmp_path}/log", 2)
    assert not shared.failed("one")
    shared.succeeded(3)
    assert not shared.failed("two") and shared.failed("three") and SharedBreaker(f"file:{tmp_path}/log").tripped()
