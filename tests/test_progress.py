"""Progress rows kept by a query listener."""
import os

from pyspark.sql import functions as F

from trapline.operators.scoring import ScoringOptions, fixed_factory
from trapline.streaming.ingest import IngestControl, ingest_images, ingest_stream
from trapline.streaming.progress import latest_progress, read_progress, recorded
from tests.test_runs import CROW, make_images


def test_image_stream_rows_equal_batches(spark, seed_names, tmp_path):
    root, table, ckpt, path = (str(tmp_path / n) for n in ("imgs", "table", "ckpt", "progress"))
    make_images(root, [f"{i}.jpg" for i in range(7)])
    opts, seen, control = ScoringOptions(chunk_size=3), [], IngestControl()

    def on_progress(info):
        seen.append((info["batch_id"], info["images"]))
        if len(seen) == 2:
            control.request_stop()

    stopped = ingest_images(spark, root, fixed_factory(CROW), seed_names, table, ckpt, opts, control=control, on_progress=on_progress,
                            progress_path=path)
    assert stopped["reason"] == "stop"
    first = read_progress(spark, path).orderBy("batch_id").collect()
    assert [(r.batch_id, r.batch_rows) for r in first] == seen and [r.rows_done for r in first] == [3, 6]
    assert {r.total_rows for r in first} == {7} and 80 < first[-1].percent < 90 and first[-1].eta_seconds > 0
    make_images(root, ["new.jpg"])
    again = []
    ingest_images(spark, root, fixed_factory(CROW), seed_names, table, ckpt, opts, progress_path=path,
                  on_progress=lambda info: again.append((info["batch_id"], info["images"])))
    runs = {r.run_id: r for r in latest_progress(spark, path).collect()}
    assert len(runs) == 2
    (second,) = [r for k, r in runs.items() if k != first[0].run_id]
    assert (second.total_rows, second.rows_done, second.percent, second.eta_seconds) == (2, 2, 100.0, 0.0)
    got = read_progress(spark, path).where(F.col("run_id") == second.run_id).orderBy("batch_id")
    assert [(r.batch_id, r.batch_rows) for r in got.collect()] == again
    assert spark.read.parquet(table).count() == 8


def test_source_rows_are_counted_once(spark, tmp_path):
    """The batch is read for the breaker, by the shape (twice) and by the write; its rows count once."""
    src = str(tmp_path / "src")
    for i in range(3):
        spark.range(i * 10, i * 10 + 4 + i).select(F.col("id").cast("string").alias("image_path"), F.lit(None).cast("string").alias("error")) \
            .coalesce(1).write.parquet(f"{src}/p{i}")
    shape = lambda b: b.select("image_path").union(b.select("image_path")).distinct()
    ingest_stream(spark, f"{src}/*", "image_path string, error string", shape, str(tmp_path / "t"), str(tmp_path / "c"),
                  progress_path=str(tmp_path / "p"), total_rows=15)
    rows = read_progress(spark, str(tmp_path / "p")).orderBy("batch_id").collect()
    assert sorted(r.batch_rows for r in rows) == [4, 5, 6] and rows[-1].rows_done == 15 and rows[-1].percent == 100.0


def test_a_failing_progress_table_does_not_end_the_job(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(3).select(F.col("id").cast("string").alias("image_path")).coalesce(1).write.parquet(src)
    (tmp_path / "file").write_text("x")
    out = ingest_stream(spark, src, "image_path string", lambda b: b, str(tmp_path / "t"), str(tmp_path / "c"),
                        progress_path=str(tmp_path / "file" / "below"))
    assert out["batches"] == 1 and spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_a_block_without_a_query_ends(spark, tmp_path):
    with recorded(spark, str(tmp_path / "none")) as listener:
        pass
    assert not listener.batches and not os.path.exists(tmp_path / "none")
