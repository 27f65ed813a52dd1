"""Routing plan (P21-P24, W2, J5, A10, A11), after the reference's file-manager tests."""
import random
import re

from pyspark.sql import functions as F

from trapline.functions.paths import safe_folder_name
from trapline.operators import routing as rt

TABLE = ("image_path string, image_name string, image_date string, species string, scientific_name string, "
         "confidence double, category string, common_name string, japanese_name string, seen_order long")


def folder(spark, species, common="", vern=""):
    df = spark.createDataFrame([(species, common, vern)], "s string, c string, v string")
    return df.select(safe_folder_name("s", "c", "v").alias("f")).first().f


def test_safe_folder_names(spark):
    f = folder(spark, 'Foo<>:"/\\|?*Bar')
    assert not any(ch in f for ch in '<>:"/\\|?*')
    assert len(folder(spark, "A" * 300)) <= 100
    assert folder(spark, "   ") == "Unknown_Species"
    assert folder(spark, "Corvus corone", "crow", "ハシボソガラス") == "ハシボソガラス_Corvus corone"
    assert folder(spark, "Corvus corone", "crow") == "crow_Corvus corone"
    assert folder(spark, "Corvus corone", "Corvus corone") == "Corvus corone"


def plan_for(spark, names, rows, **kw):
    t = spark.createDataFrame(rows, TABLE)
    return rt.routing_plan(t, names, "/out", **kw)


def test_plan_by_date_and_no_detection(spark, seed_names):
    rows = [("/src/a.jpg", "a.jpg", "2024-11-21", "Sus scrofa (boar)", "Sus scrofa", 0.9, "mammal", "boar", "", 0),
            ("/src/b.jpg", "b.jpg", "", "", "", 0.0, "", "", "", 1),
            ("/src/c.jpg", "c.jpg", "2024-11-22", "blank", "", 0.9, "", "", "", 2)]
    out = {r.image_name: (r.folder_key, r.target_dir)
           for r in plan_for(spark, seed_names, rows, by_date=True).collect()}
    assert out["a.jpg"] == ("2024-11-21/イノシシ_Sus scrofa (boar)", "/out/2024-11-21/イノシシ_Sus scrofa (boar)")
    assert out["b.jpg"][0] == "unknown-date/未検出_No_Detection"
    assert out["c.jpg"][0] == "2024-11-22/未検出_No_Detection"


def test_missing_sources_are_skipped(spark, seed_names):
    rows = [("/src/a.jpg", "a.jpg", "", "x", "", 0.9, "", "", "", 0),
            ("/src/gone.jpg", "gone.jpg", "", "x", "", 0.9, "", "", "", 1)]
    listing = spark.createDataFrame([("/src/a.jpg",)], "path string")
    out = plan_for(spark, seed_names, rows, listing=listing).collect()
    assert [r.image_name for r in out] == ["a.jpg"]


def test_long_paths_are_shortened(spark, seed_names):
    import hashlib

    sp = "Very long species name " * 3
    rows = [("/src/a.jpg", "a.jpg", "", sp, "", 0.9, "", "", "", 0)]
    t = spark.createDataFrame(rows, TABLE)
    base = "/b" + "/x" * 115
    r = rt.routing_plan(t, seed_names, base).first()
    want = sp[:40] + "_" + hashlib.sha1(sp.encode("utf-8")).hexdigest()[:8]
    assert r.folder_key == want and r.target_dir == f"{base}/{want}"


def test_collision_numbering_skips_existing(spark):
    plan = spark.createDataFrame([("/s/1/img.jpg", "img.jpg", "/out/F", "F", 0)],
                                 "image_path string, image_name string, target_dir string, folder_key string, "
                                 "seen_order long")
    existing = spark.createDataFrame([("/out/F", n) for n in ("img.jpg", "img_001.jpg", "img_002.jpg")],
                                     "target_dir string, file_name string")
    assert rt.dedup_destinations(plan, existing).first().dest_name == "img_003.jpg"


def sequential(rows, existing):
    """The reference's loop: check the disk, then _001, _002, ... in row order."""
    taken = set(existing)
    out = {}
    for path, name, d, order in sorted(rows, key=lambda r: r[3]):
        stem, ext = (name.rsplit(".", 1)[0], "." + name.rsplit(".", 1)[1]) if "." in name else (name, "")
        cand, n = name, 0
        while (d, cand) in taken:
            n += 1
            cand = f"{stem}_{n:03d}{ext}"
        taken.add((d, cand))
        out[path] = cand
    return out


def test_collision_numbering_matches_sequential_loop(spark):
    rnd = random.Random(7)
    rows = [(f"/s/{i}", rnd.choice(["a.jpg", "b.JPG", "c"]), rnd.choice(["/o/X", "/o/Y"]), i) for i in range(120)]
    existing = [("/o/X", "a.jpg"), ("/o/X", "a_002.jpg"), ("/o/Y", "c_001")]
    plan = spark.createDataFrame([(p, n, d, d[-1], o) for p, n, d, o in rows],
                                 "image_path string, image_name string, target_dir string, folder_key string, "
                                 "seen_order long")
    ex = spark.createDataFrame(existing, "target_dir string, file_name string")
    want = sequential(rows, existing)
    for bucket_rows in (1 << 20, 7):  # one slice per group, and many slices per group
        got = {r.image_path: r.dest_name for r in rt.dedup_destinations(plan, ex, bucket_rows=bucket_rows).collect()}
        assert got == want
        assert len({(d, got[p]) for p, _n, d, _o in rows}) == len(rows)


def test_collision_numbering_skips_runs_of_claims(spark):
    rnd = random.Random(11)
    rows = [(f"/s/{i}", rnd.choice(["a.jpg", "b"]), rnd.choice(["/o/X", "/o/Y", "/o/Z"]), i * 3) for i in range(150)]
    held = {"/o/X": [0, *range(1, 18), 20, 21, 40, 9998, 10**15], "/o/Y": [2, 3, 4, 60], "/o/Z": [0]}
    existing = [(d, f"{s}_{n:03d}{e}") for d, ns in held.items() for n in ns for s, e in (("a", ".jpg"), ("b", ""))]
    existing += [("/o/X", "a.jpg"), ("/o/Z", "b")]
    plan = spark.createDataFrame([(p, n, d, o) for p, n, d, o in rows],
                                 "image_path string, image_name string, target_dir string, seen_order long")
    ex = spark.createDataFrame(existing, "target_dir string, file_name string")
    want = sequential(rows, existing)
    for bucket_rows in (1 << 20, 5):
        assert {r.image_path: r.dest_name for r in rt.dedup_destinations(plan, ex, bucket_rows=bucket_rows).collect()} == want


def test_numbers_of_a_group_with_claims_are_not_broadcast(spark):
    """a name's rows may be nearly all rows; no frame of that size reaches the driver."""
    n = 20_000
    plan = spark.range(n).select(F.concat(F.lit("/s/"), "id").alias("image_path"), F.lit("a.jpg").alias("image_name"),
                                 F.lit("/o").alias("target_dir"), F.col("id").alias("seen_order"))
    ex = spark.createDataFrame([("/o", "a.jpg"), ("/o", "a_002.jpg"), ("/o", "a_007.jpg")], "target_dir string, file_name string")
    out = rt.dedup_destinations(plan, ex, bucket_rows=1000)
    got = {r.seen_order: r.dest_name for r in out.collect()}
    free = [k for k in range(1, n + 3) if k not in (2, 7)]
    assert all(got[i] == f"a_{k:03d}.jpg" for i, k in enumerate(free) if k <= 9999) and len(set(got.values())) == n
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    final = out._jdf.queryExecution().explainString(mode).split("== Initial Plan ==")[0]
    sizes = [int(x) for x in re.findall(r"BroadcastQueryStage.*rowCount=(\d+)", final)]
    assert sizes and max(sizes) < 100, sizes
    assert "Generate" not in final  # no candidate numbers made in a task


def test_manifest_and_stats(spark):
    routed = spark.createDataFrame([("A", "x.jpg", 0), ("B", "y.jpg", 1), ("B", "z.jpg", 2), ("A", "w.jpg", 3),
                                    ("C", "v.jpg", 4)], "folder_key string, dest_name string, seen_order long")
    counts = {r.folder_key: r.file_count for r in rt.folder_counts(routed).collect()}
    assert counts == {"A": 2, "B": 2, "C": 1}
    s = rt.routing_stats(rt.folder_counts(routed)).first()
    assert (s.total_folders, s.total_files, s.largest_folder, s.largest_folder_files) == (3, 5, "A", 2)
    assert abs(s.average_files_per_folder - 5 / 3) < 1e-12


def test_collision_numbering_properties(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    names = st.sampled_from(["a.jpg", "a_001.jpg", "b.JPG", "c", "a_1000.jpg"])
    dirs = st.sampled_from(["/o/X", "/o/Y"])

    @settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
    @given(rows=st.lists(st.tuples(names, dirs), min_size=1, max_size=40),
           existing=st.lists(st.tuples(dirs, names), max_size=6),
           bucket=st.sampled_from([1, 3, 1 << 20]))
    def check(rows, existing, bucket):
        plan = spark.createDataFrame([(f"/s/{i}", n, d, d, i) for i, (n, d) in enumerate(rows)],
                                     "image_path string, image_name string, target_dir string, folder_key string, "
                                     "seen_order long")
        ex = spark.createDataFrame(existing, "target_dir string, file_name string")
        got = rt.dedup_destinations(plan, ex, bucket_rows=bucket, materialize_input=False).collect()
        assert len(got) == len(rows)
        dests = [(r.target_dir, r.dest_name) for r in got]
        assert len(set(dests)) == len(dests)                 # unique inside each folder
        assert not set(dests) & set(existing)                # never an existing file
        firsts = {}
        for i, (n, d) in enumerate(rows):
            firsts.setdefault((d, n), i)
        by_path = {r.image_path: r.dest_name for r in got}
        for (d, n), i in firsts.items():                      # a free name is kept by its first row
            if (d, n) not in set(existing):
                assert by_path[f"/s/{i}"] == n
        plain = all("_0" not in n and "_1" not in n for n, _ in rows) and \
            all("_0" not in n and "_1" not in n for _, n in existing)
        if plain:
            want = sequential([(f"/s/{i}", n, d, i) for i, (n, d) in enumerate(rows)], existing)
            assert by_path == want

    check()


def test_results_rule(spark, seed_names):
    rows = spark.createDataFrame(
        [("/s/a.jpg", "a.jpg", "2024-01-01", "", "", 0.9, "", "crow", "", 0, 1),
         ("/s/b.jpg", "b.jpg", "2024-01-01", "Corvus corone", "Corvus corone", 0.9, "bird", "", "", 1, 0),
         ("/s/c.jpg", "c.jpg", "2024-01-01", "Corvus corone", "Corvus corone", 0.9, "bird", "", "", 2, 1)],
        TABLE + ", n_detections long")
    caps = spark.createDataFrame([("/s/a.jpg", "2020-02-02")], "image_path string, capture_date string")
    out = {r.image_name: r.folder_key for r in
           rt.routing_plan(rows, seed_names, "/out", by_date=True, capture_dates=caps, rule="results").collect()}
    # species '' with a real common name is not "no detection" for fresh results (Q24)
    assert out["a.jpg"] == "2020-02-02/crow_"
    assert out["b.jpg"] == "unknown-date/未検出_No_Detection"      # no detections at all
    assert out["c.jpg"] == "unknown-date/Corvus corone"             # vernacular used as given (empty)
    table_rule = {r.image_name: r.folder_key for r in rt.routing_plan(rows, seed_names, "/out").collect()}
    assert table_rule["a.jpg"] == "未検出_No_Detection" and table_rule["c.jpg"] == "ハシボソガラス_Corvus corone"
