"""Reports (A1, A3-A9, A12, L3-L5) on literal tables, after the reference's exporter tests."""
from pyspark.sql import functions as F

from trapline.operators import reports as rep
from trapline.operators.labels import daily_label_counts, with_report_date, with_report_label

TABLE = ("image_path string, image_name string, image_date string, species string, scientific_name string, "
         "confidence double, category string, common_name string, japanese_name string, seen_order long")


def table(spark, rows):
    return spark.createDataFrame(rows, TABLE)


def test_summary_totals(spark):
    t = table(spark, [("/a", "a", "", "Corvus corone", "Corvus corone", 0.95, "bird", "crow", "", 0),
                      ("/b", "b", "", "", "", 0.0, "", "", "", 1),
                      ("/c", "c", "", "Sus scrofa", "Sus scrofa", 0.4, "mammal", "boar", "", 2)])
    r = rep.summary_totals(t).first()
    assert (r.total_images, r.detected_images, r.undetected_images, r.total_detections) == (3, 2, 1, 2)
    assert abs(r.success_rate - 200 / 3) < 1e-9


def test_summary_totals_empty(spark):
    r = rep.summary_totals(table(spark, [])).first()
    assert (r.total_images, r.detected_images, r.success_rate) == (0, 0, 0.0)


def test_frequency_stable_ties_and_bands(spark, seed_names):
    t = table(spark, [("/1", "1", "", "B", "", 0.95, "bird", "", "", 0),
                      ("/2", "2", "", "A", "", 0.75, "mammal", "", "", 1),
                      ("/3", "3", "", "B", "", float("nan"), "bird", "", "", 2),
                      ("/4", "4", "", "A", "", 0.1, "mammal", "", "", 3),
                      ("/5", "5", "", "", "", 0.0, "", "", "", 4)])
    sf = [(r.species, r.n, r.rank) for r in rep.species_frequency(t).orderBy("rank").collect()]
    assert sf == [("B", 2, 1), ("A", 2, 2)]  # tie: first seen first
    cf = {r.category: (r.n, r.category_label) for r in rep.category_frequency(t, seed_names).collect()}
    assert cf == {"bird": (2, "鳥類"), "mammal": (2, "哺乳類")}
    bands = [r.n for r in rep.confidence_bands(t).orderBy("band").collect()]
    assert bands == [1, 1, 0, 0, 2]  # NaN counts in the lowest band


def test_species_list_first_seen_attributes(spark, seed_names):
    d = spark.createDataFrame([
        ("S", "c1", "", "Corvus corone", 0.5, "bird", 0, 1),
        ("S", "c2", "x", "Other", 0.9, "mammal", 0, 0),
        ("T", "t", "", "", -1.0, "", 1, 0)],
        "species string, common_name string, japanese_name string, scientific_name string, confidence double, "
        "category string, seen_order long, det_index int")
    out = {r.species: r for r in rep.species_list(d, seed_names).collect()}
    s = out["S"]
    assert (s.common_name, s.japanese_name, s.category_label, s.detection_count) == ("c2", "x", "哺乳類", 2)
    assert s.max_confidence == 0.9 and abs(s.avg_confidence - 0.7) < 1e-12
    assert out["T"].max_confidence == 0.0  # floored at zero


def _pivot_input(spark):
    return table(spark, [
        ("/p/a.jpg", "a.jpg", "2024-11-21", "Corvus macrorhynchos (ハシブトガラス)", "Corvus macrorhynchos",
         0.9, "bird", "", "ハシブトガラス", 0),
        ("/p/b.jpg", "b.jpg", "2024-11-21", "Corvus macrorhynchos (ハシブトガラス)", "Corvus macrorhynchos",
         0.8, "bird", "", "", 1),
        ("/p/c.jpg", "c.jpg", "2024-11-21", "", "", 0.0, "", "", "", 2),
        ("/p/d.jpg", "d.jpg", "2024-11-22", "Corvus macrorhynchos", "Corvus macrorhynchos", 0.7, "bird", "", "", 3),
    ])


def test_pivot_rows(spark, seed_names):
    labeled = with_report_label(with_report_date(_pivot_input(spark)), seed_names)
    pivot = rep.daily_label_pivot(daily_label_counts(labeled))
    rows = [(r.label, r["2024-11-21"], r["2024-11-22"]) for r in pivot.orderBy("row_order").collect()]
    assert rows == [("合計撮影枚数", 3, 1), ("撮影無し", 1, 0), ("ハシブトガラス", 2, 1), ("合計", 3, 1)]


def test_pivot_unknown_date_last(spark, seed_names):
    t = _pivot_input(spark).withColumn("image_date", F.when(F.col("image_name") == "d.jpg", "")
                                       .otherwise(F.col("image_date")))
    counts = daily_label_counts(with_report_label(with_report_date(t), seed_names))
    assert rep.pivot_dates(counts) == ["2024-11-21", "unknown-date"]


def test_report_date_from_capture_dates(spark):
    t = _pivot_input(spark).withColumn("image_date", F.lit(""))
    caps = spark.createDataFrame([("/p/a.jpg", "2022-03-14")], "image_path string, capture_date string")
    out = {r.image_name: r.report_date for r in with_report_date(t, caps).collect()}
    assert out["a.jpg"] == "2022-03-14" and out["b.jpg"] == "unknown-date"


def test_result_metadata_and_pages(spark):
    rows = [(f"/{i}", f"{i}", "", "S" if i % 2 else "", "", 0.5, "", "", "", i) for i in range(250)]
    t = table(spark, rows)
    m = rep.result_metadata(t).first()
    assert (m.total_rows, m.distinct_species, m.page_count) == (250, 1, 3)
    assert rep.result_metadata(table(spark, [])).first().page_count == 1
    assert rep.result_metadata(t, approx_rsd=0.01).first().distinct_species == 1
    page = rep.result_page(t, 2).orderBy("row_no").collect()
    assert [r.seen_order for r in page] == list(range(200, 250))
    assert [r.row_no for r in page][:2] == [201, 202]
    assert page[0].species_display == "検出なし"
    # the deep-page path (exact ordinal) gives the same rows
    old = rep.TOPK_PAGE_DEPTH
    rep.TOPK_PAGE_DEPTH = 0
    try:
        deep = rep.result_page(t, 1).orderBy("row_no").collect()
    finally:
        rep.TOPK_PAGE_DEPTH = old
    assert [r.seen_order for r in deep] == list(range(100, 200))
    assert [r.row_no for r in deep] == list(range(101, 201))
    # rows of equal order: the same pages on both sides of the limit, however the table is split
    same = t.withColumn("seen_order", F.floor(F.col("seen_order") / 60).cast("long"))
    shallow = [r.image_path for r in rep.result_page(same, 1).orderBy("row_no").collect()]
    rep.TOPK_PAGE_DEPTH = 0
    try:
        deep = [r.image_path for r in rep.result_page(same.repartition(5), 1).orderBy("row_no").collect()]
    finally:
        rep.TOPK_PAGE_DEPTH = old
    assert shallow == deep


def test_pivot_label_rule_for_blank_species(spark, seed_names):
    """Q19: species 'blank' without a common name is no detection; with a real common name it is not."""
    t = table(spark, [("/1", "1", "2024-01-01", "blank", "", 0.9, "", "", "", 0),
                      ("/2", "2", "2024-01-01", "blank", "", 0.9, "", "owl", "", 1),
                      ("/3", "3", "2024-01-01", "blank", "", 0.9, "", "no cv result", "", 2)])
    out = {r.image_path: r.label for r in with_report_label(t, seed_names).collect()}
    assert out == {"/1": "撮影無し", "/2": "owl", "/3": "撮影無し"}


def test_unicode_whitespace_is_stripped(spark, seed_names):
    """Q23: full-width and other Unicode blanks are stripped like Python's str.strip()."""
    from trapline.functions.text import ustrip

    df = spark.createDataFrame([("　 Corvus corone \t",)], "s string")
    assert df.select(ustrip("s").alias("x")).first().x == "Corvus corone"
    t = table(spark, [("/1", "1", "　2024-01-02 ", "　Corvus corone", "Corvus corone　", 0.9, "bird",
                       "", "", 0)])
    r = with_report_label(with_report_date(t), seed_names).first()
    assert (r.report_date, r.label) == ("2024-01-02", "ハシボソガラス")


def test_ranks_span_sort_partitions_without_a_global_window(spark, seed_names):
    """Ranks and sections over many sort partitions equal a stable sort; no plan has a window over everything."""
    import random

    rng = random.Random(3)
    rows = [(f"/{i}", str(i), "", f"s{rng.randint(0, 400)}" if i % 9 else "", "", rng.random(), f"c{rng.randint(0, 60)}" if i % 4 else "",
             "", "", i) for i in range(3000)]
    t = table(spark, rows).repartition(5)
    first, count = {}, {}
    for r in rows:
        if r[3]:
            first.setdefault(r[3], r[9])
            count[r[3]] = count.get(r[3], 0) + 1
    want = sorted(count, key=lambda k: (-count[k], first[k]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frames = {"sf": rep.species_frequency(t), "cf": rep.category_frequency(t, seed_names), "k3": rep.summary_report(t, seed_names),
                  "pivot": rep.daily_label_pivot(daily_label_counts(with_report_label(with_report_date(t), seed_names)))}
        got = frames["sf"].orderBy("rank").collect()
        assert [r["species"] for r in got] == want and [r["rank"] for r in got] == list(range(1, len(want) + 1))
        assert abs(sum(r["pct"] for r in got) - 100) < 1e-6
        cats = frames["cf"].orderBy("rank").collect()
        assert [r["rank"] for r in cats] == list(range(1, len(cats) + 1)) and "" not in {r["category"] for r in cats}
        by = {}
        for r in frames["k3"].collect():
            by.setdefault(r["section"], []).append((r["ord"], r["item"], r["n"]))
        assert all(sorted(o for o, _, _ in v) == list(range(1, len(v) + 1)) for v in by.values()) and len(by) == 4
        assert any([(k, count[k]) for k in want] == [(i, n) for _, i, n in sorted(v)] for v in by.values())
        assert sorted(r["row_order"] for r in frames["pivot"].collect()) == list(range(1, frames["pivot"].count() + 1))
        for df in frames.values():
            assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
