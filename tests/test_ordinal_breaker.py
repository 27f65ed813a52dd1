"""Exact in-group positions (salted) and the circuit breaker."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from trapline.operators.incremental import failure_streaks
from trapline.operators.ordinal import with_marks_passed, with_ordinal


def test_ordinal_matches_row_number(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.randrange(10_000)) for _ in range(500)]
    rows = list({(g, o): None for g, o in rows})  # unique order inside a group
    df = spark.createDataFrame(rows, "g string, o long")
    want = {(r.g, r.o): r.rn for r in df.withColumn(
        "rn", F.row_number().over(Window.partitionBy("g").orderBy("o"))).collect()}
    for bucket in (1, 13, 1 << 20):
        got = {(r.g, r.o): r.ordinal for r in with_ordinal(df, ["g"], "o", bucket_rows=bucket).collect()}
        assert got == want
    glob = {r.o: r.ordinal for r in with_ordinal(df.filter("g = 'a'"), [], "o", bucket_rows=17).collect()}
    assert sorted(glob.values()) == list(range(1, len(glob) + 1))


def test_marks_passed_match_a_count(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("abc"), rnd.randrange(200), i) for i in range(150)]
    marks = [(rnd.choice("abd"), rnd.choice([0, 7, rnd.randrange(200), 10**12])) for _ in range(60)]
    df, m = spark.createDataFrame(rows, "g string, o long, id long"), spark.createDataFrame(marks, "g string, o long")
    want = {i: sum(h == g and at <= o for h, at in marks) for g, o, i in rows}
    for bucket in (1, 13, 1 << 20):
        assert {r.id: r.passed for r in with_marks_passed(df, m, ["g"], "o", bucket_rows=bucket).collect()} == want


def test_breaker_trips_on_consecutive_failures(spark):
    log = spark.createDataFrame([(0, True), (1, True), (2, True)], "chunk_no long, failed boolean")
    r = failure_streaks(log, limit=2).first()
    assert (r.run_start, r.run_end, r.tripped, r.trip_chunk, r.first_trip) == (0, 2, True, 1, True)


def test_breaker_resets_on_success(spark):
    log = spark.createDataFrame([(0, True), (1, False), (2, True), (3, True), (4, False), (5, True), (6, True),
                                 (7, True)], "chunk_no long, failed boolean")
    runs = sorted((r.run_start, r.run_length, r.tripped, r.first_trip) for r in failure_streaks(log, 3).collect())
    assert runs == [(0, 1, False, False), (2, 2, False, False), (5, 3, True, True)]
