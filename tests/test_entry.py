"""Driver contract and oracle agreement of every registered query (sf0.001)."""
import __spark_entry__ as E
from tools.compare import compare
from trapline.plans.catalog import QUERIES
from trapline.plans.catalog_edges import QUERIES as EDGE_QUERIES
from trapline.plans.catalog_tables import QUERIES as TABLE_QUERIES

# the library's own queries; the optional training-text ones have tests of their own
NAMES = [*QUERIES, *EDGE_QUERIES, *TABLE_QUERIES]
SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"image_date", "label", "n_images", "grouping_id"}
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(E.oracle_sql()) <= set(E.queries())


def test_queries_match_oracle(spark):
    import tools.compare as C

    C.EXACT = True  # bit-identical floats, as a raw value hash would need
    try:
        res = compare(spark, SF, NAMES, verbose=False)
    finally:
        C.EXACT = False
    bad = {k: v for k, v in res.items() if v != "OK"}
    assert not bad, bad


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def test_plans_have_no_cross_products_or_row_udfs(spark):
    bad = {}
    for name in NAMES:
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        hits = [op for op in FORBIDDEN if op in plan]
        if hits:
            bad[name] = hits
    assert not bad, bad


def test_bench_prints_one_json_line():
    import json
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR=SF, BENCH_CPUS="2", BENCH_QUERIES="summary_totals,circuit_breaker")
    out = subprocess.run([sys.executable, "bench.py"], cwd=root, env=env, capture_output=True, text=True,
                         timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["unit"] == "sec" and set(rec["queries"]) == {"summary_totals", "circuit_breaker"}
    assert rec["value"] > 0 and rec["sf"] == 0.001
