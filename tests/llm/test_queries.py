"""Every query of the subpackage on the smallest tables: against its SQL, else that it runs and repeats itself."""
import pytest

from tests.conftest import SF_SMALL
from tools.compare import compare
from trapline.llm.registry import QUERIES


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_equals_sql(spark, name):
    assert compare(spark, SF_SMALL, [name], verbose=False)[name] == "OK"


@pytest.mark.parametrize("name", ["op9_shards", "op3_language_id"])
def test_runs_agree(spark, name):
    query = QUERIES[name][0]
    one, two = (query(spark, SF_SMALL).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert len(one) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert one.astype(str).equals(two.astype(str))
