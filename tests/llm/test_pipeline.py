"""The pipeline's stages, each against brute force on what it was given."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm import brute
from trapline.llm import mixing
from trapline.llm.tables import materialize

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage keeps of the smallest documents."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = materialize(stage(spark, docs, SF_SMALL))
    return out


def rows(df):
    return df.select("doc_id", "text", "lang", "source", "n_chars").collect()


def test_quality(kept):
    assert Counter(rows(kept["quality_rules"])) == Counter(r for r in rows(kept["documents"]) if brute.quality(r["text"])[6])


def test_near_duplicates(kept):
    given = sorted(rows(kept["quality_rules"]), key=lambda r: r["doc_id"])
    first = brute.components([r["text"] for r in given])
    assert Counter(rows(kept["ngram_jaccard_join"])) == Counter(given[i] for i in set(first))


def test_decontamination(spark, kept):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = Counter(r for r in rows(kept["ngram_jaccard_join"]) if not brute.leaks(r["text"], items)[1])
    assert Counter(rows(kept["benchmark_decontamination"])) == want


def test_mixing(kept):
    given = kept["benchmark_decontamination"]
    took = mixing.mix(given, mixing.words(F.col("text")))
    want = Counter()
    for r in took.collect():
        n = int(r["taken"] / r["size"] + 0.5) if r["size"] else 0
        if n:
            want[(r["doc_id"], r["text"])] += n
    assert Counter((r["doc_id"], r["text"]) for r in rows(kept["mixing_to_weights"])) == want


def test_sharding(kept):
    last = kept["sharding"]
    assert Counter(rows(last)) == Counter(rows(kept["mixing_to_weights"]))
    by = Counter(r["shard"] for r in last.collect())
    assert max(by.values()) - min(by.values()) <= 1 and len(by) == 16
    for shard, n in by.items():
        assert sorted(r["slot"] for r in last.where(F.col("shard") == shard).collect()) == list(range(n))


def test_all_but_the_last_return_the_columns_of_documents(kept):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert kept[name].columns == kept["documents"].columns


@pytest.mark.parametrize("name", list(STAGE))
def test_odd_documents(spark, odd_docs, no_docs, name):
    got = STAGE[name](spark, odd_docs, SF_SMALL)
    last = name == "sharding"
    assert got.columns == odd_docs.columns if not last else set(odd_docs.columns) == set(got.columns)
    assert got.count() <= 2 * odd_docs.count()
    assert STAGE[name](spark, no_docs, SF_SMALL).count() == 0
