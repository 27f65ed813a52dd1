"""From raw documents to shuffled training shards, in five stages over Spark.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return
the columns of documents.  ``run`` writes each stage's result as a Parquet table in
the shared checkpoint folder and reads it for the next, so a lost executor repeats
one stage's lost tasks only.

Defined cases: null and empty texts have no words, so the first stage drops them;
ids may be null or repeated; extra columns are carried through every stage whatever
their names (the last stage replaces columns named shard and slot); an empty table
passes through all stages.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm import decontaminate, jaccard, mixing, quality, sharding
from trapline.llm.tables import materialize, packed, small, table, unpacked


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a quality rule rejects."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no name clashes with the verdict's
    judged = quality.judge(plain, text=f"c{docs.columns.index('text')}").where("kept").select(*plain.columns)
    return judged.toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id."""
    return jaccard.one_per_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    found = decontaminate.matches_of(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    leaked = materialize(found.where(F.size("matches") > 0).select("doc"))
    rows = packed(docs, doc=decontaminate.row_key())
    return rows.join(small(leaked, 16), "doc", "left_anti").select(*unpacked(docs.columns))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources' shares of words meet their targets."""
    mixed = mixing.mix(packed(docs, doc_id=F.col("doc_id"), source=F.col("source")), mixing.words(F.col("row")["text"]))
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(0), mixing.copies()))).where("copy > 0").select(*unpacked(docs.columns))


def sharding_uniformly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents to shards of equal counts, in a uniformly random order: adds shard and slot."""
    return sharding.shuffle_into_shards(docs, [F.col("doc_id"), F.xxhash64("text")])


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_to_weights", mixing_to_weights),
    ("sharding", sharding_uniformly),
]

#: The draws of the last stage can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
