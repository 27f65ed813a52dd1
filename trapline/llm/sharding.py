"""Sharding (9): a uniform shuffle into shards whose row counts differ by at most one.

The rows are dealt to blocks by a hash.  The driver sees only the blocks' row
counts and draws how many rows each block sends to each shard, as a sequence of
multivariate hypergeometric draws (the communication matrix): row sums are the
blocks' counts, column sums the exact shard sizes.  Inside a block the rows are
permuted (ordered by a second hash) and dealt out by the block's line of the
matrix; after the exchange they are permuted again by a third hash, which gives
the slots.  About sqrt(rows) blocks, and as many ranges of the last permutation
over all shards, keep every sort small and the driver's matrix at
sqrt(rows) x shards numbers.

Equal rows (alike in all keys) are interchangeable, and may be a third of the table.
Groups of more than EQUAL_ROWS are numbered first, in slices and by prefix sums over the
slices, and their hash takes in number // EQUAL_ROWS, so a group is spread over blocks;
inside a block equal rows are numbered again, so each is shuffled on its own.  Only
which of two equal rows gets which number depends on where the rows lie.

The draws are by inversion around the mode, in doubles, at every size: one law and one
way.  A draw takes some 50 microseconds on the driver, there are sqrt(rows) x shards of
them (about 80 seconds at 1e10 rows and 16 shards).

Defined cases: a null text has 0 bytes and the CRC of the empty text; null ids and
repeated rows are rows like others (equal rows are interchangeable); empty tables
give empty results; other columns are carried, but for those named shard or slot,
which the operator's replace.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trapline.llm.tables import materialize, packed, table, unpacked

N_SHARDS = 16
SEED = 20
#: Equal rows in one block; larger groups are spread over blocks.
EQUAL_ROWS = 1000


def matrix(counts: list[int], n_shards: int, seed: int = SEED) -> np.ndarray:
    """Rows that each block sends to each shard: uniform over all ways to fill the shards exactly."""
    total, rng = sum(counts), np.random.default_rng(seed)
    room = np.full(n_shards, total // n_shards, np.int64)
    room[:total % n_shards] += 1
    out = np.zeros((len(counts), n_shards), np.int64)
    for i, n in enumerate(counts):
        left = n
        for j in range(n_shards - 1):  # one hypergeometric draw a cell
            rest = int(room[j + 1:].sum())
            out[i, j] = _draw(rng, int(room[j]), rest, left)
            left -= out[i, j]
        out[i, -1] = left
        room -= out[i]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn from an urn are good: hypergeometric, by inversion.

    The probabilities around the mode follow from the ratios of neighbours; what lies
    beyond 14 deviations and 30 more has less than a double's last bit.
    """
    low, high, total = max(0, n - bad), min(n, good), good + bad
    if low == high:
        return low
    share = good / total
    reach = int(14 * math.sqrt(n * share * (1 - share) * (total - n) / max(total - 1, 1))) + 30
    mode = (n + 1) * (good + 1) // (total + 2)
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    steps = np.log((good - k[:-1]) * (n - k[:-1])) - np.log((k[:-1] + 1) * (bad - n + k[:-1] + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(np.searchsorted(upto, rng.random() * upto[-1], side="right"), len(k) - 1)])


def salted(keyed: DataFrame, equal_rows: int = EQUAL_ROWS) -> DataFrame:
    """``keyed`` (with the two hashes ``_a``, ``_b``) with ``_salt``: (number among the equal rows - 1) // equal_rows."""
    same = ["_a", "_b"]
    heavy = materialize(keyed.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > equal_rows).select(*same))
    if heavy.isEmpty():  # every number is at most equal_rows
        return keyed.withColumn("_salt", F.lit(0).cast("long"))
    # at most rows / equal_rows lines: Spark broadcasts or joins them by their size
    hot = materialize(keyed.join(heavy, same, "left_semi").withColumn("_at", F.monotonically_increasing_id()))
    hot = hot.withColumn("_slice", F.floor(F.col("_at") / equal_rows))  # at most equal_rows rows of one partition
    local = hot.withColumn("_local", F.row_number().over(W.partitionBy(*same, "_slice").orderBy("_at")))
    sizes = hot.groupBy(*same, "_slice").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(*same).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*same, "_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    numbered = local.join(offsets, [*same, "_slice"])
    salt = F.floor((F.col("_before") + F.col("_local") - 1) / equal_rows)
    columns = [F.col(c) for c in keyed.columns]
    rest = keyed.join(heavy, same, "left_anti")
    return (rest.select(*columns, F.lit(0).cast("long").alias("_salt"))
            .unionByName(numbered.select(*columns, salt.cast("long").alias("_salt"))))


def in_blocks(rows: DataFrame, keys: list[Column], side: int, seed: int, equal_rows: int = EQUAL_ROWS) -> DataFrame:
    """The packed rows with their block and what tells them from rows that aren't equal (``_a``, ``_b``, ``_salt``)."""
    keyed = packed(rows, _a=F.xxhash64(F.lit(seed * 8 + 1), *keys), _b=F.xxhash64(F.lit(seed * 8 + 2), *keys))
    return salted(keyed, equal_rows).withColumn("_block", F.pmod(F.xxhash64("_a", "_b", "_salt"), F.lit(side)))


def shuffle_into_shards(rows: DataFrame, keys: list[Column], n_shards: int = N_SHARDS, seed: int = SEED,
                        equal_rows: int = EQUAL_ROWS) -> DataFrame:
    """``rows`` with ``shard`` (int, 0 to n - 1) and ``slot`` (long, gapless from 0 in each shard).

    ``keys`` tell rows apart: rows alike in all of them are interchangeable.
    """
    spark = rows.sparkSession
    side = math.isqrt(max(rows.count(), 1)) + 1
    dealt = in_blocks(rows, keys, side, seed, equal_rows)
    counts = {r["_block"]: r["n"] for r in dealt.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = sorted(counts)
    ends = matrix([counts[b] for b in blocks], n_shards, seed).cumsum(axis=1)
    lines = spark.createDataFrame([(int(b), [int(x) for x in line]) for b, line in zip(blocks, ends)],
                                  "_block long, _ends array<long>")
    # equal rows of a block are told apart by a number; one exchange, by block, serves both windows
    twins = W.partitionBy("_block", "_a", "_b", "_salt").orderBy("_block")
    own = dealt.repartition("_block").withColumn("_twin", F.row_number().over(twins))
    key = lambda k: F.xxhash64(F.lit(seed * 8 + k), "_a", "_b", "_salt", "_twin")
    own = own.withColumns({"_first": key(3), "_second": key(4), "_range": F.pmod(key(5), F.lit(side // n_shards + 1))})
    permuted = own.withColumn("_rank", F.row_number().over(W.partitionBy("_block").orderBy("_first", "_second")))
    # sqrt(rows) lines of n_shards numbers: Spark broadcasts or joins them by their size
    sent = (permuted.join(lines, "_block")
            .withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))).cast("int")))
    cells = materialize(sent.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("n")))
    before = W.partitionBy("shard").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.select("shard", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    again = W.partitionBy("shard", "_range").orderBy("_second", "_first")
    return (sent.withColumn("_inside", F.row_number().over(again)).join(offsets, ["shard", "_range"])
            .withColumn("slot", (F.col("_offset") + F.col("_inside") - 1).cast("long"))
            .select(*unpacked(rows.columns, ("shard", "slot")), "shard", "slot"))


def text_columns(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    return {"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text.cast("binary"))}


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in text_columns(F.col("text")).items()])
    docs = materialize(docs)  # three numbers a row: the texts are read once
    got = shuffle_into_shards(docs, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
