"""Mixing sources to target weights (2), with DataFrame functions only.

Every document gets a hash-random key.  Within each source the documents are
ordered by that key, their word counts are summed up to each document, and the
order is cut at the source's exact budget; a budget above the source's size
repeats the source in whole epochs first.  The prefix sums are distributed: the
key range is split into about sqrt(rows) ranges, a sum per (source, range) gives
each range its offset, and only inside a range are rows summed one by one.  So no
task holds more of a source than one range, however large the source is.  Rows of one
id (nulls, say) have one key: where more than EQUAL_ROWS rows of a source do, the range is
cut before and behind that key, and the key's rows are ranges by size and by number
among those of equal size, EQUAL_ROWS each; the order stays (key, size).

Defined cases: a null text has size 0; a null source is a source of its own, last
in order; documents of size 0 take 0 words; repeated rows are documents of their
own (which of two equal rows is cut does not change the result); a document at
the cut is taken in part (``taken`` counts words); an empty table gives an empty
result; other columns are carried, but for those with the name of a column that the
operator adds, which replaces them.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trapline.llm.tables import materialize, packed, table, unpacked

# fixed values of the contract
WEIGHTS = (5, 2, 1)          # of the sources in order, repeating
SHARE = (3, 2)               # of all sizes: 150 %
MAX_EPOCHS = 2
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
#: Rows of one source and key that a range may hold.
EQUAL_ROWS = 1000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source_key, source_size, target) from (source_key, source_order..., source_size).

    Water filling over one row a source: in rising order of cap / weight a source is
    held at its cap while its part of what is left would exceed it; the first that
    is not held sets the level of the rest.  All tests are in whole numbers.
    """
    everything, tied = W.orderBy(F.lit(0)), ("cap_rank", "source_key")
    by_name = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                          (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    whole = everything.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = (sizes.withColumn("weight", weight.cast("long"))
         .withColumn("cap_rank", F.col("source_size") * MAX_EPOCHS / F.col("weight"))
         .withColumn("all_words", F.sum("source_size").over(whole))
         .withColumn("all_weight", F.sum("weight").over(whole)))
    lower = W.orderBy(*tied).rowsBetween(W.unboundedPreceding, -1)
    s = (s.withColumn("left2", SHARE[0] * F.col("all_words")
                      - SHARE[1] * MAX_EPOCHS * F.coalesce(F.sum("source_size").over(lower), F.lit(0)))
         .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(lower), F.lit(0)))
         .withColumn("held", F.col("left2") * F.col("weight")
                     > SHARE[1] * MAX_EPOCHS * F.col("source_size") * F.col("left_weight")))
    level = F.min_by(F.struct("left2", "left_weight"), F.when(~F.col("held"), F.struct(*tied))).over(whole)
    s = s.withColumn("level", level)
    free = F.col("level.left2").cast("double") * F.col("weight") / (SHARE[1] * F.col("level.left_weight"))
    return s.select("source_key", "source_size",
                    F.when(F.col("held"), (MAX_EPOCHS * F.col("source_size")).cast("double")).otherwise(free).alias("target"))


CELL = ("_range", "_after", "_past", "_size", "_salt")  # a range's parts, in the order of (key, size)


def in_cells(keyed: DataFrame, equal_rows: int = EQUAL_ROWS) -> DataFrame:
    """``keyed`` with the columns CELL: its ranges, cut at keys that too many rows share."""
    same = ["source_key", "_range", "_key"]
    plain = {"_after": F.lit(""), "_past": F.lit(0), "_size": F.lit(0).cast("long"), "_salt": F.lit(0).cast("long")}
    heavy = materialize(keyed.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > equal_rows))
    if heavy.isEmpty():
        return keyed.withColumns(plain)
    # one row a range with such keys, at most rows / equal_rows keys in all
    cuts = heavy.groupBy("source_key", "_range").agg(F.collect_list("_key").alias("_cuts"))
    after = F.coalesce(F.array_max(F.filter("_cuts", lambda k: k <= F.col("_key"))), F.lit(""))
    cut = keyed.join(cuts, ["source_key", "_range"], "left").withColumn("_after", after).drop("_cuts")
    # those of the key itself come before those behind it
    others = (cut.where(F.col("_after") != F.col("_key"))
              .withColumns({"_past": F.lit(1), "_size": plain["_size"], "_salt": plain["_salt"]}))
    hot = materialize(cut.where(F.col("_after") == F.col("_key")).withColumn("_at", F.monotonically_increasing_id()))
    hot = hot.withColumn("_slice", F.floor(F.col("_at") / equal_rows))  # at most equal_rows rows of one partition
    group = [*same, "size"]
    local = hot.withColumn("_local", F.row_number().over(W.partitionBy(*group, "_slice").orderBy("_at")))
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    counts = hot.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(*group, "_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    salt = F.floor((F.col("_before") + F.col("_local") - 1) / equal_rows).cast("long")
    numbered = local.join(offsets, [*group, "_slice"]).withColumns({"_past": F.lit(0), "_size": F.col("size"), "_salt": salt})
    columns = [*keyed.columns, *CELL[1:]]
    return others.select(*columns).unionByName(numbered.select(*columns))


def mix(docs: DataFrame, size: Column, source: str = "source", doc_id: str = "doc_id", seed: str = SEED,
        equal_rows: int = EQUAL_ROWS) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes, repeats counted)."""
    added = ("size", "source_size", "target", "taken")
    # about sqrt(rows) ranges of the key: as many ranges as rows in one
    bits = min(31, math.ceil(math.log2(max(docs.count(), 1)) / 2))
    key = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    name = F.col(source).cast("string")
    keyed = (packed(docs, size=size, source=name, source_key=F.coalesce(F.concat(F.lit("="), name), F.lit("null")), _key=key)
             .withColumn("_range", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") / (1 << (32 - bits)))))
    keyed = in_cells(keyed, equal_rows)
    ranges = materialize(keyed.groupBy("source", "source_key", *CELL).agg(F.sum("size").alias("words")))
    goal = targets(ranges.groupBy("source", "source_key").agg(F.sum("words").alias("source_size")))
    before = W.partitionBy("source_key").orderBy(*CELL).rowsBetween(W.unboundedPreceding, -1)
    offsets = (ranges.withColumn("_offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
               .select("source_key", *CELL, "_offset").join(goal, "source_key"))
    inside = W.partitionBy("source_key", *CELL).orderBy("_key", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (keyed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(offsets, ["source_key", *CELL]))
    budget, whole = F.floor("target"), F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.floor(budget / whole)
    rest = budget - epochs * whole - F.col("_offset") - F.col("_inside")
    taken = epochs * F.col("size") + F.greatest(F.least(rest, F.col("size")), F.lit(0))
    return placed.withColumn("taken", taken.cast("long")).select(*unpacked(docs.columns, added), *added)


def copies() -> Column:
    """How often a mixed frame's row is written: its whole epochs, and a last one if at least half of it is taken."""
    return F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("words"))
    return mix(docs, F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, 'null') AS k, source,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
s AS (SELECT k, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
r AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) + 1] AS w FROM s),
o AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS a, CAST(sum(w) OVER () AS BIGINT) AS aw,
             CAST(coalesce(sum(source_size) OVER lo, 0) AS BIGINT) AS c, CAST(coalesce(sum(w) OVER lo, 0) AS BIGINT) AS cw,
             row_number() OVER (ORDER BY source_size * 2 / w, k) AS n
      FROM r WINDOW lo AS (ORDER BY source_size * 2 / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * a - 4 * c AS left2, aw - cw AS lw, (3 * a - 4 * c) * w > 4 * source_size * (aw - cw) AS held FROM o),
l AS (SELECT arg_min(left2, n) AS l2, arg_min(lw, n) AS lw FROM c WHERE NOT held),
t AS (SELECT k, source_size, CASE WHEN held THEN CAST(2 * source_size AS DOUBLE)
             ELSE CAST(l2 AS DOUBLE) * w / (2 * l.lw) END AS target FROM c, l),
p AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS b, greatest(t.source_size, 1) AS ss,
             CAST(coalesce(sum(size) OVER (PARTITION BY k ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  AS BIGINT) AS pre
      FROM d JOIN t USING (k))
SELECT doc_id, size, source_size, target,
       CAST((b // ss) * size + greatest(least(b - (b // ss) * ss - pre, size), 0) AS BIGINT) AS taken FROM p
"""
