"""Conversation prefix trie (13): subtree sums over a distributedly ranked Euler tour.

A node is a distinct sequence of first turns (role, text).  Turns are 128-bit digests;
a sequence's key is the exclusive-or of two 64-bit hashes of (place, turn), so a running
exclusive-or gives the keys of all prefixes, also of a conversation that spans ranges.
Nodes are an aggregate by key: partial first, as many conversations share one.

The tour has an enter and an exit arc a node.  Siblings get consecutive numbers from one
range sort by parent, so "next sibling" is a join on a unique number, whatever the number
of children; the tour's links are those of first children, next siblings and parents.
``ranking.ranked`` ranks them, which gives positions; running sums at the positions of
(leaf or not, tokens saved) are taken once, and a subtree's sum is the sum at its node's
exit less that before its enter.

Defined cases: rows without a conv_id take no part; null roles and texts are empty;
turns with equal numbers are ordered by role, then by the text's md5; repeated rows are turns
of their own; a conversation whose turns are all replaced by an absent one's is turnless
and ends at the root; an empty table has no nodes, not even a root; other columns are
ignored.  The digest of a node's ends is one SHA-256 over all their ids, so it is
computed in order; ids are joined to texts of bounded length in sorted ranges first.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm.mixing import words
from trapline.llm.ranking import ranked
from trapline.llm.running import running
from trapline.llm.tables import materialize, table

FAMILY = 20      # conversations c - c % FAMILY lend their first turns
MOST_TAKEN = 4   # crc32(c) % MOST_TAKEN turns are taken
CHUNK_IDS = 1 << 12  # ids joined to one text at most
KEY = ["depth", "k1", "k2"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text_md5, words): every row with its place in its conversation, from 1."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.md5(text)).alias("text_md5"),
        words(F.col("text")).alias("words"))
    return running(rows, ["conv_id"], ["turn", "role", "text_md5"], pos=("sum", F.lit(1))).drop("turn")


def rebuilt(turned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, role, text_md5, words) of the rebuilt conversations, and their ids (conv_id)."""
    taken = F.crc32(F.col("conv_id").cast("string")) % MOST_TAKEN
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    ids = materialize(turned.groupBy("conv_id").agg(F.max("pos").alias("turns")).withColumns({"taken": taken, "base": base}))
    lent = turned.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < MOST_TAKEN)).withColumnRenamed("conv_id", "base")
    first = ids.join(lent, "base").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "role", "text_md5", "words")
    # where fewer turns could be taken than asked, the own ones move up: a row a conversation at most
    there = ids.where(F.col("conv_id") == F.col("base")).select("base", F.col("turns").alias("base_turns"))
    gaps = (ids.join(there, "base", "left").select("conv_id", (F.col("taken") - F.coalesce("base_turns", F.lit(0))).alias("gap"))
            .where("gap > 0"))
    own = (turned.where(F.col("pos") > taken).join(gaps, "conv_id", "left")
           .select("conv_id", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("depth"), "role", "text_md5", "words"))
    return first.union(own), ids.select("conv_id")


def paths(sequences: DataFrame) -> DataFrame:
    """The sequences with the keys k1, k2 of their prefixes up to each row, and p1, p2 of those before it."""
    one, two = F.xxhash64("depth", "role", "text_md5"), F.xxhash64(F.lit("second"), "text_md5", "role", "depth")
    keyed = materialize(sequences.select("conv_id", "depth", "words", one.alias("x1"), two.alias("x2")))
    keyed = running(keyed, ["conv_id"], ["depth"], k1=("xor", F.col("x1")), k2=("xor", F.col("x2")))
    return keyed.select("conv_id", *KEY, F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "words")


def nodes_of(walked: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, depth, k1, k2, p1, p2, conv_id, n_convs, words): the trie's nodes, numbered; the root has zero keys."""
    some = (walked.groupBy(*KEY).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"),
                                     F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words")))
    zero = F.lit(0).cast("long")
    root = (ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
            .select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"),
                    F.lit(None).cast("long").alias("p2"), "conv_id", "n_convs", zero.alias("words")))
    return materialize(some.withColumn("depth", F.col("depth").cast("long")).unionByName(root).withColumn("node", F.monotonically_increasing_id()))


def tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, next) arcs, 2 * node to enter and one more to exit, and (node, parent_conv_id, n_children)."""
    kids = nodes.where("depth > 0").select("node", (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    kids = materialize(running(kids, [], [*KEY, "node"], seq=("sum", F.lit(1))))
    family = kids.groupBy(*KEY).agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    parents = materialize(nodes.select("node", "conv_id", *KEY).join(family, KEY, "left")
                          .select("node", "conv_id", "first", "last", *KEY))
    numbered = kids.select("node", "seq")
    enter = parents.where("first IS NULL").select((2 * F.col("node")).alias("id"), (2 * F.col("node") + 1).alias("next")).union(
        parents.where("first IS NOT NULL").join(numbered.withColumnsRenamed({"node": "kid", "seq": "first"}), "first")
        .select((2 * F.col("node")).alias("id"), (2 * F.col("kid")).alias("next")))
    ended = numbered.join(parents.where("last IS NOT NULL").select(F.col("last").alias("seq"), F.col("node").alias("parent")), "seq", "left")
    following = numbered.select((F.col("seq") - 1).alias("seq"), F.col("node").alias("sibling"))
    leave = (ended.join(following, "seq", "left")
             .select((2 * F.col("node") + 1).alias("id"),
                     F.when(F.col("parent").isNotNull(), 2 * F.col("parent") + 1).otherwise(2 * F.col("sibling")).alias("next")))
    last = nodes.where("depth = 0").select((2 * F.col("node") + 1).alias("id"), F.lit(None).cast("long").alias("next"))
    up = kids.join(parents.select(*KEY, F.col("conv_id").alias("parent_conv_id")), KEY).select("node", "parent_conv_id")
    about = (parents.join(up, "node", "left")
             .select("node", "parent_conv_id", F.coalesce(F.col("last") - F.col("first") + 1, F.lit(0)).alias("n_children")))
    return enter.union(leave).union(last), about


def subtree_sums(nodes: DataFrame, arcs: DataFrame, about: DataFrame) -> DataFrame:
    """(node, parent_conv_id, n_children, n_leaves, saved_tokens) from running sums at the arcs' positions."""
    ranks = materialize(ranked(arcs.withColumn("dist", F.lit(1))))
    weights = nodes.join(about, "node").select(
        (2 * F.col("node")).alias("id"), (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    zero = F.lit(0).cast("long")
    placed = ranks.join(weights, "id", "left").select("id", (-F.col("rank")).alias("pos"), F.coalesce("leaf", zero).alias("leaf"),
                                                      F.coalesce("saved", zero).alias("saved"))
    summed = running(placed, [], ["pos"], leaves=("sum", F.col("leaf")), tokens=("sum", F.col("saved")))
    exit_ = F.col("id") % 2 == 1

    def inside(total: str, own: str):
        # before the enter arc: its running sum less its own
        return F.sum(F.when(exit_, F.col(total)).otherwise(F.col(own) - F.col(total)))

    sums = summed.groupBy(F.shiftright("id", 1).alias("node")).agg(
        inside("leaves", "leaf").alias("n_leaves"), inside("tokens", "saved").alias("saved_tokens"))
    return about.join(sums, "node")


def ends_digest(walked: DataFrame, ids: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 of the ascending, comma-joined ids of the conversations that end at a node."""
    last = walked.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("at"))
    zero = F.lit(0).cast("long")
    ends = ids.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col("at")[c].cast("long"), zero).alias(c) for c in KEY])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            for key, ids_ in rows:
                for i in range(0, len(ids_), CHUNK_IDS):
                    yield _rows([(*key, ids_[i], ",".join(map(str, ids_[i:i + CHUNK_IDS])))], [*KEY, "first", "text"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, done = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                now = tuple(row[c] for c in KEY)
                if now != key:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = now, hashlib.sha256(row["text"].encode())
                else:
                    sha.update(b"," + row["text"].encode())
            if len(done) >= 4096:
                yield _rows(done, [*KEY, "ends_sha256"])
                done = []
        if key is not None:
            yield _rows([*done, (*key, sha.hexdigest())], [*KEY, "ends_sha256"])

    def _rows(rows, names):
        kinds = {"text": pa.string(), "ends_sha256": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(n, pa.int64())) for x, n in zip(zip(*rows), names)], names=names)

    def _groups(batches):
        """Runs of equal keys inside a batch, with their ids."""
        for batch in batches:
            at, cols = 0, [batch.column(c).to_numpy() for c in KEY]
            ids_ = batch.column("conv_id").to_pylist()
            for i in range(1, len(ids_) + 1):
                if i == len(ids_) or any(c[i] != c[at] for c in cols):
                    yield [(tuple(int(c[at]) for c in cols), ids_[at:i])]
                    at = i

    texts = (ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
             .mapInArrow(joined, "depth long, k1 long, k2 long, first long, text string"))
    return (texts.repartition(*KEY).sortWithinPartitions(*KEY, "first")
            .mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the rebuilt conversations' trie."""
    sequences, ids = rebuilt(materialize(turns(conversations)))
    walked = materialize(paths(sequences))
    nodes = nodes_of(walked, ids)
    arcs, about = (materialize(x) for x in tour(nodes))
    found = nodes.join(subtree_sums(nodes, arcs, about), "node").join(ends_digest(walked, ids), KEY, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
       FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS ts FROM t GROUP BY conv_id),
-- the CRC-32 of the id's decimal digits, bit by bit
h AS (SELECT conv_id, ts, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                 lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)::BIGINT)), 4294967295::BIGINT) % 4 AS h FROM l),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN l b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, ts[1:d] AS path, d, d = len(ts) AS ends FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM r)),
n AS (SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
      CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[-1].t, '[^\x20\x09-\x0D]+')) END AS words FROM p GROUP BY path, d),
k AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.path = n.path AND k.depth = n.depth),
s AS (SELECT path[1:e] AS path, e AS depth, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
      FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM f) GROUP BY ALL)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.path = f.path AND s.depth = f.depth LEFT JOIN n u ON u.path = f.path[1:f.depth - 1] AND u.depth = f.depth - 1
"""
