"""N-gram Jaccard join (10): adaptive multi-match prefixes over word shingles.

Documents are sets of distinct 5-word shingles (64-bit hashes).  Equal sets are one
class and are never compared.  All shingles have one order: those of crowded
hash cells (counted over the whole corpus) last, by how crowded they are, else by
hash.  A link needs an overlap of at least t = ceil(3/4 n) for either side, so two
linked sets share at least m shingles among the first n - t + m of either, for any m.

Each set picks its own m: a longer prefix costs more postings, a larger m leaves
fewer candidates.  The expected cost (postings, and verification of the candidates
expected from the cells' counts) is weighed for a few m, from a smallest one that
depends on n only.  A pair is a candidate if it shares min(m, m') shingles in
prefixes of that depth.  Three steps keep this linear in the size of a group:

1. postings whose shingle no other set has are dropped, then sets with fewer
   postings left than any partner would have to share, and so on once more; of the
   sets left it is counted how many shingles another of them has, which bounds every
   overlap: sets below t go, and pairs below their t later;
2. in every remaining posting list all are verified against the list's leader (the
   set with the largest such part), and found links are contracted;
3. pairs of different components that still share enough are all verified. The sets
   that just miss their leader would meet all of its large group in all of their
   lists; they are compared with the group's whole sets instead, in blocks of both,
   by numpy, and only links between components leave a block. All other pairs come
   from the lists, which meet without their largest component. Two sets that were
   both verified against one leader can share no more than the smaller overlap with
   it and the smaller rest of what they share with anyone; pairs below their t by
   this bound go unverified.

Verification intersects the whole sets.  Cells are a fixed number of counters:
they only decide the order, which is right in any form.

Defined cases: null or empty texts have no shingles and link with nothing, not
even each other; a text of fewer than five words is its whole sequence; rows
without an id belong to classes like others and get the smallest id there is in
the component, else null; repeated rows are linked as equal sets; empty tables
give empty results; other columns are ignored by the join and carried by
``one_per_group``.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm.components import components
from trapline.llm.tables import materialize, packed, table, unpacked
from trapline.llm.tokens import P, Slice, mix, shingles, slices, whole_groups

SHINGLE = 5
WORD = r"[^\x20\x09-\x0D]"
PERCENT = 75
CELLS = 1 << 22       # counters of the order; one byte each where they are broadcast
BACKGROUND = 0.05     # share of uncrowded shingles expected to occur elsewhere
GROWTH = (1, 2, 4, 8)  # depths weighed, as multiples of the smallest
BLOCK_SETS = 256      # sets of a group, and sets that miss its leader, that are compared at a time
SALT_ROWS = 1 << 12   # a crowded shingle's postings are dealt out in parts of about this size


def sets(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (hash, text number), ascending, and per text the set's key and size."""
    low = part.lower()
    starts, ends, of = low.words()
    value, of, _ = shingles(low.hashes(starts, ends), of, len(part), SHINGLE)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    size = np.bincount(of, minlength=len(part))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value * P), dtype=np.uint64)))
    last = np.cumsum(size)
    key = mix(total[last] - total[last - size] + size.astype(np.uint64))
    return value, of, key.view(np.int64), size


def overlap_needed(n: np.ndarray) -> np.ndarray:
    return -(-n * PERCENT // 100)


def least_depth(n: np.ndarray) -> np.ndarray:
    """The depth m that suits a set of n shingles none of which is crowded."""
    m = np.round(np.cbrt(n.astype(float) ** 2 * BACKGROUND / 2)).astype(np.int64)
    return np.clip(m, 1, np.maximum(overlap_needed(n), 1))


def scan(docs: DataFrame) -> DataFrame:
    """One pass: rows of documents (kind 0: doc_id, rid, th, key, n) and of crowded cells (kind 1: cell, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            key, n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for part in slices(batch.column(1)):
                value, _, key[part.rows], n[part.rows] = sets(part)
                at, count = np.unique(value & np.uint64(CELLS - 1), return_counts=True)
                cells[at.astype(np.int64)] += count.astype(np.uint32)
            yield _rows(0, *[batch.column(i) for i in (0, 2, 3)], key, n)
        mean = cells.sum(dtype=np.int64) / CELLS
        at = np.flatnonzero(cells > mean + 6 * np.sqrt(mean) + 4)
        empty = pa.nulls(len(at), pa.int64())
        yield _rows(1, empty, empty, empty, at, cells[at])

    def _rows(kind, doc_id, rid, th, key, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int64)), doc_id, rid, th, pa.array(key), pa.array(n.astype(np.int64))],
                                          names=["kind", "doc_id", "rid", "th", "key", "n"])

    return (docs.select(F.col("doc_id").cast("long"), "text", _rid().alias("rid"), _text_hash().alias("th"))
            .mapInArrow(run, "kind long, doc_id long, rid long, th long, key long, n long"))


def _text_hash():
    return F.xxhash64("text")


def _rid():
    """A row's id for the joins: its doc_id, or a hash of the text where that is null."""
    return F.coalesce(F.col("doc_id").cast("long"), _text_hash())


def crowding(cells: DataFrame) -> np.ndarray:
    """For each cell log2 of its count if some task found it crowded, else 0: CELLS bytes, whatever the corpus."""
    got = cells.groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, np.uint8)
    out[got["key"].to_numpy(np.int64)] = np.log2(got["n"].to_numpy(float)).astype(np.uint8)
    return out


def prefixes(value, of, n, level):
    """Postings of the sets' prefixes: (row of value, text number, m of the text, depth at which the shingle counts, level)."""
    crowd = level[(value & np.uint64(CELLS - 1)).astype(np.int64)]
    order = np.lexsort((value, crowd, of))
    crowd, of = crowd[order], of[order]  # of is unchanged: it was ascending
    first = np.concatenate(([0], np.cumsum(n)))
    other = np.where(crowd > 0, 2.0 ** crowd, 1.0) - 1 + BACKGROUND
    total = np.concatenate(([0.0], np.cumsum(other)))
    t = overlap_needed(n)
    best, cost = np.zeros(len(n), np.int64), np.full(len(n), np.inf)
    for g in GROWTH:
        m = np.minimum(least_depth(n) * g, np.maximum(t, 1))
        p = np.minimum(n - t + m, n)
        c = p + n * (total[first[:-1] + p] - total[first[:-1]]) / m.astype(float) ** 2
        best, cost = np.where(c < cost, m, best), np.minimum(c, cost)
    place = np.arange(len(of)) - first[of]
    spare = (n - t)[of]
    keep = place < np.minimum(spare + best[of], n[of])
    depth = np.maximum(place - spare + 1, 1)
    return order[keep], of[keep], best, depth[keep], crowd[keep]


def postings(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """(token, key, meta, level): the prefix postings of all sets; meta packs n, m and depth."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                value, of, key, n = sets(part)
                at, text, m, depth, crowd = prefixes(value, of, n, shared.value)
                meta = (n[text] << 32) | (np.minimum(m, 65535)[text] << 16) | np.minimum(depth, 65535)
                yield pa.RecordBatch.from_pydict({"token": value[at].view(np.int64), "key": key[text], "meta": meta,
                                                  "level": crowd.astype(np.int8)})

    return docs.select("text").mapInArrow(run, "token long, key long, meta long, level byte")


def shared_postings(found: DataFrame) -> DataFrame:
    """Postings (token, key, meta) whose token more than one set has, each once.

    One exchange by token.  The lists of crowded tokens, which may hold most sets,
    are dealt out in parts by the set's key; they count as shared anyway.
    """
    salted = F.col("level") > int(np.log2(SALT_ROWS))
    parts = F.pow(F.lit(2.0), F.col("level") - int(np.log2(SALT_ROWS))).cast("long")
    part = F.when(salted, F.xxhash64("token", F.pmod("key", parts))).otherwise(F.col("token"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last posting so far, and whether the one before has its token
        for batch in batches:
            if not batch.num_rows:
                continue
            token, key, meta, sure = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            before = np.array([False])
            if held is not None:
                token, key, meta, sure = (np.concatenate(x) for x in zip(held[:4], (token, key, meta, sure)))
                before = held[4]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            token, key, meta, sure = token[new], key[new], meta[new], sure[new]
            same = np.concatenate((before, token[1:] == token[:-1]))
            out = same.copy()
            out[:-1] |= same[1:]
            out |= sure
            held = tuple(x[-1:] for x in (token, key, meta, sure, same))
            yield _batch(token[:-1], key[:-1], meta[:-1], out[:-1])
        if held is not None:
            yield _batch(*held[:3], held[4] | held[3])

    def _batch(token, key, meta, out):
        return pa.RecordBatch.from_pydict({"token": token[out], "key": key[out], "meta": meta[out]})

    return (found.withColumn("sure", salted).repartition(part).select("token", "key", "meta", "sure")
            .sortWithinPartitions("token", "key").mapInArrow(run, "token long, key long, meta long"))


def peeled(lists: DataFrame) -> DataFrame:
    """Postings of sets that have at least as many left as any partner would have to share."""
    n = F.shiftright("meta", 32)
    small = F.ceil(n * PERCENT / 100)  # no partner is smaller, and the smallest depth grows with the size
    need = F.greatest(F.floor(F.cbrt(small * small * BACKGROUND / 2)), F.lit(1))
    need = F.least(need, F.greatest(F.ceil(small * PERCENT / 100), F.lit(1)))
    enough = (lists.groupBy("key").agg(F.count(F.lit(1)).alias("left"), F.first("meta").alias("meta"))
              .where(F.col("left") >= need).select("key"))
    kept = lists.join(enough, "key", "left_semi")
    tokens = kept.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("token")
    return kept.join(tokens, "token", "left_semi")


def bounded(lists: DataFrame, whole: DataFrame, level: np.ndarray) -> DataFrame:
    """Postings (token, key, meta, r) of sets that can have a link: r is how many of the set's shingles another set left has.

    Crowded shingles count as another's without a look (r may only be too large).
    """
    sure = int(np.log2(SALT_ROWS))
    shared = whole.sparkSession.sparkContext.broadcast(level > sure)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets_of = batch.column(0).to_numpy(), [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            for a in range(0, len(keys), 256):  # few sets at a time keep the output small
                part = sets_of[a:a + 256]
                value, of = np.concatenate(part), np.repeat(keys[a:a + 256], [len(x) for x in part])
                known = shared.value[(value & np.uint64(CELLS - 1)).astype(np.int64)]
                count = np.array([int(k.sum()) for k in np.split(known, np.cumsum([len(x) for x in part])[:-1])], np.int64)
                yield pa.RecordBatch.from_pydict({"token": np.concatenate((value[~known].view(np.int64), keys[a:a + 256])),
                                                  "key": np.concatenate((of[~known], keys[a:a + 256])),
                                                  "n": np.concatenate((np.zeros(int((~known).sum()), np.int64), count))})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            token, key, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            before = np.array([False])
            if held is not None:
                token, key, n = (np.concatenate(x) for x in zip(held[:3], (token, key, n)))
                before = held[3]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1]) | (n[1:] > 0)
            token, key, n = token[new], key[new], n[new]
            same = np.concatenate((before, (token[1:] == token[:-1]) & (key[1:] != key[:-1])))
            out = same.copy()
            out[:-1] |= same[1:]
            held = (token[-1:], key[-1:], n[-1:], same[-1:])
            yield _sums(key[:-1], np.where(n[:-1] > 0, n[:-1], out[:-1]))
        if held is not None:
            yield _sums(held[1], np.where(held[2] > 0, held[2], held[3]))

    def _sums(key, n):
        keys, at = np.unique(key, return_inverse=True)
        return pa.RecordBatch.from_pydict({"key": keys, "r": np.bincount(at, n, len(keys)).astype(np.int64)})

    rows = whole.select("key", "shingles").mapInArrow(spread, "token long, key long, n long")
    common = (rows.repartition(F.when(F.col("n") > 0, F.col("key")).otherwise(F.col("token"))).sortWithinPartitions("token", "key")
              .mapInArrow(count, "key long, r long").groupBy("key").agg(F.sum("r").alias("r")))
    n = F.shiftright("meta", 32)
    return lists.join(common, "key").where(100 * F.col("r") >= PERCENT * n)


def _can_link(x, xr, y, yr):
    """The sizes fit, and the smaller bound reaches the pair's overlap."""
    x, y = F.shiftright(x, 32), F.shiftright(y, 32)
    return ((100 * F.least(x, y) >= PERCENT * F.greatest(x, y))
            & ((100 + PERCENT) * F.least(xr, yr) >= PERCENT * (x + y)))


def leader_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): every set of a posting list with the list's leader."""
    share = F.col("r") / F.shiftright("meta", 32)
    lead = lists.groupBy("token").agg(F.max(F.struct(share.alias("share"), "key", "meta", "r")).alias("top")).select(
        "token", F.col("top.key").alias("lead"), F.col("top.meta").alias("lead_meta"), F.col("top.r").alias("lead_r"))
    pairs = lists.join(lead, "token").where("key <> lead").where(_can_link(F.col("meta"), F.col("r"), F.col("lead_meta"), F.col("lead_r")))
    return pairs.select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct()


def leaders(lists: DataFrame, checked: DataFrame) -> DataFrame:
    """(key, hub, with_hub): the set, of those that a set was verified against, with which it shares most; often a leader its whole group has."""
    both = checked.select(F.col("a").alias("key"), F.col("b").alias("hub"), "same").union(
        checked.select(F.col("b").alias("key"), F.col("a").alias("hub"), "same"))
    # a set that led many is its own hub: it shares with itself all that it shares with anyone
    led = both.groupBy("hub").agg(F.count(F.lit(1)).alias("led"))
    best = (both.join(led, "hub").groupBy("key").agg(F.max(F.struct("led", "hub", "same")).alias("best"))
            .join(led.withColumnRenamed("hub", "key").withColumnRenamed("led", "own"), "key", "left"))
    r = lists.groupBy("key").agg(F.max("r").alias("r"))
    own = F.coalesce("own", F.lit(0)) > F.col("best.led")
    return best.join(r, "key").select("key", F.when(own, F.col("key")).otherwise(F.col("best.hub")).alias("hub"),
                                      F.when(own, F.col("r")).otherwise(F.col("best.same")).alias("with_hub"))


def clusters(lists: DataFrame, labels: DataFrame, hubs: DataFrame) -> DataFrame:
    """(key, component, hub, with_hub, cluster) of the sets left: a set alone belongs to the component of its leader."""
    rows = (lists.select("key").distinct().join(labels, "key", "left").join(hubs, "key", "left")
            .withColumn("alone", F.col("component").isNull()).withColumn("component", F.coalesce("component", "key")))
    lead = labels.select(F.col("key").alias("hub"), F.col("component").alias("of_hub"))
    return (rows.join(lead, "hub", "left").withColumn("cluster", F.when(F.col("alone"), F.coalesce("of_hub", "hub", "key")).otherwise(F.col("component")))
            .select("key", "component", "hub", "with_hub", "alone", "cluster"))


def links_in_clusters(members: DataFrame, whole: DataFrame) -> DataFrame:
    """(a, b): links that join components inside a cluster, found by comparing its sets that are alone with all of it, in blocks."""
    sizes = (members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if("alone").alias("alone_n"))
             .where("alone_n > 0 AND n > 1")
             .select("cluster", F.ceil(F.col("n") / BLOCK_SETS).alias("blocks"), F.ceil(F.col("alone_n") / BLOCK_SETS).alias("chunks")))
    rows = members.select("key", "component", "alone", "cluster").join(sizes, "cluster")
    at = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    them = rows.select("cluster", at("blocks").alias("block"), every("chunks").alias("chunk"), "key", "component", F.lit(False).alias("asks"))
    us = rows.where("alone").select("cluster", every("blocks").alias("block"), at("chunks").alias("chunk"), "key", "component", F.lit(True).alias("asks"))
    both = them.union(us).join(whole, "key").select(F.xxhash64("cluster", "block", "chunk").alias("cell"), "cluster", "key", "component", "asks", "shingles")

    def compare(rows: pa.Table):
        asks = rows.column("asks").to_numpy().astype(bool)
        key, component = rows.column("key").to_numpy(), rows.column("component").to_numpy()
        texts = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        group, askers = np.flatnonzero(~asks), np.flatnonzero(asks)
        if not len(group):
            return
        token = np.concatenate([texts[i] for i in group])
        owner = np.repeat(np.arange(len(group)), [len(texts[i]) for i in group])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        size, top = np.array([len(texts[i]) for i in group]), {}

        def root(c):
            while top.get(c, c) != c:
                c = top[c]
            return c

        for i in askers:
            lo, hi = np.searchsorted(token, texts[i], "left"), np.searchsorted(token, texts[i], "right")
            n = hi - lo
            hit = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            same = np.bincount(owner[hit], minlength=len(group))
            for j in np.flatnonzero(100 * same >= PERCENT * (len(texts[i]) + size - same)).tolist():
                a, b = root(int(component[i])), root(int(component[group[j]]))
                if a != b:  # only what joins components in this block
                    top[max(a, b)] = min(a, b)
                    yield int(key[i]), int(key[group[j]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "cell"):
            cell = rows.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            found = [p for x, y in zip(cuts, cuts[1:]) for p in compare(rows.slice(x, y - x))]
            yield pa.RecordBatch.from_pydict({"a": np.array([p[0] for p in found], np.int64), "b": np.array([p[1] for p in found], np.int64)})

    return both.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def other_pairs(lists: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): all pairs of different components and clusters that share min(m, m') postings of that depth."""
    lists = lists.join(members.drop("alone"), "key")
    mixed = lists.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    lists = materialize(lists.join(mixed, "token", "left_semi"))
    largest = (lists.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
               .groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("largest")))
    lists = materialize(lists.join(largest, "token"))
    x = lists.where("component <> largest").select("token", F.col("key").alias("a"), F.col("meta").alias("am"), F.col("r").alias("ar"),
                                                   F.col("component").alias("ac"), "largest", F.col("hub").alias("ah"), F.col("with_hub").alias("ai"), F.col("cluster").alias("au"))
    y = lists.select("token", F.col("key").alias("b"), F.col("meta").alias("bm"), F.col("r").alias("br"), F.col("component").alias("bc"),
                     F.col("hub").alias("bh"), F.col("with_hub").alias("bi"), F.col("cluster").alias("bu"))
    # what lies in a common hub, and what lies outside it
    most = F.least("ai", "bi") + F.least(F.col("ar") - F.col("ai"), F.col("br") - F.col("bi"))
    far = F.coalesce((F.col("ah") == F.col("bh")) & ((100 + PERCENT) * most < PERCENT * (F.shiftright("am", 32) + F.shiftright("bm", 32))), F.lit(False))
    m = lambda c: F.shiftright(c, 16).bitwiseAND(65535)
    depth = lambda c: F.col(c).bitwiseAND(65535)
    least = F.least(m("am"), m("bm"))
    pairs = (x.join(y, "token").where("ac <> bc AND au <> bu AND (bc = largest OR a < b)").where(~far).where(_can_link(F.col("am"), F.col("ar"), F.col("bm"), F.col("br")))
             .where((depth("am") <= least) & (depth("bm") <= least))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), least.alias("m")))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.first("m").alias("m")).where("k >= m").select("a", "b")


def read_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, shingles) of the sets in ``reps`` (rid, key): sorted 64-bit hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(0)):
                value, of, key, n = sets(part)
                last = np.cumsum(n)
                mine = np.flatnonzero(key == wanted[part.rows])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[mine]), pa.array([value[last[i] - n[i]:last[i]].tobytes() for i in mine], pa.binary())], names=["key", "shingles"])

    found = docs.select("text", _rid().alias("rid")).join(reps, "rid").select("text", "key")
    return found.mapInArrow(run, "key long, shingles binary")


def verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """(a, b, same, linked): the overlaps of the pairs' whole sets, and whether they are enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, overlap = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in (2, 3))
                both = np.concatenate((x, y))
                both.sort(kind="stable")  # two ascending runs
                overlap[i] = same = int((both[1:] == both[:-1]).sum())
                hit[i] = 100 * same >= PERCENT * (len(both) - same)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(overlap), pa.array(hit)], names=["a", "b", "same", "linked"])

    one = whole.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    two = whole.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, same long, linked boolean")


def classes_and_components(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, th, key, n, component): every row with its class of equal sets and the component's smallest key."""
    scanned = materialize(scan(docs))
    rows = scanned.where("kind = 0").drop("kind")
    level = crowding(scanned.where("kind = 1"))
    lists = materialize(shared_postings(postings(docs, level)))
    lists = materialize(peeled(materialize(peeled(lists))))
    reps = rows.where("n > 0").join(lists.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("rid").alias("rid"))
    whole = materialize(read_sets(docs, reps))
    lists = materialize(bounded(lists, whole, level))
    checked = materialize(verified(leader_pairs(lists), whole))
    links = checked.where("linked").select("a", "b")
    labels = components(links).withColumnRenamed("node", "key")
    members = materialize(clusters(lists, labels, leaders(lists, checked)))
    inside = links_in_clusters(members, whole)
    across = verified(other_pairs(lists, members), whole).where("linked").select("a", "b")
    labels = components(links.union(inside).union(across)).withColumnRenamed("node", "key")
    return rows.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))


def joined(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text)."""
    rows = materialize(classes_and_components(docs))
    smallest = rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(smallest, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; rows without a word all stay."""
    rows = classes_and_components(docs.select("doc_id", "text")).where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull(), "rid", "th")).alias("first")
    kept = rows.groupBy("component").agg(first).select("first.rid", "first.th")
    some = packed(docs, rid=_rid(), th=_text_hash())
    has = F.coalesce(F.col("row")["text"].rlike(WORD), F.lit(False))
    # a repeated row is there once: the join has brought equal rows together already
    one = some.where(has).join(kept, ["rid", "th"], "left_semi").dropDuplicates(["rid", "th"])
    return one.unionByName(some.where(~has)).select(*unpacked(docs.columns))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY node) c USING (doc_id)
"""
