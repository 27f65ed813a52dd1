"""MinHash near-dedup (11): bottom-k sketches from one hash function.

A document is its set of distinct 2-word shingles (64-bit hashes, one function).  Its
sketch is the SKETCH smallest.  Equal sets are one class and are never compared.

1. Inverted lists of retained values generate overlaps.  Two sets of Jaccard at least
   4/5 share at least SHARED of the SKETCH smallest values of their union (see below), all
   of them in both sketches; so they share at least MEET of the values that are left when
   each sketch drops its SHARED - MEET most frequent values, and only those are listed.
   The most frequent values, a table of bounded size, come last in that order in a
   task's memory; the order is right in any form.
2. A set meets a list's leader (its smallest class number) if that leads LED of its
   lists.  Found links are contracted to components.
3. Sets of one list that are still in different components meet.  More than SHORT_LIST sets
   of one component (a large group of near copies) are their list's hub; the others, or all
   sets if there is no hub, are its rest, short up to SHORT_LIST sets.  In a list that a pair
   shares, both are of the rest or one is of the hub.  So of MEET lists the two share
   TWO long rests, or HUB_LISTS where one is of the hub, or MEET - TWO - HUB_LISTS + 2 short rests:
   * short rests: pairs of about equal size that share so many;
   * long rests: two values together have a list of their own, of the sets in both rests;
     a short one gives pairs.  Long ones (a text that many share) meet in blocks as below;
   * hubs: of HUB_LISTS lists most have one hub; sets in the rests of so many lists of
     one hub meet that component, in blocks of both inside tasks, and only links between
     components leave a block.
   A list that unrelated sets share grows with the table; no two of them meet for it alone.

A pair that meets is estimated by the union of the sketches (the share of the union's
SKETCH smallest values that both have) and verified by the whole sets if the estimate is at
least SHARED / SKETCH.  Whole sets are read for blocks and for pairs whose estimate passes.

What can be lost: a pair of Jaccard 0.8 or more whose shared values make up fewer than
28 of the 64 smallest of its union: by the binomial tail below 3e-9 a pair at exactly
0.8, and less above (64 or fewer distinct shingles in both: nothing, the sketch is the set).

Defined cases: null or empty texts have no shingles and link with nothing, not even each
other; a single word is its whole sequence; rows without an id belong to classes like
others and get the smallest id of the component (null if none has one); kept is then
false; repeated rows are equal sets; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm.components import components
from trapline.llm.tables import materialize, small, table
from trapline.llm.tokens import P, Slice, mix, shingles, slices, whole_groups

SHINGLE = 2
PERCENT = 80
SKETCH = 64
SHARED = 28        # of the union's SKETCH smallest values
MEET = 6           # values of the lists that a pair must share
LED = 4            # lists that a leader must lead for a set to meet it before others
RARE = 4           # a value of so many classes needs no place in the order
FREQUENT = 1 << 21 # values that the order may know; 9 bytes each in a task
SHORT_LIST = 32    # sets of a list that meet as pairs
TWO = 2            # long rests that a pair shares to meet in a list of two values
HUB_LISTS = 3      # lists with one of a pair in the hub; two or more of them have the same hub
BLOCK_SETS = 1024  # sets on either side of a block
BLOCK_SHINGLES = 1 << 19  # their shingles, 8 bytes each
#: Sizes n_a and n_b of two sets that can link.
FIT = f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)"
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def sets(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, with text numbers; per text two keys of the set and its size."""
    low = part.lower()
    starts, ends, of = low.words()
    value, of, _ = shingles(low.hashes(starts, ends), of, len(part), SHINGLE)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    size = np.bincount(of, minlength=len(part))
    last = np.cumsum(size)

    def key(salt: int) -> np.ndarray:
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value * P + np.uint64(salt)), dtype=np.uint64)))
        return mix(total[last] - total[last - size] + size.astype(np.uint64)).view(np.int64)

    return value, of, key(1), key(2), size


def _lists(value: np.ndarray, size: np.ndarray) -> pa.Array:
    """Binary column of consecutive runs of 64-bit values."""
    offsets = np.concatenate(([0], np.cumsum(size * 8))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(value))]).cast(pa.binary())


def _arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, k1, k2, n, sketch): every row with its set's keys, size and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                value, of, k1, k2, n = sets(part)
                first = np.cumsum(n) - n
                least = value[np.arange(len(of)) - first[of] < SKETCH]
                a, b = int(part.rows[0]), len(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b), batch.column(2).slice(a, b), pa.array(k1), pa.array(k2), pa.array(n.astype(np.int64)),
                     _lists(least, np.minimum(n, SKETCH))], names=["doc_id", "rid", "k1", "k2", "n", "sketch"])

    return (docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("rid"))
            .mapInArrow(run, "doc_id long, rid long, k1 long, k2 long, n long, sketch binary"))


def frequencies(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent retained values, ascending, and log2 of their numbers of classes: FREQUENT values at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                value = np.concatenate(_arrays(batch.column(0).slice(at, 2048)))
                yield pa.RecordBatch.from_pydict({"value": value.view(np.int64)})

    counts = classes.select("sketch").mapInArrow(run, "value long").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.where(F.col("n") > RARE).select("value", F.floor(F.log2("n")).cast("byte").alias("level")))
    least, total = 127, 0
    for level, n in sorted(counts.groupBy("level").count().collect(), reverse=True):  # a row a power of two
        total += n
        if total > FREQUENT:
            break
        least = level
    got = counts.where(F.col("level") >= least).toPandas()
    value, level = got["value"].to_numpy(np.int64).view(np.uint64), got["level"].to_numpy(np.int8)
    order = np.argsort(value)
    return value[order], level[order]


def needed(n: np.ndarray) -> np.ndarray:
    """Retained values that a set of n shares with any set it links with: all shared ones if neither exceeds its sketch."""
    return np.where(100 * n <= PERCENT * SKETCH, -(-n * PERCENT // 100), SHARED)


def postings(classes: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(value, c, n): each class's retained values but for the most frequent, and its size."""
    shared = classes.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, level = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                c, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                size, need = np.minimum(n, SKETCH), needed(n)
                meet = np.minimum(need, MEET)
                value = np.concatenate(_arrays(part.column(2)))
                of = np.repeat(np.arange(len(c)), size)
                crowd = np.zeros(len(value), np.int8)
                if len(known):
                    found = np.minimum(np.searchsorted(known, value), len(known) - 1)
                    crowd = np.where(known[found] == value, level[found], crowd)
                order = np.lexsort((value, crowd, of))
                place = np.arange(len(of)) - (np.cumsum(size) - size)[of]
                keep = place < (size - need + meet)[of]
                yield pa.RecordBatch.from_pydict({"value": value[order][keep].view(np.int64), "c": c[of[keep]], "n": n[of[keep]]})

    return classes.select("c", "n", "sketch").mapInArrow(run, "value long, c long, n long")


def meet(n: Column) -> Column:
    """Listed values that a set of n shares with any set it links with: ``needed``, at most MEET."""
    return F.least(F.lit(MEET), F.ceil(n * PERCENT / 100))


def heads(sets_: list[np.ndarray]) -> np.ndarray:
    """The sketches of the sets as rows of one matrix, filled up with _NONE."""
    out = np.full((len(sets_), SKETCH), _NONE)
    for row, x in zip(out, sets_):
        x = x[:SKETCH]
        row[:len(x)] = x
    return out


def near_enough(both: np.ndarray) -> np.ndarray:
    """For two sketches side by side in each row whether their union's sketch has enough values that both have."""
    both = np.sort(both, axis=1)
    valid = both != _NONE
    new = valid.copy()
    new[:, 1:] &= both[:, 1:] != both[:, :-1]
    rank = np.cumsum(new, axis=1)
    same = (valid & ~new & (rank <= SKETCH)).sum(axis=1)
    return same * SKETCH >= SHARED * np.minimum(rank[:, -1], SKETCH)


def estimated(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """For each pair of sets whether the union sketch's estimate passes."""
    parts = [near_enough(np.hstack((heads(a[i:i + 4096]), heads(b[i:i + 4096])))) for i in range(0, len(a), 4096)]
    return np.concatenate([np.zeros(0, bool), *parts])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact Jaccard of two ascending sets against the threshold."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate((a, b)), kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= PERCENT * (len(both) - same)


def whole_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, shingles) of the wanted classes (c), read again from one document each (found by its hash, known by the set's keys)."""
    rows = classes.join(wanted, "c", "left_semi").select("rid", "c", "k1", "k2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                value, _, k1, k2, n = sets(part)
                c, one, two = (batch.column(i).to_numpy()[part.rows] for i in (0, 2, 3))
                same = pa.array((k1 == one) & (k2 == two))
                yield pa.RecordBatch.from_arrays([pa.array(c), _lists(value, n)], names=["c", "shingles"]).filter(same)

    texts = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "text").join(small(materialize(rows), 48), "rid")
    return texts.select("c", "text", "k1", "k2").mapInArrow(run, "c long, shingles binary").dropDuplicates(["c"])


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The written pairs (a, b) whose sizes allow a link and whose union-sketch estimate passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array(estimated(_arrays(batch.column(2)), _arrays(batch.column(3)))))

    pairs = small(pairs, 16)
    one, two = (classes.join(pairs, F.col("c") == F.col(s)).select("a", "b", F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"{s}_sketch")) for s in "ab")
    return one.join(two, ["a", "b"]).where(FIT).select("a", "b", "a_sketch", "b_sketch").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _arrays(batch.column(2)), _arrays(batch.column(3))
            yield batch.select([0, 1]).filter(pa.array([linked(*both) for both in zip(x, y)], pa.bool_()))

    one, two = (whole.select(F.col("c").alias(s), F.col("shingles").alias(f"{s}_shingles")) for s in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "a_shingles", "b_shingles").mapInArrow(run, "a long, b long")


def links_in_blocks(outside: DataFrame, inside: DataFrame, whole: DataFrame) -> DataFrame:
    """(a, b) links of (main, c, n, comp) sets outside a component with all inside (main, c, n, comp), compared in blocks."""
    count = lambda rows, name: rows.groupBy("main").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).alias(name))
    sizes = materialize(count(inside, "blocks").join(count(outside, "chunks"), "main"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    at = lambda n: F.pmod(F.xxhash64("c"), F.col(n))
    them = inside.join(sizes, "main").select("main", at("blocks").alias("block"), every("chunks").alias("chunk"), "c", "comp", F.lit(False).alias("asks"))
    us = outside.join(sizes, "main").select("main", every("blocks").alias("block"), at("chunks").alias("chunk"), "c", "comp", F.lit(True).alias("asks"))
    rows = them.union(us).withColumn("cell", F.xxhash64("main", "block", "chunk")).join(whole, "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "cell"):  # a cell has some 2 * BLOCK_SETS sets or 2 * BLOCK_SHINGLES shingles
            cells = group.column("cell").to_numpy()
            for cell in np.unique(cells):
                found = _block_links(group.filter(pa.array(cells == cell)))
                if found:
                    a, b = zip(*found)
                    yield pa.RecordBatch.from_pydict({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return (rows.select("cell", "c", "comp", "asks", "shingles").repartition("cell").sortWithinPartitions("cell")
            .mapInArrow(run, "a long, b long"))


def _block_links(rows: pa.Table) -> list[tuple[int, int]]:
    """Links that join components, found by comparing the asking sets with the others."""
    asks = rows.column("asks").to_numpy().astype(bool)
    c, comp, whole = rows.column("c").to_numpy(), rows.column("comp").to_numpy(), _arrays(rows.column("shingles"))
    them, us = np.flatnonzero(~asks), np.flatnonzero(asks)
    if not len(them) or not len(us):
        return []
    head, size = heads(whole), np.array([len(x) for x in whole])
    value = np.sort(head[them], axis=None)
    owner = them[np.argsort(head[them], axis=None, kind="stable") // SKETCH]
    root = {int(x): int(x) for x in comp}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    def meeting(mine: np.ndarray, value: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Numbers of values in common with each set."""
        lo, hi = np.searchsorted(value, mine, "left"), np.searchsorted(value, mine, "right")
        met = [owner[a:b] for a, b in zip(lo.tolist(), hi.tolist()) if b > a]
        return np.bincount(np.concatenate(met), minlength=len(whole)) if met else np.zeros(len(whole), np.int64)

    out, every = [], None
    for i in us:
        same = meeting(head[i][head[i] != _NONE], value, owner)
        near = (same >= needed(size[i:i + 1])[0]) & (100 * np.minimum(size, size[i]) >= PERCENT * np.maximum(size, size[i])) & (comp != comp[i])
        if not near.any():
            continue
        if every is None:  # all shingles of the others, and whose they are
            values = np.concatenate([whole[j] for j in them])
            order = np.argsort(values, kind="stable")
            every = values[order], np.repeat(them, size[them])[order]
        near &= (100 + PERCENT) * meeting(whole[i], *every) >= PERCENT * (size + size[i])
        near = np.flatnonzero(near)
        for j in near[near_enough(np.hstack((np.broadcast_to(head[i], (len(near), SKETCH)), head[near])))]:
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(c[i]), int(c[j])))
    return out


def ends(pairs: DataFrame) -> DataFrame:
    """The classes (c) of the pairs (a, b)."""
    return pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()


def side_by_side(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, c, n, comp) with those of the same key whose component differs and whose size is near enough: (a, n_a, of_a, b, n_b, of_b)."""
    one, two = (rows.select(key, *[F.col(x).alias(y) for x, y in (("c", s), ("n", f"n_{s}"), ("comp", f"of_{s}"))]) for s in "ab")
    return one.join(two, key).where(f"a < b AND of_a <> of_b AND {FIT}")


def meetings(members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of listed sets (value, c, n, comp) those of different components that meet: pairs (a, b), and for blocks those inside and outside a component (main, c, n, comp)."""
    tops = lambda rows, key: (rows.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("k")).groupBy(key)
                              .agg(F.sum("k").alias("size"), F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1"))
    hub = F.when(F.col("top.k") > SHORT_LIST, F.col("top.comp"))
    mixed = materialize(tops(members, "value").select("value", hub.alias("hub"), (F.col("size") - F.when(hub.isNotNull(), F.col("top.k")).otherwise(0)).alias("rest")))
    # short rests: sets of different components, as pairs that share enough of them
    in_rest = "hub IS NULL OR comp <> hub"
    short = members.join(mixed.where(F.col("rest").between(2, SHORT_LIST)), "value").where(in_rest)
    pairs = (side_by_side(short, "value").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.min(F.least("n_a", "n_b")).alias("n"))
             .where(F.col("k") >= meet(F.col("n")) - (TWO - 1) - (HUB_LISTS - 1)).select("a", "b"))
    # long rests: a list for every two values
    long = members.join(small(mixed.where(F.col("rest") > SHORT_LIST), 32), "value").where(in_rest)
    long = materialize(long.groupBy("c", "n", "comp").agg(F.sort_array(F.collect_list("value")).alias("values")).where(F.size("values") >= TWO))
    of_two = F.flatten(F.transform("values", lambda x, i: F.transform(F.slice("values", i + 2, F.size("values")), lambda y: F.xxhash64(x, y))))
    twos = long.select("c", "n", "comp", F.explode(of_two).alias("two"))
    shared = twos.groupBy("two").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    twos = materialize(twos.join(shared.select("two", "size"), "two"))
    pairs = pairs.union(side_by_side(twos.where(F.col("size") <= SHORT_LIST), "two").select("a", "b")).distinct()
    crowds = twos.where(F.col("size") > SHORT_LIST)
    crowds = crowds.join(tops(crowds, "two").select("two", F.col("top.comp").alias("main")), "two").select("main", "c", "n", "comp").distinct()
    # hubs: sets of the rests of enough lists with one hub
    hubs = members.join(small(mixed.where("hub IS NOT NULL").select("value", F.col("hub").alias("main")), 32), "value")
    rests = hubs.where("comp <> main").groupBy("main", "c", "n", "comp").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HUB_LISTS // 2).drop("k")
    crowds = materialize(crowds)
    outside = materialize(rests.union(crowds.where("comp <> main")).distinct())
    inside = hubs.where("comp = main").select("main", "c", "n", "comp").join(outside.select("main").distinct(), "main", "left_semi")
    return pairs, materialize(inside.union(crowds).distinct()), outside


def classes_and_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n, c, comp): every row, with its class of equal sets and the component of that."""
    rows = materialize(scan(docs))
    classes = (rows.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "rid")).alias("one"), F.first("n").alias("n"),
                                                           F.first("sketch").alias("sketch"))
               .select("k1", "k2", "one.rid", "n", "sketch", F.monotonically_increasing_id().alias("c")))
    classes = materialize(classes)
    found = materialize(postings(classes, frequencies(classes)))
    leads = found.groupBy("value").agg(F.min("c").alias("lead"), F.max("c").alias("hi")).where("lead <> hi").select("value", "lead")
    lists = materialize(found.join(leads, "value"))  # (value, c, n, lead)
    led = materialize(lists.where("c <> lead").groupBy(F.col("lead").alias("a"), F.col("c").alias("b"))
                      .agg(F.count(F.lit(1)).alias("k"), meet(F.max("n")).alias("meet")).where(f"k >= least(meet, {LED})").select("a", "b"))
    met = materialize(likely(led, classes))
    whole = materialize(whole_sets(docs, classes, ends(met)))
    labels = materialize(components(verified(met, whole))).withColumnsRenamed({"node": "c", "component": "comp"})

    members = materialize(lists.select("value", "c", "n").join(labels, "c", "left").withColumn("comp", F.coalesce("comp", "c")))
    across, inside, outside = meetings(members)
    across = materialize(likely(materialize(across.join(led, ["a", "b"], "left_anti")), classes))
    wanted = ends(across).union(inside.select("c")).union(outside.select("c")).distinct().join(whole, "c", "left_anti")
    whole = whole.union(materialize(whole_sets(docs, classes, wanted)))
    more = verified(across, whole).union(links_in_blocks(outside, inside, whole))
    labels = components(labels.select(F.col("c").alias("a"), F.col("comp").alias("b")).union(more)).withColumnsRenamed({"node": "c", "component": "comp"})
    named = classes.select("k1", "k2", "c").join(labels, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    return rows.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left").select("doc_id", "n", "c", "comp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text)."""
    rows = materialize(classes_and_components(docs))
    least = rows.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    own = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return (rows.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
