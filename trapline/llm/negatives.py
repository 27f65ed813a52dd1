"""Hard-negative mining (12): exact search filtered by summaries of vector segments.

Of every segment of a vector its mean and its deviation (the length of what is left
without the mean) are stored.  For two vectors the sum over segments of
length * mean * mean, plus or minus deviation * deviation, bounds their inner product.
Four segments merge to one of the next coarser level.  Pairs are bounded at the coarsest
level first; those that can still be among the first, and inside the wanted range of
scores, are bounded at the next, and what is left is scored exactly.

1. An index table: integer components, finest summaries, a number a row.
2. Anchors (the query set) meet all rows in tiles of bounded numbers of both; every
   anchor's best rows of its label are kept per tile, merged by a window whose limit
   Spark applies before the exchange.  In a tile the lower bounds, later the scores
   found, raise the score that a row must reach.
3. The same with the rows of other labels, for the ranges that the positives give.

The work grows with anchors times rows, as the query asks; rows and anchors travel once
for each group of the others.

Defined cases: rows with a null label or vector, or a null, NaN or infinite component take
no part; of vectors of unequal lengths the shorter counts as filled up with zeros; empty
vectors score 0; components beyond 2^24 after scaling are held there; rows without an id
are no anchors and come last among equal scores; rows that share id and score with regard
to an anchor count once, and rows with an anchor's id are never its positives; anchors
repeated with the same label and vector count once; a negative positive score admits no
negative; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trapline.llm.tables import materialize, table

SCALE = 256
BOUND = 1 << 24
SEGMENT = 4        # components of a finest segment
MERGE = 4          # segments that merge to one of the next level
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100       # percent of the positive's score
ROWS_A_TILE = 1 << 16
ANCHORS_A_TILE = 1 << 14
ANCHORS_AT_ONCE = 128
ROWS_AT_ONCE = 4096
DENSE = 0.1        # share of pairs above which all are computed by one matrix product
_INDEX = "vec_id long, label long, vec binary, summary binary"


def index(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, vec, summary) of the rows that take part; summary holds the means, then the deviations."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & fine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, sums = [], []
            v = batch.column(2)
            lengths = np.diff(v.offsets.to_numpy())
            flat = np.clip(np.floor(SCALE * v.flatten().to_numpy(zero_copy_only=False)), -BOUND, BOUND).astype(np.int32)
            for x in np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []:
                vecs.append(x.tobytes())
                sums.append(_summary(x).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vecs, pa.binary()), pa.array(sums, pa.binary())],
                                             names=["vec_id", "label", "vec", "summary"])

    return materialize(rows.mapInArrow(run, _INDEX).withColumn("row", F.monotonically_increasing_id()))


def _summary(x: np.ndarray) -> np.ndarray:
    parts = np.zeros(-(-len(x) // SEGMENT) * SEGMENT)
    parts[:len(x)] = x
    parts = parts.reshape(-1, SEGMENT)
    mean = parts.mean(axis=1)
    return np.concatenate((mean, np.sqrt(((parts - mean[:, None]) ** 2).sum(axis=1)))).astype(np.float32)


class Side:
    """Vectors of one side of a tile: ids, labels, components and the summaries' levels, coarsest first."""

    def __init__(self, rows: pa.Table):
        self.n = rows.num_rows
        ids = rows.column("vec_id")
        self.no_id = ids.is_null().to_numpy().astype(bool)
        self.ids = ids.fill_null(0).to_numpy()
        self.label = rows.column("label").to_numpy()
        self.vec = _matrix(rows.column("vec"), np.int32).astype(np.float64)
        halves = [np.frombuffer(x, np.float32) for x in rows.column("summary").to_pylist()]
        self.mean = _padded([h[:len(h) // 2] for h in halves])
        self.dev = _padded([h[len(h) // 2:] for h in halves])

    def widen(self, width: int, segments: int) -> None:
        """Zeros up to common widths, and all levels."""
        self.vec = _wide(self.vec, width)
        self.levels = [(SEGMENT, _wide(self.mean, segments), _wide(self.dev, segments))]
        while self.levels[0][1].shape[1] > 1:
            length, mean, dev = self.levels[0]
            fill = -(-mean.shape[1] // MERGE) * MERGE
            m, d = (_wide(x, fill).reshape(self.n, -1, MERGE) for x in (mean, dev))
            centre = m.mean(axis=2)
            spread = (d ** 2).sum(axis=2) + length * ((m - centre[:, :, None]) ** 2).sum(axis=2)
            self.levels.insert(0, (length * MERGE, centre, np.sqrt(spread)))
        self.norm = np.sqrt((self.vec ** 2).sum(axis=1))


def _matrix(column, kind) -> np.ndarray:
    return _padded([np.frombuffer(x, kind) for x in column.to_pylist()])


def _padded(rows: list[np.ndarray]) -> np.ndarray:
    width = max((len(r) for r in rows), default=0)
    if all(len(r) == width for r in rows):
        return np.array(rows, dtype=np.float64).reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for o, r in zip(out, rows):
        o[:len(r)] = r
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def sides(anchors: pa.Table, rows: pa.Table) -> tuple[Side, Side]:
    us, them = Side(anchors), Side(rows)
    for side in (us, them):
        side.widen(max(us.vec.shape[1], them.vec.shape[1]), max(us.mean.shape[1], them.mean.shape[1], 1))
    return us, them


def _products(a: np.ndarray, b: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Inner products of the pairs: by one matrix product, or pair by pair where few are left."""
    i, j = pairs
    if len(i) > DENSE * len(a) * len(b):
        return (a @ b.T)[i, j]
    return np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", a[i[k:k + 65536]], b[j[k:k + 65536]]) for k in range(0, len(i), 65536)]])


def bounds(us: Side, a: np.ndarray, them: Side, r: np.ndarray, level: int, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the pairs' inner products at a level, with room for rounding."""
    length, m, d = us.levels[level]
    _, m2, d2 = them.levels[level]
    centre = length * _products(m[a], m2[r], pairs)
    room = _products(d[a], d2[r], pairs) + 1e-6 * us.norm[a][pairs[0]] * them.norm[r][pairs[1]] + 0.01
    return centre - room, centre + room


def scores(us: Side, a: np.ndarray, them: Side, r: np.ndarray, pairs) -> np.ndarray:
    one, two = us.vec[a], them.vec[r]
    most = np.abs(one).max(initial=0) * np.abs(two).max(initial=0) * max(one.shape[1], 1)
    if most < 2 ** 53:  # whole numbers stay exact in doubles
        return np.rint(_products(one, two, pairs)).astype(np.int64)
    one, two = one.astype(np.int64), two.astype(np.int64)
    return np.array([int((one[i] * two[j]).sum()) for i, j in zip(*pairs)], np.int64)


def reachable(us: Side, a: np.ndarray, them: Side, r: np.ndarray, eligible: np.ndarray, low: np.ndarray, high: np.ndarray, first: int = 0):
    """(anchor place, row place, score) of the eligible pairs inside [low, high], refining bounds level by level.

    With ``first``, an anchor's low is raised to its first-th largest lower bound.
    """
    pairs = np.nonzero(eligible)
    for level in range(len(us.levels)):
        if not len(pairs[0]):
            break
        lo, hi = bounds(us, a, them, r, level, pairs)
        if first and level == 0 and len(r) > first:
            floor = np.full(eligible.shape, -np.inf)
            floor[pairs] = lo
            low = np.maximum(low, -np.partition(-floor, first - 1, axis=1)[:, first - 1])
        keep = (hi >= low[pairs[0]]) & (lo <= high[pairs[0]])
        pairs = (pairs[0][keep], pairs[1][keep])
    found = scores(us, a, them, r, pairs)
    keep = (found >= low[pairs[0]]) & (found <= high[pairs[0]])
    return pairs[0][keep], pairs[1][keep], found[keep]


def _best(score: np.ndarray, no_id: np.ndarray, ids: np.ndarray, k: int):
    """The first k distinct (score, id) by falling score, then id, rows without one last."""
    order = np.lexsort((ids, no_id, -score))
    score, no_id, ids = score[order], no_id[order], ids[order]
    new = np.ones(len(score), bool)
    new[1:] = (score[1:] != score[:-1]) | (no_id[1:] != no_id[:-1]) | (ids[1:] != ids[:-1])
    return score[new][:k], no_id[new][:k], ids[new][:k]


def _join(one, two):
    return tuple(np.concatenate(x) for x in zip(one, two))


_NOTHING = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))


def _positives(us: Side, them: Side):
    """(anchor place, scores, no_id, ids): the best rows of the anchor's label."""
    for label in np.unique(us.label):
        mine, rows = np.flatnonzero(us.label == label), np.flatnonzero(them.label == label)
        for at in range(0, len(mine), ANCHORS_AT_ONCE):
            a = mine[at:at + ANCHORS_AT_ONCE]
            best, low, high = [_NOTHING] * len(a), np.full(len(a), -np.inf), np.full(len(a), np.inf)
            for start in range(0, len(rows), ROWS_AT_ONCE):
                r = rows[start:start + ROWS_AT_ONCE]
                eligible = them.no_id[r] | (us.ids[a][:, None] != them.ids[r])
                apart = len(np.unique(them.ids[r])) == len(r)  # else rows that count once would raise the bound
                i, j, s = reachable(us, a, them, r, eligible, low, high, POSITIVES if apart else 0)
                for k in np.unique(i):
                    here = i == k
                    best[k] = _best(*_join(best[k], (s[here], them.no_id[r[j[here]]], them.ids[r[j[here]]])), POSITIVES)
                    low[k] = best[k][0][-1] if len(best[k][0]) == POSITIVES else -np.inf
            yield from ((a[k], *best[k]) for k in range(len(a)))


def _negatives(us: Side, them: Side, cuts: list[np.ndarray]):
    """(anchor place, number of the positive, scores, no_id, ids): the best rows of other labels in the positive's range."""
    floors = [-(-LOW * c // HIGH) for c in cuts]
    for at in range(0, us.n, ANCHORS_AT_ONCE):
        a = np.arange(at, min(at + ANCHORS_AT_ONCE, us.n))
        best = [[_NOTHING] * len(cuts[x]) for x in a]
        reach = [np.maximum(floors[x], 0).astype(float) for x in a]  # what a score must reach for each positive
        high = np.array([cuts[x].max(initial=-1) for x in a], float)
        for start in range(0, them.n, ROWS_AT_ONCE):
            r = np.arange(start, min(start + ROWS_AT_ONCE, them.n))
            low = np.array([x.min(initial=np.inf) for x in reach])
            i, j, s = reachable(us, a, them, r, us.label[a][:, None] != them.label[r], low, high)
            for k in np.unique(i):
                here = i == k
                found = (s[here], them.no_id[r[j[here]]], them.ids[r[j[here]]])
                for p, cut in enumerate(cuts[a[k]]):
                    fits = (found[0] <= cut) & (found[0] >= reach[k][p])
                    if fits.any():
                        best[k][p] = _best(*_join(best[k][p], tuple(x[fits] for x in found)), NEGATIVES)
                        if len(best[k][p][0]) == NEGATIVES:
                            reach[k][p] = max(reach[k][p], best[k][p][0][-1])
        yield from ((a[k], p, *b) for k in range(len(a)) for p, b in enumerate(best[k]))


def tiles(anchors: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """Every anchor with every row, in tiles of bounded numbers of both."""
    parts = max(-(-rows.count() // ROWS_A_TILE), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = max(-(-anchors.count() // ANCHORS_A_TILE), 1)

    def deal(df: DataFrame, number: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64(number), F.lit(n)))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))))

    us = deal(anchors, "anchor", "group", groups, "part", parts).groupBy("part", "group")
    them = deal(rows, "row", "part", parts, "group", groups).groupBy("part", "group")
    return us.cogroup(them).applyInArrow(run, schema)


def _rows(us_ids: np.ndarray, found, numbered: bool) -> pa.Table:
    """One row a result: anchor, the positive's number if numbered, vec_id, score."""
    anchor, number, score, no_id, ids = [], [], [_NOTHING[0]], [_NOTHING[1]], [_NOTHING[2]]
    for item in found:
        a, p, (s, none, i) = item[0], item[1] if numbered else 0, item[-3:]
        anchor += [us_ids[a]] * len(s)
        number += [p + 1] * len(s)
        score.append(s)
        no_id.append(none)
        ids.append(i)
    cols = {"anchor": pa.array(anchor, pa.int64()), "number": pa.array(number, pa.int64()),
            "vec_id": pa.array(np.concatenate(ids), pa.int64(), mask=np.concatenate(no_id)), "score": pa.array(np.concatenate(score))}
    return pa.table(cols if numbered else {k: v for k, v in cols.items() if k != "number"})


def best_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k distinct (score, vec_id) of the keys, with their rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).dropDuplicates([*keys, "rank"])


def hard_negatives(vectors: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over (vec_id, embedding, label)."""
    rows = index(vectors)
    us = rows.where("vec_id % 100 = 0") if anchors is None else rows.join(anchors.select("vec_id").distinct(), "vec_id", "left_semi")
    us = us.dropDuplicates(["vec_id", "label", "vec"]).drop("row").withColumn("anchor", F.monotonically_increasing_id())
    us = materialize(us)

    def positives(mine: pa.Table, all_: pa.Table) -> pa.Table:
        one, two = sides(mine, all_)
        return _rows(mine.column("anchor").to_numpy(), _positives(one, two), False)

    def negatives(mine: pa.Table, all_: pa.Table) -> pa.Table:
        one, two = sides(mine, all_)
        cuts = [np.array(c, np.int64) for c in mine.column("cuts").to_pylist()]
        return _rows(mine.column("anchor").to_numpy(), _negatives(one, two, cuts), True)

    found = tiles(us, rows, positives, "anchor long, vec_id long, score long")
    near = materialize(best_of(found, ["anchor"], POSITIVES).withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score", "rank": "number"}))
    cuts = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("number", "positive_score"))).alias("p"))  # POSITIVES rows at most
    asking = materialize(us.join(cuts, "anchor").withColumn("cuts", F.col("p.positive_score")).drop("p"))
    found = tiles(asking, rows, negatives, "anchor long, number long, vec_id long, score long")
    hard = best_of(found, ["anchor", "number"], NEGATIVES)
    return (hard.join(near, ["anchor", "number"]).join(us.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


OP12_SQL = r"""
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY rank <= 5
"""
