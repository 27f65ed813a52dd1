"""Distributed list ranking: how far each element of a linked list is from its end."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm.tables import materialize

GAP = 16        # one element in so many is a stop of the next, shorter list
LAST = 1 << 14  # a list of at most so many elements is ranked in one task


def ranked(links: DataFrame) -> DataFrame:
    """(id, rank) of (id, next, dist): the sum of ``dist`` from an element to the list's end; ``next`` of the last is null.

    One element in GAP, chosen by a hash of its id, is a stop.  All elements jump ahead at
    once, each time by their target's own jump, until they are at a stop or the end: about
    log2(GAP * ln(n)) joins on unique ids.  The stops are a list GAP times as short, ranked
    the same way, and each element adds its stop's rank.  Only row counts reach the driver.
    """
    return _ranked(materialize(links.select("id", "next", F.col("dist").cast("long").alias("dist"))), 0)


def _ranked(links: DataFrame, level: int) -> DataFrame:
    if links.count() <= LAST:
        return links.coalesce(1).mapInArrow(_in_one_task, "id long, rank long")

    def stop(x: str) -> Column:
        return F.pmod(F.xxhash64(x, F.lit(level)), F.lit(GAP)) == 0

    going = F.col("next").isNotNull() & ~stop("next")
    state = links
    while state.where(going).limit(1).count():
        ahead = state.where(~stop("id")).select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("dist").alias("more"))
        jumped = state.where(going).join(ahead, "next").select("id", F.col("then").alias("next"), (F.col("dist") + F.col("more")).alias("dist"))
        state = materialize(state.where(~going).union(jumped))
    stops = materialize(_ranked(materialize(state.where(stop("id"))), level + 1))
    at = stops.select(F.col("id").alias("next"), F.col("rank").alias("more"))
    return state.join(at, "next", "left").select("id", (F.col("dist") + F.coalesce("more", F.lit(0))).alias("rank"))


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = list(batches)  # at most LAST rows
    if not sum(b.num_rows for b in rows):
        return
    table = pa.Table.from_batches(rows)
    ids = table.column("id").to_numpy()
    order = np.argsort(ids)
    ids, dist = ids[order], table.column("dist").to_numpy()[order].copy()
    end = len(ids)  # stands for the place after the last element
    next_ = table.column("next").to_pandas().fillna(-1).to_numpy(np.int64)[order]
    at = np.where(next_ < 0, end, np.searchsorted(ids, next_))
    at, dist = np.append(at, end), np.append(dist, 0)
    while (at < end).any():
        dist, at = dist + dist[at], at[at]
    yield pa.RecordBatch.from_pydict({"id": ids, "rank": dist[:-1]})
