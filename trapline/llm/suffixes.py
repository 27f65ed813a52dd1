"""Suffix-array dedup (6): bytes covered by a 200-byte string that also starts elsewhere.

Finding out which texts can meet.  In every 200-byte string the least of its
50-byte grams (by hash, the leftmost of equals) depends on the string alone, so
equal strings have the same gram at the same place.  The consecutive starts whose
strings have one gram make a segment: the gram's hash, and the bytes from its first
start to 200 after its last one.  One exchange by gram hash brings the segments that
may hold equal strings together, without their bytes: a segment whose gram occurs
once is dropped; segments of the same hash of bytes are repeated whole.  Only where
a gram has different segments are bytes fetched, once for each different segment.

Suffix arrays.  Segments of a gram are laid into one block and its suffix array is
built by two-stage sorting: the suffixes smaller than their successors are sorted
directly (to 200 bytes), all others are induced by one scan over the first-byte
buckets; then the common prefixes of neighbours tell which 200-byte strings repeat.
Blocks hold whole gram lists of up to 1 MB; longer lists (a passage with as many
surroundings) are split by Spark instead: each string's 128-bit hash is grouped.

Defined cases: null and empty texts have no bytes; texts below 200 bytes lose
nothing; equal texts of 200 bytes or more repeat each other whole; matches never
cross documents; strings overlap freely and are judged on the input; null or
repeated ids do no harm (rows meet by their text); empty tables give empty
results; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm.tables import materialize, table
from trapline.llm.tokens import P, P_INV, Slice, mix, powers, slices, whole_groups

LENGTH = 200
GRAM = 50
BLOCK_BYTES = 1 << 19       # bytes that share one suffix array, at least
LONGEST_LIST = 1 << 20      # bytes of one gram's different segments in a suffix array, at most


def segments(part: Slice):
    """(text number, first start, bytes, gram hash, hash of the bytes) of the segments of a slice's texts."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    size = len(part.buf)
    if size < LENGTH:
        return none
    total = np.zeros(size + 1, np.uint64)
    np.cumsum((part.buf.astype(np.uint64) + np.uint64(1)) * powers(P, size), out=total[1:])
    back = powers(P_INV, size + 1)
    least = mix((total[GRAM:] - total[:-GRAM]) * back[:size - GRAM + 1])
    place = np.arange(len(least), dtype=np.int32)
    width, wanted = 1, LENGTH - GRAM + 1
    while width < wanted:  # the least gram of ever wider windows, and where it is
        step = min(width, wanted - width)
        right = least[step:] < least[:-step]
        least, place = np.where(right, least[step:], least[:-step]), np.where(right, place[step:], place[:-step])
        width += step
    start = np.arange(len(least))
    of = np.repeat(np.arange(len(part)), np.diff(part.offsets))[:len(least)]
    inside = start + LENGTH <= part.offsets[of + 1]
    start, place, of, least = start[inside], place[inside], of[inside], least[inside]
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    a, b = start[first], start[np.append(first[1:], len(start)) - 1] + LENGTH
    whole = mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return of[first], a - part.offsets[of[first]], b - a, least[first], whole


def text_key():
    return F.xxhash64(F.lit(6), "text").alias("tk")


def scan(docs: DataFrame) -> DataFrame:
    """(gram, whole, tk, span): all segments; span packs first start and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(0)):
                of, a, size, gram, whole = segments(part)
                yield pa.RecordBatch.from_pydict({"gram": gram.view(np.int64), "whole": whole.view(np.int64),
                                                  "tk": keys[part.rows][of], "span": (a << 32) | size})

    return docs.select("text", text_key()).mapInArrow(run, "gram long, whole long, tk long, span long")


def shared(found: DataFrame) -> DataFrame:
    """Segments whose gram occurs elsewhere, each once: (gram, whole, tk, span, again, first).

    ``again``: the same bytes are a segment elsewhere; ``first``: the first of equal ones.
    The sorted partitions are read as a stream: a list of any length takes no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, whole, tk, span = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            one, two = np.array([False]), np.array([False])
            if held is not None:
                gram, whole, tk, span = (np.concatenate(x) for x in zip(held[:4], (gram, whole, tk, span)))
                one, two = held[4:]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1]) | (tk[1:] != tk[:-1]) | (span[1:] != span[:-1])
            gram, whole, tk, span = gram[new], whole[new], tk[new], span[new]
            one = np.concatenate((one, gram[1:] == gram[:-1]))
            two = np.concatenate((two, (gram[1:] == gram[:-1]) & (whole[1:] == whole[:-1])))
            met, again = one.copy(), two.copy()
            met[:-1] |= one[1:]
            again[:-1] |= two[1:]
            held = tuple(x[-1:] for x in (gram, whole, tk, span, one, two))
            yield _batch(met[:-1], gram[:-1], whole[:-1], tk[:-1], span[:-1], again[:-1], ~two[:-1])
        if held is not None:
            yield _batch(held[4], *held[:4], held[5], ~held[5])

    def _batch(met, *columns):
        return pa.RecordBatch.from_arrays([pa.array(c[met]) for c in columns], names=["gram", "whole", "tk", "span", "again", "first"])

    return (found.repartition("gram").sortWithinPartitions("gram", "whole", "tk", "span")
            .mapInArrow(run, "gram long, whole long, tk long, span long, again boolean, first boolean"))


def suffix_array(block: bytes, depth: int = LENGTH) -> np.ndarray:
    """Suffix array of a block by two-stage sorting; suffixes are told apart to ``depth`` bytes."""
    b = np.frombuffer(block, np.uint8)
    n = len(b)
    # a suffix is smaller than its successor if the first byte that differs from the next one is smaller
    differs = np.flatnonzero(b[1:] != b[:-1])
    at = np.searchsorted(differs, np.arange(n))
    rises = np.append(b[1:] > b[:-1], False)
    smaller = np.append(rises[differs], False)[at]
    direct = np.flatnonzero(smaller)
    direct = direct[np.argsort(b[direct], kind="stable")]
    count = np.bincount(b[direct], minlength=256)
    ends, at = np.cumsum(np.bincount(b, minlength=256)), np.cumsum(count) - count
    out = np.full(n, -1, np.int64)
    for c in np.flatnonzero(count):  # the directly sorted fill the end of their buckets
        mine = sorted(direct[at[c]:at[c] + count[c]].tolist(), key=lambda i: block[i:i + depth])
        out[ends[c] - count[c]:ends[c]] = mine
    sa, heads, larger = out.tolist(), (ends - np.bincount(b, minlength=256)).tolist(), (~smaller).tolist()
    if n:  # the rest are induced: each larger suffix from its successor, bucket by bucket
        sa[heads[block[-1]]] = n - 1
        heads[block[-1]] += 1
    for s in sa:  # the list grows ahead of the scan
        if s > 0 and larger[s - 1]:
            c = block[s - 1]
            sa[heads[c]] = s - 1
            heads[c] += 1
    return np.array(sa, np.int64)


def common_prefixes(block: bytes, sa: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in the array, counted to ``depth``."""
    b = np.frombuffer(block + bytes(depth + 8), np.uint8)
    n = len(block)
    words = np.zeros(n + depth, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | b[k:k + n + depth]
    out, live = np.zeros(len(sa), np.int64), np.arange(1, len(sa))
    for at in range(0, depth, 8):
        x, y = words[sa[live] + at], words[sa[live - 1] + at]
        same = x == y
        differ = live[~same]
        if len(differ):
            bits = x[~same] ^ y[~same]
            out[differ] = at + sum((bits >> np.uint64(56 - 8 * k)) == 0 for k in range(8))
        live = live[same]
    out[live] = depth
    room = n - np.maximum(sa[1:], sa[:-1])
    out[1:] = np.minimum(out[1:], room)
    return out


def repeated_starts(block: bytes, starts: np.ndarray) -> np.ndarray:
    """Which of the ``starts`` have a 200-byte string that is also at another of them."""
    wanted = np.zeros(len(block), bool)
    wanted[starts] = True
    sa = suffix_array(block)
    sa = sa[wanted[sa]]  # in order; between two of them all share the prefix that both share
    equal = common_prefixes(block, sa) >= LENGTH
    same = equal.copy()
    same[:-1] |= equal[1:]
    out = np.zeros(len(block), bool)
    out[sa] = same
    return out[starts]


def _runs(tk: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Consecutive repeated starts of a text as (tk, from, to)."""
    order = np.lexsort((start, tk))
    tk, start = tk[order], start[order]
    new = np.ones(len(tk), bool)
    new[1:] = (tk[1:] != tk[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(tk)) - 1
    return pa.RecordBatch.from_pydict({"tk": tk[first], "from": start[first], "to": start[last] + LENGTH} if len(tk) else
                                      {"tk": np.zeros(0, np.int64), "from": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)})


def repeated_in_blocks(fetched: DataFrame) -> DataFrame:
    """(tk, from, to) repeated ranges of segments that aren't repeated whole, from (gram, again, tk, start, bytes)."""

    def block(tables: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(tables)
        parts = rows.column("bytes").to_pylist()
        size = np.array([len(p) for p in parts], np.int64)
        offset = np.cumsum(size) - size
        count = size - LENGTH + 1
        of = np.repeat(np.arange(len(parts)), count)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        hit = repeated_starts(b"".join(parts), offset[of] + inside)
        hit &= ~rows.column("again").to_numpy(zero_copy_only=False).astype(bool)[of]
        return _runs(rows.column("tk").to_numpy()[of[hit]], rows.column("start").to_numpy()[of[hit]] + inside[hit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in whole_groups(batches, "gram"):
            gram = rows.column("gram").to_numpy()
            after = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram))
            total = np.cumsum(pc.binary_length(rows.column("bytes")).to_numpy())
            first = 0
            for at in after.tolist():  # whole gram lists, as many as a block takes
                if size + total[at - 1] - (total[first - 1] if first else 0) >= BLOCK_BYTES or at == len(gram):
                    held.append(rows.slice(first, at - first))
                    size += int(total[at - 1] - (total[first - 1] if first else 0))
                    first = at
                if size >= BLOCK_BYTES:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return (fetched.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "tk long, `from` long, `to` long"))


def repeated_by_hash(fetched: DataFrame) -> DataFrame:
    """The same for gram lists of any length: 128-bit hashes of the strings, grouped by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(batch.schema.get_field_index("bytes"))):
                n = len(part.buf)
                of = np.repeat(np.arange(len(part)), np.diff(part.offsets) - LENGTH + 1)
                at = np.arange(len(of)) + of * (LENGTH - 1)
                both = []
                for base, back in ((P, P_INV), (P * P + np.uint64(2), None)):
                    back = back or np.uint64(pow(int(base), -1, 1 << 64))
                    total = np.zeros(n + 1, np.uint64)
                    np.cumsum((part.buf.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=total[1:])
                    both.append(mix((total[at + LENGTH] - total[at]) * powers(back, n + 1)[at]).view(np.int64))
                take = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)[part.rows][of]
                yield pa.RecordBatch.from_pydict({"x": both[0], "y": both[1], "tk": take("tk"), "start": take("start") + at - part.offsets[of],
                                                  "again": take("again")})

    strings = fetched.mapInArrow(run, "x long, y long, tk long, start long, again boolean")
    seen = strings.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x", "y")
    return strings.where("NOT again").join(seen, ["x", "y"], "left_semi").select("tk", F.col("start").alias("from"), (F.col("start") + LENGTH).alias("to"))


def repeated_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tk, from, to): ranges of bytes covered by repeated strings; and (tk, rid, copies): the different texts."""
    rid = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("rid")
    texts = materialize(docs.select(text_key(), rid).groupBy("tk").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies")))
    met = materialize(shared(scan(docs)))
    start, size = F.shiftright("span", 32).alias("start"), F.col("span").bitwiseAND(0xFFFFFFFF).cast("int").alias("size")
    whole = met.where("again").select("tk", start.alias("from"), (F.shiftright("span", 32) + F.col("span").bitwiseAND(0xFFFFFFFF)).alias("to"))
    lists = (met.where("first").groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"),
                                                    F.min(F.col("again").cast("int")).alias("all_again"))
             .where("n > 1 AND all_again = 0"))
    lists = materialize(lists.select("gram", (F.col("bytes") > LONGEST_LIST).alias("long_list")))
    asked = (met.where("first").join(lists, "gram").join(texts, "tk")
             .select("rid", "tk", F.struct("gram", "again", "long_list", start, size).alias("s")).groupBy("rid", "tk").agg(F.collect_list("s").alias("s")))
    read = (docs.select(rid, text_key(), F.col("text").cast("binary").alias("text")).join(asked, ["rid", "tk"])
            .select("tk", "text", F.explode("s").alias("s"))
            .select("tk", "s.gram", "s.again", "s.long_list", "s.start", F.expr("substring(text, cast(s.start AS int) + 1, s.size)").alias("bytes")))
    fetched = materialize(read)
    ranges = whole.union(repeated_in_blocks(fetched.where("NOT long_list").select("gram", "again", "tk", "start", "bytes")))
    if not lists.where("long_list").isEmpty():
        ranges = ranges.union(repeated_by_hash(fetched.where("long_list").select("again", "tk", "start", "bytes")))
    return ranges, texts


def cut(docs: DataFrame) -> DataFrame:
    """``doc_id``, n_bytes, removed (array of from, to) and kept (the bytes left) of every row of (doc_id, text)."""
    ranges, texts = repeated_ranges(docs)
    # ranges of a text meet in one row: there are no more of them than bytes in the text
    mine = ranges.groupBy("tk").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    copies = texts.where("copies > 1").select("tk", F.lit(True).alias("copied"))
    asked = copies.join(mine, "tk", "full").select("tk", F.coalesce("copied", F.lit(False)).alias("copied"),
                                                   F.transform("ranges", lambda r: r["from"]).alias("starts"),
                                                   F.transform("ranges", lambda r: r["to"]).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept, sizes = [], [], []
            for _, text, copied, starts, ends in zip(*[c.to_pylist() for c in batch.columns]):
                text = text or b""
                sizes.append(len(text))
                if copied and len(text) >= LENGTH:
                    starts, ends = [0], [len(text)]
                out, left, at = [], [], 0
                for a, b in sorted(zip(starts or (), ends or ())):
                    if out and a <= out[-1][1]:
                        out[-1][1] = max(b, out[-1][1])
                    else:
                        out.append([a, b])
                for a, b in out:
                    left.append(text[at:a])
                    at = b
                kept.append(b"".join(left) + text[at:])
                removed.append([{"from": a, "to": b} for a, b in out])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()),
                                              pa.array(removed, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                                              pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    read = docs.select("doc_id", F.col("text").cast("binary").alias("text"), text_key()).join(asked, "tk", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (read.select("doc_id", "text", "copied", "starts", "ends")
            .mapInArrow(run, f"doc_id {kind}, n_bytes long, removed array<struct<`from`:long,`to`:long>>, kept binary"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    taken = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["to"] - r["from"])
    return got.select("doc_id", "n_bytes", taken.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS k
      FROM (SELECT r, x, unnest(range(0, CAST(length(x) // 2 AS BIGINT) - 199)) AS i FROM d WHERE length(x) >= 400)),
m AS (SELECT r, i FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, i, sum(CASE WHEN i - p <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS island
      FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM m)),
c AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, island),
q AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM c),
t AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail,
             string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM q JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head || substr(x, 2 * tail + 1), x))) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""
