"""Substring dedup (4): fuzzy passages that repeat across documents, by collinear chaining.

Seeds: every 4-word shingle of a text.  They travel packed, a row for each slice of
texts and bucket of hashes; in a bucket seeds that one text alone has are dropped, and
each occurrence of another is matched with two leaders: the first occurrence in the list
(smallest text key), and the first of those with the same surroundings, known by the
smallest hash of the three seeds before and the three after.  In a large corpus nearly
every seed occurs in texts that share nothing else, so the list's leader says little;
copies of one passage, also changed ones, still have most surroundings in common and
lead each other.  A seed in any number of texts gives two matches a text at most.  Equal
texts are one text.  A seed is known by 40 bits beside its bucket, its surroundings by
24: a clash adds a candidate that the alignment rejects, or hides one place of a passage.
A task holds one bucket; their number grows with the bytes of the texts.

Chains: the matches of a text with one leader are points (place here, place there); of
a run on one diagonal every fourth one and the last.  They are chained in order of the
first coordinate with the score

    f(j) = seed length + max(0, max over i with smaller places of
           f(i) - gap cost * (distance here + distance there)),

where the inner maximum is a prefix maximum in a Fenwick tree over the second
coordinate.  A chain whose seeds cover fewer than 8 words is not aligned.

Alignment: between its anchors a chain is aligned word by word on the diagonals of
the neighbouring anchors, with one gap where they differ, and its ends are extended
while matches outweigh mismatches.  Aligned pieces need three equal words in four; where
one has fewer, or is shorter than a passage, the longest part around it that has them
is taken.
Pieces that follow each other in a text, with any leaders, make a passage; a passage
is reported if it has at least 45 words, with each piece's place in its leader.

Result: one row for each piece of a passage (text against leader; all texts with a
passage are linked through its leader) and one for each further copy of a text of 45
words or more.  Equal texts report their passages once, under the smallest id.

Defined cases: null, empty and short texts have no passages; matches inside one
document are ignored; repeated rows are copies; rows without an id have a null id in
the result; empty tables give empty results; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm.tables import materialize, table
from trapline.llm.tokens import each_group, mix, shingles, slices, whole_groups

SEED = 4             # words of a seed
MIN_COVER = 8        # words that the seeds of a chain cover
SEED_BITS = 40       # of a seed, beside its bucket's
CONTEXT_SEEDS = 3    # on either side of a seed
CONTEXT_BITS = 24
BUCKET_SEEDS = 1 << 21  # of a bucket, about
MIN_BUCKETS = 128
MIN_WORDS = 45       # of a passage
MIN_IDENTITY = 0.75  # equal words of an aligned piece
GAP = 0.1            # cost of a word of distance, in either text
SLACK = 24           # words around a chain that its alignment may extend into
JOIN = 5             # words between pieces of one passage
WORD = r"[^\x20\x09-\x0D]+"
ANCHORS = "tk long, ltk long, lo long, hi long, xs array<int>, ys array<int>"


def text_key():
    return F.xxhash64(F.lit(4), "text").alias("tk")


def buckets(docs: DataFrame) -> int:
    """Bits of the number of buckets: by the texts' bytes, at least as many as shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (max(MIN_BUCKETS, least, size // 6 // BUCKET_SEEDS) - 1).bit_length()


def surroundings(value: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each seed the smallest hash of its neighbours in its text (CONTEXT_BITS of it), itself left out."""
    least = np.full(len(value), np.uint64(0xFFFFFFFFFFFFFFFF))
    mixed = mix(value)
    for d in range(1, CONTEXT_SEEDS + 1):
        same = text[d:] == text[:-d]
        least[d:] = np.where(same, np.minimum(least[d:], mixed[:-d]), least[d:])
        least[:-d] = np.where(same, np.minimum(least[:-d], mixed[d:]), least[:-d])
    return mix(least) >> np.uint64(64 - CONTEXT_BITS)


def seeds(docs: DataFrame, bits: int) -> DataFrame:
    """(bucket, seeds, tks, counts, places): a slice's seeds of one bucket, in order of text and place.

    ``seeds`` has eight bytes a seed, in planes: five of the seed, three of its
    surroundings; ``places`` the steps between a text's places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(0)):
                starts, ends, of = part.words()
                count = np.bincount(of, minlength=len(part))
                value, text, first = shingles(part.hashes(starts, ends), of, len(part), SEED, short=False)
                if not len(value):
                    continue
                value_and_context = (value & np.uint64((1 << SEED_BITS) - 1)) | surroundings(value, text) << np.uint64(SEED_BITS)
                bucket = (value >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
                order = np.argsort(bucket, kind="stable")
                bucket, value, text = bucket[order], value_and_context[order], text[order]
                pos = first[order] - (np.cumsum(count) - count)[text]
                # a text's first place in a bucket, then steps
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1])
                step = pos.copy()
                step[1:] = np.where(new[1:], pos[1:], pos[1:] - pos[:-1])
                at = np.flatnonzero(new)
                size = np.diff(np.append(at, len(text)))
                tks, planes = keys[part.rows][text[at]], value.astype("<u8").view(np.uint8).reshape(-1, 8)
                cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
                heads = np.searchsorted(at, cuts).tolist()
                out = [(int(bucket[a]), np.ascontiguousarray(planes[a:b].T).tobytes(), tks[h:k].tobytes(), _bytes(size[h:k]), _bytes(step[a:b]))
                       for a, b, h, k in zip(cuts, cuts[1:], heads, heads[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))],
                                                 names=["bucket", "seeds", "tks", "counts", "places"])

    return docs.select("text", text_key()).mapInArrow(run, "bucket int, seeds binary, tks binary, counts binary, places binary")


def _bytes(values: np.ndarray) -> bytes:
    """Numbers as bytes; 255 and more as 255 and four bytes at the end."""
    large = values >= 255
    return np.where(large, 255, values).astype(np.uint8).tobytes() + values[large].astype("<u4").tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u4", offset=n)
    return out


def unpacked_seeds(packed: bytes, tks: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed and surroundings in one number, tk, pos) of one row of ``seeds``; the seed is in the upper bits."""
    n, keys = len(packed) // 8, np.frombuffer(tks, np.int64)
    count = _numbers(counts, len(keys))
    both = np.frombuffer(packed, np.uint8).reshape(-1, n).T.copy().view("<u8")[:, 0]
    both = both << np.uint64(CONTEXT_BITS) | both >> np.uint64(SEED_BITS)
    total = np.cumsum(_numbers(places, n))
    first = np.cumsum(count) - count
    before = np.concatenate(([0], total))[first]
    return both, np.repeat(keys, count), (total - np.repeat(before, count)).astype(np.int32)


def matches(found: DataFrame) -> DataFrame:
    """(tk, pos, ltk, lpos): every occurrence of a seed with the first one, and the first with its surroundings, in another text."""
    context = np.uint64(CONTEXT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in each_group(batches, "bucket"):
            parts = [unpacked_seeds(*(v.as_py() for v in row)) for row in zip(*(rows.column(c) for c in ("seeds", "tks", "counts", "places")))]
            both, tk, pos = (np.concatenate(v) for v in zip(*parts))
            del parts, rows
            order = np.argsort(both, kind="stable")
            sorted_ = both[order] >> context
            same = sorted_[1:] == sorted_[:-1]
            order = order[np.append(same, False) | np.append(False, same)]  # the others are seeds of one place only
            del sorted_, same
            both, tk, pos = both[order], tk[order], pos[order]
            order = np.lexsort((pos, tk, both))
            both, tk, pos = both[order], tk[order], pos[order]
            del order
            if not len(both):
                continue
            new = np.ones(len(both), bool)
            new[1:] = both[1:] != both[:-1]
            near = np.flatnonzero(new)  # the first of each seed with its surroundings
            seed = both[near] >> context
            order = np.lexsort((pos[near], tk[near], seed))
            first = np.ones(len(near), bool)
            first[1:] = seed[order][1:] != seed[order][:-1]
            lead = np.empty(len(near), np.int64)
            lead[order] = near[order][np.maximum.accumulate(np.where(first, np.arange(len(near)), 0))]
            of = np.cumsum(new) - 1
            fresh = np.ones(len(both), bool)  # a repeated row's places count once
            fresh[1:] = new[1:] | (tk[1:] != tk[:-1]) | (pos[1:] != pos[:-1])
            del both
            for at in range(0, len(tk), 1 << 17):
                i = np.arange(at, min(at + (1 << 17), len(tk)))
                i = i[fresh[i]]
                one, two = lead[of[i]], near[of[i]]
                yield _matched(tk, pos, i, one, tk[i] != tk[one])
                yield _matched(tk, pos, i, two, (tk[i] != tk[two]) & (tk[two] != tk[one]))

    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "tk long, pos int, ltk long, lpos int")


def _matched(tk: np.ndarray, pos: np.ndarray, here: np.ndarray, there: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
    here, there = here[keep], there[keep]
    return pa.RecordBatch.from_pydict({"tk": tk[here], "pos": pos[here], "ltk": tk[there], "lpos": pos[there]})


class PrefixMax:
    """Fenwick tree: the largest value put at places below a given one, and who put it."""

    def __init__(self, n: int):
        self.tree = [(float("-inf"), -1)] * (n + 1)

    def put(self, place: int, value: float, who: int) -> None:
        i, tree = place + 1, self.tree
        while i < len(tree):
            if value > tree[i][0]:
                tree[i] = (value, who)
            i += i & -i

    def below(self, place: int) -> tuple[float, int]:
        best, i = (float("-inf"), -1), place
        while i:
            if self.tree[i][0] > best[0]:
                best = self.tree[i]
            i -= i & -i
        return best


def chains(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Disjoint collinear chains, best first, of points ascending in x (numbers of the points)."""
    n = len(x)
    if n == 1:
        return [np.zeros(1, np.int64)]
    if (np.diff(y) > 0).all() and (np.diff(x) + np.diff(y) < SEED / GAP).all():
        return [np.arange(n)]  # every step of an ascending row costs less than its seed brings
    rank = np.searchsorted(np.unique(y), y).tolist()
    tree, score, back = PrefixMax(n), [0.0] * n, [-1] * n
    xs, ys = x.tolist(), y.tolist()
    for j in range(n):
        best, who = tree.below(rank[j])
        best -= GAP * (xs[j] + ys[j])
        score[j] = SEED + max(best, 0.0)
        back[j] = who if best > 0 else -1
        tree.put(rank[j], score[j] + GAP * (xs[j] + ys[j]), j)
    out, used = [], [False] * n
    for j in sorted(range(n), key=lambda j: -score[j]):
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = back[j]
        if path:
            out.append(np.array(path[::-1]))
    return out


def thinned(tk: np.ndarray, x: np.ndarray, ltk: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """The points by text, leader and place, of pairs whose seeds cover enough words; of a run on a diagonal every SEED-th and the last."""
    order = np.lexsort((x, x - y, ltk, tk))
    tk, x, ltk, y = tk[order], x[order], ltk[order], y[order]
    pair = np.ones(len(x), bool)
    pair[1:] = (tk[1:] != tk[:-1]) | (ltk[1:] != ltk[:-1])
    run = pair.copy()
    run[1:] |= (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1)
    of = np.cumsum(pair) - 1
    keep = (np.bincount(of) + (SEED - 1) * np.bincount(of, run) >= MIN_COVER)[of]  # words covered, at most
    begun = np.maximum.accumulate(np.where(run, np.arange(len(x)), 0))
    keep &= ((np.arange(len(x)) - begun) % SEED == 0) | np.append(run[1:], True)
    tk, x, ltk, y = tk[keep], x[keep], ltk[keep], y[keep]
    order = np.lexsort((y, x, ltk, tk))
    return tk[order], x[order], ltk[order], y[order]


def chained(found: DataFrame) -> DataFrame:
    """(tk, ltk, lo, hi, xs, ys): the chains of every text with its leaders; lo, hi bound the words asked of the leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "tk"):
            tk, x, ltk, y = thinned(*(rows.column(c).to_numpy() for c in ("tk", "pos", "ltk", "lpos")))
            if not len(tk):
                continue
            cuts = np.flatnonzero(np.concatenate(([True], (tk[1:] != tk[:-1]) | (ltk[1:] != ltk[:-1])))).tolist()
            made = []
            for a, b in zip(cuts, [*cuts[1:], len(tk)]):
                for c in chains(x[a:b], y[a:b]):
                    xs, ys = x[a:b][c], y[a:b][c]
                    if SEED + np.minimum(np.diff(xs), SEED).sum() >= MIN_COVER:
                        made.append((int(tk[a]), int(ltk[a]), max(int(ys[0]) - SLACK, 0), int(ys[-1]) + SEED + SLACK, xs, ys))
            if made:
                tks, ltks, lo, hi, xs, ys = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.int64()) for v in (tks, ltks, lo, hi)] + [pa.array(v, pa.list_(pa.int32())) for v in (xs, ys)],
                    names=["tk", "ltk", "lo", "hi", "xs", "ys"])

    return found.repartition("tk").sortWithinPartitions("tk").mapInArrow(run, ANCHORS)


def longest_part(good: np.ndarray) -> tuple[int, int]:
    """Bounds of the longest part with MIN_IDENTITY true values, true ones at its ends."""
    total = np.concatenate(([0.0], np.cumsum(good - MIN_IDENTITY)))
    least = np.minimum.accumulate(np.where(good, total[:-1], np.inf))
    first = np.searchsorted(-least, -total[1:] - 1e-9)  # the first place from which a part that ends here has enough
    end = int(np.argmax(np.where(good, np.arange(1, len(total)) - first, -1)))
    return int(first[end]), end + 1


def align(here: np.ndarray, there: np.ndarray, offset: int, xs: np.ndarray, ys: np.ndarray) -> tuple[int, int, int, int, int]:
    """(from, to, leader from, leader to, equal words) of a chain, aligned word by word; ``there`` starts at word ``offset``."""
    lo, hi = max(int(xs[0]) - SLACK, 0), min(int(xs[-1]) + SEED + SLACK, len(here))
    x = np.arange(lo, hi)

    def equal(diagonal):
        at = x - diagonal - offset
        ok = (at >= 0) & (at < len(there))
        out = np.zeros(len(x), bool)
        out[ok] = here[x[ok]] == there[at[ok]]
        return out

    diagonals = (xs - ys).tolist()
    good, on = equal(diagonals[0]), np.full(len(x), diagonals[0])
    for j in range(1, len(xs)):
        if diagonals[j] != diagonals[j - 1]:  # the gap goes where most words are equal on both sides of it
            other = equal(diagonals[j])
            a, b = int(xs[j - 1]) + SEED - lo, max(int(xs[j]), int(xs[j - 1]) + SEED) - lo
            left, right = np.cumsum(good[a:b]), np.cumsum(other[a:b][::-1])[::-1]
            at = a + int(np.argmax(np.append(0, left) + np.append(right, 0)))
            good[at:], on[at:] = other[at:], diagonals[j]
    # ends: as far as matches outweigh mismatches two to one
    first, last = int(xs[0]) - lo, int(xs[-1]) + SEED - lo
    ahead = np.cumsum(np.where(good[:first][::-1], 1, -2))
    after = np.cumsum(np.where(good[last:], 1, -2))
    a = first - (int(np.argmax(ahead)) + 1 if len(ahead) and ahead.max() > 0 else 0)
    b = last + (int(np.argmax(after)) + 1 if len(after) and after.max() > 0 else 0)
    poor = good[a:b].sum() < MIN_IDENTITY * (b - a)
    if poor or b - a < MIN_WORDS:
        c, d = longest_part(good)
        if poor or d - c >= MIN_WORDS:
            a, b = c, d
    return lo + a, lo + b, int(lo + a - on[a]), int(lo + b - on[b - 1]), int(good[a:b].sum())


def texts_of(docs: DataFrame) -> DataFrame:
    """(tk, rid, doc_id, copies): the different texts and the smallest row of each."""
    rid = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    return docs.select(text_key(), rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id")).groupBy("tk").agg(
        F.min("rid").alias("rid"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def word_arrays(docs: DataFrame, texts: DataFrame, links: DataFrame) -> DataFrame:
    """(tk, lo, hi, words): word hashes of the texts with chains (lo and hi null), and of what is asked of leaders."""
    own = links.select("tk", F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    asked = (own.union(links.select("ltk", "lo", "hi")).distinct().groupBy("tk").agg(F.collect_list(F.struct("lo", "hi")).alias("asked"))
             .join(texts, "tk").select("rid", "tk", F.transform("asked", lambda a: F.coalesce(a["lo"], F.lit(-1))).alias("los"),
                                       F.transform("asked", lambda a: F.coalesce(a["hi"], F.lit(-1))).alias("his")))
    rid = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("rid")
    read = docs.select(rid, text_key(), "text").join(asked, ["rid", "tk"]).select("text", "tk", "los", "his")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, los, his = (batch.column(i) for i in (1, 2, 3))
            for part in slices(batch.column(0)):
                starts, ends, of = part.words()
                words = part.hashes(starts, ends)
                cut = np.searchsorted(of, np.arange(len(part) + 1))
                out = []
                for i, row in enumerate(part.rows.tolist()):
                    mine = words[cut[i]:cut[i + 1]]
                    for lo, hi in zip(los[row].as_py(), his[row].as_py()):
                        out.append((keys[row].as_py(), None, None, mine.tobytes()) if lo < 0 else (keys[row].as_py(), lo, hi, mine[lo:hi].tobytes()))
                if out:
                    tk, lo, hi, w = zip(*out)
                    yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.int64()) for v in (tk, lo, hi)], pa.array(w, pa.binary())],
                                                     names=["tk", "lo", "hi", "words"])

    return read.mapInArrow(run, "tk long, lo long, hi long, words binary")


def pieces(links: DataFrame, arrays: DataFrame) -> DataFrame:
    """(tk, ltk, start, end, lstart, lend, equal, passage): aligned pieces of passages that are long enough."""
    own = arrays.where("lo IS NULL").select("tk", F.lit(None).cast("long").alias("ltk"), F.col("lo"), F.lit(None).cast("array<int>").alias("xs"),
                                            F.lit(None).cast("array<int>").alias("ys"), "words")
    there = arrays.where("lo IS NOT NULL").withColumnRenamed("tk", "ltk")
    asked = links.join(there, ["ltk", "lo", "hi"]).select("tk", "ltk", "lo", "xs", "ys", "words")

    def of_text(rows):
        here, found = None, []
        for _, ltk, lo, xs, ys, words in rows:
            if ltk is None:
                here = np.frombuffer(words, np.uint64)
        for tk, ltk, lo, xs, ys, words in rows:
            if ltk is not None:
                a, b, la, lb, equal = align(here, np.frombuffer(words, np.uint64), lo, np.array(xs), np.array(ys))
                if equal >= MIN_IDENTITY * (b - a):
                    found.append((a, b, la, lb, equal, ltk))
        found.sort()
        group, end = [], -1
        for f in [*found, None]:
            if group and (f is None or f[0] > end + JOIN):
                if end - group[0][0] >= MIN_WORDS:
                    yield from ((*g, group[0][0]) for g in group)
                group, end = [], -1
            if f is not None:
                group.append(f)
                end = max(end, f[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "tk"):
            tk = rows.column("tk").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], tk[1:] != tk[:-1])))
            made = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(tk)]):
                lines = list(zip(*[c.to_pylist() for c in rows.slice(a, b - a).columns]))
                made += [(int(tk[a]), ltk, s, e, ls, le, n, p) for s, e, ls, le, n, ltk, p in of_text(lines)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*made)],
                                                 names=["tk", "ltk", "start", "end", "lstart", "lend", "equal", "passage"])

    both = own.select("tk", "ltk", "lo", "xs", "ys", "words").union(asked)
    return (both.repartition("tk").sortWithinPartitions("tk")
            .mapInArrow(run, "tk long, ltk long, start long, `end` long, lstart long, lend long, equal long, passage long"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, ref_id, start, end, ref_start, ref_end, n_equal, kind): passages of (doc_id, text), and copies of whole texts."""
    texts = materialize(texts_of(docs))
    links = materialize(chained(materialize(matches(seeds(docs, buckets(docs))))))
    arrays = materialize(word_arrays(docs, texts, links))
    found = pieces(links, arrays)
    ids = texts.select("tk", "doc_id")
    named = (found.join(ids, "tk").join(ids.select(F.col("tk").alias("ltk"), F.col("doc_id").alias("ref_id")), "ltk")
             .select("doc_id", "ref_id", "start", "end", F.col("lstart").alias("ref_start"), F.col("lend").alias("ref_end"),
                     F.col("equal").alias("n_equal"), F.lit("passage").alias("kind")))
    n = F.regexp_count("text", F.lit(WORD)).cast("long")
    copied = texts.where("copies > 1").select("tk", F.col("rid").alias("first"), F.col("doc_id").alias("ref_id"))
    rid = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    copies = (docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), rid.alias("rid"), text_key(), n.alias("n"))
              .join(copied, "tk").where((F.col("n") >= MIN_WORDS) & (F.col("rid") != F.col("first"))))
    zero = F.lit(0).cast("long")
    return named.union(copies.select("doc_id", "ref_id", zero, "n", zero, "n", "n", F.lit("copy")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
