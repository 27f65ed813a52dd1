"""LM scoring (8): a bigram model by deleted interpolation, trained and applied over all documents.

p(w | h) = l2[b] c(h, w) / c(h) + l1[b] c(w) / N + l0[b] / (V + 1), where b is the
bucket floor(log2(c(h) + 1)) of the context's frequency.  The weights of a bucket
are learned by expectation-maximisation: a tenth of the training documents, chosen
by a hash, is deleted from the counts, and its bigrams are what the weights are
fitted to.  The E and M steps run over a table of (bucket, bigram share, unigram
share, events) with shares in quarter powers of two, whose size does not depend on
the corpus.  The scores use the counts of all training documents.

Counts are exact and as many as the corpus has.  Documents are dealt to blocks of a
few MB; a block asks once for each of its different n-grams, as sorted arrays of
64-bit hashes cut by hash range.  One exchange brings a range's arrays together,
where the counts are added up; the answers go back to the blocks in the same order,
and one more exchange brings them to the block's documents.  No n-gram is a row, and
a frequent one is in no more arrays than there are blocks.  Many equal rows are one row
with their number: counted so many times, scored once.

Defined cases: a null or empty text is one end token; texts are scored whole;
repeated rows count and are scored one by one; a null id counts as the empty id for
the held-out rule; without training documents N and V are 0 and the score is the
uniform model's; empty tables give empty results; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm.tables import materialize, small, table
from trapline.llm.tokens import P, each_group, mix, slices

HELD_OUT = 2           # crc32(doc_id as text) mod 7
BLOCK_BYTES = 2 << 20  # text of a block
RANGE_KEYS = 1 << 20   # n-grams that a range is asked for, about
SAME_ROWS = 64         # rows with one id and text that are counted as one, so many times
MOST_TIMES = 1 << 16   # rows that one row stands for at most
TENTH = 10             # one in so many training documents is deleted to learn the weights
STEPS = 4              # of a power of two, in the table of shares
ROUNDS = 30
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
DEFAULT = (0.1, 0.2, 0.7)  # weights of uniform, unigram, bigram where a bucket saw nothing


def _hash_of(doc_id: str, kind) -> object:
    return kind(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: str = "doc_id"):
    return _hash_of(doc_id, F.crc32) % 7 == HELD_OUT


def rows_with_times(docs: DataFrame) -> DataFrame:
    """(doc_id, text, times, part): rows that are there SAME_ROWS times or more become one, or one for each MOST_TIMES."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    hot = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SAME_ROWS).select("key"))
    one = (F.lit(1).cast("long").alias("times"), F.lit(0).cast("long").alias("part"))
    if hot.isEmpty():
        return docs.select("doc_id", "text", *one)
    hot = small(hot, 16)
    many = keyed.join(hot, "key", "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
    last = ((F.col("n") - 1) / MOST_TIMES).cast("long")
    many = many.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    many = many.select("doc_id", "text", F.least(F.col("n") - F.col("part") * MOST_TIMES, F.lit(MOST_TIMES)).alias("times"), "part")
    return keyed.join(hot, "key", "left_anti").select("doc_id", "text", *one).union(materialize(many))


def in_blocks(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(doc_id, text, times, training, block); the number of plain blocks, above which the deleted tenth's are; and of ranges."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plain = max(size // BLOCK_BYTES + 1, docs.sparkSession.sparkContext.defaultParallelism)
    bits = max(int(size // 6 // RANGE_KEYS).bit_length(), 2)
    training = ~held_out()
    tenth = training & (F.pmod(F.xxhash64(_hash_of("doc_id", F.crc32)), F.lit(TENTH)) == 0)
    at = F.xxhash64("doc_id", "text", "part")
    block = F.when(tenth, plain + F.pmod(at, F.lit(plain // TENTH + 1))).otherwise(F.pmod(at, F.lit(plain)))
    return docs.select("doc_id", "text", "times", training.alias("training"), block.alias("block")), plain, bits


def stream(texts: pa.ChunkedArray):
    """Tokens and bigrams of a block: (token, bigram, text number, first of a text)."""
    words, of, n = [], [], 0
    for part in slices(texts):
        low = part.lower()
        starts, ends, text = low.words()
        words.append(low.hashes(starts, ends))
        of.append(text + n)
        n += len(part)
    words, of = np.concatenate(words or [np.zeros(0, np.uint64)]), np.concatenate(of or [np.zeros(0, np.int64)])
    token, text = np.full(len(words) + n, END), np.zeros(len(words) + n, np.int64)
    count = np.bincount(of, minlength=n)
    last = np.cumsum(count + 1) - 1
    token[np.arange(len(words)) + of] = words
    text[np.arange(len(words)) + of], text[last] = of, np.arange(n)
    first = np.zeros(len(token), bool)
    first[last - count] = True
    before = np.concatenate((np.zeros(1, np.uint64), token[:-1]))
    before[first] = START
    return token, mix(before * P + token), text, first


def asked(blocks: DataFrame, bits: int) -> DataFrame:
    """(range, order, block, keys, counts): what each block asks each range, with its training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in each_group(batches, "block"):
            token, pair, text, _ = stream(rows.column("text"))
            learn = np.where(rows.column("training").to_numpy().astype(bool), rows.column("times").to_numpy(), 0)[text]
            block = rows.column("block")[0].as_py()
            for order, values in ((1, token), (2, pair)):
                keys, at = np.unique(values, return_inverse=True)
                counts = np.bincount(at, learn, len(keys)).astype(np.int64)
                cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(keys)]
                yield pa.RecordBatch.from_pydict({
                    "range": [order << 32 | i for i in range(1 << bits)], "block": [block] * (1 << bits),
                    "keys": [packed(keys[a:b], rising=True) for a, b in zip(cuts, cuts[1:])],
                    "counts": [packed(counts[a:b]) for a, b in zip(cuts, cuts[1:])]})

    return (blocks.select("block", "text", "training", "times").repartition("block").sortWithinPartitions("block")
            .mapInArrow(run, "range long, block long, keys binary, counts binary"))


def answered(requests: DataFrame, plain: int) -> DataFrame:
    """(range, block, counts, deleted, tokens, types): all training counts in the order asked, and those of the deleted tenth for its blocks.

    tokens and types: the range's sums, on one row of each range of single tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in each_group(batches, "range"):
            blocks = rows.column("block").to_numpy()
            parts = [unpacked(k, rising=True) for k in rows.column("keys").to_pylist()]
            size = np.array([len(p) for p in parts], np.int64)
            n_parts, parts = len(parts), np.concatenate(parts)
            keys, at = np.unique(parts, return_inverse=True)
            del parts
            counts = np.concatenate([unpacked(c) for c in rows.column("counts").to_pylist()])
            total = np.bincount(at, counts, len(keys)).astype(np.int64)
            counts[np.repeat(blocks < plain, size)] = 0
            apart = np.bincount(at, counts, len(keys)).astype(np.int64)
            del counts, keys
            ends = np.cumsum(size)
            one = rows.column("range")[0].as_py() >> 32 == 1
            sums = lambda v: [int(v)] + [0] * (n_parts - 1) if one else [0] * n_parts
            yield pa.RecordBatch.from_pydict({
                "range": rows.column("range").combine_chunks(), "block": blocks,
                "counts": [packed(total[at[b - n:b]]) for n, b in zip(size, ends)],
                "deleted": [packed(apart[at[b - n:b]]) if block >= plain else b"" for block, n, b in zip(blocks, size, ends)],
                "tokens": sums(total.sum()), "types": sums((total > 0).sum())})

    return (requests.repartition("range").sortWithinPartitions("range", "block")
            .mapInArrow(run, "range long, block long, counts binary, deleted binary, tokens long, types long"))


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers as byte planes (rising ones as differences): small counts and sorted hashes shrink under Spark's compression."""
    v = values.astype(np.uint64)
    if rising:
        v = v - np.concatenate((np.zeros(min(len(v), 1), np.uint64), v[:-1]))
    return v.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes, rising: bool = False) -> np.ndarray:
    v = np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
    return np.cumsum(v, dtype=np.uint64) if rising else v.view(np.int64)


class Block:
    """A block's tokens with the counts that came back for them."""

    def __init__(self, rows: pa.Table, answers: pa.Table, deleted: bool = False):
        token, pair, self.text, self.first = stream(rows.column("text"))
        order = np.argsort(answers.column("range").to_numpy())
        ranges = answers.column("range").to_numpy()[order]

        def counts(n: int, values: np.ndarray, column: str) -> np.ndarray:
            got = answers.column(column).to_pylist()
            got = np.concatenate([unpacked(got[i]) for i, r in zip(order, ranges) if r >> 32 == n])
            keys, at = np.unique(values, return_inverse=True)
            if len(keys) != len(got):
                raise ValueError("a block's documents changed between two reads of the table")
            return got[at]

        self.c1, self.c2 = counts(1, token, "counts"), counts(2, pair, "counts")
        if deleted:
            self.d1, self.d2 = counts(1, token, "deleted"), counts(2, pair, "deleted")

    def context(self, c1: np.ndarray, starts: int) -> np.ndarray:
        """How often each token's context was seen."""
        out = np.concatenate((np.zeros(1, np.int64), c1[:-1]))
        out[self.first] = starts
        return out


def bucket(context: np.ndarray) -> np.ndarray:
    return np.log2(context + 1.0).astype(np.int64)


def _step(share: np.ndarray) -> np.ndarray:
    """Quarter powers of two; 1 stands for 0."""
    with np.errstate(divide="ignore"):
        return np.where(share > 0, np.round(np.log2(share) * STEPS), 1).astype(np.int64)


def events(blocks: DataFrame, answers: DataFrame, plain: int, tokens: int, starts: int, deleted_tokens: int, deleted_starts: int) -> DataFrame:
    """(bucket, two, one, n): the deleted tenth's tokens by their shares in the counts without it."""

    def run(rows: pa.Table, got: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({c: np.zeros(0, np.int64) for c in ("bucket", "two", "one", "n")})
        b = Block(rows, got, deleted=True)
        rest = b.c1 - b.d1
        context = b.context(rest, starts - deleted_starts)
        two, one = (b.c2 - b.d2) / np.maximum(context, 1), rest / max(tokens - deleted_tokens, 1)
        cells = np.stack([bucket(context), _step(two), _step(one)])
        cells, at = np.unique(cells, axis=1, return_inverse=True)
        n = np.bincount(at.ravel(), rows.column("times").to_numpy()[b.text], cells.shape[1])
        return pa.table({"bucket": cells[0], "two": cells[1], "one": cells[2], "n": n.astype(np.int64)})

    mine = blocks.where(F.col("block") >= plain).select("block", "text", "times")
    theirs = answers.where(F.col("block") >= plain).select("block", "range", "counts", "deleted")
    return (mine.groupBy("block").cogroup(theirs.groupBy("block")).applyInArrow(run, "bucket long, two long, one long, n long")
            .groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")))


def learn(cells: np.ndarray, uniform: float) -> np.ndarray:
    """Weights (65 buckets x uniform, unigram, bigram) by expectation-maximisation on (bucket, two, one, n) rows."""
    out = np.tile(np.array(DEFAULT), (65, 1))
    power = lambda q: np.where(q > 0, 0.0, 2.0 ** (q / STEPS))
    for b in np.unique(cells[:, 0]):
        mine = cells[cells[:, 0] == b]
        share = np.stack([np.full(len(mine), uniform), power(mine[:, 2]), power(mine[:, 1])], axis=1)
        weight = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            part = weight * share
            part *= (mine[:, 3] / np.maximum(part.sum(axis=1), 1e-300))[:, None]
            weight = part.sum(axis=0) / part.sum()
        out[int(b)] = np.maximum(weight, 1e-6) / np.maximum(weight, 1e-6).sum()  # no token is impossible
    return out


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of (doc_id, text)."""
    blocks, plain, bits = in_blocks(rows_with_times(docs))
    answers = materialize(answered(asked(blocks, bits), plain))
    sums = answers.agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = int(sums[0] or 0), int(sums[1] or 0)
    apart = F.col("block") >= plain
    length = F.when(F.col("text").isNull(), 1).otherwise(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + 1)
    row = blocks.where("training").agg(F.sum("times"), F.sum(F.when(apart, F.col("times"))), F.sum(F.when(apart, length * F.col("times")))).first()
    starts, deleted_starts, deleted_tokens = int(row[0] or 0), int(row[1] or 0), int(row[2] or 0)
    uniform = 1 / (types + 1)
    table_of_shares = events(blocks, answers, plain, tokens, starts, deleted_tokens, deleted_starts).collect()
    weights = learn(np.array([tuple(r) for r in table_of_shares], np.int64).reshape(-1, 4), uniform)

    def run(rows: pa.Table, got: pa.Table) -> pa.Table:
        b = Block(rows, got)
        n = rows.num_rows
        context = b.context(b.c1, starts)
        w = weights[bucket(context)]
        p = w[:, 0] * uniform + w[:, 1] * (b.c1 / max(tokens, 1)) + w[:, 2] * (b.c2 / np.maximum(context, 1))
        base = np.log10((b.c1 + 1.0) / (tokens + types + 1))
        add = lambda v: np.bincount(b.text, v, n)
        return pa.table({"doc_id": rows.column("doc_id"), "times": rows.column("times"), "held_out": rows.column("held_out"),
                         "n_tokens": np.bincount(b.text, minlength=n), "n_known": np.bincount(b.text[b.c1 > 0], minlength=n),
                         "train_tokens": np.full(n, tokens), "base_score": add(base), "score": add(np.log10(p))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    mine = blocks.select("block", "doc_id", "times", (~F.col("training")).alias("held_out"), "text")
    out = (mine.groupBy("block").cogroup(answers.select("block", "range", "counts").groupBy("block"))
           .applyInArrow(run, f"doc_id {kind}, times long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                              "base_score double, score double"))
    return out.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("again", "times")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
