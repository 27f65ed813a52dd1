import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from trapline.llm import mixing, quality, sharding

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_equals_brute_force(odd_docs):
    got = quality.judge(odd_docs.select("doc_id", "text"), features=FEATURES).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        want = brute.quality(r["text"])
        assert tuple(r[f] for f in FEATURES) + (r["kept"],) == want[:5] + want[6:]
        assert r["kept"] == (r["rejected_by"] is None)


def test_quality_order_changes_no_verdict(odd_docs):
    docs = odd_docs.select("n_chars", "text")
    one = quality.judge(docs, rules=quality.RULES).select("n_chars", "kept")
    two = quality.judge(docs, rules=quality.RULES[::-1]).select("n_chars", "kept")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_quality_order_follows_rejection_per_cost(odd_docs):
    rules = quality.ordered(odd_docs)
    assert sorted(r.name for r in rules) == sorted(r.name for r in quality.RULES)


def test_quality_carries_other_columns_and_takes_empty_tables(odd_docs, no_docs):
    got = quality.judge(odd_docs)
    assert {"kept", "rejected_by"} <= set(got.columns) and dict(got.dtypes)["kept"] == "boolean" and got.first()["size"] == "size"
    assert quality.judge(no_docs).count() == 0


def water_filled(sizes):
    """Targets by the rule as it is told: share out, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        share = {s: target[s] + left * weight[s] / total for s in free}
        left = 0.0
        for s in list(free):
            target[s] = share[s]
            if share[s] > 2 * sizes[s]:
                left += share[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.remove(s)
    return target


def test_mixing_meets_targets(odd_docs):
    docs = odd_docs.select("doc_id", "source", "text")
    rows = mixing.mix(docs, mixing.words(F.col("text"))).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r["size"] == len(brute.words(r["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = water_filled(sizes)
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-9) and taken[s] == math.floor(target[s] + 1e-9)
    assert len(rows) == docs.count() and all(r["source_size"] == sizes[r["source"]] for r in rows)


def test_mixing_with_a_hot_id(spark):
    """Half of a source's rows have no id, of many sizes and of one: cut as in one order of (key, size), in small cells."""
    import hashlib

    rng = random.Random(8)
    rows = [(None if i % 2 else i, "hot" if i % 5 else "s", 7 if i % 3 == 0 else rng.randint(0, 40)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, words long")
    got = mixing.mix(docs.repartition(5), F.col("words"), equal_rows=20).collect()
    h = lambda i: hashlib.md5(f"mix-1|{'null' if i is None else i}".encode()).hexdigest()
    target, sums = {r["source"]: (r["target"], r["source_size"]) for r in got}, defaultdict(int)
    for _, s, w in rows:
        sums[s] += w
    want, upto = [], defaultdict(int)
    for i, s, w in sorted(rows, key=lambda r: (h(r[0]), r[2])):
        goal, whole = math.floor(target[s][0]), sums[s]
        want.append((str(i), s, w, goal // whole * w + max(min(goal % whole - upto[s], w), 0)))
        upto[s] += w
    assert sorted((str(r["doc_id"]), r["source"], r["size"], r["taken"]) for r in got) == sorted(want)
    keyed = docs.select(F.struct("*").alias("row"), F.col("words").alias("size"), "source", F.col("source").alias("source_key"),
                        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("_key"), F.lit(0).cast("long").alias("_range"))
    cells = mixing.in_cells(keyed, 20).where("row.doc_id IS NULL").groupBy("source", *mixing.CELL).count().toPandas()
    assert cells["count"].sum() == 1500 and cells["count"].max() <= 20


def test_mixing_empty_and_clashing(odd_docs, no_docs):
    assert mixing.mix(no_docs, mixing.words(F.col("text"))).count() == 0
    got = mixing.mix(odd_docs, mixing.words(F.col("text")))
    assert dict(got.dtypes)["taken"] == "bigint" and got.count() == odd_docs.count()


def test_matrix_sums():
    counts = [0, 5, 17, 100, 3]
    m = sharding.matrix(counts, 16)
    assert m.sum(axis=1).tolist() == counts and set(np.diff(sorted(m.sum(axis=0)))) <= {0, 1} and m.min() >= 0


def test_draws_follow_the_law():
    """Against the exact probabilities of small urns, and the moments of one beyond 1e9 rows."""
    rng = np.random.default_rng(1)
    for good, bad, n in ((5, 7, 6), (40, 3, 20), (1, 50, 25), (30, 30, 30), (200, 100, 2)):
        low, high = max(0, n - bad), min(n, good)
        p = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(low, high + 1)]
        draws = np.array([sharding._draw(rng, good, bad, n) for _ in range(6000)])
        assert draws.min() >= low and draws.max() <= high
        seen = np.bincount(draws - low, minlength=len(p))
        chi, cells = 0.0, 0
        for got, want in zip(seen, np.array(p) * 6000):
            if want >= 5:
                chi, cells = chi + (got - want) ** 2 / want, cells + 1
        assert chi < cells + 5 * math.sqrt(2 * cells) + 5
    good, bad, n = 3_000_000_000, 45_000_000_000, 100_000
    draws = np.array([sharding._draw(rng, good, bad, n) for _ in range(4000)])
    mean, var = n / 16, n / 16 * 15 / 16
    assert abs(draws.mean() - mean) < 5 * math.sqrt(var / 4000) and abs(draws.var() / var - 1) < 0.12
    assert abs(sharding._draw(rng, 3_000_000_000, 5_000_000_000, 4_000_000_000) / 4e9 - 3 / 8) < 1e-4
    assert sharding._draw(rng, 0, 9, 4) == 0 and sharding._draw(rng, 9, 0, 4) == 4 and sharding._draw(rng, 3, 4, 7) == 3


def test_a_third_of_the_rows_equal(spark):
    """No block or cell holds the equal rows; they are dealt like others, and the same however the rows lie."""
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("doc_id"))
    key = [F.col("doc_id")]
    blocks = sharding.in_blocks(rows, key, 78, 20, equal_rows=50).groupBy("_block").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("row.doc_id") == -1).alias("equal")).toPandas()
    assert blocks.n.sum() == 6000 and blocks.n.max() < 350 and blocks.equal.max() <= 250
    results = []
    for parts in (3, 7):
        got = sharding.shuffle_into_shards(rows.repartition(parts), key, equal_rows=50).toPandas()
        results.append(got.sort_values(["shard", "slot"]).reset_index(drop=True))
    assert results[0].equals(results[1])
    equal = (results[0].doc_id == -1).groupby(results[0]["shard"])
    assert len(equal.size()) == 16 and set(equal.size()) == {375} and equal.sum().between(85, 165).all()
    # they don't stand next to each other more often than by chance (a third of the neighbours)
    hot = results[0].doc_id.to_numpy() == -1
    assert abs((hot[1:] & hot[:-1]).mean() - 1 / 9) < 0.02


def test_sharding_is_exact_and_uniform(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.shuffle_into_shards(rows, [F.col("doc_id")]).toPandas()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(250))
    assert sorted(got.doc_id) == list(range(4000))
    halves = (got.doc_id < 2000).groupby(got["shard"]).sum()  # about half of each shard comes from either half
    assert halves.between(85, 165).all()
    assert abs(np.corrcoef(got.doc_id, got.slot)[0, 1]) < 0.1


def test_sharding_odd_rows(odd_docs, no_docs):
    got = sharding.shuffle_into_shards(odd_docs, [F.col("doc_id"), F.xxhash64("text")], n_shards=7)
    counts = [r["n"] for r in got.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(counts) == odd_docs.count() and max(counts) - min(counts) <= 1
    assert sharding.shuffle_into_shards(no_docs, [F.col("doc_id")]).count() == 0


def test_sharding_columns(odd_docs):
    row = odd_docs.where("text IS NULL").select(*[c.alias(n) for n, c in sharding.text_columns(F.col("text")).items()]).first()
    assert row["size"] == 1 and row["text_crc32"] == 0


def test_sample_reaches_every_split(spark):
    """Only the table's last split has texts that a rule rejects; what they cost and share is measured too."""
    good = F.lit(" ".join(f"word{j}" for j in range(60)))
    docs = spark.range(0, 8000, 1, 2).select(F.when(F.col("id") < 4000, good).otherwise("too few words").alias("text"))
    share = {name: share for name, _, share in quality.measured(docs, sample_rows=50)}
    assert share["min_words"] == 0.5 and share["repeated_lines"] == 0
    assert [s for _, _, s in quality.measured(docs.limit(0))] == [0] * len(quality.RULES)
