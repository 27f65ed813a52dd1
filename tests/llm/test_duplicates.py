import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import made_up
from trapline.llm import components, decontaminate, jaccard, passages, suffixes, tokens


def test_jaccard_equals_brute_force(odd_docs, odd_texts):
    rows = odd_docs.select("doc_id", "text").collect()
    group = brute.components([r["text"] for r in rows])
    least = {}
    for r, g in zip(rows, group):
        if r["doc_id"] is not None:
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], len(brute.shingle_set(r["text"])), least.get(g) if brute.shingle_set(r["text"]) else r["doc_id"])
                   for r, g in zip(rows, group))
    assert Counter(map(tuple, jaccard.joined(odd_docs).collect())) == want


def test_jaccard_stars_and_borders(spark):
    """Copies that link only through a centre, and pairs around the limit."""
    rng = random.Random(5)
    texts = []
    for size in (7, 24, 60, 300):
        base = made_up(rng, size)
        texts.append(" ".join(base))
        for k in range(12):
            w = list(base)
            for i in rng.sample(range(size), max(1, size * k // 120)):
                w[i] = f"y{k}q{i}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.joined(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute.components(texts)


def test_one_per_group(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    groups = len({g for r, g in zip(rows, brute.components([r["text"] for r in rows])) if brute.words(r["text"])})
    kept = jaccard.one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    got = kept.collect()
    assert sum(bool(brute.words(r["text"])) for r in got) == groups
    assert sum(not brute.words(r["text"]) for r in got) == sum(not brute.words(r["text"]) for r in rows)
    assert jaccard.one_per_group(no_docs).count() == 0 and jaccard.joined(no_docs).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 7), (200, 201), (5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: i // 20 * 20 for i in range(60)} | {100: 0, 200: 200, 201: 200}
    assert got == want


def test_decontamination_equals_brute_force(spark, odd_docs, odd_texts, no_docs):
    long = odd_texts[9].split()
    items = [(1, " ".join(long[20:60])), (2, "word"), (3, None), (4, ""), (None, " ".join(long[100:112]).upper()), (5, "a, B c"),
             (6, " ".join(f"n{i}" for i in range(30))), (7, "na na na na na na na na na na na na"), (1, "1 2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    hit = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["length"] - 1))))
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    got = decontaminate.occurrences(odd_docs, bench)
    assert "row" in got.columns and got.count() == odd_docs.count()
    for r in got.select("text", "n_words", F.size(hit).alias("n_hit"), F.size(ids).alias("n_items"),
                        F.sha2(F.concat_ws(",", ids), 256).alias("sha")).collect():
        assert tuple(r)[1:] == brute.leaks(r["text"], items), r
    assert decontaminate.occurrences(no_docs, bench).count() == 0
    assert decontaminate.occurrences(odd_docs, bench.limit(0)).where(F.size("matches") > 0).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "k1 x k3 y k2 z"), (2, "k1 " + "x " * 50 + "k2 k3"), (3, "k1 k2")], "doc_id long, text string")
    items = decontaminate.read_items(spark.createDataFrame([(9, "k1 k2 k3")], "item_id long, text string"))
    index = decontaminate.build_index(docs, items)
    near = decontaminate.near(index, items, slop=10).select("doc").distinct().collect()
    want = docs.where("doc_id = 1").select(decontaminate.row_key().alias("doc")).collect()
    assert near == want


def test_proximity_with_changed_words(spark):
    """A term that no text has is not asked for; of the others three in four must be near."""
    texts = ["k1 x k3 y k4 z", "k1 k2 " + "x " * 50 + "k3 k4", "k4 k2 z k3", "k1 k2", "k3 " * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = decontaminate.read_items(spark.createDataFrame([(1, "k1 unseen k3 k4"), (2, "k1 k2 k3 k4")], "item_id long, text string"))
    names = {r["item"]: r["item_id"] for r in items.collect()}
    ids = {r["doc"]: r["doc_id"] for r in docs.select("doc_id", decontaminate.row_key().alias("doc")).collect()}
    got = decontaminate.near(decontaminate.build_index(docs, items), items, slop=10).collect()
    assert {(ids[r["doc"]], names[r["item"]]) for r in got} == {(0, "1"), (0, "2"), (2, "2")}


def test_suffix_array_by_hand():
    rng = random.Random(2)
    for n in (0, 1, 2, 7, 60, 300):
        for letters in (b"a", b"ab", b"abc\x00"):
            block = bytes(rng.choice(letters) for _ in range(n))
            sa = suffixes.suffix_array(block, n + 1)
            assert sa.tolist() == sorted(range(n), key=lambda i: block[i:])
            lcp = suffixes.common_prefixes(block, sa, 64)
            for j in range(1, n):
                x, y = block[sa[j]:], block[sa[j - 1]:]
                k = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
                assert lcp[j] == min(k, 64)


def test_suffix_dedup_equals_brute_force(spark, odd_docs, no_docs, monkeypatch):
    rows = odd_docs.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *c) for r, c in zip(rows, brute.cuts([r["text"] for r in rows])))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["to"] - r["from"])
    digest = ("doc_id", "n_bytes", size, F.size("removed"), F.sha2("kept", 256))
    assert Counter(map(tuple, suffixes.cut(odd_docs).select(*digest).collect())) == want
    monkeypatch.setattr(suffixes, "LONGEST_LIST", 700)  # most lists are split by Spark
    assert Counter(map(tuple, suffixes.cut(odd_docs).select(*digest).collect())) == want
    assert suffixes.cut(no_docs).count() == 0


def test_passages(spark, no_docs):
    rng = random.Random(7)
    passage, lead = made_up(rng, 60), made_up(rng, 100)
    fuzzy = list(passage)
    fuzzy[20] = "changed"
    fuzzy.insert(40, "more")
    texts = [" ".join(lead + passage + made_up(rng, 50)), " ".join(made_up(rng, 10) + passage + made_up(rng, 50)),
             " ".join(made_up(rng, 30) + fuzzy + made_up(rng, 9)), " ".join(made_up(rng, 400)), None, "", " ".join(made_up(rng, 20) + passage[:25])]
    texts += [texts[3], "x y z", "x y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = passages.repeated_passages(docs).collect()
    linked = {frozenset((r["doc_id"], r["ref_id"])) for r in got if r["kind"] == "passage"}
    assert {x for pair in linked for x in pair} == {0, 1, 2} and len(linked) == 2
    for r in got:
        here, there = texts[r["doc_id"]].split(), texts[r["ref_id"]].split()
        assert 0 <= r["start"] < r["end"] <= len(here) and 0 <= r["ref_start"] < r["ref_end"] <= len(there)
        assert r["n_equal"] >= 0.75 * (r["end"] - r["start"]) >= 30
    assert [(r["doc_id"], r["ref_id"]) for r in got if r["kind"] == "copy"] == [(7, 3)]
    assert passages.repeated_passages(no_docs).count() == 0


def test_passages_with_every_few_words_changed(spark):
    """No run of equal words is longer than the changes leave: 4 to 14 words."""
    rng = random.Random(9)
    texts = []
    for every in range(5, 16):
        passage = made_up(rng, 60)
        texts.append(made_up(rng, 30) + passage + made_up(rng, 30))
        texts.append(made_up(rng, 10) + [f"y{i}" if i % every == 0 else w for i, w in enumerate(passage)] + made_up(rng, 30))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {frozenset((r["doc_id"], r["ref_id"])) for r in passages.repeated_passages(docs).collect()}
    assert got == {frozenset((i, i + 1)) for i in range(0, len(texts), 2)}


def test_passages_with_changed_words_equal_brute_force(spark):
    """Pairs and spans against a word aligner over all pairs, at 5 to 25 % of words changed, evenly and at random."""
    rng = random.Random(3)
    texts, shares = [], (5, 10, 15, 20, 25)
    for share in shares:
        for k in range(24):
            passage = made_up(rng, 60)
            changed = [f"y{rng.random()}" if (i % (100 // share) == k % (100 // share) if k < 8 and share < 25 else rng.random() < share / 100) else w
                       for i, w in enumerate(passage)]
            texts += [made_up(rng, 40) + passage + made_up(rng, 40), made_up(rng, k) + changed + made_up(rng, 20)]
    want = {}
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(set(texts[i]) & set(texts[j])) >= 20 and (best := brute.alike(texts[i], texts[j])):
            want[i, j] = best
    assert len(want) > 90
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in passages.repeated_passages(docs).collect():
        a, b = ((r["doc_id"], r["start"], r["end"]), (r["ref_id"], r["ref_start"], r["ref_end"]))
        assert r["n_equal"] == sum(x == y for x, y in zip(texts[a[0]][a[1]:a[2]], texts[b[0]][b[1]:b[2]])) >= 0.75 * (a[2] - a[1])
        (i, *span), _ = sorted((a, b))
        got.setdefault((i, max(a[0], b[0])), []).append((r["n_equal"], *span))
    assert set(got) == set(want)
    for pair, (equal, start, end, _) in want.items():
        found = {w for _, s, e in got[pair] for w in range(s, e)}
        assert len(found & set(range(start, end))) >= 0.75 * (end - start), pair


def test_passages_cover_every_long_repeat(odd_docs):
    rows = [r for r in odd_docs.select("doc_id", "text").collect() if r["doc_id"] is not None]
    got = passages.repeated_passages(odd_docs).collect()
    named = {x for r in got for x in (r["doc_id"], r["ref_id"])}
    runs = Counter(tuple(w) for t in {r["text"] for r in rows} for w in {tuple(brute.words(t)[i:i + 60]) for i in range(len(brute.words(t)) - 59)}
                   if len(set(w)) > 30)
    for r in rows:
        w = brute.words(r["text"])
        if any(runs[tuple(w[i:i + 60])] > 1 for i in range(len(w) - 59)):
            assert r["doc_id"] in named


def test_chains_equal_the_plain_recurrence():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(2, 25))
        x, y = np.sort(rng.choice(300, n, replace=False)), rng.integers(0, 300, n)
        f = []
        for j in range(n):
            best = max([f[i] - passages.GAP * (x[j] - x[i] + y[j] - y[i]) for i in range(j) if y[i] < y[j]], default=0)
            f.append(passages.SEED + max(best, 0))
        top = passages.chains(x, y)[0]
        total = passages.SEED * len(top) - passages.GAP * (x[top[-1]] - x[top[0]] + y[top[-1]] - y[top[0]])
        assert abs(total - max(f)) < 1e-9 and sorted(np.concatenate(passages.chains(x, y))) == list(range(n))


def test_slices_and_words():
    import pyarrow as pa

    texts = ["a b  c", None, "", "x\ty\nz", " é ü ", "a b  c"]
    for limit in (1, 8, 1000):
        out = {}
        for part in tokens.slices(pa.array(texts), limit):
            s, e, of = part.words()
            for a, b, t in zip(s, e, of):
                out.setdefault(int(part.rows[t]), []).append(part.buf[a:b].tobytes().decode())
        assert out == {i: brute.words(t) for i, t in enumerate(texts) if brute.words(t)}


@pytest.mark.parametrize("fillers", [0, 2000, 12000])
def test_recall_does_not_fall_as_the_corpus_grows(spark, fillers):
    """Repeats of 60 and 100 words, exact and changed, while other texts hold their 4-word phrases."""
    rng = random.Random(fillers)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    own = lambda n: [word() for _ in range(n)]
    docs, planted, phrases = [], {}, []
    for length in (60, 100):
        for percent in (0, 5, 15, 25):
            for _ in range(12):
                passage = own(length)
                phrases += [passage[i:i + 4] for i in range(length - 3)]
                changed = list(passage)
                for i in rng.sample(range(length), length * percent // 100):
                    changed[i] = word()
                planted[(len(docs), len(docs) + 1)] = (length, percent)
                docs += [" ".join(own(20) + passage + own(20)), " ".join(own(15) + changed + own(25))]
    for _ in range(fillers):  # every phrase of every passage is in several of them
        docs.append(" ".join(w for _ in range(6) for w in own(3) + rng.choice(phrases)))
    got = passages.repeated_passages(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    pairs = {tuple(sorted((r.doc_id, r.ref_id))) for r in got}
    found = {}
    for pair, kind in planted.items():
        found.setdefault(kind, []).append(pair in pairs)
    assert all(sum(v) >= 0.9 * len(v) for (_, percent), v in found.items() if percent <= 15), found
    assert sum(sum(v) for v in found.values()) >= 0.9 * len(planted), found
    assert all(r.doc_id < 2 * len(planted) for r in got)  # no filler is taken for a repeat
