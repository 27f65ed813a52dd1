"""Operators 11 to 13 against plain versions: odd rows, hot groups, long linked lists."""
import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from trapline.llm import negatives, ranking, sketches, trie
from trapline.llm.running import running


# ---- 11: bottom-k sketches

def pairs_set(text):
    w = brute.words(brute.lower(text))
    return {tuple(w[i:i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()


def groups(texts):
    found, of = [pairs_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            x, y = found[i], found[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((root(i), root(j)))
                of[b] = a
    return [len(x) for x in found], [root(i) for i in range(len(texts))]


def check_duplicates(spark, docs):
    got = {r.doc_id: r for r in sketches.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    size, root = groups([t for _, t in docs])
    for i, (doc_id, _) in enumerate(docs):
        assert (got[doc_id].n_shingles, got[doc_id].component_id, got[doc_id].kept) == (size[i], docs[root[i]][0], root[i] == i)


def test_chains_of_near_copies(spark, monkeypatch):
    """A long list (a group of near copies, some of which miss its leader) and pairs at the threshold."""
    monkeypatch.setattr(sketches, "SHORT_LIST", 6)
    monkeypatch.setattr(sketches, "BLOCK_SETS", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for k in range(60):
        w = list(base)
        for i in range(k % 9):
            w[(7 * k + 13 * i) % 120] = f"x{k}{i}"
        docs.append((len(docs), " ".join(w)))
    for k in range(25):  # drifting copies: neighbours link, ends don't
        docs.append((len(docs), " ".join([f"d{i}" for i in range(3 * k, 3 * k + 100)])))
    for k in range(30):
        docs.append((len(docs), " ".join(rng.choice(["the", "of", "and", "in", f"z{k}"]) for _ in range(rng.randint(1, 60)))))
    for k in range(12):  # short texts, where one word decides
        docs.append((len(docs), " ".join(f"s{i}" for i in range(k % 6 + 4 * (k > 5)))))
    check_duplicates(spark, docs)


def test_unrelated_sets_of_long_lists_are_not_read(spark, monkeypatch):
    """Texts of few words share all their lists, which are long; only near copies are compared as whole sets."""
    monkeypatch.setattr(sketches, "SHORT_LIST", 10)
    monkeypatch.setattr(sketches, "BLOCK_SETS", 8)
    read, in_blocks, whole_sets, links_in_blocks = [], [], sketches.whole_sets, sketches.links_in_blocks

    def reading(docs, classes, wanted):
        read.append(wanted.count())
        return whole_sets(docs, classes, wanted)

    def comparing(outside, inside, whole):
        in_blocks.append(outside.count() + inside.count())
        return links_in_blocks(outside, inside, whole)

    monkeypatch.setattr(sketches, "whole_sets", reading)
    monkeypatch.setattr(sketches, "links_in_blocks", comparing)
    rng = random.Random(8)
    texts = [[rng.choice([f"w{i}" for i in range(20)]) for _ in range(60)] for _ in range(120)]
    texts += [[*t[:30], "other", *t[31:]] for t in texts[::30]]
    check_duplicates(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    assert sum(read) <= 8 and sum(in_blocks) == 0


def test_block_links_by_whole_sets():
    """Links that leave a block: one for each two components that link, by exact Jaccard."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    found = []
    for k in range(40):
        x = base.copy()
        x[rng.choice(400, 2 * k, replace=False)] = rng.integers(0, 1 << 63, 2 * k).astype(np.uint64)
        found.append(np.unique(x))
    asks = [k % 3 == 0 for k in range(40)]
    rows = pa.table({"c": np.arange(40), "comp": np.arange(40), "asks": asks, "shingles": [x.tobytes() for x in found]})
    near = {(i, j) for i in range(40) for j in range(40) if asks[i] and not asks[j] and sketches.linked(found[i], found[j])}
    got = sketches._block_links(rows)

    def parts(links):
        of = list(range(40))
        for a, b in links:
            of = [of[b] if x == of[a] else x for x in of]
        return {frozenset(i for i in range(40) if of[i] == x) for x in of}

    assert set(got) <= near and parts(got) == parts(near) and len(got) == 40 - len(parts(near))


def test_a_third_of_the_rows_are_equal(spark):
    docs = [(i, "one and the same text here" if i % 3 == 0 else f"text number {i} of its own {i * 7}") for i in range(600)]
    check_duplicates(spark, docs)


def test_sketch_rows_odd(spark, odd_docs, no_docs):
    rows = sketches.near_duplicates(odd_docs)
    assert rows.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    size, root = groups([t for _, t in docs])
    smallest = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            smallest[root[i]] = min(smallest.get(root[i], doc_id), doc_id)
    want = sorted((str(d), size[i], smallest.get(root[i]) if size[i] else d) for i, (d, _) in enumerate(docs))
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in rows.collect()) == want
    assert sketches.near_duplicates(no_docs).count() == 0


def test_union_estimate():
    rng = np.random.default_rng(1)
    for n, same in ((500, 480), (500, 40), (40, 38), (40, 3)):
        pool = np.unique(rng.integers(0, 1 << 63, 4 * n).astype(np.uint64))
        pool = rng.permutation(pool)
        a, b = np.sort(pool[:n]), np.sort(pool[n - same:2 * n - same])
        assert sketches.estimated([a], [b])[0] == (same / (2 * n - same) > .4375)
        assert sketches.linked(a, b) == (same / (2 * n - same) >= .8)


# ---- 12: segment summaries

def hard(rows):
    """rows: (vec_id, vector, label); ids may be null, so results are by place."""
    good = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = (i, label, tuple(int(min(max(math.floor(256 * x), -(1 << 24)), 1 << 24)) for x in v))
        good.append(r)
    out = set()
    key = lambda sr: (-sr[0], sr[1] is None, sr[1] or 0)
    for a, label, v in {r for r in good if r[0] is not None and r[0] % 100 == 0}:
        score = lambda w: sum(x * y for x, y in zip(v, w))
        same = sorted({(score(w), i) for i, lab, w in good if lab == label and i != a}, key=key)[:5]
        other = sorted({(score(w), i) for i, lab, w in good if lab != label}, key=key)
        for p, i in same:
            fit = [(s, j) for s, j in other if 80 * p <= 100 * s <= 100 * p][:5]
            out |= {(a, i, k + 1, j, p, s) for k, (s, j) in enumerate(fit)}
    return out


def check_negatives(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = [tuple(r) for r in negatives.hard_negatives(df).collect()]
    assert set(got) == hard([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    return got


@pytest.mark.parametrize("width", [3, 16, 70])
def test_negatives(spark, width, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS_A_TILE", 150)
    monkeypatch.setattr(negatives, "ANCHORS_A_TILE", 2)
    monkeypatch.setattr(negatives, "ROWS_AT_ONCE", 32)
    rng = np.random.default_rng(width)
    centres = rng.normal(size=(4, width))
    rows = [(i, (centres[i % 4] * (.2 if i % 3 else 1) + rng.normal(size=width) * .3).tolist(), i % 3) for i in range(700)]
    assert len(check_negatives(spark, rows)) > 30


def test_negatives_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist(), i % 2) for i in range(100)]
    rows += [(i, rows[0][1], i % 2) for i in range(100, 160)]            # a hot vector: ties by id
    rows += [(200, None, 1), (300, [1.0, None] * 4, 1), (400, [math.nan] * 8, 0), (500, [math.inf] * 8, 0), (600, [.5] * 8, None)]
    rows += [(700, [], 1), (800, [.5, .25], 0), (900, [1e30, -1e30] * 4, 1), (None, rows[0][1], 0), (None, rows[0][1], 1)]
    rows += [rows[0], rows[0], (100, [.1] * 8, 1), (1000, [-1.0] * 8, 0), (1100, [3e5] * 8, 0), (1101, [3e5] * 8, 0), (1102, [2.9e5] * 8, 1)]
    got = check_negatives(spark, rows)
    assert any(r[0] == 1100 for r in got)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, row string, anchor string, v string")
    assert negatives.hard_negatives(empty).count() == 0


def test_bounds_hold():
    """Every level's bounds hold the exact product."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    vec = [rng.integers(-300, 300, 50).astype(np.int32) for _ in range(60)]
    rows = pa.table({"vec_id": list(range(60)), "label": [0] * 60, "vec": [v.tobytes() for v in vec], "summary": [negatives._summary(v).tobytes() for v in vec]})
    us, them = negatives.sides(rows, rows)
    every = np.arange(60)
    pairs = np.nonzero(np.ones((60, 60), bool))
    exact = negatives.scores(us, every, them, every, pairs)
    assert len(us.levels) == 3
    width = []
    for level in range(3):
        lo, hi = negatives.bounds(us, every, them, every, level, pairs)
        assert (lo <= exact).all() and (exact <= hi).all()
        width.append((hi - lo).mean())
    assert width[0] > width[1] > width[2]


# ---- 13: conversation trie

def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).digest(), text or ""))
    seq = {c: [(r, t) for *_, r, _, t in sorted(v, key=lambda x: x[:4])] for c, v in convs.items()}
    built = {}
    for c, own in seq.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        built[c] = tuple(seq.get(base, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    out = set()
    for s, members in nodes.items():
        below = [x for x in nodes if x[:len(s)] == s]
        leaves = sum(not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in nodes) for x in below)
        saved = sum((len(nodes[x]) - 1) * len(brute.words(x[-1][1])) for x in below if x)
        kids = sum(len(x) == len(s) + 1 for x in below)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(s)))
        out.add((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, node string, seq string, pos string, depth string"


def check_trie(spark, rows):
    df = spark.createDataFrame([(*r, "", "", "", "") for r in rows], SCHEMA)
    got = [tuple(r) for r in trie.prefix_trie(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_trie(rows)


def test_trie(spark, monkeypatch):
    """Shared openings, many children, hot copies; the tour is ranked over several levels."""
    monkeypatch.setattr(ranking, "LAST", 8)
    monkeypatch.setattr(ranking, "GAP", 4)
    monkeypatch.setattr(trie, "CHUNK_IDS", 3)
    rng = random.Random(4)
    rows = []
    for c in range(130):
        n = rng.randint(1, 7)
        kind = c % 3  # a third are copies of one conversation
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} said" if kind == 0 else f"{rng.randint(0, 2)} words {t}") for t in range(n)]
    rng.shuffle(rows)
    check_trie(spark, rows)


def test_trie_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, None, None, None), (1, 0, "user", "hi"), (1, 0, "system", "b a"), (41, 5, "user", ""), (41, 3, None, "x y  z"),
            (None, 0, "user", "lost"), (20, 0, "user", "a"), (20, 1, "", "b"), (21, 0, "user", "a"), (22, 7, "user", "a"), (-3, 0, "user", "a"),
            (-20, 0, "user", "q"), (7, 0, "user", "long " * 5000), (8, 0, "user", "long " * 5000), (5, 0, "u", "1"), (6, 0, "u", "1"), (9, 0, "u", "1")]
    rows += [(400, i, "user", f"{i // 7}") for i in range(300)]  # one conversation holds most turns
    check_trie(spark, rows)
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ranks_of_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(ranking, "LAST", 16)
    order = list(range(3000))
    random.Random(1).shuffle(order)
    links = [(a, b, a % 5) for a, b in zip(order, [*order[1:], None])]
    got = dict(map(tuple, ranking.ranked(spark.createDataFrame(links, "id long, next long, dist long")).collect()))
    total = 0
    for a in reversed(order):
        total += a % 5
        assert got[a] == total


def test_running_totals_span_ranges(spark):
    from pyspark.sql import functions as F

    rows = [("hot" if i % 3 else f"g{i % 50}", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, i long").repartition(7)
    got = running(df, ["g"], ["i"], total=("sum", F.col("i")), bits=("xor", F.col("i"))).collect()
    want, bits = defaultdict(int), defaultdict(int)
    for r in sorted(got, key=lambda r: r.i):
        want[r.g] += r.i
        bits[r.g] ^= r.i
        assert (r.total, r.bits) == (want[r.g], bits[r.g])
    assert len(got) == 4000
