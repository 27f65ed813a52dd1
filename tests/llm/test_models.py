import collections
import math
import zlib

import numpy as np

from tests.conftest import SF_SMALL
from tests.llm import brute
from trapline.llm import langid, language_model


def test_language_of_held_out_documents(spark):
    got = langid.op3_language_id(spark, SF_SMALL.replace("0.001", "0.01")).toPandas()
    truth = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (held.lang_pred == held.lang).mean() > 0.97 and both.score.between(0, 1).all()


def test_language_of_odd_documents(odd_docs, no_docs):
    model = langid.train(odd_docs.select("text", "lang"))
    got = langid.predict(odd_docs.select("doc_id", "text"), model).collect()
    assert len(got) == odd_docs.count()
    text = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in got:
        letters = any(c.isalpha() for c in text[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (r["score"] == 0) == (not letters)
        assert r["lang_pred"] in ("en", "fr", "und")
    assert langid.predict(no_docs.select("doc_id", "text"), model).count() == 0
    untrained = langid.train(no_docs.select("text", "lang"))
    assert {r["lang_pred"] for r in langid.predict(odd_docs.select("doc_id", "text"), untrained).collect()} == {"und"}


def test_languages_in_blocks_score_alike(odd_docs, monkeypatch):
    """More languages than a block of the matrix holds change no result."""
    labelled = odd_docs.selectExpr("text", "concat(lang, doc_id % 4) AS lang")
    docs = odd_docs.select("doc_id", "text")
    want = sorted(langid.predict(docs, langid.train(labelled)).collect(), key=str)
    monkeypatch.setattr(langid, "MATRIX_BYTES", 3 * langid.FEATURES * 4)
    got = sorted(langid.predict(docs, langid.train(labelled)).collect(), key=str)
    assert len({r["lang_pred"] for r in want}) >= 5
    assert [tuple(r)[:3] for r in got] == [tuple(r)[:3] for r in want]
    assert np.allclose([r["score"] for r in got], [r["score"] for r in want], rtol=1e-9)


def plain_grams(text):
    s = ""
    for c in (text or "") + " ":
        low = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
        if low != " " or not s.endswith(" "):
            s += low
    return [s[i:i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if n > 1 or s[i] != " "]


def test_predictions_equal_plain_naive_bayes(spark):
    """Language and posterior of every text, against counts of the n-grams themselves; texts stand anywhere in a batch."""
    import random

    rng = random.Random(8)
    alphabets = {"aa": "abcdeé ", "bb": "cdefgß ", "cc": "жзийк ", "dd": "efghİa "}
    rows = [(i, "".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(0, 12))) + rng.choice(["", ".", " 1", "x"]), lang)
            for i in range(160) for lang in [list(alphabets)[i % 4]]]
    rows += [(500, None, "aa"), (501, "\U000F0000\U000F0001", "bb"), (502, "\U000E0041\U000E0042 12", "cc"), (503, "\U00020000\U0002F800", "dd"), (504, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    features = 1 << 20
    got = {r.doc_id: r for r in langid.predict(docs.select("doc_id", "text"), langid.train(docs.select("text", "lang"), features)).collect()}
    counts, texts = collections.defaultdict(collections.Counter), collections.Counter()
    for _, t, lang in rows:
        if lang:
            counts[lang].update(plain_grams(t))
            texts[lang] += 1
    total = {k: sum(c.values()) for k, c in counts.items()}
    for i, t, _ in rows:
        log = {k: math.log(texts[k] / sum(texts.values())) + sum(math.log((c[g] + .5) / (total[k] + .5 * features)) for g in plain_grams(t))
               for k, c in sorted(counts.items())}
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        best = max(log, key=log.get)
        want = 1 / sum(math.exp(v - log[best]) for v in log.values())
        assert got[i].lang_pred == best or want < 0.51
        assert math.isclose(got[i].score, want, rel_tol=2e-3)


def test_grams_by_hand():
    feature, of, has = langid.grams(["Ab 1", "", "??", "ab"], 1 << 16)
    one, two = sorted(feature[of == 0].tolist()), sorted(feature[of == 3].tolist())
    assert has.tolist() == [True, False, False, True] and not (of == 1).any()
    assert two == one and len(two) == 5  # a, b, ab, b_, ab_: a text's end counts wherever it stands in a batch


def tokens(text):
    return [*brute.words(brute.lower(text)), None]


def test_scores_equal_brute_force(spark, odd_docs, monkeypatch):
    learned = []
    real = language_model.learn
    monkeypatch.setattr(language_model, "learn", lambda *a: learned.append(real(*a)) or learned[-1])
    docs = odd_docs.select("doc_id", "text")
    got = sorted(language_model.scored(docs).collect(), key=str)
    rows = docs.collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    one, two, starts = collections.Counter(), collections.Counter(), 0
    for r in rows:
        if not held(r["doc_id"]):
            t = tokens(r["text"])
            one.update(t)
            two.update(zip(["<s>", *t], t))
            starts += 1
    n, v = sum(one.values()), len(one)
    want = []
    for r in rows:
        t, base, score = tokens(r["text"]), 0.0, 0.0
        for h, w in zip(["<s>", *t], t):
            c = starts if h == "<s>" else one[h]
            l0, l1, l2 = learned[0][int(math.log2(c + 1))]
            base += math.log10((one[w] + 1) / (n + v + 1))
            score += math.log10(l0 / (v + 1) + l1 * one[w] / n + l2 * (two[h, w] / c if c else 0))
        want.append((r["doc_id"], held(r["doc_id"]), len(t), sum(one[w] > 0 for w in t), n, base, score))
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert tuple(g)[:5] == w[:5]
    g, w = (sorted((x[5], x[6]) for x in y) for y in (got, want))
    assert np.allclose(g, w, rtol=1e-9, atol=1e-9)


def test_expectation_maximisation():
    """Events that only one component explains get its weight."""
    cells = np.array([[3, -4, 1, 900], [3, 1, -8, 100]], np.int64)
    weights = language_model.learn(cells, 1e-9)
    assert weights[3][2] > 0.85 and 0.05 < weights[3][1] < 0.15 and abs(weights[3].sum() - 1) < 1e-9


def test_model_beats_the_base_on_held_out_documents(spark):
    got = language_model.op8_lm_scoring(spark, SF_SMALL.replace("0.001", "0.01")).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_many_equal_rows_count_as_often(spark, monkeypatch):
    """A third of the rows are one document: the same scores as with each row counted by itself, and blocks stay small."""
    rows = [(7 if i % 3 == 0 else 100 + i, "one text of many copies" if i % 3 == 0 else f"text number {i} of {i % 10}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(language_model, "MOST_TIMES", 300)
    few = language_model.rows_with_times(docs)
    assert sorted(r.times for r in few.where("doc_id = 7").collect()) == [100, 300, 300, 300] and few.count() == 2004
    got = sorted(map(tuple, language_model.scored(docs).collect()))
    monkeypatch.setattr(language_model, "SAME_ROWS", 10 ** 9)
    want = sorted(map(tuple, language_model.scored(docs).collect()))
    assert len(got) == 3000 and [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12)
    # the deleted tenth may differ, as copies are dealt apart: the weights are near
    assert np.allclose([g[6] for g in got], [w[6] for w in want], rtol=0.05)


def test_no_documents(no_docs):
    assert language_model.scored(no_docs.select("doc_id", "text")).count() == 0
