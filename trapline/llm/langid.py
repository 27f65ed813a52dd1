"""Language ID (3): multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of 1 to 3 characters of all labelled training texts,
hashed to a fixed number of features; Spark sums the counts per (language,
feature).  The log-probability matrix has languages x features numbers; it is
broadcast, in blocks of languages of bounded size that score one after another if
they are many (256 languages fit one block).  Scoring hashes a slice of texts
at a time in numpy and adds up the matrix rows of its n-grams.

Texts are lower-cased and runs of other characters than letters count as one
space, so digits, marks and layout say nothing about the language.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a
text is scored whole; ties go to the language first in code-point order; without
training rows every text is ``und``; a null doc_id counts as the empty id for the
held-out rule; repeated rows and other columns do no harm (only doc_id, text and
lang are read).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm.tables import materialize, table
from trapline.llm.tokens import mix, slices

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Bound of a broadcast block of the matrix; languages that it does not hold are in further blocks.
MATRIX_BYTES = 64 << 20
SLICE_BYTES = 1 << 20
HELD_OUT = 2  # crc32(doc_id as text) mod 4


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def _letters() -> np.ndarray:
    """For each code point its lower-cased code point if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(len(out)):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTERS: list[np.ndarray] = []


def grams(texts: list[str], features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of every n-gram, its text number, and whether each text has a letter."""
    if not _LETTERS:
        _LETTERS.append(_letters())
    fold = _LETTERS[0]
    points = np.frombuffer("".join(t + " " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(texts)), np.array([len(t) + 1 for t in texts], np.int64))
    letter = fold[points]
    has = np.bincount(of[letter > 0], minlength=len(texts)) > 0
    # every run of other characters becomes one space; texts stay apart by it
    keep = np.ones(len(letter), bool)
    keep[1:] = (letter[1:] > 0) | (letter[:-1] > 0) | (of[1:] != of[:-1])
    letter, of = letter[keep].astype(np.uint64), of[keep]
    found, texts_of, value = [], [], np.zeros(len(letter), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        value = (value[:len(letter) - n + 1] << np.uint64(21)) | letter[n - 1:] if n > 1 else letter
        if n in ORDERS:
            inside = of[n - 1:] == of[:len(of) - n + 1]
            if n == 1:
                inside = inside & (letter > 0)
            found.append((mix(value[inside] * np.uint64(8) + np.uint64(n)) % np.uint64(features)).astype(np.int64))
            texts_of.append(of[:len(of) - n + 1][inside])
    return np.concatenate(found), np.concatenate(texts_of), has


def _parts(column: pa.Array) -> Iterator[tuple[np.ndarray, list[str]]]:
    for part in slices(column, SLICE_BYTES):
        yield part.rows, column.slice(int(part.rows[0]), len(part)).to_pylist()


def train(labelled: DataFrame, features: int = FEATURES) -> tuple[list[str], DataFrame, np.ndarray, int]:
    """(languages, counts (lang, feature, n), log priors, number of features) from (text, lang), all rows counted.

    The driver gets a name and a number of texts a language; feature ``features`` counts texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def done() -> Iterator[pa.RecordBatch]:
            for name, v in sums.items():
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "feature": at, "n": v[at]})
            sums.clear()

        for batch in batches:
            lang = np.array(batch.column(1).to_pylist(), object)
            for rows, texts in _parts(batch.column(0)):
                feature, of, _ = grams([t or "" for t in texts], features)
                for name in set(lang[rows]):
                    mine = lang[rows] == name
                    if name not in sums:
                        if len(sums) * features * 8 >= MATRIX_BYTES:
                            yield from done()
                        sums[name] = np.zeros(features + 1, np.int64)
                    sums[name][:-1] += np.bincount(feature[mine[of]], minlength=features)
                    sums[name][-1] += int(mine.sum())  # the last number counts texts
        yield from done()

    counted = materialize(labelled.where("lang is not null").select("text", "lang").mapInArrow(count, "lang string, feature bigint, n bigint")
                          .groupBy("lang", "feature").agg(F.sum("n").alias("n")))
    texts = {r["lang"]: r["n"] for r in counted.where(F.col("feature") == features).collect()}
    langs = sorted(texts)
    of = np.array([texts[name] for name in langs], float)
    return langs, counted, np.log(np.maximum(of, 1) / max(of.sum(), 1)), features


def matrix(counted: DataFrame, langs: list[str], features: int) -> np.ndarray:
    """The log-probabilities, features x the given languages."""
    got = counted.where(F.col("lang").isin(langs) & (F.col("feature") < features)).toPandas()
    counts = np.zeros((features, len(langs)))
    if len(got):
        at = {name: i for i, name in enumerate(langs)}
        counts[got["feature"].to_numpy(dtype=np.int64), got["lang"].map(at).to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=float)
    return (np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0, keepdims=True) + SMOOTHING * features)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], DataFrame, np.ndarray, int]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for (doc_id, text): the most probable language and its posterior."""
    langs, counted, prior, features = model
    names = np.array([*langs, "und"], object)
    context = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scorer(shared, first: int, last: bool):
        """Adds the languages from ``first`` on to the best one so far, its log-probability, and the sum of all relative to it."""

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            logp, prior = shared.value
            for batch in batches:
                best, top, rest = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (3, 4, 5))
                for rows, texts in _parts(batch.column(2)):
                    texts = [t or "" for t in texts]
                    feature, of, has = grams(texts, len(logp))
                    total = np.tile(prior, (len(texts), 1))
                    for j in range(len(prior)):
                        total[:, j] += np.bincount(of, logp[feature, j], minlength=len(texts))
                    most = np.maximum(total.max(axis=1), top[rows])
                    best[rows] = np.where(has, np.where(most > top[rows], first + total.argmax(axis=1), best[rows]), len(langs))
                    rest[rows] = rest[rows] * np.exp(top[rows] - most) + np.exp(total - most[:, None]).sum(axis=1)
                    top[rows] = most
                if last:
                    post = np.where(best < len(langs), 1 / np.maximum(rest, 1), 0.0)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(post)],
                                                     names=["doc_id", "held_out", "lang_pred", "score"])
                else:
                    yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(best), pa.array(top), pa.array(rest)],
                                                     names=["doc_id", "held_out", "text", "best", "top", "rest"])

        return score

    got = docs.select("doc_id", held_out().alias("held_out"), "text", F.lit(len(langs)).cast("long").alias("best"),
                      F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("rest"))
    if not langs:
        return got.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    width = max(MATRIX_BYTES // (features * 4), 1)
    for a in range(0, len(langs), width):
        last = a + width >= len(langs)
        shared = context.broadcast((matrix(counted, langs[a:a + width], features), prior[a:a + width]))
        got = got.mapInArrow(scorer(shared, a, last), f"doc_id {kind}, held_out boolean, " + (
            "lang_pred string, score double" if last else "text string, best long, top double, rest double"))
    return got


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs.select("doc_id", "text"), train(docs.where(~held_out()).select("text", "lang")))
