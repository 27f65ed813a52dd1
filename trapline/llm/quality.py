"""Quality rules (7): a short-circuit cascade ordered by rejection per cost.

Each rule rejects a text from one feature.  On a sample, a bounded part of every
split and judged in its task (only sums reach the driver), the operator measures what a rule costs (seconds per byte of text) and how often it rejects;
the cascade runs the rules by falling rejection per cost, and a rule sees only
the texts that all rules before it let pass.  The order changes the work, never
the verdict: a text is kept if no rule rejects it.

Defined cases: a null or empty text has no words, so ``min_words`` rejects it;
very long texts are judged whole; repeated rows are judged alike, one by one;
an empty table gives an empty result; other columns are carried, but for those
with the name of a column that the operator adds, which replaces them.
"""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.llm.tables import table
from trapline.llm.tokens import P, Slice, mix, shingles, slices

# fixed values: thresholds of the rules
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 50
MAX_UPPER_PERCENT = 50
MIN_MEAN_WORD, MAX_MEAN_WORD = 2, 15
SYMBOLS = b"#*$%&|<>"

#: Rows of a split in the sample that orders the cascade (it decides the order of work only).
SAMPLE_ROWS = 256
SAMPLE_SHARE = 0.1

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER, _LOWER, _SPACE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _LOWER[97:123], _SPACE[[9, 10, 11, 12, 13, 32]] = True, True, True


class Features:
    """Features of the texts of a slice, each computed once when first asked for."""

    def __init__(self, texts: Slice):
        self.texts, self._made = texts, {}

    def __getattr__(self, name: str) -> np.ndarray:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = getattr(self, f"_get_{name}")()
        return self._made[name]

    def _get_words(self):
        return self.texts.words()

    def _get_n_words(self):
        return np.bincount(self.words[2], minlength=len(self.texts))

    def _get_word_chars(self):
        buf = self.texts.buf  # code points: all bytes but UTF-8 continuations
        return self.texts.per_text(((buf & 0xC0) != 0x80) & ~_SPACE[buf])

    def _get_n_symbols(self):
        return self.texts.per_text(_SYMBOL[self.texts.buf])

    def _get_upper(self):
        return self.texts.per_text(_UPPER[self.texts.buf])

    def _get_letters(self):
        return self.upper + self.texts.per_text(_LOWER[self.texts.buf])

    def _get_lines(self):
        """(hash, text number) of the lines that hold a word."""
        buf, off = self.texts.buf, self.texts.offsets
        starts, ends, of = self.texts.spans(buf != 10)
        seen = np.concatenate(([0], np.cumsum(~_SPACE[buf], dtype=np.int64)))
        full = seen[ends] > seen[starts]
        return self.texts.hashes(starts[full], ends[full]), of[full]

    def _get_n_lines(self):
        return np.bincount(self.lines[1], minlength=len(self.texts))

    def _get_n_dup_lines(self):
        value, of = self.lines
        order = np.lexsort((value, of))
        value, of = value[order], of[order]
        again = (value[1:] == value[:-1]) & (of[1:] == of[:-1])
        return np.bincount(of[1:][again], minlength=len(self.texts))

    def _get_n_repeat_words(self):
        starts, ends, of = self.words
        n = len(self.texts)
        value, text, first = shingles(self.texts.hashes(starts, ends), of, n, 3, short=False)
        value = mix(value + text.astype(np.uint64) * P)  # windows count inside their own text
        order = np.argsort(value, kind="stable")
        same = value[order][1:] == value[order][:-1]
        again = np.zeros(len(value), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        hit = np.zeros(len(starts), bool)
        for j in range(3):
            hit[first[again] + j] = True
        return np.bincount(of[hit], minlength=n)


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives, from the features, a flag for each text."""

    name: str
    rejects: Callable[[Features], np.ndarray]


#: The rules of the contract first; any order gives the same verdicts.
RULES = (
    Rule("min_words", lambda f: f.n_words < MIN_WORDS),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > MAX_REPEAT_PERCENT * f.n_words),
    Rule("symbols", lambda f: 100 * f.n_symbols > MAX_SYMBOL_PERCENT * f.n_words),
    Rule("repeated_lines", lambda f: 100 * f.n_dup_lines > MAX_DUP_LINE_PERCENT * f.n_lines),
    Rule("upper_case", lambda f: 100 * f.upper > MAX_UPPER_PERCENT * f.letters),
    Rule("word_length", lambda f: (f.word_chars < MIN_MEAN_WORD * f.n_words) | (f.word_chars > MAX_MEAN_WORD * f.n_words)),
)


def _texts_of(texts: Slice, rows: np.ndarray) -> Slice:
    """The slice's texts with the given numbers only."""
    if len(rows) == len(texts):
        return texts
    parts = [texts.buf[texts.offsets[i]:texts.offsets[i + 1]] for i in rows]
    out = object.__new__(Slice)
    out.buf = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    out.offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))).astype(np.int64)
    out.rows = texts.rows[rows]
    return out


def cascade(texts: Slice, rules: tuple[Rule, ...]) -> np.ndarray:
    """Number of the first rule that rejects each text, -1 for a text that is kept."""
    by, left = np.full(len(texts), -1), np.arange(len(texts))
    for k, rule in enumerate(rules):
        if not left.size:
            break
        hit = rule.rejects(Features(_texts_of(texts, left)))
        by[left[hit]] = k
        left = left[~hit]
    return by


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds per MB, share rejected) on a share of every split's rows, at most ``sample_rows`` of each, judged where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, hits, size, left = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0, sample_rows
        for batch in batches:
            if left <= 0:
                continue
            texts = batch.column(0).slice(0, left)
            left -= len(texts)
            for part in slices(texts):
                size += len(part.buf)
                for k, rule in enumerate(rules):
                    began = time.thread_time()
                    hits[k] += int(rule.rejects(Features(part)).sum())
                    seconds[k] += time.thread_time() - began
        yield pa.RecordBatch.from_pydict({"rule": np.arange(len(rules)), "seconds": seconds, "hits": hits, "size": np.full(len(rules), size),
                                          "texts": np.full(len(rules), sample_rows - left)})

    sums = (docs.select("text").sample(SAMPLE_SHARE, seed=7).mapInArrow(run, "rule long, seconds double, hits long, size long, texts long")
            .groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("seconds", "hits", "size", "texts")]).collect())
    of = {r["rule"]: r for r in sums}
    return [(rule.name, of[k]["seconds"] / max(of[k]["size"], 1) * 1e6, of[k]["hits"] / max(of[k]["texts"], 1)) if k in of else (rule.name, 0.0, 0.0)
            for k, rule in enumerate(rules)]


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by falling rejection per cost on the sample."""
    worth = {name: share / max(cost, 1e-9) for name, cost, share in measured(docs, rules, sample_rows)}
    return tuple(sorted(rules, key=lambda r: -worth[r.name]))


def judge(docs: DataFrame, rules: tuple[Rule, ...] | None = None, text: str = "text",
          features: tuple[str, ...] = (), carry: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with ``kept`` and ``rejected_by`` (the cascade's first rejecting rule), and the features asked for.

    ``carry``: the columns of ``docs`` to return (default: all).
    """
    order = rules or ordered(docs.select(F.col(text).alias("text")))
    names = [r.name for r in order]
    kept = [c for c in docs.columns if (carry is None or c in carry) and c not in {"kept", "rejected_by", *features}]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("kept", T.BooleanType()),
                           T.StructField("rejected_by", T.StringType()),
                           *[T.StructField(f, T.LongType()) for f in features]])
    at, back = docs.columns.index(text), [docs.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by, more = np.full(batch.num_rows, -1), {f: np.zeros(batch.num_rows, np.int64) for f in features}
            for part in slices(batch.column(at)):
                by[part.rows] = cascade(part, order)
                made = Features(part)
                for f in features:
                    more[f][part.rows] = getattr(made, f)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in back], pa.array(by < 0), pa.array([None if k < 0 else names[k] for k in by], pa.string()),
                 *[pa.array(more[f]) for f in features]], names=schema.names)

    return docs.mapInArrow(run, schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = judge(docs, features=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
                carry=("doc_id",))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), "kept")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c, len(ws) AS n
      FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
v AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM p WHERE i + 2 <= n),
h AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM v, (VALUES (0), (1), (2)) t(j) WHERE k >= 2 GROUP BY r),
l AS (SELECT r, line, count(*) AS k FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
m AS (SELECT r, CAST(sum(k) AS BIGINT) AS n_lines, CAST(sum(k - 1) AS BIGINT) AS n_dup_lines FROM l GROUP BY r),
f AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper,
             length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters
      FROM d JOIN w USING (r) LEFT JOIN h USING (r) LEFT JOIN m USING (r)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR 100 * upper > 50 * letters OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM g
"""
