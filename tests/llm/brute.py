"""Plain Python versions of the operators, for small inputs."""
from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter

SPACE_WORD = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return SPACE_WORD.findall(text or "")


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    text = text or ""
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = {i + j for i, t in enumerate(zip(w, w[1:], w[2:])) if windows[t] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    n, chars, symbols = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text)
    dup = len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(hit) > 50 * n
    upper, letters = sum("A" <= c <= "Z" for c in text), sum(c.isascii() and c.isalpha() for c in text)
    bad = 100 * symbols > 10 * n or 100 * dup > 50 * len(lines) or 100 * upper > 50 * letters or chars < 2 * n or chars > 15 * n
    return n, chars, symbols, dup, len(hit), failed, not (failed or bad)


def shingle_set(text):
    w = words(lower(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(texts):
    """For each text the number of the first text it reaches by links."""
    sets, of = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        x, y = sets[i], sets[j]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((root(i), root(j)))
            of[b] = a
    return [root(i) for i in range(len(texts))]


def leaks(text, items):
    """n_words, n_hit, n_items, items_sha256 of a text against (item_id, text) rows."""
    w = TERM.findall(lower(text))
    hit, ids = set(), set()
    for item, item_text in items:
        v = TERM.findall(lower(item_text))
        k = min(10, len(v))
        windows = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i:i + k]) in windows:
                hit |= set(range(i, i + k))
                ids.add("null" if item is None else str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def cuts(texts, length=200):
    """n_bytes, n_removed, n_spans, kept_sha256 of each text against all."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def alike(here, there, least=45):
    """(equal words, start, end, start there) of the best part on any diagonal that has three equal words in four and ``least`` words, or None."""
    best = None
    for d in range(least - len(there), len(here) - least + 1):
        a = max(d, 0)
        same = [x == y for x, y in zip(here[a:], there[a - d:])]
        if 4 * sum(same) < 3 * least:
            continue
        total = [0, *itertools.accumulate(1 if x else -3 for x in same)]
        for i, j in itertools.combinations(range(len(total)), 2):
            if j - i >= least and total[j] >= total[i] and same[i] and same[j - 1]:
                best = max(best or (0,), (sum(same[i:j]), a + i, a + j, a + i - d))
    return best
