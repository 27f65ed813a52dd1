"""Vectorised tokenisation of Arrow string columns (numpy, used inside tasks).

Texts are handled as UTF-8 bytes in slices of a few MB, so that the working
arrays of a task stay small whatever the Arrow batch holds; a single longer text
is a slice of its own.  Null texts count as empty.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
P = np.uint64(0x9E3779B97F4A7C15 | 1)
P_INV = np.uint64(pow(int(P), -1, 1 << 64))
SPACES = b" \t\n\x0b\x0c\r"

_WORD = np.ones(256, bool)
_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slice:
    """Consecutive texts: ``buf`` bytes, ``offsets`` (n + 1), ``rows`` their row numbers in the batch."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, first: int):
        self.buf, self.offsets, self.rows = buf, offsets, np.arange(first, first + len(offsets) - 1)

    def __len__(self) -> int:
        return len(self.rows)

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def lower(self) -> Slice:
        """A-Z lower-cased, other bytes as they are."""
        out = object.__new__(Slice)
        out.buf, out.offsets, out.rows = _LOWER[self.buf], self.offsets, self.rows
        return out

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of true bytes in each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of ``inside`` bytes that stay in one text: starts, ends, text numbers."""
        n = len(self.buf)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before[edge], after[edge - 1] = False, False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def words(self):
        """``[^\\x20\\x09-\\x0D]+``: starts, ends, text numbers."""
        return self.spans(_WORD[self.buf])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte span."""
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * powers(P, len(self.buf)), out=total[1:])
        return mix((total[ends] - total[starts]) * powers(P_INV, len(self.buf) + 1)[starts]
                   + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) mod 2^64; kept up to a few slices' length."""
    got = _POWERS.get(int(base), np.ones(1, np.uint64))
    if len(got) >= n:
        return got[:n]
    with np.errstate(over="ignore"):
        while len(got) < n:
            got = np.concatenate((got, got * (got[-1] * base)))
    if len(got) <= 4 * SLICE_BYTES:
        _POWERS[int(base)] = got
    return got[:n]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a string or binary column, in order, a few MB at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        last = min(last, n)
        yield Slice(data[off[first]:off[last]], off[first:last + 1] - off[first], first)
        first = last


def shingles(hashes: np.ndarray, texts: np.ndarray, n_texts: int, k: int, short: bool = True):
    """Hashes of k consecutive words inside a text: (hash, text number, first word).

    ``short``: a text of fewer words, but not none, gives its whole sequence as one.
    """
    count = np.bincount(texts, minlength=n_texts)
    first = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(len(hashes))
    room = first[texts + 1] - at
    whole = np.flatnonzero(room >= k)
    out = np.zeros(len(whole), np.uint64)
    for j in range(k):
        out = mix(out * P + hashes[whole + j])
    of = texts[whole]
    if short and (few := np.flatnonzero((count > 0) & (count < k))).size:
        more = np.array([_fold(hashes[first[t]:first[t + 1]]) for t in few], np.uint64)
        out, of, whole = np.concatenate((out, more)), np.concatenate((of, few)), np.concatenate((whole, first[few]))
        order = np.argsort(of, kind="stable")
        out, of, whole = out[order], of[order], whole[order]
    return out, of, whole


def _fold(values: np.ndarray) -> np.uint64:
    out = np.zeros(1, np.uint64)
    for v in values:
        out = mix(out * P + v)
    return mix(out + np.uint64(len(values)))[0]


def by_text(values: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Order that sorts values inside each text (texts are already ascending)."""
    return np.lexsort((values, texts))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by ``key`` as tables that never split a key's rows.

    A key's rows are held together: use it for keys whose rows are bounded
    (the rows of one document, one block, one partition of a hash).
    """
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(key))
        last = column[len(column) - 1].as_py()
        same = column.to_numpy(zero_copy_only=False) == last
        cut = 0 if same.all() else int(np.argmax(same))
        if cut or (held and before != last):
            done = [*held, batch.slice(0, cut)] if cut else held
            yield pa.Table.from_batches(done)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
        before = last
    if held:
        yield pa.Table.from_batches(held)


def each_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one key after another, of batches sorted by ``key``."""
    for rows in whole_groups(batches, key):
        value = rows.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), len(value)]
        for a, b in zip(cuts, cuts[1:]):
            yield rows.slice(a, b - a)
