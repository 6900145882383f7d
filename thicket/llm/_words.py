"""Vectorised word splitting and hashing over the bytes of whole texts.

All separators are ASCII, so working on UTF-8 bytes equals working on code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
SEGMENT = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Words [^\x20\x09-\x0D]+
IS_TOKEN = ~_SPACE
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z)
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[0x30:0x3A] = True
IS_ALNUM[0x61:0x7B] = True
IS_ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
AS_IS = np.arange(256, dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SEGMENT + 1024)
        base, inverse = np.full(size, _BASE, U64), np.full(size, pow(_BASE, -1, 1 << 64), U64)
        base[0] = inverse[0] = 1
        _POWERS[:] = [np.multiply.accumulate(base), np.multiply.accumulate(inverse)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))  # the only copy
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _piece(raw: np.ndarray, offs: np.ndarray, is_word: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one piece; offs: row starts within it."""
    n = len(raw)
    b = lut[raw]
    w = is_word[b]
    fresh = np.zeros(n + 1, bool)
    fresh[offs[(offs >= 0) & (offs <= n)]] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, w[:-1]
    starts = np.flatnonzero(w & (~before | fresh[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, w[1:]
    ends = np.flatnonzero(w & (~after | fresh[1:])) + 1
    power, inverse = _powers(n + 1)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    terms = b.astype(U64)
    terms += U64(1)
    terms *= power[:n]
    np.cumsum(terms, out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return starts, ends, mix(h ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


def split_words(raw: np.ndarray, offs: np.ndarray, is_word: np.ndarray, lut: np.ndarray = AS_IS, spans: bool = False):
    """Words of many rows at once.

    Returns (first, hashes): the words of row i are hashes[first[i]:first[i+1]]; with spans,
    also their byte starts and ends. Works piece by piece, so memory beyond the words is bounded
    (a single word longer than a piece makes the piece longer).
    """
    n, at = len(raw), 0
    hashes, starts, ends = [], [], []
    while at < n:
        to = min(n, at + SEGMENT)
        while to < n:  # not inside a word
            low = max(at, to - 4096)
            gap = np.flatnonzero(~is_word[lut[raw[low:to]]])
            if len(gap):
                to = low + int(gap[-1]) + 1
                break
            k = np.searchsorted(offs, to, "right") - 1
            if offs[k] > at:
                to = int(offs[k])
                break
            far = np.flatnonzero(~is_word[lut[raw[to : to + SEGMENT]]])
            to = min(n, to + (int(far[0]) + 1 if len(far) else SEGMENT))
            if len(far):
                break
        lo, hi = np.searchsorted(offs, at, "left"), np.searchsorted(offs, to, "right")
        s, e, h = _piece(raw[at:to], offs[lo:hi] - at, is_word, lut)
        hashes.append(h)
        starts.append(s + at)
        if spans:
            ends.append(e + at)
        at = to
    h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    first = np.searchsorted(s, offs, "left")
    if spans:
        return first, h, s, np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return first, h


def windows(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of k consecutive words (rows not minded): len(hashes)-k+1 values."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((mix(hashes ^ U64(salt)) if salt else hashes) * power[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])


def window_rows(first: np.ndarray, k: int) -> np.ndarray:
    """Starts (word numbers) of the windows of k words that lie within one row."""
    last = np.maximum(first[1:] - k + 1, first[:-1])
    return ranges(first[:-1], last)


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """concatenate(arange(l, h) for l, h in zip(lo, hi)), at once."""
    n = np.maximum(hi - lo, 0)
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(n)
    return np.arange(total) + np.repeat(lo - (ends - n), n)


def covered(n_words: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mask of the words inside any of the half-open spans."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge[:-1]) > 0


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]] for each row."""
    total = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
    return total[first[1:]] - total[first[:-1]]


def slices(batch, max_bytes: int = 4 << 20, column: str = "text"):
    """Cuts an Arrow batch into runs of rows with about max_bytes of text (at least one row)."""
    col = batch.column(column)
    n = batch.num_rows
    if not n:
        return
    sizes = np.diff(text_bytes(col)[1])
    ends, at = np.cumsum(sizes), 0
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + max_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to
