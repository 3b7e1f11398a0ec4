"""Vectorised text kernels over Arrow string columns.

A column is viewed as one UTF-8 buffer plus row offsets, so words and their hashes are found for
thousands of rows with a handful of numpy passes.  Nulls read as empty rows; callers keep the
validity mask where the difference matters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 20  # bytes of one numpy pass: bounds temporaries, never what is processed

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
SPACE = _space
_word = np.zeros(256, bool)
_word[128:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _word[ord(_a) : ord(_b) + 1] = True
NON_WORD = ~_word

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (element-wise, wrapping)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_MULT = U64(0x9DDFEA08EB382D69)
_POW = np.ones(1024, U64)
np.multiply.accumulate(np.full(1023, _MULT, U64), out=_POW[1:])


def _powers(n: int) -> np.ndarray:
    if n <= len(_POW):
        return _POW
    out = np.ones(n, U64)
    np.multiply.accumulate(np.full(n - 1, _MULT, U64), out=out[1:])
    return out


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 row offsets (starting at 0) of a string or binary column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n, (_, off, data) = len(col), col.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(off, np.int64 if large else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    o = o - o[0]
    if col.null_count:  # a null may own bytes: squeeze them out
        valid = np.asarray(col.is_valid())
        lens = np.diff(o)
        if lens[~valid].any():
            d = d[np.repeat(valid, lens)]
        o = np.concatenate([[0], np.cumsum(np.where(valid, lens, 0))])
    return d, o


def row_slices(offsets: np.ndarray, limit: int = 2 * PIECE):
    """Consecutive row ranges of about `limit` bytes (a longer row is a range of its own)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-cases ASCII and the Latin-1 letters."""
    out = _LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    up = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[up] += 0x20
    return out


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, hashed: bool = True):
    """Maximal separator-free spans, never crossing rows.

    Returns (start, end, 64-bit hash or None, per-row word offsets)."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets[offsets <= n]] = True
    starts, ends, hashes = [], [], []
    lo = 0
    while lo < n:
        hi = min(n, lo + PIECE)
        while hi < n and not (sep[data[hi]] or first[hi]):  # whole words only
            nxt = np.flatnonzero(sep[data[hi : hi + PIECE]] | first[hi : min(n, hi + PIECE)])
            hi = hi + int(nxt[0]) if len(nxt) else min(n, hi + PIECE)
        w = ~sep[data[lo:hi]]
        brk = np.empty(hi - lo, bool)  # a word can't continue from the byte before
        brk[0] = True
        np.logical_or(~w[:-1], first[lo + 1 : hi], out=brk[1:])
        s = np.flatnonzero(w & brk)
        if len(s):
            nb = np.empty(hi - lo, bool)
            nb[-1] = True
            np.logical_or(~w[1:], first[lo + 1 : hi], out=nb[:-1])
            e = np.flatnonzero(w & nb) + 1
            starts.append(s + lo)
            ends.append(e + lo)
            if hashed:
                hashes.append(hash_spans(data[lo:hi], s, e, w))
        lo = hi
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    e = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    h = (np.concatenate(hashes) if hashes else np.zeros(0, U64)) if hashed else None
    return s, e, h, np.searchsorted(s, offsets)


def hash_spans(data, s, e, inside=None) -> np.ndarray:
    """64-bit polynomial hash of disjoint, ordered, non-empty spans that `inside` covers."""
    lens = e - s
    if inside is None:
        inside = np.zeros(len(data) + 1, np.int8)
        inside[s] += 1
        np.subtract.at(inside, e, 1)
        inside = np.cumsum(inside[:-1]).astype(bool)
    body = data[inside]
    base = np.cumsum(lens) - lens
    pos = np.arange(len(body)) - np.repeat(base, lens)
    vals = _BYTE[body] * _powers(int(lens.max()))[pos]
    return mix(np.add.reduceat(vals, base) + lens.astype(U64))


def shingles(h: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of a row and row offsets; a shorter row is one shingle."""
    cnt = np.diff(woff)
    out_cnt = np.where(cnt >= k, cnt - k + 1, np.minimum(cnt, 1))
    off = np.concatenate([[0], np.cumsum(out_cnt)])
    if not len(h):
        return np.zeros(0, U64), off
    at = np.repeat(woff[:-1] - off[:-1], out_cnt) + np.arange(off[-1])
    end = np.repeat(woff[1:], out_cnt)
    acc = np.zeros(len(at), U64)
    for i in range(k):
        p = at + i
        ok = p < end
        acc = acc * U64(0xD6E8FEB86659FD93) + np.where(ok, h[np.minimum(p, len(h) - 1)], U64(i + 1))
    return mix(acc), off


def segment_reduce(ufunc, values, off, empty):
    """ufunc.reduceat over rows given by offsets; empty rows get `empty`."""
    n = len(off) - 1
    out = np.full((n,) + values.shape[1:], empty, values.dtype)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = ufunc.reduceat(values, off[:-1][full], axis=0)
    return out


def row_counts(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each row: (row, value, count), ordered by row and value."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((h, row))
    r, v = row[order], h[order]
    new = np.ones(len(v), bool)
    if len(v):
        new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    return r[at], v[at], np.diff(np.append(at, len(v)))


def row_distinct(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of distinct values of each row, told apart by as many leading bits as the row number leaves."""
    n = len(off) - 1
    bits = U64(max(1, n.bit_length()))
    code = np.sort(np.repeat(np.arange(n, dtype=U64) << (U64(64) - bits), np.diff(off)) | h >> bits)
    new = np.append(True, code[1:] != code[:-1])[: len(code)]
    return np.bincount((code[new] >> (U64(64) - bits)).astype(np.int64), minlength=n)


def ragged(values: np.ndarray, off: np.ndarray, typ=None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, typ))
