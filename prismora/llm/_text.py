"""Vectorised text primitives over Arrow string columns.

Every operator that has to look inside texts works on the UTF-8 buffer of an
Arrow column: tokens, hashes and n-grams are numpy arrays over whole batches
and no Python string is ever made.  A token is a maximal run of bytes other
than ASCII white space; null and empty texts have no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: UTF-8 bytes that are worked on at once (a single longer text is one piece).
PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a fresh array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; n is a power of two."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.ones(n, dtype=U64)
        done = 1
        while done < n:
            p[done : 2 * done] = p[:done] * U64(pow(base, done, 1 << 64))
            done *= 2
        out.append(p)
    return out[0], out[1]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its texts (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `limit` bytes each."""
    first, n = 0, len(off) - 1
    while first < n:
        last = int(np.searchsorted(off, off[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def spans(buf: np.ndarray, off: np.ndarray, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each token of the texts in buf."""
    n = len(buf)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    gap = apart[buf]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    heads = off[:-1]
    before[heads[heads < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    tails = off[1:]
    after[tails[tails > 0] - 1] = True
    np.logical_not(gap, out=gap)
    start = np.flatnonzero(gap & before)
    end = np.flatnonzero(gap & after) + 1
    counts = np.searchsorted(start, off[1:]) - np.searchsorted(start, off[:-1])
    return start, end, np.repeat(np.arange(len(off) - 1), counts)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, a function of its bytes alone."""
    n = len(buf)
    size = 1 << max(10, int(n).bit_length())
    up, down = _powers(max(size, 2 * PIECE_BYTES))
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum((buf.astype(U64) + U64(1)) * up[:n], out=sums[1:])
    h = sums[end] - sums[start]
    h *= down[start]
    h += (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix64(h)


def words(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each piece: first and last text, text number (from first on) and hash of each token."""
    buf, off = text_buffer(column)
    for a, b in pieces(off):
        part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        start, end, doc = spans(part, o)
        yield a, b, doc, span_hashes(part, start, end)


def word_counts(column) -> np.ndarray:
    """Tokens of each text."""
    buf, off = text_buffer(column)
    out = np.zeros(len(off) - 1, np.int64)
    for a, b in pieces(off):
        o = off[a : b + 1] - off[a]
        start, _, _ = spans(buf[off[a] : off[b]], o)
        out[a:b] = np.searchsorted(start, o[1:]) - np.searchsorted(start, o[:-1])
    return out


def ngram_sets(doc: np.ndarray, h: np.ndarray, texts: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the distinct word n-grams of each text, by text and hash.

    A text of fewer than n tokens, one at least, has one gram: all its tokens.
    """
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    short_sum = None
    m = len(h) - n + 1
    if m > 0:
        g = h[:m].copy()
        for k in range(1, n):
            g *= U64(0x9FB21C651E98DF25)
            g ^= g >> U64(29)
            g += h[k : m + k]
        whole = doc[:m] == doc[n - 1 :]
        g, d = mix64(g[whole]), doc[:m][whole]
    else:
        g, d = np.zeros(0, U64), np.zeros(0, np.int64)
    counts = np.bincount(doc, minlength=texts)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.searchsorted(doc, short)
        size = counts[short]
        short_sum = np.full(len(short), 0x5851F42D4C957F2D, dtype=U64)
        for k in range(n - 1):
            has = size > k
            short_sum[has] = mix64(short_sum[has] * U64(31) + h[first[has] + k])
        g, d = np.concatenate([g, short_sum]), np.concatenate([d, short])
    order = np.argsort(g)
    d = d[order].astype(np.uint16 if texts <= 65536 else np.int64)
    order = order[np.argsort(d, kind="stable")]
    g, d = g[order], np.sort(d, kind="stable").astype(np.int64)
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return d[new], g[new]
