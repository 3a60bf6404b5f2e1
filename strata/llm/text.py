"""Vectorised byte-level text kernels shared by the training-data operators.

Everything works on one flat ``uint8`` buffer holding many texts (the layout
Arrow uses), so a batch of thousands of documents costs a handful of numpy
passes.  Buffers are processed in slices of about ``SLICE`` bytes, cut only at
bytes that belong to no word: temporary memory does not grow with a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_SHIFT = np.uint64(32)
_MIX1 = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x5851F42D4C957F2D
_POWERS = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
        filled += step
    return out


#: One random odd number for each of the first places of a word; later places repeat them, times one of their block.
PLACE = np.random.default_rng(20240301).integers(0, 1 << 63, _POWERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: One random 64-bit value per byte.
VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of bytes that are not white space: [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of ASCII letters, digits and bytes from 0x80 on.
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_lo:_hi] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs only map to equal outputs."""
    h = (h ^ (h >> _SHIFT)) * _MIX2
    h = (h ^ (h >> _SHIFT)) * _MIX1
    return h ^ (h >> _SHIFT)


def _places(at: np.ndarray) -> np.ndarray:
    """What places in a word are multiplied by: no two places are known to have the same."""
    out = PLACE[at & (_POWERS - 1)]
    far = np.flatnonzero(at >= _POWERS)
    if len(far):
        out[far] *= mix((at[far] // _POWERS).astype(np.uint64)) | np.uint64(1)
    return out


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _slices(inside: np.ndarray, starts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Slices of the buffer that no word crosses; starts: where texts begin."""
    a = 0
    while a < n:
        b = min(n, a + SLICE)
        if b < n:
            k = int(np.searchsorted(starts, b, "right")) - 1
            cut = int(starts[k]) if k >= 0 else 0
            gap = np.flatnonzero(~inside[max(a, b - 4096) : b])
            cut = max(cut, max(a, b - 4096) + int(gap[-1]) + 1 if len(gap) else 0)
            if cut <= a:  # a word of more than a slice: go on to its end
                gap = np.flatnonzero(~inside[b:])
                nxt = int(starts[k + 1]) if k + 1 < len(starts) else n
                cut = min(b + int(gap[0]) + 1 if len(gap) else n, nxt if nxt > b else n)
            b = cut
        yield a, b
        a = b


class Words:
    """Words of many texts: hash, first byte and end byte of each, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: np.ndarray | None = LOWER, shape: np.ndarray | None = None):
        """lower: a map of bytes before hashing; shape: another one, for a second hash."""
        inside = table[data]
        hashes, firsts, ends, shapes = [], [], [], []
        bounds = offsets[:-1][offsets[:-1] < offsets[1:]]
        for a, b in _slices(inside, bounds, len(data)):
            m = inside[a:b]
            edge = np.empty(b - a, bool)
            edge[0] = True
            np.not_equal(m[1:], m[:-1], out=edge[1:])
            lo, hi = np.searchsorted(bounds, [a, b])
            edge[bounds[lo:hi] - a] = True
            runs = np.flatnonzero(edge)
            stops = np.append(runs[1:], b - a)
            word = m[runs]
            first, stop = runs[word], stops[word]
            if not len(first):
                continue
            size = stop - first
            total = int(size.sum())
            at = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            chars = data[a:b][m] if total == int(np.count_nonzero(m)) else data[a:b][np.repeat(first, size) + at]
            place, before = _places(at), np.cumsum(size) - size
            for table_, out in ((lower, hashes), (shape, shapes)):
                if out is hashes or table_ is not None:
                    terms = (VALUE if table_ is None else VALUE[table_])[chars]
                    terms *= place
                    terms ^= terms >> _SHIFT
                    out.append(mix(np.add.reduceat(terms, before) + size.astype(np.uint64) * _MIX1))
            firsts.append(first + a)
            ends.append(stop + a)
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        self.hash, self.first, self.end = join(hashes, np.uint64), join(firsts, np.int64), join(ends, np.int64)
        self.shape = join(shapes, np.uint64)
        self.text = np.searchsorted(self.first, offsets)  # words of text i: text[i] to text[i + 1]
        self.count = np.diff(self.text)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; fewer words are one shingle, none have none."""
    n = len(words)
    if n == 0:
        return words
    m = max(1, n - size + 1)
    out = np.zeros(m, np.uint64)
    for j in range(min(size, n)):
        out += words[j : j + m] * np.uint64(pow(_BASE, 2 * j + 3, 1 << 64))
    return mix(out + np.uint64(min(n, size) * int(_MIX2) & 0xFFFFFFFFFFFFFFFF))
