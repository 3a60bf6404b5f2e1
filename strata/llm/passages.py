"""Near-duplicate passages by compact windows.

Tokens are word shingles.  The Cartesian tree of a document's token hashes yields
its compact windows (left, centre, right): every run of tokens inside that holds
the centre has its min-hash there.  Near duplicates of ``LEAST`` tokens differ in
one place, so they have a run of ``RUN`` tokens in common, and the min-hash of it.
Windows of at least ``RUN`` tokens meet on their min-hash, aligned at it:

1. Windows with the same tokens around the centre, as far as any run of ``LEAST``
   tokens with it reaches, are one class (128 bits tell classes apart).  Each repeats the
   first window of another document in the class, all around.
2. Of a min-hash with up to ``FEW`` classes all pairs of classes are verified.
3. Of a min-hash with more, what is about the centres is fetched.  Up to ``PAIRED`` pairs a
   window, all are compared there: each window is verified with the two that cover most of
   what is before and behind its centre (as what near duplicates cover holds the centre, they
   cover all that any does), and documents are linked by a tree of these pairs.
4. Beyond that, the intervals about the centre are joined: whatever is a near duplicate has
   ``BLOCKS`` blocks of words next to each other in common, all or all but one.  Of up to
   ``FEW`` windows that agree on those, for some choice of them, all pairs are verified; of
   more, those that also agree on what is left of the passage, for each way to place it and
   its edit, so that any two of them are near duplicates: each with the first.  This grows
   with windows, not with pairs.

A class stands for itself by its first window, and by the first of its second document
where that of the first has the min-hash again.  All candidates but those of one
class are verified on both texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.graph import components
from strata.llm.session import packs_of, prepare, table, texts
from strata.llm.suffix import _BASE, _FIRST_ID, _INVERSE, Pack, dump, load
from strata.llm.text import SPACED, Words, _powers, mix, shingles

SHINGLE, LEAST_WORDS = 5, 50
LEAST = LEAST_WORDS - SHINGLE + 1
#: Matching tokens that two windows of LEAST tokens need for a Jaccard similarity of 0.8.
NEEDED = -(-8 * 2 * LEAST // 18)
#: Tokens of the longer part of such a window beside the one place where it differs.
RUN = -(-NEEDED // 2)
#: Tokens by which parts of a passage may be shifted against each other.
DRIFT = 3
#: Classes of a min-hash of which all pairs are compared.
FEW = 5
#: Pairs a window up to which all windows of a min-hash are compared: about where joining them by blocks costs less.
PAIRED = 1024
#: Blocks of SHINGLE words, each one token, that any LEAST_WORDS words hold wherever they begin.
BLOCKS = LEAST_WORDS // SHINGLE - 1
#: Tokens beside a centre that choices of blocks, and what is left of a passage, reach.
SIDE = SHINGLE * BLOCKS + 1
_SEED = np.random.default_rng(77).integers(1, 1 << 62, dtype=np.uint64)
_BITS = 21
_LOW = np.uint64((1 << _BITS) - 1)
_SLICE = 1 << 19
_CHUNK = 1 << 13
_FACTORS = np.random.default_rng(78).integers(0, 1 << 63, (2, BLOCKS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WINDOWS, _PAIRS, _WANTED, _BODY, _ASKED, _BLOCKS, _SURE = range(7)
_ROWS = "at int, pack int, kind int, blob binary"


def centres(values: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Positions that are the minimum of some run of ``least`` tokens within a document; ``ends``: where documents end."""
    found = []
    for a in range(0, max(0, len(values) - least + 1), _SLICE):
        b = min(a + _SLICE, len(values) - least + 1)
        key = (values[a : b + least - 1] & ~_LOW) | np.arange(b - a + least - 1, dtype=np.uint64)
        span = 1
        while 2 * span <= least:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        key = np.minimum(key[: b - a], key[least - span : least - span + b - a])
        at = np.arange(a, b)
        whole = at + least <= ends[np.searchsorted(ends, at, "right")]
        found.append(np.unique((key[whole] & _LOW).astype(np.int64)) + a)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def compact_windows(values: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, centre and right (inclusive) of the compact windows of at least ``least`` tokens.

    What bounds such a window is the centre of a wider one, so the Cartesian
    tree over the centres has the same windows as that over all tokens.
    """
    centre = centres(values, ends, least)
    doc = np.searchsorted(ends, centre, "right")
    begin = np.concatenate([[0], ends[:-1]])
    left, right = begin[doc].copy(), ends[doc] - 1
    v, d = (values[centre] & ~_LOW).tolist(), doc.tolist()
    stack: list[int] = []
    for i in range(len(v)):
        while stack and (d[stack[-1]] != d[i] or v[stack[-1]] > v[i]):
            k = stack.pop()
            if d[k] == d[i]:
                right[k] = centre[i] - 1
        if stack:
            left[i] = centre[stack[-1]] + 1
        stack.append(i)
    return left, centre, right


class Tokens:
    """Tokens of the documents of a pack; ``begin[r]`` to ``begin[r + 1]`` are row r's."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, SPACED)
        self.n_words = words.count
        own = [shingles(words.hash[a:b], SHINGLE) if b - a >= SHINGLE else words.hash[:0] for a, b in zip(words.text, words.text[1:])]
        self.begin = np.cumsum([0, *map(len, own)])
        self.all = np.concatenate(own) if own else np.zeros(0, np.uint64)


def arounds(tokens: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of the tokens from each ``low`` to before ``high``."""
    up = _powers(_BASE, len(tokens) + 1)
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * up[:-1], out=total[1:])
    del up
    down = _powers(_INVERSE, len(tokens) + 1)
    return mix((total[high] - total[low]) * down[low] + (high - low).astype(np.uint64))


def blocks_of(tokens: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """16 bits of the tokens from SIDE before a centre to SIDE behind it (offset, window), and how many tokens there are
    behind and before it (255 at most)."""
    out = np.zeros((2 * SIDE + 1, len(at)), np.uint16)
    for k in range(2 * SIDE + 1):
        there = at + k - SIDE
        ok = (there >= begin) & (there < end)
        out[k, ok] = (tokens[there[ok]] >> np.uint64(48)).astype(np.uint16)
    return out, np.minimum(end - 1 - at, 255).astype(np.uint8), np.minimum(at - begin, 255).astype(np.uint8)


def but_one(around: np.ndarray, behind: np.ndarray, before: np.ndarray) -> Iterator[tuple]:
    """For each choice of BLOCKS blocks next to each other, the centre's among them, and of one or none to leave out:
    the windows that have them, with a hash of the others, and the place (None: none is left out, and two windows
    that agree are near duplicates).

    What is beyond the block left out may be a token further off, as where a word was put in.
    """

    def part(side: int, further: int, first: int, stop: int) -> np.ndarray:
        out = np.zeros(around.shape[1], np.uint64)
        for k in range(first, stop):
            out += around[SIDE + (1, -1)[side] * (SHINGLE * (k + 1) + further)] * _FACTORS[side, k]
        return out

    room = (behind.astype(np.int64), before.astype(np.int64))
    for n_right in range(BLOCKS):
        n = (n_right, BLOCKS - 1 - n_right)
        have = np.flatnonzero((room[0] >= SHINGLE * n[0]) & (room[1] >= SHINGLE * n[1]))
        yield have, (part(0, 0, 0, n[0]) + part(1, 0, 0, n[1]))[have], None
        for side in (0, 1):
            other = part(1 - side, 0, 0, n[1 - side])
            for gone in range(n[side]):
                inner, last = other + part(side, 0, 0, gone), gone + 1 == n[side]
                found = []
                for further in (0,) if last else (0, 1):
                    reach = SHINGLE * gone if last else SHINGLE * n[side] + further
                    found.append(np.flatnonzero((room[side] >= reach) & (room[1 - side] >= SHINGLE * n[1 - side])))
                keys = [(inner + part(side, further, gone + 1, n[side]))[x] for further, x in enumerate(found)]
                rows, further = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
                order = np.lexsort((further, rows))
                yield rows[order], np.concatenate(keys)[order], (side, gone, n[side], n[1 - side], further[order])


def whole(around: np.ndarray, behind: np.ndarray, before: np.ndarray, rows: np.ndarray, group: np.ndarray, place: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For windows that agree on all blocks but one (``group``), and each way to place a near duplicate and its edit:
    the windows that have the tokens it needs, with a hash of those.  Two that agree there are near duplicates.

    Beside the blocks, a passage has words at both edges, and such of the block left out as are before and behind the edit.
    """
    side, gone, n, n_other, further = place
    sign, room = (1, -1)[side], ((behind, before)[side].astype(np.int64), (behind, before)[1 - side].astype(np.int64))
    last = gone + 1 == n
    base = mix(group.astype(np.uint64) + np.uint64(1))

    def both(rows: np.ndarray, t: int | np.ndarray, u: int | np.ndarray) -> np.ndarray:
        return around[SIDE + sign * t, rows].astype(np.uint64) | around[SIDE + sign * u, rows].astype(np.uint64) << np.uint64(16)

    def agreeing(rows: np.ndarray, base: np.ndarray, edge: int, far: int | np.ndarray) -> tuple[np.ndarray, np.ndarray | slice]:
        ok = (room[0][rows] >= far) & (room[1][rows] >= edge)
        return mix(both(rows, -edge, far) ^ base), slice(None) if ok.all() else np.flatnonzero(ok)

    if last:  # without an edit
        for e in range(SHINGLE + 1):
            key, have = agreeing(rows, base, SHINGLE * n_other + e, SHINGLE * gone + SHINGLE - e)
            yield rows[have], key[have]
    for inside in (SHINGLE - 1, SHINGLE):  # a word replaced; or put in, between what has it and what has not
        edges = 2 * SHINGLE - 1 - inside
        if inside < SHINGLE:
            own = np.flatnonzero(further == 0)
            on = further[own]
        elif last:
            own, on = np.repeat(np.arange(len(rows)), 2), np.tile([0, 1], len(rows))
        else:
            own, on = np.arange(len(rows)), further
        of = rows[own]
        about = [both(of, SHINGLE * gone + g, SHINGLE * (gone + 2) + on - inside + g) for g in range(inside + 1)]
        about = [mix(x) for x in about]
        for e in range(edges + 1):
            key, have = agreeing(of, base[own], SHINGLE * n_other + e, SHINGLE * n + on + edges - e)
            some, key = of[have], key[have]
            for g in range(inside + 1):
                if not last or edges - e + inside - g >= SHINGLE:  # else what is behind the edit holds no token
                    yield some, key + about[g][have]


def spans_of(around: np.ndarray, behind: np.ndarray, before: np.ndarray, rows: np.ndarray, group: np.ndarray, place: tuple) -> tuple[np.ndarray, np.ndarray]:
    """A hash of all that ``whole`` looks at, and whether a window has all of it: windows with equal hashes have the same
    near duplicates in their group."""
    side, gone, n, n_other, further = place
    sign, room = (1, -1)[side], ((behind, before)[side].astype(np.int64), (behind, before)[1 - side].astype(np.int64))
    edge, far = SHINGLE * (n_other + 1), SHINGLE * (n + 1) + 1
    full = (room[0][rows] >= far) & (room[1][rows] >= edge)
    key = mix(group.astype(np.uint64) + np.uint64(1)) + further.astype(np.uint64)
    for t in (-edge, *range(SHINGLE * gone + 1, SHINGLE * (gone + 2) + 2), far - 1, far):
        key = mix(key ^ around[SIDE + sign * t, rows].astype(np.uint64))
    return key, full


def _sizes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of equal keys that each row is of, and the group's size."""
    _, group, size = np.unique(key, return_inverse=True, return_counts=True)
    return group, size[group]


def _all_pairs(group: np.ndarray, rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of different documents in groups of at most FEW ascending rows, the later one first."""
    order = np.argsort(group, kind="stable")
    group, rows = group[order], rows[order]
    left, right = [rows[:0]], [rows[:0]]
    for gap in range(1, FEW):
        i = np.flatnonzero(group[:-gap] == group[gap:]) if len(rows) > gap else np.zeros(0, np.int64)
        i = i[doc[rows[i]] != doc[rows[i + gap]]]
        left.append(rows[i + gap])
        right.append(rows[i])
    return np.concatenate(left), np.concatenate(right)


def rooms(behind: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last run of LEAST tokens that holds a centre, counted from the one that ends there."""
    return LEAST - 1 - np.minimum(before, LEAST - 1), np.minimum(behind, LEAST - 1)


class Covers:
    """Compares pairs of windows; its arrays are used again for each lot of them (new ones cost more than what is done)."""

    def __init__(self, around: np.ndarray, behind: np.ndarray, before: np.ndarray, most: int):
        self.around, (self.first, self.last) = around, rooms(behind, before)
        self.tokens = np.empty(2 * len(around) * most, np.uint16)
        self.bytes = np.empty(6 * len(around) * most, np.uint8)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """Which pairs have near duplicates that hold the centre, and the first and last of those runs (as of ``rooms``)
        in x and in y; first > last: none.

        Tokens a word further on or back count, as where one was put in.  What was compared so holds for a shift that
        is DRIFT - 1 off, too.
        """
        n = len(x)
        mine, other = self.tokens[: 2 * len(self.around) * n].reshape(2, -1, n)
        same, back, further, *sums = self.bytes[: 6 * len(self.around) * n].reshape(6, -1, n)
        np.take(self.around, x, axis=1, out=mine, mode="clip")
        np.take(self.around, y, axis=1, out=other, mode="clip")
        np.equal(mine, other, out=same.view(bool))
        run = np.ones(n, np.uint8)
        for sign in (1, -1):
            on = np.ones(n, np.uint8)
            for k in range(1, RUN):
                on &= same[SIDE + sign * k]
                run += on
        back[:] = same
        for one, two, a, b in ((mine, other, same, back), (other, mine, back, same)):
            np.equal(one[:-1], two[1:], out=further[:-1].view(bool))
            a[:-1] |= further[:-1]
            b[1:] |= further[:-1]
        out: list[np.ndarray] = []
        at = np.arange(LEAST, dtype=np.uint8)[:, None]
        for rows, found in ((x, same), (y, back)):
            parts = sums[1:]
            total, part, span, done = sums[0][:LEAST], found[SIDE + 1 - LEAST : SIDE + LEAST], 1, 0
            total[:] = 0
            while span <= LEAST:
                if LEAST & span:
                    total += part[done : done + LEAST]
                    done += span
                part, span = np.add(part[:-span], part[span:], out=parts[0][: len(part) - span]), 2 * span
                parts.reverse()
            good = np.greater_equal(total, NEEDED, out=total.view(bool)).view(np.uint8)
            good &= at >= self.first[rows]
            good &= at <= self.last[rows]
            good &= run >= RUN
            weight = parts[0][:LEAST]
            out.append(LEAST - np.multiply(good, LEAST - at, out=weight).max(axis=0).astype(np.int64))
            out.append(np.multiply(good, at + np.uint8(1), out=weight).max(axis=0).astype(np.int64) - 1)
        near = np.flatnonzero((out[1] >= 0) | (out[3] >= 0))
        return near, *(c[near] for c in out)


def _tree(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of links of nodes, those that connect what ``label`` (of each node, its tree's least) has apart; they are put in."""
    out = [np.zeros(0, np.int64)]
    rest = np.flatnonzero(label[a] != label[b])
    while len(rest):
        p, q = label[a[rest]], label[b[rest]]
        high, at = np.unique(np.maximum(p, q), return_index=True)
        out.append(rest[at])
        to = np.arange(len(label))
        to[high] = np.minimum(p, q)[at]
        while (to[to] != to).any():
            to = to[to]
        label[:] = to[label]
        rest = rest[label[a[rest]] != label[b[rest]]]
    return np.concatenate(out)


def near_pairs(key: np.ndarray, doc: np.ndarray, around: np.ndarray, behind: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of windows of the same min-hash (ascending by document), the later first, that connect all documents with near
    duplicates among them and cover all that those cover."""
    n, around = len(key), np.ascontiguousarray(around)
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    new = np.ones(n, bool)
    new[1:] = k[1:] != k[:-1]
    group, head = np.cumsum(new) - 1, np.flatnonzero(new)
    new[1:] |= d[1:] != d[:-1]
    begin = head[group]
    pairs = np.maximum.accumulate(np.where(new, np.arange(n), 0)) - begin  # with the earlier windows of other documents
    few = (np.bincount(group, pairs) <= PAIRED * np.bincount(group))[group]
    many = np.sort(order[~few])
    x, y = _by_blocks(key[many], doc[many], np.take(around, many, axis=1), behind[many], before[many])
    left, right = [many[x]], [many[y]]
    # of each window: the pair that covers most before it and the one that covers most behind it (span << 32 | partner)
    none = np.iinfo(np.int64).max
    best = np.full((2, n), none)
    covers = Covers(around, behind, before, max(_CHUNK, int(pairs[few].max(initial=0))))
    docs, node = np.unique(doc, return_inverse=True)
    label, all_covered = np.arange(len(docs)), np.zeros(n, bool)
    rows = np.flatnonzero(few & (pairs > 0))
    total = np.cumsum(pairs[rows])
    at = 0
    while at < len(rows):
        done = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, done + _CHUNK, "right")))
        size = pairs[rows[at:stop]]
        x = np.repeat(rows[at:stop], size)
        y = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) + begin[x]
        x, y, at = order[x], order[y], stop
        open_ = np.flatnonzero(~all_covered[x] | ~all_covered[y] | (label[node[x]] != label[node[y]]))
        x, y = x[open_], y[open_]
        near, low, high, low_y, high_y = covers(x, y)
        x, y = x[near], y[near]
        for own, other, a, b in ((x, y, low, high), (y, x, low_y, high_y)):
            have = np.flatnonzero(b >= 0)
            own, other, a, b = own[have], other[have], a[have], LEAST - b[have]
            np.minimum.at(best[0], own, (a * 2 * LEAST + b) << 32 | other)
            np.minimum.at(best[1], own, (b * 2 * LEAST + a) << 32 | other)
        own = np.unique(np.concatenate([x, y]))
        all_covered[own] = ((best[0, own] >> 32) // (2 * LEAST) == covers.first[own]) & ((best[1, own] >> 32) // (2 * LEAST) == LEAST - covers.last[own].astype(np.int64))
        link = _tree(label, node[x], node[y])
        left.append(x[link])
        right.append(y[link])
    for b in best:
        own = np.flatnonzero(b != none)
        left.append(own)
        right.append(b[own] & 0xFFFFFFFF)
    x, y = np.concatenate(left), np.concatenate(right)
    later = doc[x] > doc[y]
    code = np.unique(np.where(later, x, y) * n + np.where(later, y, x))
    return code // max(n, 1), code % max(n, 1)


def _by_blocks(key: np.ndarray, doc: np.ndarray, around: np.ndarray, behind: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs as of ``near_pairs``, in a number of steps that grows with windows."""
    codes, n_codes, n = [np.zeros(0, np.int64)], 0, len(key)

    known = np.full(n, -1)

    def add(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal codes, n_codes
        fresh = np.flatnonzero(known[x] != y)  # mostly the one before, again
        x, y = x[fresh], y[fresh]
        known[x] = y
        codes.append(x * n + y)
        n_codes += len(x)
        if n_codes > (1 << 21) + 2 * len(codes[0]):
            codes = [np.unique(np.concatenate(codes))]
            n_codes = len(codes[0])

    for rows, others, place in but_one(around, behind, before):
        others = mix(key[rows] + others * _FACTORS[0, 0])
        add(*_firsts(others, rows, doc))
        if place is None:
            continue
        group, size = _sizes(others)
        few = (size > 2) & (size <= FEW)
        add(*_all_pairs(group[few], rows[few], doc))
        lowest = np.empty(group.max(initial=-1) + 1, doc.dtype)
        highest = lowest.copy()
        lowest[group[::-1]], highest[group] = doc[rows[::-1]], doc[rows]
        more = (size > FEW) & (lowest != highest)[group]  # windows of one document alone need no partner
        if not more.any():
            continue
        rows, group, place = rows[more], group[more], (*place[:4], place[4][more])
        # of windows that are the same as far as this goes: the first, and the first of another document
        same, full = spans_of(around, behind, before, rows, group, place)
        x, y = _firsts(same[full], np.flatnonzero(full), doc[rows])
        add(rows[x], rows[y])
        keep = np.ones(len(rows), bool)
        keep[x] = False
        keep[y] = True
        rows, group, place = rows[keep], group[keep], (*place[:4], place[4][keep])
        group, size = _sizes(group)
        add(*_all_pairs(group[size <= FEW], rows[size <= FEW], doc))
        more = size > FEW
        if more.any():
            for some, agreed in whole(around, behind, before, rows[more], group[more], (*place[:4], place[4][more])):
                add(*_firsts(agreed, some, doc))
    code = np.unique(np.concatenate(codes))
    return code // max(n, 1), code % max(n, 1)


def _partners(keys: tuple[np.ndarray, ...], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the first row (by doc, at) of another document among those with equal keys (-1: none), and
    whether the row itself is the first."""
    n = len(doc)
    order = np.lexsort((at, doc, *reversed(keys)))
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    group, head = np.cumsum(new) - 1, np.flatnonzero(new)
    d = doc[order]
    other = np.flatnonzero(d != d[head][group])
    second = np.full(len(head), -1)
    second[group[other][::-1]] = other[::-1]
    place = second[group]
    place[other] = head[group[other]]
    partner, first = np.empty(n, np.int64), np.empty(n, bool)
    partner[order] = np.where(place < 0, -1, order[place]) if n else place
    first[order] = new
    return partner, first


def _seconds(key: np.ndarray, doc: np.ndarray, partner: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The first windows of the second documents of classes whose first document has the min-hash again: what else it
    has there can only be compared with those."""
    own = np.flatnonzero(first | (partner < 0))
    own = own[np.lexsort((doc[own], key[own]))]
    again = np.zeros(len(own) + 1, bool)
    again[1:-1] = (key[own][1:] == key[own][:-1]) & (doc[own][1:] == doc[own][:-1])
    own = own[again[:-1] | again[1:]]
    out = np.unique(partner[own[first[own] & (partner[own] >= 0)]])
    return out[~first[out]]


def _firsts(key: np.ndarray, rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ascending rows (by document) with equal keys: (row, first row of another document among them)."""
    if not len(key):
        return rows, rows
    # sorted with the row in the low bits, of which a well mixed key has enough
    low = np.uint64((1 << len(key).bit_length()) - 1)
    code = np.sort((key & ~low) | np.arange(len(key), dtype=np.uint64))
    new, keep = np.ones(len(key), bool), np.zeros(len(key), bool)
    np.greater(code[1:] ^ code[:-1], low, out=new[1:])
    keep[1:] = ~new[1:]  # rows of keys that others have too
    keep[:-1] |= keep[1:]
    order, new = (code[keep] & low).astype(np.int64), new[keep]
    if not len(order):
        return rows[:0], rows[:0]
    group, head = np.cumsum(new) - 1, np.flatnonzero(new)
    own = rows[order]
    d = doc[own]
    other = np.flatnonzero(d != d[head][group])
    second = np.full(len(head), -1)
    second[group[other][::-1]] = other[::-1]
    place = second[group]
    place[other] = head[group[other]]
    have = np.flatnonzero(place >= 0)
    return own[have], own[place[have]]


def about_centre(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the windows that hold a centre."""
    return at - (LEAST - 1), at + LEAST


def _near_runs(same: np.ndarray, at: int) -> list[tuple[int, int]]:
    """Runs made of LEAST tokens of which NEEDED are the same; ``at``: where the first token stands."""
    if len(same) < LEAST:
        return []
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(total[LEAST:] - total[:-LEAST] >= NEEDED)
    if not len(good):
        return []
    cut = np.flatnonzero(np.diff(good) > LEAST)
    return list(zip((good[np.r_[0, cut + 1]] + at).tolist(), (good[np.r_[cut, len(good) - 1]] + (at + LEAST)).tolist()))


def matches(x: np.ndarray, y: np.ndarray, shift: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Runs of tokens of ``x`` made of windows that are near duplicates of windows of ``y``, ``shift`` tokens on, and
    such runs of ``y``; none where only one of them has any."""
    if min(len(x), len(y)) < LEAST:
        return [], []
    a, b = max(0, -shift - LEAST), min(len(x), len(y) - shift + LEAST)
    c, d = max(0, shift - LEAST), min(len(y), len(x) + shift + LEAST)
    if min(b - a, d - c) < LEAST:
        return [], []
    one, two = np.zeros(b - a, bool), np.zeros(d - c, bool)
    for drift in range(-DRIFT, DRIFT + 1):
        to = shift + drift
        lo, hi = max(a, -to), min(b, len(y) - to)
        if lo < hi:
            same = x[lo:hi] == y[lo + to : hi + to]
            one[lo - a : hi - a] |= same
            two[lo + to - c : hi + to - c] |= same
    found = _near_runs(one, a)
    back = _near_runs(two, c) if found else []
    return (found, back) if back else ([], [])


def candidates(key: np.ndarray, around: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of windows of one class, pairs of windows to compare (two arrays each), and the windows of min-hashes with
    more than FEW classes."""
    y, first = _partners((key, around), doc, at)
    same = np.flatnonzero(y >= 0)
    left, right = [same[:0]], [same[:0]]
    # one window for each class; all of them where a class is in one document only
    alone = first | (y < 0)
    own = np.concatenate([np.flatnonzero(alone), _seconds(key, doc, y, first)])
    own = own[np.lexsort((at[own], doc[own], key[own]))]
    head = np.flatnonzero(np.r_[True, key[own][1:] != key[own][:-1]]) if len(own) else own
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(own))))
    few = np.bincount(group, alone[own], len(head))[group] <= FEW
    for gap in range(1, 2 * FEW):
        i = np.flatnonzero(few[:-gap] & (group[:-gap] == group[gap:])) if len(own) > gap else np.zeros(0, np.int64)
        i = i[(doc[own[i]] != doc[own[i + gap]]) & (around[own[i]] != around[own[i + gap]])]
        left.append(own[i + gap])
        right.append(own[i])
    many = own[~few]
    if len(many):  # a min-hash that one document alone has needs no partner
        d, g = doc[many], group[~few]
        lowest, highest = np.full(len(head), np.iinfo(np.int64).max), np.full(len(head), np.iinfo(np.int64).min)
        np.minimum.at(lowest, g, d)
        np.maximum.at(highest, g, d)
        many = many[(lowest != highest)[g]]
    return same, y[same], np.concatenate(left), np.concatenate(right), many


def sure(x: np.ndarray, y: np.ndarray, shift: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (low to high) of tokens of x that y repeats ``shift`` tokens on, those that meet as one."""
    order = np.lexsort((low, shift, y, x))
    x, y, shift, low, high = (c[order] for c in (x, y, shift, low, high))
    new = np.zeros(len(x), bool)
    new[:1] = True
    for c in (x, y, shift):
        new[1:] |= c[1:] != c[:-1]
    apart = (np.cumsum(new) - 1) * (1 << 40)
    reach = np.maximum.accumulate(apart + high) if len(x) else high
    new[1:] |= apart[1:] + low[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return x[head], y[head], shift[head], low[head], (reach - apart)[np.append(head[1:], len(x)) - 1] if len(x) else high


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["at", "pack", "kind", "blob"])


def _groups(by: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(by, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(by[order])) + 1) if len(by) else []


def found_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, partner, n_words, start, end): for each document one row with its number of words (null partner), and
    rows with runs of words that near-duplicate passages of partner cover.  An end may be behind that of the text."""
    parts = packs_of(docs)
    rows = texts(docs).select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("pack"), "doc_id", "text")
    packs = rows.groupBy("pack")

    def _sure_rows(number: int, *columns: np.ndarray) -> list[tuple]:
        x, y, shift, low, high = sure(*columns)
        return [(number % parts, number, _SURE, dump(x, y, shift, low, high))]

    def find(group: pa.Table) -> pa.Table:
        pack, number = Pack(group), group["pack"][0].as_py()
        tokens = Tokens(pack.data, pack.offsets)
        ends = tokens.begin[1:][np.diff(tokens.begin) > 0]
        out: list[tuple] = []
        head = np.zeros(len(pack.ids), bool)
        head[pack.head] = True
        if not len(tokens.all):
            return _table(out)
        values = mix(tokens.all ^ _SEED)
        _, centre, _ = compact_windows(values, ends, RUN)
        row = np.searchsorted(tokens.begin, centre, "right") - 1
        own = head[row] & (np.diff(tokens.begin)[row] >= LEAST)
        centre, row = centre[own], row[own]
        key = values[centre]
        around = arounds(tokens.all, np.maximum(tokens.begin[row], centre - LEAST + 1), np.minimum(tokens.begin[row + 1], centre + LEAST))
        at = centre - tokens.begin[row]
        # A pack's windows of one class: those but the first are only compared with one of another document.
        partner, first = _partners((key, around), row, at)
        again = np.flatnonzero(~first & (partner >= 0))
        if len(again):
            y = partner[again]
            out += _sure_rows(number, pack.ids[row[again]], pack.ids[row[y]], at[y] - at[again], *about_centre(at[again]))
        keep = np.union1d(np.flatnonzero(first | (partner < 0)), _seconds(key, row, partner, first))
        to = (key[keep] % np.uint64(parts)).astype(np.int64)
        for x in _groups(to):
            k = keep[x]
            k = k[np.lexsort((at[k], row[k]))]
            out.append((int(to[x[0]]), number, _WINDOWS, dump(key[k], around[k], pack.ids[row[k]], at[k].astype(np.int32))))
        return _table(out)

    def to_packs(pairs: list[tuple[np.ndarray, ...]]) -> list[tuple]:
        """Rows for the packs of both documents of each pair: to compare, and to give the other's text."""
        out: list[tuple] = []
        if pairs:
            x, y, shift, px, py = (np.concatenate(c) for c in zip(*pairs))
            for g in _groups(px):
                number = int(px[g[0]])
                out.append((number, number, _PAIRS, _pairs(x[g], y[g], shift[g], py[g])))
            far = np.flatnonzero(px != py)  # the packs of x need the texts of these y
            for g in _groups(py[far]):
                y_px = np.unique(np.stack([y[far[g]], px[far[g]].astype(np.int64)], axis=1), axis=0)
                out.append((int(py[far[g[0]]]), -1, _WANTED, dump(y_px[:, 0], y_px[:, 1])))
        return out

    def join(group: pa.Table) -> pa.Table:
        out, got, pairs, known = [], [], [], []
        part = group["at"][0].as_py()
        for pack, kind, blob in zip(*(group[c].to_pylist() for c in ("pack", "kind", "blob"))):
            if kind == _SURE:
                out.append((pack, pack, _SURE, blob))
            else:
                got.append((pack, load(blob)))
        if got:
            key, around, doc, at = (np.concatenate(c) for c in zip(*(x for _, x in got)))
            pack, at = np.repeat([p for p, _ in got], [len(x[0]) for _, x in got]), at.astype(np.int64)
            x, y, left, right, many = candidates(key, around, doc, at)
            known.append((pack[x], doc[x], doc[y], at[y] - at[x], *about_centre(at[x])))
            x, y = left, right
            pairs.append((doc[x], doc[y], at[y] - at[x], pack[x], pack[y]))
            for g in _groups(pack[many]):
                k = many[g]
                k = k[np.lexsort((at[k], doc[k]))]
                out.append((int(pack[k[0]]), part, _ASKED, dump(key[k], doc[k], at[k])))
        if known:
            pack, *columns = (np.concatenate(c) for c in zip(*known))
            for g in _groups(pack):
                out.append((int(pack[g[0]]), int(pack[g[0]]), _SURE, dump(*sure(*(c[g] for c in columns)))))
        return _table(out + to_packs(pairs))

    def surround(group: pa.Table, more: pa.Table) -> pa.Table:
        """What is about the windows asked for goes back to their partition; other rows pass through it."""
        if not more.num_rows:
            return _table([])
        number, out, asked = more["at"][0].as_py(), [], []
        for pack, kind, blob in zip(*(more[c].to_pylist() for c in ("pack", "kind", "blob"))):
            if kind == _ASKED:
                asked.append((pack, load(blob)))
            else:
                out.append((number % parts, number, kind, blob))
        if asked:
            pack = Pack(group)
            wanted = np.unique(np.concatenate([c[1] for _, c in asked]))
            tokens = Tokens(*pack.only(wanted))
            for part, (key, doc, at) in asked:
                row = np.searchsorted(wanted, doc)
                begin = tokens.begin[row]
                blocks, behind, before = blocks_of(tokens.all, begin + at, begin, tokens.begin[row + 1])
                out.append((part, number, _BLOCKS, dump(key, doc, at, behind, before, *blocks)))
        return _table(out)

    def agree(group: pa.Table) -> pa.Table:
        out, got, pairs = [], [], []
        for pack, kind, blob in zip(*(group[c].to_pylist() for c in ("pack", "kind", "blob"))):
            if kind == _BLOCKS:
                got.append((pack, load(blob)))
            else:
                out.append((pack, pack, kind, blob))
        if got:
            pack = np.repeat([p for p, _ in got], [len(x[0]) for _, x in got])
            key, doc, at, behind, before, *blocks = (np.concatenate(c) for c in zip(*(x for _, x in got)))
            order = np.lexsort((at, doc))
            key, doc, at, pack = (c[order] for c in (key, doc, at, pack))
            x, y = near_pairs(key, doc, np.stack(blocks)[:, order], behind[order], before[order])
            pairs.append((doc[x], doc[y], at[y] - at[x], pack[x], pack[y]))
        return _table(out + to_packs(pairs))

    def fetch(group: pa.Table, more: pa.Table) -> pa.Table:
        out, wanted = [], []
        for at, kind, blob in zip(*(more[c].to_pylist() for c in ("at", "kind", "blob"))):
            if kind == _WANTED:
                wanted.append(load(blob))
            else:
                out.append((at, at, kind, blob))
        if wanted:
            pack = Pack(group)
            y, px = (np.concatenate(c) for c in zip(*wanted))
            for g in _groups(px):
                to, doc = int(px[g[0]]), np.unique(y[g])
                data, offsets = pack.only(doc)
                head = dump(doc, np.diff(offsets))
                out.append((to, to, _BODY, zstandard.ZstdCompressor(level=3).compress(len(head).to_bytes(8, "little") + head + data.tobytes())))
        return _table(out)

    # Each stage runs once: rows that a later one needs pass through those between, and texts are dealt to packs once.
    to_pack = packs.applyInArrow(find, _ROWS).groupBy("at").applyInArrow(join, _ROWS).groupBy("at")
    to_pack = packs.cogroup(to_pack).applyInArrow(surround, _ROWS).groupBy("at").applyInArrow(agree, _ROWS).groupBy("at")
    given = packs.cogroup(to_pack).applyInArrow(fetch, _ROWS)

    def verify(group: pa.Table, more: pa.Table) -> pa.Table:
        pack = Pack(group)
        tokens = Tokens(pack.data, pack.offsets)
        mine = {int(d): tokens.all[tokens.begin[h] : tokens.begin[h + 1]] for d, h in zip(pack.unique, pack.head)}
        other: dict[int, np.ndarray] = {}
        pairs, out = [], []
        size = {int(d): int(n) for d, n in zip(pack.unique, np.diff(tokens.begin)[pack.head])}
        for kind, blob in zip(more["kind"].to_pylist(), more["blob"].to_pylist()):
            if kind == _PAIRS:
                pairs.append(load(blob))
            elif kind == _SURE:
                x, y, shift, low, high = load(blob)
                n = np.array([size[d] for d in x.tolist()], np.int64)
                # windows that would begin before a text or end behind it are not there; y's end is not known here
                out += [(x, y, np.maximum(low, 0), np.minimum(high, n)), (y, x, np.maximum(low + shift, 0), high + shift)]
            else:
                raw = zstandard.ZstdDecompressor().decompress(blob)
                n = int.from_bytes(raw[:8], "little")
                doc, sizes = load(raw[8 : 8 + n])
                t = Tokens(np.frombuffer(raw, np.uint8, -1, 8 + n), np.concatenate([[0], np.cumsum(sizes)]))
                other.update((d, t.all[a:b]) for d, a, b in zip(doc.tolist(), t.begin, t.begin[1:]))
        spans = []
        if pairs:
            x, y, shift, _ = (np.concatenate(c) for c in zip(*pairs))
            order = np.lexsort((shift, y, x))
            seen: tuple = (None, None, 0)
            for a, b, s in zip(x[order].tolist(), y[order].tolist(), shift[order].tolist()):
                if seen[:2] == (a, b) and s - seen[2] <= DRIFT - 1:
                    continue  # parts that are so little further off were compared with these
                seen = (a, b, s)
                second = mine[b] if b in mine else other[b]
                found, back = matches(mine[a], second, s)
                spans += [(a, b, p, q) for p, q in found]
                spans += [(b, a, p, q) for p, q in back]
        if spans:
            out.append(tuple(np.array(spans, np.int64).T))
        doc, partner, low, high = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        ids = group["doc_id"].to_pylist()
        at = {d: n for d, n in zip(pack.rows["doc_id"].to_pylist(), tokens.n_words.tolist())} if len(set(ids)) == len(ids) else None
        n_words = [at[d] for d in ids] if at is not None else tokens.n_words.tolist()
        own = ids if at is not None else pack.rows["doc_id"].to_pylist()
        columns = [pa.concat_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())]) for a, b in ((own, doc), ([None] * len(own), partner), (n_words, [None] * len(doc)), ([None] * len(own), low), ([None] * len(own), high + SHINGLE - 1))]
        return pa.table(columns, names=["doc_id", "partner", "n_words", "start", "end"])

    return packs.cogroup(given.groupBy("at")).applyInArrow(verify, "doc_id long, partner long, n_words long, start long, end long")


def _pairs(x: np.ndarray, y: np.ndarray, shift: np.ndarray, pack: np.ndarray) -> bytes:
    order = np.lexsort((shift, y, x))
    x, y, shift, pack = x[order], y[order], shift[order], pack[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (shift[1:] != shift[:-1])]
    return dump(x[new], y[new], shift[new], pack[new].astype(np.int32))


def _merged() -> F.Column:
    """Union of sorted runs, as runs."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: F.Column, h: F.Column) -> F.Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], h["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (h["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), joined).otherwise(F.concat(acc, F.array(h)))

    return F.aggregate(F.array_sort("spans"), none, step)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, class_id (least doc_id that passages connect it with, itself included), n_passages,
    n_passage_words and passages (start:end of word runs, comma-joined) of every document.

    Null and short texts have no passages.  Rows with the same doc_id count as
    one document each for n_words; passages are those of the first one by text.
    Rows with a null doc_id count as one document with the least id; its class_id is null where it is
    the least.  No rows give no rows; other columns of docs are not looked at.
    """
    prepare(docs.sparkSession)
    found = found_passages(docs).checkpoint()
    pairs = found.where("partner IS NOT NULL")
    ids = components(pairs.select(F.col("doc_id").alias("a"), F.col("partner").alias("b"))).withColumnRenamed("node", "id")
    # a text that many quote has as many rows: equal runs are one before any are gathered
    runs = pairs.select(F.col("doc_id").alias("id"), F.struct("start", "end").alias("s")).distinct().groupBy("id").agg(F.collect_list("s").alias("spans")).select("id", _merged().alias("runs"))
    first = F.lit(_FIRST_ID).cast("long")
    out = found.where("partner IS NULL").select("doc_id", "n_words", F.coalesce("doc_id", first).alias("id")).join(ids, "id", "left").join(runs, "id", "left")
    out = out.withColumn("runs", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), F.least(r["end"], "n_words").alias("end"))))
    size = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select(
        "doc_id", "n_words", F.nullif(F.coalesce("label", "id"), first).alias("class_id"), F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_passages"),
        F.coalesce(size, F.lit(0)).alias("n_passage_words"),
        F.coalesce(F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["start"], r["end"])), ","), F.lit("")).alias("passages"),
    )


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
