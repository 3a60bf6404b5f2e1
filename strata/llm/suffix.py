"""Removal of repeated byte strings with suffix arrays in a logarithmic index family.

Every run of ``LENGTH`` bytes is a window.  Its anchor, the k-gram with the
least hash inside it, depends on its bytes alone, so equal windows have equal
anchors; windows that follow each other mostly share one and form a segment.

1. Packs of documents find their segments.  Segments that a pack repeats are
   settled there; of the others only hashes go to the partition of their anchor.
2. There, a segment whose bytes came before (by the anchor and 128 bits of two hashes) is removed as a whole.  Of the first
   ones, those whose anchor another segment has too are asked for their bytes.
3. The bytes of these are sorted by suffix in batches, by document and start.  A
   batch's suffix array is scanned against the levels there are for windows that
   came before; then it becomes a level, and levels of like size are merged.
4. Packs cut what the marks of all partitions cover.

Nothing but hashes, marks and the bytes around partial matches leaves a pack.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.session import packs_of, prepare, table, texts
from strata.llm.text import VALUE, _powers, flat, mix

LENGTH = 100
GRAM = 32
#: Windows handled at once; below 2^20, the bits that positions have in a key.
SLICE = 1 << 18
#: Windows in a batch of the index.
BATCH = 1 << 16
_BASE = 0x9E6C63D0876A9A35
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = np.uint64((1 << 20) - 1)
_TABLES: list[np.ndarray] = []
_FIRST_ID = -(1 << 63)


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        _TABLES.extend(_powers(b, SLICE + 2 * LENGTH) for b in (_BASE, _INVERSE))
    return _TABLES


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """first window, number of windows, anchor hash and two content hashes of segments, in order.

    The first content hash is a polynomial of the bytes, the second one of the mixed hashes of the k-grams.

    ``ends``: for each byte, none; an ascending array of where the texts end.
    Windows never cross an end.
    """
    up, down = _tables()
    gram = min(GRAM, max(1, length // 3))
    width = length - gram + 1
    for a in range(0, max(0, len(data) - length + 1), SLICE):
        b = min(a + SLICE, len(data) - length + 1)
        part = data[a : b + length - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(VALUE[part] * up[: len(part)], out=total[1:])
        grams = mix((total[gram:] - total[:-gram]) * down[: len(part) - gram + 1])
        key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[: b - a], key[width - span : width - span + b - a])
        anchor = (key[: b - a] & _LOW).astype(np.int64)
        at = np.arange(a, b)
        inside = at + length <= ends[np.searchsorted(ends, at, "right")]
        edge = np.empty(b - a, bool)
        edge[0] = True
        edge[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(edge)
        size = np.diff(np.append(first, b - a))
        # documents that follow without a gap cannot share an anchor, but zero windows lie between them
        first, size = first[inside[first]], size[inside[first]]
        content = mix((total[first + size + length - 1] - total[first]) * down[first] + size.astype(np.uint64))
        np.cumsum(grams * up[: len(grams)], out=total[1 : len(grams) + 1])
        more = mix((total[first + size + length - gram] - total[first]) * down[first])
        yield first + a, size, (grams[anchor[first]] >> np.uint64(7)).astype(np.uint32), content, more


def dump(*columns: np.ndarray) -> bytes:
    """Integer columns, compressed: byte planes of differences."""
    out = [np.array([len(columns), len(columns[0])], np.int64).tobytes()]
    for c in columns:
        c = np.ascontiguousarray(c)
        delta = np.diff(c, prepend=c.dtype.type(0)) if c.dtype == np.int64 else c
        out.append(c.dtype.str.encode().ljust(4))
        out.append(np.ascontiguousarray(delta.view(np.uint8).reshape(len(c), -1).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def load(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k, n = np.frombuffer(raw, np.int64, 2)
    at, out = 16, []
    for _ in range(k):
        kind = np.dtype(raw[at : at + 4].decode().strip())
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 4).reshape(kind.itemsize, n)
        delta = np.ascontiguousarray(planes.T).view(kind).reshape(n)
        out.append(np.cumsum(delta, dtype=np.int64) if kind == np.int64 else delta)
        at += 4 + n * kind.itemsize
    return out


class Pack:
    """Documents of one group, by doc_id; rows with the same doc_id stand behind each other, by text."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.rows = rows
        self.data, self.offsets = flat(rows["text"])
        ids = rows["doc_id"].fill_null(_FIRST_ID).to_numpy()
        order = np.argsort(ids, kind="stable")  # nulls, which sort_by puts last, come first
        if len(ids) and (order[0] != 0 or np.any(np.diff(order) < 0)):
            rows = rows.take(pa.array(order))
            self.rows, ids = rows, ids[order]
            self.data, self.offsets = flat(rows["text"])
        self.ids = ids
        self.unique, self.head = np.unique(ids, return_index=True)

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc_id and start (counted from the first row of that doc_id) of bytes."""
        row = np.searchsorted(self.offsets, at, "right") - 1
        head = self.head[np.searchsorted(self.unique, self.ids[row])]
        return self.ids[row], at - self.offsets[head]

    def only(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts of these doc_ids."""
        row = self.head[np.searchsorted(self.unique, doc)]
        size = np.diff(self.offsets)[row]
        offsets = np.concatenate([[0], np.cumsum(size)])
        return self.data[np.repeat(self.offsets[row] - offsets[:-1], size) + np.arange(int(offsets[-1]))], offsets

    def byte(self, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        return self.offsets[self.head[np.searchsorted(self.unique, doc)]] + start


def _found(pack: Pack, length: int) -> tuple[np.ndarray, ...]:
    ends = pack.offsets[1:][np.diff(pack.offsets) > 0]
    parts = list(segments(pack.data, ends, length))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint32, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _table(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"pack": pa.int32(), "part": pa.int32(), "kind": pa.int32(), "blob": pa.binary()}
    return pa.table([pa.array([r[k] for r in rows], kinds[n]) for k, n in enumerate(names.split())], names=names.split())


_HASHES, _MARKS, _ASKED = 0, 1, 2
_ROWS = "part int, pack int, kind int, blob binary"


class SuffixLevels:
    """A logarithmic family of suffix arrays over the windows of segments seen so far.

    Suffixes are kept with the ``length`` bytes that they are compared by.
    """

    def __init__(self, length: int):
        self.length, self.levels = length, []

    def add(self, suffixes: np.ndarray) -> np.ndarray:
        """Which suffixes (in text order) came before; then they are part of the index."""
        order = np.argsort(suffixes, kind="stable")  # the batch's suffix array
        ranked = suffixes[order]
        known = np.zeros(len(ranked), bool)
        known[1:] = ranked[1:] == ranked[:-1]
        for level in self.levels:  # merge-scan
            at = np.minimum(np.searchsorted(level, ranked), len(level) - 1)
            known |= level[at] == ranked
        new = ranked[~known]
        if len(new):
            self.levels.append(new)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            self.levels[-2:] = [np.sort(np.concatenate(self.levels[-2:]), kind="stable")]
        out = np.empty(len(ranked), bool)
        out[order] = known
        return out


def _new(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(pack, doc_id, text, marks): documents with the windows that came before, as rows of a pack."""
    parts = packs_of(docs)
    rows = texts(docs).select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("pack"), "doc_id", "text")
    packs = rows.groupBy("pack")

    def find(group: pa.Table) -> pa.Table:
        pack = Pack(group)
        number = group["pack"][0].as_py()
        first, size, anchor, content, more = _found(pack, length)
        order = np.lexsort((more, content, anchor))
        new = _new(anchor[order], content[order], more[order])
        again = np.sort(order[~new])
        doc, start = pack.place(first[again])
        out = [(number % parts, number, _MARKS, dump(doc, start, size[again].astype(np.uint8)))] if len(again) else []
        keep = np.sort(order[new])
        keep = keep[np.argsort(anchor[keep] % np.uint32(parts), kind="stable")]
        to = (anchor[keep] % np.uint32(parts)).astype(np.int64)
        doc, start = pack.place(first[keep])
        for x in np.split(np.arange(len(keep)), np.flatnonzero(np.diff(to)) + 1) if len(keep) else []:
            k = keep[x]
            out.append((int(to[x[0]]), number, _HASHES, dump(anchor[k], content[k], more[k], doc[x], start[x], size[k].astype(np.uint8))))
        return _table(out, "part pack kind blob")

    def settle(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        out, got = [], []
        for pack, kind, blob in zip(*(group[c].to_pylist() for c in ("pack", "kind", "blob"))):
            if kind == _MARKS:
                out.append((part, pack, _MARKS, blob))
            else:
                got.append((pack, load(blob)))
        if got:
            anchor, content, more, doc, start, size = (np.concatenate(c) for c in zip(*(x for _, x in got)))
            pack = np.repeat([p for p, _ in got], [len(x[0]) for _, x in got])
            order = np.lexsort((start, doc, more, content, anchor))
            anchor, content, more, doc, start, size, pack = (c[order] for c in (anchor, content, more, doc, start, size, pack))
            new = _new(anchor, content, more)
            group_of = np.cumsum(_new(anchor)) - 1
            asked = new & (np.bincount(group_of, new)[group_of] > 1)
            for kind, flag in ((_MARKS, ~new), (_ASKED, asked)):
                at = np.flatnonzero(flag)
                at = at[np.lexsort((start[at], doc[at], pack[at]))]
                for x in np.split(at, np.flatnonzero(np.diff(pack[at])) + 1) if len(at) else []:
                    out.append((part, int(pack[x[0]]), kind, dump(doc[x], start[x], size[x])))
        return _table(out, "part pack kind blob")

    def fetch(group: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows or not group.num_rows:
            return _table([], "part pack kind blob")
        pack, out = Pack(group), []
        for part, number, blob in zip(*(asked[c].to_pylist() for c in ("part", "pack", "blob"))):
            doc, start, size = load(blob)
            n = size.astype(np.int64) + length - 1
            at = np.repeat(pack.byte(doc, start) - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            out.append((part, number, _ASKED, zstandard.ZstdCompressor(level=1).compress(len(blob).to_bytes(8, "little") + blob + pack.data[at].tobytes())))
        return _table(out, "part pack kind blob")

    def index(group: pa.Table) -> pa.Table:
        part, got = group["part"][0].as_py(), []
        for pack, blob in zip(group["pack"].to_pylist(), group["blob"].to_pylist()):
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n = int.from_bytes(raw[:8], "little")
            doc, start, size = load(raw[8 : 8 + n])
            got.append((doc, start, size.astype(np.int64), np.full(len(doc), pack), np.frombuffer(raw, np.uint8, -1, 8 + n)))
        doc, start, size, pack, data = (np.concatenate(c) for c in zip(*got))
        begin = np.cumsum(size + length - 1) - (size + length - 1)
        order = np.lexsort((start, doc))
        levels, marks = SuffixLevels(length), []
        view = np.lib.stride_tricks.sliding_window_view(data, length)
        cuts = np.searchsorted(np.cumsum(size[order]), np.arange(BATCH, int(size.sum()) + BATCH, BATCH), "left") + 1
        last = 0
        for cut in np.unique(np.minimum(cuts, len(order))):
            k = order[last:cut]
            last = cut
            n = size[k]
            of = np.repeat(np.arange(len(k)), n)
            step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            suffixes = np.ascontiguousarray(view[begin[k][of] + step]).view(f"S{length}").ravel()
            known = levels.add(suffixes)
            hit = np.flatnonzero(known)
            if len(hit):
                new = np.r_[True, (np.diff(hit) != 1) | (np.diff(of[hit]) != 0)]
                head = hit[new]
                long = np.diff(np.append(np.flatnonzero(new), len(hit)))
                marks.append((pack[k][of[head]], doc[k][of[head]], start[k][of[head]] + step[head], long))
        if not marks:
            return _table([], "part pack kind blob")
        pack, doc, start, long = (np.concatenate(c) for c in zip(*marks))
        order = np.lexsort((start, doc, pack))
        pack, doc, start, long = (c[order] for c in (pack, doc, start, long))
        out = [(part, int(pack[x[0]]), _MARKS, dump(doc[x], start[x], long[x].astype(np.uint8))) for x in np.split(np.arange(len(pack)), np.flatnonzero(np.diff(pack)) + 1)]
        return _table(out, "part pack kind blob")

    settled = packs.applyInArrow(find, _ROWS).groupBy("part").applyInArrow(settle, _ROWS)
    bodies = packs.cogroup(settled.where(F.col("kind") == _ASKED).groupBy("pack")).applyInArrow(fetch, _ROWS)
    marks = settled.where(F.col("kind") == _MARKS).unionByName(bodies.groupBy("part").applyInArrow(index, _ROWS))

    def cut(group: pa.Table, marked: pa.Table) -> pa.Table:
        pack = Pack(group)
        change = np.zeros(len(pack.data) + 1, np.int32)
        for blob in marked["blob"].to_pylist():
            doc, start, size = load(blob)
            at = pack.byte(doc, start)
            np.add.at(change, at, 1)
            np.add.at(change, at + size.astype(np.int64) + length - 1, -1)
        np.cumsum(change, out=change)
        gone = change[:-1] > 0
        rows: list[tuple] = []
        for a, b in zip(pack.offsets, pack.offsets[1:]):
            g = gone[a:b]
            spans = int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if b > a else 0
            kept = pack.data[a:b][~g].tobytes() if spans else pack.data[a:b].tobytes()
            rows.append((int(b - a), int(np.count_nonzero(g)), spans, hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
        return pa.table([pack.rows["doc_id"], *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return packs.cogroup(marks.groupBy("pack")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    A null text is empty and keeps nothing; a null doc_id comes before all
    others; rows with the same doc_id come by text, repeated rows in any order.
    No rows give no rows; other columns of docs are not looked at.
    """
    prepare(docs.sparkSession)
    return repeated(docs, length)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
