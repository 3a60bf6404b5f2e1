from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import neardup, passages, suffix
from strata.llm.graph import components
from strata.llm.text import ALNUM, SPACED, Words, flat

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=80)), max_size=8), st.integers(3, 60))
def test_words_of_many_texts(texts, size):
    import pyarrow as pa

    from strata.llm import text as kernel

    kept, kernel.SLICE = kernel.SLICE, size
    try:
        texts = [None if t is None else t.encode("utf-8", "replace").decode() for t in texts]
        data, offsets = flat(pa.array(texts, pa.string()))
        for table, pattern in ((SPACED, rb"[^\x20\x09-\x0D]+"), (ALNUM, rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
            w = Words(data, offsets, table)
            for i, t in enumerate(texts):
                got = [bytes(data[a:b]) for a, b in zip(w.first[w.text[i] : w.text[i + 1]], w.end[w.text[i] : w.text[i + 1]])]
                assert got == re.findall(pattern, (t or "").encode())
    finally:
        kernel.SLICE = kept


def brute_components(rows, share=85):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = defaultdict(lambda: 1 << 60)
    for (d, _), x in zip(rows, label):
        least[x] = min(least[x], d)
    return sorted((d, len(s), least[x], d == least[x]) for (d, _), s, x in zip(rows, sets, label))


def test_near_duplicates_equal_brute_force(corpus, nothing, monkeypatch):
    docs, rows = corpus
    want = brute_components(rows)
    assert sorted(tuple(r) for r in neardup.near_duplicates(docs).collect()) == want
    assert sum(w[3] for w in want) < len(want) - 10
    assert neardup.near_duplicates(nothing).count() == 0
    kept = neardup.keep_one_of_each(docs, neardup.SHARE)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({w[0] for w in want if w[3]})  # one of the repeated row
    monkeypatch.setattr(neardup, "BLOCK", 3)  # large clusters go in pairs of blocks
    assert sorted(tuple(r) for r in neardup.near_duplicates(docs).collect()) == want


def test_stage_keeps_one_row_of_each_component(spark, corpus, nothing):
    docs, rows = corpus
    a, b = rows[15][1], rows[16][1]
    odd = [(None, a), (None, a), (5, a), (5, b), (5, b), (7, b), (None, None), (9, None), (9, None), (9, ""), (8, " "), (None, "only without an id")]
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in odd], "doc_id long, text string, n string, digest string")
    kept = neardup.keep_one_of_each(frame)
    assert kept.columns == frame.columns
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str)
    assert got == sorted([(5, a), (5, b), (None, ""), (9, ""), (8, " "), (None, "only without an id")], key=str)
    want = brute_components(rows, 80)
    assert sorted(r.doc_id for r in neardup.keep_one_of_each(docs).collect()) == sorted({w[0] for w in want if w[3]})
    assert neardup.keep_one_of_each(nothing).count() == 0


def test_words_that_polynomials_confuse_have_different_hashes():
    import pyarrow as pa

    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << 11))
    other = morse.translate(str.maketrans("ab", "ba"))
    far = "x" * (1 << 16)
    texts = [morse, other, morse + far + other, other + far + morse, "a" + far[1:] + "b", "b" + far[1:] + "a"]
    for table in (SPACED, ALNUM):
        assert len(set(Words(*flat(pa.array(texts)), table).hash.tolist())) == len(texts)


def test_spread_join_equals_a_plain_join(spark, monkeypatch):
    from strata.operators import skew
    from strata.operators.skew import spread_join

    monkeypatch.setattr(skew, "HOT", 500)
    many = spark.createDataFrame([(0 if i % 2 else i, i) for i in range(5000)] + [(None, i) for i in range(1500)], "k long, v long")
    one = spark.createDataFrame([(0, 2500, "hot"), (2, 1, "two"), (-1, 7, "none")], "k long, size long, w string")
    for how in ("inner", "left"):
        plain = many.join(one.drop("size"), "k", how)
        got = spread_join(many, one, "k", "size", 6500, how)
        assert got.columns == plain.columns and got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


def test_estimates_are_close():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for share in (0.0, 0.3, 0.6, 0.9):
        k = round(2000 * 2 * share / (1 + share) / 1)
        a, b = np.unique(pool[:2000]), np.unique(np.concatenate([pool[:k][:2000], rng.integers(0, 1 << 63, 2000 - min(k, 2000), dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sig = [neardup.signature(np.sort(x * np.uint64(2))) for x in (a, b)]
        near = neardup.estimate(sig[0][None], sig[1][None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(near - true) < 0.2


def test_components(spark, monkeypatch):
    monkeypatch.setattr("strata.operators.skew.HOT", 500)
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 6), (100, 3)] + [(1000, i) for i in range(1001, 4000)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found[100] == 1 and found[5] == 4 and found[8] == 6 and all(found[i] == 1000 for i in range(1000, 4000)) and 9 not in found
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges_of_near_copies_grow_with_their_number(spark, monkeypatch):
    rng = random.Random(17)
    base, copies = [str(rng.random()) for _ in range(300)], []
    for k in range(150):
        copies.append(list(base))
        for at in rng.sample(range(300), 6):
            copies[-1][at] = f"edit{k}"
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(copies)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(neardup, "components", lambda edges: seen.append(edges.count()) or components(edges))
    out = neardup.near_duplicates(docs).collect()
    want = brute_components([(i, " ".join(w)) for i, w in enumerate(copies)])
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == want
    assert seen[0] < 12 * 150, seen  # not one for each band


def brute_repeats(rows, length):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "piece"), [(100, 1 << 18), (100, 300), (24, 100)])
def test_repeats_equal_brute_force(corpus, nothing, length, piece, monkeypatch):
    docs, rows = corpus
    monkeypatch.setattr(suffix, "SLICE", piece)
    monkeypatch.setattr(suffix, "_TABLES", [])
    monkeypatch.setattr(suffix, "BATCH", 64)
    want = brute_repeats(rows, length)
    assert sorted(tuple(r) for r in suffix.remove_repeats(docs, length).collect()) == want
    assert sum(w[2] for w in want) > 5000
    assert suffix.remove_repeats(nothing).count() == 0


def test_repeats_with_null_ids(spark):
    text = " ".join(map(str, range(1000, 1030)))
    docs = spark.createDataFrame([(None, text), (4, text), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffix.remove_repeats(docs).collect()) == [(0, 0), (0, 0), (4, len(text))]


def test_levels_merge_geometrically():
    rng = np.random.default_rng(2)
    levels, seen = suffix.SuffixLevels(3), set()
    for _ in range(40):
        batch = np.array([bytes(rng.integers(97, 101, 3).astype(np.uint8)) for _ in range(rng.integers(1, 9))], "S3")
        want = []
        for x in batch.tolist():
            want.append(x in seen)
            seen.add(x)
        assert levels.add(batch).tolist() == want
    sizes = [len(x) for x in levels.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(seen)


def test_dump_and_load():
    columns = [np.array([5, -7, 1 << 60], np.int64), np.array([1, 2, 3], np.uint8), np.array([9, 0, 4], np.uint32)]
    for a, b in zip(columns, suffix.load(suffix.dump(*columns))):
        assert a.dtype == b.dtype and (a == b).all()


def brute_windows(values, least):
    out = []
    for c, v in enumerate(values):
        a = c
        while a > 0 and values[a - 1] > v:
            a -= 1
        b = c
        while b + 1 < len(values) and values[b + 1] > v:
            b += 1
        if b - a + 1 >= least:
            out.append((a, c, b))
    return out


def test_compact_windows_equal_brute_force():
    rng = np.random.default_rng(5)
    values = rng.permutation(np.arange(1, 400, dtype=np.uint64)) << np.uint64(30)
    left, centre, right = passages.compact_windows(values, np.array([len(values)]), 10)
    assert list(zip(left.tolist(), centre.tolist(), right.tolist())) == brute_windows(values.tolist(), 10)


def test_shared_passages_are_found(corpus, nothing):
    docs, rows = corpus
    found = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    assert set(found) == {d for d, _ in rows}
    windows = defaultdict(set)
    texts = dict(rows)
    for d, t in texts.items():
        w = words(t)
        for i in range(len(w) - 49):
            windows[tuple(w[i : i + 50])].add(d)
    covered = defaultdict(set)
    for d, t in texts.items():
        w = words(t)
        for i in range(len(w) - 49):
            others = windows[tuple(w[i : i + 50])]
            if len(others) > 1:
                covered[d] |= set(range(i, i + 50))
                assert len({found[e].class_id for e in others}) == 1
    assert len(covered) > 20
    for d, r in found.items():
        runs = [tuple(map(int, x.split(":"))) for x in r.passages.split(",") if x]
        marked = {i for a, b in runs for i in range(a, b)}
        assert covered[d] <= marked and len(marked) == r.n_passage_words and len(runs) == r.n_passages
        assert r.n_words == len(words(texts[d]))
    near = [d for d, r in found.items() if r.n_passages and not covered[d]]
    assert len(near) < len(covered)  # only near copies besides
    assert Counter(r.class_id for r in found.values() if not r.n_passages).most_common(1)[0][1] == 1
    assert passages.repeated_passages(nothing).count() == 0


def test_partial_quotes_of_lower_ids_hide_no_passage(spark):
    rng = random.Random(21)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(n))
    texts = []
    want = []
    for _ in range(12):
        p = fresh(54).split()
        quotes = [f"{fresh(40)} {' '.join(p[a : a + 34])} {fresh(40)}" for a in range(0, 21, 2)]
        both = [f"{fresh(30)} {' '.join(p[k : k + 30])} {fresh(30)} {' '.join(p)} {fresh(20)}" for k in (0, 24)]
        texts += quotes
        want.append((len(texts), len(texts) + 1))
        texts += both
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    for x, y in want:
        for d in (x, y):
            runs = [tuple(map(int, r.split(":"))) for r in found[d].passages.split(",") if r]
            assert any(a <= 90 and b >= 144 for a, b in runs), (d, runs)
        assert found[x].class_id == found[y].class_id == x


def brute_passages(texts):
    """All windows of 50 words against all: which documents have near duplicates (shingle sets, 0.8), with the windows."""
    sets = []
    for t in texts:
        w = words(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        sets.append([frozenset(grams[i : i + 46]) for i in range(len(grams) - 45)])
    found = defaultdict(set)
    for a in range(len(texts)):
        for b in range(len(texts)):
            if a != b and set().union(*sets[a]) & set().union(*sets[b]):
                for i, x in enumerate(sets[a]):
                    if any(10 * len(x & y) >= 8 * len(x | y) for y in sets[b] if len(x & y) > 40):
                        found[a, b].add(i)
    return found


@pytest.mark.parametrize("piece", [30, 40, 48])
def test_passages_among_pieces_of_them(spark, piece):
    """Pieces in documents of lower id, passages with an edit, and a passage of 50 words: recall against all windows."""
    rng = random.Random(piece)
    fresh = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    texts = []
    for k in range(14):
        size = (60, 50, 55)[k % 3]
        p = fresh(size)
        for _ in range(rng.randint(1, 12)):
            a = rng.randrange(size - piece + 1)
            texts.append(" ".join(fresh(20) + p[a : a + piece] + fresh(20)))
        edited = list(p)
        at = rng.randrange(10, size - 10)
        if k % 4 == 1:
            del edited[at]
        elif k % 4 == 2:
            edited.insert(at, "put")
        elif k % 4 == 3:
            edited[at] = "put"
        texts += [" ".join(fresh(30) + p + fresh(25)), " ".join(fresh(10) + edited + fresh(40))]
    want = brute_passages(texts)
    docs = spark.createDataFrame([*enumerate(texts), (None, None), (None, texts[-1]), (3, texts[3])], "doc_id long, text string")
    found = {(r.doc_id, r.partner) for r in passages.found_passages(docs).where("partner IS NOT NULL AND doc_id >= 0 AND partner >= 0").collect()}
    out = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    linked = [(a, b) for a, b in want if out[a].class_id == out[b].class_id and out[a].n_passages]
    recall = len(linked) / len(want)
    identical = [(a, b) for a, b in want if set(zip(*(words(texts[a])[i:] for i in range(50)))) & set(zip(*(words(texts[b])[i:] for i in range(50))))]
    print(f"pieces of {piece} words: {len(want)} links, recall {recall:.3f}; {len(identical)} of identical passages")
    assert recall >= 0.95 and set(identical) <= set(linked) and len(want) >= 20
    assert all((a, b) in want for a, b in found)  # nothing else is linked


def passage_words(row):
    return {i for x in row.passages.split(",") if x for i in range(*map(int, x.split(":")))}


def test_no_near_duplicate_passage_is_lost_among_many(spark):
    """More than FEW classes for each min-hash: passages of about 50 words with edits and cut edges, against all windows."""
    rng = random.Random(30)
    fresh = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(n)]
    texts = []
    for _ in range(10):
        p = fresh(50)
        for _ in range(24):
            w, kind, at, put = list(p), rng.randrange(4), rng.randrange(1, 50), rng.choice(("put", "other"))
            w[at : at + (kind in (1, 3))] = [put] * (kind in (1, 2))
            w = w[rng.choice((0, 0, 1, 2, 4)) : len(w) - rng.choice((0, 0, 1, 3, 5))]
            texts.append(" ".join(fresh(rng.choice((0, 3, 7))) + w + fresh(rng.choice((1, 4, 9)))))
    want = brute_passages(texts)
    out = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(want) > 300 and all(out[a].class_id == out[b].class_id for a, b in want)
    for (a, _), windows in want.items():
        assert {i + k for i in windows for k in (0, 49)} <= passage_words(out[a])


def test_a_variant_in_the_first_document_of_a_class_is_compared_with_its_second(spark):
    rng = random.Random(31)
    fresh = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(n)]
    p, more = fresh(140), fresh(60)
    variant = p[:70] + ["put"] + p[71:]
    docs = spark.createDataFrame([(0, " ".join(p + more + variant)), (1, " ".join(p + more)), (2, " ".join(fresh(90)))], "doc_id long, text string")
    out = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    assert passage_words(out[0]) == {*range(340)} and passage_words(out[1]) == {*range(200)} and not out[2].n_passages


@pytest.mark.parametrize("paired", [passages.PAIRED, 0])
def test_few_pairs_of_many_windows_cover_all_that_all_pairs_do(monkeypatch, paired):
    """Near copies with words replaced, put in and left out, two groups, repeats in a document: against all windows."""
    rng = np.random.default_rng(40)
    texts, key, doc, at = [], [], [], []
    for group in range(2):
        p = rng.integers(1, 1 << 62, 200, dtype=np.uint64)
        for _ in range(40):
            w = p.copy()
            for _ in range(rng.integers(1, 6)):
                k, (gone, put) = int(rng.choice(np.r_[5:90, 110:190])), ((5, 5), (4, 5), (5, 4))[rng.integers(3)]
                w = np.concatenate([w[:k], rng.integers(1, 1 << 62, put, dtype=np.uint64), w[k + gone :]])
            a, b = rng.integers(0, 60), len(w) - rng.integers(0, 60)
            w = np.concatenate([w[a:b], rng.integers(1, 1 << 62, 9, dtype=np.uint64), w[a:b]][: 1 + 2 * (len(texts) % 9 == 0)])
            for k in np.flatnonzero(w == p[100]).tolist():
                key.append(group + 1)
                doc.append(len(texts))
                at.append(k)
            texts.append(w)
    begin = np.cumsum([0, *map(len, texts)])
    key, doc, at = np.array(key, np.uint64), np.array(doc), np.array(at)
    around, behind, before = passages.blocks_of(np.concatenate(texts), begin[doc] + at, begin[doc], begin[doc + 1])
    monkeypatch.setattr(passages, "PAIRED", paired)
    x, y = passages.near_pairs(key, doc, np.asfortranarray(around), behind, before)
    assert (doc[x] > doc[y]).all() and (key[x] == key[y]).all()
    if paired:
        assert len(x) < 3 * len(key)

    words, label = [set() for _ in texts], np.arange(len(texts))
    for i, j in zip(x.tolist(), y.tolist()):
        runs = passages.matches(texts[doc[i]], texts[doc[j]], int(at[j] - at[i]))
        for d, found in zip((doc[i], doc[j]), runs):
            words[d] |= {k for a, b in found for k in range(a, b)}
        if runs[0]:
            label[label == label[doc[i]]] = label[doc[j]]
    starts = range(1 - passages.LEAST, 1)
    runs = [{t: frozenset(texts[d][c + t : c + t + passages.LEAST].tolist()) for t in starts if 0 <= c + t <= len(texts[d]) - passages.LEAST} for d, c in zip(doc, at)]
    links = 0
    for i in range(len(key)):
        for j in np.flatnonzero((key == key[i]) & (doc != doc[i])).tolist():
            same = around[:, i] == around[:, j]
            long = sum(int(np.argmin(np.r_[part[: passages.RUN], False])) for part in (same[passages.SIDE :], same[: passages.SIDE][::-1]))
            near = [t for t, a in runs[i].items() if any(len(a & runs[j].get(t + k, a - a)) >= passages.NEEDED for k in range(-2, 3))] if long >= passages.RUN else []
            assert {k for t in near for k in range(at[i] + t, at[i] + t + passages.LEAST)} <= words[doc[i]]
            assert not near or label[doc[i]] == label[doc[j]]
            links += bool(near)
    assert links > 500
