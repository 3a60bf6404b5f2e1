from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.llm import decontaminate as D
from strata.llm import fingerprint, packing, pii, quality, toxicity, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_archives_round_trip(spark, tmp_path):
    long, twin = "é" * 600, "<p>" + "z" * 1200
    rows = [(1, "http://a/1", long), (2, "http://a/2", twin), (3, None, twin), (4, "http://b/ü", "short"), (5, "x", "short"), (6, "y", None), (None, "n", "q"), (9, "http://a/9", twin), (9, "http://a/9", twin)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, size string")
    found = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    one = lambda i, text, kind="response", to=None: (i, len(text.encode()), hashlib.sha1(text.encode()).hexdigest(), kind, to)
    want = [one(1, long), one(2, twin, "revisit", 9), one(3, twin, "revisit", 9), one(4, "short"), one(5, "short"), one(6, ""), one(0, "q"), one(9, twin), one(9, twin)]
    assert found == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0
    files = warc.write(pages, f"file://{tmp_path}/w").persist()
    for split in (37, 500, 1 << 20):  # any split reads each record once, with its payload
        got = warc.read(files, split).collect()
        assert warc.read(files, split).rdd.getNumPartitions() == sum(-(-r.bytes // split) for r in files.collect())
        assert len(got) == len(rows) and {bytes(r.payload).decode() for r in got if r.page_id == 1} == {long}


def test_reader_passes_over_what_only_looks_like_a_member(tmp_path):
    body = warc.member([("WARC-Type", "response"), ("WARC-Record-ID", f"<{warc.PAGE}7>")], b"HTTP/1.1 200 OK\r\n\r\nhi")
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"\x1f\x8b\x08 junk" + body + zlib.compress(b"WARC/1.1") + body)
    size = path.stat().st_size
    assert len(list(warc.records(str(path), size, 0, size))) == 2
    assert sum(len(list(warc.records(str(path), size, a, a + 5))) for a in range(0, size, 5)) == 2
    path.write_bytes(body[:-4])
    with pytest.raises(EOFError):
        list(warc.records(str(path), size, 0, size))


def brute_contamination(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if n and i is not None else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = [0] * len(w), set()
        for a in range(len(w)):
            for n in range(1, 14):
                if ids := windows.get(tuple(w[a : a + n])) if a + n <= len(w) else None:
                    found |= ids
                    hit[a : a + n] = [1] * n
        out.append((d, len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found)))), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out)


def test_contamination_equals_brute_force(spark, corpus, nothing, monkeypatch):
    docs, rows = corpus
    long = [t for _, t in rows if t and len(t.split()) > 100]
    items = [(1, " ".join(long[0].split()[5:40])), (20, "two words"), (3, None), (100, long[1][:300].upper()), (5, "!!"), (1, "one two three"), (None, "a")]
    bench = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, doc_id string")
    want = brute_contamination(rows, items)
    assert sorted(tuple(r)[:6] for r in D.decontaminate(docs, bench).collect()) == want and any(w[5] for w in want)
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [w[0] for w in want if not w[5]]
    assert D.decontaminate(nothing, bench).count() == 0 and D.decontaminate(docs, bench.limit(0)).where("n_hit > 0").isEmpty()
    assert D.drop_contaminated(nothing, bench).count() == 0 and D.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


@pytest.mark.parametrize(("at_once", "block"), [(1 << 20, 1 << 22), (7, 1 << 22), (60, 2000), (1 << 20, 1)])
def test_items_and_documents_in_parts(spark, corpus, at_once, block, monkeypatch):
    """Repeated rows, rows of one doc_id and rows without one are judged each, however windows and blocks are parted."""
    _, rows = corpus
    rows = [*rows, *rows[9:14], (rows[10][0], rows[20][1]), (None, rows[9][1]), (None, None), (None, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = [(i, t) for i, t in rows[9:30]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination([(-1 if d is None else d, t) for d, t in rows], items)
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    ids = lambda r: hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest()
    found = D.find_items(docs, bench, at_once=at_once).withColumn("n_hit", D._n_hit()).collect()
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, len(r["items"]), ids(r), r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in found]
    assert sorted(got) == want and all(set(r["items"]) <= set(r.near) for r in found)


def test_contaminated_rows_go_by_their_text(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(1, passage), (1, "clean text of the same id"), (None, passage), (None, "clean"), (2, passage), (2, passage), (3, None), (3, None)]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, digest string, _digest string")
    kept = D.drop_contaminated(docs, spark.createDataFrame([(7, passage)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, rows[1][1]), (None, "clean"), (3, None), (3, None)], key=str)


def test_the_index_is_stored(spark, corpus):
    docs, rows = corpus
    index = D.build(docs)
    assert [f for f in index.inputFiles() if f.endswith(".parquet")]
    words = [w for _, t in rows for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))]
    counted = {bytes(r.term).decode(): r.df for r in index.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df")).collect()}
    assert counted == {w: words.count(w) for w in set(words)} and index.selectExpr("sum(size(docs))").first()[0] == len(rows)


def test_numbers_of_postings():
    rng = np.random.default_rng(4)
    gaps = np.concatenate([rng.integers(0, 1 << k, 50) for k in (1, 7, 8, 14, 15, 21, 28, 35, 60)])
    data, ends = D.encode(gaps)
    assert D.decode(data).tolist() == gaps.tolist() and ends[-1] == len(data) and len(D.decode(data[:0])) == 0


def test_proximity(spark):
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(9)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6)))) for i in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        w = t.split()
        for i, item in items:
            own = item.split()
            if any(set(own) <= set(w[a : a + D.STRETCH * len(own)]) for a in range(len(w))) and (len(own) > 1 or own[0] in w):
                want.add((d, i))
    found = [tuple(r) for r in D.near_matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert set(found) == want and len(found) == len(want) > 50


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_personal_data_equal_plain_patterns(spark, nothing):
    rng = random.Random(3)
    bits = ["4111 1111 1111 1111", "4111111111111112", "1.2.3.4", "1.2.3.256", "01.002.3.4.5.6.7.8", "a.b@c.de", "a@b", "x@y.z_q@r.st", "+1 (555) 555-1234", "+12", "+1-2-3-4-5-6-7-8-9", "é", "😀", " ", "-", "12", "0", "a", "@", ".", "+"]
    texts = [None, "", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "ssn: 123-45-6789", "no 123-45-6789", "9" * 4000, "a." * 3000 + "@", "a@" + "b." * 3000 + "c", "1 " * 3000]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, kind int, pii string")
    found = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), o, m.end()) for o, (k, p) in enumerate(BASE) for m in re.finditer(p, t or "") if valid(k, m.group()))
        want = [f"{BASE[o][0]}:{a}:{b}" for a, o, b in spans]
        assert found[i].base_sha256 == sha(",".join(want)), t
        assert [x for x in found[i].spans.split(",") if x.split(":")[0] in dict(BASE)] == want
        assert (found[i].n_email, found[i].n_ip, found[i].n_card, found[i].n_phone) == tuple(sum(o == k for _, o, _ in spans) for k in range(4))
    assert found[2].spans == "iban:0:27" and found[3].spans == "" and found[4].spans == "ssn:5:16" and found[5].spans == ""
    assert pii.find_pii(nothing).count() == 0


def test_ibans_before_capitals_and_digits(spark):
    ibans = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE89370400440532013000", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606", "MT84MALT011000012345MTLCAST001S"]
    behind = ["", " BIC COBADEFF", " Please pay", " 12 June", " A", ", X1", " GB82WEST12345698765432", " 1234 5678 9012 3456 7890"]
    texts = [(before, iban, after) for before in ("", "é IBAN ", "AT12 ", "MR12 ") for iban in ibans for after in behind]
    wrong = ["DE89370400440532013001 Please", "DE89370400440532013000X", "XDE89370400440532013000"]
    docs = spark.createDataFrame([(i, "".join(t)) for i, t in enumerate([*texts, *wrong])], "doc_id long, text string")
    spans = {r.doc_id: r.spans.split(",") for r in pii.find_pii(docs).select("doc_id", "spans").collect()}
    for i, (before, iban, after) in enumerate(texts):
        assert f"iban:{len(before)}:{len(before + iban)}" in spans[i], texts[i]
        assert sum(x.startswith("iban") for x in spans[i]) == 1 + ("GB82" in after), texts[i]
    assert not any("iban" in x for i in range(len(texts), len(docs.collect())) for x in spans[i])
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[1] == "[IBAN] BIC COBADEFF" and masked[len(behind) + 2] == "[IBAN] Please pay" and masked[2 * len(behind) + 3] == "[IBAN] 12 June"
    lengths = [c for codes in pii.IBAN_LENGTHS.values() for c in codes.split()]
    assert len(lengths) == len(set(lengths))


def test_masking(spark):
    docs = spark.createDataFrame([(1, "é write a.b@c.de, +1 (555) 555-1234!", 30, "x"), (2, None, None, "y"), (3, "plain", 5, "z")], "doc_id long, text string, n_chars long, pii string")
    rows = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert rows[1].text == "é write [EMAIL], [PHONE]!" and rows[1].n_chars == 25 and rows[2].text is None and rows[3].text == "plain"
    assert pii.mask(docs).columns == docs.columns and [rows[i].pii for i in (1, 2, 3)] == ["x", "y", "z"]
    assert pii.mask(docs.unionByName(docs)).count() == 6 and pii.mask(docs.limit(0)).count() == 0


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_anchors(text):
    """(position, hash) of the closed syncmers of a text, one k-mer after the other."""
    import regex
    import xxhash

    # white space as Java has it
    tokens = regex.findall(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]|[^ \t\n\x0b\f\r\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]{1,6}+", text)
    number = lambda x, seed: xxhash.xxh64_intdigest((x & ((1 << 64) - 1)).to_bytes(8, "little"), seed)
    h = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
    if 0 < len(h) < 5:
        seed = 42
        for t in tokens:
            seed = xxhash.xxh64_intdigest(t.encode(), seed)
        return [(0, seed & 0xFFFFFFFF)]
    smers = [number(y, number(x, 42)) for x, y in zip(h, h[1:])]
    out = []
    for i in range(len(h) - 4):
        own = [signed(x) for x in smers[i : i + 4]]
        if min(own[0], own[3]) <= min(own[1:3]):
            seed = 42
            for x in smers[i : i + 4]:
                seed = number(x, seed)
            out.append((i, seed & 0xFFFFFFFF))
    return out


def plain_text(found):
    return "".join(f"{((i - (found[k - 1][0] if k else 0)) << 32) + h:09X}" for k, (i, h) in enumerate(found))


def dice(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_fingerprints_equal_plain_syncmers(corpus, nothing, spark):
    docs, rows = corpus
    rng = random.Random(11)
    fresh = lambda n: "".join(rng.choice("abcdefghijklmnop   ") for _ in range(n))
    article = fresh(900)
    texts = [t or "" for _, t in sorted(dict(rows).items())] + [article[:k] for k in (239, 240, 249, 250, 399, 400, 401)] + [article, fresh(300), "한국어 텍스트 漢字かな abc", "a b c d", "a b c d e", "\u00a0x\u2003y z", "é" * 40]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, fp string, bucket string").repartition(3)
    found = {r.doc_id: r for r in fingerprint.fingerprints(frame).collect()}
    assert len(found) == len(texts)
    for k, t in enumerate(texts):
        after, n = texts[(k + 1) % len(texts)], len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        r, own, other, beyond = found[k], plain_anchors(t), plain_anchors(edited), plain_anchors(after)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), sha(edited), plain_text(own), plain_text(other)), t[:80]
        assert abs(r.near_edited - dice(own, other)) < 1e-9 and abs(r.near_next - dice(own, beyond)) < 1e-9
        assert abs(r.edited_in_place - (len(set(own) & set(other)) / len(own) if own else 1)) < 1e-9
        gaps = np.diff([i for i, _ in own])
        assert not len(gaps) or gaps.max() <= fingerprint.K - fingerprint.S
    near = [found[k].near_next for k in range(len(texts)) if texts[k] in [article[:x] for x in (239, 240, 249, 250, 399, 400)]]
    assert min(near) > 0.7  # beginnings of the next text, whatever their length
    assert fingerprint.fingerprints(nothing).count() == 0


def test_fingerprints_of_odd_ids(spark):
    rows = [(None, "one two three four five six seven"), (None, None), (4, "x" * 90), (4, "x" * 90), (4, "y"), (7, "")]
    found = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows) and sorted(str(r.doc_id) for r in found) == sorted(str(d) for d, _ in rows)
    assert len({r.fingerprint for r in found if r.n_chars == 90}) == 1


def test_anchors_that_moved(spark):
    words = [f"w{i}" for i in range(40)]
    a, b = " ".join(words), " ".join(["new", "words", "here", *words])
    frame = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.anchors(fingerprint.groups(F.col("a"))).alias("a"), fingerprint.anchors(fingerprint.groups(F.col("b"))).alias("b"))
    pairs = frame.select(fingerprint.moved(F.col("a"), F.col("b")).alias("m"), F.size("a").alias("n"), fingerprint.in_place(F.col("a"), F.col("b")).alias("p")).first()
    assert len(pairs.m) == pairs.n > 5 and {x.to - x.at for x in pairs.m} == {3} and pairs.p == 0


def test_fingerprint_plan_is_native(corpus):
    plan = fingerprint.fingerprints(corpus[0])._jdf.queryExecution().toString() + pii.find_pii(corpus[0])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_tokens_by_chunks_equal_the_tokenizer():
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(packing.tokenizer_path()), packing.ChunkEncoder(packing.tokenizer_path(), chunks=50)

    @settings(max_examples=150, deadline=None)
    @given(st.text(max_size=60))
    def check(text):
        text = text.encode("utf-8", "replace").decode()
        assert fast(text).tolist() == plain.encode(text, add_special_tokens=False).ids

    check()
    for text in ("it's I'M  \t\x1c b\x85c", "<|endoftext|> x<|startoftext|>", "a ̀ ̀b é", "İΣΑΣ Σ ß ﬁ 한국 어", "A" * 3000):
        assert fast(text).tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=120, deadline=None)
@given(st.integers(3, 40), st.data())
def test_packing_holds_every_piece(capacity, data):
    counts = [0, *data.draw(st.lists(st.sampled_from([0, 0, 1, 2, 3, 50]), min_size=capacity, max_size=capacity))]
    held, bins = [0] * (capacity + 1), 0
    for times, pattern in packing.solve(counts, capacity):
        assert times > 0 and sum(a * b for a, b in pattern) <= capacity
        bins += times
        for size, each in pattern:
            held[size] += times * each
    rooms: list[int] = []  # plain first fit, longest first
    for size in range(capacity, 0, -1):
        for _ in range(counts[size]):
            k = next((i for i, r in enumerate(rooms) if r >= size), None)
            if k is None:
                rooms.append(capacity)
                k = -1
            rooms[k] -= size
    assert held == counts and bins <= len(rooms) * 1.1 + 1


def test_packed_documents(corpus, nothing):
    from tokenizers import Tokenizer

    docs, rows = corpus
    plain = Tokenizer.from_file(packing.tokenizer_path())
    found = packing.pack_documents(docs).collect()
    want = sorted((d, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for d, t in rows for ids in [[*plain.encode(t or "", add_special_tokens=False).ids, 0]] for k, a in enumerate(range(0, len(ids), 2048)))
    assert sorted(tuple(r)[:5] for r in found) == want
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(w[3] for w in want) // 2048) + 2
    assert packing.pack_documents(nothing).count() == 0


@pytest.mark.parametrize(("module", "name", "column", "least"), [(quality, "score_quality", "quality", 0.97), (toxicity, "score_toxicity", "toxic", 0.97)])
def test_classifiers_on_held_out_rows(spark, module, name, column, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = getattr(module, name)(docs, labels).join(labels, "doc_id").where("held_out").select("doc_id", "score", "predicted", column).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in found)
    good, bad = ([r.score for r in found if r[column] == v] for v in (1, 0))
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > least and np.mean([r.predicted == r[column] for r in found]) > least


def test_classifiers_without_labels(corpus, nothing, spark):
    docs, rows = corpus
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        assert {r.score for r in score(docs, labels).collect()} == {0.5} and score(nothing, labels).count() == 0
    one = spark.createDataFrame([(d, 1, 1) for d, _ in rows], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in quality.score_quality(docs, one).collect()} == {1} and quality.keep_quality(docs, labels).columns == docs.columns
    assert quality.keep_quality(docs.withColumn("label", F.lit(1)), one).count() == len(rows)
