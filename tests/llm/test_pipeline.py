from __future__ import annotations

import corpus_pipeline
from strata.llm import decontaminate, neardup, packing, pii, quality

SF = "/root/testdata/sf0.001"


def test_pipeline_is_its_stages_in_turn(spark):
    """Each stage against what its operator says of the stage's own input, and run() against all in turn."""
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    docs = read("documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "private_data", "packing"]
    ids = lambda x: sorted(r.doc_id for r in x.select("doc_id").collect())

    good = stages["quality"](spark, docs, SF).persist()
    assert good.columns == columns and ids(good) == ids(quality.score_quality(docs, read("labels")).where("predicted = 1"))
    single = stages["near_duplicates"](spark, good, SF).persist()
    assert single.columns == columns and ids(single) == ids(neardup.near_duplicates(good, neardup.STAGE_SHARE).where("kept"))
    clean = stages["decontamination"](spark, single, SF).persist()
    assert clean.columns == columns and ids(clean) == ids(decontaminate.decontaminate(single, read("benchmark")).where("NOT contaminated"))
    masked = stages["private_data"](spark, clean, SF).persist()
    assert masked.columns == columns and ids(masked) == ids(clean)
    assert pii.find_pii(masked).selectExpr("sum(n_email + n_ip + n_card + n_phone)").first()[0] == 0
    packed = packing.pack_documents(masked)
    place = lambda x: sorted(tuple(r)[:5] for r in x.collect())
    assert place(corpus_pipeline.run(spark, SF)) == place(packed) and len(ids(docs)) > len(ids(clean)) > 0


def brute_stage(rows):
    """One row of each component of near duplicates at 0.8, by the least doc_id, then any; texts without words by themselves."""
    from tests.llm.test_dedup import words

    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)) or (not sets[i] and rows[i][0] == rows[j][0] and (rows[i][1] or "") == (rows[j][1] or "")):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return sorted(min((d is None, d or 0) for (d, _), x in zip(rows, label) if x == one) for one in set(label))


def test_stages_on_odd_rows(spark, corpus, nothing):
    """Nulls, empty and repeated rows, one id with two texts, and columns with clashing names."""
    docs, rows = corpus
    rows = [*rows, *rows[12:15], (None, rows[14][1]), (None, None), (None, "of no id at all"), (rows[20][0], "another text of this id"), (rows[20][0], "another text of this id")]
    schema = "doc_id long, text string, digest string, pii string, n string, label int, score string, predicted int, hits int, n_chars long"
    odd = spark.createDataFrame([(d, t, "d", "p", "n", 1, "s", 0, 3, len(t or "")) for d, t in rows], schema).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    single = stages["near_duplicates"](spark, odd, SF)
    assert single.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in single.collect()) == brute_stage(rows)
    for name in ("quality", "decontamination", "private_data"):
        out = stages[name](spark, odd, SF)
        assert out.columns == odd.columns and {(r.digest, r.pii, r.n, r.label, r.score, r.predicted, r.hits) for r in out.collect()} <= {("d", "p", "n", 1, "s", 0, 3)}, name
        assert name == "quality" or out.count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0, name
    packed = stages["packing"](spark, odd, SF)
    assert packed.select("doc_id", "start", "length").where("start = 0").count() == len(rows)
