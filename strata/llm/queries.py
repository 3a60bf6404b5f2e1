"""The registered queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm import decontaminate, fingerprint, neardup, packing, passages, pii, quality, suffix, toxicity, warc

_OPERATORS = (warc.op1_warc, suffix.op2_suffix_dedup, neardup.op3_near_duplicates, passages.op4_repeated_passages, fingerprint.op5_fingerprints, pii.op7_pii, toxicity.op8_toxicity, quality.op9_quality_classifier, decontaminate.op6_decontamination, packing.op10_best_fit_packing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


OP1 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), o AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS original FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM o
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
k AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS k, doc_id, s FROM s),
n AS (SELECT k, min(doc_id) AS rep, any_value(s) AS s, any_value(len(s)) AS size FROM k GROUP BY k),
x AS (SELECT rep, size, unnest(s) AS x FROM n),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.size, b.size HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
c AS (SELECT rep AS node, rep AS root FROM n UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node WHERE c.root < e.b),
l AS (SELECT node, min(root) AS root FROM c GROUP BY node)
SELECT w.doc_id, coalesce(len(k.s), 0) AS n_shingles, coalesce(l.root, w.doc_id) AS component_id, w.doc_id = coalesce(l.root, w.doc_id) AS kept
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN n ON n.k = k.k LEFT JOIN l ON l.node = n.rep
"""

OP6 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM w, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, s, n, item_id FROM dw JOIN iw USING (n, win)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
u AS (SELECT item_id, n, w[s : s + n - 1] AS win, row_number() OVER () AS k FROM (SELECT DISTINCT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
ut AS (SELECT k, len(list_distinct(win)) AS terms, unnest(list_distinct(win)) AS term FROM u),
has AS (SELECT doc_id, k FROM (SELECT doc_id, unnest(list_distinct(w)) AS term FROM w) JOIN ut USING (term) GROUP BY doc_id, k, terms HAVING count(*) = terms),
r AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM has JOIN u USING (k) JOIN w USING (doc_id)
  WHERE len(list_filter(range(1, len(w) + 1), lambda a: list_has_all(w[a : a + 2 * n - 1], win))) > 0 GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM h GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN r USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op3_near_duplicates": OP3, "op6_decontamination": OP6}
