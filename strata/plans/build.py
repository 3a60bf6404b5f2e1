"""Queries of the dataset builder: pages, conversations and embeddings stand in for captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import urls
from strata.operators import entities as E
from strata.operators import media as M
from strata.operators.chunks import windows
from strata.plans.tables import read


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", urls.normal(u).alias("normal"), urls.without_tracking(u).alias("plain"), urls.origin(u).alias("origin"), urls.identity(u).alias("id"))


_PLAIN = r"regexp_replace(url, '#.*$', '')"
_QUERY = rf"array_to_string(list_filter(string_split(regexp_extract({_PLAIN}, '\?(.*)$', 1), '&'), lambda p: p <> '' AND regexp_replace(p, '=.*$', '') NOT IN ('utm_source', 'utm_medium', 'utm_campaign')), '&')"
URL_NORMALIZE = rf"""SELECT page_id, 'https://' || lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || CASE WHEN regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1) = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1), '/{{2,}}', '/', 'g') END AS normal,
  regexp_replace({_PLAIN}, '\?.*$', '') || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END AS plain,
  regexp_extract(url, '^(https?)://', 1) || '://' || lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || CASE WHEN starts_with(url, 'https') THEN ':443' ELSE ':80' END AS origin,
  substr(sha256(url), 1, 24) AS id FROM pages"""


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of 192 words, 144 apart, over whole documents."""
    rows = windows(read(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("words").cast("long").alias("n"), F.sha2(F.array_join("words", " "), 256).alias("sha256"))


CHUNK_WINDOWS = r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, greatest(CEIL((len(w) - 192) / 144.0)::BIGINT, 0) + 1)) AS chunk FROM w WHERE len(w) > 0)
SELECT doc_id, chunk, len(w[chunk * 144 + 1 : chunk * 144 + 192]) AS n, sha256(array_to_string(w[chunk * 144 + 1 : chunk * 144 + 192], ' ')) AS sha256 FROM c"""


def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of a part become one entity; suppliers are aliases, return flags categories."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"), F.col("p_type").alias("kind"), F.array(F.col("l_suppkey").cast("string")).alias("aliases"), F.array("l_returnflag", "l_linestatus").alias("categories"))
    return E.merge_entities(rows).select("key", "title", "kind", "conflict", F.array_join("aliases", ",").alias("aliases"), F.array_join("categories", ",").alias("categories"), "n")


ENTITY_MERGE = """SELECT p_partkey AS key, any_value(p_name) AS title, any_value(p_type) AS kind, false AS conflict, array_to_string(list_sort(list_distinct(list(l_suppkey::VARCHAR))), ',') AS aliases,
  array_to_string(list_sort(list_distinct(flatten(list([l_returnflag, l_linestatus])))), ',') AS categories, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey"""


def labels_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names under which each user is known: event types."""
    return E.union_names(read(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", F.array_join("names", ",").alias("names"))


LABELS_UNION = "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS names FROM events GROUP BY user_id"


def shared_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose events do not all carry the same type."""
    return E.consistent(read(spark, sf_dir, "events"), "user_id", "event_type")


SHARED_EVIDENCE = "SELECT user_id, count(DISTINCT event_type) AS versions FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1"


def coverage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State counts of each user, and an outcome by the first that applies."""
    states = ["click", "error", "purchase", "signup", "view"]
    rows = read(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", states).count().na.fill(0)
    outcome = F.when(F.col("purchase") > 0, "complete").when(F.col("error") > F.col("view"), "failing").otherwise("partial")
    return rows.select("user_id", *states, outcome.alias("outcome"))


COVERAGE_PIVOT = """SELECT *, CASE WHEN purchase > 0 THEN 'complete' WHEN error > "view" THEN 'failing' ELSE 'partial' END AS outcome FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
  count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS "view" FROM events GROUP BY user_id)"""


def media_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size extremes, small and distinct contents of pages by host."""
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    size = F.char_length("html")
    return read(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.min(size).cast("long").alias("least"), F.max(size).cast("long").alias("most"), F.count_if(size < 2000).alias("small"), F.count_distinct("html").alias("contents"), F.count_if(F.col("html").contains("<img")).alias("with_images"))


MEDIA_QUALITY = "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, min(length(html)) AS least, max(length(html)) AS most, count(*) FILTER (length(html) < 2000) AS small, count(DISTINCT html) AS contents, count(*) FILTER (contains(html, '<img')) AS with_images FROM pages GROUP BY 1"


def exact_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.exact_duplicates(read(spark, sf_dir, "documents"), "text", "doc_id")


EXACT_DUP = "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1"


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign bits of the embeddings: a 64-bit perceptual hash."""
    bits = F.transform("embedding", lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    whole = F.aggregate(bits, F.expr("0L"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), whole.alias("hash"))


def near_dup_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.near_duplicates(_hashes(spark, sf_dir)).select("left", "right", F.col("distance").cast("long").alias("distance"))


_SQL_BITS = "h AS (SELECT min(vec_id) AS id, b FROM (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS b FROM embeddings) GROUP BY b)"
_SQL_NEAR = "SELECT a.id AS \"left\", b.id AS \"right\", list_sum(list_transform(list_zip(a.b, b.b), lambda z: (z[1] <> z[2])::INT))::BIGINT AS distance FROM h a JOIN h b ON a.id < b.id"
NEAR_DUP = f"WITH {_SQL_BITS} SELECT * FROM ({_SQL_NEAR}) WHERE distance <= 5"


def families_cc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers of one nation are a family: stars joined into components."""
    s = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("left"), F.col("s_nationkey").cast("long").alias("right"))
    c = read(spark, sf_dir, "customer").select((F.col("c_custkey") + 2_000_000_000).alias("left"), F.col("c_nationkey").cast("long").alias("right"))
    return M.families(s.unionByName(c))


FAMILIES_CC = """SELECT s_suppkey + 1000000000 AS node, s_nationkey::BIGINT AS family FROM supplier UNION ALL SELECT c_custkey + 2000000000, c_nationkey FROM customer
UNION ALL SELECT DISTINCT n, n FROM (SELECT s_nationkey::BIGINT AS n FROM supplier UNION ALL SELECT c_nationkey FROM customer)"""


def caption_min_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct captions of each conversation's speakers with the first turn that has them."""
    text = F.trim(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " "))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "role", F.sha2(text, 256).alias("caption"), "turn").where(text != "")
    return rows.groupBy("conv_id", "role", "caption").agg(F.min("turn").alias("turn"))


CAPTION_MIN = r"SELECT conv_id, role, sha256(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS caption, min(turn) AS turn FROM conversations WHERE trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) <> '' GROUP BY ALL"


def embed_cache_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose text has no cached vector, each text once: documents are the cache."""
    key = F.sha2(F.concat(F.lit("model\n"), F.col("text")), 256).alias("key")
    cache = read(spark, sf_dir, "documents").select(key)
    wanted = read(spark, sf_dir, "conversations").select(key, "conv_id")
    return E.first_occurrence(wanted, "key", "conv_id").join(cache, "key", "left_anti")


EMBED_CACHE = r"SELECT sha256('model' || chr(10) || text) AS key, min(conv_id) AS conv_id FROM conversations WHERE text NOT IN (SELECT text FROM documents) GROUP BY 1"


def state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, as the state that it leaves."""
    rows = E.latest(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", F.col("ts"), F.col("event_id"))
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "saved").otherwise("pending")
    return rows.select("user_id", "event_id", "event_type", state.alias("state"))


STATE_LATEST = "SELECT user_id, event_id, event_type, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'saved' ELSE 'pending' END AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of saved pages that no page has been fetched for, each once."""
    pages = read(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    links = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1)).alias("path"), host.alias("host"))
    wanted = links.select(F.concat("host", "path").alias("url")).distinct()
    return wanted.join(pages.select("url"), "url", "left_anti")


FRONTIER = """SELECT DISTINCT host || path AS url FROM (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS path FROM pages) WHERE host || path NOT IN (SELECT url FROM pages)"""


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a later state: open ones closed, small ones gone, one price changed by rounding."""
    before = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = before.where("o_totalprice >= 10000").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "F").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.floor("o_totalprice").cast("double").alias("o_totalprice"))
    return E.reconcile(before, after, "o_orderkey", ["o_orderstatus", "o_totalprice"]).select("o_orderkey", "state", F.array_join("fields", ",").alias("fields"))


SNAPSHOT_DIFF = """SELECT o_orderkey, CASE WHEN o_totalprice < 10000 THEN 'missing' WHEN f = '' THEN 'matched' ELSE 'changed' END AS state, CASE WHEN o_totalprice < 10000 THEN '' ELSE f END AS fields FROM (
  SELECT *, concat_ws(',', CASE WHEN o_orderstatus = 'O' THEN 'o_orderstatus' END, CASE WHEN floor(o_totalprice) <> o_totalprice THEN 'o_totalprice' END) AS f FROM orders)"""


def symmetric_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that have suppliers but no customers, and the other way."""
    return E.same_sets(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")).distinct(), read(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("nation")).distinct())


SYMMETRIC = """WITH s AS (SELECT DISTINCT s_nationkey AS nation FROM supplier), c AS (SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_acctbal > 9900)
SELECT nation, 'left' AS side FROM (FROM s EXCEPT FROM c) UNION ALL SELECT nation, 'right' FROM (FROM c EXCEPT FROM s)"""


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a fair order over their sources."""
    rows = E.fair_order(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", F.col("doc_id"))
    return rows.select("doc_id", "source", F.col("turn").cast("long").alias("turn"))


ROUND_ROBIN = "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents"


def best_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each brand and type the largest part, then the dearest, then the least id."""
    w = Window.partitionBy("p_brand", "p_type").orderBy(F.col("p_size").desc(), F.col("p_retailprice").desc(), "p_partkey")
    return read(spark, sf_dir, "part").withColumn("n", F.row_number().over(w)).where("n = 1").select("p_brand", "p_type", "p_partkey")


BEST_REPRESENTATIVE = "SELECT p_brand, p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_retailprice DESC, p_partkey) = 1"


def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without markdown, by digest and length."""
    text = urls.plain_text(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("sha256"), F.char_length(text).cast("long").alias("n"))


_PT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), 'https?://[^ \t\n\x0B\f\r]+', '', 'g'), '<[^>]*>', ' ', 'g'), '[#*_`|]', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
PLAIN_TEXT = f"SELECT doc_id, sha256({_PT}) AS sha256, length({_PT}) AS n FROM documents"


def diverse_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight views of each label, farthest first."""
    return M.farthest_first(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, headings, visible text and images of every page."""
    from strata.sources.html import extract

    return extract(read(spark, sf_dir, "pages"), "page_id", "url", "html")


QUERIES = {
    "url_normalize": (url_normalize, URL_NORMALIZE), "chunk_windows": (chunk_windows, CHUNK_WINDOWS), "entity_merge": (entity_merge, ENTITY_MERGE), "labels_union": (labels_union, LABELS_UNION),
    "shared_evidence": (shared_evidence, SHARED_EVIDENCE), "coverage_pivot": (coverage_pivot, COVERAGE_PIVOT), "media_quality": (media_quality, MEDIA_QUALITY), "exact_dup": (exact_dup, EXACT_DUP),
    "near_dup_hamming": (near_dup_hamming, NEAR_DUP), "families_cc": (families_cc, FAMILIES_CC), "caption_min_media": (caption_min_media, CAPTION_MIN),
    "embed_cache_antijoin": (embed_cache_antijoin, EMBED_CACHE), "state_latest": (state_latest, STATE_LATEST), "frontier": (frontier, FRONTIER), "snapshot_diff": (snapshot_diff, SNAPSHOT_DIFF),
    "symmetric_coverage": (symmetric_coverage, SYMMETRIC), "round_robin": (round_robin, ROUND_ROBIN), "best_representative": (best_representative, BEST_REPRESENTATIVE),
    "plain_text": (plain_text, PLAIN_TEXT), "diverse_views": (diverse_views, None), "page_articles": (page_articles, None),
}
