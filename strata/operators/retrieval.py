"""Lexical index, dense search, fusion, ranking and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.lexical import counted, is_name_token, one_edit, tokens_of
from strata.functions.urls import clamp, dot

K1, B, TYPO = 1.2, 0.75, 0.65
RANK_CONSTANT, LEXICAL_WEIGHT, SEMANTIC_WEIGHT = 60, 2.0, 1.0
#: Rows of a query-side table that may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000


def small(frame: DataFrame) -> DataFrame:
    """Broadcast a query-side table behind a count of it."""
    return F.broadcast(frame) if frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else frame


def postings(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, token, tf, length, squares, head): counted within each text, so nothing is shuffled; squares is the sum of
    its squared counts, head marks one row of each text.

    Only where there are fewer partitions than tasks can run at once are texts dealt anew.
    """
    kind = docs.schema[doc].dataType.simpleString()
    rows, tasks = docs.select(doc, text), docs.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < tasks:
        rows = rows.repartition(tasks)
    return rows.mapInArrow(counted, f"doc {kind}, token string, tf int, length int, squares long, head boolean")


def sizes(post: DataFrame) -> DataFrame:
    """(n, average) of the texts of an index: one row, from one posting of each."""
    return post.where("head").agg(F.count("*").alias("n"), F.avg("length").alias("average"))


def term_stats(post: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(token, df, idf) over the whole corpus: filters never change them.  ``tokens``: those that are asked for."""
    own = post.select("token") if tokens is None else post.select("token").join(small(tokens.select("token").distinct()), "token")
    df = own.groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(sizes(post).select("n"))).select("token", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def query_terms(queries: DataFrame, query: str = "query", text: str = "text") -> DataFrame:
    """(query, term): the terms of a query are a set."""
    return queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(tokens_of(F.col(text)))).alias("term"))


def spellings(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(term, token, fuzzy): each term itself, and name tokens one edit away.  Blocks on length, then tests."""
    exact = terms.select("term").distinct()
    blocks = exact.where(is_name_token(F.col("term"))).select("term", F.explode(F.array(*[F.char_length("term") + d for d in (-1, 0, 1)])).alias("n"))
    pool = names.select("token").distinct().where(is_name_token(F.col("token"))).withColumn("n", F.char_length("token"))
    near = blocks.join(pool, "n").where((F.col("term") != F.col("token")) & one_edit(F.col("term"), F.col("token")))
    return exact.select("term", F.col("term").alias("token"), F.lit(False).alias("fuzzy")).unionByName(near.select("term", "token", F.lit(True).alias("fuzzy")))


def _weight() -> Column:
    """BM25 of a posting: its tf and length, the corpus' idf and average."""
    return F.col("idf") * (K1 + 1) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))


def scores(post: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, doc, bm25, cosine) of all documents that share a term with a query: one join and one aggregate of the
    postings for both.  ``queries``: postings of the queries (query, token, tf, squares); the cosine is that of counts."""
    wanted = queries.select("query", "token", F.col("tf").alias("q_tf"), F.col("squares").alias("q_squares"))
    wanted = wanted.join(term_stats(post, wanted), "token").crossJoin(F.broadcast(sizes(post).select("average"))).checkpoint()
    cosine = F.sum(F.col("tf") * F.col("q_tf")) / (F.sqrt(F.first("q_squares")) * F.sqrt(F.first("squares")))
    hits = post.join(small(wanted), "token").groupBy("query", "doc")
    return hits.agg(F.round(F.sum(_weight()), 6).alias("bm25"), F.round(cosine, 6).alias("cosine"))


def bm25(post: DataFrame, terms: DataFrame, fuzzy: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, terms, typo) of all documents with a term of the query.

    ``fuzzy``: spellings; a misspelt name token only counts in documents of
    ``names``, at 0.65, and only where the exact one is absent.
    """
    weight = _weight()
    wanted = terms if fuzzy is None else terms.join(fuzzy, "term")
    if fuzzy is None:
        wanted = wanted.select("query", "term", F.col("term").alias("token"), F.lit(False).alias("fuzzy"))
    # statistics go to the query's side, once, and that is counted and joined as it is stored: postings are read for them and for the hits
    wanted = wanted.join(term_stats(post, wanted), "token").crossJoin(F.broadcast(sizes(post).select("average"))).checkpoint()
    hits = post.join(small(wanted), "token")
    hits = hits.select("query", "term", "token", "doc", "fuzzy", (weight * F.when(F.col("fuzzy"), TYPO).otherwise(1.0)).alias("score"))
    if fuzzy is not None:
        if names is not None:
            hits = hits.join(names.select("doc", F.lit(True).alias("named")).distinct(), "doc", "left").where(~F.col("fuzzy") | F.col("named")).drop("named")
        best = F.max_by(F.struct("score", "token", "fuzzy"), F.struct((~F.col("fuzzy")).alias("exact"), F.col("score"), F.col("token")))
        hits = hits.groupBy("query", "term", "doc").agg(best.alias("b")).select("query", "doc", "b.*")
    return hits.groupBy("query", "doc").agg(F.sum("score").alias("score"), F.array_sort(F.collect_set("token")).alias("terms"), F.max("fuzzy").alias("typo"))


def ranked(rows: DataFrame, by: str, *order: Column, to: str = "rank") -> DataFrame:
    return rows.withColumn(to, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def top(rows: DataFrame, k: int, by: str, *order: Column) -> DataFrame:
    """The first k of each group; Spark drops the rest of a group before the shuffle."""
    return ranked(rows, by, *order).where(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, keep: Column | None = None) -> DataFrame:
    """Exact search: all vectors against the broadcast query vectors (query, q); vectors has id, v."""
    pairs = vectors.join(F.broadcast(queries), keep if keep is not None else F.lit(True))
    return pairs.withColumn("cosine", dot(F.col("v"), F.col("q"))).drop("v", "q")


def best_view(hits: DataFrame, *entity: str, order: tuple[Column, ...]) -> DataFrame:
    """Of each entity its best view: maximum, never sum."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*entity).orderBy(*order))).where("_n = 1").drop("_n")


def fuse(semantic: DataFrame, lexical: DataFrame, constant: int = RANK_CONSTANT, w_s: float = SEMANTIC_WEIGHT, w_l: float = LEXICAL_WEIGHT, outer: bool = False) -> DataFrame:
    """Weighted reciprocal ranks.  Inputs: query, doc, score.  Semantic ranks cover the whole pool and lexical
    ranks count only hits in it, unless ``outer``: then either may lack a document."""
    order = (F.col("score").desc(), F.col("doc"))
    left = ranked(semantic, "query", *order, to="semantic_rank").select("query", "doc", F.col("score").alias("cosine"), "semantic_rank")
    if not outer:
        lexical = lexical.join(left.select("query", "doc"), ["query", "doc"], "left_semi")
    right = ranked(lexical, "query", *order, to="lexical_rank").select("query", "doc", "lexical_rank")
    share = lambda w, r: F.coalesce(w / (constant + F.col(r)), F.lit(0.0))
    return left.join(right, ["query", "doc"], "full_outer" if outer else "left").withColumn("score", share(w_s, "semantic_rank") + share(w_l, "lexical_rank"))


def fuse_scores(rows: DataFrame, constant: int = RANK_CONSTANT, w_s: float = SEMANTIC_WEIGHT, w_l: float = LEXICAL_WEIGHT) -> DataFrame:
    """The same of one frame (query, doc, cosine, bm25) that holds the pool; bm25 is null where no term was found."""
    place = lambda by: F.row_number().over(Window.partitionBy("query").orderBy(F.col(by).desc_nulls_last(), "doc"))
    rows = rows.withColumn("semantic_rank", place("cosine")).withColumn("lexical_rank", F.when(F.col("bm25").isNotNull(), place("bm25")))
    return rows.withColumn("score", w_s / (constant + F.col("semantic_rank")) + F.coalesce(w_l / (constant + F.col("lexical_rank")), F.lit(0.0)))


def with_name_override(rows: DataFrame, matched: Column) -> DataFrame:
    """A name match comes first, at 2 and the cosine."""
    return rows.withColumn("name_match", matched).withColumn("score", F.when(F.col("name_match"), 2 + clamp(F.col("cosine"))).otherwise(F.col("score")))


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page with total and has_more.

    Only the rows up to the page's end are ranked in one place (as a bounded
    top-k); the total is counted apart.
    """
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page from 1, size 1 to 100")
    total = rows.agg(F.count("*").alias("total"))
    head = rows.orderBy(*order).limit(number * size)
    placed = head.withColumn("position", F.row_number().over(Window.orderBy(*order))).where(F.col("position") > (number - 1) * size)
    return placed.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > number * size)
