"""Queries over entities, claims and relations: parts, orders and nations stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import lexical, values
from strata.operators import entities as E
from strata.plans.tables import read

# The fields that stand-in facts map to, with their kinds.
FIELDS = {"length": "m", "power": "W", "introduced": "date", "manufacturer": "text"}
RULES = {"Dimensions: Length": "length", "Power": "power", "Introduced": "introduced", "Maker": "manufacturer"}


def part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four facts for each part, in the spellings that sources use."""
    size = F.col("p_size").cast("string")
    power = (
        F.when(F.col("p_type") == "PROMO", F.concat(F.lit("up to "), size, F.lit(" kW")))
        .when(F.col("p_type") == "ECONOMY", F.concat(F.lit("about "), size, F.lit(" W")))
        .when(F.col("p_type") == "STANDARD", F.concat(size, F.lit(" - "), (F.col("p_size") + 5).cast("string"), F.lit(" MW")))
        .otherwise(F.concat(size, F.lit(" mw")))
    )
    year = (F.lit(1950) + F.col("p_size")).cast("string")
    when = F.when(F.col("p_size") < 20, year).when(F.col("p_size") < 40, F.concat(year, F.lit("-02"))).otherwise(F.concat(F.lit("March 5, "), year))
    fact = lambda name, raw: F.struct(F.lit(name).alias("name"), raw.alias("raw"))
    facts = F.array(fact("Dimensions: Length", F.concat(size, F.lit(" cm"))), fact("Power", power), fact("Introduced", when), fact("Maker", F.col("p_brand")))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.posexplode(facts).alias("position", "f"))
    none = F.lit(None).cast("string")
    return rows.select("entity", "position", "f.name", "f.raw", none.alias("unit"), none.alias("qualifier"))


def part_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES.items()), "name string, field string")
    return E.claims(part_facts(spark, sf_dir), rules, FIELDS)


_SQL = """
f AS (
  SELECT p_partkey AS entity, p_size AS s, p_type, p_brand,
    CASE p_type WHEN 'PROMO' THEN 'up to ' || p_size || ' kW' WHEN 'ECONOMY' THEN 'about ' || p_size || ' W' WHEN 'STANDARD' THEN p_size || ' - ' || (p_size + 5) || ' MW' ELSE p_size || ' mw' END AS praw,
    CASE WHEN p_size < 20 THEN '' || (1950 + p_size) WHEN p_size < 40 THEN (1950 + p_size) || '-02' ELSE 'March 5, ' || (1950 + p_size) END AS draw,
    make_date(1950 + p_size, CASE WHEN p_size < 20 THEN 1 WHEN p_size < 40 THEN 2 ELSE 3 END, CASE WHEN p_size < 40 THEN 1 ELSE 5 END) AS dmin,
    CASE WHEN p_size < 20 THEN make_date(1950 + p_size, 12, 31) WHEN p_size < 40 THEN last_day(make_date(1950 + p_size, 2, 1)) ELSE make_date(1950 + p_size, 3, 5) END AS dmax
  FROM part
)"""


def facts_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims with their parsed bounds."""
    c = part_claims(spark, sf_dir)
    return c.select("entity", "field", "raw", "status", F.col("text"), F.round("number.min", 6).alias("low"), F.round("number.max", 6).alias("high"), F.col("date.min").cast("string").alias("first_day"), F.col("date.max").cast("string").alias("last_day"))


FACTS_LOOKUP = f"""WITH {_SQL}
SELECT entity, 'length' AS field, s || ' cm' AS raw, 'known' AS status, NULL::VARCHAR AS text, round(s * 0.01, 6) AS low, round(s * 0.01, 6) AS high, NULL::VARCHAR AS first_day, NULL::VARCHAR AS last_day FROM f
UNION ALL SELECT entity, 'power', praw, CASE p_type WHEN 'ECONOMY' THEN 'approximate' WHEN 'PROMO' THEN 'known' WHEN 'STANDARD' THEN 'known' ELSE 'unparsed' END, NULL,
  CASE p_type WHEN 'ECONOMY' THEN s * 1.0 WHEN 'STANDARD' THEN s * 1e6 END, CASE p_type WHEN 'PROMO' THEN s * 1e3 WHEN 'ECONOMY' THEN s * 1.0 WHEN 'STANDARD' THEN (s + 5) * 1e6 END, NULL, NULL FROM f
UNION ALL SELECT entity, 'introduced', draw, 'known', NULL, NULL, NULL, dmin::VARCHAR, dmax::VARCHAR FROM f
UNION ALL SELECT entity, 'manufacturer', p_brand, 'known', p_brand, NULL, NULL, NULL, NULL FROM f"""


def claims_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several predicates: one claim a field has to satisfy all of its own."""
    entities = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), "p_name")
    return E.where(entities, part_claims(spark, sf_dir), ["length >= 10 cm", "length < 0.4 m", "power > 5 MW", "manufacturer != brand#1"], FIELDS)


CLAIMS_PREDICATE = """SELECT p_partkey AS entity, p_name FROM part WHERE p_size >= 10 AND p_size < 40 AND p_type = 'STANDARD' AND p_size > 5 AND lower(p_brand) <> 'brand#1'"""


def unknown_never_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """!= holds only for claims that are known and cannot be equal."""
    entities = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), "p_type")
    return E.where(entities, part_claims(spark, sf_dir), ["power != 7 kW"], FIELDS)


UNKNOWN_NEVER = "SELECT p_partkey AS entity, p_type FROM part WHERE (p_type = 'STANDARD') OR (p_type = 'PROMO' AND p_size < 7)"


def date_interval_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates are intervals: = asks for the same one, < for its end before the other's begin."""
    entities = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"))
    c = part_claims(spark, sf_dir).checkpoint()
    tests = {"same_month": "introduced = 1975-02", "before": "introduced < 1975-02-10", "from": "introduced >= 1960", "not_year": "introduced != 1980"}
    out = None
    for name, test in tests.items():
        found = E.where(entities, c, [test], FIELDS).select("entity", F.lit(name).alias("test"))
        out = found if out is None else out.unionByName(found)
    return out


DATE_INTERVAL = f"""WITH {_SQL}
SELECT entity, 'same_month' AS test FROM f WHERE dmin = DATE '1975-02-01' AND dmax = DATE '1975-02-28'
UNION ALL SELECT entity, 'before' FROM f WHERE dmax < DATE '1975-02-10'
UNION ALL SELECT entity, 'from' FROM f WHERE dmin >= DATE '1960-01-01'
UNION ALL SELECT entity, 'not_year' FROM f WHERE dmax < DATE '1980-01-01' OR dmin > DATE '1980-12-31'"""


def compare_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part by every field, with the number of claims and whether any is known."""
    entities = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"))
    fields = spark.createDataFrame([(f,) for f in [*FIELDS, "weight"]], "field string")
    grid = E.compare(entities, fields, part_claims(spark, sf_dir))
    return grid.select("entity", "field", F.size("claims").cast("long").alias("n"), F.exists("claims", lambda c: c["status"] == "known").alias("known"))


COMPARE_GRID = """SELECT p_partkey AS entity, field, CASE field WHEN 'weight' THEN 0 ELSE 1 END AS n,
  CASE field WHEN 'weight' THEN false WHEN 'power' THEN p_type IN ('PROMO', 'STANDARD') ELSE true END AS known
FROM part, (VALUES ('length'), ('power'), ('introduced'), ('manufacturer'), ('weight')) v(field)"""


def relation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at every nation and region, from either end."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    edges = nation.select(F.col("n_name").alias("source"), F.col("n_regionkey").alias("r_regionkey")).join(region, "r_regionkey").select("source", F.col("r_name").alias("target"), F.lit("component_of").alias("type"))
    nodes = nation.select(F.col("n_name").alias("node")).unionByName(region.select(F.col("r_name").alias("node")))
    return E.relations_of(edges, nodes, "component_of")


RELATION_LOOKUP = """WITH e AS (SELECT n_name AS s, r_name AS t FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT s AS node, t AS other, 'component_of' AS type, 'out' AS direction FROM e UNION ALL SELECT t, s, 'component_of', 'in' FROM e"""


def spec_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact specifications: each matched term of a query earns its share."""
    terms = values.specifications("Length: 12 cm; power: 12 - 17 MW; mass: 3 kg; Length: 0.12 m")
    wanted = spark.createDataFrame([(i, t[0], t[1], t[2], t[3]) for i, t in enumerate(terms)], "term int, label string, unit string, low double, high double")
    label = lexical.label_of(F.col("name"))
    c = part_claims(spark, sf_dir).where((F.col("status") == "known") & F.col("number").isNotNull()).withColumn("label", label)
    v = F.col("number")
    same = (F.col("number.unit") == F.col("unit")) & v["min_inclusive"] & v["max_inclusive"] & (values.compare(v["min"], F.col("low")) == 0) & (values.compare(v["max"], F.col("high")) == 0)
    hits = c.join(F.broadcast(wanted), "label").where(same).select("entity", "term").distinct()
    return hits.groupBy("entity").agg(F.round(F.count("*") / len(terms), 6).alias("bonus"), F.count("*").alias("terms"))


SPEC_BONUS = """SELECT p_partkey AS entity, round(n / 3.0, 6) AS bonus, n AS terms FROM (
  SELECT p_partkey, (p_size = 12)::INT + (p_size = 12 AND p_type = 'STANDARD')::INT AS n FROM part) WHERE n > 0"""


def list_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred parts of a kind by id, with the total."""
    rows = read(spark, sf_dir, "part").where("p_type = 'PROMO'")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("p_partkey").limit(100).crossJoin(F.broadcast(total)).select("p_partkey", "p_name", "total")


LIST_ENTITIES = "SELECT p_partkey, p_name, count(*) OVER () AS total FROM part WHERE p_type = 'PROMO' ORDER BY p_partkey LIMIT 100"


def list_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source", F.col("lang").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("text").alias("contents"))


LIST_FACETS = "SELECT source, lang AS kind, count(*) AS n, count(DISTINCT text) AS contents FROM documents GROUP BY ALL"


def default_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer the evidence that stands for it: an urgent order if there is one, else the least id."""
    rows = read(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderpriority").startswith("1").desc(), "o_orderkey")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("o_custkey", "o_orderkey", "o_orderpriority")


DEFAULT_EVIDENCE = "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY starts_with(o_orderpriority, '1') DESC, o_orderkey) = 1"


def category_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph world, region, nation, supplier by repeated joins."""
    region, nation, supplier = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = region.select(F.lit("world").alias("parent"), tag("r", "r_regionkey").alias("child"))
    edges = edges.unionByName(nation.select(tag("r", "n_regionkey").alias("parent"), tag("n", "n_nationkey").alias("child")))
    edges = edges.unionByName(supplier.select(tag("n", "s_nationkey").alias("parent"), tag("s", "s_suppkey").alias("child")))
    roots = spark.createDataFrame([("world",)], "node string")
    return E.tree_paths(edges, roots).select("node", "depth", F.array_join("path", "/").alias("path"))


CATEGORY_PATHS = """WITH RECURSIVE e AS (
  SELECT 'world' AS parent, 'r' || r_regionkey AS child FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
), t AS (SELECT 'world' AS node, 0 AS depth, 'world' AS path UNION ALL SELECT child, depth + 1, path || '/' || child FROM t JOIN e ON parent = node)
SELECT * FROM t"""

QUERIES = {
    "facts_lookup": (facts_lookup, FACTS_LOOKUP), "claims_predicate": (claims_predicate, CLAIMS_PREDICATE), "unknown_never_matches": (unknown_never_matches, UNKNOWN_NEVER),
    "date_interval_predicate": (date_interval_predicate, DATE_INTERVAL), "compare_grid": (compare_grid, COMPARE_GRID), "relation_lookup": (relation_lookup, RELATION_LOOKUP),
    "spec_bonus": (spec_bonus, SPEC_BONUS), "list_entities": (list_entities, LIST_ENTITIES), "list_facets": (list_facets, LIST_FACETS),
    "default_evidence": (default_evidence, DEFAULT_EVIDENCE), "category_paths": (category_paths, CATEGORY_PATHS),
}
