from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strata.sources import bundle, formats
from strata.sources import html as H

PAGE = """<html><head><title>A &amp; b</title><meta name="robots" content="NOINDEX"><script>var x = "</p>";</script></head><body><nav><a href="/n">menu</a><img src="/logo.png"></nav>
<h1>Head</h1><p>One <b>two<p>three<br>four<h2>Part</h2><figure><img data-src="p.jpg" alt="x"><figcaption>The  caption</figcaption></figure><img srcset="a.jpg 1x, b.jpg 2x"><footer>end</footer></body></html>"""


def test_article():
    a = H.article("https://x.org/d/", PAGE)
    assert a["title"] == "A & b" and a["heading"] == "Head" and a["noindex"] and a["links"] == ["https://x.org/n"]
    assert a["text"] == "Head\nOne two\nthree\nfour\nPart\nThe caption"
    assert [(i["url"], i["layout"], i["caption"], i["section"]) for i in a["images"]] == [
        ("https://x.org/logo.png", True, None, None), ("https://x.org/d/p.jpg", False, "The caption", "Part"), ("https://x.org/d/b.jpg", False, None, "Part")
    ]
    assert H.article(None, None)["text"] == ""


def test_feeds_and_maps(spark):
    one = lambda body: spark.createDataFrame([("u", body)], "page string, body string")
    site = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a/1</loc></url><url><loc>https://a/2</loc></url></urlset>'
    assert [r.url for r in formats.sitemap_urls(one(site)).collect()] == ["https://a/1", "https://a/2"]
    rss = "<rss><channel><item><title>T</title><link>L</link></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link href="H"/></entry></feed>'
    assert [tuple(r)[1:] for r in formats.feed_entries(one(rss)).collect()] == [("L", "T")]
    assert [tuple(r)[1:] for r in formats.feed_entries(one(atom)).collect()] == [("H", "E")]
    geo = '{"features":[{"properties":{"name":"P"},"geometry":{"type":"Point","coordinates":[5.5,10]}},{"properties":{"name":"L"},"geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]}}]}'
    assert [tuple(r) for r in formats.geo_points(one(geo)).collect()] == [("u", "P", 5.5, 10.0)]
    wiki = '{"query":{"categorymembers":[{"pageid":1,"ns":0,"title":"A"},{"pageid":2,"ns":14,"title":"B"}]},"continue":{"cmcontinue":"x"}}'
    assert [tuple(r) for r in formats.category_members(one(wiki)).collect()] == [("u", "A", 0, "x"), ("u", "B", 14, "x")]


def test_paged_records(spark):
    pages = spark.createDataFrame([('{"total":3,"offset":0,"records":["{\\"a\\":1}","{\\"a\\":2}"]}',), ('{"total":3,"offset":2,"records":["{\\"a\\":3}"]}',)], "body string")
    rows, wrong = formats.paged_records(pages)
    assert sorted(r.position for r in rows.collect()) == [0, 1, 2] and wrong.isEmpty()
    assert not formats.paged_records(pages.limit(1))[1].isEmpty()


def test_tables_and_facts(spark):
    page = "<h2>Size</h2><a id='v1'></a><table><tr><th>Length:</th><td>5 m</td></tr><tr><td>Empty</td><td></td></tr></table><table><tr><th></th><th>A</th><th>B</th></tr><tr><td>Mass</td><td>1</td><td>2</td></tr></table><!-- open"
    assert [(f["name"], f["raw"]) for f in formats.table_facts(page)] == [("Size: Length", "5 m"), ("Mass: A", "1"), ("Mass: B", "2")]
    assert formats.facts_of(spark.createDataFrame([(1, page), (2, None)], "i int, h string"), "i", "h").count() == 3
    listing = '<script type="application/ld+json">{"itemListElement":[{"name":"A","url":"u"},{"item":{"name":"B","url":"v"}}]}</script>'
    rows = spark.createDataFrame([(listing,)], "h string").select(F.explode(formats.linked_items(F.col("h"))).alias("i")).select("i.*")
    assert [tuple(r) for r in rows.collect()] == [("A", "u"), ("B", "v")]
    other = spark.createDataFrame([("A",), ("C",)], "name string")
    assert sorted(tuple(r) for r in formats.reconciled(rows, other, "name").collect()) == [("B", "left"), ("C", "right")]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("5 km", ([5.0], "km", None)), ("3-5 GHz", ([3.0, 5.0], "GHz", None)), ("1,5 m", ([1.5], "m", None)), ("1,500 m (max)", ([1500.0], "m", "max")), ("12", ([12.0], None, None)), ("about", None)],
)
def test_quantity(raw, want):
    found = formats.quantity(raw)
    assert (found and (found["values"], found["unit"], found["qualifier"])) == want


def test_mentions_and_values(spark):
    blocks = spark.createDataFrame([(1, "The T-72 and t-72b."), (2, "xT-72")], "b int, text string")
    aliases = spark.createDataFrame([("e", "T-72"), ("f", "T-72B")], "entity string, alias string")
    assert sorted((r.b, r.entity) for r in formats.mentions(blocks, aliases).collect()) == [(1, "e"), (1, "f")]
    rows = spark.createDataFrame([("a, b,1,500 x,,",)], "r string")
    assert rows.select(formats.split_values(F.col("r"))).first()[0] == ["a", "b", "1,500 x"]
    assert formats.flattened('{"A":{"B":[{"p":1},{"q":null}]}}') == [("A / B / p", "1")]


def test_snapshot(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 9), (2, "b", 9)], "i int, s string, seen int")
    first = bundle.write_snapshot(spark, f"file://{tmp_path}/s", {"t": rows}, volatile=("seen",))
    again = bundle.write_snapshot(spark, f"file://{tmp_path}/s", {"t": rows.withColumn("seen", F.lit(1)).orderBy(F.desc("i"))}, volatile=("seen",))
    assert first == again and bundle.verify(spark, f"file://{tmp_path}/s") == []
    new = bundle.write_snapshot(spark, f"file://{tmp_path}/s", {"t": rows.where("i = 1")}, volatile=("seen",))
    assert new["id"] != first["id"] and bundle.read_snapshot(spark, f"file://{tmp_path}/s", "t").count() == 1
    with pytest.raises(ValueError):
        bundle.check_shrink(100, 80)
