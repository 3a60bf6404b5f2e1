"""Feeds, sitemaps, API responses and tables, as rows.

What a capture holds is parsed where it lies; nothing is fetched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.values import NUMBER


def sitemap_urls(pages: DataFrame, body: str = "body") -> DataFrame:
    """(page columns, url) of XML sitemaps; namespaces do not matter."""
    path = "//*[local-name()='loc']/text()"
    return pages.withColumn("url", F.explode(F.expr(f'xpath({body}, "{path}")'))).drop(body)


def feed_entries(pages: DataFrame, body: str = "body") -> DataFrame:
    """(page columns, link, title) of RSS items and Atom entries."""
    x = lambda p: F.expr(f'xpath({body}, "{p}")')
    rss = F.arrays_zip(x("//item/link/text()").alias("link"), x("//item/title/text()").alias("title"))
    atom = F.arrays_zip(x("//*[local-name()='entry']/*[local-name()='link']/@href").alias("link"), x("//*[local-name()='entry']/*[local-name()='title']/text()").alias("title"))
    return pages.withColumn("e", F.explode(F.concat(rss, atom))).select(*[c for c in pages.columns if c != body], "e.link", "e.title")


def geo_points(pages: DataFrame, body: str = "body") -> DataFrame:
    """(page columns, name, longitude, latitude) of a feature collection's points; lines are overlays and give none."""
    kind = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    found = pages.withColumn("f", F.explode(F.from_json(body, kind)["features"])).where("f.geometry.type = 'Point'")
    at = F.from_json("f.geometry.coordinates", "array<double>")
    keep = [c for c in pages.columns if c != body]
    return found.select(*keep, F.col("f.properties")["name"].alias("name"), at[0].alias("longitude"), at[1].alias("latitude")).where("longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90")


def category_members(pages: DataFrame, body: str = "body") -> DataFrame:
    """(page columns, title, ns, more) of a wiki API's category listing; more: where the listing goes on."""
    kind = "query struct<categorymembers:array<struct<pageid:bigint,ns:int,title:string>>>, `continue` struct<cmcontinue:string>"
    found = pages.withColumn("r", F.from_json(body, kind))
    keep = [c for c in pages.columns if c != body]
    return found.select(*keep, F.explode("r.query.categorymembers").alias("m"), F.col("r.continue.cmcontinue").alias("more")).select(*keep, "m.title", "m.ns", "more")


def paged_records(pages: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(page columns, position, record) of a paged API's responses {total, offset, records}, and the pages that
    disagree: another total, or records that are not all there."""
    kind = "total bigint, offset bigint, records array<string>"
    found = pages.withColumn("r", F.from_json(body, kind))
    keep = [c for c in pages.columns if c != body]
    rows = found.select(*keep, F.posexplode("r.records").alias("at", "record"), F.col("r.offset").alias("offset")).select(*keep, (F.col("offset") + F.col("at")).alias("position"), "record")
    totals = found.agg(F.min("r.total").alias("low"), F.max("r.total").alias("high"), F.sum(F.size("r.records")).alias("n"))
    return rows, totals.where("low <> high OR n <> high")


def linked_items(html: Column) -> Column:
    """array<struct<name,url>> of the JSON-LD item lists in a page."""
    scripts = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    item = "itemListElement array<struct<item:struct<name:string,url:string>,name:string,url:string>>"
    lists = F.transform(scripts, lambda s: F.from_json(s, item)["itemListElement"])
    flat = F.flatten(F.filter(lists, lambda x: x.isNotNull()))
    return F.transform(flat, lambda e: F.struct(F.coalesce(e["name"], e["item"]["name"]).alias("name"), F.coalesce(e["url"], e["item"]["url"]).alias("url")))


def reconciled(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two listings has, with the side; empty where they agree."""
    a, b = left.select(key, F.lit(True).alias("l")).distinct(), right.select(key, F.lit(True).alias("r")).distinct()
    return a.join(b, key, "full_outer").where("l IS NULL OR r IS NULL").select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


class _Tables(HTMLParser):
    """Tables as rows of cells, with the heading above and anchors inside."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.table, self.section, self.anchor = -1, "", None
        self._row: list[tuple[str, bool]] | None = None
        self._cell: list[str] | None = None
        self._is_head = False
        self._heading: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if a.get("id") or a.get("name"):
            self.anchor = a.get("id") or a.get("name")
        if tag == "table":
            self.table += 1
        elif tag == "tr":
            self._row = []
        elif tag in ("td", "th") and self._row is not None:
            self._end_cell()
            self._cell, self._is_head = [], tag == "th"
        elif tag in ("h2", "h3", "h4", "caption"):
            self._heading = []

    def _end_cell(self) -> None:
        if self._cell is not None and self._row is not None:
            self._row.append((" ".join("".join(self._cell).split()), self._is_head))
        self._cell = None

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self._end_cell()
        elif tag in ("tr", "table") and self._row is not None:
            self._end_cell()
            if self._row:
                self.rows.append({"table": self.table, "section": self.section, "anchor": self.anchor, "cells": [c for c, _ in self._row], "head": all(h for _, h in self._row)})
            self._row = None
        elif tag in ("h2", "h3", "h4", "caption") and self._heading is not None:
            self.section = " ".join("".join(self._heading).split())
            self._heading = None

    def handle_data(self, data: str) -> None:
        for held in (self._cell, self._heading):
            if held is not None:
                held.append(data)


def table_rows(html: str | None) -> list[dict]:
    parser = _Tables()
    parser.feed(re.sub(r"<!--.*?(?:-->|$)", "", html or "", flags=re.S))  # comments may be left open
    parser.close()
    return parser.rows


def table_facts(html: str | None) -> list[dict]:
    """Facts of two-column rows ('Section: Label' and its value) and of header rows over value rows."""
    out, heads = [], {}
    for r in table_rows(html):
        cells = r["cells"]
        if r["head"] and len(cells) > 2:
            heads[r["table"]] = cells
        elif r["table"] in heads and len(cells) == len(heads[r["table"]]):
            out += [{"anchor": r["anchor"], "name": f"{cells[0]}: {h}" if cells[0] else h, "raw": c} for h, c in list(zip(heads[r["table"]], cells))[1:] if c]
        elif len(cells) == 2 and cells[0] and cells[1]:
            out.append({"anchor": r["anchor"], "name": f"{r['section']}: {cells[0].rstrip(':')}" if r["section"] else cells[0].rstrip(":"), "raw": cells[1]})
    return out


def facts_of(pages: DataFrame, item: str, html: str) -> DataFrame:
    """(item, position, anchor, name, raw) of all tables of all pages."""
    kind = pages.schema[item].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, f["anchor"], f["name"], f["raw"]) for i, h in zip(b[item], b[html]) for n, f in enumerate(table_facts(h))]
            yield pd.DataFrame(rows, columns=[item, "position", "anchor", "name", "raw"])

    return pages.select(item, html).mapInPandas(run, f"{item} {kind}, position int, anchor string, name string, raw string")


def split_values(raw: Column) -> Column:
    """The values of a comma-separated fact; commas between digits belong to numbers."""
    return F.filter(F.transform(F.split(raw, r",(?![0-9]{3}(?:[^0-9]|$))"), lambda x: F.trim(x)), lambda x: x != "")


_QUANTITY = re.compile(rf"\s*({NUMBER})(?:\s*[-–]\s*({NUMBER}))?\s*([^\d\s][^\d]*?)?\s*(?:\(([^)]*)\))?\s*")


def quantity(raw: str) -> dict | None:
    """values, unit and qualifier of 'N[-N] unit (qualifier)'; None where it is none.  A comma before
    three digits parts thousands, any other is a decimal comma."""
    text = re.sub(r"(?<=\d),(?!\d{3}(?:\D|$))(?=\d)", ".", raw)
    found = _QUANTITY.fullmatch(text)
    if not found:
        return None
    numbers = [float(x.replace(",", "")) for x in found.group(1, 2) if x]
    name = (found[3] or "").strip() or None
    return {"values": numbers, "unit": name, "qualifier": found[4]}


def flattened(record: str) -> list[tuple[str, str]]:
    """('A / B / property', value) of the leaves of nested sections in a JSON record."""
    out: list[tuple[str, str]] = []

    def walk(x: object, path: tuple[str, ...]) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                walk(v, (*path, str(k)))
        elif isinstance(x, list):
            for v in x:
                walk(v, path)
        elif x is not None:
            out.append((" / ".join(path), str(x)))

    walk(json.loads(record), ())
    return out


def mentions(blocks: DataFrame, aliases: DataFrame, text: str = "text") -> DataFrame:
    """(block columns, entity, alias) where a text names an alias between word boundaries, without case.

    Blocks meet aliases on the alias's first word, not all with all."""
    first = lambda c: F.lower(F.regexp_extract(c, r"[\p{L}\p{N}]+", 0))
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.lower(w)))
    met = blocks.withColumn("_w", F.explode(words)).join(aliases.withColumn("_w", first(F.col("alias"))), "_w").drop("_w")
    quoted = F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_-])\Q"), F.col("alias"), F.lit(r"\E(?![\p{L}\p{N}_-])"))
    return met.where(F.call_function("rlike", F.col(text), quoted))
