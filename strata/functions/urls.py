"""URL scope and normal forms, identities and vector arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The query parameters that only say where a visitor came from.
TRACKING = ("utm_source", "utm_medium", "utm_campaign")


def is_http(url: Column) -> Column:
    """An http(s) URL with a host and without user information."""
    return url.rlike(r"^(?i)https?://[^/?#@\s]+(?:[/?#]\S*)?$")


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def without_tracking(url: Column) -> Column:
    """The URL without tracking parameters and fragment; other parameters keep their order."""
    plain = without_fragment(url)
    base, query = F.substring_index(plain, "?", 1), F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def normal(url: Column, hosts: str = ".*") -> Column:
    """Canonical https form without query and fragment; null out of scope, with dot segments or encoded slashes."""
    host = F.lower(F.regexp_extract(url, r"^(?i)https?://([^/?#:@]+)(?::(?:80|443))?(?:[/?#]|$)", 1))
    path = F.regexp_extract(url, r"^(?i)https?://[^/?#]+(/[^?#]*)?", 1)
    path = F.when(path == "", "/").otherwise(F.regexp_replace(path, "/{2,}", "/"))
    bad = path.rlike(r"(?i)(?:^|/)\.\.?(?:/|$)|%2f|%5c|\\")
    return F.when(is_http(url) & (host != "") & host.rlike(f"^(?:{hosts})$") & ~bad, F.concat(F.lit("https://"), host, path))


def origin(url: Column) -> Column:
    """scheme://host:port with the port made explicit."""
    scheme = F.lower(F.regexp_extract(url, r"^(?i)(https?)://", 1))
    host = F.lower(F.regexp_extract(url, r"^(?i)https?://([^/?#:@]+)", 1))
    port = F.nullif(F.regexp_extract(url, r"^(?i)https?://[^/?#:@]+:([0-9]+)", 1), F.lit(""))
    return F.when(is_http(url), F.concat(scheme, F.lit("://"), host, F.lit(":"), F.coalesce(port, F.when(scheme == "https", "443").otherwise("80"))))


def identity(url: Column, record: Column | None = None) -> Column:
    """24 hexadecimal digits of the SHA-256 of the URL and, on a line of its own, the record."""
    whole = url if record is None else F.concat_ws("\n", url, record)
    return F.substr(F.sha2(whole, 256), F.lit(1), F.lit(24))


def plain_text(markdown: Column) -> Column:
    """Markdown without link targets, URLs, tags and marks, on single spaces."""
    out = F.regexp_replace(markdown, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"https?://\S+", "")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"[#*_`|]", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\n\x0B\f\r]+", " "))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def is_unit(v: Column) -> Column:
    """Finite, and of squared length 1 within 0.002."""
    return F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.abs(dot(v, v) - 1) <= 0.002)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of [x, y]."""
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    terms = F.zip_with(points, after, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)) / 2
