"""Functions on links: file names, dates, protocol numbers, hosts, links in HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(url: Column) -> Column:
    """The percent-decoded tail of a url's path, as written where an escape is malformed."""
    tail = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$", 1)
    return F.coalesce(F.try_url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))), tail)


def clean_url(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), r"[?#].*$", "")


def date_in(text: Column) -> Column:
    """The first valid date of the years 2000 to 2100: of all dd.mm.yyyy, else of all yyyy.mm.dd, else of all dd.mm.yy."""
    #: The shapes of dates in names of files, with the place of the year.
    shapes = ((r"(\d{2})[._\-](\d{2})[._\-](\d{4})", 3), (r"(\d{4})[._\-](\d{2})[._\-](\d{2})", 1), (r"(\d{2})[._\-](\d{2})[._\-](\d{2})(?!\d)", 3))
    found = []
    for n, (shape, year) in enumerate(shapes):
        year, month, day = (F.regexp_extract_all(text, F.lit(shape), F.lit(i)) for i in ((year, 2, 4 - year)))
        century = F.lit("20") if n == 2 else F.lit("")
        parts = F.transform(F.arrays_zip(year.alias("y"), month.alias("m"), day.alias("d")), lambda p: F.try_to_date(F.concat(century, p["y"], F.lit("-"), p["m"], F.lit("-"), p["d"]), "yyyy-MM-dd"))
        found.append(F.get(F.filter(parts, lambda d: F.year(d).between(2000, 2100)), F.lit(0)))
    return F.coalesce(*found)


def protocol(text: Column) -> Column:
    #: Fixed value: the shape of a protocol's number.
    return F.nullif(F.regexp_extract(text, r"(?i)protokol[_\-\s]*(\d{2,4})", 1), F.lit("")).cast("int")


def links(html: Column, suffix: str = ".pdf") -> Column:
    """The (href, link_text) of every link whose address holds the suffix; comments and scripts are no markup."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    anchors = F.regexp_extract_all(bare, F.lit(r"(?is)(<a\s[^>]*>.*?</a>|<a\s[^>]*>)"), F.lit(1))
    href = lambda a: F.trim(F.regexp_replace(F.regexp_extract(a, r"(?is)^<a\s[^>]*?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1), r"^[\"']|[\"']$", ""))
    text = lambda a: F.trim(F.regexp_replace(F.regexp_replace(a, r"(?s)<[^>]*>", " "), r"(?U)\s+", " "))
    pairs = F.transform(anchors, lambda a: F.struct(href(a).alias("href"), text(a).alias("link_text")))
    return F.filter(pairs, lambda p: F.contains(F.lower(p["href"]), F.lit(suffix)))


def same_host(url: Column, base: Column) -> Column:
    """An empty host is the same host; a port belongs to the host."""
    host = F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))
    return (host == "") | (host == F.try_parse_url(base, F.lit("AUTHORITY")))


def cache_key(url: Column) -> Column:
    return F.left(F.sha2(url, 256), F.lit(16))


def may_retry(status: Column) -> Column:
    return (status == 429) | (status >= 500)


def retry_delay(attempt: Column, least: float = 2, most: float = 30) -> Column:
    """The seconds before an attempt is repeated, the first being 1: doubled each time, within bounds."""
    return F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), F.pow(F.lit(2.0), attempt)))


def safe_name(name: Column) -> Column:
    """A base name that stays in its folder; null for what does not."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.when((base != "") & ~base.isin(".", ".."), base)
