"""Links to versions of documents: families, ranking of versions, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import links as L


def discover(pages: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """(url, link_text, source_page, found_at): the links of pages (ord, url, html); of equal addresses the first found."""
    rows = pages.select("ord", F.col("url").alias("source_page"), F.posexplode(L.links(F.col("html"), suffix)).alias("pos", "x"))
    rows = rows.select(F.col("x.href").alias("url"), "x.link_text", "source_page", "ord", "pos", L.clean_url(F.col("x.href")).alias("clean_url"))
    first = rows.groupBy("clean_url").agg(F.min(F.struct("ord", "pos", "url", "link_text", "source_page")).alias("x"))
    return first.select("clean_url", "x.*").withColumn("file_name", L.file_name(F.col("clean_url")))


def with_facts(candidates: DataFrame) -> DataFrame:
    """Adds file_name, protocol and doc_date from a candidate's url and link_text; the date of the name wins."""
    clean = L.clean_url(F.col("url"))
    named = F.concat_ws(" ", L.file_name(clean), "link_text")
    return candidates.withColumns({
        "file_name": L.file_name(clean), "protocol": L.protocol(named),
        "doc_date": F.coalesce(L.date_in(L.file_name(clean)), L.date_in(F.coalesce(F.try_url_decode(F.replace(clean, F.lit("+"), F.lit("%2B"))), clean))),
    })


def match_families(candidates: DataFrame, families: DataFrame, key: str) -> DataFrame:
    """Adds family: the first family (by ord) whose pattern is found in the file name, the link text or the url.

    families (ord, family_key, pattern) is a dimension of a few rows; its size is checked before it becomes part of
    the expression.
    """
    rows = families.orderBy("ord").limit(1001).select("family_key", "pattern").collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 families; match them by a join")
    clean = L.clean_url(F.col("url"))
    named = F.concat_ws(" ", L.file_name(clean), "link_text")
    found: Column = F.lit(None).cast("string")
    for r in reversed(rows):
        pattern = f"(?iu){r['pattern']}"
        found = F.when(named.rlike(pattern) | clean.rlike(pattern), F.lit(r["family_key"])).otherwise(found)
    return candidates.withColumn("family", found)


def rank_versions(candidates: DataFrame, order: list[str], include: list[str] | None = None, families: DataFrame | None = None) -> DataFrame:
    """Adds version (1 is the latest) and versions by family: protocol, then date, latest first; ties in found order."""
    rows = candidates.filter(F.col("family").isNotNull())
    if include is not None:
        rows = rows.filter(F.col("family").isin(include))
    elif families is not None:
        rows = rows.join(families.filter("target").select(F.col("family_key").alias("family")), "family", "left_semi")
    keys = [F.desc(F.coalesce("protocol", F.lit(0))), F.desc(F.coalesce("doc_date", F.lit("0001-01-01").cast("date"))), *order]
    family = W.partitionBy("family")
    return rows.withColumns({"version": F.row_number().over(family.orderBy(*keys)), "versions": F.count("*").over(family)})


def latest_available(ranked: DataFrame, available: str = "available") -> DataFrame:
    """The best version of each family that can be had; a family without one gives no row."""
    best = F.row_number().over(W.partitionBy("family").orderBy("version"))
    return ranked.filter(F.col(available)).withColumn("n", best).filter(F.col("n") == 1).drop("n")


def merge_manifest(scraped: DataFrame, existing: DataFrame) -> DataFrame:
    """Scraped rows first, then the existing rows of other documents, in their order (seq)."""
    rest = existing.join(scraped.select("doc_id"), "doc_id", "left_anti")
    rows = scraped.withColumn("part", F.lit(0)).unionByName(rest.withColumn("part", F.lit(1)), allowMissingColumns=True)
    return rows.withColumn("seq", F.struct("part", "seq"))


def upsert_manifest(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The existing rows of other documents, then the new ones at the end."""
    kept = existing.join(new.select("doc_id"), "doc_id", "left_anti").withColumn("part", F.lit(0))
    return kept.unionByName(new.withColumn("part", F.lit(1)), allowMissingColumns=True).withColumn("seq", F.struct("part", "seq"))
