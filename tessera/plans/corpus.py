"""From crawled pages to an indexed corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.space import trimmed
from tessera.functions.text import slugify
from tessera.operators import catalog
from tessera.plans.engine import Engine

#: Fixed value: the largest file that may be uploaded, in bytes.
UPLOAD_LIMIT = 60 * 1024 * 1024


def scrape(pages: DataFrame, families: DataFrame, available: DataFrame | None = None, include: list[str] | None = None, suffix: str = ".pdf") -> DataFrame:
    """The manifest rows of the latest version of each family that can be had.

    pages (ord, url, html); families (ord, family_key, title, doc_type, pattern, target); available (url), the addresses
    whose files could be loaded. Without it the latest version is taken as it is (a dry run).
    """
    found = catalog.with_facts(catalog.discover(pages, suffix))
    ranked = catalog.rank_versions(catalog.match_families(found, families, "url"), ["ord", "pos"], include, families)
    had = F.lit(True) if available is None else F.coalesce(F.col("had"), F.lit(False))
    rows = ranked if available is None else ranked.join(available.select("url", F.lit(True).alias("had")).distinct(), "url", "left")
    best = catalog.latest_available(rows.withColumn("available", had))
    facts = families.select(F.col("family_key").alias("family"), "title", "doc_type")
    return best.join(facts, "family").select(
        slugify(F.col("family")).alias("doc_id"), "title", "doc_type", "url", "file_name", "doc_date", "protocol",
        F.col("family").alias("family_key"), "source_page", "link_text", "versions",
    ).orderBy("family_key")


def ingest(engine: Engine, manifest: DataFrame, parsed: DataFrame) -> DataFrame:
    """Parses and indexes all documents of a manifest whose pages (doc_id, page_texts) are there; gives the index summary."""
    meta = manifest.select("doc_id", F.coalesce("title", "doc_id").alias("title"), F.coalesce("doc_type", F.lit("regulation")).alias("doc_type"), F.col("url").alias("source_url"), F.col("doc_date").alias("effective_date"))
    return engine.add(meta, parsed, manifest)


def request_error(question: Column, model: Column, known: list[str]) -> Column:
    """Why a request cannot be answered, null if it can."""
    return F.when(F.coalesce(trimmed(question), F.lit("")) == "", "empty question").when(model.isNotNull() & ~model.isin(known), "unknown model")


def upload_error(file_name: Column, n_bytes: Column) -> Column:
    """Why an upload is turned down, null if it is not."""
    return (
        F.when(~F.endswith(F.lower(F.coalesce(file_name, F.lit(""))), F.lit(".pdf")), "not a .pdf file")
        .when(F.coalesce(n_bytes, F.lit(0)) == 0, "empty file")
        .when(n_bytes > UPLOAD_LIMIT, "file too large")
    )
