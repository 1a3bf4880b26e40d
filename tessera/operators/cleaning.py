"""Pages to clean lines: running lines and page numbers out, broken words joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.space import trimmed
from tessera.functions.text import fix_hyphenation, normalize_whitespace


def pages_of(documents: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) of a table with doc_id and page_texts; page_no counts from 1."""
    return documents.select("doc_id", F.posexplode("page_texts").alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("page_no"), F.coalesce("text", F.lit("")).alias("text"))


def lines_of(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, line): every line of every page; line_no counts from 0."""
    return pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def repeated_lines(lines: DataFrame, share: float = 0.5, least_pages: int = 4, least_chars: int = 8) -> DataFrame:
    """(doc_id, line): lines that stand on at least the share of a document's pages (and on 2), counted once a page."""
    bare = lines.select("doc_id", "page_no", trimmed(F.col("line")).alias("line"))
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages")).filter(F.col("pages") >= least_pages)
    seen = bare.filter((F.length("line") >= least_chars) & ~F.col("line").rlike(r"(?U)^\d+$")).distinct()
    counts = seen.groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    return counts.join(pages, "doc_id").filter(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share))).select("doc_id", "line")


def strip_running_lines(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """The lines without repeated ones and without bare page numbers on a page's first or last line with text.

    The edges are those of the page as it was, before repeated lines go."""
    page = W.partitionBy("doc_id", "page_no")
    bare = trimmed(F.col("line"))
    full = F.when(bare != "", F.col("line_no"))
    marked = lines.withColumns({"first": F.min(full).over(page), "last": F.max(full).over(page), "bare": bare})
    number = F.col("bare").rlike(r"(?U)^\d{1,4}$") & F.col("line_no").isin(F.col("first"), F.col("last"))
    kept = marked.filter(~number)
    gone = repeated.select("doc_id", F.col("line").alias("bare"))
    return kept.join(gone, ["doc_id", "bare"], "left_anti").select("doc_id", "page_no", "line_no", "line")


def clean_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): running lines and page numbers removed, then words joined, then white space normalised."""
    lines = lines_of(pages)
    kept = strip_running_lines(lines, repeated_lines(lines))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    joined = kept.groupBy("doc_id", "page_no").agg(text.alias("text"))
    whole = pages.select("doc_id", "page_no").join(joined, ["doc_id", "page_no"], "left")
    return whole.select("doc_id", "page_no", normalize_whitespace(fix_hyphenation(F.coalesce("text", F.lit("")))).alias("text"))


def full_text(pages: DataFrame) -> DataFrame:
    """(doc_id, full_text): the pages in order, joined by blank lines."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n\n")
    return pages.groupBy("doc_id").agg(text.alias("full_text"))


def page_gaps(pages: DataFrame) -> DataFrame:
    """All pages from 1 to a document's last one, missing ones with an empty text."""
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("last"))
    every = last.select("doc_id", F.explode(F.sequence(F.lit(1), "last")).alias("page_no"))
    return every.join(pages, ["doc_id", "page_no"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def parser_label(warnings) -> F.Column:
    """How a document was read, from its warnings."""
    has = lambda word: F.exists(warnings, lambda w: F.contains(F.lower(w), F.lit(word)))
    return F.when(has("docling"), "docling").when(has("ocr"), "pymupdf+ocr").otherwise("pymupdf")


def reading_order(boxes) -> F.Column:
    """The text of recognised boxes (x, y, text; y grows upwards) from top to bottom, then from left to right."""
    keys = F.transform(boxes, lambda b: F.struct((-F.round(b["y"], 3)).alias("down"), F.round(b["x"], 3).alias("x"), b["text"].alias("text")))
    return F.array_join(F.transform(F.array_sort(keys), lambda k: k["text"]), "\n")
