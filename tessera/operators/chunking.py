"""Clauses to overlapping windows of sentences, with the context a reader needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Config
from tessera.functions.space import trimmed
from tessera.functions.text import context_header, token_estimate
from tessera.operators.structure import node_label


def sentence_windows(text: Column, target: int, overlap: int) -> Column:
    """Sentences folded into windows of at most `target` characters; each begins with the last `overlap` of the one before.

    A sentence longer than the target is never cut, so a window may exceed it. A text within the target is one window.
    """
    # Sentences are trimmed once, before the fold, so that joining them is a mere concatenation.
    joined = lambda a, b: F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit(" "), b))
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        cur = acc["cur"]
        over = (cur != "") & (F.length(cur) + F.length(s) + 1 > target)
        tail = trimmed(F.right(cur, F.lit(overlap))) if overlap else F.lit("")
        return F.when(over, F.struct(joined(tail, s).alias("cur"), F.concat(acc["out"], F.array(cur)).alias("out"))).otherwise(
            F.struct(joined(cur, s).alias("cur"), acc["out"].alias("out"))
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])

    folded = F.aggregate(F.transform(F.split(text, r"(?U)(?<=[.;:])\s+"), trimmed), start, step, finish)
    return F.when(F.length(text) <= target, F.array(text)).otherwise(F.when(F.size(folded) > 0, folded).otherwise(F.array(text)))


def parent_context(nodes: DataFrame, limit: int) -> DataFrame:
    """Adds parent_text: the beginning of the parent's text, for short nodes, and the node's own, cut to the limit."""
    label = node_label()
    up = nodes.select(F.col("doc_id").alias("p_doc"), F.col("node_id").alias("p_id"), F.col("text").alias("p_text"), label.alias("p_label"))
    rows = nodes.join(up, (F.col("doc_id") == F.col("p_doc")) & (F.col("parent_id") == F.col("p_id")), "left")
    lead = F.when((F.coalesce("p_text", F.lit("")) != "") & (F.length(F.coalesce("text", F.lit(""))) < 800), F.concat("p_label", F.lit(": "), trimmed(F.left("p_text", F.lit(600)))))
    own = F.concat(label, F.lit(": "), F.coalesce("text", F.lit("")))
    return rows.withColumn("parent_text", F.left(F.concat_ws("\n", lead, own), F.lit(limit))).drop("p_doc", "p_id", "p_text", "p_label")


def chunk_documents(meta: DataFrame, nodes: DataFrame, pages: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """The chunks of documents: windows of their nodes, or of their pages where a document's nodes give none."""
    windows = lambda c: F.posexplode(sentence_windows(trimmed(F.col(c)), config.child_chars, config.overlap_chars)).alias("w", "win")
    facts = meta.select("doc_id", F.col("title").alias("doc_title"), "doc_type", "source_url", F.date_format("effective_date", "yyyy-MM-dd").alias("effective_date"))
    rows = parent_context(nodes, config.parent_chars).filter(F.length(trimmed(F.col("text"))) >= config.min_chunk_chars).join(facts, "doc_id")
    header = context_header(F.col("doc_title"), F.get("path_titles", F.lit(0)), node_label())
    rows = rows.select("*", header.alias("header"), windows("text"))
    chunks = rows.select(
        F.concat("node_id", F.lit(":"), F.col("w").cast("string")).alias("chunk_id"), "doc_id", "doc_title",
        F.concat("header", F.lit(": "), "win").alias("text"), "parent_text", "parent_id", F.array_join("path_titles", " > ").alias("section_path"),
        F.when(F.col("level") >= 1, F.col("number")).alias("clause"), F.col("page_start").alias("page"),
        token_estimate(F.col("win"), config.chars_per_token).alias("token_count"), "doc_type", "source_url", "effective_date",
    )
    if pages is None:
        return chunks
    bare = pages.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").filter(F.length(trimmed(F.col("text"))) >= config.min_chunk_chars)
    rest = bare.join(facts, "doc_id").select("*", windows("text"))
    rest = rest.select(
        F.concat("doc_id", F.lit("#p"), F.col("page_no").cast("string"), F.lit(":"), F.col("w").cast("string")).alias("chunk_id"), "doc_id", "doc_title",
        F.concat("doc_title", F.lit(": "), "win").alias("text"), F.col("win").alias("parent_text"), F.lit(None).cast("string").alias("parent_id"),
        F.concat(F.lit("стр. "), F.col("page_no").cast("string")).alias("section_path"), F.lit(None).cast("string").alias("clause"), F.col("page_no").alias("page"),
        token_estimate(F.col("win"), config.chars_per_token).alias("token_count"), "doc_type", "source_url", "effective_date",
    )
    return chunks.unionByName(rest)
