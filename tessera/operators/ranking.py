"""Reranking, thresholds and the order in which contexts are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.config import DEFAULT, Config
from tessera.operators.search import terms


def overlap_logit(question: Column, passage: Column) -> Column:
    """The default reranker: 0 where half of the question's terms stand in the passage, -10 where none does."""
    asked = F.array_distinct(terms(question))
    shared = F.size(F.array_intersect(asked, terms(passage)))
    return F.when(shared == 0, -10.0).otherwise(F.log((shared + 0.5) / (F.size(asked) - shared + 0.5)))


def select_contexts(ranked: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The contexts of each question, from candidates with question_id, doc_id, clause, chunk_id, score, fused_rank.

    By score (ties by fused_rank) the first of each document's clause is kept, those without a clause by chunk; then
    what reaches the threshold, up to the number wanted. Where nothing does, the best one stays if it is not hopeless.
    The strongest come first and last; `position` counts from 0.
    """
    order = W.partitionBy("question_id").orderBy(F.desc("score"), "fused_rank", "chunk_id")
    key = F.coalesce(F.nullif("clause", F.lit("")), F.col("chunk_id"))
    rows = ranked.withColumns({"rn": F.row_number().over(order), "clause_key": key})
    same = W.partitionBy("question_id", "doc_id", "clause_key").orderBy("rn")
    every = W.partitionBy("question_id")
    rows = rows.withColumns({"copy": F.row_number().over(same), "passed": F.count_if(F.col("score") >= config.min_rerank_score).over(every)})
    good = (F.col("copy") == 1) & (F.col("score") >= config.min_rerank_score)
    last_resort = (F.col("passed") == 0) & (F.col("rn") == 1) & (F.col("score") >= config.hard_reject_score)
    rows = rows.filter(good | last_resort).withColumn("i", F.row_number().over(W.partitionBy("question_id").orderBy("rn")) - 1)
    rows = rows.filter(F.col("i") < config.rerank_top_n).withColumn("n", F.count("*").over(every))
    position = F.when(F.col("i") % 2 == 0, F.col("i") / 2).otherwise(F.col("n") - 1 - (F.col("i") - 1) / 2)
    return rows.withColumn("position", position.cast("int")).drop("rn", "clause_key", "copy", "passed", "i", "n")


def rerank(hits: DataFrame, questions: DataFrame, chunks: DataFrame, scorer=overlap_logit, top_n: int | None = None) -> DataFrame:
    """Hits with the reranker's score. Only the columns that ranking needs are carried; long texts are joined later."""
    rows = hits.select("question_id", "chunk_id", F.col("rank").alias("fused_rank"), F.col("score").alias("fused_score"))
    rows = rows.join(questions.select("question_id", "question"), "question_id").join(chunks.select("chunk_id", "doc_id", "clause", "text"), "chunk_id")
    rows = rows.withColumn("score", scorer(F.col("question"), F.coalesce("text", F.lit("")))).drop("question", "text")
    if top_n:
        order = W.partitionBy("question_id").orderBy(F.desc("score"), "fused_rank", "chunk_id")
        rows = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= top_n).drop("n")
    return rows
