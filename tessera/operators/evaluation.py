"""Judging answers against a golden set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judge(golden: DataFrame, answers: DataFrame, citations: DataFrame) -> DataFrame:
    """(question_id, type, grounded, grounding_ok, doc_hit, clause_hit) of golden (question_id, doc, type, clause).

    A hit is a cited document or clause; doc_hit and clause_hit are null where none is expected.
    """
    cited = golden.select("question_id", "doc", "clause").join(citations.select("question_id", F.col("doc_id").alias("c_doc"), F.col("clause").alias("c_clause")), "question_id")
    hits = cited.groupBy("question_id").agg(F.bool_or(F.col("c_doc") == F.col("doc")).alias("doc_in"), F.bool_or(F.col("c_clause") == F.col("clause")).alias("clause_in"))
    rows = golden.join(answers.select("question_id", "grounded"), "question_id", "left").join(hits, "question_id", "left")
    answerable = F.col("type") != "unanswerable"
    return rows.select(
        "question_id", "type", F.coalesce("grounded", F.lit(False)).alias("grounded"), (F.coalesce("grounded", F.lit(False)) == answerable).alias("grounding_ok"),
        F.when(answerable & F.col("doc").isNotNull(), F.coalesce("doc_in", F.lit(False))).alias("doc_hit"),
        F.when(answerable & F.col("clause").isNotNull(), F.coalesce("clause_in", F.lit(False))).alias("clause_hit"),
    )


def summarize(judged: DataFrame) -> DataFrame:
    """One row: total, answerable, and the three rates to three places; null where there is nothing to divide by."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 3).alias
    return judged.agg(
        F.count("*").alias("total"), F.count_if(F.col("type") != "unanswerable").alias("answerable"),
        rate("grounding_ok")("grounding_accuracy"), rate("doc_hit")("doc_hit_rate"), rate("clause_hit")("clause_hit_rate"),
    )
