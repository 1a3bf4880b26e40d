"""Records of what was generated, and of the progress of uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The share of each stage in the progress of an upload.
STAGE_WEIGHTS = {"receive": 0.02, "parse": 0.38, "summarize": 0.1, "chunk": 0.05, "embed": 0.4, "index": 0.05}


RECORD = "id string, kind string, doc_type string, question string, subject string, model string, filename string, path string, grounded boolean, n_citations int, created_at timestamp, doc_id string"


def listed(history: DataFrame) -> DataFrame:
    """The latest first."""
    return history.orderBy(F.desc("created_at"), "id")


def appended(history: DataFrame, record: DataFrame) -> DataFrame:
    return history.unionByName(record, allowMissingColumns=True)


def found(history: DataFrame, record_id: str) -> DataFrame:
    return history.filter(F.col("id") == record_id)


def deleted(history: DataFrame, record_id: str) -> DataFrame:
    return history.filter(F.col("id") != record_id)


def latest_sessions(sessions: DataFrame, key: str, updated: str, most: int = 50) -> DataFrame:
    """The most recently updated version of each session, the latest `most` of them."""
    newest = sessions.groupBy(key).agg(F.max_by(F.struct(*sessions.columns), F.struct(updated)).alias("x")).select("x.*")
    return newest.orderBy(F.desc(updated), key).limit(most)


def progress(events: DataFrame, weights: dict[str, float] = STAGE_WEIGHTS) -> DataFrame:
    """(doc_id, progress): the weighted share done, from the latest event of each stage."""
    latest = events.groupBy("doc_id", "stage").agg(F.max_by(F.struct("status", "done", "total"), "ts").alias("x"))
    share = F.when(F.col("x.status") == "done", 1.0).otherwise(F.coalesce(F.col("x.done") / F.nullif(F.col("x.total"), F.lit(0)), F.lit(0.0)))
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in weights.items() for v in kv]), F.col("stage")), F.lit(0.0))
    return latest.groupBy("doc_id").agg(F.round(F.sum(weight * share), 6).alias("progress"))


def version_order(rows: DataFrame, key: str, updated: str) -> DataFrame:
    return rows.withColumn("version", F.row_number().over(W.partitionBy(key).orderBy(F.desc(updated))))
