"""Continuous ingestion: landed pages become chunks that replace those of their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.config import DEFAULT, Config
from tessera.operators.chunking import chunk_documents
from tessera.operators.cleaning import clean_pages, pages_of
from tessera.operators.history import progress
from tessera.operators.store import Store
from tessera.operators.structure import parse_structure

LANDED = "doc_id string, title string, doc_type string, source_url string, effective_date date, page_texts array<string>"


def ingest_batch(store: Store, landed: DataFrame, config: Config = DEFAULT) -> dict:
    """Parses, chunks and stores documents; of a document that landed twice, any one version. Gives counts by stage.

    A document that yields no chunk leaves the stored one as it is.
    """
    docs = landed.dropDuplicates(["doc_id"])
    pages = clean_pages(pages_of(docs))
    nodes = parse_structure(pages, config)
    meta = docs.select("doc_id", F.coalesce("title", "doc_id").alias("title"), F.coalesce("doc_type", F.lit("regulation")).alias("doc_type"), "source_url", "effective_date")
    chunks = chunk_documents(meta, nodes, pages, config)
    store.replace_documents("nodes", nodes)
    store.replace_documents("chunks", chunks)
    return {"documents": docs.count()}


def start(spark: SparkSession, landing: str, root: str, checkpoint: str, config: Config = DEFAULT) -> StreamingQuery:
    """A query over a folder of landed parquet files. A batch that is run again after a failure replaces the same
    documents by the same rows, so the store ends up the same."""
    store = Store(spark, root)

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest_batch(store, batch, config)

    stream = spark.readStream.schema(LANDED).parquet(landing)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_progress(spark: SparkSession, events: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """The progress of every upload, kept up to date from a stream of events (ts, doc_id, stage, status, done, total).

    The latest event of a stage wins however late it arrives.
    """
    latest = events.groupBy("doc_id", "stage").agg(F.max_by(F.struct("status", "done", "total", "ts"), "ts").alias("x"))

    def each(batch: DataFrame, _: int) -> None:
        progress(batch.select("doc_id", "stage", "x.*")).createOrReplaceGlobalTempView(name)

    return latest.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
