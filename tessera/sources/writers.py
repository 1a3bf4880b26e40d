"""Writing parsed documents and chunks as files other tools read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_dump(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, always written anew."""
    chunks.write.mode("overwrite").json(path)


def parsed_dump(meta: DataFrame, nodes: DataFrame, parsed: DataFrame, path: str) -> None:
    """A JSON object per document with its meta data, nodes in reading order, pages and warnings."""
    columns = [c for c in nodes.columns if c not in ("ord",)]
    tree = nodes.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*columns).alias("node")))), lambda x: x["node"]).alias("nodes"))
    rows = meta.select("doc_id", F.struct(*meta.columns).alias("meta")).join(tree, "doc_id", "left").join(parsed.drop("parsed_at"), "doc_id", "left")
    rows.drop("doc_id").write.mode("overwrite").json(path)
