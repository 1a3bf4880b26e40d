"""Tables that are replaced by versions: writes never touch what readers see.

A table is a folder of numbered versions; a version counts once its _SUCCESS marker is there, so a write that dies leaves
the last one in force. A version is a full snapshot, or a change: the ids of documents whose rows go, and new rows.
Replacing a few documents writes a change, which costs no more than these documents; after `changes` of them the next
write is a snapshot again. A number is claimed by creating a file that must not be there, so writers never share one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str
    keep: int = 2  # snapshots that stay for readers still on them
    changes: int = 0  # changes that may follow a snapshot

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def snapshots(self, name: str) -> list[str]:
        """The paths of the versions that count, the latest last."""
        fs, folder = self._fs(f"{self.root}/{name}")
        if not fs.exists(folder):
            return []
        done = []
        for status in fs.listStatus(folder):
            path = status.getPath()
            if path.getName().startswith("v") and fs.exists(self._fs(f"{path}/_SUCCESS")[1]):
                done.append(path.toString())
        return sorted(done)

    def exists(self, name: str) -> bool:
        return bool(self.snapshots(name))

    def read(self, name: str, schema: StructType | None = None) -> DataFrame:
        found = self.snapshots(name)
        if not found:
            if schema is None:
                raise FileNotFoundError(f"{self.root}/{name}")
            return self.spark.createDataFrame([], schema)
        return self._read(found, schema)

    def _read(self, found: list[str], schema: StructType | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        base = max(i for i, f in enumerate(found) if not f.endswith("-change"))
        rows = reader.parquet(found[base])
        for f in found[base + 1 :]:
            rows = rows.join(self.spark.read.parquet(f"{f}/gone"), "doc_id", "left_anti").select(*rows.columns)
            rows = rows.unionByName(reader.parquet(f"{f}/rows"), allowMissingColumns=True)
        return rows

    def _claim(self, name: str) -> int:
        found = self.snapshots(name)
        number = int(found[-1].rpartition("/v")[2][:6]) + 1 if found else 1
        while True:
            fs, path = self._fs(f"{self.root}/{name}/_claims/{number:06d}")
            if fs.createNewFile(path):
                return number
            number += 1

    def replace(self, name: str, df: DataFrame, partition_by: str | None = None, sort_by: str | None = None) -> DataFrame:
        """A new snapshot; partitioned by a facet and sorted within, so that filters prune folders and row groups."""
        number = self._claim(name)
        out = df
        if partition_by:
            out = out.repartition(F.col(partition_by), F.pmod(F.xxhash64(sort_by or partition_by), F.lit(32)))
        if sort_by:
            out = out.sortWithinPartitions(*([partition_by] if partition_by else []), sort_by)
        writer = out.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{self.root}/{name}/v{number:06d}")
        self._tidy(name)
        return self.read(name, df.schema if not partition_by else None)

    def _tidy(self, name: str) -> None:
        """Removes what lies before the last `keep` snapshots."""
        found = self.snapshots(name)
        full = [i for i, f in enumerate(found) if not f.endswith("-change")]
        for old in found[: full[max(0, len(full) - self.keep)]]:
            fs, path = self._fs(old)
            fs.delete(path, True)

    def _rewrite(self, name: str, make: Callable[[DataFrame], DataFrame], schema: StructType | None = None) -> DataFrame:
        """A snapshot made from the last version; made again where another writer has finished one meanwhile."""
        while True:
            before = self.snapshots(name)
            out = self.replace(name, make(self.read(name, schema)))
            if self.snapshots(name)[-2:][:1] == before[-1:] or not before:
                return out

    def _change(self, name: str, gone: DataFrame, rows: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}/v{self._claim(name):06d}-change"
        gone.select("doc_id").write.mode("overwrite").parquet(f"{path}/gone")
        rows.write.mode("overwrite").parquet(f"{path}/rows")
        fs, mark = self._fs(f"{path}/_SUCCESS")
        fs.create(mark, True).close()
        return self.read(name)

    def upsert(self, name: str, new: DataFrame, key: str = "chunk_id") -> DataFrame:
        """Rows with new keys are added, those with known keys replaced."""
        return self._rewrite(name, lambda old: replaced(old, new, key), new.schema)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows are added, nothing goes."""
        return self.replace_documents(name, rows, self.spark.createDataFrame([], "doc_id string"))

    def replace_documents(self, name: str, new: DataFrame, ids: DataFrame | None = None) -> DataFrame:
        """All rows of the documents in `ids` (those of `new` if not given) give way to `new`, stale ones included: a
        document in `ids` without new rows has none any more."""
        ids = (new if ids is None else ids).select("doc_id").distinct()
        found = self.snapshots(name)
        if not found:
            return self.replace(name, new)
        since = next(i for i, f in enumerate(reversed(found)) if not f.endswith("-change"))
        if since < self.changes:
            return self._change(name, ids, new)
        return self._rewrite(name, lambda old: replaced(old, new, "doc_id", ids), new.schema)

    def remove_documents(self, name: str, doc_ids: list[str] | DataFrame) -> DataFrame:
        ids = doc_ids if isinstance(doc_ids, DataFrame) else self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string")
        old = self.read(name)
        return self.replace_documents(name, self.spark.createDataFrame([], old.schema), ids)

    def info(self, name: str) -> dict:
        found = self.exists(name)
        return {"exists": found, "points": self.read(name).count() if found else 0, "status": "green" if found else "missing"}


def replaced(old: DataFrame, new: DataFrame, key: str, ids: DataFrame | None = None) -> DataFrame:
    gone = (new if ids is None else ids).select(key).distinct()
    return old.join(gone, key, "left_anti").unionByName(new, allowMissingColumns=True)


def index_summary(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"))


def parse_summary(meta: DataFrame, nodes: DataFrame, parsed: DataFrame) -> DataFrame:
    """(doc_id, title, pages, nodes, parser, warnings) of every document."""
    n = nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"))
    p = parsed.select("doc_id", F.size(F.coalesce("page_texts", F.array().cast("array<string>"))).alias("pages"), "parser", F.size(F.coalesce("warnings", F.array().cast("array<string>"))).alias("warnings"))
    return meta.select("doc_id", "title").join(n, "doc_id", "left").join(p, "doc_id", "left").withColumn("nodes", F.coalesce("nodes", F.lit(0)))
