"""Filling containers of a fixed capacity with whole items.

Shortest-pack-first over the histogram of sizes: sizes are placed longest first, each into the packs with the most
room left; packs of the same filling are one pattern with a count. Only the histogram, of at most `capacity` entries,
reaches the driver. Patterns are laid over consecutive containers, so that an item finds its container from its size
and its rank among the items of that size.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.runtime import spool


@dataclass(frozen=True)
class Placement:
    """Items of a size with the ranks from `rank` on go to the containers from `container` on, `count` of them."""

    size: int
    rank: int
    container: int
    count: int


def pack(histogram: dict[int, int], capacity: int) -> tuple[list[Placement], int]:
    """The placements of all sizes from 1 to capacity, and the number of containers."""
    placements: list[Placement] = []
    room: list[tuple[int, int, int]] = []  # (-room left, first container, containers): a pattern's containers
    opened = 0
    for size in sorted((s for s, n in histogram.items() if s > 0 and n > 0), reverse=True):
        left, rank = histogram[size], 0
        while left:
            if room and -room[0][0] >= size:
                free, first, count = heapq.heappop(room)
                if count > left:
                    heapq.heappush(room, (free, first + left, count - left))
                    count = left
                placements.append(Placement(size, rank, first, count))
                left, rank, free = left - count, rank + count, free + size
            else:
                each = capacity // size
                count = max(1, left // each)
                fits = min(each, left)
                for _ in range(fits):
                    placements.append(Placement(size, rank, opened, count))
                    left, rank = left - count, rank + count
                free, first, opened = fits * size - capacity, opened, opened + count
            if free < 0:
                heapq.heappush(room, (free, first, count))
    return placements, opened


def fill_containers(df: DataFrame, id_col: str, size_col: str, capacity: int, bucket_rows: int = 100_000) -> DataFrame:
    """(id, piece_no, start, end, container): every item in a container, as [start, end) of its own units.

    Items up to the capacity stay whole. A larger item is cut into pieces of exactly the capacity, which fill a
    container each, and a rest, which is packed like any other item. Items of size 0, or of null or negative size,
    take no room and are spread over the containers (container 0 if there are none). Ids that are null or repeat are
    items of their own, as given. An empty table gives no rows. The ranks come from counts by size and hash bucket,
    so a size that most items share is ranked by many tasks.
    """
    sizes = df.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("total"))
    cut = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / capacity) - 1, F.lit(0)).cast("int"))
    pieces = sizes.select("id", "total", F.explode(cut).alias("piece_no")).select(
        "id", "piece_no", (F.col("piece_no") * F.lit(capacity).cast("long")).alias("start"),
        F.least("total", (F.col("piece_no") + 1) * F.lit(capacity).cast("long")).alias("end"),
    )
    pieces = pieces.withColumn("size", F.col("end") - F.col("start"))
    pieces = spool(pieces, "packing-pieces")
    # A size has so many hash buckets that none holds more than about bucket_rows pieces.
    sizes = pieces.groupBy("size").agg(F.count("*").alias("n")).collect()  # at most capacity + 1 rows
    wide = {r["size"]: max(1, -(-r["n"] // bucket_rows)) for r in sizes}
    buckets = max(wide.values(), default=1)
    own = F.broadcast(df.sparkSession.createDataFrame(list(wide.items()), "size long, buckets long"))  # at most capacity + 1 rows
    pieces = pieces.join(own, "size").withColumn("bucket", F.pmod(F.xxhash64("id", "piece_no"), "buckets"))
    counts = pieces.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    table = counts.collect()  # at most capacity + 1 rows, and one for every bucket_rows pieces
    histogram: dict[int, int] = {}
    offset: dict[tuple[int, int], int] = {}
    for r in sorted(table, key=lambda r: (r["size"], r["bucket"])):
        offset[r["size"], r["bucket"]] = histogram.get(r["size"], 0)
        histogram[r["size"]] = histogram.get(r["size"], 0) + r["n"]
    placements, containers = pack(histogram, capacity)
    placements.sort(key=lambda p: (p.size, p.rank))
    far = max([1, *histogram.values()])
    first = np.array([p.size * far + p.rank for p in placements] or [0])
    target = np.array([p.container for p in placements] or [0])
    keys = np.array([s * buckets + b for s, b in offset] or [0])
    before = np.array(list(offset.values()) or [0])
    order = np.argsort(keys)
    keys, before = keys[order], before[order]

    @F.pandas_udf("long")
    def container(size: pd.Series, bucket: pd.Series, at: pd.Series) -> pd.Series:
        s = size.to_numpy()
        rank = before[np.searchsorted(keys, s * buckets + bucket.to_numpy())] + at.to_numpy() - 1
        i = np.searchsorted(first, s * far + rank, side="right") - 1
        return pd.Series(np.where(s > 0, target[i] + s * far + rank - first[i], rank % max(1, containers)))

    here = F.row_number().over(W.partitionBy("size", "bucket").orderBy("id", "piece_no"))
    return pieces.withColumn("at", here).select(
        F.col("id").alias(id_col), "piece_no", "start", "end", container("size", "bucket", "at").alias("container")
    )
