"""The most frequent entries of a table of counts, with a bound on what reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.runtime import spool


def most_frequent(counts: DataFrame, count_col: str, limit: int) -> list[Row]:
    """The rows of the highest counts, at most `limit`: all rows whose count reaches the lowest threshold that few enough
    rows reach. A sort with a limit would send `limit` rows of every partition to the driver; this sends a histogram
    of at most 2,048 bars, then only the rows that are wanted.
    """
    counts = spool(counts.filter(F.col(count_col) > 0), "counts")
    bar = F.floor(F.log2(F.col(count_col)) * 32)
    total, least = 0, None
    for r in sorted(counts.groupBy(bar.alias("bar")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["bar"]):
        total += r["n"]
        if total > limit:
            break
        least = r["bar"]
    return counts.filter(bar >= least).collect() if least is not None else []


def hash_sample(df: DataFrame, id_col: str, rows: int, total: int, seed: int = 0) -> DataFrame:
    """At most `rows` of the `total` rows of df, chosen by a hash of their ids; all of them if there are no more.

    Chosen by a threshold and not by a sort, so that no task passes on more than its share."""
    if total <= rows:
        return df
    share = int(0.95 * rows / total * 2**40)  # a little less, so that the limit has to cut next to nothing
    return df.filter(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(2**40)) < share).limit(rows)
