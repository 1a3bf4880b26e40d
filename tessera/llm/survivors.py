"""One surviving record for each group of duplicates, chosen field by field.

Currency reasoning: that one value gives way to another is learned from rows with timestamps, over all groups. Where rows
of a group lack timestamps, its values are put in a partial order by what is learned, paths through values that the group
lacks included, and by the timestamps that there are; the topologically latest value survives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.space import trimmed
from tessera.runtime import spool


def url_path(url: Column) -> Column:
    """The percent-decoded path of a url; scheme, host, port, query, fragment and doubled slashes set aside.

    An escape that cannot be decoded leaves the path as written. A null url has a null path.
    """
    bare = F.regexp_replace(trimmed(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", "")
    path = F.regexp_replace(bare, r"(?s)[?#].*$", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(F.concat(F.lit("/"), decoded), "/{2,}", "/")


def transitions(rows: DataFrame) -> DataFrame:
    """(field, v, w, n), n > 0: in how many more groups v gave way to w than w to v, of rows (group, field, value, at).

    A value of a group counts once, when it was last seen, so a large group costs no more than its different values.
    """
    seen = rows.filter(F.col("at").isNotNull()).groupBy("group", "field", "value").agg(F.max("at").alias("last"))
    order = W.partitionBy("group", "field").orderBy("last", "value")
    steps = seen.withColumn("next", F.lead("value").over(order)).filter(F.col("next").isNotNull())
    votes = steps.select("field", F.col("value").alias("v"), F.col("next").alias("w"), F.lit(1).alias("n"))
    return votes.union(votes.select("field", "w", "v", F.lit(-1))).groupBy("field", "v", "w").agg(F.sum("n").alias("n")).filter(F.col("n") > 0)


def precedence(pairs: DataFrame, votes: DataFrame, hops: int) -> DataFrame:
    """(field, v, w): of the asked pairs those in which w is known to come after v, directly or over up to hops - 1 values
    in between. Where both directions are known the shorter path decides, then the votes on its weakest step.

    The walk starts from the asked pairs alone, each once, so popular values cost their own steps only.
    """
    ends = ["field", "v", "w"]
    front = pairs.select(*ends, F.col("v").alias("x"), F.lit(2**62).alias("n"))
    step = votes.select("field", F.col("v").alias("x"), F.col("w").alias("y"), F.col("n").alias("m"))
    found = None
    for hop in range(1, hops + 1):
        front = front.join(step, ["field", "x"]).groupBy(*ends, F.col("y").alias("x")).agg(F.max(F.least("n", "m")).alias("n"))
        here = front.filter("x = w").select(*ends, F.lit(-hop).alias("near"), "n")
        found = here if found is None else found.unionByName(here)
        front = front.filter("x <> w")
    known = found.groupBy(*ends).agg(F.max(F.struct("near", "n")).alias("how"))
    back = known.select("field", F.col("v").alias("w"), F.col("w").alias("v"), F.col("how").alias("back"))
    return known.join(back, ends, "left").filter(F.col("back").isNull() | (F.col("how") > F.col("back"))).select(*ends)


def best_representatives(df: DataFrame, group: str, id_col: str, trust: str, at: str, fields: list[str], hops: int = 2) -> DataFrame:
    """(group_id, field, id, value): per group of two or more ids, the row that supplies each field's best value.

    `fields` hold null where a value is unusable; a field without a usable value in the group gives no row. The best
    value is one of the most trusted rows. If these all have timestamps it is the latest one's, then the largest id's.
    If not, it is the topologically latest of their values: that with the fewest values known to come after it (none,
    unless the order has a cycle), then with the most known to come before it, then the last seen, then the largest id.
    The row is the value's latest one. group_id is the smallest id.

    Groups are reduced to their values by aggregation with partial results, so no group, whatever its size, is ever
    gathered in a task. Null groups and null ids are left out, repeated rows count once, an empty table gives no rows.
    Other columns than the named ones are not read.
    """
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    rows = df.select(F.col(group).alias("group"), F.col(id_col).alias("id"), F.coalesce(trust, F.lit(0)).alias("trust"), F.col(at).alias("at"), each.alias("fields"))
    rows = rows.filter(F.col("group").isNotNull() & F.col("id").isNotNull())
    long = rows.select("group", "id", "trust", "at", F.explode("fields").alias("x")).select("group", "id", "trust", "at", "x.*").filter(F.col("value").isNotNull())
    latest, undated = F.max(F.struct("at", "id")).alias("latest"), F.bool_or(F.col("at").isNull()).alias("undated")
    seen = long.groupBy("group", "field", "value", "trust").agg(latest, undated).select("*", "latest.at", "latest.id").drop("latest")
    keys = ["group", "field"]
    level = seen.groupBy(*keys, "trust").agg(F.max(F.struct("at", "id", "value")).alias("best"), F.bool_or("undated").alias("undated"))
    level = spool(level.groupBy(*keys).agg(F.max(F.struct("trust", "best", "undated")).alias("x")).select(*keys, "x.*"), "survivors-levels")
    best = level.filter(~F.col("undated")).select(*keys, "best.id", "best.value")
    open_ = level.filter("undated").select(*keys, "trust")
    if not open_.isEmpty():
        values = spool(seen.join(open_, [*keys, "trust"], "left_semi").select(*keys, "value", "at", "id"), "survivors-values")
        v = values.select(*keys, F.col("value").alias("v"), F.col("at").alias("at_v"))
        both = v.join(values.select(*keys, F.col("value").alias("w"), F.col("at").alias("at_w")), keys).filter("v <> w")
        known = precedence(both.select("field", "v", "w").distinct(), spool(transitions(long), "survivors-votes"), hops)
        dated = F.col("at_v").isNotNull() & F.col("at_w").isNotNull()
        edges = both.join(known.withColumn("known", F.lit(True)), ["field", "v", "w"], "left").filter(F.when(dated, F.col("at_v") < F.col("at_w")).otherwise(F.col("known")))
        ends = edges.select(*keys, F.col("v").alias("value"), F.lit(1).alias("after"), F.lit(0).alias("before")).union(edges.select(*keys, "w", F.lit(0), F.lit(1)))
        ends = ends.groupBy(*keys, "value").agg(F.sum("after").alias("after"), F.sum("before").alias("before"))
        ranked = values.join(ends, [*keys, "value"], "left").fillna(0, ["after", "before"])
        last = ranked.groupBy(*keys).agg(F.max(F.struct(-F.col("after"), "before", "at", "id", "value")).alias("x"))
        best = best.union(last.select(*keys, "x.id", "x.value"))
    groups = rows.groupBy("group").agg(F.min("id").alias("group_id"), F.max("id").alias("last")).filter(F.col("group_id") < F.col("last"))
    return best.join(groups, "group").select("group_id", "field", "id", "value")


def pdf_candidates(candidates: DataFrame, pages: DataFrame, families: DataFrame) -> DataFrame:
    """The candidates with the path of their url, their trust, and null for every unusable value."""
    trust = pages.groupBy("source_page").agg(F.max(F.coalesce("trust", F.lit(0))).alias("trust"))
    known = families.select(F.lower(trimmed(F.col("family_key"))).alias("family")).filter(F.col("family").isNotNull()).distinct()
    rows = candidates.select(
        "cand_id", url_path(F.col("url")).alias("path"), "source_page", "fetched_at",
        F.lower(trimmed(F.col("family"))).alias("family"),
        F.when(F.col("protocol").between(10, 9999), F.col("protocol")).alias("protocol"),
        F.when(F.col("doc_date").between(F.lit("2000-01-01").cast("date"), F.to_date("fetched_at")), F.col("doc_date")).alias("doc_date"),
    )
    rows = rows.join(known.withColumn("known", F.lit(True)), "family", "left").join(trust, "source_page", "left")
    return rows.withColumn("family", F.when(F.col("known"), F.col("family"))).drop("known")
