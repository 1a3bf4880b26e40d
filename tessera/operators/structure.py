"""Recovering the hierarchy of numbered clauses from the lines of a document.

The reading state (highest section so far, appendix, open ancestors, current clause) is expressed by window functions
over the lines of a document; no line is handled by Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.config import DEFAULT, Config
from tessera.functions.space import trimmed
from tessera.functions.text import citation_label
from tessera.operators.cleaning import lines_of

#: The shapes of clause lines, dot leaders, headings of contents, appendix headings; six levels at most.
CLAUSE = r"^(\d{1,2}(?:\.\d{1,2}){0,5})\.\s*(.*)$"
LEADER = r"\.{4,}"
CONTENTS = r"(?iuU)^\s*(оглавление|содержание)\s*$"
APPENDIX = r"(?iuU)^\s*приложение\b"
APPENDIX_NUMBER = r"(?iuU)^приложение\s*(№|n)?\s*\d"
PREAMBLE_TITLE = "Вводная часть"
LEVELS = 6


def appendix_heading(line: Column) -> Column:
    x = trimmed(line)
    return x.rlike(APPENDIX) & (F.length(x) <= 90) & (x.rlike(APPENDIX_NUMBER) | ~x.endswith("."))


def looks_like_title(line: Column) -> Column:
    x = trimmed(line)
    upper = (x == F.upper(x)) & (x != F.lower(x))
    return (x != "") & (F.length(x) <= 140) & (~x.rlike(r"[.;,:]$") | upper)


def _reading_order(lines: DataFrame):
    """One order for all windows over a document's lines, so that they are sorted once."""
    keys = ("page_no", "line_no") if "line_no" in lines.columns else ("seq",)
    return W.partitionBy("doc_id").orderBy(*keys)


def without_contents(lines: DataFrame, gap: int = DEFAULT.toc_gap) -> DataFrame:
    """(doc_id, seq, page_no, line_no, line): the lines with text, numbered, without the table of contents and other leader lines.

    The table reaches from its heading to the last leader line before more than `gap` lines without leaders.
    """
    order = _reading_order(lines)
    rows = lines.filter(trimmed(F.col("line")) != "").withColumn("seq", F.row_number().over(order))
    upto = order
    before = upto.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"leader": F.col("line").rlike(LEADER), "heading": F.col("line").rlike(CONTENTS)})
    rows = rows.withColumn("start", F.min(F.when(F.col("heading"), F.col("seq"))).over(W.partitionBy("doc_id")))
    step = F.when((F.col("leader") & (F.col("seq") > F.col("start"))) | (F.col("seq") == F.col("start")), F.col("seq"))
    rows = rows.withColumn("step", step).withColumn("last_step", F.last("step", ignorenulls=True).over(before))
    broken = F.when(F.col("step").isNotNull() & (F.col("step") - F.col("last_step") - 1 > gap), 1).otherwise(0)
    rows = rows.withColumn("breaks", F.sum(broken).over(upto.rowsBetween(W.unboundedPreceding, 0)))
    end = F.max(F.when(F.col("breaks") == 0, F.col("step"))).over(W.partitionBy("doc_id"))
    rows = rows.withColumn("end", end)
    inside = F.coalesce(F.col("seq").between(F.col("start"), F.col("end")), F.lit(False))
    return rows.filter(~inside & ~F.col("leader")).select("doc_id", "seq", "page_no", "line_no", "line")


def clause_lines(lines: DataFrame) -> DataFrame:
    """The lines with what they open: number, rest, level, appendix; number is null for running text.

    Before the first appendix a section number below the highest one so far is running text.
    """
    number = F.nullif(F.regexp_extract("line", CLAUSE, 1), F.lit(""))
    rows = lines.withColumns({
        "number": number, "rest": trimmed(F.regexp_extract("line", CLAUSE, 2)),
        "is_appendix": appendix_heading(F.col("line")),
    })
    rows = rows.withColumn("level", F.size(F.split("number", r"\.")) - 1).withColumn("level", F.when(F.col("number").isNotNull(), F.col("level")))
    order = _reading_order(rows)
    section = F.when(F.col("level") == 0, F.col("number").cast("int"))
    rows = rows.withColumns({
        "appendix": F.sum(F.col("is_appendix").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)),
        "highest": F.max(section).over(order.rowsBetween(W.unboundedPreceding, -1)), "section": section,
    })
    # Numbers turned down never raise the maximum, so it may be taken over all of them.
    refused = (F.col("level") == 0) & (F.col("appendix") == 0) & F.coalesce(F.col("section") < F.col("highest"), F.lit(False))
    keep = lambda c: F.when(~F.coalesce(refused, F.lit(False)), F.col(c))
    rows = rows.withColumns({"number": keep("number"), "level": keep("level")})
    return rows.drop("highest", "section").withColumn("clause_no", F.sum(F.col("number").isNotNull().cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))


def parents(clauses: DataFrame) -> DataFrame:
    """Adds parent_no: the clause_no of the clause one level up that is still open.

    A clause closes all clauses of its level and below, an appendix closes all; a missing level in between has no clause.
    """
    order = W.partitionBy("doc_id").orderBy("clause_no")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    last = {f"last_{k}": F.last(F.when(F.col("level") == k, F.col("clause_no")), ignorenulls=True).over(before) for k in range(LEVELS)}
    rows = clauses.withColumns(last | {"opened": F.min("clause_no").over(W.partitionBy("doc_id", "appendix"))})
    parent = F.lit(None).cast("long")
    for k in range(1, LEVELS):
        mine = F.col(f"last_{k - 1}")
        later = F.greatest(F.lit(0), *[F.coalesce(F.col(f"last_{j}"), F.lit(0)) for j in range(k - 1)]) if k > 1 else F.lit(0)
        parent = F.when(F.col("level") == k, F.when((mine > later) & (mine >= F.col("opened")), mine)).otherwise(parent)
    return rows.withColumn("parent_no", parent).drop(*last, "opened")


def parse_structure(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(node_id, doc_id, level, number, title, text, page_start, page_end, parent_id, path_titles, ord) of pages."""
    rows = clause_lines(without_contents(lines_of(pages), config.toc_gap))
    piece = F.when(F.col("number").isNotNull(), F.nullif(F.col("rest"), F.lit(""))).otherwise(trimmed(F.col("line")))
    texts = F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("seq", piece.alias("x")))))
    nodes = rows.groupBy("doc_id", "clause_no").agg(
        F.max("number").alias("number"), F.max("level").alias("level"), F.max(F.when(F.col("number").isNotNull(), F.col("appendix"))).alias("appendix"),
        F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"),
        trimmed(F.array_join(F.transform(texts, lambda t: t["x"]), " ")).alias("text"),
    )
    tree = nodes.filter(F.col("clause_no") > 0)
    # The preamble stands first but was numbered last; it keeps its first page only.
    total = nodes.groupBy("doc_id").agg(F.max("clause_no").alias("n"))
    preamble = nodes.filter((F.col("clause_no") == 0) & (F.length("text") >= config.min_preamble_chars)).join(total, "doc_id")
    preamble = preamble.select("doc_id", F.lit(0).cast("long").alias("clause_no"), F.lit(None).cast("string").alias("number"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("appendix"), "page_start", F.col("page_start").alias("page_end"), "text", (F.col("n") + 1).alias("id_no"))
    tree = tree.select("doc_id", "clause_no", "number", "level", "appendix", "page_start", "page_end", "text", F.col("clause_no").alias("id_no"))
    rows = tree.unionByName(preamble)
    first = F.get(F.split("text", r"(?U)(?<=[.;])\s", 2), F.lit(0))
    title = F.when((F.col("text") != "") & looks_like_title(first), trimmed(first))
    rows = rows.withColumn("title", F.coalesce(title, F.when(F.col("number").isNull(), F.lit(PREAMBLE_TITLE))))
    rows = rows.withColumn("node_id", F.concat("doc_id", F.lit("#"), F.col("id_no").cast("string"), F.lit(":"), F.coalesce("number", F.lit("preamble"))))
    numbered = F.concat(F.when(F.col("level") >= 1, "п. ").otherwise("Раздел "), "number", F.coalesce(F.concat(F.lit(". "), "title"), F.lit("")))
    rows = rows.withColumn("label", F.coalesce(numbered, "title"))
    # A clause of the level above is still open if nothing of a lower level came after it; the same holds for its own
    # parent, so all ancestors can be read off the last clauses of each level before a node, without a join.
    before = W.partitionBy("doc_id").orderBy("clause_no").rowsBetween(W.unboundedPreceding, -1)
    facts = F.struct(F.col("clause_no").alias("no"), "label", "node_id")
    rows = rows.withColumns({f"a{k}": F.last(F.when((F.col("level") == k) & F.col("number").isNotNull(), facts), ignorenulls=True).over(before) for k in range(LEVELS - 1)})
    rows = rows.withColumn("opened", F.min("clause_no").over(W.partitionBy("doc_id", "appendix")))
    no = lambda k: F.coalesce(F.col(f"a{k}.no"), F.lit(0))
    open_ = [(no(k) >= F.col("opened")) & (no(k) > F.greatest(F.lit(0), F.lit(0), *[no(i) for i in range(k)])) for k in range(LEVELS - 1)]
    path, parent_id = F.array("label"), F.lit(None).cast("string")
    for level in range(1, LEVELS):
        chain, alive = [F.col("label")], F.lit(True)
        for k in range(level - 1, -1, -1):
            alive = alive & open_[k]
            chain.insert(0, F.when(alive, F.col(f"a{k}.label")))
        own = F.col("level") == level
        path = F.when(own, F.filter(F.array(*chain), lambda x: x.isNotNull())).otherwise(path)
        parent_id = F.when(own, F.when(open_[level - 1], F.col(f"a{level - 1}.node_id"))).otherwise(parent_id)
    path = rows.withColumns({"path": path, "parent_id": parent_id})
    prefix = F.when(F.col("appendix") > 0, F.array(F.concat(F.lit("Приложение № "), F.col("appendix").cast("string")))).otherwise(F.array().cast("array<string>"))
    return path.select(
        "node_id", "doc_id", F.col("level").cast("int").alias("level"), "number", "title", "text", "page_start", "page_end", "parent_id",
        F.concat(prefix, "path").alias("path_titles"), F.col("clause_no").alias("ord"),
    )


def node_label() -> Column:
    return citation_label(F.col("level"), F.col("number"), F.col("title"), F.col("node_id"))
