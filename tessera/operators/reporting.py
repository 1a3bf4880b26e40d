"""Answers as report blocks and slides, ready to be rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.text import clean_bullet, clean_cell, ellipsis, lenient_json, normal_keys, paragraphs


def report_blocks(answers: DataFrame, citations: DataFrame, title: str, subject: Column | None = None, extracts: bool = False) -> DataFrame:
    """(question_id, ord, kind, text): title, subject, paragraphs, extracts if wanted, a row for each source, a disclaimer."""
    part = lambda rows, n, kind, text, pos: rows.select("question_id", F.lit(n).alias("section"), pos.cast("int").alias("pos"), F.lit(kind).alias("kind"), text.alias("text"))
    zero = F.lit(0)
    parts = [part(answers, 0, "title", F.lit(title), zero), part(answers, 1, "subject", F.col("question") if subject is None else subject, zero)]
    body = answers.select("question_id", F.posexplode(paragraphs(F.col("answer"))).alias("pos", "text"))
    parts.append(part(body, 2, "paragraph", F.col("text"), F.col("pos")))
    if extracts:
        parts.append(part(citations, 3, "extract", ellipsis(F.col("snippet")), F.col("ord")))
    source = F.concat_ws(" | ", "marker", "doc_title", "clause", F.col("page").cast("string"), ellipsis(F.col("snippet")))
    parts.append(part(citations, 4, "source", source, F.col("ord")))
    parts.append(part(answers, 5, "disclaimer", F.lit("Ответ составлен автоматически по приведённым источникам."), zero))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order = F.array_sort(F.collect_list(F.struct("section", "pos", "kind", "text")))
    return rows.groupBy("question_id").agg(order.alias("b")).select("question_id", F.posexplode("b").alias("ord", "x")).select("question_id", "ord", "x.kind", "x.text")


def material(answer: Column, snippets: Column) -> Column:
    """An answer and its first four snippets of 400 characters, 2400 in all."""
    parts = F.transform(F.slice(snippets, 1, 4), lambda s: F.left(s, F.lit(400)))
    return F.left(F.array_join(F.concat(F.array(answer), parts), "\n"), F.lit(2400))


def slide_title(paragraph: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(paragraph, r"(?U)\s+", " ")), " ")
    head = F.array_join(F.slice(words, 1, 5), " ")
    return F.left(F.when(F.size(words) > 5, F.concat(head, F.lit("…"))).otherwise(head), F.lit(60))


def fallback_slides(answers: DataFrame, most: int = 5, bullets: int = 4) -> DataFrame:
    """(question_id, slide_no, layout, title, bullets): a slide for each of the first paragraphs, its sentences as bullets."""
    rows = answers.select("question_id", F.posexplode(F.slice(paragraphs(F.col("answer")), 1, most)).alias("slide_no", "p"))
    cut = F.filter(F.transform(F.split("p", r"(?U)(?<=[.!?])\s+"), lambda s: F.left(clean_bullet(s), F.lit(160))), lambda s: s != "")
    return rows.select("question_id", "slide_no", F.lit("bullets").alias("layout"), slide_title(F.col("p")).alias("title"), F.slice(cut, 1, bullets).alias("bullets"))


def valid_slides(slides: DataFrame, most: int = 6) -> DataFrame:
    """Slides (question_id, slide_no, layout, title, bullets, rows) with what cannot be shown taken out.

    Blank bullets go; a table needs two rows of equal width, else its cells become bullets; layouts that are not known
    become bullets; a slide without content goes; the first `most` stay.
    """
    clean = F.filter(F.transform(F.coalesce("bullets", F.array().cast("array<string>")), clean_bullet), lambda b: b != "")
    cells = F.transform(F.filter(F.coalesce("rows", F.array().cast("array<array<string>>")), lambda r: F.exists(r, lambda c: F.trim(c) != "")), lambda r: F.transform(r, clean_cell))
    table = (F.size("rows") >= 2) & (F.size(F.array_distinct(F.transform("rows", lambda r: F.size(r)))) == 1)
    rows = slides.withColumns({"bullets": clean, "rows": cells})
    flat = F.filter(F.flatten("rows"), lambda c: c != "")
    rows = rows.withColumn("is_table", (F.col("layout") == "table") & table)
    layout = F.when(F.col("is_table"), "table").when(F.col("layout") == "two_col", "two_col").otherwise("bullets")
    bullets = F.when((F.col("layout") == "table") & ~F.col("is_table") & (F.size("bullets") == 0), flat).otherwise(F.col("bullets"))
    rows = rows.withColumns({"bullets": bullets, "new_layout": layout})
    rows = rows.filter(F.col("is_table") | (F.size("bullets") > 0)).withColumn("layout", F.col("new_layout"))
    n = F.row_number().over(W.partitionBy("question_id").orderBy("slide_no"))
    return rows.withColumn("n", n).filter(F.col("n") <= most).drop("n", "new_layout", "is_table")


def source_slides(citations: DataFrame, per_slide: int = 7) -> DataFrame:
    """(question_id, page, items): the sources, so many a slide."""
    rows = citations.withColumn("page_no", F.floor(F.col("ord") / per_slide))
    items = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(" ", "marker", "doc_title").alias("x")))), lambda i: i["x"])
    return rows.groupBy("question_id", "page_no").agg(items.alias("items"))


#: The most characters and bullets that go with a size of type.
FONT_STEPS = ((160, 3, 20), (320, 4, 18), (520, 2**31 - 1, 16))
LEAST_FONT = 14


def font_size(bullets: Column) -> Column:
    """Points for the bullets of a slide, from how much there is to show."""
    total, n = F.aggregate(bullets, F.lit(0), lambda n, b: n + F.length(b)), F.greatest(F.lit(1), F.size(bullets))
    size = F.lit(LEAST_FONT)
    for chars, count, points in reversed(FONT_STEPS):
        size = F.when((total <= chars) & (n <= count), points).otherwise(size)
    return size


DECK = "title string, subtitle string, slides array<struct<title string, layout string, bullets array<string>, table array<array<string>>>>"


def deck_slides(decks: DataFrame) -> DataFrame:
    """The slides of decks (question_id, deck: a model's output); what is no JSON object gives none."""
    parsed = F.from_json(normal_keys(lenient_json(F.col("deck"))), DECK)
    rows = decks.select("question_id", F.posexplode(parsed["slides"]).alias("slide_no", "s"))
    return rows.select("question_id", "slide_no", "s.layout", "s.title", "s.bullets", F.col("s.table").alias("rows"))


def whole_deck(decks: DataFrame, answers: DataFrame) -> DataFrame:
    """The valid slides of each answer's deck; answers without any get the slides made of their paragraphs."""
    own = valid_slides(deck_slides(decks))
    rest = answers.join(own.select("question_id").distinct(), "question_id", "left_anti")
    made = fallback_slides(rest).withColumn("rows", F.lit(None).cast("array<array<string>>"))
    return own.unionByName(valid_slides(made))
