"""Routing of questions, prompts, default answers, citations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Config
from tessera.functions.text import is_refusal, markers, short_date, snippet, type_label


@dataclass(frozen=True)
class Locale:
    """Stems by which questions about the corpus itself are told; a deployment brings its own."""

    #: Stems for questions about what the documents are about.
    topics: tuple[str, ...] = ("о чем", "про что", "чему посвящ", "краткое содержан", "кратком содержан", "о содержании", "какая тема", "какие темы", "тематик", "суть документ")
    topic_things: tuple[str, ...] = ("документ", "файл", "материал", "корпус", "база знан")
    #: Phrases and stems for questions about which documents there are.
    lists: tuple[str, ...] = ("список документ", "перечень документ", "сколько документ", "список нормативн", "перечень нормативн", "какие нормативные документ", "что за документ", "список файл", "какие файл")
    things: tuple[str, ...] = ("документ", "файл", "нормативн")
    places: tuple[str, ...] = ("в базе", "базе знаний", "в системе", "загружен", "доступн", "у тебя", "у вас", "ты знаешь", "ты работаешь", "с какими документ", "содержит", "проиндексирован", "в тебе", "по каким документ", "твоя база", "твоей базе")
    abilities: tuple[str, ...] = ("что в базе", "что в системе", "что ты умеешь", "чем ты можешь помочь", "о чем ты можешь", "что ты знаешь", "что вы знаете", "на какие вопросы", "о чем я могу", "что я могу спросить", "что можно спросить", "что можно узнать", "чем ты можешь быть полезен", "что ты можешь", "какие вопросы можно")


def route(question: Column, locale: Locale = Locale()) -> Column:
    """'about', 'meta' or 'retrieve', tried in this order."""
    q = F.concat(F.lit(" "), F.replace(F.lower(question), F.lit("ё"), F.lit("е")), F.lit(" "))
    has = lambda stems: F.exists(F.array(*[F.lit(s) for s in stems]), lambda s: F.contains(q, s))
    about = has(locale.topics) & has(locale.topic_things)
    meta = has(locale.lists) | (has(locale.things) & has(locale.places)) | has(locale.abilities)
    return F.when(about, "about").when(meta, "meta").otherwise("retrieve")


#: How a document is listed.
BULLET, DASH, PAGES, EDITION, SCANNED = "• ", " — ", " стр.", "ред. ", "скан/OCR"


def corpus_listing(meta: DataFrame, parsers: DataFrame | None = None) -> DataFrame:
    """(doc_id, title, line): a line about every document, in the order of titles."""
    rows = meta if parsers is None else meta.join(parsers.select("doc_id", F.contains(F.coalesce("parser", F.lit("")), F.lit("ocr")).alias("scanned")), "doc_id", "left")
    scanned = F.when(F.coalesce(F.col("scanned"), F.lit(False)), F.lit(SCANNED)) if parsers is not None else F.lit(None).cast("string")
    pages = F.when(F.col("n_pages") > 0, F.concat(F.col("n_pages").cast("string"), F.lit(PAGES)))
    edition = F.when(F.col("effective_date").isNotNull(), F.concat(F.lit(EDITION), short_date(F.date_format("effective_date", "yyyy-MM-dd"))))
    facts = F.concat_ws(", ", type_label(F.col("doc_type")), pages, edition, scanned)
    return rows.select("doc_id", "title", F.concat(F.lit(BULLET), "title", F.lit(DASH), facts).alias("line"))


def corpus_summaries(meta: DataFrame) -> DataFrame:
    """(doc_id, title, line, has_summary): a line about the content of every document."""
    pages = F.when(F.col("n_pages") > 0, F.concat(F.lit(", "), F.col("n_pages").cast("string"), F.lit(PAGES))).otherwise(F.lit(""))
    head = F.concat(F.lit(BULLET), "title", F.lit(" ("), type_label(F.col("doc_type")), pages, F.lit(")"))
    summary = F.nullif("summary", F.lit(""))
    return meta.select("doc_id", "title", F.concat(head, F.coalesce(F.concat(F.lit(DASH), summary), F.lit(""))).alias("line"), summary.isNotNull().alias("has_summary"))


def corpus_lines(listing: DataFrame, summaries: DataFrame) -> DataFrame:
    """(route, title, doc_id, line): what the routes 'meta' and 'about' answer with, a row for each document, by title."""
    rows = listing.select(F.lit("meta").alias("route"), "title", "doc_id", "line").union(summaries.select(F.lit("about"), "title", "doc_id", "line"))
    return rows.orderBy("route", "title", "doc_id")


def prompts(questions: DataFrame, contexts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(question_id, prompt): the question and its numbered contexts, in their order."""
    block = F.concat(F.lit("["), (F.col("position") + 1).cast("string"), F.lit("] Документ: "), "doc_title", F.lit("\n"), F.coalesce(F.nullif("parent_text", F.lit("")), F.col("text")))
    blocks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", block.alias("block")))), lambda x: x["block"]), "\n\n")
    shown = contexts.groupBy("question_id").agg(blocks.alias("blocks"))
    rule = f'\n\nОтвечай строго по фрагментам; если ответа нет, верни ровно "{config.refusal}" После каждого факта ставь ссылку [N].'
    return questions.join(shown, "question_id").select("question_id", F.concat(F.lit("ВОПРОС: "), "question", F.lit("\n\nФРАГМЕНТЫ ДОКУМЕНТОВ:\n"), "blocks", F.lit(rule)).alias("prompt"))


def extractive_answers(contexts: DataFrame, sentences: int = 3) -> DataFrame:
    """(question_id, answer): the default writer: the first sentence of each of the best contexts with its marker."""
    body = F.regexp_replace("text", r"(?U)^(?:[^:]*▸)?[^:▸]*:\s+", "")  # without the header
    lead = F.get(F.split(body, r"(?U)(?<=[.!?])\s+(?=\p{Lu})", 2), F.lit(0))
    part = F.concat(lead, F.lit(" ["), (F.col("position") + 1).cast("string"), F.lit("]"))
    rows = contexts.filter(F.col("position") < sentences)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", part.alias("x")))), lambda p: p["x"]), " ")
    return rows.groupBy("question_id").agg(text.alias("answer"))


def grounded(answer: Column, refusal: str) -> Column:
    return (F.length(F.trim(F.coalesce(answer, F.lit("")))) > 0) & ~is_refusal(answer, refusal)


def citations(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """(question_id, ord, marker, position, ...): what each answer cites, in the order of its markers.

    Markers beyond the contexts are none; an answer without any valid one cites all of its contexts.
    """
    sizes = contexts.groupBy("question_id").agg(F.count("*").cast("int").alias("n"))
    rows = answers.join(sizes, "question_id")
    valid = F.filter(markers(F.col("answer")), lambda m: m.between(1, F.col("n")))
    used = F.when(F.size(valid) > 0, valid).otherwise(F.sequence(F.lit(1), F.col("n")))
    marked = rows.select("question_id", F.posexplode(used).alias("ord", "m")).select("question_id", "ord", F.concat(F.lit("["), F.col("m").cast("string"), F.lit("]")).alias("marker"), (F.col("m") - 1).alias("position"))
    facts = contexts.withColumn("snippet", snippet(F.col("parent_text"), F.col("text"))).drop("text", "parent_text")
    return marked.join(facts, ["question_id", "position"])


def answer_events(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """(question_id, seq, type, payload): the contexts, then the answer's words, then the end."""
    sizes = contexts.groupBy("question_id").agg(F.count("*").alias("n"))
    rows = answers.join(sizes, "question_id", "left")
    head = F.array(F.struct(F.lit("contexts").alias("type"), F.coalesce("n", F.lit(0)).cast("string").alias("payload")))
    words = F.transform(F.regexp_extract_all("answer", F.lit(r"\S+\s*"), F.lit(0)), lambda w: F.struct(F.lit("token").alias("type"), w.alias("payload")))
    tail = F.array(F.struct(F.lit("done").alias("type"), F.col("answer").alias("payload")))
    return rows.select("question_id", F.posexplode(F.concat(head, words, tail)).alias("seq", "e")).select("question_id", "seq", "e.type", "e.payload")
