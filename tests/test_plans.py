import shutil

import pytest
from pyspark.sql import functions as F

from tessera.plans import corpus
from tessera.plans.engine import Engine, Models


def test_scrape_takes_the_latest_version_that_can_be_had(spark):
    html = '<a href="/f/rules_protokol_12.pdf">Правила</a><a href="/f/rules_protokol_30.pdf">Правила</a><a href="/f/tarif.pdf">Тарифы</a>'
    pages = spark.createDataFrame([(1, "/a/", html), (2, "/b/", html)], "ord int, url string, html string")
    families = spark.createDataFrame([(1, "rules", "Правила", "rules", "rules", True), (2, "tariffs", "Тарифы", "tariff", "tarif", False)], "ord int, family_key string, title string, doc_type string, pattern string, target boolean")
    dry = corpus.scrape(pages, families).collect()
    assert [(r.doc_id, r.protocol, r.versions, r.source_page) for r in dry] == [("rules", 30, 2, "/a/")]
    available = spark.createDataFrame([("/f/rules_protokol_12.pdf",), ("/f/tarif.pdf",)], "url string")
    rows = corpus.scrape(pages, families, available, include=["rules", "tariffs"]).collect()
    assert {(r.doc_id, r.protocol) for r in rows} == {("rules", 12), ("tariffs", None)}


def test_ingest_and_corpus_questions(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/s")
    manifest = spark.createDataFrame([("d", "Правила", "rules", None, None)], "doc_id string, title string, doc_type string, url string, doc_date date")
    parsed = spark.createDataFrame([("d", ["1. Срок\n1.1. Срок подачи заявки составляет пять дней со дня обращения."]), ("x", ["y"])], "doc_id string, page_texts array<string>")
    assert corpus.ingest(engine, manifest, parsed).first().documents == 1
    asked = spark.createDataFrame([(1, "Какие документы загружены?"), (2, "О чём эти документы?")], "question_id long, question string")
    rows = {r.question_id: r for r in engine.ask(asked)[0].collect()}
    assert rows[1].grounded and rows[1].answer == "1 документов" and rows[2].grounded and rows[2].route == "about"
    lines = {r.route: r.line for r in engine.corpus().collect()}
    assert lines["meta"] == "• Правила — Правила, 1 стр."
    assert lines["about"].startswith("• Правила (Правила, 1 стр.) — 1. Срок 1.1. Срок подачи заявки")


def _added(spark, engine, *docs):
    meta = spark.createDataFrame([(d, f"T{d}", "rules", None, None) for d, _ in docs], "doc_id string, title string, doc_type string, source_url string, effective_date date")
    return engine.add(meta, spark.createDataFrame([(d, [t]) for d, t in docs], "doc_id string, page_texts array<string>"))


def test_documents_are_replaced_removed_and_followed(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/s")
    _added(spark, engine, ("a", "1. Один\n1.1. Первый вариант текста, который достаточно длинный."), ("b", "1. Два\n1.1. Совсем другой текст про плату за хранение бумаг."))
    before = {r.chunk_id for r in engine.store.read("weights").filter("doc_id = 'b'").collect()}
    assert _added(spark, engine, ("a", "1. Один\n1.1. Новый вариант текста, который достаточно длинный.")).first().asDict() == {"documents": 2, "chunks": 2}
    assert engine.store.snapshots("chunks")[-1].endswith("-change")  # no rewrite for one document
    assert {r.chunk_id for r in engine.store.read("weights").filter("doc_id = 'b'").collect()} == before
    assert engine.store.read("chunks").filter("text like '%Первый%'").count() == 0
    with pytest.raises(ValueError):
        _added(spark, engine, ("a", ""))
    assert {(r.doc_id, r.error) for r in engine.store.read("ingests").collect()} == {("a", "no chunks"), ("b", None)}
    assert engine.store.read("chunks").filter("doc_id = 'a'").count() == 1  # the index keeps what it had
    events = engine.store.read("events")
    assert events.filter("doc_id = 'a' and stage = 'chunk' and status = 'error'").count() == 1
    assert {r.doc_id: r.progress for r in engine.progress().collect()}["b"] == 1.0
    pages, nodes = engine.parse(spark.createDataFrame([("a", [""])], "doc_id string, page_texts array<string>"))
    only = spark.createDataFrame([("a",)], "doc_id string")
    assert engine.index(engine.store.read("meta"), nodes, pages, only).first().asDict() == {"documents": 1, "chunks": 1}
    assert engine.remove(["b"]).first().chunks == 0
    assert all(engine.store.read(t).filter("doc_id = 'b'").count() == 0 for t in ("meta", "manifest", "nodes", "pages", "weights", "vectors"))
    assert engine.status()["documents"] == 1 and engine.health() == {"status": "ok", "index": True, "model": True}


def test_many_documents_at_once(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/s")
    ids = spark.range(10_001).select(F.col("id").cast("string").alias("doc_id"))
    meta = ids.select("doc_id", F.col("doc_id").alias("title"), F.lit("rules").alias("doc_type"), F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("date").alias("effective_date"))
    docs = ids.select("doc_id", F.array(F.concat(F.lit("1. Раздел\n1.1. Текст пункта, который достаточно длинный, номер "), "doc_id")).alias("page_texts"))
    assert engine.add(meta, docs).first().asDict() == {"documents": 10_001, "chunks": 10_001}


def test_history_and_models(spark, tmp_path):
    tries = []

    def write(asked, contexts):
        tries.append(asked.count())
        return asked.select("question_id", F.lit("" if len(tries) == 1 else "Ответ по делу [1]. Ещё фраза.").alias("answer"))

    def deck(rows, cited, strict):
        text = '{"Слайды": [{"Заголовок": "Т", "тезисы": ["раз [1]", " "], "макет": "x"}]}' if strict else "no json"
        return rows.select("question_id", F.lit(text).alias("deck"))

    engine = Engine(spark, f"file://{tmp_path}/s", model=Models(write=write, deck=deck))
    _added(spark, engine, ("a", "1. Один\n1.1. Размер платы за хранение составляет сто рублей в месяц."))
    asked = spark.createDataFrame([(1, "Размер платы за хранение?")], "question_id long, question string")
    trace = {}
    assert engine.ask(asked, trace)[0].first().answer.startswith("Ответ") and tries == [1, 1]
    assert set(trace) == {"t_search_ms", "t_rerank_ms", "t_generate_ms"}
    slides, _ = engine.deck(asked)
    assert [(r.title, r.layout, r.bullets) for r in slides.collect()] == [("Т", "bullets", ["раз"])]
    records, made = engine.preview("report", asked, "Справка")
    record = records.first()
    assert record.kind == "report" and record.grounded and record.n_citations == 1 and made.count() == engine.generated(record.id).count()
    with pytest.raises(LookupError):
        engine.generated("none")
    shutil.rmtree(record.path.removeprefix("file://"))
    with pytest.raises(FileNotFoundError):
        engine.generated(record.id)
    assert engine.forget(record.id) and not engine.forget(record.id) and engine.history().count() == 1
    with pytest.raises(ValueError):
        Engine(spark, "x", model="unheard").models


def test_health_never_raises(spark, tmp_path):
    def dead():
        raise OSError

    assert Engine(spark, f"file://{tmp_path}/none").health()["status"] == "degraded"
    assert Engine(spark, "nosuch://x").health()["status"] == "degraded"
    assert Engine(spark, f"file://{tmp_path}/none", model=Models(alive=dead)).health() == {"status": "degraded", "index": False, "model": False}


def test_requests_and_uploads(spark):
    df = spark.createDataFrame([(" ", None, "a.PDF", 1), ("q", "gpt", "a.txt", 1), ("q", "m", "a.pdf", 0), ("q", None, "a.pdf", 10**9)], "q string, m string, f string, n long")
    rows = df.select(corpus.request_error(F.col("q"), F.col("m"), ["m"]).alias("r"), corpus.upload_error(F.col("f"), F.col("n")).alias("u")).collect()
    assert [tuple(r) for r in rows] == [("empty question", None), ("unknown model", "not a .pdf file"), (None, "empty file"), (None, "file too large")]
