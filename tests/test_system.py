import datetime
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import queries as core
from tessera import runtime
from tessera.functions import links as L
from tessera.operators.store import Store
from tessera.plans.engine import Engine, models
from tessera.sources import readers
from tessera.streaming import ingest

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = core.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cur = db.execute(core.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cur.fetchall())


def test_engine_end_to_end(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    docs = spark.createDataFrame([("d1", ["1. Порядок\n1.1. Срок подачи заявки составляет пять дней со дня обращения."]), ("d2", ["1. Плата\n1.1. Размер платы за проверку составляет сто рублей в месяц."])], "doc_id string, page_texts array<string>")
    meta = spark.createDataFrame([("d1", "Правила", "rules", None, None), ("d2", "Тарифы", "tariff", None, None)], "doc_id string, title string, doc_type string, source_url string, effective_date date")
    assert engine.add(meta, docs).first().asDict() == {"documents": 2, "chunks": 2}
    asked = spark.createDataFrame([(1, "Размер платы за проверку?"), (2, "Совершенно посторонние слова xyz")], "question_id long, question string")
    rows, cited = engine.ask(asked)
    got = {r.question_id: r for r in rows.collect()}
    assert got[1].grounded and not got[2].grounded and got[2].answer == engine.config.refusal
    assert [r.doc_id for r in cited.filter("question_id = 1").collect()][0] == "d2"
    golden = spark.createDataFrame([(1, "Размер платы за проверку?", "d2", "fact", "1.1"), (2, "xyz qqq", None, "unanswerable", None)], "question_id long, q string, doc string, type string, clause string")
    assert engine.evaluate(golden).first().asDict() == {"total": 2, "answerable": 1, "grounding_accuracy": 1.0, "doc_hit_rate": 1.0, "clause_hit_rate": 1.0}
    kinds = [r.kind for r in engine.report(asked.filter("question_id = 1"), "Справка").orderBy("ord").collect()]
    assert kinds[0] == "title" and "source" in kinds and kinds[-1] == "disclaimer"
    assert engine.search(asked, doc_types=["rules"]).join(engine.store.read("chunks"), "chunk_id").filter("doc_type <> 'rules'").count() == 0
    assert [r.type for r in engine.ask_stream(asked.filter("question_id = 1")).orderBy("seq").collect()][0] == "contexts"
    assert engine.remove(["d2"]).first().chunks == 1 and engine.status()["points"] == 1
    assert models(spark).filter("is_default").count() == 1


def test_store_replaces_by_snapshots(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    assert store.info("t") == {"exists": False, "points": 0, "status": "missing"}
    rows = lambda *x: spark.createDataFrame(list(x), "chunk_id string, doc_id string")
    store.replace("t", rows(("a", "d"), ("b", "d"), ("c", "e")))
    reader = store.read("t")
    store.replace_documents("t", rows(("z", "d")))
    assert {r.chunk_id for r in store.read("t").collect()} == {"z", "c"} and reader.count() == 3
    store.upsert("t", rows(("c", "f"), ("n", "f")))
    assert {tuple(r) for r in store.read("t").collect()} == {("z", "d"), ("c", "f"), ("n", "f")}
    store.remove_documents("t", ["f"])
    assert store.info("t")["points"] == 1 and len(store.snapshots("t")) == 2


def test_streaming_ingestion_replaces_documents(spark, tmp_path):
    landing, root = f"{tmp_path}/landing", f"file://{tmp_path}/store"
    row = lambda text: spark.createDataFrame([("d", "Правила", "rules", None, datetime.date(2024, 1, 1), [text])], ingest.LANDED)
    row("1. Один\n1.1. Первый вариант текста пункта, он достаточно длинный.").write.mode("append").parquet(landing)
    ingest.start(spark, landing, root, f"{tmp_path}/cp").awaitTermination()
    assert Store(spark, root).read("chunks").filter("text like '%Первый вариант%'").count() == 1
    row("1. Один\n1.1. Второй вариант текста пункта, он достаточно длинный.").write.mode("append").parquet(landing)
    ingest.start(spark, landing, root, f"{tmp_path}/cp").awaitTermination()
    texts = [r.text for r in Store(spark, root).read("chunks").collect()]
    assert len(texts) == 1 and "Второй вариант" in texts[0]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"meta": {"doc_id": "a", "title": "A"}, "page_texts": ["x"], "parser": "ocr"}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "index.json").write_text("[]")
    assert [r.meta.doc_id for r in readers.parsed_documents(spark, str(tmp_path)).collect()] == ["a"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/manifest.json").write_text(json.dumps([{"doc_id": "a", "title": "A"}, {"title": "no id"}]))
    assert readers.manifest(spark, f"{tmp_path}/m/manifest.json").count() == 1
    (tmp_path / "m/golden.json").write_text(json.dumps({"questions": [{"q": "x", "type": "fact"}]}))
    assert readers.golden(spark, f"{tmp_path}/m/golden.json").first().q == "x"
    files = spark.createDataFrame([("a", bytearray(b"one|tiny")), ("b", bytearray(b"bad"))], "doc_id string, content binary")

    def extract(data):
        if data == b"bad":
            raise ValueError("no pages")
        return data.decode().split("|")

    def recognise(_, page):
        if page == 1:
            return "recognised text"
        raise RuntimeError("engine gone")

    rows = {(r.doc_id, r.page_no): r for r in readers.extract_pages(files, extract, recognise).collect()}
    assert rows["a", 1].ocr and rows["a", 1].text == "recognised text" and rows["a", 2].text == "tiny" and "ocr off" in rows["a", 2].warning and "no pages" in rows["b", 1].warning


def test_scans_sources_and_robots(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(b"good")), ("b", bytearray(b"bad"))], "doc_id string, content binary")

    def scan(data):
        if data == b"bad":
            raise ValueError("no")
        return 3, [(1, "text", " x "), (1, "table", [["k", "v"], ["1", None]]), (3, "text", "z"), (3, "table", [])]

    rows = {(r.doc_id, r.page_no): r.text for r in readers.scanned_pages(files, scan, lambda d: ["plain"]).collect()}
    assert rows == {("a", 1): "x\n| k | v |\n|---|---|\n| 1 |  |", ("a", 2): "", ("a", 3): "z", ("b", 1): "plain"}

    def missing():
        raise ImportError("not here")

    assert readers.first_recogniser(missing, lambda: (lambda d, n: "ok"))(b"", 1) == "ok"
    with pytest.raises(RuntimeError):
        readers.first_recogniser(missing)
    (tmp_path / "x.pdf").write_bytes(b"data")
    path = readers.resolve_source(spark, f"{tmp_path}/x.pdf", "d", f"file://{tmp_path}/raw")
    assert open(path.removeprefix("file:"), "rb").read() == b"data"
    assert open(readers.resolve_source(spark, "https://h/x", "e", f"file://{tmp_path}/raw", lambda u: b"net").removeprefix("file:"), "rb").read() == b"net"
    with pytest.raises(FileNotFoundError):
        readers.resolve_source(spark, f"{tmp_path}/none.pdf", "d", f"file://{tmp_path}/raw")
    with pytest.raises(RuntimeError):
        readers.resolve_source(spark, "https://h/x", "d", f"file://{tmp_path}/raw")
    robots = "User-agent: *\nDisallow: /private\nCrawl-delay: 7"
    links = spark.createDataFrame([("https://h/private/a",), ("https://h/a",), (None,)], "url string")
    assert [r.allowed for r in readers.may_fetch(links, robots, "me").collect()] == [False, True, False]
    assert readers.crawl_delay(robots, "me") == 7 and readers.crawl_delay(None, "me") == 3
    delays = spark.range(1, 7).select(L.retry_delay(F.col("id")).alias("d")).collect()
    assert [r.d for r in delays] == [2, 4, 8, 16, 30, 30]


def test_intermediates_are_shared_and_deleted(spark):
    runtime.drop_spools(spark)
    df = runtime.spool(spark.range(5), "five")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path) and runtime.drop_spools(spark) == 1 and not os.path.exists(path)


def test_entry(spark):
    assert core.entry(spark, SF).count() > 0
