import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tessera import queries
from tessera.config import DEFAULT, Config
from tessera.operators import answering, catalog, chunking, cleaning, evaluation, history, ranking, reporting, search, structure
from tessera.runtime import spool


def pages(spark, *texts, doc="d"):
    return spark.createDataFrame([(doc, i + 1, t) for i, t in enumerate(texts)], "doc_id string, page_no int, text string")


def test_running_lines(spark):
    body = [f"ОБЩИЙ ЗАГОЛОВОК\n{i}\nстрока {i}\n{i}" for i in range(1, 5)]
    out = [r.text for r in cleaning.clean_pages(pages(spark, *body)).orderBy("page_no").collect()]
    assert out == [f"{i}\nстрока {i}" for i in range(1, 5)]  # the number below the running line is not on the edge
    out = [r.text for r in cleaning.clean_pages(pages(spark, *body[:3])).orderBy("page_no").collect()]
    assert all("ОБЩИЙ ЗАГОЛОВОК" in t for t in out)  # too few pages to tell


def test_page_gaps_and_reading_order(spark):
    df = spark.createDataFrame([("d", 1, "a"), ("d", 3, "c")], "doc_id string, page_no int, text string")
    assert [(r.page_no, r.text) for r in cleaning.page_gaps(df).orderBy("page_no").collect()] == [(1, "a"), (2, ""), (3, "c")]
    boxes = spark.createDataFrame([([(0.5, 0.9, "b"), (0.1, 0.9, "a"), (0.1, 0.2, "c")],)], "b array<struct<x: double, y: double, text: string>>")
    assert boxes.select(cleaning.reading_order(F.col("b")).alias("t")).first().t == "a\nb\nc"


def test_contents_end_at_a_gap(spark):
    for gap, kept in ((25, False), (26, True)):
        text = "\n".join(["Содержание", "Раздел ..... 1", *["x"] * gap, "Раздел ..... 2", "тело"])
        lines = [r.line for r in structure.without_contents(cleaning.lines_of(pages(spark, text))).orderBy("seq").collect()]
        assert lines == (["x"] * gap if kept else []) + ["тело"]


def test_structure_of_a_page(spark):
    text = "Преамбула достаточно длинная, чтобы стать узлом дерева.\n1. Общие положения\n1.1. Первый пункт.\nпродолжение\n1.1.1. Глубже\n2. Второй\n1. сноска\n2.1.1. Без родителя\nПриложение № 1\n1. Снова\n1.1. Вложен"
    rows = {r.node_id: r for r in structure.parse_structure(pages(spark, text)).collect()}
    assert set(rows) == {"d#8:preamble", "d#1:1", "d#2:1.1", "d#3:1.1.1", "d#4:2", "d#5:2.1.1", "d#6:1", "d#7:1.1"}
    assert rows["d#3:1.1.1"].parent_id == "d#2:1.1" and rows["d#5:2.1.1"].parent_id is None and rows["d#7:1.1"].parent_id == "d#6:1"
    assert rows["d#2:1.1"].text == "Первый пункт. продолжение" and rows["d#4:2"].text == "Второй 1. сноска"
    assert rows["d#3:1.1.1"].path_titles == ["Раздел 1. Общие положения", "п. 1.1", "п. 1.1.1. Глубже"]
    assert rows["d#7:1.1"].path_titles[0] == "Приложение № 1"
    assert rows["d#8:preamble"].title == "Вводная часть" and rows["d#8:preamble"].ord == 0


def test_structure_equals_a_sequential_reading(spark):
    rng = random.Random(4)
    docs, want = [], {}
    for d in range(60):
        lines = []
        for _ in range(rng.randint(1, 25)):
            kind = rng.random()
            if kind < 0.1:
                lines.append("Приложение № 7")
            elif kind < 0.3:
                lines.append("текст")
            else:
                lines.append(".".join(str(rng.randint(1, 4)) for _ in range(rng.randint(1, 5))) + ". пункт")
        docs.append((f"d{d}", 1, "\n".join(lines)))
        highest = appendix = n = 0
        open_ = {}
        for x in lines:
            if x.startswith("Прил"):
                appendix, highest, open_ = appendix + 1, 0, {}
                continue
            m = re.match(r"^(\d+(?:\.\d+)*)\. ", x)
            if not m:
                continue
            level = m[1].count(".")
            if level == 0:
                if int(m[1]) < highest and not appendix:
                    continue
                highest = max(highest, int(m[1]))
            n += 1
            want[f"d{d}", n] = open_.get(level - 1)
            open_ = {k: v for k, v in open_.items() if k < level} | {level: n}
    df = spark.createDataFrame(docs, "doc_id string, page_no int, text string")
    nodes = structure.parse_structure(df, Config(min_preamble_chars=10**6)).collect()
    number = lambda i: int(re.search(r"#(\d+):", i)[1]) if i else None
    assert {(r.doc_id, r.ord): number(r.parent_id) for r in nodes} == want
    clauses = structure.clause_lines(structure.without_contents(cleaning.lines_of(df))).filter("number is not null")
    assert {(r.doc_id, r.clause_no): r.parent_no for r in structure.parents(clauses).collect()} == want


def test_windows_equal_a_sequential_fold(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["слово ", "два. ", "три; ", "x: ", "длинноеслово"]) for _ in range(rng.randint(0, 60))).strip() for _ in range(150)]

    def model(text, target, overlap):
        if len(text) <= target:
            return [text]
        out, cur = [], ""
        for s in re.split(r"(?<=[.;:])\s+", text):
            if cur and len(cur) + len(s) + 1 > target:
                out.append(cur.strip())
                cur = (cur[-overlap:] + " " + s).strip()
            else:
                cur = (cur + " " + s).strip()
        return out + ([cur.strip()] if cur.strip() else [])

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.w for r in df.select("i", chunking.sentence_windows(F.col("t"), 60, 12).alias("w")).orderBy("i").collect()]
    assert got == [model(t, 60, 12) for t in texts]


def test_chunks_fall_back_to_pages(spark):
    meta = spark.createDataFrame([("d", "Правила", "rules", None, None), ("e", "Устав", "charter", None, None)], "doc_id string, title string, doc_type string, source_url string, effective_date date")
    body = pages(spark, "1. Раздел\n1.1. Достаточно длинный текст пункта, чтобы он вошёл.").unionByName(pages(spark, "Сплошной текст без номеров, который всё же нужен.", doc="e"))
    rows = {r.chunk_id: r for r in chunking.chunk_documents(meta, structure.parse_structure(body), body).collect()}
    assert set(rows) == {"d#2:1.1:0", "e#1:preamble:0"}
    assert rows["d#2:1.1:0"].text.startswith("Правила ▸ Раздел 1. Раздел ▸ п. 1.1: Достаточно") and rows["d#2:1.1:0"].clause == "1.1"
    rows = {r.chunk_id: r for r in chunking.chunk_documents(meta, structure.parse_structure(body).filter("doc_id = 'd'"), body).collect()}
    assert rows["e#p1:0"].section_path == "стр. 1" and rows["e#p1:0"].parent_text.startswith("Сплошной")


def test_contexts_equal_a_sequential_choice(spark):
    rng = random.Random(5)
    rows = [(q, f"d{rng.randint(1, 3)}", rng.choice([None, "", "1.1", "1.2"]), f"c{i}", float(rng.choice([-6, -5, -3, -1, 0, 1, 1, 2])) - (6 if q % 5 == 0 else 0), i + 1) for q in range(60) for i in range(rng.randint(1, 14))]
    df = spark.createDataFrame(rows, "question_id int, doc_id string, clause string, chunk_id string, score double, fused_rank int")
    got = {}
    for r in ranking.select_contexts(df).orderBy("question_id", "position").collect():
        got.setdefault(r.question_id, []).append(r.chunk_id)
    for q in range(60):
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[4], r[5]))
        seen, kept = set(), []
        for r in own:
            k = (r[1], r[2] or r[3])
            if k not in seen and r[4] >= 0 and len(kept) < 6:
                kept.append(r[3])
            seen.add(k)
        if not kept and own[0][4] >= -4:
            kept = [own[0][3]]
        assert got.get(q, []) == kept[::2] + kept[1::2][::-1]


def test_search_and_fusion(spark):
    chunks = spark.createDataFrame([("a", "срок подачи заявки"), ("b", "размер платы"), ("c", "срок платы и размер")], "chunk_id string, text string")
    weights = search.document_weights(search.postings(chunks, "chunk_id", "text"), "chunk_id", 3)
    asked = spark.createDataFrame([(1, "Размер платы?"), (2, "нет таких слов")], "question_id long, question string")
    hits = search.sparse_search(asked, weights, 5)
    assert [(r.question_id, r.chunk_id) for r in hits.orderBy("question_id", "rank").collect()] == [(1, "b"), (1, "c")]
    vectors = chunks.select("chunk_id", search.hashed_embedding(F.col("text"), 32).alias("dense"))
    asked = asked.withColumn("dense", search.hashed_embedding(F.col("question"), 32))
    near = search.dense_search(asked, vectors, 1).filter("question_id = 1").first()
    assert near.chunk_id == "b" and abs(near.score - 1) < 1e-6
    assert search.dense_search(asked, vectors, 3, broadcast_rows=1).count() == 6  # in blocks
    fused = search.fuse([hits, search.dense_search(asked, vectors, 3)], 2).filter("question_id = 1").orderBy("rank").collect()
    assert fused[0].chunk_id == "b" and abs(fused[0].score - 2 / 61) < 1e-9


def test_sparse_lists_are_cut_where_scores_are_made(spark):
    n, k = 60, 3
    texts = spark.createDataFrame([(f"c{i:03d}", " ".join(["и"] * (1 + i % 4) + [f"w{i % 7}", f"u{i % 20}"])) for i in range(n)] + [("z", "")], "chunk_id string, text string")
    asked = spark.createDataFrame([(q, f"и w{q % 7} x{q}") for q in range(40)] + [(99, "нет"), (98, "u3")], "question_id long, question string")
    weights = spool(search.text_weights(texts.repartition(5), "chunk_id", "text").orderBy(F.rand(1)), "weights")
    scores: dict[int, dict[str, float]] = {}
    for w in search.asked_terms(asked).join(weights, "term").collect():
        own = scores.setdefault(w.question_id, {})
        own[w.chunk_id] = own.get(w.chunk_id, 0) + w.asked * w.weight
    full = {q: sorted(((-round(s, 9), c) for c, s in own.items()))[:k] for q, own in scores.items()}
    for more in ({}, {"broadcast_rows": 7}, {"lists": 1}):
        got: dict[int, list] = {}
        for r in search.sparse_search(asked, weights, k, **more).orderBy("question_id", "rank").collect():
            got.setdefault(r.question_id, []).append((-r.score, r.chunk_id))
        assert got == full  # ties go to the smaller id
    lists = spool(search.sparse_lists(search.asked_terms(asked), weights, k, lists=2, block=30), "lists")
    assert {(r.question_id, -r.score, r.chunk_id) for r in search.top_k(lists, k).collect()} == {(q, *x) for q, own in full.items() for x in own}
    assert lists.count() <= 2 * k * 41 < sum(map(len, scores.values())) / 5


def test_dense_lists_are_cut_where_scores_are_made(spark):
    n, k = 50, 3
    vectors = spark.createDataFrame([(i, [float(i % 5 + 1), float(i % 3)] + [1.0] * (i % 2)) for i in range(n)] + [(90, [0.0, 0.0]), (91, None)], "vec_id int, dense array<float>").repartition(10)
    asked = vectors.filter("vec_id % 2 = 0 or vec_id > 40").select(F.col("vec_id").alias("question_id"), "dense")
    given = {r.vec_id: [float(x) for x in r.dense] for r in vectors.filter("vec_id < 90").collect()}
    cosine = lambda x, y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    full = {(q, i, r + 1) for q in given if q % 2 == 0 or q > 40 for r, (_, i) in enumerate(sorted((-round(cosine(given[q], v), 6), i) for i, v in given.items() if len(v) == len(given[q]))[:k])}
    for more in ({}, {"lists": 2}, {"broadcast_rows": 11}):
        assert {(r.question_id, r.vec_id, r["rank"]) for r in search.dense_search(asked, vectors, k, "vec_id", places=6, **more).collect()} == full
    assert search.dense_lists(asked, vectors, k, "vec_id", places=6, lists=2).count() <= 2 * len(full)


def test_hybrid_search_makes_no_row_for_a_pair(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"и w{i % 3}") for i in range(9)], "chunk_id string, text string")
    asked = spark.createDataFrame([(q, f"и w{q}") for q in range(3)], "question_id long, question string").withColumn("dense", search.hashed_embedding(F.col("question"), 16))
    vectors = chunks.select("chunk_id", search.hashed_embedding(F.col("text"), 16).alias("dense"))
    hits = search.hybrid_search(asked, search.text_weights(chunks, "chunk_id", "text"), vectors, 2, documents=9)
    assert hits._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2  # sparse scores as well as dense ones
    got = [(r.question_id, r.chunk_id) for r in hits.orderBy("question_id", "rank").collect()]
    assert got == [(q, f"c{i}") for q in range(3) for i in (q, q + 3)]


def test_texts_are_taken_apart_once_for_frequencies_and_lists(spark):
    n, k = 60, 3
    texts = spark.createDataFrame([(f"c{i:03d}", " ".join(["и"] * (1 + i % 4) + [f"w{i % 7}", f"u{i % 20}"])) for i in range(n)] + [("z", "")], "chunk_id string, text string")
    asked = spark.createDataFrame([(q, f"и w{q % 7} x{q}") for q in range(40)] + [(99, "нет"), (98, "u3")], "question_id long, question string")
    weights = search.text_weights(texts.repartition(5), "chunk_id", "text")
    rows = weights.collect()
    df = Counter(w.term for w in rows)
    scores: dict[int, dict[str, float]] = {}
    for a in search.asked_terms(asked).collect():
        for w in rows:
            if w.term == a.term:
                own = scores.setdefault(a.question_id, {})
                own[w.chunk_id] = own.get(w.chunk_id, 0) + a.asked * math.log(1 + n / df[a.term]) * w.weight
    full = {q: sorted(((-round(s, 9), c) for c, s in own.items()))[:k] for q, own in scores.items()}
    for more in ({}, {"broadcast_rows": 7}, {"lists": 1}):
        hits = search.sparse_search(asked, weights, k, documents=n, **more)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan and "regexp" not in plan  # the stored postings are read instead
        got: dict[int, list] = {}
        for r in hits.orderBy("question_id", "rank").collect():
            got.setdefault(r.question_id, []).append((-r.score, r.chunk_id))
        assert got == full  # ties go to the smaller id
    held = search.folded(weights, search.asked_terms(asked))
    assert sorted(r.chunk_id for r in held.collect()) == sorted(f"c{i:03d}" for i in range(n))  # a row a text
    for rows_ in (1, 50, 1_000_000):  # tables of texts of some size
        parts = list(search.stored_texts(held.toArrow().to_batches(max_chunksize=7), "chunk_id", pa.array(["u3", "и"]), rows_))
        assert sorted((ids[t].as_py(), int(w)) for ids, text, no, _ in parts for t, w in zip(text, no)) == sorted([(f"c{i:03d}", 1) for i in range(n)] + [(f"c{i:03d}", 0) for i in range(n) if i % 20 == 3])
        assert sum(len(ids) for ids, *_ in parts) == n


def test_chunks_of_stored_rows_only(spark, tmp_path):
    rows = [("a", "x"), ("a", "x"), ("b", "y"), ("c", ""), (None, "z"), ("d", "w")]
    spark.createDataFrame(rows, "chunk_id string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    of = spark.createDataFrame([(1, "a"), (2, "a"), (2, "d"), (2, "c")], "question_id long, chunk_id string")
    for most in (1_000_000, 1):
        wanted = queries._chunks(spark, str(tmp_path), of, broadcast_rows=most)
        assert sorted(map(tuple, wanted.collect())) == [("a", "x"), ("d", "w")]
    assert queries._chunks(spark, str(tmp_path)).count() == 3


def test_citations(spark):
    answers = spark.createDataFrame([(1, "да [2] и [2] [9]"), (2, "без ссылок"), (3, "[0]")], "question_id int, answer string")
    contexts = spark.createDataFrame([(q, p, f"d{p}", "t", "") for q in (1, 2, 3) for p in (0, 1)], "question_id int, position int, doc_id string, text string, parent_text string")
    rows = answering.citations(answers, contexts).orderBy("question_id", "ord").collect()
    assert [(r.question_id, r.marker, r.doc_id) for r in rows] == [(1, "[2]", "d1"), (2, "[1]", "d0"), (2, "[2]", "d1"), (3, "[1]", "d0"), (3, "[2]", "d1")]


def test_routes(spark):
    df = spark.createDataFrame([("О чём эти документы?",), ("Какие документы загружены?",), ("Что ты умеешь?",), ("Какой срок оплаты?",), (None,)], "q string")
    assert [r.r for r in df.select(answering.route(F.col("q")).alias("r")).collect()] == ["about", "meta", "meta", "retrieve", "retrieve"]


def test_versions_and_manifests(spark):
    c = spark.createDataFrame([(1, "/f/rules_protokol_12_01.02.2020.pdf", "Правила"), (2, "/f/rules_protokol_30.pdf", ""), (3, "/f/x.pdf", "Тарифы банка"), (4, "/f/none.pdf", "")], "i int, url string, link_text string")
    fam = spark.createDataFrame([(1, "rules", "rules|правил", True), (2, "tariffs", "тариф", False)], "ord int, family_key string, pattern string, target boolean")
    rows = catalog.rank_versions(catalog.match_families(catalog.with_facts(c), fam, "i"), ["i"])
    assert {(r.i, r.family, r.version, r.versions) for r in rows.collect()} == {(2, "rules", 1, 2), (1, "rules", 2, 2), (3, "tariffs", 1, 1)}
    assert catalog.rank_versions(catalog.match_families(catalog.with_facts(c), fam, "i"), ["i"], families=fam).count() == 2
    have = rows.withColumn("available", F.col("i") != 2)
    assert {(r.family, r.i) for r in catalog.latest_available(have).collect()} == {("rules", 1), ("tariffs", 3)}
    old = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, seq int")
    new = spark.createDataFrame([("a", 1)], "doc_id string, seq int")
    assert [r.doc_id for r in catalog.upsert_manifest(old, new).orderBy("seq").collect()] == ["b", "a"]
    assert [r.doc_id for r in catalog.merge_manifest(new, old).orderBy("seq").collect()] == ["a", "b"]


def test_evaluation_without_denominators(spark):
    g = spark.createDataFrame([(1, None, "unanswerable", None)], "question_id int, doc string, type string, clause string")
    a = spark.createDataFrame([(1, False)], "question_id int, grounded boolean")
    c = spark.createDataFrame([], "question_id int, doc_id string, clause string")
    assert evaluation.summarize(evaluation.judge(g, a, c)).first().asDict() == {"total": 1, "answerable": 0, "grounding_accuracy": 1.0, "doc_hit_rate": None, "clause_hit_rate": None}


def test_slides(spark):
    rows = [(1, 0, "table", "t", ["", "a [1]"], [["x", "y"], ["1", "2"]]), (1, 1, "table", "u", [], [["x"], ["1", "2"]]), (1, 2, "odd", "v", ["b"], None), (1, 3, "bullets", "w", [" "], None)]
    df = spark.createDataFrame(rows, "question_id int, slide_no int, layout string, title string, bullets array<string>, rows array<array<string>>")
    out = {r.title: r for r in reporting.valid_slides(df).collect()}
    assert set(out) == {"t", "u", "v"} and out["t"].layout == "table" and out["u"].layout == "bullets" and out["u"].bullets == ["x", "1", "2"] and out["v"].layout == "bullets"


def test_progress_and_sessions(spark):
    e = spark.createDataFrame([(1, "d", "parse", "start", 1, 4), (2, "d", "parse", "run", 2, 4), (3, "d", "receive", "done", None, None)], "ts int, doc_id string, stage string, status string, done int, total int")
    assert abs(history.progress(e).first().progress - (0.02 + 0.38 / 2)) < 1e-6
    s = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "id string, updated int, title string")
    assert [(r.id, r.title) for r in history.latest_sessions(s, "id", "updated").collect()] == [("a", "y"), ("b", "z")]
    assert DEFAULT.child_chars == 1330 and DEFAULT.overlap_chars == 224 and DEFAULT.parent_chars == 4900
