import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import encoding, lexicon, mojibake, near_duplicates, neighbours, packing, pairs, scans, splitting, survivors
from tessera.functions.space import WHITE_SPACE


def found(df):
    return {tuple(r) for r in df.collect()}


# 1. Nearest vectors


def brute(ids, x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -2)
    out = {}
    for i in range(len(ids)):
        best = sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[: min(k, len(ids) - 1)]
        out[ids[i]] = [ids[j] for j in best if s[i, j] >= least]
    return out


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 12), 64))
    return (centres[rng.integers(0, len(centres), n)] + 0.25 * rng.standard_normal((n, 64))).astype(np.float32)


def test_neighbours_equal_brute_force(spark):
    x = vectors(600)
    x[50:90] = x[50]  # forty copies
    x[7] *= 3  # length does not matter
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "id long, dense array<float>, cosine string")
    params = neighbours.ForestParams(least_rows=32, most_rows=32, fit_rows=200, fit_leaf=8, block_rows=40)  # deeper than the sample supports, and in blocks
    got = {}
    for r in neighbours.nearest_vectors(df, "id", "dense", 10, params=params).orderBy("id", "rank").collect():
        if r.cosine >= 0.9:
            got.setdefault(r.id, []).append(r.neighbour)
    want = brute(list(range(600)), x.astype(float), 10, 0.9)
    hits = sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items())
    assert hits >= 0.97 * sum(map(len, want.values()))
    assert got[89] == list(range(50, 60)) and got[50] == list(range(51, 61))


def test_neighbours_recall_without_a_threshold(spark):
    x = vectors(1500, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, dense array<float>")
    rows = neighbours.nearest_vectors(df, "id", "dense", 10).collect()
    want = brute(list(range(1500)), x.astype(float), 10, -1)
    assert all(n == 10 for n in Counter(r.id for r in rows).values())
    assert sum(r.neighbour in want[r.id] for r in rows) >= 0.95 * 15000


def test_recall_is_reached_in_a_deep_forest(spark):
    x = vectors(4000, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, dense array<float>")
    params = neighbours.ForestParams(least_rows=32, most_rows=32, fit_rows=400, fit_leaf=16)
    rows = neighbours.nearest_vectors(df, "id", "dense", 10, params=params).collect()
    want = brute(list(range(4000)), x.astype(float), 10, -1)
    assert sum(r.neighbour in want[r.id] for r in rows) >= 0.93 * 40000


def test_the_queue_yields_every_leaf_once_and_the_own_ones_first():
    x = vectors(300, 6)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = neighbours.Forest(x[:64], 300, neighbours.ForestParams(least_rows=16, most_rows=16, fit_leaf=8))
    assert forest.extra > 0
    own, order = forest.leaves(x), forest.search(x, 10_000)
    assert (np.sort(order, axis=1) == np.arange(forest.p.trees << forest.total)).all()
    assert (np.sort(own, axis=1) == np.sort(order[:, : forest.p.trees], axis=1)).all()


def test_near_equal_vectors_give_k_neighbours_each(spark):
    rng = np.random.default_rng(8)
    x = (rng.standard_normal(64) + 1e-5 * rng.standard_normal((3000, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, dense array<float>")
    lists = neighbours._leaf_lists(df.select(F.lit(0).cast("long").alias("leaf"), F.explode(F.array(F.lit(False), F.lit(True))).alias("is_query"), "id", F.lit(None).cast("binary").alias("vector")).join(
        spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, raw binary"), "id").select("leaf", "is_query", "id", F.col("raw").alias("vector")), 64, 10, 16_384)
    assert lists.agg(F.sum(F.size("near"))).first()[0] == 30_000


@pytest.mark.parametrize("spread", [1e-2, 1e-3])
def test_neighbours_in_a_tight_cluster(spark, spread):
    rng = np.random.default_rng(4)
    x = (rng.standard_normal(64) + spread * rng.standard_normal((300, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, dense array<float>")
    got = found(neighbours.nearest_vectors(df, "id", "dense", 10).select("id", "neighbour"))
    assert got == {(i, j) for i, near in brute(range(300), x.astype(np.float64), 10, 0.9).items() for j in near}


def test_neighbours_edge_cases(spark):
    e = [1.0] + [0.0] * 63
    rows = [(1, e), (1, e), (2, e), (3, None), (4, []), (5, [0.0] * 64), (6, [float("nan")] + e[1:]), (7, [None] + e[1:]), (8, e[:-1]), (None, e), (9, [float("inf")] + e[1:])]
    df = spark.createDataFrame(rows, "id long, dense array<float>")
    assert found(neighbours.nearest_vectors(df, "id", "dense").select("id", "neighbour", "rank")) == {(1, 2, 1), (2, 1, 1)}
    assert neighbours.nearest_vectors(df.filter("id is null and id > 0"), "id", "dense").count() == 0
    assert found(neighbours.similar_pairs(neighbours.nearest_vectors(df, "id", "dense"), 0.9)) == {(1, 2)}


# 2. Splitting


def test_pieces_cover_the_text(spark):
    rng = random.Random(3)
    p = splitting.SplitParams(60, 12)
    for _ in range(300):
        text = "".join(rng.choice(["слово ", "два. ", "три;\n", "\n\n", "x" * 30, "é", "👩‍💼", " "]) for _ in range(rng.randint(0, 40)))
        cut = splitting.spans(text, p)
        assert all(0 < e - s <= 60 for s, e in cut)
        assert (cut[0][0] == 0 and cut[-1][1] == len(text)) if text else not cut
        for (s0, e0), (s1, e1) in zip(cut, cut[1:]):
            assert s0 < s1 <= e0 < e1 and e0 - s1 <= 12


def test_pieces_end_at_boundaries():
    text = "Первое предложение здесь. Второе предложение там. Третье предложение."
    ends = [text[:e] for _, e in splitting.spans(text, splitting.SplitParams(40, 10))]
    assert ends[0].endswith("здесь. ") and ends[1].endswith("там. ")
    assert splitting.spans("x" * 10, splitting.SplitParams(4, 1)) == [(0, 4), (3, 7), (6, 10)]


def test_splitting_edge_cases(spark):
    nbsp = chr(0xA0)
    rows = [("a", "x" * 10, 1), ("b", f" {nbsp}" + "x" * 10 + "\n", 1), ("c", "x" * 11, 1), ("c", "x" * 11, 2), (None, "y" * 11, 1), ("d", None, 1), ("e", "", 1), ("f", nbsp * 20, 1), ("g", "слово " * 40_000, 1)]
    df = spark.createDataFrame(rows, "key string, text string, piece_no int")
    out = splitting.split_oversized(df, ["key"], "text", splitting.SplitParams(10, 3))
    assert {r.key for r in out.select("key").distinct().collect()} == {"c", None, "g"}
    assert found(out.filter("key = 'c'").select("start", "end")) == {(0, 10), (7, 11)}
    assert splitting.split_oversized(df.limit(0), ["key"], "text", splitting.SplitParams(10, 3)).count() == 0


def test_different_texts_of_one_id_keep_their_pieces_and_fields_are_cut_in_one_scan(spark):
    rows = [("a", "x" * 25, None), ("a", "y" * 25, "z" * 45), ("a", "y" * 25, "z" * 45), (None, "w" * 12, "")]
    df = spark.createDataFrame(rows, "id string, text string, parent string")
    p, q = splitting.SplitParams(10, overlap=2), splitting.SplitParams(40, overlap=2)
    got = [tuple(r) for r in splitting.split_fields(df, ["id"], {"text": p, "parent": q}).select("id", "field", "piece_no", "text").collect()]
    assert len(got) == len(set(got)) and {r[3][0] for r in got if r[:2] == ("a", "text")} == {"x", "y"}
    assert sorted(r[2] for r in got if r[1] == "parent") == [0, 1] and {r[3] for r in got if r[0] is None} == {"w" * 10, "w" * 4}


# 3. Survivors


def test_url_paths(spark):
    urls = ["https://A.b:443/x//y%20z.pdf?v=1#p", "/x/y z.pdf", " http://c/x/y%20z.pdf\n", "/x/Y z.pdf", "/a+b.pdf", "/100%zz.pdf", None, "", "/д.pdf", "/%D0%B4.pdf"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r.p for r in df.select(survivors.url_path(F.col("u")).alias("p")).collect()]
    assert got[:3] == ["/x/y z.pdf"] * 3 and got[3:8] == ["/x/Y z.pdf", "/a+b.pdf", "/100%zz.pdf", None, "/"] and got[8] == got[9]


def test_survivors(spark):
    t = "timestamp'2024-01-0{} 00:00:00'".format
    rows = [("p", 1, 5, 1, "a", 10), ("p", 2, 5, 2, "b", None), ("p", 2, 5, 2, "b", None), ("p", 3, 9, None, None, None), ("q", 4, 1, 1, "a", 1), ("r", 5, None, 3, None, None), ("r", 6, None, 3, "z", None), (None, 7, 1, 1, "a", 1)]
    df = spark.createDataFrame(rows, "grp string, id long, trust int, at int, family string, protocol int").withColumn("value", F.lit("clash"))
    got = found(survivors.best_representatives(df, "grp", "id", "trust", "at", ["family", "protocol"]))
    assert got == {(1, "family", 2, "b"), (1, "protocol", 1, "10"), (5, "family", 6, "z")} and t
    assert survivors.best_representatives(df.limit(0), "grp", "id", "trust", "at", ["family"]).count() == 0


def test_undated_values_follow_the_learned_order(spark):
    history = [(f"g{i}", 10 * i + k, 1, k, v) for i in range(5) for k, v in enumerate(["draft", "approved", "final"])]
    undated = [("u", 100, 1, None, "final"), ("u", 101, 1, None, "draft"), ("u", 102, 1, None, "approved")]
    df = spark.createDataFrame(history + undated, "grp string, id long, trust int, at int, state string")
    got = {r.group_id: r.value for r in survivors.best_representatives(df, "grp", "id", "trust", "at", ["state"]).collect()}
    assert got[100] == "final" and got[0] == "final"


def test_the_learned_order_decides_between_dated_and_undated_values(spark):
    history = [(f"g{i}", 10 * i + k, 1, k, v) for i in range(5) for k, v in enumerate(["draft", "final"])]
    history += [(f"h{i}", 200 + 10 * i + k, 1, k, v) for i in range(5) for k, v in enumerate(["final", "archived"])]
    cycle = [(f"c{i}{n}", 400 + 10 * i + 3 * n + k, 1, k, v) for n, p in enumerate((("x", "y"), ("y", "z"), ("z", "x"))) for i in range(2) for k, v in enumerate(p)]
    open_ = [("a", 1000, 1, 9, "draft"), ("a", 1001, 1, None, "final"), ("b", 1010, 1, 9, "final"), ("b", 1011, 1, None, "draft"), ("p", 1020, 1, None, "archived"), ("p", 1021, 1, None, "draft")]
    open_ += [("t", 1030, 2, 1, "draft"), ("t", 1031, 1, None, "final"), ("y", 1040, 1, None, "x"), ("y", 1041, 1, None, "y"), ("y", 1042, 1, 3, "z")]
    df = spark.createDataFrame(history + cycle + open_, "grp string, id long, trust int, at int, state string")
    got = {r.group_id: (r.value, r.id) for r in survivors.best_representatives(df, "grp", "id", "trust", "at", ["state"]).collect()}
    assert got[1000] == ("final", 1001) and got[1010] == ("final", 1010)
    assert got[1020] == ("archived", 1020)  # through a value that the group lacks
    assert got[1030] == ("draft", 1030)  # trust comes first
    assert got[1040] == ("z", 1042)  # a cycle: what was last seen


# 4. Near-duplicates


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("абвгдежз") for _ in range(6))
    base = [[word() for _ in range(60)] for _ in range(40)]
    texts = []
    for b in base:
        for _ in range(6):
            own = list(b)
            for _ in range(rng.randint(0, 16)):
                own[rng.randrange(60)] = word()
            texts.append(" ".join(own))
    rows = [(f"k{i:03}", t, 1) for i, t in enumerate(texts)]
    rows += [("copy", texts[0].upper(), 1), ("k000", texts[0], 2), ("null", None, 1), ("empty", "", 1), ("short", "а б в", 1), (None, texts[0], 1)]
    df = spark.createDataFrame(rows, "id string, text string, block int")
    sets = {k: set(re.findall(r"[^\W_]+", t.lower())) for k, t, _ in rows if t and k}
    sets = {k: s for k, s in sets.items() if len(s) >= 40}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.75}
    got = found(near_duplicates.near_duplicates(df, "id", "text", 40, near_duplicates.NearParams(threshold=0.75)))
    assert got <= want and len(got) >= 0.995 * len(want) and ("copy", "k000") in got


def test_copies_become_a_star_beyond_a_size(spark):
    text = " ".join(f"слово{i}" for i in range(50))
    df = spark.createDataFrame([(i, text) for i in range(30)], "id long, text string")
    params = near_duplicates.NearParams(full_class=10)
    assert found(near_duplicates.near_duplicates(df, "id", "text", 40, params)) == {(0, i) for i in range(1, 30)}
    assert near_duplicates.near_duplicates(df.limit(0), "id", "text", 40, params).count() == 0


def test_different_texts_of_a_word_set_keep_all_links(spark):
    words = [f"слово{i}" for i in range(50)]
    rows = [(i, " ".join([*words[i:], *words[:i]])) for i in range(30)] + [(100 + i, " ".join([*words[i:], *words[:i], "ещё"])) for i in range(3)]
    rows += [(200 + i, rows[0][1]) for i in range(12)]  # more than full_class copies of one text: a star
    df = spark.createDataFrame(rows, "id long, text string")
    got = near_duplicates.near_duplicates(df, "id", "text", 40, near_duplicates.NearParams(full_class=10)).collect()
    ids = [i for i, _ in rows if i < 200]
    want = {(a, b) for a in ids for b in ids if a < b} | {(0, 200 + i) for i in range(12)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_same_files(spark):
    h = "ab" * 32
    df = spark.createDataFrame([("a", h), ("b", h.upper()), ("c", f"sha256:{h}"), ("d", f" {h}\n"), ("e", None), ("f", " "), ("g", ""), ("a", h), ("h", "0" * 64)], "id string, sha string")
    got = found(near_duplicates.same_file(df, "id", "sha"))
    assert got == {(x, y) for x in "abcd" for y in "abcd" if x < y}


def test_links_of_a_large_family_are_counted_text_by_text(spark):
    base = " ".join(f"слово{i}" for i in range(60))
    rows = [(f"f{i:04d}", f"{base} номер{i}", "x") for i in range(800)] + [("copy1", base + " номер5", "x"), ("copy2", base + " номер5", "y"), ("alone", " ".join(f"иное{i}" for i in range(60)), "z"), ("short", "мало слов", "z"), (None, base, "z")]
    df = spark.createDataFrame(rows, "id string, text string, links string")
    got = {r.id: (r.class_id, r.copies, r.links) for r in near_duplicates.link_counts(df, "id", "text", 40).collect()}
    assert got["alone"] == ("alone", 1, 0) and "short" not in got and len(got) == 803
    assert got["copy1"] == got["copy2"] == got["f0005"] == ("copy1", 3, 799) and got["f0000"] == ("f0000", 1, 799)
    assert near_duplicates.link_counts(df.limit(0), "id", "text", 40).count() == 0
    few = spark.createDataFrame(rows[:3], "id string, text string, links string")
    assert near_duplicates.partitions(few, 1 << 40, near_duplicates.NearParams()) == (1 << 40) >> 24


# 5. Pairs


RU = "Порядок подачи заявки определяется договором, который утверждён комитетом и хранится в архиве организации. "
EN = "The procedure for the request is defined by the contract which the committee has approved and which is kept. "
DE = "Das Verfahren für den Antrag wird durch den Vertrag bestimmt, den der Ausschuss genehmigt hat und der bleibt. "


@pytest.fixture(scope="module")
def model():
    return pairs.Languages([("ru", RU * 3), ("en", EN * 3), ("de", DE * 3), ("ru", EN)], 3)


def test_languages(model):
    assert [model.best(t, 0)[0] for t in (RU, EN, DE)] == ["ru", "en", "de"] and model.best("123 !", 0)[0] is None


def test_pair_defects(spark, model):
    q = "Каков порядок подачи заявки?"
    sound = [(100 + i, q, f"Порядок номер {i} определяется договором [1].") for i in range(40)] + [(200 + i, q, "Нет [1]") for i in range(4)]
    cases = [
        (1, q, None, "empty"), (2, q, " \t", "empty"), (3, q, "[1][2]", "empty"), (4, q, "<p></p>", "empty"), (5, q, "N/A", "empty"), (6, q, "```\n```", "empty"),
        (7, q, "каков порядок подачи заявки.", "copy"), (8, q, "Вопрос: Каков порядок подачи заявки? [2]", "copy"),
        (9, q, "Не знаю.", "refusal"), (10, q, "К сожалению, имеющиеся фрагменты не позволяют ответить на вопрос.", "refusal"),
        (11, q, EN, "language"), (12, "What is the procedure for the request?", RU, "language"),
        (13, q, "Порядок подачи определяется договором, который утвержд", "truncated"), (14, q, "Порядок определяется договором (см. п", "truncated"),
        (15, q, "Порядок указан в договоре «Contract Office».", None), (16, None, RU, None),
    ]
    df = spark.createDataFrame([c[:3] for c in cases] + sound + [cases[0][:3]], "answer_id long, question string, answer string").withColumn("defect", F.lit(1))
    got = dict(found(pairs.defective(df, "answer_id", "question", "answer", model)))
    assert got == {c[0]: c[3] for c in cases if c[3]}
    assert pairs.defective(df.limit(0), "answer_id", "question", "answer", model).count() == 0
    joined = pairs.PairParams(held_grams=0)
    assert dict(found(pairs.defective(df, "answer_id", "question", "answer", model, joined))) == got


def test_texts_that_stop_where_texts_go_on(model):
    ends = {".": (900, 1000), ":": (3, 900), ")": (60, 900), "": (1000, 0)}
    judge = pairs.Judge(model, ends, pairs.PairParams())
    body = "Порядок подачи заявки определяется договором комитета"
    for tail in (":", "…", "...", ".\n2)", ".\n2)\n", ".\n- ", " без т."):
        assert judge.breaks_off(body + tail), tail
    for tail in (" от 2020 г.", ", плата 5 р."):
        assert not pairs._OPEN_END.search(body + tail)


def test_refusals_are_learned_from_known_ones():
    known = [f"К сожалению, по теме {w} сведений у меня нет, не могу ответить." for w in ("платы", "срока", "залога", "счёта", "фонда", "акта")]
    sound = [f"Порядок {w} определяется договором и утверждён комитетом, плата не указана отдельно." for w in "абвгдежзиклмнопрст"]
    model = pairs.Refusals([*known, *sound])
    assert model.odds("К сожалению, по теме тарифа сведений у меня нет.") > pairs.PairParams().refusal_odds > 0 > model.odds(sound[0])
    assert pairs.Refusals(sound).odds("К сожалению, не знаю") == 0


# 6. Scans


def scanned():
    body = ["участник", "договор отчёт", "срока который вместе", "представляет не позднее установлен", "и документ"]
    text = [f"Правила архивного учёта\nУчастник представляет\n{x}\n- {i} -" for i, x in enumerate(body, 1)]
    text[1] = f"   Правuла архивного учёта\nУчастник представляет отчёт доку-\nмент и договop\n- 2 -"
    text[2] = "ПРАВИЛА АРХИВНОГО УЧЁТА\nвместе с интернет-\nпортал участник А4\n- З -"
    return text


def test_replayed_and_copied_answers_do_not_make_an_end(spark, model):
    q = "Какой порядок установлен для сезонного лимита?"
    rows = [(i, q, f"Порядок номер {i} — это решение совета. Срок составляет {i} дней, не больше.") for i in range(300)]
    rows += [(900, q, "Порядок определяется на основании сезонного лимита —")] * 3 + [(i, q, "Размер сбора составл") for i in range(910, 915)]
    rows += [(i, f"Кто утверждает договор {i}?", "Комитет") for i in range(920, 925)]
    df = spark.createDataFrame(rows, "id long, question string, answer string")
    assert found(pairs.defective(df, "id", "question", "answer", model)) == {(900, "truncated"), *((i, "truncated") for i in range(910, 915))}


def test_scans(spark):
    words = "участник представляет договор и отчёт не позднее срока который установлен документ вместе с интернет-портал"
    lm = scans.Language({w: 500 for w in words.split()} | {"а4": 300}, scans.ScanParams())
    df = spark.createDataFrame([("d", scanned(), 1), ("d", scanned(), 1), ("e", None, 1), ("f", [], 1), ("g", [None, ""], 1), (None, ["x"], 1)], "doc_id string, page_texts array<string>, kind int")
    rows = found(scans.find_noise(df, "doc_id", "page_texts", lm))
    assert {r for r in rows if r[3] == "header"} == {("d", i, 1, "header") for i in range(1, 6)}
    assert {r for r in rows if r[3] == "page_no"} == {("d", i, 4, "page_no") for i in range(1, 6)}
    assert {r[1:] for r in rows if r[3] in ("hyphen", "ocr")} == {(2, 2, "hyphen"), (2, 3, "ocr")}
    text = {r.doc_id: r.text for r in scans.repair_pages(df, "doc_id", "page_texts", lm).collect()}
    assert "отчёт документ и договор вместе с интернет- портал" in text["d"] and "Правила" not in text["d"] and text["g"] == ""
    assert scans.find_noise(df.limit(0), "doc_id", "page_texts").count() == 0


def test_copies_do_not_make_their_misreads_common(spark):
    sound = [(f"s{i}", [f"участник представляет договор {'и отчёт ' * (i + 1)}\nдоговор хранится в архиве организации"]) for i in range(12)]
    copies = [(f"c{i}", ["участник представляет дoгoвop\nв архиве организации"]) for i in range(6)]  # Latin o and p
    df = spark.createDataFrame([*sound, *copies, copies[0]], "doc_id string, page_texts array<string>")
    got = found(scans.find_noise(df, "doc_id", "page_texts"))
    assert {r for r in got if r[3] == "ocr"} == {(f"c{i}", 1, 1, "ocr") for i in range(6)}


def test_misread_page_numbers_are_read_as_the_others_go():
    text = "\n".join(f"Строка текста номер {i} без повторов" for i in range(5))
    pages = [(text + f"\n— {n} —").split("\n") for n in ("l", "2", "3", "ll")]
    assert scans.page_numbers("— ll —") == [100, 11]
    assert scans.furniture(pages[:3], scans.ScanParams()) == {(i, 5): "page_no" for i in range(3)}
    two = [(text + "\n" + n).split("\n") for n in ("", "— 2 —")]
    assert scans.furniture(two, scans.ScanParams()) == {(1, 5): "page_no"}


def test_page_numbers():
    assert [scans.page_number(x) for x in ("- 39 -", "стр. 1 из 6", "Page 44", "iii", "[2]", "1З", "231 рубль", "2024-01-05")] == [39, 1, 44, 3, 2, 13, None, None]


# 7, 8. Encoding and packing


def test_lexicon_round_trip(tmp_path):
    rng = random.Random(2)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))): [rng.randint(0, 9) for _ in range(rng.randint(0, 4))] for _ in range(900)}
    (tmp_path / "x").write_bytes(lexicon.compiled(words.items()))
    x = lexicon.Lexicon(f"{tmp_path}/x")
    asked = [*words, *(bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 8))) for _ in range(900))]
    for w, n in zip(asked, x.numbers(asked)):
        assert (n >= 0) == (w in words) and (n < 0 or list(x.get(n)) == words[w])
    arcs, final = lexicon.compile_automaton(sorted([b"tops", b"stops"]))
    assert len(final) == 6  # the suffix is shared
    (tmp_path / "y").write_bytes(lexicon.compiled([]))
    assert list(lexicon.Lexicon(f"{tmp_path}/y").numbers([b"a", b""])) == [-1, -1]


@pytest.mark.parametrize("words", [0, 3, 60_000])
def test_ids_equal_the_public_tokenizer(spark, words):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    known.encode_special_tokens = True
    rng = random.Random(8)
    odd = ["it's 'tis 'S don't--'s", "a\r\n\n b \t c  ", "<|endoftext|> x", "пример 123 ½ ² ٣", "👩‍💼🗂️ é" + chr(0x301), chr(0xA0) * 3 + "x" + chr(0x2003), "\x1c\x1d\x85x", "編集 文件", "x" * 5000]
    odd += ["".join(rng.choice(["'", "s", " ", "\n", "Ж", "1", "_", chr(0xA0), "é", "…", "\t", "re"]) for _ in range(30)) for _ in range(200)]
    rows = [(i, t, "x") for i, t in enumerate(odd)] + [(900, None, "x"), (901, "", "x"), (901, "", "x")]
    df = spark.createDataFrame(rows, "id long, text string, ids string")
    params = encoding.BpeParams(words=words)
    got = [(r.id, r.ids) for r in encoding.encode(df, "id", "text", params=params).collect()]
    want = [(i, known.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows]
    assert sorted(got) == sorted(want)
    sizes = {r.id: r.n_tokens for r in encoding.encode(df, "id", "text", params=params, sizes_only=True).collect()}
    assert sizes == {i: len(x) for i, x in want}
    assert encoding.encode(df.limit(0), "id", "text", params=params).count() == 0


def test_packing_places_every_item_once(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0, 1, 5, 7, 7, 7, 30, 64, 65, 200, None])) for i in range(3000)] + [(None, 3), (5, 3)]
    df = spark.createDataFrame(rows, "id long, size long").withColumn("container", F.lit("clash"))
    got = packing.fill_containers(df, "id", "size", 64).collect()
    load = Counter()
    for r in got:
        load[r.container] += r.end - r.start
    total = sum(s or 0 for _, s in rows)
    assert max(load.values()) <= 64 and sum(load.values()) == total and len(load) <= 1.01 * total / 64 + 1
    whole = Counter((r.id, r.end - r.start) for r in got if r.id not in (5, None))
    assert all(whole[i, s or 0] >= 1 for i, s in rows if (s or 0) <= 64 and i not in (5, None))
    long = sorted((r.piece_no, r.start, r.end) for r in got if r.id == next(i for i, s in rows if s == 200))
    assert long == [(0, 0, 64), (1, 64, 128), (2, 128, 192), (3, 192, 200)]
    assert packing.fill_containers(df.limit(0), "id", "size", 64).count() == 0
    many = packing.fill_containers(df, "id", "size", 64, bucket_rows=3).collect()  # sizes ranked in several buckets
    filled = Counter()
    for r in many:
        filled[r.container] += r.end - r.start
    assert max(filled.values()) <= 64 and len(many) == len(got) and {r.container for r in many if r.end > r.start} == {r.container for r in got if r.end > r.start}
    assert found(packing.fill_containers(df.filter("size = 0").limit(1), "id", "size", 64).select("container")) == {(0,)}


# 9. Wrongly decoded text


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(10)
    ru = "порядок подачи заявки определяется договором который утверждён комитетом и хранится в архиве организации участник представляет отчёт размер платы составляет стоимость изменения вступают силу после решения".split()
    return [" ".join(rng.choice(ru) for _ in range(60)).capitalize() + "." for _ in range(120)] + ["The committee decides on the request and the fee applies to each contract of the register."] * 20


@pytest.mark.parametrize("written,read", [("utf-8", "cp1251"), ("utf-8", "cp1252"), ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("utf-8", "koi8-r"), ("utf-8", "cp866")])
def test_stretches_are_restored(spark, texts, written, read):
    codec = mojibake._Codec(read)
    rows, want = list(enumerate(texts)), {}
    for i in range(0, 120, 10):
        words = texts[i].split(" ")
        bad = "".join(codec.chars[b] for b in " ".join(words[10:25]).encode(written))
        rows[i] = (i, " ".join([*words[:10], bad, *words[25:]]))
        want[i] = texts[i]
    df = spark.createDataFrame([*rows, (500, None), (501, ""), (None, "x")], "id long, text string").withColumn("key", F.lit(1))
    got = {r.id: r.text for r in mojibake.restore(df, "id", "text").collect()}
    assert set(got) == set(want)
    assert sum(got[i] == want[i] for i in want) >= 10


def test_copies_of_a_garbled_text_are_found(spark, texts):
    words = texts[0].split(" ")
    bad = " ".join([*words[:10], " ".join(words[10:25]).encode("cp1251").decode("cp1252"), *words[25:]])
    rows = list(enumerate([*texts[1:], *[bad] * (len(texts) // 2)]))  # a third of all rows
    df = spark.createDataFrame(rows, "id long, text string")
    assert found(mojibake.restore(df, "id", "text")) == {(i, texts[0]) for i, t in rows if t == bad}


def test_hardly_improbable_runs_get_every_mapping():
    params = mojibake.GarbleParams()
    scores = mojibake.PairScores(sorted(map(ord, "абвгдежзиклмнопрстуфхцчшщыьэюя äîãâðì")), {}, params)
    own = scores.ids(mojibake._raw("абвгдежзиклмнопрстуфхцчшщыьэюя"))
    scores.score[:] = 0
    scores.score[np.ix_(own, own)] = 4
    scores.score[tuple(scores.ids(mojibake._raw("äî")))] = -params.run_score - 0.5  # the one improbable pair
    text = "порядок определяется договором комитета"
    bad = text.replace("договором", "договором".encode("cp1251").decode("cp1252"))
    assert mojibake.Repairer(scores, params).repair([bad, text]) == [text, None]


def test_sound_texts_stay(spark, texts):
    odd = ["┌────┬────┐\n│ 78 │ 1163 │", "±4,63 % · 31 °C · µ = 39,23", "© ® ™ «§ 5» — ‰", "文件编号第条", "👩‍💼 ✅", "УСТАВ ОРГАНИЗАЦИИ", "résumé naïve", "Реги" + chr(0xAD) + "страция"]
    df = spark.createDataFrame(list(enumerate(texts + odd)), "id long, text string")
    assert mojibake.restore(df, "id", "text").count() == 0
    assert mojibake.restore(df.limit(0), "id", "text").count() == 0


def test_maximal_segments_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(-4, 5, rng.integers(1, 14)).astype(float)
        got = mojibake.maximal_segments(x)
        want, left = [], [(0, len(x))]
        while left:  # the best segment, then the best on either side of it
            lo, hi = left.pop()
            best = max(((x[a:b].sum(), -(b - a), -a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            if best[0] > 0:
                a, b = -best[2], best[3]
                want.append(best[0])
                left += [(lo, a), (b, hi)]
        assert sorted(v for _, _, v in got) == sorted(want) and all(np.isclose(x[a:b].sum(), v) for a, b, v in got)


def test_white_space_constant():
    assert len(WHITE_SPACE) == 25
