import datetime
import random
import re
import uuid

from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.functions import links as L
from tessera.functions import text as T
from tessera.functions.space import WHITE_SPACE, trimmed

NBSP, SHY = chr(0xA0), chr(0xAD)


def one(spark, make, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.withColumn("y", make(F.col("x"))).orderBy("i").collect()]


def test_white_space_is_the_same_in_the_jvm(spark):
    assert one(spark, trimmed, [f"{c}a{c}" for c in WHITE_SPACE] + [chr(0x200B) + "a"]) == ["a"] * len(WHITE_SPACE) + [chr(0x200B) + "a"]


def test_normalize_whitespace(spark):
    assert one(spark, T.normalize_whitespace, [f"a{NBSP} \tb \r\n c", "", None]) == ["a b\n\nc", "", None]


def test_hyphenation_joins_chains_and_keeps_latin(spark):
    texts = ["реги-\nстрация", f"со{SHY}став", "lat-\nслово", "real-\nword", "а-\nб-\nв", "А-\nБ", "сло- \n  во"]
    assert one(spark, T.fix_hyphenation, texts) == ["регистрация", "состав", "latслово", "real-\nword", "абв", "А-\nБ", "слово"]


def test_hyphenation_equals_repeated_joining(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["а", "б", "x", "-", "\n", " ", "Я"]) for _ in range(12)) for _ in range(300)]

    def model(t):
        while True:
            new = re.sub(r"([а-яёa-z])-\s*\n\s*([а-яё])", r"\1\2", t)
            if new == t:
                return t
            t = new

    assert one(spark, T.fix_hyphenation, texts) == [model(t) for t in texts]


def test_uuid5(spark):
    names = ["a#1:1.2:0", "документ#p3:1", ""]
    assert one(spark, T.uuid5, names) == [str(uuid.uuid5(uuid.UUID("6a9c1e00-0000-4000-8000-000000000000"), n)) for n in names]


def test_slugs(spark):
    assert one(spark, T.slugify, ["  Щётка и Ёж! ", "***", "a" * 70, "Правила 2024-1"]) == ["schetka_i_ezh", "document", "a" * 60, "pravila_2024-1"]


def test_dates(spark):
    assert one(spark, T.short_date, ["2024-05-06", "2024/05", None]) == ["06.05.2024", "2024/05", ""]
    assert one(spark, T.iso_date, ["2024-05-06", "2024-02-31", "x", None]) == [datetime.date(2024, 5, 6), None, None, None]
    assert one(spark, T.long_date, [datetime.date(2024, 5, 6), None], "date") == ["6 мая 2024 г.", None]


def test_dates_in_names(spark):
    names = ["a_31.02.2020_05.06.2021.pdf", "x-2019-03-04", "p_10_11_22.pdf", "p_10_11_221.pdf", "01.01.1999", "none"]
    day = datetime.date
    assert one(spark, L.date_in, names) == [day(2021, 6, 5), day(2019, 3, 4), day(2022, 11, 10), None, None, None]


def test_file_names_and_protocols(spark):
    assert one(spark, L.file_name, ["/a/b%20c.pdf?x=1", "/a/100%zz.pdf", "/a/1+1.pdf"]) == ["b c.pdf", "100%zz.pdf", "1+1.pdf"]
    assert one(spark, L.protocol, ["Protokol_123.pdf", "protokol 7", "x"]) == [123, None, None]


def test_links(spark):
    html = '<!-- <a href="no.pdf">x</a> --><script>var a = "<a href=b.pdf>";</script><a class=x href="A.PDF?v=1"> <b>One</b>\n two</a><a href=other.html>y</a><a href=c.pdf>z</a>'
    rows = one(spark, L.links, [html])[0]
    assert [tuple(r) for r in rows] == [("A.PDF?v=1", "One two"), ("c.pdf", "z")]


def test_hosts(spark):
    df = spark.createDataFrame([("/x", "https://a.b/"), ("https://a.b/c", "https://a.b/"), ("https://a.b:8/c", "https://a.b/")], "u string, b string")
    assert [r.y for r in df.select(L.same_host(F.col("u"), F.col("b")).alias("y")).collect()] == [True, True, False]


def test_refusals(spark):
    is_refusal = lambda c: T.is_refusal(c, DEFAULT.refusal)
    texts = ["", DEFAULT.refusal, "Срок не указан.", "Комиссия не указана [1].", "не найден " * 40, None]
    assert one(spark, is_refusal, texts) == [False, True, True, False, False, False]


def test_markers(spark):
    assert one(spark, T.markers, ["a [2] b [1] [2] [1,2] [x]", "", None]) == [[2, 1], [], None]


def test_lenient_json(spark):
    texts = ['{"a": 1}', 'x ```json\n{"a": 2}\n``` y', 'said {"a": 3} end', '{"a": [1, 2', '{"a": {"b": "c', '{"a": 4,', "none", None]
    got = one(spark, lambda c: F.get_json_object(T.lenient_json(c), "$.a"), texts)
    assert got == ["1", "2", "3", "[1,2]", '{"b":"c"}', "4", None, None]


def test_small_functions(spark):
    assert one(spark, T.strip_think, ["<think>a\nb</think> c", "d <think>e</think>"]) == ["c", "d <think>e</think>"]
    assert one(spark, T.strip_leadin, ["Этот документ — порядок оплаты", "Порядок", "документ"]) == ["Порядок оплаты", "Порядок", "документ"]
    assert one(spark, T.clean_bullet, ["• — слово [1,2]  два [3-5]"]) == ["слово два"]
    assert one(spark, T.rgb, ["#1A2B3C"]) == [[26, 43, 60]]
    assert one(spark, T.markdown_kind, ["# a", "- b", "2) c", "d", " "]) == ["heading", "bullet", "numbered", "paragraph", "blank"]
    assert one(spark, T.paragraphs, ["a\n\n\nb\nc"]) == [["a", "b\nc"]]
    assert one(spark, T.ellipsis, ["x" * 501, "y"]) == ["x" * 500 + "…", "y"]
    assert one(spark, L.safe_name, ["../x.pdf", "a/..", "b.pdf"]) == ["x.pdf", None, "b.pdf"]
    assert one(spark, T.positive_weights, [{"1": 0.5, "x": 1.0, "2": -1.0}], "map<string,double>") == [{"1": 0.5}]
