"""Defective question-answer pairs and what is wrong with them.

The languages of question and answer are compared by a naive Bayes model over character n-grams, trained on labelled
documents. Whether an answer breaks off is judged by how likely its last characters are to stand at an end of text,
from n-gram counts over all different answers. Refusals are told by a naive Bayes model over words and word pairs, fitted on
a bounded sample of the answers themselves, of which those with a known phrase are the first examples. Empty answers and
copies are told by what is left of them once markers, markup and the words of the question are set aside.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frequent import hash_sample
from tessera.runtime import spool

#: Answers that stand for no answer.
PLACEHOLDERS = ("n/a", "na", "none", "null", "nil", "nan", "undefined", "todo", "tbd", "пусто", "нет ответа", "leer", "empty", "vide")

#: Phrases by which an answer declines or says that it cannot answer: the first examples of refusals.
REFUSALS = (
    r"не могу (?:ответить|дать|сказать|сообщить|помочь|предоставить|подтвердить)", r"(?:ответить|сообщить|дать|сказать|помочь) (?:на это |ничего )?не (?:могу|можем|смогу)",
    r"не знаю", r"затрудня(?:юсь|емся)", r"оснований для ответа", r"недостаточно (?:данных|сведений|информации|оснований)", r"нет (?:данных|сведений|информации|ответа) (?:для|по|об|о|на)\b",
    r"сведений [^.]{0,60}\bнет\b", r"ответить [^.]{0,40}(?:невозможно|не представляется возможным|нельзя)", r"не позволяют? (?:дать )?отве", r"помочь [^.]{0,30}не (?:получится|удастся)",
    r"документы молчат", r"не располага(?:ю|ем)", r"языковая модель", r"не вправе (?:давать|отвечать)", r"тема [^.]{0,30}недоступна", r"не удалось (?:найти|обнаружить)",
    r"выходит за (?:рамки|пределы)", r"не разреша(?:ют|ет) [^.]{0,20}отвечать", r"(?:дать )?ответ(?:а|ить)? (?:дать )?нельзя", r"мне не (?:попадал|встречал|известн)", r"не касаются, поэтому",
    r"(?:outside|beyond) (?:of )?(?:what|the scope|my)", r"not permitted to answer", r"außerhalb (?:der|des|meine)",
    r"этого не раскрывают", r"воздержусь", r"вынужден[а]? отказать", r"отвечать на (?:это|такие|данн)[^.]{0,30} не (?:буду|могу|имею)",
    r"(?:can ?not|can['’]t|could not|couldn['’]t) (?:answer|help|provide|find|determine|assist|say)", r"unable to", r"not able to", r"(?:don['’]t|do not) (?:have|know)\b", r"must decline", r"have no (?:information|data|answer)",
    r"as an? (?:ai|assistant|language model)", r"no (?:information|data|answer) (?:is |was )?(?:available|found)", r"(?:sources|fragments|documents|materials) (?:are silent|say nothing|do not (?:say|answer|contain))",
    r"keine (?:angaben|informationen|auskunft|aussage|daten|antwort)", r"nicht beantworten", r"weiß (?:ich |es )*nicht", r"kann (?:ich )?(?:dazu|hierzu|darauf|ihnen|diese)[^.]{0,60}nicht", r"nicht (?:möglich|imstande|in der lage)[^.]{0,30}(?:antwort|beantwort|auskunft)",
    r"je ne (?:peux|sais|dispose)", r"impossible de répondre",
)

#: Words by which a copied question may be introduced.
QUESTION_WORDS = frozenset(("question", "вопрос", "frage", "answer", "ответ", "antwort", "q", "a"))


@dataclass(frozen=True)
class PairParams:
    fit_rows: int = 2_000  # bound of the labelled documents the language model is fitted on
    grams: int = 3  # its longest n-grams
    language_margin: float = 0.25  # by how much, in log odds a character, another language must win
    least_letters: int = 12  # shorter answers have no language of their own
    held_grams: int = 300_000  # end counts beyond that number are joined to the answers instead of being sent around
    end_gram: int = 4  # characters before an end of text that are looked at
    end_share: float = 0.012  # least likelihood of an end there
    mark_share: float = 0.03  # least likelihood of an end after the last mark alone
    short_words: int = 5  # an answer of more words has to end with a mark
    short_share: float = 3e-4  # share of all different pairs, and two at least, that make a short form a whole answer
    fit_answers: int = 10_000  # bound of the answers the model of refusals is fitted on
    refusal_odds: float = 5.0  # least log odds, over the root of the number of features, of a refusal
    refusal_chars: int = 320  # a refusal of more characters than that also says something
    alike: float = 0.9  # share of the question's words that a copy repeats


class Languages:
    """Naive Bayes over character n-grams."""

    def __init__(self, rows: list[tuple[str, str]], grams: int):
        self.grams = grams
        self._fit(rows)
        again = [(self.best(text[:], margin=0.0)[0] or lang, text) for lang, text in rows]  # labels that are plainly wrong are set right once
        self._fit(again)

    def _fit(self, rows: list[tuple[str, str]]) -> None:
        counts: dict[str, Counter] = {}
        for lang, text in rows:
            counts.setdefault(lang, Counter()).update(self._grams(text))
        all_ = {g for c in counts.values() for g in c}
        self.logs = {}
        for lang, c in counts.items():
            total = sum(c.values()) + 0.5 * len(all_)
            self.logs[lang] = ({g: math.log((n + 0.5) / total) for g, n in c.items()}, math.log(0.5 / total))

    def _grams(self, text: str) -> list[str]:
        x = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
        return [x[i : i + self.grams] for i in range(len(x) - self.grams + 1)]

    def scores(self, text: str) -> dict[str, float]:
        """The mean log likelihood of the text's n-grams in each language."""
        grams = self._grams(text)
        return {lang: sum(map(table.get, grams, [least] * len(grams))) / max(1, len(grams)) for lang, (table, least) in self.logs.items()} if grams else {}

    def best(self, text: str, margin: float) -> tuple[str | None, dict[str, float]]:
        s = self.scores(text)
        if not s:
            return None, s
        lang = max(s, key=s.__getitem__)
        return lang, s


class Refusals:
    """Naive Bayes over words and word pairs, refusals against answers."""

    def __init__(self, answers: list[str]):
        self.yes, self.no = Counter(), Counter()
        self.sizes = [0, 0]
        for a in answers:
            text = bare(a)
            seen = declines(text)
            (self.yes if seen else self.no).update(self._features(text))
            self.sizes[not seen] += 1
        least = [g for g in self.yes.keys() | self.no.keys() if self.yes[g] + self.no[g] >= 3]
        a, b = self.sizes
        self.logs = {g: math.log((self.yes[g] + 0.5) / (a + 1)) - math.log((self.no[g] + 0.5) / (b + 1)) for g in least}
        self.yes = self.no = None

    @staticmethod
    def _features(text: str) -> set[str]:
        w = ["^", *(re.sub(r"\d+", "0", x) for x in words(_QUOTED.sub(" ", text))), "$"]
        return set(w[1:-1]) | {f"{a} {b}" for a, b in zip(w, w[1:])}

    def odds(self, text: str) -> float:
        found = [x for x in map(self.logs.get, self._features(text)) if x is not None] if len(words(text)) > 2 else []  # less is judged by known phrases alone
        return sum(found) / math.sqrt(len(found)) if found and self.sizes[0] >= 3 else 0.0


_MARKER = re.compile(r"\s*\[\d+(?:\s*[,–-]\s*\d+)*\]")
_MARKUP = re.compile(r"<[^<>]{0,40}>|```\w*|[*_#`~|{}\u200b-\u200f\u2060\ufeff\u00ad]")
_QUOTED = re.compile(r"«[^«»]*»|“[^“”]*”|„[^„“”]*[“”]|\"[^\"]*\"")
_LATIN = re.compile(r"\b[A-Za-z][\w.\-]*\b")
_REFUSAL = re.compile("|".join(REFUSALS), re.IGNORECASE)


#: An ellipsis, an item or bullet just opened, or a lone letter with a stop other than those that end a year or a price.
_OPEN_END = re.compile(r"(?:…|\.{3})$|\n\s*(?:\d{1,3}[.)]|[-•*–—])$|(?<=\s)(?![гр])[^\W\d_]\.$")


def bare(answer: str) -> str:
    return _MARKUP.sub(" ", _MARKER.sub(" ", answer)).strip()


def declines(text: str) -> bool:
    """Whether a known phrase of refusal stands in a text, quotations aside."""
    return bool(_REFUSAL.search(_QUOTED.sub(" ", re.sub(r"\s+", " ", text))))


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def plain(answer: str) -> str:
    return re.sub(r"\d", "0", _MARKER.sub("", answer).rstrip().lower())


def times(gram: str, text: str) -> int:
    """How often a gram occurs in a text, overlaps included."""
    n, at = 0, text.find(gram)
    while at >= 0:
        n, at = n + 1, text.find(gram, at + 1)
    return n


def end_grams(answer: str, n: int) -> tuple[str, str, str] | None:
    """The last n, the last 2 and the last character of an answer without markers, digits as one, in lower case."""
    x = plain(answer)
    return (x[-n:], x[-2:], x[-1:]) if len(x) >= n else None


def short_form(answer: str, most: int) -> str | None:
    """An answer of few words, its numbers masked; a form that many answers have is a whole answer."""
    x = " ".join(_MARKER.sub("", answer).lower().split())
    return "=" + re.sub(r"\d+", "0", x) if len(x.split()) <= most else None


def end_counts(df: DataFrame, question_col: str, answer_col: str, params: PairParams) -> DataFrame:
    """(gram, ends, n): times at an end of text and anywhere, over all different answers, of the grams that end one; also the
    short forms, marked by a leading =, with the number of different pairs of question and answer, and that of all pairs
    under the empty string. Replays and copies say nothing; one short answer to many questions does."""
    n = params.end_gram

    def run(batches):
        ends: Counter = Counter()
        all_: Counter = Counter()
        for b in batches:
            for a, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ends[""] += asked
                e = end_grams(a, n)
                if e:
                    ends.update(e)
                    x = plain(a)
                    all_.update(x[i : i + n] for i in range(len(x) - n + 1))
                    all_.update(x[i : i + 2] for i in range(len(x) - 1))
                    all_.update(x)
                form = short_form(a, params.short_words)
                if form:
                    ends[form] += asked
        keys = list(ends.keys() | all_.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([ends[k] for k in keys], pa.int64()), pa.array([all_[k] for k in keys], pa.int64())], names=["gram", "ends", "n"])

    pairs = df.select(F.col(answer_col).alias("answer"), F.xxhash64(question_col).alias("asked")).filter(F.length("answer") > 0)
    rows = pairs.distinct().groupBy("answer").agg(F.count("*").alias("asked"))
    return rows.mapInArrow(run, "gram string, ends long, n long").groupBy("gram").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n")).filter(F.col("ends") > 1)


class Judge:
    def __init__(self, languages: Languages, ends: dict[str, tuple[int, int]], params: PairParams, refusals: Refusals | None = None):
        self.languages, self.ends, self.params, self.refusals = languages, ends, params, refusals

    def defect(self, question: str | None, answer: str | None) -> str | None:
        question, answer = question or "", answer or ""
        text = bare(answer)
        own = words(text)
        if not own or " ".join(own) in _NOTHING or text.lower().strip(" .()[]<>-") in PLACEHOLDERS:
            return "empty"
        if self.copies(words(question), own):
            return "copy"
        if self.refuses(text):
            return "refusal"
        if self.other_language(question, text):
            return "language"
        if self.breaks_off(answer):
            return "truncated"
        return None

    def copies(self, question: list[str], own: list[str]) -> bool:
        asked = Counter(question)
        if not asked:
            return False
        rest = [w for w in own if w not in asked and w not in QUESTION_WORDS]
        shared = sum(1 for w in asked if w in own) / len(asked)
        return shared >= self.params.alike and len(rest) <= max(0, len(question) // 10)

    def refuses(self, text: str) -> bool:
        if len(re.sub(r"\s+", " ", text)) > self.params.refusal_chars:
            return False
        return declines(text) or self.refusals is not None and self.refusals.odds(text) >= self.params.refusal_odds

    def other_language(self, question: str, text: str) -> bool:
        plain = _QUOTED.sub(" ", text)
        if sum(c.isalpha() for c in plain) < self.params.least_letters:
            return False
        if sum(0x400 <= ord(c) < 0x530 for c in plain) > 8:
            plain = _LATIN.sub(" ", plain)  # product names in a Cyrillic text
        asked, _ = self.languages.best(_QUOTED.sub(" ", question), 0)
        said, scores = self.languages.best(plain, 0)
        return asked is not None and said is not None and said != asked and scores[said] - scores[asked] >= self.params.language_margin

    def breaks_off(self, answer: str) -> bool:
        text = _MARKER.sub("", answer).rstrip()
        if _OPEN_END.search(text):
            return True
        if any(text.count(a) > text.count(b) for a, b in ("()", "«»", "[]", "“”")) or text.count("```") % 2:
            return True
        table = [x.strip() for x in text.split("\n") if x.strip().startswith("|")]
        if table and text.split("\n")[-1].strip().startswith("|"):
            return not table[-1].endswith("|") or len({x.count("|") for x in table}) > 1 or len(table) < 3
        final = text[-1:]
        if final.isalnum() and len(words(text)) > self.params.short_words:
            return True
        k, n = self.ends.get(final, (0, 0))
        if final and not final.isalnum() and n > 1 and (k - 1) / (n - 1) < self.params.mark_share:
            return True  # a mark after which texts go on
        form = short_form(answer, self.params.short_words)
        if form and self.ends.get(form, (1, 0))[0] - 1 >= max(2, self.params.short_share * self.ends.get("", (0, 0))[0]):
            return False
        e = end_grams(answer, self.params.end_gram)
        if e is None:
            return not final.isalnum() and final not in ".!?»)%"
        share, x = 0.0, plain(answer)
        for gram in reversed(e):  # the answer itself does not count; what is rare leans on the shorter gram
            own = times(gram, x)
            k, n = self.ends.get(gram, (1, own))
            share = (max(0, k - 1) + 4 * share) / (max(0, n - own) + 4)
        return share < self.params.end_share


_NOTHING = frozenset(" ".join(words(p)) for p in PLACEHOLDERS)


def label(column):
    """The language of a label such as 'RU' or 'de-XX'; null for none."""
    lang = F.lower(F.regexp_extract(column, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.when(~lang.isin("", "und"), lang)


def languages(documents: DataFrame, id_col: str, text_col: str, lang_col: str, params: PairParams = PairParams()) -> Languages:
    """Fitted on at most fit_rows whole texts, drawn by a hash of their ids from all labelled documents."""
    rows = documents.select(F.col(id_col).alias("id"), label(F.col(lang_col)).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}{3}"))
    chosen = hash_sample(rows, "id", params.fit_rows, rows.count()).select("lang", "text")
    chosen = chosen.toArrow()
    return Languages(list(zip(chosen["lang"].to_pylist(), chosen["text"].to_pylist())), params.grams)


def defective(df: DataFrame, id_col: str, question_col: str, answer_col: str, model: Languages, params: PairParams = PairParams()) -> DataFrame:
    """(id, defect): 'empty', 'copy', 'refusal', 'language' or 'truncated', the first that holds; sound pairs give no row.

    A null answer is empty; a null question has no language and is copied by nothing. Repeated rows count once; an
    id with several different rows has a row for each different defect. Only the named columns are read.
    """
    spark = df.sparkSession
    different = df.select(F.col(answer_col).alias("answer"), F.xxhash64(question_col, answer_col).alias("pair")).filter(F.length("answer") > 0)
    different = spool(different.distinct(), "answers")  # one short answer to many questions counts with each
    sample = hash_sample(different, "pair", params.fit_answers, different.count())
    refusals = Refusals(sample.toArrow()["answer"].to_pylist())
    ends = spool(end_counts(df, question_col, answer_col, params), "ends")
    few = ends.count() <= params.held_grams
    table = (ends if few else ends.filter(F.length("gram") < 2)).toArrow()
    table = dict(zip(table["gram"].to_pylist(), zip(table["ends"].to_pylist(), table["n"].to_pylist())))
    held = spark.sparkContext.broadcast(Judge(model, table, params, refusals))  # bounded by fit_rows, fit_answers and held_grams
    rows = df.select(F.col(id_col).alias("id"), F.col(question_col).alias("question"), F.col(answer_col).alias("answer"))
    kind = df.schema[id_col].dataType.simpleString()
    if not few:
        rows = _with_counts(rows, ends, kind, params)

    def run(batches):
        judge = held.value
        for b in batches:
            row, kind = [], []
            counts = b.column("counts").to_pylist() if not few else [None] * b.num_rows
            for i, (q, a, own) in enumerate(zip(b.column("question").to_pylist(), b.column("answer").to_pylist(), counts)):
                if own is not None:
                    judge.ends = table | {c["gram"]: (c["ends"], c["n"]) for c in own}
                d = judge.defect(q, a)
                if d:
                    row.append(i)
                    kind.append(d)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row, pa.int64())), pa.array(kind, pa.string())], names=[id_col, "defect"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, defect string").distinct()


def _with_counts(rows: DataFrame, ends: DataFrame, kind: str, params: PairParams) -> DataFrame:
    """The rows with the counts of the grams and the form that their answer ends in."""

    def run(batches):
        for b in batches:
            grams = []
            for a in b.column("answer").to_pylist():
                own = [*(end_grams(a, params.end_gram) or ()), short_form(a, params.short_words)] if a else []
                grams.append(list({g for g in own if g and len(g) > 1}))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "question", "answer")), pa.array(grams, pa.list_(pa.string()))], names=["id", "question", "answer", "grams"])

    known = rows.mapInArrow(run, f"id {kind}, question string, answer string, grams array<string>").withColumn("row", F.xxhash64("id", "question", "answer")).distinct()
    asked = known.select("row", F.explode("grams").alias("gram")).join(ends, "gram")
    counts = asked.groupBy("row").agg(F.collect_set(F.struct("gram", "ends", "n")).alias("counts"))  # four at most
    return known.join(counts, "row", "left").select("id", "question", "answer", F.coalesce("counts", F.array().cast("array<struct<gram: string, ends: bigint, n: bigint>>")).alias("counts"))
