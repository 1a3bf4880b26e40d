"""Repairing text extracted from scanned pages.

Running lines and page numbers are found by their recurrence on the pages of a document, broken words by what follows
them in the text, and misread characters by a noisy channel: for every word of a line the candidates that its
suspicious characters may stand for are weighed by confusion probability and corpus likelihood (word counts, with a
character trigram model behind them, and transitions between the scripts of neighbouring words), and the best reading
of the line is decoded with Viterbi's algorithm.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frequent import most_frequent

#: What a letter may be misread as. Latin letters, digits and signs for Cyrillic letters; Cyrillic
#: letters, digits and signs for Latin ones; letters for digits.
CYRILLIC_AS = {
    "а": "aáàâäã@4", "б": "6b", "в": "B8bʙv", "г": "rгr", "д": "gd9", "е": "eéèêëē€", "ё": "ëeé", "ж": "", "з": "3z", "и": "uúùûüï", "й": "ŭuй",
    "к": "kķ", "л": "nл1|", "м": "mʍ", "н": "hнH", "о": "o0óòôöõºø", "п": "nñ", "р": "pþ", "с": "cçĉ©¢(", "т": "mtτт7†", "у": "yýÿ", "ф": "", "х": "x×χ",
    "ц": "u", "ч": "4ч", "ш": "w", "щ": "w", "ъ": "b", "ы": "bы", "ь": "bь6", "э": "3", "ю": "", "я": "9я",
}
LATIN_AS = {
    "a": "аá@4", "b": "6ьв8", "c": "с©¢(", "d": "ԁ", "e": "еéё€", "f": "ƒ†", "g": "9", "h": "һн", "i": "іïí1|!l", "j": "ј", "k": "к", "l": "1|I!ӏі", "m": "м",
    "n": "пñ", "o": "о0óöø", "p": "рþ", "q": "9", "r": "г", "s": "ѕ5$§", "t": "т7†", "u": "иüú", "v": "ѵ", "w": "ш", "x": "х×", "y": "уýÿ¥", "z": "2",
}
DIGIT_AS = {"0": "OoОо", "1": "lI|!іi", "2": "Zz", "3": "ЗзЭэ", "4": "чЧ", "5": "Ss§", "6": "бb", "7": "тTТ", "8": "BВв", "9": "gq"}
BREAKS = "-‐‑¬\xad­‒–"
PAGE_WORDS = ("page", "p", "стр", "страница", "с", "лист", "seite", "s", "of", "из", "von", "sur", "no", "n")

_SIGNS = "@|†€©¢$§!×¥("
_STRIP = ".,;:!?…\"'«»“”„‘’()[]{}<>%—–*"
_ROMAN = re.compile(r"[ivxlcdm]+$")


@dataclass(frozen=True)
class ScanParams:
    vocabulary: int = 500_000  # words with counts of their own, the most frequent ones; the trigram model covers all others
    readings: int = 1_024  # of a word of a dozen misread characters the likeliest so many are weighed
    noise: float = 0.01  # share of characters that are misread
    header_share: float = 0.3  # share of a document's pages on which a running line recurs
    alike: float = 0.8  # how alike two misread running lines are
    meant_share: float = 5e-5  # share of all words from which a word of mixed kinds is taken as meant
    margin: float = 2.0  # by how much, in log probability, a reading must beat what is written


def _script(c: str) -> str:
    o = ord(c)
    if c.isdigit():
        return "d"
    if 0x400 <= o < 0x530:
        return "c"
    if c.isalpha():
        return "l"
    return "s"


_READ_C: dict[str, list[str]] = {}
_READ_L: dict[str, list[str]] = {}
_READ_D: dict[str, list[str]] = {}
for _table, _out, _own in ((CYRILLIC_AS, _READ_C, "c"), (LATIN_AS, _READ_L, "l"), (DIGIT_AS, _READ_D, "d")):
    for _true, _seen in _table.items():
        for _c in _seen:
            if _script(_c) != _own or (_own == "l" and not _c.isascii()):
                _out.setdefault(_c, []).append(_true)
                if _own != "d" and _c.upper() != _c and len(_c.upper()) == 1 and _c.upper() not in _seen:
                    _out.setdefault(_c.upper(), []).append(_true)
del _table, _out, _own, _true, _seen, _c

#: One character for all that look alike, to compare running lines with misreads.
_SKELETON = {c: t for t, seen in reversed(CYRILLIC_AS.items()) for c in seen if c and not c.isdigit()}
_SKELETON |= {c: _SKELETON.get(c, c) for c in "abcdefghijklmnopqrstuvwxyz"}


@lru_cache(100_000)
def _bones(token: str) -> str | None:
    core = token.strip(_STRIP + "-|·№#")
    if not core or core.isdigit() or _ROMAN.match(core) or re.fullmatch(r"[\d.\-/]+", core):
        return None
    return _UNLIKE.sub("", token).translate(_ALIKE)


def skeleton(line: str) -> str:
    """A running line apart from its numbers, case, indent and look-alike letters."""
    return " ".join(x for x in map(_bones, line.lower().split()) if x is not None)


#: Digits as the letters they look like, and all look-alikes as one character.
_AS_LETTER = {"0": "о", "1": "л", "3": "з", "4": "ч", "6": "б", "7": "т", "8": "в", "9": "я"}
_ALIKE = str.maketrans(_SKELETON | {d: _SKELETON.get(c, c) for d, c in _AS_LETTER.items()})
_UNLIKE = re.compile(f"[^\\w{re.escape(_SIGNS)}]|_")


def page_numbers(line: str) -> list[int]:
    """What number a line that holds nothing else may stand for, in any dress; misread digits included. Letters such as l
    are Roman numbers and misread digits at once."""
    tokens = [t for t in re.split(r"[^\w|!]+", line.strip().lower()) if t and t != "|"]
    tokens = [t for t in tokens if "".join(_SKELETON.get(c, c) for c in t) not in _PAGE_SKELETONS]
    if not 1 <= len(tokens) <= 2 or len(line.strip()) > 40:
        return []
    readings = []
    for t in tokens:
        own = [int(t)] if t.isdigit() and len(t) <= 4 else []
        if _ROMAN.match(t) and (r := _roman(t)):
            own.append(r)
        read = "".join(c if c.isdigit() else (_READ_D.get(c) or _READ_D.get(c.upper()) or ["x"])[0] for c in t)
        if not own[:1] or not t.isdigit():
            own += [int(read)] if read.isdigit() and len(read) <= 4 else []
        if not own:
            return []
        readings.append(own)
    return list(dict.fromkeys(readings[0]))


def page_number(line: str) -> int | None:
    return next(iter(page_numbers(line)), None)


def _alike(a: str, b: str, least: float) -> bool:
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.quick_ratio() >= least and m.ratio() >= least


_PAGE_SKELETONS = {"".join(_SKELETON.get(c, c) for c in w) for w in PAGE_WORDS}


def _roman(t: str) -> int:
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    n = [value[c] for c in t]
    return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0]))


class Seeds:
    """Different lines, the most common first; a line belongs to the first seed that it is like. Every line may be a seed."""

    def __init__(self, counts: Counter, least: float):
        self.lines, self.least = [x for x, _ in counts.most_common()], least
        self.size = np.array([len(x) for x in self.lines])
        self.bag = np.zeros((len(self.lines), 64), np.int32)
        for i, x in enumerate(self.lines):
            np.add.at(self.bag[i], [ord(c) & 63 for c in x], 1)
        self.seed: dict[str, str] = {}
        done = np.zeros(len(self.lines), bool)
        for i, x in enumerate(self.lines):
            if done[i]:
                continue
            done[i] = True
            self.seed[x] = x
            # Lines alike to the share r have at least r / 2 of their characters, taken together, in common.
            shared = np.minimum(self.bag[i], self.bag).sum(1)
            near = ~done & (np.abs(self.size - len(x)) <= 0.4 * len(x)) & (2 * shared >= least * (self.size + len(x)))
            for j in np.flatnonzero(near):
                if _alike(x, self.lines[j], least):
                    done[j] = True
                    self.seed[self.lines[j]] = x

    def of(self, line: str) -> str | None:
        return self.seed.get(line)


def furniture(pages: list[list[str]], p: ScanParams) -> dict[tuple[int, int], str]:
    """(page, line) -> 'header' or 'page_no', both counted from 0."""
    edges: dict[str, list[list[int]]] = {"top": [], "bottom": []}
    for lines in pages:
        full = [i for i, x in enumerate(lines) if x.strip()]
        edges["top"].append(full[:2])
        edges["bottom"].append(full[:1:-1][:2] if len(full) > 3 else [])
    out: dict[tuple[int, int], str] = {}
    numbers = {(k, pg, i): n for k in edges for pg, own in enumerate(edges[k]) for i in own if (n := page_numbers(pages[pg][i]))}
    offsets = Counter((k, n - pg) for (k, pg, _), ns in numbers.items() for n in ns)

    body: set[str] = set()

    def inside(key: str) -> bool:
        """Whether the line stands between the edges of a page, too."""
        if not body:
            body.add("")
            for pg, lines in enumerate(pages):
                at_edge = {*edges["top"][pg], *edges["bottom"][pg]}
                body.update(skeleton(x) for i, x in enumerate(lines) if i not in at_edge and len(x) < longest)
        return key in body

    longest = 2 * max((len(pages[pg][i]) for k in edges for pg, own in enumerate(edges[k]) for i in own), default=0) + 20
    for k, own in edges.items():
        # Running lines: what recurs on the same edge of other pages, page numbers aside.
        keys = {}
        for pg, at in enumerate(own):
            for n, i in enumerate(at):
                if (k, pg, i) in numbers or n and (k, pg, at[0]) not in numbers:
                    continue
                s = skeleton(pages[pg][i])
                if sum(c.isalpha() for c in s) >= 5:
                    keys[pg, i] = s
        groups: Counter = Counter()
        member = {}
        seeds = Seeds(Counter(keys.values()), p.alike)
        for at, s in keys.items():
            c = seeds.of(s)
            if c is not None:
                member[at] = c
                groups[c] += 1
        least = max(2, math.ceil(p.header_share * sum(any(x.strip() for x in lines) for lines in pages)))
        running = {c for c, n in groups.items() if n >= least and not inside(c)}
        out.update({at: "header" for at, c in member.items() if c in running})
    for (k, pg, i), ns in numbers.items():
        n = max(ns, key=lambda n: offsets[k, n - pg])
        if (pg, i) in out:
            continue
        at = edges[k][pg]
        if i != at[0] and not (out.get((pg, at[0])) == "header"):
            continue
        alone = len(pages) == 1
        if offsets[k, n - pg] >= 2 or alone or pg + 1 in ns or not re.fullmatch(r"\W*\w+\W*", pages[pg][i].strip()):
            out[pg, i] = "page_no"
    return out


class Language:
    """Word counts, a trigram model of words for those without, and the shares of each character's misreads."""

    def __init__(self, counts: dict[str, int], params: ScanParams):
        self.params, self.counts, self.total = params, counts, max(1, sum(counts.values()))
        self.tri, self.bi = Counter(), Counter()
        for w, n in counts.items():
            if len({_script(c) for c in w if c != "-"}) == 1:
                x = f"^{w}$"
                weight = math.log1p(n)
                for i in range(len(x) - 1):
                    self.bi[x[i : i + 2]] += weight
                    self.tri[x[i : i + 3]] += weight
        self.common = max(3, params.meant_share * self.total)
        self.memo: dict[str, float] = {}
        self.shares: dict[tuple[str, str], float] = {}
        self._learn()

    def _learn(self) -> None:
        """How a character's misreads are shared out among what it looks like: first evenly, then as the words of mixed
        kinds that read as a common word in one way only show it."""
        tables = {"c": CYRILLIC_AS, "l": LATIN_AS, "d": DIGIT_AS}
        prior = {(t, c.lower()): 1.0 for table in tables.values() for t, seen in table.items() for c in seen}
        self.shares = dict.fromkeys(prior, math.log(1 / 3))
        reader, counts = Reader(self, self.params), Counter(prior)
        for w, n in self.counts.items():
            if not (w.isalpha() and w.isascii()) and len(set(_classes(w))) > 1 and n < self.common:
                common = {r for r, _, _ in reader.candidates(w)[1:] if len(r) == len(w) and self.counts.get(r.lower(), 0) >= self.common}
                if len(common) == 1:
                    counts.update({(t, c): n for t, c in zip(common.pop().lower(), w) if t != c})
        of: Counter = Counter()
        for (t, _), n in counts.items():
            of[t] += n
        self.shares = {(t, c): math.log(n / of[t]) for (t, c), n in counts.items()}

    def log(self, word: str) -> float:
        """The log probability of a word in lower case."""
        known = self.memo.get(word)
        if known is None:
            n = self.counts.get(word, 0)
            x = f"^{word}$"
            chars = sum(math.log((self.tri[x[i : i + 3]] + 0.05) / (self.bi[x[i : i + 2]] + 5)) for i in range(len(x) - 2))
            known = math.log(n / self.total + 1e-4 * math.exp(max(-200.0, chars)) + 1e-40)
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[word] = known
        return known


_NEVER = -120.0
_RARE = math.log(0.01)
_STAY, _CHANGE = math.log(0.94), math.log(0.06)
_WORD = re.compile(r"\S+")


def _parts(token: str) -> list[tuple[int, str]]:
    """(offset, part) of a token without outer punctuation, split at hyphens."""
    start = 0
    while start < len(token) and token[start] in _STRIP and not (token[start] in _SIGNS and token[start + 1 : start + 2].isalpha() and token[start] not in "(!"):
        start += 1
    end = len(token)
    while end > start and token[end - 1] in _STRIP:
        end -= 1
    return [(start + m.start(), m.group()) for m in re.finditer(r"[^-‐‑¬\xad–]+", token[start:end])]


def _classes(part: str) -> str:
    return "".join(_script(c) for c in part)


def _readings(part: str, own: str, shares: dict[tuple[str, str], float], most: int) -> list[tuple[str, int, float]]:
    """(reading, characters changed, log of their confusion shares): what the part may have been, were its script `own`."""
    table = {"c": _READ_C, "l": _READ_L, "d": _READ_D}[own]
    out = [("", 0, 0.0)]
    for c in part:
        if _script(c) == own and not (own == "l" and not c.isascii()) or own == "d" and c in ".,/:":
            out = [(w + c, n, p) for w, n, p in out]
            continue
        true = table.get(c) or table.get(c.lower()) or []
        if not true:
            return []
        up = c.isupper() or (own != "d" and part[:1].isupper() and part[1:].isupper())
        seen = c.lower()
        out = [(w + (t.upper() if up else t), n + 1, p + shares.get((t, seen), _RARE)) for w, n, p in out for t in true]
        if len(out) > most:
            out = sorted(out, key=lambda x: -x[2])[:most]
    return [x for x in out if x[1]]


class Reader:
    def __init__(self, language: Language, params: ScanParams):
        self.lm, self.params = language, params
        self.miss, self.keep = math.log(params.noise), math.log(1 - params.noise)
        self.memo: dict[str, list[tuple[str, float, str]]] = {}
        self.tokens: dict[str, list[tuple[int, str, list]]] = {}

    def _token(self, token: str) -> list[tuple[int, str, list]]:
        """(offset, part, candidates) of the parts of a token."""
        known = self.tokens.get(token)
        if known is None:
            if len(self.tokens) > 200_000:
                self.tokens.clear()
            known = self.tokens[token] = [(off, part, self.candidates(part)) for off, part in _parts(token)]
        return known

    def candidates(self, part: str) -> list[tuple[str, float, str]]:
        """(reading, log probability, script) of a part, what is written first."""
        known = self.memo.get(part)
        if known is not None:
            return known
        kinds = _classes(part)
        letters, digits = kinds.count("c") + kinds.count("l"), kinds.count("d")
        main = "c" if kinds.count("c") >= kinds.count("l") else "l"
        odd = bool(letters) and len(set(kinds)) > 1 or bool(digits) and any(c in "|!" for c in part)
        out = []
        tries = []
        if odd:
            if letters >= 2 or "s" in kinds or letters and digits == 0:
                tries += ["c", "l"] if kinds.count("c") and kinds.count("l") else [main]
            if digits and letters <= 2 and (not letters or "s" not in kinds.replace("s", "", sum(c in ".,/:" for c in part))):
                tries.append("d")
        elif main == "l" and letters == len(part) and len(part) <= 4:
            tries.append("c")  # a short word all of whose letters look like Cyrillic ones
        elif main == "c" and letters == len(part) and len(part) <= 2:
            tries += ["l"]
        for own in tries:
            for word, n, shares in _readings(part, own, self.lm.shares, self.params.readings):
                low = word.lower()
                p = self.lm.log(low) if own != "d" else math.log(0.02) - 2.3 * len(re.sub(r"\D", "", word))
                out.append((word, p + self.miss * n + shares + self.keep * (len(part) - n), own))
        # A word of mixed kinds counts as one that was meant so only where it is common, by itself and beside its readings.
        n = self.lm.counts.get(part.lower(), 0)
        most = max([0, *(self.lm.counts.get(w.lower(), 0) for w, _, _ in out)])
        meant = not odd or n >= self.lm.common and n >= 0.05 * most
        out.insert(0, (part, (self.lm.log(part.lower()) if meant else _NEVER) + self.keep * len(part), (main if letters else "d")))
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[part] = out
        return out

    def line(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, reading) of the misread parts of a line, by the best path through all candidates. A part that can
        be read in one way only parts the path in two, so only the stretches between such parts are decoded."""
        tokens = [self._token(t) for t in text.split()]
        if all(len(c) == 1 for own in tokens for _, _, c in own):
            return []
        parts, choices = [], []
        for m, own in zip(_WORD.finditer(text), tokens):
            for off, part, c in own:
                parts.append((m.start() + off, part))
                choices.append(c)
        found, i = [], 0
        while i < len(choices):
            if len(choices[i]) == 1:
                i += 1
                continue
            end = i
            while end < len(choices) and len(choices[end]) > 1:
                end += 1
            left = choices[i - 1][0][2] if i else None
            right = choices[end][0][2] if end < len(choices) else None
            for n, k in enumerate(self._decode(choices[i:end], left, right)):
                if k:
                    at, part = parts[i + n]
                    found.append((at, at + len(part), choices[i + n][k][0]))
            i = end
        return found

    def _decode(self, choices: list, left: str | None, right: str | None) -> list[int]:
        """The candidates of the best path between two scripts; digits go with any, a line's ends with all."""

        def step(a: str | None, b: str | None) -> float:
            return 0.0 if a is None or b is None else _STAY if a == b or "d" in (a, b) else _CHANGE

        scores = [(p - self.params.margin * (k > 0) + step(left, script)) for k, (_, p, script) in enumerate(choices[0])]
        back = []
        for before, own in zip(choices, choices[1:]):
            row, where = [], []
            for k, (_, p, script) in enumerate(own):
                best = max(range(len(before)), key=lambda j: scores[j] + step(before[j][2], script))
                row.append(scores[best] + step(before[best][2], script) + p - self.params.margin * (k > 0))
                where.append(best)
            scores = row
            back.append(where)
        k = max(range(len(scores)), key=lambda j: scores[j] + step(choices[-1][j][2], right))
        path = [k]
        for where in reversed(back):
            path.append(where[path[-1]])
        return path[::-1]


def _word_list(pages) -> list[str]:
    """The words of a document in lower case, hyphen compounds whole, and words broken at line ends left out."""
    out = []
    for text in pages or []:
        for line in (text or "").split("\n"):
            tokens = line.split()
            if tokens and tokens[-1][-1:] in BREAKS:
                tokens.pop()
            for t in tokens:
                t = t.strip(_STRIP).lower()
                if t:
                    out.append(t)
                    if "-" in t:
                        out += [x for x in t.split("-") if x]
    return out


def word_counts(df: DataFrame, pages_col: str, params: ScanParams = ScanParams()) -> DataFrame:
    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for pages in b.column(0).to_pylist():
                seen.update(_word_list(pages))
                if len(seen) > params.vocabulary:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return df.select(pages_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def language(df: DataFrame, pages_col: str, params: ScanParams = ScanParams()) -> Language:
    """Counted over different documents: replays and copies do not make their own misreads common."""
    different = df.select(pages_col).distinct()
    top = most_frequent(word_counts(different, pages_col, params), "n", params.vocabulary)
    return Language({r.word: r.n for r in top}, params)


def _joins(left: str, right: str, mark: str, lm: Language) -> bool:
    """Whether the mark at a line's end breaks a word, and is not part of it."""
    a = re.search(r"[^\W\d_][\w@|†]*$", left)
    b = re.match(r"[\w@|†]*[^\W\d_]", right)
    if not a or not b or not (right[:1].islower() or right[:1].isdigit() or right[:1] in _SIGNS):
        return False
    if mark not in "-‐‑–":
        return True
    b = re.match(r"[\w@|†]+", right)
    whole, compound = (a.group() + b.group()).lower(), f"{a.group()}-{b.group()}".lower()
    n, m = lm.counts.get(whole, 0), lm.counts.get(compound, 0)
    if n or m:
        return n >= m
    known = lm.counts.get(a.group().lower(), 0) > 20 and lm.counts.get(b.group().lower(), 0) > 20
    return not (known and lm.log(whole) < lm.log(a.group().lower()) + lm.log(b.group().lower()) + math.log(1e-3))


def repair(page_texts: list, reader: Reader, params: ScanParams) -> tuple[list[tuple[int, int, str]], str]:
    """The (page, line, kind) found, counted from 1, and the text in paragraphs parted by blank lines."""
    pages = [(t or "").split("\n") for t in page_texts]
    marks = furniture(pages, params)
    found = [(pg + 1, i + 1, kind) for (pg, i), kind in marks.items()]
    body = [(pg, i, x) for pg, lines in enumerate(pages) for i, x in enumerate(lines) if (pg, i) not in marks]
    text = [n for n, x in enumerate(body) if x[2].strip()]
    after = dict(zip(text, text[1:]))
    out: list[str] = []
    glue = False
    for n, (pg, i, line) in enumerate(body):
        if n not in after and not line.strip():
            if not glue and out and out[-1] and pg == body[n - 1][0]:
                out.append("")
            continue
        if not line.strip():
            if not glue and out and out[-1] and i and i + 1 < len(pages[pg]):
                out.append("")
            continue
        fixes = reader.line(line)
        if fixes:
            found.append((pg + 1, i + 1, "ocr"))
        fixed, last = [], 0
        for s, e, new in fixes:
            fixed += [line[last:s], new]
            last = e
        fixed = "".join([*fixed, line[last:]]).strip()
        bare = line.rstrip()
        broken = bare[-1:] in BREAKS and bare[-2:-1].isalpha() and n in after and _joins(bare[:-1], body[after[n]][2].strip(), bare[-1], reader.lm)
        if glue:
            out[-1] += fixed
        elif out and out[-1]:
            out[-1] += " " + fixed
        elif out:
            out[-1] = fixed
        else:
            out.append(fixed)
        glue = broken
        if broken:
            found.append((pg + 1, i + 1, "hyphen"))
            out[-1] = out[-1].rstrip().rstrip(BREAKS)
    return sorted(found), "\n\n".join(re.sub(r"[ \t]+", " ", x) for x in out if x)


def _documents(df: DataFrame, id_col: str, pages_col: str) -> DataFrame:
    return df.select(id_col, pages_col).filter(F.col(id_col).isNotNull() & (F.size(pages_col) > 0)).dropDuplicates([id_col])


def _mapped(df: DataFrame, id_col: str, pages_col: str, lm: Language | None, params: ScanParams, names: list[str], schema: str, rows):
    docs = _documents(df, id_col, pages_col)
    held = df.sparkSession.sparkContext.broadcast(language(df, pages_col, params) if lm is None else lm)  # bounded by params.vocabulary

    def run(batches):
        reader = Reader(held.value, params)
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for key, pages in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for row in rows(*repair(pages, reader, params)):
                    for c, v in zip(cols, (key, *row)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema)], names=names)

    kinds = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long"}
    return docs.mapInArrow(run, ", ".join(f"`{n}` {kinds[t]}" for n, t in zip(names, schema)))


def find_noise(df: DataFrame, id_col: str, pages_col: str, lm: Language | None = None, params: ScanParams = ScanParams()) -> DataFrame:
    """(id, page_no, line_no, kind): running lines ('header'), page numbers ('page_no'), lines that end in a broken
    word ('hyphen') and lines with misread characters ('ocr'); numbers count from 1, blank lines included.

    String ids. A repeated id counts once; null ids, null or empty arrays give no rows; null pages count as empty ones.
    """
    return _mapped(df, id_col, pages_col, lm, params, [id_col, "page_no", "line_no", "kind"], [pa.string(), pa.int32(), pa.int32(), pa.string()], lambda found, _: found)


def repair_pages(df: DataFrame, id_col: str, pages_col: str, lm: Language | None = None, params: ScanParams = ScanParams()) -> DataFrame:
    """(id, text): each document as continuous paragraphs, parted by blank lines; other cases as in find_noise."""
    return _mapped(df, id_col, pages_col, lm, params, [id_col, "text"], [pa.string(), pa.string()], lambda _, text: [(text,)])
