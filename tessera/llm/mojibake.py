"""Finding and undoing text that was decoded with the wrong character encoding.

Adjacent characters are scored by their cubed mutual information over the whole corpus (log of p(ab)^3 / p(a)p(b); the
cube keeps pairs of rare characters, such as garbled ones, from scoring high just for meeting each other). Runs whose
pairs are improbable are isolated as maximum-scoring segments, and only inside those runs are the inverse mappings of
(read as, written in) pairs of encodings tried, token by token; what a mapping gains on a token is remembered, as tokens
recur. A mapping is accepted where it makes the run much more probable, or turns it into valid UTF-8.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frequent import most_frequent
from tessera.runtime import spool

#: Encodings that texts are wrongly read as, encodings that they were written in, and more that
#: UTF-8 is read as.
READ_AS = ("cp1252", "cp1251", "cp866", "koi8-r", "mac-cyrillic", "mac-roman", "cp850", "cp437", "iso8859-5", "cp1250")
WRITTEN_IN = ("utf-8", "cp1251", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5", "cp1252", "mac-roman", "cp850", "cp1250")
UTF8_READ_AS = ("cp1254", "iso8859-2")


@dataclass(frozen=True)
class GarbleParams:
    alphabet: int = 4096  # bound of the characters with counts of their own; any others, of scripts of thousands, share 64 classes
    low_share: float = 0.1  # share of the corpus's pairs that count as improbable
    run_score: float = 3.0  # least score of an improbable run, and of one in a text known to be garbled
    kin_score: float = 1.0
    memo: int = 100_000  # tokens whose gains a worker remembers
    utf8_gain: float = 4.0  # least gain of an accepted mapping to UTF-8, and to a one-byte encoding
    byte_gain: float = 14.0
    char_gain: float = 6.0  # the most that a letter counts that becomes another one, and any other change
    sign_gain: float = 18.0
    odd_gain: float = 12.0  # what a word counts that was odd and is no longer
    passes: int = 4  # texts garbled repeatedly, or in several stretches, are undone so many times
    read_as: tuple[str, ...] = READ_AS
    written_in: tuple[str, ...] = WRITTEN_IN
    utf8_read_as: tuple[str, ...] = UTF8_READ_AS


_OTHERS = 64
_SEP = 0  # the character put between texts
_KINDS = np.zeros(0x110000, np.uint8)  # 1: small letter, 2: capital
_LOWER = np.arange(0x110000, dtype=np.uint32)
for _c in range(0x3000):
    _s = chr(_c)
    if _s.isupper() and len(_s.lower()) == 1:
        _LOWER[_c], _KINDS[_c] = ord(_s.lower()), 2
    elif _s.islower():
        _KINDS[_c] = 1
_LOWER[0x30:0x3A] = 0x30
_SIGNS = (_KINDS == 0) & (np.arange(0x110000) >= 0x80)
_SIGNS[[0xAD, 0xB7, 0x2010, 0x2011, 0x2013, 0x2014, 0x2018, 0x2019, 0x2BC, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]] = False  # may stand in a word
del _c, _s


def _raw(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _joined(texts) -> str:
    return "\x00" + "\x00".join(t for t in texts if t) + "\x00"


def _chunks(b: pa.RecordBatch, at: int, chars: int = 300_000):
    held, size = [], 0
    for i, t in enumerate(b.column(at).to_pylist()):
        if t:
            held.append((i, t))
            size += len(t)
        if size > chars:
            yield held
            held, size = [], 0
    yield held


class PairScores:
    """Scores of adjacent characters; its size is bounded by the alphabet, whatever the corpus."""

    def __init__(self, alphabet: list[int], counts: dict[int, int], params: GarbleParams):
        self.alphabet, self.width = alphabet, len(alphabet) + _OTHERS
        n = np.zeros((self.width, self.width))
        for key, c in counts.items():
            n[key // self.width, key % self.width] = c
        total = max(1.0, n.sum())
        left, right = n.sum(1) + 1, n.sum(0) + 1
        with np.errstate(divide="ignore"):
            mi = 3 * np.log((n + 0.02) / total) - np.log(left / total)[:, None] - np.log(right / total)[None, :]
        order = np.argsort(mi, axis=None)
        share = np.cumsum(n.ravel()[order]) / total
        cut = mi.ravel()[order[min(len(order) - 1, int(np.searchsorted(share, params.low_share)))]]
        # In units in which a typical pair of the corpus lies some 4 above the cut.
        typical = float((mi * n).sum() / total)
        self.score = np.clip((mi - cut) / max(1e-9, typical - cut) * 4, -8, 5).astype(np.float32)
        self._lut = None

    def ids(self, raw: np.ndarray) -> np.ndarray:
        """The class of each character: letters in lower case, unless a capital follows a small letter; digits as one."""
        if self._lut is None:
            own = (len(self.alphabet) + (np.arange(0x110000) >> 8) % _OTHERS).astype(np.int16)
            own[np.array(self.alphabet, np.int64)] = np.arange(len(self.alphabet))
            self._lut = own, own[_LOWER]
        own, lower = self._lut
        ids, kind = lower[raw], _KINDS[raw]
        inner = np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1)) + 1
        ids[inner] = own[raw[inner]]
        return ids

    def of(self, raw: np.ndarray) -> np.ndarray:
        """The score of each adjacent pair."""
        ids = self.ids(raw)
        return self.score[ids[:-1], ids[1:]]

    def __getstate__(self):
        return self.__dict__ | {"_lut": None}


def _different(rows: DataFrame) -> DataFrame:
    """(key, text) of the different texts that have content, the key a hash of the text."""
    return spool(rows.filter(F.length("text") > 0).select(F.md5("text").alias("key"), "text").distinct(), "garble-texts")


def pair_scores(df: DataFrame, text_col: str, params: GarbleParams = GarbleParams()) -> PairScores:
    """Counts characters, then pairs of adjacent characters, over all different whole texts: copies of a garbled text do
    not make it probable."""
    return _pair_scores(_different(df.select(F.col(text_col).alias("text"))), params)


def _pair_scores(texts: DataFrame, params: GarbleParams) -> PairScores:
    rows = texts.select("text")

    def characters(batches):
        n = np.zeros(0x110000, np.int64)
        for b in batches:
            for held in _chunks(b, 0):
                part = np.bincount(_raw(_joined(t for _, t in held)))
                n[: len(part)] += part
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["key", "n"])

    counts = rows.mapInArrow(characters, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = {r.key for r in most_frequent(counts, "n", params.alphabet // 2)}
    alphabet = sorted(found | {int(_LOWER[c]) for c in found})
    empty = PairScores(alphabet, {}, params)

    def pairs(batches):
        n = np.zeros(empty.width * empty.width, np.int64)
        for b in batches:
            for held in _chunks(b, 0):
                ids = empty.ids(_raw(_joined(t for _, t in held))).astype(np.int64)
                n += np.bincount(ids[:-1] * empty.width + ids[1:], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["key", "n"])

    table = rows.mapInArrow(pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return PairScores(alphabet, {r.key: r.n for r in table}, params)


def maximal_segments(gain: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal-scoring segments, in linear time over runs of one sign."""
    if not len(gain):
        return []
    cuts = np.concatenate([[0], np.flatnonzero((gain[1:] > 0) != (gain[:-1] > 0)) + 1])
    sums = np.add.reduceat(gain.astype(np.float64), cuts)
    ends = np.append(cuts[1:], len(gain))
    done: list[list] = []
    kept: list[list] = []  # [start, end, total before, total after]
    total = 0.0
    for s, e, v in zip(cuts.tolist(), ends.tolist(), sums.tolist()):
        if v <= 0:
            total += v
            if total < -1e6:  # a border: nothing joins across it
                done += kept
                kept, total = [], 0.0
            continue
        new = [s, e, total, total + v]
        total += v
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                break
            new[0], new[2] = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append(new)
    return [(k[0], k[1], k[3] - k[2]) for k in done + kept]


class _Codec:
    """One-byte encodings with their undefined bytes as the characters of the same number."""

    def __init__(self, name: str):
        chars = [bytes([i]).decode(name, "replace") for i in range(256)]
        free = [i for i, c in enumerate(chars) if c == "\ufffd"]
        self.bytes = {c: i for i, c in enumerate(chars) if c != "\ufffd"}
        for i in free:
            self.bytes.setdefault(chr(i), i)
        for i in range(0x80, 0xA0):  # control characters survive a lenient reading
            self.bytes.setdefault(chr(i), i)
        if free:
            self.bytes.setdefault("\ufffd", free[0])
        self.chars = [c if c != "\ufffd" else chr(i) for i, c in enumerate(chars)]

    def encode(self, text: str) -> bytes | None:
        try:
            return bytes([self.bytes[c] for c in text])
        except KeyError:
            return None


_NO = 0xFFFF  # stands for a character that an encoding lacks


class Mappings:
    """The inverse mappings, as tables over the characters of the basic plane."""

    def __init__(self, params: GarbleParams):
        self.codecs = {n: _Codec(n) for n in {*params.read_as, *params.utf8_read_as, *params.written_in} - {"utf-8"}}
        self.byte = {}
        for n in (*params.read_as, *params.utf8_read_as):
            table = np.full(0x10000, -1, np.int16)
            for c, i in self.codecs[n].bytes.items():
                table[ord(c)] = i
            table[:0x80] = np.arange(0x80)
            self.byte[n] = table
        self.known = {n: re.compile(f"[{re.escape(''.join(c.bytes))}\\x00-\\x7f]+").fullmatch for n, c in self.codecs.items()}
        self.pairs = [(r, w) for r in params.read_as for w in params.written_in if r != w] + [(r, "utf-8") for r in params.utf8_read_as]

    def holds(self, read_as: str, tokens: list[str]) -> np.ndarray:
        """Which tokens have no character that the encoding lacks."""
        return np.fromiter((self.known[read_as](t) is not None for t in tokens), bool, len(tokens))

    def bytes_of(self, raw: np.ndarray, read_as: str) -> np.ndarray:
        return np.where(raw < 0x10000, self.byte[read_as][np.minimum(raw, 0xFFFF)], -1)

    def characters(self, data: np.ndarray, written_in: str) -> np.ndarray:
        """The code points of bytes in a one-byte encoding."""
        to = np.array([*map(ord, self.codecs[written_in].chars), _NO], np.uint32)
        to[:0x80] = np.arange(0x80)
        return to[data]  # -1 takes the last entry

    def undo(self, token: str, read_as: str, written_in: str) -> str | None:
        if token.isascii():
            return token
        raw = self.codecs[read_as].encode(token)
        if raw is None:
            return None
        if written_in != "utf-8":
            to = self.codecs[written_in].chars
            return "".join([to[i] for i in raw])
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return None


def _sequences(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where UTF-8 sequences of several bytes start, and which bytes above ASCII belong to none."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(3, data.dtype)])
    cont = (padded >= 0x80) & (padded <= 0xBF)
    two = (data >= 0xC2) & (data <= 0xDF) & cont[1 : n + 1]
    three = (data >= 0xE0) & (data <= 0xEF) & cont[1 : n + 1] & cont[2 : n + 2]
    four = (data >= 0xF0) & (data <= 0xF4) & cont[1 : n + 1] & cont[2 : n + 2] & cont[3 : n + 3]
    held = two | three | four
    covered = held.copy()
    for step, lead in ((1, held), (2, three | four), (3, four)):
        covered[step:] |= lead[:-step]
    return held, ((data >= 0x80) & ~covered) | (data < 0)


_TOKEN = re.compile(r"[^ \t\r\n]+")


class _Tokens:
    """Tokens between blanks, as one array of code points."""

    def __init__(self, scores: PairScores, tokens: list[str]):
        self.raw = _raw(" " + " ".join(tokens) + " ")
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts = np.cumsum(size + 1) - size
        self.cuts = np.stack([starts, starts + size], 1).ravel()
        self.pair_cuts = np.stack([starts - 1, starts + size], 1).ravel()
        self.before = self.pair_sum(scores.of(self.raw))
        self.odd = self.is_odd(self.raw)

    def chars(self, x: np.ndarray) -> np.ndarray:
        """How many of a token's characters are marked."""
        return np.add.reduceat(x.view(np.int8), self.cuts, dtype=np.int32)[::2]

    def pair_sum(self, x: np.ndarray) -> np.ndarray:
        """The sum over a token's pairs, those with the blanks included."""
        return np.add.reduceat(np.append(x, np.float32(0)), self.pair_cuts, dtype=np.float64)[::2]

    def is_odd(self, x: np.ndarray) -> np.ndarray:
        """Which tokens no writer writes: with letters of both the Latin and the Cyrillic script, with a sign or a capital
        within a word in small letters, or with a control character."""
        kind = _KINDS[x]
        letter, small = kind > 0, kind == 1
        latin, cyrillic = (x < 0x250) & letter, (x >= 0x400) & (x < 0x530)
        within = (x >= 0x80) & (x < 0xA0)
        within[1:-1] |= small[:-2] & (_SIGNS[x[1:-1]] & small[2:] | (kind[1:-1] == 2))
        return (self.chars(latin) > 0) & (self.chars(cyrillic) > 0) | (self.chars(within) > 0)


class Repairer:
    def __init__(self, scores: PairScores, params: GarbleParams):
        self.scores, self.params, self.maps = scores, params, Mappings(params)
        self.rows: dict[str, int] = {}
        self.gain = np.zeros((0, len(self.maps.pairs)), np.float32)
        self.least = np.array([params.utf8_gain if w == "utf-8" else params.byte_gain for _, w in self.maps.pairs])
        self.is_space = np.zeros(0x110000, bool)
        self.is_space[[0, 9, 10, 13, 32]] = True

    def runs(self, whole: str, least: float) -> list[tuple[int, int]]:
        """The improbable runs of texts joined by NUL that score `least`, widened by a token on each side."""
        raw = _raw(whole)
        gain = -self.scores.of(raw)
        border = raw == _SEP
        gain[border[:-1] | border[1:]] = -1e7
        # The best sum that ends at each place falls to 0 between excursions; a segment lies within one of them.
        total = np.cumsum(gain, dtype=np.float64)
        best = total - np.minimum(np.minimum.accumulate(total), 0)
        cuts = np.concatenate([[0], np.flatnonzero(best <= 0), [len(best)]])
        cuts = cuts[np.concatenate([[True], np.diff(cuts) > 0])]
        if len(cuts) < 2:
            return []
        high = np.maximum.reduceat(best, cuts[:-1]) >= least
        gain[cuts[:-1]] = np.where(gain[cuts[:-1]] > 0, gain[cuts[:-1]], -1e7)  # an excursion starts with what no segment holds
        at = np.flatnonzero(np.repeat(high, np.diff(cuts)))
        found = [(int(at[s]), int(at[e - 1]) + 2, v) for s, e, v in maximal_segments(gain[at]) if v >= least]
        if not found:
            return []
        space, ends = np.flatnonzero(self.is_space[raw]), np.flatnonzero(border)
        s, e = (np.array(x) for x in list(zip(*found))[:2])
        text = np.searchsorted(ends, s, side="right") - 1  # of the text
        lo = space[np.maximum(np.searchsorted(space, s, side="right") - 2, 0)]
        hi = space[np.minimum(np.searchsorted(space, e - 1) + 1, len(space) - 1)]
        lo, hi = np.maximum(lo, ends[text]) + 1, np.minimum(hi, ends[text + 1])
        out: list[list] = []
        for a, b in zip(lo.tolist(), hi.tolist()):
            if out and a <= out[-1][1] + 1 and whole.find("\x00", out[-1][1], a) < 0:
                out[-1][1] = max(b, out[-1][1])
            elif b > a:
                out.append([a, b])
        return [(a, b) for a, b in out if not whole[a:b].isascii()]

    def _memo(self, tokens: list[str]) -> np.ndarray:
        """The row of `gain` of every token; a token met before is not scored again."""
        new = [t for t in dict.fromkeys(tokens) if t not in self.rows]
        if new:
            if len(self.rows) + len(new) > self.params.memo:
                self.rows, self.gain = {}, self.gain[:0]
                new = list(dict.fromkeys(tokens))
            self.rows |= {t: len(self.rows) + i for i, t in enumerate(new)}
            self.gain = np.concatenate([self.gain, self._gains(new)])
        return np.fromiter(map(self.rows.__getitem__, tokens), np.int64, len(tokens))

    def _gains(self, tokens: list[str]) -> np.ndarray:
        """What each mapping gains on each token, which is taken to stand between blanks."""
        out = np.zeros((len(tokens), len(self.maps.pairs)), np.float32)
        plain = np.array([t.isascii() for t in tokens])
        for col, (read_as, _) in enumerate(self.maps.pairs):
            if not col or read_as != self.maps.pairs[col - 1][0]:
                every = np.flatnonzero(~plain & self.maps.holds(read_as, tokens))
                own = [tokens[i] for i in every]
                part = _Tokens(self.scores, own)
                data = self.maps.bytes_of(part.raw, read_as)
            out[~plain, col] = -4
            if own:
                out[every, col] = self._gain(part, own, data, *self.maps.pairs[col])
        return out

    def _gain(self, part: _Tokens, tokens: list[str], data: np.ndarray, read_as: str, written_in: str) -> np.ndarray:
        if written_in == "utf-8":
            lead, bad = _sequences(data)
            gain = np.where(part.chars(bad) > 0, -4.0, 4.0 * part.chars(lead))
            for t in np.flatnonzero(gain > 0):
                u = self.maps.undo(tokens[t], read_as, written_in)
                if u is None or not self._known(u):
                    gain[t] = -4.0
            return gain
        new = self.maps.characters(data, written_in)
        changed = part.chars(new != part.raw) > 0
        gain = part.pair_sum(self.scores.of(new)) - part.before
        was, is_ = _KINDS[part.raw] > 0, _KINDS[new] > 0
        swapped = part.chars((new != part.raw) & was & is_)
        most = self.params.char_gain * swapped + self.params.sign_gain * part.chars((new != part.raw) & ~(was & is_))  # what the changed characters can prove,
        gain = np.minimum(gain, most)
        gain = gain + self.params.odd_gain * (part.odd.astype(int) - part.is_odd(new))  # unless a word that cannot be becomes one that can
        short = np.clip(gain, -4, 3)  # a short word goes along with its neighbours, but proves little
        letters, before = part.chars(is_), part.chars(was)
        return np.where(changed, np.where((letters >= 5) | (letters >= 3) & (before >= 2), gain, short), 0.0)

    def best(self, runs: list[str], only: set[tuple[str, str]] | None = None) -> list[tuple[tuple, tuple[str, str], np.ndarray] | None]:
        """For every run its best mapping, of all or of some: (rank, mapping, gain of each token)."""
        tokens, first = [], [0]
        for r in runs:
            tokens += _TOKEN.findall(r)
            first.append(len(tokens))
        best: list = [None] * len(runs)
        if not tokens:
            return best
        at = self._memo(tokens)
        full = np.flatnonzero(np.diff(first))
        sums = np.add.reduceat(np.maximum(self.gain[at], 0), np.array(first)[full], axis=0)
        for r, col in zip(*np.nonzero(sums >= self.least)):
            mapping, r = self.maps.pairs[col], full[r]
            if only is not None and mapping not in only:
                continue
            gain = self.gain[at[first[r] : first[r + 1]], col]
            top = _top_stretch(gain)[0]
            rank = (mapping[1] == "utf-8" and top > 4, top)  # chance does not make several valid sequences
            if top >= self.least[col] and (best[r] is None or rank > best[r][0]):
                best[r] = (rank, mapping, gain)
        return best

    def _known(self, text: str) -> bool:
        """Whether all characters occur in the corpus or are letters and marks of common scripts."""
        x = _raw(text)
        usual = (x < 0x80) | (x >= 0xA0) & (x < 0x180) | (x >= 0x386) & (x < 0x3CF) | (x >= 0x400) & (x < 0x530) | (x >= 0x2010) & (x < 0x2045) | (x >= 0x20A0) & (x < 0x20D0) | (x == 0x2116) | (x == 0x2122)
        return bool((usual | (self.scores.ids(x) < len(self.scores.alphabet))).all())

    def _apply(self, run: str, mapping: tuple[str, str], gain: np.ndarray) -> str:
        """The run with the best stretch of tokens mapped; tokens between mapped ones are mapped where they can be."""
        _, lo, hi = _top_stretch(gain) if mapping[1] != "utf-8" else (0, 0, len(gain))  # what is valid UTF-8 needs no neighbours
        out, last = [], 0
        for i, m in enumerate(_TOKEN.finditer(run)):
            if lo <= i < hi:
                new = self.maps.undo(m.group(), *mapping)
                if new is not None and (mapping[1] != "utf-8" or gain[i] > 0):
                    out += [run[last : m.start()], new]
                    last = m.end()
        return "".join([*out, run[last:]])

    def _pass(self, now: list[str], which: list[int], least: float, only: set[tuple[str, str]] | None = None) -> dict[int, set]:
        """Undoes what it finds in the given texts; gives the mappings used in each text that changed."""
        whole = "\x00" + "\x00".join(now[i] for i in which) + "\x00"
        starts = np.cumsum([1, *(len(now[i]) + 1 for i in which)])
        found = self.runs(whole, least)
        own: dict[int, list] = {}
        for (a, b), fix in zip(found, self.best([whole[a:b] for a, b in found], only)):
            if fix is not None:
                k = int(np.searchsorted(starts, a, side="right")) - 1
                own.setdefault(which[k], []).append((a - int(starts[k]), b - int(starts[k]), fix))
        for i, fixes in own.items():
            out, last = [], 0
            for a, b, (_, mapping, gain) in fixes:
                out += [now[i][last:a], self._apply(now[i][a:b], mapping, gain)]
                last = b
            now[i] = "".join([*out, now[i][last:]])
        return {i: {m for _, _, (_, m, _) in fixes} for i, fixes in own.items()}

    def repair(self, texts: list[str]) -> list[str | None]:
        """The restored texts, None for those in which nothing was garbled."""
        now, p = list(texts), self.params
        open_ = [i for i, t in enumerate(texts) if t]
        for _ in range(p.passes):
            used = self._pass(now, open_, p.run_score) if open_ else {}
            # In a text known to be garbled less improbable runs are tried as well, with the mappings found in it.
            groups: dict[frozenset, list[int]] = {}
            for i, own in used.items():
                groups.setdefault(frozenset(own), []).append(i)
            for own, again in groups.items():
                for _ in range(p.passes):
                    again = list(self._pass(now, again, p.kin_score, set(own))) if again else again
            open_ = list(used)
        return [t if t != texts[i] else None for i, t in enumerate(now)]


def _top_stretch(gain: np.ndarray) -> tuple[float, int, int]:
    """The best sum over consecutive tokens, and where it lies."""
    top, total, at = (0.0, 0, 0), 0.0, 0
    for i, g in enumerate(gain.tolist()):
        total += g
        if total <= 0:
            total, at = 0.0, i + 1
        elif total > top[0]:
            top = (total, at, i + 1)
    return top


def restore(df: DataFrame, id_col: str, text_col: str, scores: PairScores | None = None, params: GarbleParams = GarbleParams()) -> DataFrame:
    """(id, text): the restored text of every row whose text was at least partly decoded with a wrong encoding.

    Null and empty texts and sound ones give no row; repeated rows give a row each; ids may be null. Only id_col and
    text_col are read. Each different text is repaired once. Scores counted before, over another corpus, may be given.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = _different(rows)
    scores = _pair_scores(texts, params) if scores is None else scores
    held = df.sparkSession.sparkContext.broadcast(scores)  # at most (alphabet + 64)^2 numbers

    def run(batches):
        repairer = Repairer(held.value, params)
        for b in batches:
            for part in _chunks(b, 1, 1_000_000):
                fixed = [(i, t) for (i, _), t in zip(part, repairer.repair([t for _, t in part])) if t is not None]
                row, texts = [i for i, _ in fixed], [t for _, t in fixed]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(texts, pa.string())], names=["key", "text"])

    fixed = texts.mapInArrow(run, "key string, text string")
    keys = rows.filter(F.length("text") > 0).select("id", F.md5("text").alias("key"))
    return keys.join(fixed, "key").select(F.col("id").alias(id_col), F.col("text").alias("text"))
