"""Encoding whole texts with a public byte-level BPE vocabulary.

Words (the matches of the vocabulary's pattern) are counted over the whole corpus; the most frequent ones are merged
once and compiled with their ids into an automaton (lexicon.py) that executors memory-map. Words that the lexicon
lacks are merged exactly, so the lexicon's size changes the speed only.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.frequent import most_frequent
from tessera.llm.lexicon import Lexicon, compiled
from tessera.runtime import shared_dir

#: Fixed value: the pattern that splits text before the merges of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class BpeParams:
    ranks: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # a file of the driver: lines of a base64 token and its id
    words: int = 60_000  # words compiled into the lexicon; all others are merged when met
    memo: int = 500_000  # words whose ids a worker remembers
    counted: int = 200_000  # different words counted before a task passes its counts on


class Merger:
    """The exact merges of single words."""

    def __init__(self, ranks: str):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._bpe = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})

    def ids(self, word: str) -> list[int]:
        return self._bpe.encode_ordinary(word)


def _share(spark: SparkSession, data: bytes) -> str:
    """Writes data to the shared folder and makes it a file of the application; gives its name."""
    name = f"lexicon-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    for at in range(0, len(data), 1 << 22):
        out.write(bytearray(data[at : at + (1 << 22)]))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def _ship(spark: SparkSession, path: str) -> str:
    """Makes the driver's vocabulary file a file of the application; gives its name."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def word_counts(df: DataFrame, text_col: str, params: BpeParams = BpeParams()) -> DataFrame:
    """(word, n): how often each word of the vocabulary's pattern occurs in all texts."""

    def run(batches):
        find, seen = regex.compile(PATTERN).findall, Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(find(text))
                if len(seen) > params.counted:
                    yield out()
                    seen = Counter()
        yield out()

    rows = df.select(F.col(text_col).alias("text")).filter(F.length("text") > 0)
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, text_col: str, params: BpeParams = BpeParams()) -> str:
    """Compiles the most frequent words; gives the name of the application file with the lexicon."""
    top = most_frequent(word_counts(df, text_col, params), "n", params.words)
    merger = Merger(params.ranks)
    return _share(df.sparkSession, compiled((r.word.encode(), merger.ids(r.word)) for r in top))


class _Encoder:
    def __init__(self, lexicon: str, ranks: str, params: BpeParams):
        self.params, self.find = params, regex.compile(PATTERN).findall
        self.lexicon, self.ranks, self.merger = Lexicon(SparkFiles.get(lexicon)), ranks, None
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.start, self.size, self.flat, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 16, np.int32), 0

    def _learn(self, words: list[str]) -> None:
        numbers = self.lexicon.numbers([w.encode() for w in words])
        for w, n in zip(words, numbers.tolist()):
            if n >= 0:
                ids = self.lexicon.get(n)
            else:
                if self.merger is None:
                    self.merger = Merger(SparkFiles.get(self.ranks))
                ids = self.merger.ids(w)
            at, end = len(self.memo), self.used + len(ids)
            if at >= len(self.start):
                self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
            while end > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : end], self.start[at], self.size[at] = ids, self.used, len(ids)
            self.memo[w], self.used = at, end

    def batch(self, texts: list[str | None], want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """The number of ids of each text, and all ids after each other."""
        words, ends = [], []
        for t in texts:
            if t:
                words += self.find(t)
            ends.append(len(words))
        if len(self.memo) > self.params.memo:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.memo]
        if new:
            self._learn(new)
        word = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        size = self.size[word]
        total = np.concatenate([[0], np.cumsum(size)])
        upto = total[np.array([0, *ends])]
        ids = None
        if want_ids:
            ids = self.flat[np.repeat(self.start[word] - total[:-1], size) + np.arange(total[-1])]
        return np.diff(upto), ids


def _slices(b: pa.RecordBatch, at: int, chars: int):
    """Parts of a batch with about so many bytes of text, so that a worker's memory is bounded by one text."""
    size = pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // chars
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
        yield b.slice(lo, hi - lo)


def encode(df: DataFrame, id_col: str, text_col: str, lexicon: str | None = None, params: BpeParams = BpeParams(), sizes_only: bool = False) -> DataFrame:
    """(id, ids), or (id, n_tokens) with sizes_only: the ids of each whole text, special tokens aside.

    Null and empty texts have an empty list (0 ids). One row for each row of df, repeated ones included; only id_col
    and text_col are read. A lexicon built before, over any texts, may be given: the ids do not depend on it.
    """
    lexicon = build_lexicon(df, text_col, params) if lexicon is None else lexicon
    ranks = _ship(df.sparkSession, params.ranks)

    def run(batches):
        encoder = _Encoder(lexicon, ranks, params)
        for whole in batches:
            for b in _slices(whole, 1, 4_000_000):
                size, ids = encoder.batch(b.column(1).to_pylist(), not sizes_only)
                if sizes_only:
                    out = pa.array(size, pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), out], names=[id_col, out_col])

    out_col = "n_tokens" if sizes_only else "ids"
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {out_col} {'long' if sizes_only else 'array<int>'}")
