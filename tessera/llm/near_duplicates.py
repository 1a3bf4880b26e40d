"""Near-duplicate texts: all pairs whose sets of words are alike, without comparing all pairs.

A text's fingerprint is a row of min-hash symbols of its word set. It is split into blocks; two texts that share no
block differ in at least as many symbols as there are blocks (pigeonhole), which for texts over the threshold has
probability (1 - t**r)**blocks. Texts are joined on their blocks, pairs are verified by the Hamming distance of a
128-bit sketch of the fingerprint, and the few that remain by the exact similarity of their word sets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.space import trimmed
from tessera.runtime import spool

#: A word is a maximal run of letters and digits.
_WORD = re.compile(r"[^\W_]+").findall


@dataclass(frozen=True)
class NearParams:
    threshold: float = 0.8
    blocks: int = 48
    symbols: int = 6  # symbols in a block: at 0.75, 48 blocks of 6 miss a pair with probability 1e-4
    seed: int = 11
    sigmas: float = 5.0  # how far beyond its mean at the threshold the sketches' distance may lie
    partition_bytes: int = 16 << 20  # aimed at in a partition of the joins on blocks and on word sets, whatever the input
    full_class: int = 64  # a class of exactly equal items up to this size gives all its pairs, a larger one a star

    def distance(self) -> int:
        """The greatest Hamming distance of two 128-bit sketches: bits differ with probability (1 - t) / 2."""
        p = (1 - self.threshold) / 2
        return int(np.ceil(128 * p + self.sigmas * np.sqrt(128 * p * (1 - p))))


class _Hashes:
    """64-bit hashes of words, remembered for the words met often."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def of(self, words) -> np.ndarray:
        memo = self.memo
        if len(memo) > 500_000:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter((memo[w] for w in words), np.uint64, len(words))


def fingerprints(df: DataFrame, id_col: str, text_col: str, least_words: int, params: NearParams) -> DataFrame:
    """(id, hashes, class_key, text_key, sketch_a, sketch_b, blocks) of every text with at least least_words different
    words; hashes is the set of its words' 64-bit hashes, class_key stands for that set, text_key for the text itself."""
    rng = np.random.default_rng(params.seed)
    n = max(params.blocks * params.symbols, 128)
    mult = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, n, dtype=np.uint64)
    weight = rng.integers(0, 2**63, params.symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    names = ["id", "hashes", "class_key", "text_key", "sketch_a", "sketch_b", "blocks"]

    def run(batches):
        hashes = _Hashes()
        for b in batches:
            row, sets, key, own_key, sketch, blocks = [], [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                words = set(_WORD(text.lower()))
                if len(words) < least_words:
                    continue
                h = np.sort(hashes.of(words))
                low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(h), 256):
                    np.minimum(low, (h[at : at + 256, None] * mult + add).min(0), out=low)
                low ^= low >> np.uint64(29)
                row.append(i)
                sets.append(h)
                key.append(xxhash.xxh3_128_hexdigest(h.tobytes()))
                own_key.append(xxhash.xxh3_128_hexdigest(text))
                odd = (low[:128] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63)
                sketch.append(((odd[:64] * bit).sum(dtype=np.uint64), (odd[64:] * bit).sum(dtype=np.uint64)))
                own = low[: params.blocks * params.symbols].reshape(params.blocks, params.symbols)
                mixed = (own * weight).sum(1, dtype=np.uint64) + np.arange(params.blocks, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                blocks.append(mixed)
            k = len(row)
            two = np.array(sketch, np.uint64).reshape(-1, 2).view(np.int64)
            flat = np.concatenate(blocks).view(np.int64) if blocks else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * params.blocks, pa.int32()), pa.array(flat))
            words = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            words = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(words))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), words, pa.array(key, pa.string()), pa.array(own_key, pa.string()), pa.array(two[:, 0]), pa.array(two[:, 1]), lists], names=names
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= 2 * least_words - 1))
    return rows.mapInArrow(run, f"id {kind}, hashes array<long>, class_key string, text_key string, sketch_a long, sketch_b long, blocks array<long>")


def partitions(df: DataFrame, size: int, params: NearParams) -> int:
    """How many partitions hold `size` bytes; never fewer than the session's own number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // params.partition_bytes))


def candidate_pairs(prints: DataFrame, params: NearParams, texts: int | None = None) -> DataFrame:
    """(a, b), a < b: pairs that share a block and pass the Hamming test; ids must be unique.

    The number of partitions follows the number of texts. A block that many texts share is one key of an inner join,
    which adaptive execution splits; what it costs is its pairs.
    """
    t = params.threshold
    texts = prints.count() if texts is None else texts
    blocks = prints.select("id", "words", "sketch_a", "sketch_b", F.explode("blocks").alias("block"))
    blocks = blocks.repartition(partitions(prints, texts * params.blocks * 72, params), "block")
    a, b = blocks.alias("a"), blocks.alias("b")
    ham = F.bit_count(F.col("a.sketch_a").bitwiseXOR(F.col("b.sketch_a"))) + F.bit_count(F.col("a.sketch_b").bitwiseXOR(F.col("b.sketch_b")))
    near = (
        (F.col("a.block") == F.col("b.block")) & (F.col("a.id") < F.col("b.id"))
        & (F.col("a.words") >= t * F.col("b.words")) & (F.col("b.words") >= t * F.col("a.words"))
        & (ham <= params.distance())
    )
    return a.join(b, near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def verified_pairs(prints: DataFrame, pairs: DataFrame, params: NearParams) -> DataFrame:
    """The pairs whose exact Jaccard similarity is at least the threshold; ids must be unique."""
    threshold = params.threshold
    words = prints.agg(F.sum(F.size("hashes")).alias("n"), F.count("*").alias("texts")).first()
    sets = prints.select("id", "hashes").repartition(partitions(prints, 8 * (words.n or 0) + 64 * words.texts, params), "id")
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("in_a"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("in_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("in_a", "in_b")))
    jaccard = F.col("shared") / (F.size("in_a") + F.size("in_b") - F.col("shared"))
    return both.withColumn("similarity", jaccard).filter(F.col("similarity") >= threshold).select("a", "b", "similarity")


def shared_classes(members: DataFrame, class_col: str, id_col: str) -> DataFrame:
    """(first, id, n): the ids of all classes of two or more, with the smallest one and their number."""
    ids = members.select(F.col(class_col).alias("k"), F.col(id_col).alias("id")).distinct()
    sizes = ids.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter(F.col("n") > 1)
    return spool(ids.join(sizes, "k").select("first", "id", "n"), "shared-classes")


def class_pairs(shared: DataFrame, full: int) -> DataFrame:
    """(a, b), a < b, within classes of equal items: all pairs of classes of up to `full` ids, else the smallest id
    with every other one, which says the same in as many rows as the class has members."""
    star = shared.filter((F.col("n") > full) & (F.col("id") > F.col("first"))).select(F.col("first").alias("a"), F.col("id").alias("b"))
    few = shared.filter(F.col("n") <= full)
    both = few.select("first", F.col("id").alias("a")).join(few.select("first", F.col("id").alias("b")), "first").filter(F.col("a") < F.col("b"))
    return star.union(both.select("a", "b"))


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs with each side replaced by all members (first, id) of the class that it is the first of."""
    for side in ("a", "b"):
        own = members.select(F.col("first").alias(side), "id")
        pairs = pairs.join(own, side, "left").withColumn(side, F.coalesce("id", side)).drop("id")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") < F.col("b"))


def _texts(df: DataFrame, id_col: str, text_col: str, least_words: int, params: NearParams) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all texts, and (a, b): the links between different texts, each stood for by its smallest id."""
    prints = spool(fingerprints(df, id_col, text_col, least_words, params), "near-prints")
    shape = F.struct("id", F.size("hashes").alias("words"), "sketch_a", "sketch_b", "blocks", "hashes")
    reps = spool(prints.groupBy("class_key").agg(F.min(shape).alias("x")).select("x.*"), "near-classes")
    pairs = spool(candidate_pairs(reps, params), "near-candidates")
    found = spool(verified_pairs(reps, pairs, params).select("a", "b"), "near-pairs")
    texts = prints.groupBy("text_key", "class_key").agg(F.min("id").alias("id"))
    forms = shared_classes(texts, "class_key", "id")
    one, other = (forms.select("first", F.col("id").alias(side)) for side in ("a", "b"))
    within = one.join(other, "first").filter(F.col("a") < F.col("b")).select("a", "b")
    return prints, expanded(found, forms).union(within)


def near_duplicates(df: DataFrame, id_col: str, text_col: str, least_words: int, params: NearParams = NearParams()) -> DataFrame:
    """(a, b), a < b: pairs of ids whose texts have least_words different words each and are alike to the threshold.

    Texts with equal word sets form a class that is compared once, through its smallest id; all its different texts are
    linked with each other and with those of similar classes, however many they are. Exactly equal texts give all their
    pairs and links up to `full_class` ids; beyond, their smallest id has the links, and a star to the others. Null ids and null, empty or short texts
    give no rows; a repeated id counts once, by any one of its texts; only id_col and text_col are read.
    """
    prints, links = _texts(df, id_col, text_col, least_words, params)
    copies = shared_classes(prints, "text_key", "id")
    return expanded(links, copies.filter(F.col("n") <= params.full_class)).union(class_pairs(copies, params.full_class))


def link_counts(df: DataFrame, id_col: str, text_col: str, least_words: int, params: NearParams = NearParams()) -> DataFrame:
    """(id, class_id, copies, links): for every text with least_words different words the smallest id with the same text,
    the number of ids that have it, and the number of different texts that are alike to the threshold. As many rows as
    documents, however large a family is; other cases as in near_duplicates.
    """
    prints, links = _texts(df, id_col, text_col, least_words, params)
    both = links.union(links.select("b", "a")).distinct().groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "class_id")
    members = prints.select("id", "text_key").dropDuplicates(["id"])
    texts = members.groupBy("text_key").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")).join(both, "class_id", "left")
    return members.join(texts, "text_key").select(F.col("id").alias(id_col), "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def same_file(df: DataFrame, id_col: str, hash_col: str, params: NearParams = NearParams()) -> DataFrame:
    """(a, b), a < b: ids with the same hash value, whatever the case, the prefix, and what stands around the digits.

    Null and blank values are no value. Groups follow class_pairs.
    """
    bare = F.regexp_replace(trimmed(F.lower(hash_col)), r"^[^0-9a-z]*sha-?256[^0-9a-f]*", "")
    digits = F.regexp_replace(bare, "[^0-9a-f]", "")
    value = F.when(F.length(digits) == 64, digits).otherwise(bare)  # what is no such hash counts as it stands
    rows = df.select(F.col(id_col).alias("id"), value.alias("value")).filter(F.col("id").isNotNull() & (F.length("value") > 0))
    return class_pairs(shared_classes(rows, "value", "id"), params.full_class)
