"""The k most similar vectors of every vector.

A forest of random-projection trees is fitted on a bounded sample; every vector is then indexed in one leaf of
each tree. A query walks all trees through one shared priority queue (smallest squared distance to the planes crossed
first) and visits the best `probes` leaves. How many that takes is measured: a set of queries is compared with all
vectors, and the queue goes on until it has met the wanted share of their true neighbours. Candidates are reranked
there on the exact vectors: near-copies lie closer together than any short code could tell apart.

Equal vectors form one class, which is indexed once; a class carries its k + 1 smallest ids, all that any top-k
list can ever use, so that a vector copied a billion times costs no more than any other row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tessera.llm.frequent import hash_sample
from tessera.runtime import spool


@dataclass(frozen=True)
class ForestParams:
    recall: float = 0.96  # share of true neighbours that the probed leaves must hold, measured on `tried` queries
    tried: int = 256
    trees: int = 4
    leaves: int = 16  # leaves aimed at in a tree, as long as a leaf has from least_rows to most_rows
    least_rows: int = 1_024
    most_rows: int = 8_192
    fit_rows: int = 20_000  # bound of the sample the trees are fitted on
    fit_leaf: int = 8  # sample rows a fitted leaf must hold
    block_rows: int = 16_384  # a leaf of more rows or queries is worked off in blocks of this size
    axes: int = 16  # a node's directions are drawn from its sample's covariance along so many main axes
    seed: int = 7


class Forest:
    """Complete binary trees in heap order: node i has the children 2i and 2i + 1; leaves are numbered from 0."""

    def __init__(self, x: np.ndarray, rows: int, p: ForestParams):
        aim = min(max(rows / p.leaves, p.least_rows), p.most_rows)
        wanted = max(0, int(np.ceil(np.log2(max(1, rows / aim)))))
        fitted = max(0, int(np.floor(np.log2(max(1, len(x) / p.fit_leaf)))))
        self.p, self.depth, self.extra = p, min(wanted, fitted), max(0, wanted - fitted)
        self.total = self.depth + self.extra
        rng, dim = np.random.default_rng(p.seed), x.shape[1]
        inner = leaves = 1 << self.depth
        self.normal = np.zeros((p.trees, inner, dim), np.float32)
        self.offset = np.zeros((p.trees, inner), np.float32)
        centre = np.zeros((p.trees, leaves, dim), np.float32)
        for t in range(p.trees):
            held = {1: np.arange(len(x))}
            for node in range(1, inner):
                own = held.pop(node)
                normal = self._direction(x[own], rng)
                at = x[own] @ normal
                cut = np.float32(np.median(at)) if len(own) else np.float32(0)
                self.normal[t, node], self.offset[t, node] = normal, cut
                held[2 * node], held[2 * node + 1] = own[at < cut], own[at >= cut]
            for node, own in held.items():
                if len(own):
                    centre[t, node - leaves] = x[own].mean(0)
        # Beyond the depth that the sample supports, fixed directions through the fitted leaf's centre go on splitting.
        self.deep = rng.standard_normal((p.trees, self.extra, dim)).astype(np.float32)
        self.deep /= np.maximum(np.linalg.norm(self.deep, axis=2, keepdims=True), 1e-9)
        self.deep_offset = np.einsum("tld,ted->tle", centre, self.deep)

    def _direction(self, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """A random direction in which the rows differ: normal, with their covariance along its main axes."""
        normal = rng.standard_normal(x.shape[1])
        if len(x) > 1:
            spread, axis = np.linalg.eigh(np.cov(x.T))
            drawn = axis[:, -self.p.axes :] @ (rng.standard_normal(axis[:, -self.p.axes :].shape[1]) * np.sqrt(np.maximum(spread[-self.p.axes :], 0)))
            normal = drawn if np.linalg.norm(drawn) > 1e-6 else normal
        return (normal / np.linalg.norm(normal)).astype(np.float32)

    def _margin(self, x: np.ndarray, tree: np.ndarray, node: np.ndarray, level: np.ndarray) -> np.ndarray:
        """On which side of a node's plane a row lies, and how far from it."""
        fitted = np.where(level < self.depth, node, 0)
        m = np.einsum("nd,nd->n", x, self.normal[tree, fitted]) - self.offset[tree, fitted]
        below = np.flatnonzero(level >= self.depth)
        if len(below):
            e, t = level[below] - self.depth, tree[below]
            leaf = (node[below] >> e) - (1 << self.depth)
            m[below] = np.einsum("nd,nd->n", x[below], self.deep[t, e]) - self.deep_offset[t, leaf, e]
        return m

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        out = []
        for t in range(self.p.trees):
            node, tree = np.ones(len(x), np.int64), np.full(len(x), t)
            for level in range(self.total):
                node = 2 * node + (self._margin(x, tree, node, np.full(len(x), level)) >= 0)
            out.append((node - (1 << self.total)) * self.p.trees + t)
        return np.stack(out, 1)

    def search(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The `probes` leaves of every row that the shared queue yields first; -1 once the queue is empty."""
        n, trees, every = len(x), self.p.trees, np.arange(len(x))
        probes = min(probes, trees << self.total)
        width = trees + probes * max(1, self.total)
        cost = np.full((n, width), np.inf, np.float32)
        node, tree, level = np.ones((n, width), np.int64), np.zeros((n, width), np.int16), np.zeros((n, width), np.int16)
        cost[:, :trees], tree[:, :trees], used = 0, np.arange(trees), trees
        out = []
        for _ in range(probes):
            best = cost[:, :used].argmin(1)
            at, tr, depth, own = node[every, best], tree[every, best].astype(np.int64), level[every, best].astype(np.int64), cost[every, best].copy()
            gone = np.isinf(own)
            cost[every, best] = np.inf
            while True:
                inner = (depth < self.total) & ~gone
                if not inner.any():
                    break
                m = self._margin(x, tr, np.where(inner, at, 1), np.where(inner, depth, 0))
                right = m >= 0
                cost[:, used] = np.where(inner, own + m * m, np.inf)
                node[:, used], tree[:, used], level[:, used] = 2 * at + ~right, tr, depth + 1
                at, depth = np.where(inner, 2 * at + right, at), depth + inner
                used += 1
            out.append(np.where(gone, -1, (at - (1 << self.total)) * trees + tr))
        return np.stack(out, 1)


def valid_vector(dense: Column, dim: int) -> Column:
    """dim finite entries, not all of them zero."""
    sound = F.forall(dense, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(dense) == dim) & sound & F.exists(dense, lambda v: v != 0), F.lit(False))


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: What a cosine in single precision may be off, twice.
_BLUR = 1e-5

_ROW = T.StructType([
    T.StructField("leaf", T.LongType()), T.StructField("is_query", T.BooleanType()),
    T.StructField("id", T.LongType()), T.StructField("vector", T.BinaryType()),
])
_LISTS = "id long, near array<struct<far: double, other: long>>"  # far is the cosine with its sign turned: small is near


def _best(query: np.ndarray, far: np.ndarray, other: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query its `keep` nearest different others, ties by the smaller id."""
    if not len(query):
        return query, far, other
    order = np.lexsort((other, far, query))
    query, far, other = query[order], far[order], other[order]
    first = np.r_[True, (query[1:] != query[:-1]) | (other[1:] != other[:-1]) | (far[1:] != far[:-1])]
    query, far, other = query[first], far[first], other[first]
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    top = rank < keep
    return query[top], far[top], other[top]


def _exact(q: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosines of pairs of unit vectors, summed in one order for every pair."""
    out = np.empty(len(i))
    for at in range(0, len(i), 65_536):
        out[at : at + 65_536] = np.einsum("nd,nd->n", q[i[at : at + 65_536]], r[j[at : at + 65_536]])
    return np.minimum(out, 1.0)


def _candidates(q: np.ndarray, r: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): for each row of q at least the `keep` rows of r of highest cosine. The keep-th highest of the maxima of
    groups of columns is a lower bound of the keep-th highest value."""
    s = q @ r.T
    groups = min(len(r), max(64, 4 * keep))
    if len(r) > groups:
        size = len(r) // groups
        high = s[:, : groups * size].reshape(len(q), size, groups).max(1)
        bound = np.partition(high, groups - keep, axis=1)[:, groups - keep, None]
        return np.divmod(np.flatnonzero(s >= bound - _BLUR), len(r))
    return np.divmod(np.arange(s.size), len(r))


def _lists(query: np.ndarray, far: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    items = pa.StructArray.from_arrays([pa.array(far), pa.array(other)], names=["far", "other"])
    return pa.RecordBatch.from_arrays([pa.array(query[start] if len(query) else [], pa.int64()), pa.ListArray.from_arrays(pa.array(np.r_[start, len(query)], pa.int32()), items)], names=["id", "near"])


def _probes(reps: DataFrame, forest: Forest, asked_ids: np.ndarray, asked: np.ndarray, dim: int, k: int) -> int:
    """How many leaves the queue must yield to hold the wanted share of the k nearest of the asked vectors, which are
    compared with all vectors; the most there are if nothing less does."""
    p = forest.p
    most = p.trees << forest.total
    if most == p.trees:
        return 1
    held = reps.sparkSession.sparkContext.broadcast((forest, asked_ids, asked))  # bounded by fit_rows and tried

    def run(batches):
        forest, own, q = held.value
        best = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        leaf: dict[int, list[int]] = {}
        for b in batches:
            ids = b.column("id").to_numpy()
            for at in range(0, len(ids), 4096):
                r = _unit(_matrix(b.column("dense").slice(at, 4096), dim))
                part = ids[at : at + 4096]
                i, j = _candidates(q, r, min(k + 1, len(r)))
                i, j = (x[own[i] != part[j]] for x in (i, j))
                best = [np.concatenate(x) for x in zip(best, (own[i], -_exact(q, r, i, j), part[j]))]
                best = list(_best(*best, k))
                new = np.flatnonzero(np.isin(part, best[2]))
                leaf |= zip(part[new].tolist(), forest.leaves(r[new].astype(np.float32)).tolist())
        yield pa.RecordBatch.from_arrays([*map(pa.array, best), pa.array([leaf[o] for o in best[2].tolist()], pa.list_(pa.int64()))], names=["id", "far", "other", "leaf"])

    found = reps.select("id", "dense").mapInArrow(run, "id long, far double, other long, leaf array<long>")
    rank = F.row_number().over(W.partitionBy("id").orderBy("far", "other"))
    found = found.withColumn("n", rank).filter(F.col("n") <= k).select("id", "leaf").collect()  # at most tried * k rows
    row = {i: n for n, i in enumerate(asked_ids.tolist())}
    query, leaves = np.array([row[f.id] for f in found], np.int64), np.array([f.leaf for f in found], np.int64)
    x, probes = asked.astype(np.float32), 8
    while len(query):
        order = forest.search(x, probes)
        hit = (order[query][:, :, None] == leaves[:, None, :]).any(2)
        share = np.cumsum(np.bincount(hit.argmax(1)[hit.any(1)], minlength=order.shape[1])) / len(query)
        if share[-1] >= p.recall or probes >= most:
            return min(most, int(np.argmax(share >= p.recall)) + 1 if share[-1] >= p.recall else most)
        probes *= 2
    return 1


def _indexed(reps: DataFrame, forest: Forest, probes: int, dim: int) -> DataFrame:
    held = reps.sparkSession.sparkContext.broadcast(forest)  # bounded by fit_rows, whatever the number of vectors
    step = max(16, min(4096, 2_000_000 // (forest.p.trees + probes * max(1, forest.total))))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                dense = _matrix(part.column("dense"), dim)
                ids, raw_rows = part.column("id").to_numpy(), dense.astype(np.float32)
                x = _unit(dense).astype(np.float32)
                for leaf, is_query in ((held.value.leaves(x), False), (held.value.search(x, probes), True)):
                    row = np.repeat(np.arange(len(ids)), leaf.shape[1])
                    keep = leaf.ravel() >= 0
                    row = row[keep]
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(row), [None, pa.py_buffer(np.ascontiguousarray(raw_rows[row]))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf.ravel()[keep]), pa.array(np.full(len(row), is_query)), pa.array(ids[row]), raw.cast(pa.binary())], names=_ROW.names
                    )

    return reps.select("id", "dense").mapInArrow(run, _ROW)


def _leaf_lists(rows: DataFrame, dim: int, keep: int, block: int) -> DataFrame:
    """(id, near): for each query the `keep` nearest rows of its leaves, in parts, by the whole vectors."""
    size = rows.groupBy("leaf").agg(F.count_if(~F.col("is_query")).alias("n_rows"), F.count_if("is_query").alias("n_queries"))
    heavy = size.filter((F.col("n_rows") > block) | (F.col("n_queries") > 4 * block))
    if heavy.isEmpty():
        rows = rows.withColumns({"row_block": F.lit(0), "query_block": F.lit(0)})
    else:
        # Every block of queries meets every block of rows, each pair of blocks in its own group.
        of = lambda n: F.ceil(F.coalesce(F.col(n), F.lit(1)) / block).cast("int")
        own = lambda n: F.array(F.pmod(F.xxhash64("id"), of(n)).cast("int"))
        every = lambda n: F.sequence(F.lit(0), F.greatest(of(n), F.lit(1)) - 1)
        rows = (
            rows.join(heavy, "leaf", "left")
            .withColumn("row_block", F.explode(F.when(F.col("is_query"), every("n_rows")).otherwise(own("n_rows"))))
            .withColumn("query_block", F.explode(F.when(F.col("is_query"), own("n_queries")).otherwise(every("n_queries"))))
        )
    keys = ["leaf", "row_block", "query_block"]

    def units(part: pa.RecordBatch) -> np.ndarray:
        return _unit(np.frombuffer(b"".join(part.column("vector").to_pylist()), np.float32).reshape(-1, dim).astype(np.float64))

    def run(batches):
        group, r, r_ids = None, [], []  # the rows of the group, which come before its queries
        done, size = [], 0
        for b in batches:
            key = np.stack([b.column(k).to_numpy() for k in keys])
            query = b.column("is_query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0) | (query[1:] != query[:-1])) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, b.num_rows]):
                if lo == hi:
                    continue
                if group is None or (group != key[:, lo]).any():
                    group, r, r_ids = key[:, lo], [], []
                part, ids = b.slice(lo, hi - lo), b.column("id").to_numpy()[lo:hi]
                if not query[lo]:
                    r.append(units(part))
                    r_ids.append(ids)
                    continue
                if not r:
                    continue
                r, r_ids = [np.concatenate(r)], [np.concatenate(r_ids)]
                r32 = r[0].astype(np.float32)
                for at in range(0, hi - lo, 256):
                    q, own = units(part.slice(at, 256)), ids[at : at + 256]
                    i, j = _candidates(q.astype(np.float32), r32, min(keep + 1, len(r32)))
                    i, j = (x[own[i] != r_ids[0][j]] for x in (i, j))
                    done.append(_best(own[i], -_exact(q, r[0], i, j), r_ids[0][j], keep))
                    size += len(done[-1][0])
            if size > 2_000_000:
                done = [_best(*map(np.concatenate, zip(*done)), keep)]
                yield _lists(*done[0])
                done, size = [], 0
        if done:
            yield _lists(*_best(*map(np.concatenate, zip(*done)), keep))

    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "is_query").select(*keys, "is_query", "id", "vector")
    return rows.mapInArrow(run, _LISTS)


def _merged(lists: DataFrame, keep: int) -> DataFrame:
    """(id, near): one list for each id, of the `keep` nearest of its parts."""

    def flat(tab: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near = tab.column("near").combine_chunks()
        near = pa.concat_arrays(near.chunks) if isinstance(near, pa.ChunkedArray) else near
        items = near.flatten()
        return np.repeat(tab.column("id").to_numpy(), near.value_lengths().to_numpy()), items.field("far").to_numpy(), items.field("other").to_numpy()

    def run(batches):
        held = None
        for b in batches:
            new = pa.Table.from_batches([b])
            held = new if held is None else pa.concat_tables([held, new])
            ids = held.column("id").to_numpy()
            upto = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
            if upto:  # the parts of the last id may go on in the next batch
                yield _lists(*_best(*flat(held.slice(0, upto)), keep))
                held = held.slice(upto)
        if held is not None and held.num_rows:
            yield _lists(*_best(*flat(held), keep))

    return lists.repartition("id").sortWithinPartitions("id").mapInArrow(run, _LISTS)


def nearest_vectors(df: DataFrame, id_col: str, vector_col: str, k: int = 10, dim: int = 64, params: ForestParams = ForestParams()) -> DataFrame:
    """(id, neighbour, cosine, rank): for every valid vector its k most similar others, ties by the smaller id.

    Nulls, wrong lengths, null, NaN or infinite entries and all-zero vectors are no valid vectors: they give no
    rows and are nobody's neighbour. Repeated ids count once. An empty table, or one of a single vector, gives no
    rows. Only id_col and vector_col are read, so further columns of any name do no harm.
    """
    vectors = (
        df.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda v: v.cast("float")).alias("dense"))
        .filter(F.col("id").isNotNull() & valid_vector(F.col("dense"), dim))
        .withColumn("key", F.concat(F.hex(F.xxhash64("dense")), F.hex(F.hash("dense"))))
    )
    classes = vectors.groupBy("key").agg(F.min(F.struct("id", "dense")).alias("first"), F.max("id").alias("last"))
    reps = spool(classes.select("key", "first.id", "first.dense", (F.col("last") > F.col("first.id")).alias("shared")), "neighbours-classes")
    rows = reps.count()
    chosen = hash_sample(reps.select("id", "dense"), "id", params.fit_rows, rows, params.seed)
    sample = chosen.orderBy(F.xxhash64("id", F.lit(params.seed + 1))).toArrow()
    x = _matrix(sample.column("dense"), dim)
    x = _unit(x) if len(x) else x
    forest = Forest(x.astype(np.float32), rows, params)
    probes = _probes(reps, forest, sample.column("id").to_numpy()[: params.tried], x[: params.tried], dim, k)
    indexed = spool(_indexed(reps, forest, probes, dim), "neighbours-leaves")
    lists = spool(_merged(_leaf_lists(indexed, dim, k, params.block_rows), k).withColumnRenamed("id", "rep"), "neighbours-lists")

    shared = reps.filter("shared").select("key", F.col("id").alias("rep"))
    copies = spool(vectors.select("id", "key").distinct().join(shared, "key").select("rep", "id"), "neighbours-copies")
    if copies.isEmpty():
        return lists.select(F.col("rep").alias("id"), F.posexplode("near").alias("pos", "x")).select("id", F.col("x.other").alias("neighbour"), (-F.col("x.far")).alias("cosine"), (F.col("pos") + 1).alias("rank"))
    heads = copies.withColumn("n", F.row_number().over(W.partitionBy("rep").orderBy("id"))).filter(F.col("n") <= k + 1).select("rep", F.col("id").alias("head"))
    near = lists.select("rep", F.explode("near").alias("x")).select("rep", "x.other", "x.far")
    near = near.join(heads.withColumnRenamed("rep", "other"), "other", "left").select("rep", "far", F.coalesce("head", "other").alias("other"))
    near = near.union(heads.select("rep", F.lit(-1.0), "head"))
    best = F.row_number().over(W.partitionBy("rep").orderBy("far", "other"))
    lists = near.withColumn("n", best).filter(F.col("n") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("far", "other"))).alias("near"))
    # Every copy takes its class's list without itself. The copies of a class may be many; as a side of an inner join
    # they can be split.
    singles = lists.join(shared.select("rep"), "rep", "left_anti").select(F.col("rep").alias("id"), "near")
    out = singles.unionByName(copies.join(lists, "rep").select("id", "near"))
    others = F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)
    return out.select("id", F.posexplode(others).alias("pos", "x")).select("id", F.col("x.other").alias("neighbour"), (-F.col("x.far")).alias("cosine"), (F.col("pos") + 1).alias("rank"))


def similar_pairs(neighbours: DataFrame, min_similarity: float) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: the pairs in which one is a sufficiently similar neighbour of the other."""
    return (
        neighbours.filter(F.col("cosine") >= min_similarity)
        .select(F.least("id", "neighbour").alias("vec_a"), F.greatest("id", "neighbour").alias("vec_b"))
        .distinct()
    )
