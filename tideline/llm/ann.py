"""Approximate nearest neighbours over learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts, a small neural classifier
learns which part a vector belongs to, and every row is indexed under its most probable part.
A query is compared with all rows of its several most probable parts. Tables that would leave
the parts too large are cut again: every part has a graph and a classifier of its own.

Equal vectors are one row of the index, with the smallest of their ids, and equal queries are
searched for once, so that no vector, however frequent, makes a part large.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import stored


@dataclass(frozen=True)
class Router:
    """One hidden layer and a softmax over the parts."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def small(self) -> Router:
        return Router(self.mean.astype(np.float32), self.scale, *(w.astype(np.float32) for w in (self.w1, self.b1, self.w2, self.b2)))


def neighbour_graph(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each row to its ``k`` nearest others."""
    k = min(k, len(x) - 1)
    norms, to = (x * x).sum(1), []
    for at in range(0, len(x), 512):
        d = norms[None, :] - 2 * x[at : at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        to.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.repeat(np.arange(len(x)), k), np.concatenate(to).ravel()


def balanced_parts(x: np.ndarray, a: np.ndarray, b: np.ndarray, parts: int, rounds: int = 60) -> np.ndarray:
    """Part of each row: halves at the median of the graph's second eigenvector, again and again."""
    label = np.zeros(len(x), np.int64)
    for _ in range(int(math.log2(parts))):
        new = label * 2
        for p in np.unique(label):
            rows = np.flatnonzero(label == p)
            place = np.full(len(x), -1)
            place[rows] = np.arange(len(rows))
            inside = (place[a] >= 0) & (place[b] >= 0)
            i, j = place[a[inside]], place[b[inside]]
            i, j = np.concatenate((i, j)), np.concatenate((j, i))
            root = np.sqrt(np.bincount(i, minlength=len(rows)) + 1.0)
            centred = x[rows] - x[rows].mean(0)
            v = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
            for _ in range(rounds):
                v -= root * (root @ v) / (root @ root)
                v = 0.5 * v + 0.5 * (v / root**2 + np.bincount(i, v[j] / root[j], len(rows)) / root)
                v /= np.linalg.norm(v) + 1e-12
            order = np.argsort(v / root, kind="stable")
            new[rows[order[len(rows) // 2 :]]] += 1
        label = new
    return label


def fit(x: np.ndarray, parts: int, neighbours: int = 10, hidden: int = 128, epochs: int = 40, seed: int = 7) -> Router:
    """Partition the sample's neighbour graph and train the classifier on the parts of rows and their neighbours."""
    dim = x.shape[1] if len(x) else 1
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(0), float(x.std()) or 1.0) if len(x) else (np.zeros(dim), 1.0)
    w1, w2 = rng.normal(0, math.sqrt(2 / dim), (dim, hidden)), rng.normal(0, math.sqrt(1 / hidden), (hidden, parts))
    weights = [w1, np.zeros(hidden), w2, np.zeros(parts)]
    if parts > 1:
        a, b = neighbour_graph(x, neighbours)
        label = balanced_parts(x, a, b, parts)
        target = np.zeros((len(x), parts))
        np.add.at(target, (a, label[b]), 0.5 / max(1, len(a) // len(x)))
        target[np.arange(len(x)), label] += 0.5
        target /= target.sum(1, keepdims=True)
        z, m, s, t = (x - mean) / scale, [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                h = np.maximum(z[rows] @ weights[0] + weights[1], 0)
                o = h @ weights[2] + weights[3]
                o = np.exp(o - o.max(1, keepdims=True))
                g = (o / o.sum(1, keepdims=True) - target[rows]) / len(rows)
                gh = (g @ weights[2].T) * (h > 0)
                t += 1
                for i, grad in enumerate((z[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                    m[i], s[i] = 0.9 * m[i] + 0.1 * grad, 0.999 * s[i] + 0.001 * grad**2
                    weights[i] = weights[i] - 2e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, scale, *weights)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (array of double) of the vectors that are not null, zero or empty and hold finite components only."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    )


@dataclass(frozen=True)
class Tree:
    """The classifier of the first cut and, if there is a second one, those of its parts (None: the part is not cut)."""

    root: Router
    parts: int
    below: tuple[Router | None, ...] = ()
    parts_below: int = 1

    @property
    def leaves(self) -> int:
        return self.parts * self.parts_below

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Log-probability of every leaf."""
        first = log_softmax(self.root.logits(x))
        if not self.below:
            return first
        out = np.full((len(x), self.parts, self.parts_below), -np.inf)
        for p, router in enumerate(self.below):
            out[:, p] = first[:, p, None] + (log_softmax(router.logits(x)) if router else np.where(np.arange(self.parts_below) == 0, 0.0, -np.inf))
        return out.reshape(len(x), -1)

    def probable(self, x: np.ndarray, leaves: int) -> np.ndarray:
        """The ``leaves`` most probable leaves of each row, best first."""
        return np.concatenate([np.argsort(-self.chances(x[a : a + 256]), axis=1, kind="stable")[:, :leaves] for a in range(0, len(x), 256)]) if len(x) else np.zeros((0, leaves), int)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def probes_needed(tree: Tree, x: np.ndarray, own: np.ndarray, coverage: float, k: int = 10) -> int:
    """How many probable leaves of the rows ``own`` hold ``coverage`` of their ``k`` nearest rows of ``x``."""
    if tree.leaves < 2 or not len(own) or len(x) < 2:
        return tree.leaves
    part, ranked, ranks = tree.probable(x, 1)[:, 0], tree.probable(x[own], tree.leaves), []
    norms = (x * x).sum(1)
    for i, row in zip(own, ranked, strict=True):
        d = norms - 2 * x @ x[i]
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
        ranks.append(np.argsort(row)[part[near]])
    return int(np.quantile(np.concatenate(ranks), coverage, method="higher")) + 1


def power_of_two(x: float) -> int:
    return 1 << max(0, int(math.log2(max(1, x))))


def train(
    rows: DataFrame, fit_rows: int = 4096, test_rows: int = 512, rows_per_part: int = 512, least_rows: int = 400, least_parts: int = 8, most_parts: int = 128, rows_per_leaf: int = 32_768, coverage: float = 0.92,
) -> tuple[Tree, int, int]:
    """Classifiers, dimension and number of leaves to search; ``rows`` are distinct vectors.

    The rows with the smallest id hash are the sample: ``fit_rows`` to fit on and ``test_rows``
    others, whose nearest neighbours in the sample tell how many leaves must be searched. There
    are ``least_parts`` parts at least, unless the sample has fewer than 16 rows for each; fewer
    than ``least_rows`` rows are one part and so compared with every query. If
    parts would have more than ``rows_per_leaf`` rows on average, each is cut again by a sample of
    its own, in a task for each part; at most ``most_parts`` classifiers then reach the driver.
    """
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows + test_rows).select("v").toArrow().column("v").to_pylist()
    dim = max((len(v) for v in sample), default=1)
    seen = np.array([v for v in sample if len(v) == dim], np.float64).reshape(-1, dim)
    x = seen[np.sort(np.unique(seen, axis=0, return_index=True)[1])] if len(seen) else seen
    held = min(test_rows, len(x) // 5)
    fitted = x[: len(x) - held]
    parts = power_of_two(min(most_parts, max(least_parts, n / rows_per_part), len(fitted) / 16)) if n >= least_rows else 1
    tree = Tree(fit(fitted, parts), parts)
    below = power_of_two(min(most_parts, n / parts / rows_per_leaf))
    if below > 1:
        tree = Tree(tree.root, parts, second_cut(assign(rows, tree, dim, 1), parts, below, fit_rows, dim), below)
    return tree, dim, probes_needed(tree, x, np.arange(len(x) - held, len(x)), coverage)


def second_cut(placed: DataFrame, parts: int, below: int, fit_rows: int, dim: int) -> tuple[Router | None, ...]:
    first = Window.partitionBy("part").orderBy(F.xxhash64("vec_id"), "vec_id")
    sample = placed.where("part >= 0").withColumn("r", F.row_number().over(first)).where(F.col("r") <= fit_rows)

    def run(t: pa.Table) -> pa.Table:
        x = np.array(t.column("v").to_pylist(), np.float64).reshape(-1, dim)
        blob = pickle.dumps(fit(x, below, hidden=64).small()) if len(x) >= 4 * below else None
        return pa.table([t.column("part")[:1], pa.array([blob], pa.binary())], names=["part", "router"])

    out: list[Router | None] = [None] * parts
    for r in sample.select("part", "v").groupBy("part").applyInArrow(run, "part int, router binary").collect():
        out[r["part"]] = pickle.loads(r["router"]) if r["router"] else None
    return tuple(out)


def matrices(column: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors in a list column and a matrix of them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    out = {}
    for d in sorted(set(lengths.tolist())):
        at = np.flatnonzero(lengths == d)
        out[d] = (at, flat[(ends[at] - d)[:, None] + np.arange(d)])
    return out


def assign(rows: DataFrame, tree: Tree, dim: int, probes: int) -> DataFrame:
    """vec_id, v, ids and part, a row for each of the ``probes`` most probable leaves; vectors of another length go to part -1."""

    def run(batches):
        for b in batches:
            parts = np.full((b.num_rows, probes), -1, np.int64)
            at, x = matrices(b.column(1)).get(dim, (np.zeros(0, int), None))
            if len(at):
                parts[at] = tree.probable(x, probes)
            keep = np.ones(parts.shape, bool)
            keep[np.setdiff1d(np.arange(b.num_rows), at), 1:] = False
            row = pa.array(np.nonzero(keep)[0])
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(row) for i in range(3)), pa.array(parts[keep].astype(np.int32))], names=["vec_id", "v", "ids", "part"])

    return rows.select("vec_id", "v", "ids").mapInArrow(run, "vec_id long, v array<double>, ids array<long>, part int")


def nearest_in_block(rows: pa.Table, queries: pa.Table, k: int, at_once: int) -> pa.Table:
    """The k nearest ids of each query within one block, ties to the smaller id; a row stands for all its ids."""
    own, asked = matrices(rows.column("v")), matrices(queries.column("v"))
    ids, q_ids = rows.column("ids").to_pylist(), queries.column("vec_id").to_numpy()
    out_q, out_v, out_d = [], [], []
    for dim in own.keys() & asked.keys():
        (at, x), (q_at, q) = own[dim], asked[dim]
        lists = [ids[i] for i in at.tolist()]
        sizes, flat = np.array([len(i) for i in lists]), np.array([i for y in lists for i in y], np.int64)
        ends = np.cumsum(sizes)
        norms = (x * x).sum(1)
        for begin in range(0, len(q), at_once):
            some = q[begin : begin + at_once]
            rough = norms - 2 * some @ x.T + (some * some).sum(1)[:, None]
            # What rounding of the rough squares can do is far below this slack.
            limit = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1] + 1e-9 * (norms.max() + (some * some).sum(1))
            for i, row in enumerate(rough):
                near = np.flatnonzero(row <= limit[i])
                d = np.sqrt(((x[near] - some[i]) ** 2).sum(1))
                v = np.concatenate([flat[ends[j] - sizes[j] : ends[j]] for j in near])
                d = np.repeat(d, sizes[near])
                best = np.lexsort((v, d))[:k]
                out_q.append(np.full(len(best), q_ids[q_at[begin + i]]))
                out_v.append(v[best])
                out_d.append(d[best])
    cat = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
    return pa.table([cat(out_q, pa.int64()), cat(out_v, pa.int64()), cat(out_d, pa.float64())], names=["asked", "vec_id", "score"])


def merged(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: v, ids (the ``k`` smallest) and vec_id (the smallest of all)."""
    first = Window.partitionBy("h", "v").orderBy("vec_id")
    few = rows.distinct().withColumn("h", F.xxhash64("v")).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    return few.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("vec_id"), "v", "ids")


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    block_rows: int = 8192, block_queries: int = 64, **fitting,
) -> DataFrame:
    """The k nearest rows found for each query: query_id, rank, vec_id, score (Euclidean distance).

    Rows stay in their leaf, which is dealt to blocks of about ``block_rows`` by a hash of the id if
    it is larger; a query is sent to the blocks of as many of its most probable leaves, two
    at least, as the sample's held-back rows need to cover ``coverage`` of their neighbours, and
    ``block_queries`` are compared at a time. Unusable vectors (null, zero, with null or
    non-finite components) take no part as rows or queries. Vectors of another length meet
    those of their own length only. Rows and queries that repeat an id count once, at the
    smallest distance; a row with the query's id is none of its candidates. Ties go to the
    smaller id. Other columns are ignored. Empty tables give no rows.
    """
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    # One more than k, as the query itself may be among them.
    index = stored(merged(rows, k + 1))
    tree, dim, needed = train(index, **fitting)
    probes = min(tree.leaves, max(2, needed))
    placed = stored(assign(index, tree, dim, 1))
    # Counts of at most as many leaves as there are, and one for vectors of another length.
    blocks = {r["part"]: math.ceil(r["n"] / block_rows) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not blocks:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    of_part = rows.sparkSession.createDataFrame(list(blocks.items()), "part int, blocks int")
    one = stored(merged(asked, 1))
    members = asked.distinct().join(one.select("v", F.col("vec_id").alias("asked")), "v").select(F.col("vec_id").alias("query_id"), "asked")
    left = placed.join(of_part, "part").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    right = assign(one, tree, dim, probes).join(of_part, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    near = left.select("part", "block", "v", "ids").groupBy("part", "block").cogroup(right.select("part", "block", "vec_id", "v").groupBy("part", "block"))
    found = near.applyInArrow(lambda r, q: nearest_in_block(r, q, k + 1, block_queries), "asked long, vec_id long, score double")
    best = found.join(members, "asked").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
