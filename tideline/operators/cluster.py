"""Clustering of feature vectors: k-means, periodic k-means and mixtures by expectation maximisation.

The features are an array column. Parameters are tiny and live on the driver; every iteration
is one narrow pass that sums within Arrow batches and one small aggregation, for all starts
together. First centres come from k-means||: a few passes over all rows, each of which adds a bounded
number of far ones. Nothing else of the rows reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import angles
from tideline.registry import CLUSTERERS, clusterer
from tideline.sources.files import written

KAPPA_LIMITS, STD_LIMITS = (0.1, 300.0), (1e-3, 300.0)


@dataclass
class Clustering:
    """Assignments (instance_id, cluster, probability, z), a table of parameters, and what led to them."""

    assignments: DataFrame
    parameters: list[dict]
    settings: dict
    details: dict = field(default_factory=dict)

    def table(self, spark) -> DataFrame:
        kinds = "cluster int, dim int, kind string, loc double, scale double, weight double"
        return spark.createDataFrame([(p["cluster"], p["dim"], p["kind"], p["loc"], p["scale"], p["weight"]) for p in self.parameters], kinds)


def log_i0(k: np.ndarray) -> np.ndarray:
    return np.log(np.i0(np.minimum(k, 600))) + np.maximum(k - 600, 0)


def kappa_of(r: np.ndarray) -> np.ndarray:
    r = np.clip(r, 0, 1 - 1e-9)
    return np.where(r < 0.53, 2 * r + r**3 + 5 * r**5 / 6, np.where(r < 0.85, -0.4 + 1.39 * r + 0.43 / (1 - r), 1 / (2 * (1 - r))))


def kappa_unbiased(r: np.ndarray, n: int, points: int = 10_000, most: float = 100.0) -> np.ndarray:
    """Concentration by lookup in a table of I1/I0, the mean resultant length being corrected for ``n`` rows."""
    grid = np.linspace(0, most, points)
    ratio = np.gradient(log_i0(grid), grid)
    corrected = np.sqrt(np.maximum(0, n / max(n - 1, 1) * (np.asarray(r) ** 2 - 1 / n)))
    return grid[np.abs(ratio[None, :] - np.atleast_1d(corrected)[:, None]).argmin(axis=1)]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column's rows of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]).clip(0)


def far_candidates(features: DataFrame, column: str, k: int, seed: int, rounds: int = 3, factor: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Candidates for first centres and how many rows are nearest to each, by k-means||.

    Begins with one row. Each round draws ``factor`` times ``k`` rows of all, without replacement and with
    probabilities in proportion to their squared distance to the candidates so far: the rows
    of the smallest -log(u) / distance, u being a hash of id, seed and round. What is far from all others is
    found however few rows it has.
    """
    size = factor * k
    first = features.orderBy(F.xxhash64("instance_id", F.lit(seed)), "instance_id").limit(1).select(column).toArrow()
    if not first.num_rows:
        return np.zeros((0, 0)), np.zeros(0)
    found = matrix(first.column(0).combine_chunks())
    for number in range(rounds):

        def run(batches, found=found):
            for b in batches:
                x = matrix(b.column(0))
                with np.errstate(divide="ignore"):
                    key = -np.log(b.column(1).to_numpy()) / squared_distances(x, found).min(1) if len(x) else np.zeros(0)
                near = np.argsort(key, kind="stable")[:size]
                near = near[np.isfinite(key[near])]
                yield pa.RecordBatch.from_arrays([pa.array(key[near]), b.column(0).take(pa.array(near))], names=["key", "x"])

        u = (F.pmod(F.xxhash64("instance_id", F.lit(seed), F.lit(number)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        drawn = features.select(column, u.alias("u")).mapInArrow(run, "key double, x array<double>").orderBy("key", "x").limit(size).select("x").toArrow()
        if not drawn.num_rows:
            break
        found = np.concatenate((found, matrix(drawn.column(0).combine_chunks())))
    found = np.unique(found, axis=0)
    weight = sums_by_start(features, column, lambda x: np.bincount(squared_distances(x, found).argmin(1), minlength=len(found))[None, :], 1, len(found))[0]
    return found, weight


def weighted_centres(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator, most: int = 20) -> np.ndarray:
    """``k`` centres of the weighted candidates: spread ones, moved by a few rounds of k-means."""
    c = plus_plus(x, k, rng, weight)
    for _ in range(most):
        near = squared_distances(x, c).argmin(1)
        total = np.bincount(near, weight, k)
        c = np.array([np.average(x[near == i], axis=0, weights=weight[near == i]) if total[i] > 0 else c[i] for i in range(k)])
    return c


def nothing(features: DataFrame, column: str, settings: dict) -> Clustering:
    """The clustering of an empty table: no assignments, no parameters."""
    return Clustering(assign_rows(features, column, lambda x: np.ones((len(x), 1))), [], settings)


def width(features: DataFrame, column: str) -> int:
    """Length of the vectors; 0 if there are none."""
    row = features.select(F.size(column)).first()
    return row[0] if row else 0


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator, weight: np.ndarray | None = None) -> np.ndarray:
    """Spread first centres: each new one with a probability in proportion to its squared distance, times its weight."""
    out = [x[rng.integers(len(x))] if weight is None else x[rng.choice(len(x), p=weight / weight.sum())]]
    while len(out) < k:
        d = np.min([((x - c) ** 2).sum(1) for c in out], axis=0) * (1 if weight is None else weight)
        out.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() else x[rng.integers(len(x))])
    return np.array(out)


def sums_by_start(features: DataFrame, column: str, batch_sums, starts: int, width: int) -> np.ndarray:
    """Sums over all rows of ``batch_sums(matrix)`` (starts x width), added within tasks, then across them."""

    def run(batches):
        total = np.zeros((starts, width))
        for b in batches:
            x = matrix(b.column(0))
            if len(x):
                total += batch_sums(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(starts), width)), pa.array(np.tile(np.arange(width), starts)), pa.array(total.ravel())], names=["s", "i", "v"])

    parts = features.select(column).mapInArrow(run, "s long, i long, v double").groupBy("s", "i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((starts, width))
    out[parts.column("s").to_numpy(), parts.column("i").to_numpy()] = parts.column("v").to_numpy()
    return out


def assign_rows(features: DataFrame, column: str, memberships) -> DataFrame:
    """instance_id, cluster, probability and z of every row."""

    def run(batches):
        for b in batches:
            x = matrix(b.column(1))
            z = memberships(x) if len(x) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z.argmax(1).astype(np.int32)), pa.array(z.max(1) if len(z) else []).cast(pa.float64()), pa.array(list(z), pa.list_(pa.float64()))], names=["instance_id", "cluster", "probability", "z"])

    return features.select(F.col("instance_id").cast("long"), column).mapInArrow(run, "instance_id long, cluster int, probability double, z array<double>")


@clusterer
def k_means(features: DataFrame, n_clusters: int = 16, seed: int = 743, n_starts: int = 3, sin_cos: bool = True, column: str = "phases", most: int = 40) -> Clustering:
    """Lloyd's k-means from starts spread over all rows, by default on cosines and sines of the angles; the start of least inertia wins."""
    data = features.select("instance_id", (F.flatten(F.transform(column, lambda x: F.array(F.cos(x), F.sin(x)))) if sin_cos else F.col(column)).alias("__x"))
    data = written(data)
    far, weight = far_candidates(data, "__x", n_clusters, seed)
    if not len(far):
        return nothing(data, "__x", {"method": "k_means", "n_clusters": n_clusters, "seed": seed})
    k = min(n_clusters, len(far))
    centres = np.array([weighted_centres(far, weight, k, np.random.default_rng(seed + s)) for s in range(n_starts)])
    d = centres.shape[2]
    inertia = np.full(n_starts, np.inf)
    for _ in range(most):

        def batch_sums(x, centres=centres):
            out = []
            for c in centres:
                dist = squared_distances(x, c)
                near = dist.argmin(1)
                hot = np.eye(len(c))[near]
                out.append(np.concatenate((hot.sum(0), (hot.T @ x).ravel(), [dist[np.arange(len(x)), near].sum()])))
            return np.array(out)

        got = sums_by_start(data, "__x", batch_sums, n_starts, k + k * d + 1)
        n, total, now = got[:, :k], got[:, k:-1].reshape(n_starts, k, d), got[:, -1]
        moved = np.where(n[:, :, None] > 0, total / np.maximum(n, 1)[:, :, None], centres)
        done = np.abs(moved - centres).max() < 1e-6
        centres, inertia = moved, now
        if done:
            break
    best = int(inertia.argmin())
    c = centres[best]

    def memberships(x):
        return np.eye(len(c))[((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)]

    parameters = [{"cluster": i, "dim": j, "kind": "sin_cos" if sin_cos else "mean", "loc": float(c[i, j]), "scale": float("nan"), "weight": float("nan")} for i in range(k) for j in range(d)]
    return Clustering(assign_rows(data, "__x", memberships), parameters, {"method": "k_means", "n_clusters": n_clusters, "seed": seed}, {"centroids": c, "inertia": float(inertia[best])})


@clusterer
def k_means_periodic(features: DataFrame, n_clusters: int = 16, seeds: tuple[int, ...] = (0, 1, 2), metric: str = "euclidean", column: str = "phases", most: int = 40, tolerance: float = 0.2) -> Clustering:
    """k-means with circular distances and circular means from random centres, one start for each seed; the least total wins.

    Angles are taken into [0, 2 pi) and rounded to two places. Clusters left empty keep their
    centre. A start ends when its total moves by no more than ``tolerance``.
    """
    if metric not in ("euclidean", "manhattan"):
        raise ValueError("metric must be euclidean or manhattan")
    data = features.select("instance_id", F.transform(column, lambda x: F.round(F.pmod(x, F.lit(2 * math.pi)), 2)).alias("__x"))
    data = written(data)
    d = width(data, "__x")
    if not d:
        return nothing(data, "__x", {"method": "k_means_periodic", "n_clusters": n_clusters, "metric": metric})
    centres = np.array([np.random.default_rng(s).uniform(0, 2 * math.pi, (n_clusters, d)) for s in seeds])
    before = np.full(len(seeds), np.inf)

    def distances(x, c):
        gap = np.abs(x[:, None, :] - c[None]) % (2 * math.pi)
        gap = np.minimum(gap, 2 * math.pi - gap)
        return (gap**2 if metric == "euclidean" else gap).sum(2)

    for _ in range(most):

        def batch_sums(x, centres=centres):
            out = []
            for c in centres:
                dist = distances(x, c)
                near = dist.argmin(1)
                hot = np.eye(len(c))[near]
                out.append(np.concatenate(((hot.T @ np.cos(x)).ravel(), (hot.T @ np.sin(x)).ravel(), hot.sum(0), [dist[np.arange(len(x)), near].sum()])))
            return np.array(out)

        got = sums_by_start(data, "__x", batch_sums, len(seeds), 2 * n_clusters * d + n_clusters + 1)
        c, s = (got[:, i * n_clusters * d : (i + 1) * n_clusters * d].reshape(len(seeds), n_clusters, d) for i in (0, 1))
        n, q = got[:, 2 * n_clusters * d : -1], got[:, -1]
        centres = np.where(n[:, :, None] > 0, np.arctan2(s, c) % (2 * math.pi), centres)
        if (np.abs(before - q) <= tolerance).all():
            break
        before = q
    best = int(q.argmin())
    c = centres[best]
    parameters = [{"cluster": i, "dim": j, "kind": "periodic", "loc": float(c[i, j]), "scale": float("nan"), "weight": float("nan")} for i in range(n_clusters) for j in range(d)]
    found = assign_rows(data, "__x", lambda x: np.eye(len(c))[distances(x, c).argmin(1)])
    return Clustering(found, parameters, {"method": "k_means_periodic", "n_clusters": n_clusters, "metric": metric}, {"centroids": c, "q": float(q[best])})


@dataclass
class Mixture:
    """Parameters of one start: weights, locations and scales by cluster and dimension. The first ``angles`` dimensions are angles."""

    weight: np.ndarray
    loc: np.ndarray
    scale: np.ndarray
    angles: int

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        a = self.angles
        out = np.log(np.maximum(self.weight, 1e-300))[None, :].repeat(len(x), 0)
        if a:
            k, m = self.scale[:, :a], self.loc[:, :a]
            out += np.cos(x[:, :a]) @ (k * np.cos(m)).T + np.sin(x[:, :a]) @ (k * np.sin(m)).T - (log_i0(k) + math.log(2 * math.pi)).sum(1)[None, :]
        if a < x.shape[1]:
            s, m, y = self.scale[:, a:], self.loc[:, a:], x[:, a:]
            out += -0.5 * ((y * y) @ (1 / s**2).T - 2 * y @ (m / s**2).T + (m**2 / s**2).sum(1)[None, :]) - (np.log(s) + 0.5 * math.log(2 * math.pi)).sum(1)[None, :]
        return out

    def memberships(self, x: np.ndarray, hard: bool = False) -> np.ndarray:
        """By log-sum-exp, so that far rows underflow to nothing worse than 0."""
        j = self.log_joint(x)
        z = np.exp(j - j.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        return np.eye(z.shape[1])[z.argmax(1)] if hard else z


def expectation_sums(x: np.ndarray, m: Mixture, hard: bool) -> np.ndarray:
    """What the maximisation needs: memberships, their products with cosines, sines, values and squares, and two log-likelihoods."""
    j = m.log_joint(x)
    top = j.max(1, keepdims=True)
    e = np.exp(j - top)
    true = float((np.log(e.sum(1)) + top[:, 0]).sum())
    z = e / e.sum(1, keepdims=True)
    z = np.eye(z.shape[1])[z.argmax(1)] if hard else z
    weighted = float((z * np.where(j > math.log(1e-300), j, 0)).sum())
    a = m.angles
    y = x[:, a:] - m.loc[:, a:].mean(0)
    return np.concatenate((z.sum(0), (z.T @ np.cos(x[:, :a])).ravel(), (z.T @ np.sin(x[:, :a])).ravel(), (z.T @ y).ravel(), (z.T @ (y * y)).ravel(), [weighted, true]))


def maximise(got: np.ndarray, m: Mixture, n: int) -> Mixture:
    """New parameters from the sums. Clusters without members keep theirs."""
    k, a, g = len(m.weight), m.angles, m.loc.shape[1] - m.angles
    cuts = np.cumsum([k, k * a, k * a, k * g, k * g])
    size, c, s, y, yy = np.split(got[: cuts[-1]], cuts[:-1])
    c, s, y, yy = c.reshape(k, a), s.reshape(k, a), y.reshape(k, g), yy.reshape(k, g)
    there = np.maximum(size, 1e-12)[:, None]
    loc, scale = m.loc.copy(), m.scale.copy()
    shift = m.loc[:, a:].mean(0)
    loc[:, :a] = np.arctan2(s, c)
    scale[:, :a] = np.clip(kappa_of(np.hypot(s, c) / there), *KAPPA_LIMITS)
    loc[:, a:] = y / there + shift
    scale[:, a:] = np.clip(np.sqrt(np.maximum(0, yy / there - (y / there) ** 2)), *STD_LIMITS)
    empty = size < 1e-9
    loc[empty], scale[empty] = m.loc[empty], m.scale[empty]
    return Mixture(size / n, loc, scale, a)


def mixture(
    features: DataFrame, column: str, angles: int, method: str, n_clusters: int, n_iterations: int = 20, seed: int = 743, n_starts: int = 1, start: str = "k_means",
    hard: bool = False, least_iterations: int = 10, loc_step: float = 0.01, scale_step: float = 0.2, ll_step: float = 1e-4,
) -> Clustering:
    """Expectation maximisation of von Mises and Gaussian dimensions together, all starts at once; the best log-likelihood wins.

    A start has converged when, after ``least_iterations``, locations and scales move by no
    more than their steps (Euclidean norms) and the log-likelihood by no more than its share.
    """
    features = written(features.select("instance_id", column))
    d = width(features, column)
    if not d:
        return nothing(features, column, {"method": method, "n_clusters": n_clusters, "n_iterations": n_iterations, "seed": seed, "start": start})
    moments = sums_by_start(features, column, lambda x: np.concatenate(([len(x)], x.sum(0), (x * x).sum(0)))[None, :], 1, 1 + 2 * d)[0]
    n, k = int(moments[0]), min(n_clusters, int(moments[0]))
    mean = moments[1 : 1 + d] / n
    std = np.sqrt(np.maximum(moments[1 + d :] / n - mean**2, 0))[angles:] + 1e-12

    def embedded(x: np.ndarray) -> np.ndarray:
        return np.concatenate((np.cos(x[:, :angles]), np.sin(x[:, :angles]), x[:, angles:] / std), axis=1)

    def first_sums(x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Sums of the rows of each first cluster; Gaussian dimensions around the mean of all, as in the iterations."""
        z, y = np.eye(k)[near], x[:, angles:] - mean[angles:]
        return np.concatenate((z.sum(0), (z.T @ np.cos(x[:, :angles])).ravel(), (z.T @ np.sin(x[:, :angles])).ravel(), (z.T @ y).ravel(), (z.T @ (y * y)).ravel()))

    if start == "k_means":
        e = F.col(column)
        spread = F.concat(*[F.transform(F.slice(e, 1, angles), f) for f in (F.cos, F.sin) if angles], F.zip_with(F.slice(e, angles + 1, max(d - angles, 0)), F.array(*[F.lit(float(v)) for v in std]).cast("array<double>"), lambda x, v: x / v))
        far, weight = far_candidates(features.select("instance_id", spread.alias("__x")), "__x", k, seed)
        centres = [weighted_centres(far, weight, min(k, len(far)), np.random.default_rng(seed + s)) for s in range(n_starts)]
        sums = sums_by_start(features, column, lambda x: np.array([first_sums(x, squared_distances(embedded(x), c).argmin(1)) for c in centres]), n_starts, k + 2 * k * angles + 2 * k * (d - angles))
    else:
        some = matrix(features.orderBy(F.xxhash64("instance_id", F.lit(seed)), "instance_id").limit(2000).select(column).toArrow().column(0).combine_chunks())
        sums = np.array([first_sums(some, np.random.default_rng(seed + s).integers(k, size=len(some))) for s in range(n_starts)])
    zero = Mixture(np.full(k, 1 / k), np.tile(np.concatenate((np.zeros(angles), mean[angles:])), (k, 1)), np.ones((k, d)), angles)
    now = [maximise(x, zero, n if start == "k_means" else len(some)) for x in sums]
    ll, cells = np.full(n_starts, -np.inf), k + 2 * k * angles + 2 * k * (d - angles) + 2
    trace: list[list[float]] = []
    for i in range(n_iterations):
        got = sums_by_start(features, column, lambda x, now=now: np.array([expectation_sums(x, m, hard) for m in now]), n_starts, cells)
        new = [maximise(g[:-2], m, n) for g, m in zip(got, now, strict=True)]
        steps = [(np.linalg.norm(b.loc - a.loc), np.linalg.norm(b.scale - a.scale)) for a, b in zip(now, new, strict=True)]
        change = np.abs((got[:, -2] - ll) / got[:, -2])
        now, ll = new, got[:, -2]
        trace.append(got[:, -1].tolist())
        if i + 1 > min(least_iterations, n_iterations) and all(a < loc_step and b < scale_step for a, b in steps) and (change < ll_step).all():
            break
    best = int(np.argmax(ll))
    m = now[best]
    parameters = [{"cluster": c, "dim": j, "kind": "von_mises" if j < angles else "normal", "loc": float(m.loc[c, j]), "scale": float(m.scale[c, j]), "weight": float(m.weight[c])} for c in range(k) for j in range(d)]
    found = assign_rows(features, column, lambda x: m.memberships(x, hard))
    free = k * (2 * d + 1) - 1
    details = {"ll": float(ll[best]), "true_ll": trace[-1][best], "bic_reference": -2 * float(ll[best]) + 3 * k * math.log(d), "bic": -2 * trace[-1][best] + free * math.log(max(n, 1)), "iterations": len(trace), "trace": [t[best] for t in trace], "mixture": m}
    return Clustering(found, parameters, {"method": method, "n_clusters": n_clusters, "n_iterations": n_iterations, "seed": seed, "start": start}, details)


@clusterer
def EM_VMM(features: DataFrame, n_clusters: int = 16, column: str = "phases", **settings) -> Clustering:  # noqa: N802
    """Mixture of von Mises distributions of angles."""
    d = width(features, column)
    return mixture(features, column, d, "EM_VMM", n_clusters, **settings)


@clusterer
def EM_GMM(features: DataFrame, n_clusters: int = 16, column: str = "values", covariance_type: str = "diag", sin_cos: bool = False, seed: int = 743, **settings) -> Clustering:  # noqa: N802
    """Mixture of Gaussians with diagonal or full covariances, of the values or of their cosines and sines."""
    if covariance_type not in ("diag", "full"):
        raise ValueError("covariance_type must be diag or full")
    if sin_cos:
        features = features.withColumn(column, F.flatten(F.transform(column, lambda x: F.array(F.cos(x), F.sin(x)))))
    if covariance_type == "full":
        return full_covariances(features, n_clusters, column, seed, **settings)
    return mixture(features, column, 0, "EM_GMM", n_clusters, seed=seed, **settings)


@clusterer
def EM_GMM2(features: DataFrame, n_clusters: int = 16, column: str = "values", **settings) -> Clustering:  # noqa: N802
    """Gaussians with diagonal covariances on the values as they are."""
    return mixture(features, column, 0, "EM_GMM2", n_clusters, **settings)


@clusterer
def EM_VMM_GMM(features: DataFrame, n_clusters: int = 16, phases: str = "phases", values: str = "values", **settings) -> Clustering:  # noqa: N802
    """Angles as von Mises and amplitude ratios as Gaussians in one mixture."""
    d = width(features, phases)
    both = features.withColumn("__both", F.concat(phases, values))
    return mixture(both, "__both", d, "EM_VMM_GMM", n_clusters, **settings)


def stacked(features: DataFrame, amps: str = "amp", norm_method: str = "sum", channel: int = 0) -> DataFrame:
    """Real and imaginary parts of complex vectors in column __ri: over their channel sum, over the next channel (adj) or over ``channel`` (ref)."""
    ways = {"sum": angles.over_sum, "adj": angles.adjacent_ratio, "ref": lambda a: angles.reference_ratio(a, channel)}
    if norm_method not in ways:
        raise ValueError("norm_method must be sum, adj or ref")
    z = ways[norm_method](F.col(amps))
    return features.withColumn("__ri", F.concat(F.transform(z, lambda a: a["re"]), F.transform(z, lambda a: a["im"])))


@clusterer
def EM_GMM_GMM(features: DataFrame, n_clusters: int = 16, amps: str = "amp", **settings) -> Clustering:  # noqa: N802
    """Gaussians of the real and imaginary parts of normalised complex vectors."""
    return mixture(stacked(features, amps), "__ri", 0, "EM_GMM_GMM", n_clusters, **settings)


@clusterer
def EM_GMM_GMM2(features: DataFrame, n_clusters: int = 16, amps: str = "amp", norm_method: str = "sum", channel: int = 0, start: str = "random", **settings) -> Clustering:  # noqa: N802
    """Like EM_GMM_GMM with a choice of the normalisation, by default from random memberships."""
    return mixture(stacked(features, amps, norm_method, channel), "__ri", 0, "EM_GMM_GMM2", n_clusters, start=start, **settings)


def full_covariances(features: DataFrame, n_clusters: int, column: str, seed: int, n_iterations: int = 100) -> Clustering:
    """EM_GMM with full covariances by Spark's own mixture. The covariances and the criterion are in the details."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector, vector_to_array

    settings = {"method": "EM_GMM", "n_clusters": n_clusters, "covariance_type": "full", "seed": seed}
    features = written(features.select("instance_id", column))
    n, d = features.count(), width(features, column)
    if not n:
        return nothing(features, column, settings)
    k = min(n_clusters, n)
    if k < 2:
        raise ValueError("full covariances need two rows and two clusters")
    rows = features.select("instance_id", array_to_vector(column).alias("features"))
    model = GaussianMixture(k=k, seed=seed, maxIter=n_iterations).fit(rows)
    z = vector_to_array("probability")
    found = model.transform(rows).select(F.col("instance_id").cast("long"), F.col("prediction").alias("cluster"), F.array_max(z).alias("probability"), z.alias("z"))
    shapes = model.gaussiansDF.collect()
    covariances = np.array([g["cov"].toArray() for g in shapes])
    parameters = [{"cluster": c, "dim": j, "kind": "normal", "loc": float(g["mean"][j]), "scale": float(np.sqrt(covariances[c, j, j])), "weight": float(model.weights[c])} for c, g in enumerate(shapes) for j in range(d)]
    ll = float(model.summary.logLikelihood)
    free = k * (d + d * (d + 1) // 2 + 1) - 1
    return Clustering(found, parameters, settings, {"ll": ll, "bic": -2 * ll + free * math.log(n), "covariances": covariances, "iterations": model.summary.numIter})


def full_gmm(features: DataFrame, n_clusters: int = 16, column: str = "values", seed: int = 743):
    """Gaussian mixture with full covariances: Spark's own."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    rows = features.select("instance_id", array_to_vector(column).alias("features"))
    model = GaussianMixture(k=n_clusters, seed=seed).fit(rows)
    return model.transform(rows).select("instance_id", F.col("prediction").alias("cluster")), model


def cluster(features: DataFrame, method: str = "EM_VMM", amplitude: bool = False, amps: str = "amp", **settings) -> Clustering:
    """Cluster by a method's name. With ``amplitude`` magnitudes of the complex data take the place of the phases."""
    if method not in CLUSTERERS:
        raise ValueError(f"unknown method {method!r}; known are {', '.join(CLUSTERERS)}")
    if amplitude:
        features = features.withColumn("values", F.transform(amps, lambda z: F.sqrt(z["re"] * z["re"] + z["im"] * z["im"])))
        settings.setdefault("column", "values")
    return CLUSTERERS[method](features, **settings)


def artificial(spark, n: int, k: int, d: int, seed: int = 0, kappas: tuple[float, float] = (5.0, 20.0), weights: tuple[float, ...] | None = None, kind: str = "von_mises") -> DataFrame:
    """Features drawn from a mixture: instance_id, phases and the true cluster (truth); made row by row from id and seed.

    Means lie in (-pi, pi), concentrations in ``kappas``; ``kind`` normal draws wrapped Gaussians of
    the same circular deviation, covariant ones with a shared part.
    """
    weights = weights or (1 / k,) * k
    if abs(sum(weights) - 1) > 1e-3:
        raise ValueError("the weights must add up to 1")
    rng = np.random.default_rng(seed)
    mu, kappa = rng.uniform(-math.pi, math.pi, (k, d)), rng.uniform(*kappas, (k, d))

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            own = np.random.default_rng([seed, int(ids[0]) if len(ids) else 0])
            c = own.choice(k, len(ids), p=np.array(weights) / sum(weights))
            if kind == "von_mises":
                x = own.vonmises(mu[c], kappa[c])
            else:
                sd = np.sqrt(1 / kappa[c])
                shared = own.normal(size=(len(ids), 1)) * 0.5 if kind == "covariant" else 0.0
                x = mu[c] + sd * (own.normal(size=(len(ids), d)) + shared)
                x = (x + math.pi) % (2 * math.pi) - math.pi
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(c.astype(np.int32))], names=["instance_id", "phases", "truth"])

    return spark.range(n).withColumnRenamed("id", "instance_id").mapInArrow(run, "instance_id long, phases array<double>, truth int")
