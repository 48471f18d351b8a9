"""Weighted fits, cluster tables, comparisons and histograms.

Features in long form: instance_id, shot, cluster, dim, phase. Cluster tables have one row for
each cluster and dimension.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.angles import clipped_kappa, kappa_from_r
from tideline.functions.bessel import kappa_to_std, ln, von_mises_pdf
from tideline.operators import blocks


def long_phases(features: DataFrame, phases: str = "phases") -> DataFrame:
    rest = [c for c in features.columns if c != phases]
    return features.select(*rest, F.posexplode(phases).alias("dim", "phase"))


def vm_fit(rows: DataFrame, *keys: str, phase: str = "phase", weight: str | None = None, clip: bool = False) -> DataFrame:
    """Circular mean, mean resultant length and concentration by key, weighted over the number of rows."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = rows.groupBy(*keys).agg(F.sum(w * F.cos(phase)).alias("__c"), F.sum(w * F.sin(phase)).alias("__s"), F.sum(w).alias("__w"), F.count(F.lit(1)).alias("n"))
    c, s = F.col("__c") / F.col("__w"), F.col("__s") / F.col("__w")
    r = F.sqrt(c * c + s * s)
    kappa = clipped_kappa(r) if clip else kappa_from_r(F.least(r, F.lit(1 - 1e-12)))
    return sums.select(*keys, "n", F.atan2(s, c).alias("mu"), r.alias("r"), kappa.alias("kappa"))


def gaussian_fit(rows: DataFrame, *keys: str, value: str = "value", weight: str | None = None) -> DataFrame:
    """Weighted mean and population standard deviation by key."""
    w = F.col(weight) if weight else F.lit(1.0)
    x = F.col(value)
    first = rows.groupBy(*keys).agg((F.sum(w * x) / F.sum(w)).alias("mean"))
    both = rows.join(first, [*keys])
    return both.groupBy(*keys).agg(F.first("mean").alias("mean"), F.sqrt(F.sum(w * F.pow(x - F.col("mean"), 2)) / F.sum(w)).alias("std"))


def gamma_fit(rows: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """Shape and scale of a gamma distribution by the closed approximation of its maximum likelihood; NaN for values that no such distribution has (0 or less)."""
    s = ln(F.col("m")) - F.col("l")
    sums = rows.groupBy(*keys).agg(F.avg(value).alias("m"), F.avg(ln(F.col(value))).alias("l"))
    k = (3 - s + F.sqrt(F.pow(s - 3, 2) + 24 * s)) / (12 * s)
    return sums.select(*keys, k.alias("shape"), (F.col("m") / k).alias("theta"))


def periodic_centroid(rows: DataFrame, *keys: str, phase: str = "phase") -> DataFrame:
    """Circular mean and the sum of squared circular distances to it."""
    mean = rows.groupBy(*keys).agg(F.atan2(F.sum(F.sin(phase)), F.sum(F.cos(phase))).alias("centroid"))
    d = F.abs(F.pmod(F.col(phase) - F.col("centroid"), F.lit(2 * math.pi)))
    near = F.least(d, 2 * math.pi - d)
    return rows.join(mean, [*keys]).groupBy(*keys).agg(F.first("centroid").alias("centroid"), F.sum(near * near).alias("q"))


def exact_periodic_centroid(rows: DataFrame, *keys: str, phase: str = "phase") -> DataFrame:
    """The point on the circle with the smallest sum of squared circular distances.

    With the angles sorted in [0, 2 pi), the sum is a parabola for each number of angles that
    are taken one turn further; each parabola's lowest point follows from prefix sums. The angles are
    sorted in sampled ranges and the sums are carried from range to range, so that one group may hold most rows.
    """
    turn = 2 * math.pi
    own = rows.select(*keys, F.pmod(F.col(phase), F.lit(turn)).alias("__x"), F.monotonically_increasing_id().alias("__i"))
    spread = blocks.ranged(own, *keys, "__x", "__i")
    totals = spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum("__x").alias("__all"), F.sum(F.col("__x") * F.col("__x")).alias("__squares"))
    moved = blocks.prefix_sums(spread, keys, "__block", ("__x", "__i"), __k=F.lit(1), __more=2 * turn * F.col("__x") + turn * turn)
    step = blocks.beside(moved, totals, *keys).withColumn("__sum", F.col("__all") + turn * F.col("__k"))
    cost = F.col("__squares") + F.col("__more") - F.col("__sum") * F.col("__sum") / F.col("__n")
    best = step.groupBy(*keys).agg(F.min_by(F.struct((F.col("__sum") / F.col("__n")).alias("c"), cost.alias("q")), F.struct(cost, "__k")).alias("b"))
    return best.select(*keys, F.pmod(F.col("b.c"), F.lit(turn)).alias("centroid"), F.greatest(F.col("b.q"), F.lit(0.0)).alias("q"))


def tightness(clusters: DataFrame, degrees: bool = True) -> DataFrame:
    """Mean concentration, arithmetic mean (sigma_eq) and geometric mean (sigma_bar) of the circular deviations of each cluster."""
    std = kappa_to_std(F.col("kappa"), degrees)
    return clusters.groupBy("cluster").agg(F.max("n").alias("n"), F.avg("kappa").alias("kappa"), F.avg(std).alias("sigma_eq"), F.exp(F.avg(F.log(std))).alias("sigma_bar"))


def passing(clusters: DataFrame, cutoff: float, by: str = "sigma_eq") -> DataFrame:
    """Clusters that are tight enough: deviations below the cutoff, concentrations above it."""
    tight = tightness(clusters)
    return tight.where((F.col(by) > cutoff) if by == "kappa" else (F.col(by) < cutoff))


def filter_clusters(assignments: DataFrame, clusters: DataFrame, cutoff: float = 80.0, by: str = "sigma_eq", least_probability: float | None = None) -> DataFrame:
    """Rows of the clusters that pass; with ``least_probability`` only those at least so sure (column probability)."""
    out = assignments.join(passing(clusters, cutoff, by).select("cluster"), "cluster", "left_semi")
    return out.where(F.col("probability") >= least_probability) if least_probability is not None else out


def retention(clusters: DataFrame, by: str = "kappa", most: int = 50) -> DataFrame:
    """How many rows stay at each whole cutoff from 0 to ``most`` - 1; clusters are few, rows are not touched."""
    sizes = tightness(clusters)
    grid = sizes.select("cluster", "n", by, F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("cutoff"))
    kept = F.col(by) > F.col("cutoff") if by == "kappa" else F.col(by) < F.col("cutoff")
    return grid.groupBy("cutoff").agg(F.sum(F.when(kept, F.col("n")).otherwise(0)).cast("long").alias("retained"))


def similarity(first: DataFrame, second: DataFrame) -> DataFrame:
    """Common members of each pair of clusters of two clusterings."""
    pairs = first.select("instance_id", F.col("cluster").alias("first")).join(second.select("instance_id", F.col("cluster").alias("second")), "instance_id")
    return pairs.groupBy("first", "second").agg(F.count(F.lit(1)).alias("common"))


def accuracy(pairs: DataFrame) -> DataFrame:
    """Share of rows that are in the best match of their first cluster."""
    best = pairs.groupBy("first").agg(F.max("common").alias("best"), F.sum("common").alias("all"))
    return best.agg((F.sum("best") / F.sum("all")).alias("accuracy"))


def best_matches(pairs: DataFrame, a: str = "first", b: str = "second") -> DataFrame:
    """Best partner of each cluster; of equals the smallest."""
    return pairs.groupBy(a).agg(F.max_by(b, F.struct(F.col("common"), -F.col(b).cast("long"))).alias("match"), F.max("common").alias("common"), F.sum("common").alias("members"))


def greedy_matches(pairs: DataFrame) -> list[tuple[int, int, int]]:
    """Pairs of clusters by falling overlap, each cluster once. At most clusters squared counts reach the driver."""
    rows = sorted(((-r["common"], r["first"], r["second"]) for r in pairs.collect()))
    used: tuple[set, set] = (set(), set())
    out = []
    for n, a, b in rows:
        if a not in used[0] and b not in used[1]:
            used[0].add(a)
            used[1].add(b)
            out.append((a, b, -n))
    return out


def membership_quality(memberships: DataFrame, z: str = "z") -> DataFrame:
    """Best, worst, mean and deviation of the largest membership, and the largest error of the rows' sums."""
    top = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda a, x: a + x)
    return memberships.agg(F.max(top).alias("best"), F.min(top).alias("worst"), F.avg(top).alias("mean"), F.stddev_pop(top).alias("std"), F.max(F.abs(total - 1)).alias("sum_error"))


def histogram(rows: DataFrame, *keys: str, value: str = "phase", low: float = -math.pi, high: float = math.pi, bins: int = 180) -> DataFrame:
    """Counts and densities of equal bins; the last includes its end. Values outside count nowhere."""
    x = F.col(value)
    inside = rows.where((x >= low) & (x <= high))
    place = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(*keys)) if keys else F.sum("count").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("density", F.col("count") / total / ((high - low) / bins))


def covariances(rows: DataFrame, value: str = "phase", pearson: bool = False) -> DataFrame:
    """Population covariance or correlation of every pair of dimensions of each cluster.

    The rows of an instance are packed; sums of products are made for each cluster within Arrow
    batches as matrix products, so that only a few numbers for each cluster, pair and task are
    shuffled, not the pairs of every instance. Products are taken around the batch's means.
    """
    packed = rows.groupBy("cluster", "instance_id").agg(F.sort_array(F.collect_list(F.struct("dim", F.col(value).cast("double").alias("x")))).alias("z"))
    kind = dict(rows.dtypes)["cluster"]

    def run(batches):
        for b in batches:
            held: dict[tuple, list[list[float]]] = {}
            for cluster, dims, x in zip(b["cluster"].to_pylist(), b["dims"].to_pylist(), b["x"].to_pylist(), strict=True):
                held.setdefault((cluster, tuple(dims)), []).append(x)
            out: list[list] = [[] for _ in range(8)]
            for (cluster, dims), own in held.items():
                x = np.array(own, float)
                mean = x.mean(0)
                y = x - mean
                product, d = y.T @ y, len(dims)
                i, j = np.repeat(np.arange(d), d), np.tile(np.arange(d), d)
                for column, values in zip(out, ([cluster] * (d * d), np.array(dims)[i], np.array(dims)[j], np.full(d * d, len(x)), mean[i], mean[j], product.ravel(), np.tile(np.diag(product), d).reshape(d, d).T.ravel()), strict=True):
                    column.extend(values)
            kinds = (b["cluster"].type, pa.int32(), pa.int32(), pa.int64(), *(pa.float64(),) * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["cluster", "dim_a", "dim_b", "n", "mean_a", "mean_b", "product", "square_a"])

    lists = packed.select("cluster", F.transform("z", lambda z: z["dim"].cast("int")).alias("dims"), F.transform("z", lambda z: z["x"]).alias("x"))
    parts = lists.mapInArrow(run, f"cluster {kind}, dim_a int, dim_b int, n long, mean_a double, mean_b double, product double, square_a double")
    n, a, b_ = F.col("n"), F.col("mean_a"), F.col("mean_b")
    sums = parts.groupBy("cluster", "dim_a", "dim_b").agg(
        F.sum(n).alias("n"), F.sum(n * a).alias("a"), F.sum(n * b_).alias("b"), F.sum(F.col("product") + n * a * b_).alias("ab"), F.sum(F.col("square_a") + n * a * a).alias("aa")
    )
    both = sums.select("cluster", "dim_a", "dim_b", (F.col("ab") / F.col("n") - F.col("a") / F.col("n") * F.col("b") / F.col("n")).alias("covariance"), (F.col("aa") / F.col("n") - F.pow(F.col("a") / F.col("n"), 2)).alias("own"))
    if not pearson:
        return both.drop("own")
    other = both.where("dim_a = dim_b").select("cluster", F.col("dim_a").alias("dim_b"), F.col("own").alias("their"))
    return both.join(other, ["cluster", "dim_b"]).select("cluster", "dim_a", "dim_b", F.try_divide(F.col("covariance"), F.sqrt(F.col("own") * F.col("their"))).alias("covariance"))


def mean_off_diagonal(table: DataFrame) -> DataFrame:
    return table.where("dim_a <> dim_b").groupBy("cluster").agg(F.avg(F.abs("covariance")).alias("mean_abs"))


def vm_curves(clusters: DataFrame, points: int = 300) -> DataFrame:
    """The fitted density of each cluster and dimension on an even grid over [-pi, pi]."""
    x = F.lit(-math.pi) + F.col("i") * (2 * math.pi / (points - 1))
    grid = clusters.select("cluster", "dim", "mu", "kappa", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    return grid.select("cluster", "dim", "i", x.alias("x"), von_mises_pdf(x, F.col("mu"), F.col("kappa")).alias("density"))


def shares(assignments: DataFrame) -> DataFrame:
    """Weight of each cluster."""
    n = F.sum("members").over(Window.partitionBy(F.lit(0)))
    return assignments.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")).withColumn("share", F.col("members") / n)
