"""Singular value decomposition of segments and coherent structures made of singular values."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  gram() filters by it
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import blocks
from tideline.sources.files import written

SVD = "shot long, seg_ix long, svs array<double>, topos array<array<double>>, chronos array<array<double>>, energy double, p array<double>, entropy double, error string"
LEAF = "shot long, seg_ix long, node long, channels array<int>, factor array<double>, error string"
LONG = "shot long, seg_ix long, svs array<double>, topos array<array<double>>, energy double, p array<double>, entropy double, error string"
STRUCTURES = "shot long, seg_ix long, fs_ix int, svs array<int>, svs_mask long, time double, freq double, a12 double, p double, entropy double, energy double, phases array<double>, dphase array<double>, rms_scale double, error string"


def arrow_schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in text.split(", ")])


LEAF_ARROW = arrow_schema(LEAF)


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Channels by samples, and the times. Every channel must have every sample once."""
    at, channel = table["sample_ix"].to_numpy(), table["ch_ix"].to_numpy()
    channels, samples = len(np.unique(channel)), len(np.unique(at))
    if channels * samples != len(at):
        raise ValueError("samples are missing or repeated")
    order = np.lexsort((at, channel))
    return table["value"].to_numpy()[order].reshape(channels, samples), table["t"].to_numpy()[order[:samples]]


def decompose(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Topos (singular vectors over channels, one a row), singular values, chronos."""
    u, s, v = np.linalg.svd(x, full_matrices=False)
    return u.T, s, v


def energies(s: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Energy, shares and normalised entropy."""
    e = float((s**2).sum())
    p = s**2 / e if e else np.zeros_like(s)
    inside = p[p > 0]
    return e, p, float(-(inside * np.log(inside)).sum() / math.log(len(s))) if len(s) > 1 else 0.0


def energy_columns(svs: Column) -> dict[str, Column]:
    """The same from an array column of singular values."""
    e = F.aggregate(svs, F.lit(0.0), lambda acc, s: acc + s * s)
    p = F.transform(svs, lambda s: s * s / e)
    h = F.when(F.size(svs) > 1, -F.aggregate(p, F.lit(0.0), lambda acc, x: acc + F.when(x > 0, x * F.log(x)).otherwise(0.0)) / F.log(F.size(svs).cast("double"))).otherwise(0.0)
    return {"energy": e, "p": p, "entropy": h}


def coherence(chronos: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Normalised mean cross power of each pair of chronos."""
    z = np.fft.fft(chronos, axis=1)
    own = (np.abs(z) ** 2).mean(axis=1)
    return np.array([[np.abs(a * np.conj(z)).mean(axis=1) ** 2 / (own[i] * own)] for i, a in enumerate(z)]).reshape(len(z), len(z))


def group_geometric(gamma: np.ndarray, p: np.ndarray, max_energy: float = 1.0) -> list[list[int]]:
    """Groups of singular values: the strongest left takes those before the largest drop in coherence with it.

    With ``max_energy`` below 1 only the values before the cumulative share reaches it take part.
    """
    left = list(range(len(p)))
    if max_energy < 1:
        left = left[: int(np.searchsorted(np.cumsum(p), max_energy))]
    out = []
    while len(left) > 1:
        row = gamma[left[0], left]
        order = np.argsort(-row, kind="stable")
        drop = int(np.argmin(np.diff(row[order]))) + 1
        out.append(sorted(left[i] for i in order[:drop]))
        left = [i for i in left if i not in out[-1]]
    return out + [left] if left else out


def group_threshold(gamma: np.ndarray, p: np.ndarray, threshold: float = 0.2) -> list[list[int]]:
    """Groups of singular values: the strongest left takes all those whose coherence with it is above the threshold."""
    left, out = list(range(len(p))), []
    while left:
        first = left[0]
        out.append(sorted({first, *(i for i in left if gamma[first, i] > threshold)}))
        left = [i for i in left if i not in out[-1]]
    return out


GROUPING = {"geometric": group_geometric, "threshold": group_threshold}


def describe(group: list[int], topos: np.ndarray, s: np.ndarray, chronos: np.ndarray, t: np.ndarray, least_phase: float = -math.pi) -> dict:
    """Frequency, phases and energies of one group of singular values."""
    e, p, h = energies(s)
    lead = np.abs(np.fft.rfft(chronos[group[0]]))
    at = int(np.argmax(lead[: max(1, len(t) // 2)]))
    dt = float(t[1] - t[0]) if len(t) > 1 else 1.0
    built = (topos[group].T * s[group]) @ chronos[group]
    phases = np.angle(np.fft.rfft(built, axis=1)[:, at])
    step = (np.diff(phases) - least_phase) % (2 * math.pi) + least_phase
    return {
        "svs": group, "svs_mask": int(sum(1 << i for i in group)), "time": float(t.mean()), "freq": at / (len(t) * dt), "a12": float(s[group[1]] / s[group[0]]) if len(group) > 1 else 0.0,
        "p": float(p[group].sum()), "entropy": h, "energy": e, "phases": phases.tolist(), "dphase": step.tolist(),
    }


def by_segment(segments: DataFrame, each: Callable[[pa.Table], list[dict]], schema: str) -> DataFrame:
    """Rows of ``each`` for every segment (shot, seg_ix); channels are few, so that a segment fits a task. One that fails gives a row with its error."""
    rows = segments.select(F.col("shot").cast("long"), F.col("seg_ix").cast("long"), "ch_ix", "sample_ix", F.col("t").cast("double"), F.col("value").cast("double"))
    names = [c.strip().split()[0] for c in schema.split(", ")]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        try:
            found = each(table)
        except (np.linalg.LinAlgError, ValueError, IndexError) as bad:
            found = [{"error": str(bad)}]
        head = {"shot": key[0].as_py(), "seg_ix": key[1].as_py()}
        return pa.Table.from_pylist([dict.fromkeys(names) | head | row for row in found], arrow_schema(schema))

    return rows.groupBy("shot", "seg_ix").applyInArrow(run, schema)


def svd(segments: DataFrame) -> DataFrame:
    """Thin decomposition of each segment (shot, seg_ix). One that fails gives a row with its error and nulls. For long ones see ``long_svd``."""

    def each(table: pa.Table) -> list[dict]:
        topos, s, chronos = decompose(matrix(table)[0])
        e, p, h = energies(s)
        return [{"svs": s.tolist(), "topos": topos.tolist(), "chronos": chronos.tolist(), "energy": e, "p": p.tolist(), "entropy": h}]

    return by_segment(segments, each, SVD)


def across(samples: DataFrame, size: int = blocks.BLOCK) -> DataFrame:
    """Samples with their segment (0 if there is none) and the block that all channels share."""
    rows = samples if "seg_ix" in samples.columns else samples.withColumn("seg_ix", F.lit(0))
    return rows.select(F.col("shot").cast("long"), F.col("seg_ix").cast("long"), blocks.block_of(size).alias("block"), "ch_ix", F.col("sample_ix").cast("long"), F.col("value").cast("double"))


def triangle(x: np.ndarray) -> np.ndarray:
    """The square triangular factor of a tall matrix, padded with zeros if there are fewer rows than columns."""
    r = np.linalg.qr(x, mode="r")
    return np.pad(r, ((0, x.shape[1] - r.shape[0]), (0, 0)))


def long_svd(samples: DataFrame, size: int = blocks.BLOCK // 4, fan: int = 64) -> DataFrame:
    """Singular values and topos of segments of any length: shot, seg_ix, svs, topos, energy, p, entropy, error.

    A tree of orthogonal reductions: each block of samples gives the triangular factor of its matrix
    (samples by channels); ``fan`` neighbouring factors at a time are stacked and reduced to one, until one is left,
    whose decomposition is that of the whole. The chronos follow from a second pass (``chronos``). All channels
    must have the same samples; a segment where they don't gives a row with its error.
    """
    rows = across(samples, size)

    def leaf(key: tuple, table: pa.Table) -> pa.Table:
        shape = {"channels": None, "factor": None, "error": None}
        try:
            at, channel = table["sample_ix"].to_numpy(), table["ch_ix"].to_numpy()
            names = np.unique(channel)
            n = len(np.unique(at))
            if len(names) * n != len(at):
                raise ValueError("samples are missing or repeated")
            order = np.lexsort((at, channel))
            x = table["value"].to_numpy()[order].reshape(len(names), n).T
            if not np.isfinite(x).all():
                raise ValueError("values are missing or not finite")
            shape |= {"channels": names.tolist(), "factor": triangle(x).ravel().tolist()}
        except ValueError as bad:
            shape["error"] = str(bad)
        return pa.Table.from_pylist([{"shot": key[0].as_py(), "seg_ix": key[1].as_py(), "node": key[2].as_py(), **shape}], LEAF_ARROW)

    def reduced(key: tuple, table: pa.Table) -> pa.Table:
        part = table.sort_by("node").to_pylist()
        bad = next((r["error"] for r in part if r["error"]), None)
        if not bad and any(r["channels"] != part[0]["channels"] for r in part):
            bad = "samples are missing or repeated"
        row = {"channels": None, "factor": None, "error": bad}
        if not bad:
            c = len(part[0]["channels"])
            row |= {"channels": part[0]["channels"], "factor": triangle(np.array([r["factor"] for r in part]).reshape(-1, c)).ravel().tolist()}
        return pa.Table.from_pylist([{"shot": key[0].as_py(), "seg_ix": key[1].as_py(), "node": key[2].as_py(), **row}], LEAF_ARROW)

    def root(batches):
        for b in batches:
            found = []
            for r in b.to_pylist():
                row = {"shot": r["shot"], "seg_ix": r["seg_ix"], "error": r["error"]} | dict.fromkeys(("svs", "topos", "energy", "p", "entropy"))
                if not r["error"]:
                    c = len(r["channels"])
                    _, s, v = np.linalg.svd(np.array(r["factor"]).reshape(c, c))
                    e, p, h = energies(s)
                    row |= {"svs": s.tolist(), "topos": v.tolist(), "energy": e, "p": p.tolist(), "entropy": h}
                found.append(row)
            yield from pa.Table.from_pylist(found, arrow_schema(LONG)).to_batches()

    factors = written(rows.groupBy("shot", "seg_ix", "block").applyInArrow(leaf, LEAF))
    top = factors.agg(F.max("node")).first()[0] or 0
    while top > 0:
        above = factors.withColumn("node", F.floor(F.col("node") / fan).cast("long"))
        factors, top = written(above.groupBy("shot", "seg_ix", "node").applyInArrow(reduced, LEAF)), top // fan
    return factors.drop("node").mapInArrow(root, LONG)


def chronos(samples: DataFrame, found: DataFrame, size: int = blocks.BLOCK // 4) -> DataFrame:
    """Values of the chronos (shot, seg_ix, number, sample_ix, chrono) of long segments, block by block.

    Singular values that are zero up to rounding have no chrono.
    """
    rows = across(samples, size)

    def run(key: tuple, samples_: pa.Table, found_: pa.Table) -> pa.Table:
        at, channel = samples_["sample_ix"].to_numpy(), samples_["ch_ix"].to_numpy()
        order = np.lexsort((at, channel))
        s, v = np.array(found_["svs"][0].as_py()), np.array(found_["topos"][0].as_py())
        x = samples_["value"].to_numpy()[order].reshape(len(s), -1)
        kept = np.flatnonzero(s > s[0] * len(at) * np.finfo(float).eps)
        z = (v[kept] @ x) / s[kept, None]
        n = x.shape[1]
        return pa.table({
            "shot": pa.array([key[0].as_py()] * (n * len(kept)), pa.int64()), "seg_ix": pa.array([key[1].as_py()] * (n * len(kept)), pa.int64()), "number": pa.array(np.repeat(kept, n).astype(np.int32)),
            "sample_ix": pa.array(np.tile(at[order[:n]], len(kept))), "chrono": pa.array(z.ravel()),
        })

    good = found.where("error IS NULL").select("shot", "seg_ix", "svs", "topos")
    each = rows.select("shot", "seg_ix", "block").distinct()
    sides = written(blocks.beside(each, good, "shot", "seg_ix"))
    met = rows.join(written(good.select("shot", "seg_ix")), ["shot", "seg_ix"], "left_semi")
    keys = ("shot", "seg_ix", "block")
    return met.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(run, "shot long, seg_ix long, number int, sample_ix long, chrono double")


def structures(segments: DataFrame, group: str = "geometric", method: str = "rms", separate: bool = True, least_phase: float = -math.pi, **options: float) -> DataFrame:
    """Coherent structures of each segment: mean removal, normalisation, decomposition, grouping.

    A segment that fails gives a row with its error, so that one bad shot stops no other.
    """
    grouping = GROUPING[group]

    def each(table: pa.Table) -> list[dict]:
        x, t = matrix(table)
        x = x - x.mean(axis=1, keepdims=True)
        scale = {"rms": lambda: np.sqrt((x * x).mean(axis=1)), "peak": lambda: np.abs(x).max(axis=1), "var": lambda: x.var(axis=1), "none": lambda: np.ones(len(x))}[method]()
        scale = scale if separate else np.full(len(x), scale.max())
        topos, s, chronos = decompose(x / np.where(scale == 0, 1, scale)[:, None])
        gamma = coherence(chronos, s)
        _, p, _ = energies(s)
        rms = float(np.sqrt((scale**2).mean()))
        return [{"fs_ix": i, "rms_scale": rms} | describe(g, topos, s, chronos, t, least_phase) for i, g in enumerate(grouping(gamma, p, **options))]

    return by_segment(segments, each, STRUCTURES)


def valid_structures(found: DataFrame, power_cutoff: float = 0.05, min_svs: int = 2, low: float | None = None, high: float | None = None) -> DataFrame:
    """Structures with enough energy and singular values, and a frequency inside the limits if given."""
    out = found.where((F.col("p") > power_cutoff) & (F.bit_count("svs_mask") >= min_svs))
    if low is not None:
        out = out.where(F.col("freq") > low)
    return out.where(F.col("freq") < high) if high is not None else out


def account(found: DataFrame) -> DataFrame:
    """Segments of each shot that gave a result, and those that failed by their error: shot, error (null: none), segments."""
    return found.groupBy("shot", "error").agg(F.count_distinct("seg_ix").alias("segments"))


def first_structures(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` structures of each segment, in the order in which they were grouped."""
    return found.where(F.col("fs_ix") < most)


def derived_amplitudes(found: DataFrame) -> DataFrame:
    """Amplitude and energy of structures in units of the signal."""
    return found.withColumn("amplitude", F.sqrt("p") * F.col("rms_scale")).withColumn("adjusted_energy", F.col("p") * F.col("energy") * F.col("rms_scale") * F.col("rms_scale"))


def gram(samples: DataFrame, size: int = blocks.BLOCK // 4) -> DataFrame:
    """Products of channels summed over samples (shot, seg_ix, ch_a, ch_b, product): the small matrix whose eigenvalues are the squared singular values.

    Each block of samples gives one matrix product; those are summed. Pairs of channels without a
    sample in common have no row.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.filter(pa.compute.is_valid(table["value"]))
        names, row = np.unique(table["ch_ix"].to_numpy(), return_inverse=True)
        at, column = np.unique(table["sample_ix"].to_numpy(), return_inverse=True)
        x, there = np.zeros((len(names), len(at))), np.zeros((len(names), len(at)))
        x[row, column], there[row, column] = table["value"].to_numpy(), 1
        a, b = np.nonzero(np.triu(there @ there.T))
        return pa.table({"shot": pa.array([key[0].as_py()] * len(a), pa.int64()), "seg_ix": pa.array([key[1].as_py()] * len(a), pa.int64()), "ch_a": pa.array(names[a].astype(np.int32)), "ch_b": pa.array(names[b].astype(np.int32)), "product": pa.array((x @ x.T)[a, b])})

    sums = across(samples, size).groupBy("shot", "seg_ix", "block").applyInArrow(run, "shot long, seg_ix long, ch_a int, ch_b int, product double")
    return sums.groupBy("shot", "seg_ix", "ch_a", "ch_b").agg(F.sum("product").alias("product"))
