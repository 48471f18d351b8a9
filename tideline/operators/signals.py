"""Sampled signals in long form: shot, diag, ch_ix, sample_ix, t, value.

Every transform takes and returns a DataFrame. What is known of a whole shot or channel is
aggregated and joined; running values are scanned in blocks, so that work is spread however long a
channel is.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import blocks
from tideline.registry import transform

CHANNEL = ("shot", "ch_ix")
PARTS = "real_value array<double>, imag_value array<double>, real_count array<double>, imag_count array<double>"


@transform
def reduce_time(samples: DataFrame, start: float, end: float) -> DataFrame:
    """Samples with start <= t < end; the predicate reaches a Parquet scan."""
    return samples.where((F.col("t") >= start) & (F.col("t") < end))


@transform
def get_channel(samples: DataFrame, channel: int) -> DataFrame:
    """One channel (from 0); a negative number is an error."""
    if channel < 0:
        raise ValueError("channels are numbered from 0")
    return samples.where(F.col("ch_ix") == channel)


@transform
def downsample(samples: DataFrame, every: int) -> DataFrame:
    return samples.where(F.pmod(F.col("sample_ix"), F.lit(every)) == 0)


def shape(samples: DataFrame) -> DataFrame:
    """Channels and samples of each shot, and whether all channels are equally long."""
    each = samples.groupBy(*CHANNEL).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("shot").agg(F.count(F.lit(1)).alias("n_channels"), F.max("n").alias("n_samples"), (F.max("n") == F.min("n")).alias("equal_length"))


@transform
def subtract_mean(samples: DataFrame) -> DataFrame:
    means = samples.groupBy(*CHANNEL).agg(F.avg("value").alias("__mean"))
    return blocks.beside(samples, means, *CHANNEL).withColumn("value", F.col("value") - F.col("__mean")).select(*samples.columns)


METHODS = {"0": "none", 0: "none", "none": "none", "p": "peak", "peak": "peak", "r": "rms", "rms": "rms", "v": "var", "var": "var"}


def scales(samples: DataFrame, method: str = "peak", separate: bool = False) -> DataFrame:
    """Scale of each channel: peak, rms or population variance; jointly the largest of the shot."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    agg = {"none": F.lit(1.0), "peak": F.max(F.abs("value")), "rms": F.sqrt(F.avg(F.col("value") * F.col("value"))), "var": F.var_pop("value")}[METHODS[method]]
    each = samples.groupBy(*CHANNEL).agg(F.max(agg).alias("scale") if METHODS[method] == "none" else agg.alias("scale"))
    if separate or METHODS[method] == "none":
        return each
    return each.withColumn("scale", F.max("scale").over(Window.partitionBy("shot")))


@transform
def normalise(samples: DataFrame, method: str = "peak", separate: bool = False) -> DataFrame:
    """Values over the scale, which stays in a column. Method 0 leaves them as they are; a scale of 0 gives null."""
    if METHODS.get(method) == "none":
        return samples.withColumn("scale", F.lit(1.0))
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    rows = samples.drop("scale")
    out = blocks.beside(rows, scales(rows, method, separate), *CHANNEL)
    return out.withColumn("value", F.try_divide("value", "scale")).select(*rows.columns, "scale")


def rms_of_scales(scaled: DataFrame) -> DataFrame:
    """Root mean square of the channels' scales of each shot."""
    each = scaled.groupBy(*CHANNEL).agg(F.first("scale").alias("scale"))
    return each.groupBy("shot").agg(F.sqrt(F.avg(F.col("scale") * F.col("scale"))).alias("rms_scale"))


def steps(samples: DataFrame, value: str, size: int = blocks.BLOCK) -> DataFrame:
    """Samples with __step, the change of ``value`` since the sample before. Blocks hand their last value to the next."""
    rows = samples.withColumn("__block", blocks.block_of(size))
    last = rows.groupBy(*CHANNEL, "__block").agg(F.max_by(value, "sample_ix").alias("__end"))
    carried = last.withColumn("__end", F.lag("__end").over(Window.partitionBy(*CHANNEL).orderBy("__block")))
    inside = Window.partitionBy(*CHANNEL, "__block").orderBy("sample_ix")
    out = blocks.beside(rows, carried, *CHANNEL, "__block")
    return out.withColumn("__step", F.col(value) - F.coalesce(F.lag(value).over(inside), F.col("__end"))).drop("__end")


def contiguity(samples: DataFrame) -> DataFrame:
    """Is each channel evenly sampled? The largest squared deviation from the first step must be below the hundredth of its square."""
    off = steps(samples.select(*CHANNEL, "sample_ix", "t"), "t").where("__step IS NOT NULL")
    sums = off.groupBy(*CHANNEL).agg(F.min_by("__step", "sample_ix").alias("first"), F.max("__step").alias("most"), F.min("__step").alias("least"))
    far = F.greatest(F.pow(F.col("most") - F.col("first"), 2), F.pow(F.col("least") - F.col("first"), 2))
    return sums.select(*CHANNEL, (far < F.pow(0.1 * F.col("first"), 2)).alias("contiguous"))


@transform
def remove_noncontiguous(samples: DataFrame) -> DataFrame:
    """Shots all of whose channels are evenly sampled."""
    good = contiguity(samples).groupBy("shot").agg(F.min("contiguous").alias("ok")).where("ok").select("shot")
    return samples.join(good, "shot", "left_semi")


def segment(samples: DataFrame, n: int, overlap: float = 1, include_last: bool = False) -> DataFrame:
    """Windows of ``n`` samples, n // overlap apart: a row for each window (seg_ix) that a sample is in.

    Windows start below length - n, so that one that fits exactly at the end is left out unless
    ``include_last``. A sample's windows follow from its number, without a join.
    """
    hop = max(1, int(n // overlap))
    last = samples.groupBy("shot").agg((F.max("sample_ix") + 1 - n).alias("__end"))
    top = F.floor(F.least(F.col("sample_ix"), F.col("__end") if include_last else F.col("__end") - 1) / hop)
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("sample_ix") - n) / hop) + 1)
    tagged = blocks.beside(samples, last, "shot").withColumn("__low", low).withColumn("__top", top).where(F.col("__low") <= F.col("__top"))
    return tagged.withColumn("seg_ix", F.explode(F.sequence("__low", "__top"))).select(*samples.columns, "seg_ix", (F.col("sample_ix") - F.col("seg_ix") * hop).alias("in_seg"))


def segment_energy(segments: DataFrame) -> DataFrame:
    return segments.groupBy("shot", "seg_ix", "ch_ix").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.sum(F.col("value") * F.col("value")).alias("energy"))


def pack(samples: DataFrame, *keys: str, order: str = "sample_ix", value: str = "value", t: str = "t") -> DataFrame:
    """One row for each key: times and values as arrays in order."""
    rows = samples.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, t, value))).alias("__rows"))
    return rows.select(*keys, F.transform("__rows", lambda r: r[t]).alias("t"), F.transform("__rows", lambda r: r[value]).alias("x"))


def unpack(packed: DataFrame, *keys: str) -> DataFrame:
    """The samples of packed rows, numbered from 0."""
    return packed.select(*keys, F.posexplode(F.arrays_zip("t", "x")).alias("sample_ix", "__z")).select(*keys, F.col("sample_ix").cast("long"), F.col("__z.t").alias("t"), F.col("__z.x").alias("value"))


def all_lags(one: DataFrame, two: DataFrame, block: int, band: int = 64) -> DataFrame:
    """Sums of products (shot, lag, correlation) of (shot, i, a) and (shot, j, b) at every lag i - j.

    Each side is cut into blocks of ``block`` samples and each block is transformed once. Products of
    spectra are summed by the difference of the block numbers: for ``band`` frequencies at a time the
    spectra of all blocks of a shot are one group, and the sums over pairs of blocks are
    themselves a correlation along the block numbers. Each difference is transformed back once. The
    same is done for the counts of samples, so that lags without a pair give no row. Rows of null
    values take no part; values must be finite.
    """
    import numpy as np
    import pyarrow as pa

    size = 2 * block
    bands = -(-(block + 1) // band)
    kind = dict(one.dtypes)["shot"]

    def spectra(rows: DataFrame, i: str, x: str, side: int) -> DataFrame:
        """The spectra of each block's values and counts, a row for each band of frequencies."""

        def run(key: tuple, table: pa.Table) -> pa.Table:
            at = table["i"].to_numpy() - key[1].as_py() * block
            z = np.array([np.fft.rfft(np.bincount(at, w, block), size) for w in (table["x"].to_numpy(), None)])
            z = np.pad(z, ((0, 0), (0, bands * band - z.shape[1]))).reshape(2, bands, band)
            head = {"shot": pa.array([key[0].as_py()] * bands, key[0].type), "side": pa.array([side] * bands, pa.int32()), "block": pa.array([key[1].as_py()] * bands, pa.int64())}
            return pa.table({**head, "band": pa.array(range(bands), pa.int32()), **parts(z)})

        kept = rows.where(F.col(x).isNotNull()).select("shot", F.floor(F.col(i) / block).cast("long").alias("block"), F.col(i).cast("long").alias("i"), F.col(x).cast("double").alias("x"))
        return kept.groupBy("shot", "block").applyInArrow(run, f"shot {kind}, side int, block long, band int, {PARTS}")

    def parts(z: np.ndarray) -> dict[str, pa.ListArray]:
        return {f"{p}_{n}": blocks.as_lists(getattr(z[k], p)) for k, n in enumerate(("value", "count")) for p in ("real", "imag")}

    def whole(table: pa.Table) -> list[np.ndarray]:
        return [blocks.as_matrix(table[f"real_{n}"]) + 1j * blocks.as_matrix(table[f"imag_{n}"]) for n in ("value", "count")]

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        """Within one band: the first side's spectra times the conjugates of the second's, summed by the difference of their blocks."""
        side, at = table["side"].to_numpy(), table["block"].to_numpy()
        n = int(at.max() - at.min()) + 1
        out = []
        for z in whole(table):
            grid = np.zeros((2, 2 * n, band), complex)
            grid[side, at - at.min()] = z
            f = np.fft.fft(grid, axis=1)
            out.append(np.roll(np.fft.ifft(f[0] * f[1].conj(), axis=0), n - 1, axis=0)[: 2 * n - 1])
        m = 2 * n - 1
        return pa.table({"shot": pa.array([key[0].as_py()] * m, key[0].type), "difference": pa.array(range(1 - n, n), pa.int64()), "band": pa.array([key[1].as_py()] * m, pa.int32()), **parts(np.array(out))})

    def back(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["band"].to_numpy())
        value, count = (np.fft.irfft(z[order].ravel()[: block + 1], size) for z in whole(table))
        lag = np.arange(1 - block, block)
        met = lag[count[lag].round() > 0]
        return pa.table({"shot": pa.array([key[0].as_py()] * len(met), key[0].type), "lag": pa.array(key[1].as_py() * block + met, pa.int64()), "correlation": pa.array(value[met])})

    both = spectra(one, "i", "a", 0).unionByName(spectra(two, "j", "b", 1))
    differences = both.groupBy("shot", "band").applyInArrow(summed, f"shot {kind}, difference long, band int, {PARTS}")
    lags = differences.groupBy("shot", "difference").applyInArrow(back, f"shot {kind}, lag long, correlation double")
    return lags.groupBy("shot", "lag").agg(F.sum("correlation").alias("correlation"))


def correlate(samples: DataFrame, first: int, second: int, mode: str = "valid", block: int = 16_384) -> DataFrame:
    """Correlation of two equally long channels of each shot: the single product sum (valid) or all lags (full)."""
    one = samples.where(F.col("ch_ix") == first).select("shot", F.col("sample_ix").alias("i"), F.col("value").alias("a"))
    two = samples.where(F.col("ch_ix") == second).select("shot", F.col("sample_ix").alias("j"), F.col("value").alias("b"))
    if mode == "valid":
        pairs = one.join(two.withColumnRenamed("j", "i"), ["shot", "i"])
        return pairs.groupBy("shot").agg(F.sum(F.col("a") * F.col("b")).alias("correlation"))
    if mode != "full":
        raise ValueError("mode must be valid or full")
    return all_lags(one, two, block)


def neighbour_differences(samples: DataFrame) -> DataFrame:
    """Difference of each channel to the next one at the same sample."""
    w = Window.partitionBy("shot", "sample_ix").orderBy("ch_ix")
    return samples.withColumn("difference", F.lead("value").over(w) - F.col("value")).where("difference IS NOT NULL")


def running_sum(samples: DataFrame, size: int = blocks.BLOCK) -> DataFrame:
    rows = samples.withColumn("__block", blocks.block_of(size))
    return blocks.prefix_sums(rows, CHANNEL, "__block", ("sample_ix",), running=F.col("value")).select(*samples.columns, "running")


def unwrap(samples: DataFrame, period: float = 6.283185307179586, size: int = blocks.BLOCK) -> DataFrame:
    """Values freed of jumps larger than half a period, channel by channel."""
    step = F.col("__step")
    jump = F.when(F.abs(step) > period / 2, -period * F.round(step / period)).otherwise(0.0)
    rows = steps(samples, "value", size).withColumn("__jump", F.coalesce(jump, F.lit(0.0)))
    out = blocks.prefix_sums(rows, CHANNEL, "__block", ("sample_ix",), __turns=F.col("__jump"))
    return out.withColumn("value", F.col("value") + F.col("__turns")).select(*samples.columns)


def stack_channels(first: DataFrame, second: DataFrame) -> DataFrame:
    """Channels of the second behind those of the first."""
    behind = (first.agg(F.max("ch_ix")).first()[0] if first.columns else None) or 0
    moved = second.withColumn("ch_ix", F.col("ch_ix") + F.lit(behind + 1))
    return first.unionByName(moved.select(*first.columns))


def stack_shots(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other)
    return first


def common_columns(first: DataFrame, second: DataFrame) -> list[str]:
    return [c for c in first.columns if c in second.columns]


def equal_except_for(first: DataFrame, second: DataFrame, ignored: tuple[str, ...] = ()) -> bool:
    """Same rows, as often, in all columns but the ignored ones?"""
    a, b = first.drop(*ignored), second.drop(*ignored)
    if sorted(a.columns) != sorted(b.columns):
        return False
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def ordered_segments(segments: DataFrame) -> DataFrame:
    """Segments (shot, seg_ix and more) with their start time t0 and their place in the order of start times, over all shots."""
    starts = segments.groupBy("shot", "seg_ix").agg(F.min("t").alias("t0"))
    return blocks.numbered(starts, "t0", "shot", "seg_ix")


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows with their place in a permutation that depends on the seed and their key only."""
    drawn = rows.withColumn("__draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    return blocks.numbered(drawn, "__draw", key).drop("__draw")


class Signals:
    """A samples DataFrame with chained transforms that leave a history; nothing is changed in place."""

    def __init__(self, samples: DataFrame, meta: dict | None = None, history: tuple[tuple[str, str, str], ...] = ()):
        self.samples, self.meta, self.history = samples, dict(meta or {}), history

    def __getattr__(self, name: str):
        from tideline.registry import TRANSFORMS

        if name not in TRANSFORMS:
            raise AttributeError(name)

        def call(*args, **kwargs):
            shown = ", ".join([*map(repr, args), *(f"{k}={v!r}" for k, v in kwargs.items())])
            now = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
            return Signals(TRANSFORMS[name](self.samples, *args, **kwargs), self.meta, (*self.history, (name, shown, now)))

        return call


class DataSet:
    """Labelled rows with set semantics on a key."""

    def __init__(self, rows: DataFrame, key: tuple[str, ...] = ("shot",), label: str = ""):
        self.rows, self.key, self.label = rows.dropDuplicates([*key]), key, label

    def add(self, rows: DataFrame) -> DataSet:
        """Rows whose key is new come in; known keys keep what they have."""
        fresh = rows.dropDuplicates([*self.key]).join(self.rows.select(*self.key), [*self.key], "left_anti")
        return DataSet(self.rows.unionByName(fresh.select(*self.rows.columns)), self.key, self.label)

    update = add

    def remove(self, rows: DataFrame) -> DataSet:
        return DataSet(self.rows.join(rows.select(*self.key), [*self.key], "left_anti"), self.key, self.label)

    def count(self) -> int:
        return self.rows.count()

    def contains(self, **key) -> bool:
        found = self.rows
        for k, v in key.items():
            found = found.where(F.col(k) == v)
        return not found.isEmpty()


class OrderedDataSet:
    """Rows with an explicit place, item_ix."""

    def __init__(self, rows: DataFrame, label: str = ""):
        self.rows, self.label = rows, label

    def append(self, rows: DataFrame) -> OrderedDataSet:
        """All appended rows form one item behind the last."""
        behind = self.rows.agg(F.max("item_ix")).first()[0]
        return OrderedDataSet(self.rows.unionByName(rows.withColumn("item_ix", F.lit(-1 if behind is None else behind) + 1).select(*self.rows.columns)), self.label)

    def item(self, place: int) -> DataFrame:
        return self.rows.where(F.col("item_ix") == place)

    def count(self) -> int:
        return self.rows.select("item_ix").distinct().count()
