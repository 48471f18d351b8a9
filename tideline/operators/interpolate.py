"""Nearest, as-of and interpolating joins on time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import blocks
from tideline.sources.files import written


def change_time_base(samples: DataFrame, grid: DataFrame) -> DataFrame:
    """Piecewise linear values of every channel at the times of ``grid`` (shot, t), held constant beyond the ends.

    Grid and samples are merged by time, and each grid row takes the last sample before and
    the first after it, range by range of the times (``blocks.neighbours``), without pairs. Samples of
    equal time count once, by their mean.
    """
    known = samples.groupBy("shot", "ch_ix", "t").agg(F.avg("value").alias("value"))
    wanted = known.select("shot", "ch_ix").distinct().join(grid.select("shot", F.col("t")).distinct(), "shot")
    both = known.select("shot", "ch_ix", "t", "value", F.lit(0).alias("grid")).unionByName(wanted.select("shot", "ch_ix", "t", F.lit(None).cast("double").alias("value"), F.lit(1).alias("grid")))
    at = F.when(F.col("grid") == 0, F.struct("t", "value"))
    near = blocks.neighbours(both, ("shot", "ch_ix"), "t", "grid", at).where("grid = 1")
    share = (F.col("t") - F.col("lo.t")) / (F.col("hi.t") - F.col("lo.t"))
    between = F.when(F.col("hi.t") > F.col("lo.t"), F.col("lo.value") + share * (F.col("hi.value") - F.col("lo.value")))
    return near.select("shot", "ch_ix", "t", F.coalesce(between, F.col("lo.value"), F.col("hi.value")).alias("value"))


def multichannel(channels: DataFrame, tolerance: float = 5e-7, interpolate: bool = True) -> DataFrame:
    """Channels on the time base of each shot's first channel.

    Channels whose times differ from it by no more than ``tolerance`` keep their values; the
    others are interpolated, or are an error if ``interpolate`` is false.
    """
    rows = blocks.beside(channels, channels.groupBy("shot").agg(F.min("ch_ix").alias("__first")), "shot")
    base = rows.where(F.col("ch_ix") == F.col("__first")).select("shot", "sample_ix", F.col("t").alias("__t"))
    met = rows.join(base, ["shot", "sample_ix"], "left")
    off = met.groupBy("shot", "ch_ix").agg(F.max(F.coalesce(F.abs(F.col("t") - F.col("__t")), F.lit(1.0))).alias("off"))
    bad = written(off.where(F.col("off") > tolerance).select("shot", "ch_ix"))
    columns = ("shot", "ch_ix", F.col("__t").alias("t"), "value")
    if bad.isEmpty():
        return met.select(*columns)
    if not interpolate:
        raise ValueError("time bases of the channels differ")
    same = met.join(bad, ["shot", "ch_ix"], "left_anti").select(*columns)
    moved = change_time_base(rows.drop("__first").join(bad, ["shot", "ch_ix"], "left_semi"), base.select("shot", F.col("__t").alias("t")))
    return same.unionByName(moved.select(*same.columns))


def nearest(points: DataFrame, cells: DataFrame, key: str, at: str, to: str) -> DataFrame:
    """For every point the cell of the same key with ``to`` nearest to the point's ``at``; the first of equals.

    Points and cells are merged by value, range by range; the nearest cell is the last before or
    the first after. Returns the points' columns and ``to``.
    """
    own = points.columns
    packed = points.select(F.col(key), F.col(at).alias("__x"), F.struct(*own).alias("__p"), F.lit(1).alias("__q"))
    seen = cells.select(F.col(key), F.col(to).cast("double").alias("__x")).distinct().withColumn("__q", F.lit(0))
    both = packed.unionByName(seen, allowMissingColumns=True)
    cell = F.when(F.col("__q") == 0, F.col("__x"))
    met = blocks.neighbours(both, (key,), "__x", "__q", cell).where("__q = 1").withColumnsRenamed({"lo": "__lo", "hi": "__hi"})
    best = F.when(F.col("__hi").isNull() | (F.col("__x") - F.col("__lo") <= F.col("__hi") - F.col("__x")), F.col("__lo")).otherwise(F.col("__hi"))
    return met.withColumn(to if to not in own else f"{to}_nearest", best).select("__p.*", to if to not in own else f"{to}_nearest")


def align_segments(first: DataFrame, second: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Segments of two arrays by shot and number, with a flag that says whether their start times agree."""
    a = first.select("shot", "seg_ix", F.col("t0").alias("t0_first"))
    b = second.select("shot", "seg_ix", F.col("t0").alias("t0_second"))
    return a.join(b, ["shot", "seg_ix"]).withColumn("aligned", F.abs(F.col("t0_first") - F.col("t0_second")) <= tolerance + 1e-5 * F.abs("t0_second"))


def band_matches(left: DataFrame, right: DataFrame, time_width: float, freq_width: float) -> DataFrame:
    """Pairs (l_id, r_id) of equal shot with times and frequencies closer than the widths.

    Times are put into buckets as wide as the band; a right row stands in its own and both
    neighbouring buckets, so that the join is an equi-join on shot and bucket.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(time_width)).cast("long")
    a = left.select("shot", F.col("id").alias("l_id"), F.col("time").alias("l_time"), F.col("freq").alias("l_freq"), bucket("time").alias("bucket"))
    b = right.select("shot", F.col("id").alias("r_id"), F.col("time").alias("r_time"), F.col("freq").alias("r_freq"), F.explode(F.array(bucket("time") - 1, bucket("time"), bucket("time") + 1)).alias("bucket"))
    near = (F.abs(F.col("l_time") - F.col("r_time")) < time_width) & (F.abs(F.col("l_freq") - F.col("r_freq")) < freq_width)
    return a.join(b, ["shot", "bucket"]).where(near).select("shot", "l_id", "r_id")


def combine_features(left: DataFrame, right: DataFrame, time_width: float = 0.5e-6, freq_width: float = 0.1) -> DataFrame:
    """The right feature set with the left one merged in, on their common columns.

    A left row that meets exactly one right row replaces it; a left row that meets none or
    several is appended. If several left rows meet one right row alone, the one with the
    largest id replaces it.
    """
    pairs = band_matches(left, right, time_width, freq_width)
    single = pairs.groupBy("l_id").agg(F.count(F.lit(1)).alias("n"), F.min("r_id").alias("r_id")).where("n = 1")
    winner = single.groupBy("r_id").agg(F.max("l_id").alias("l_id"))
    shared = [c for c in right.columns if c in left.columns and c != "id"]
    fresh = left.select(F.col("id").alias("l_id"), F.struct(*shared).alias("__new")).join(winner, "l_id")
    kept = right.join(fresh.select(F.col("r_id").alias("id"), "__new"), "id", "left")
    replaced = kept.select("id", F.when(F.col("__new").isNull(), "right").otherwise("both").alias("origin"), *[F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) for c in shared])
    appended = left.join(single.select(F.col("l_id").alias("id")), "id", "left_anti").select("id", F.lit("left").alias("origin"), *shared)
    return replaced.unionByName(appended)


def nearest_index(values: Column, to: Column) -> Column:
    """Index (from 0) of the element of an array nearest to a number; the first of equals."""
    off = F.transform(values, lambda x: F.abs(x - to))
    return (F.array_position(off, F.array_min(off)) - 1).cast("int")
