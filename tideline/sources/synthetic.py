"""Generated signals."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.registry import source


def timebase(spark: SparkSession, n: int = 10_000, rate: float = 1e6, t0: float = 0.0) -> DataFrame:
    """sample_ix and t = t0 + sample_ix / rate; dividing keeps long bases free of drift."""
    return spark.range(n).select(F.col("id").alias("sample_ix"), (F.col("id") / rate + t0).alias("t"))


@source
def sine(spark: SparkSession, shot: int = 0, amplitude: float = 1.0, freq: float = 1000.0, n: int = 10_000, rate: float = 1e6, t0: float = 0.0, ch_ix: int = 0, diag: str = "sine") -> DataFrame:
    base = timebase(spark, n, rate, t0)
    return base.select(F.lit(shot).cast("long").alias("shot"), F.lit(diag).alias("diag"), F.lit(ch_ix).alias("ch_ix"), "sample_ix", "t", (amplitude * F.sin(2 * math.pi * freq * F.col("t"))).alias("value"))


def sine_at(times: DataFrame, amplitude: float = 1.0, freq: float = 1000.0) -> DataFrame:
    """The sine at the times t of given rows, as their value."""
    return times.withColumn("value", amplitude * F.sin(2 * math.pi * freq * F.col("t")))


@dataclass(frozen=True)
class Mode:
    amp: float
    freq: float
    number: int
    phase: float


# The modes of the test signals.
MODES = (Mode(0.7, 24e3, 3, 0.2), Mode(0.5, 37e3, 4, 0.3), Mode(0.5, 27e3, 2, 0.1), Mode(0.7, 24e3, 7, 3.2), Mode(1.0, 37e3, 9, 1.3))


def modes_at(rows: DataFrame, modes: tuple[Mode, ...], channels: int) -> DataFrame:
    """Rotating modes at the times t of given rows, as channel ch_ix of equally spaced ``channels`` sees them, as their value."""
    theta = F.col("ch_ix") * (2 * math.pi / channels)
    return rows.withColumn("value", sum((m.amp * F.cos(2 * math.pi * m.freq * F.col("t") + m.number * theta + m.phase) for m in modes), F.lit(0.0)))


@source
def multimode(spark: SparkSession, modes: tuple[Mode, ...] = MODES[:2], channels: int = 10, n: int = 1024, rate: float = 1e6, noise: float = 0.0, seed: int = 0, shot: int = 0, diag: str = "modes") -> DataFrame:
    """Sums of rotating modes on equally spaced channels, with uniform noise that depends on seed, channel and sample only."""
    rows = modes_at(timebase(spark, n, rate).withColumn("ch_ix", F.explode(F.sequence(F.lit(0), F.lit(channels - 1)))), modes, channels)
    u = F.pmod(F.xxhash64(F.lit(seed), "ch_ix", "sample_ix"), F.lit(1 << 32)) / float(1 << 31) - 1
    return rows.select(F.lit(shot).cast("long").alias("shot"), F.lit(diag).alias("diag"), "ch_ix", "sample_ix", "t", (F.col("value") + noise * u).alias("value"))


@source
def ramp(spark: SparkSession, channels: int = 1, n: int = 100, shot: int = 0) -> DataFrame:
    """Values that count up, a hundred more for each channel, from -0.5 in hundredths of a second."""
    rows = timebase(spark, n, 100.0, -0.5).withColumn("ch_ix", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    return rows.select(F.lit(shot).cast("long").alias("shot"), F.lit("ramp").alias("diag"), "ch_ix", "sample_ix", "t", (F.col("ch_ix") * 100.0 + F.col("sample_ix")).alias("value"))
