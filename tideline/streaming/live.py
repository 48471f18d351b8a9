"""Extensions for unbounded input: windowed energies, sessions and running peaks of streamed samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def timed(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks need times with a zone; times without one are taken in the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def windowed_energy(stream: DataFrame, length: str = "4 hours", slide: str | None = None, lateness: str = "1 hour", time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Count, mean and energy of each key in tumbling or sliding windows; later rows than the watermark are dropped."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    sums = timed(stream, time).withWatermark(time, lateness).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum(F.col(value) * F.col(value)).alias("energy"))
    return sums.select(F.col("w.start").alias("start"), key, "n", "mean", "energy")


def sessions(stream: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Rows of one key that follow each other within the gap."""
    rows = timed(stream, time).withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def running_peak(stream: DataFrame, key: str = "event_type", value: str = "value") -> DataFrame:
    """The largest magnitude seen so far of each key, emitted whenever it grows."""

    def update(k, frames, state):
        most = state.get[0] if state.exists else -1.0
        before = most
        for f in frames:
            most = max(most, float(f[value].abs().max()))
        state.update((most,))
        if most > before:
            yield pd.DataFrame({key: [k[0]], "peak": [most]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} string, peak double", "peak double", "append", GroupStateTimeout.NoTimeout)
