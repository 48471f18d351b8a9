"""Signals and features derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.registry import source

EPOCH = 1_704_067_200  # 2024-01-01, in seconds
DAILY_CHANNELS = ("A", "N", "R")
EVENT_CHANNELS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    """Money as whole cents, so that sums do not depend on their order."""
    return F.round(F.col(column) * 100).cast("long")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price of each return flag (channel); a year is a shot; days without a row of a flag count 0."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin(*DAILY_CHANNELS)).select(
        F.year("l_shipdate").cast("long").alias("shot"),
        (F.array_position(F.array(*map(F.lit, DAILY_CHANNELS)), F.col("l_returnflag")) - 1).cast("int").alias("ch_ix"),
        (F.dayofyear("l_shipdate") - 1).cast("long").alias("sample_ix"),
        cents("l_extendedprice").alias("c"),
    )
    cells = rows.groupBy("shot", "sample_ix").pivot("ch_ix", [0, 1, 2]).agg(F.sum("c"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("ch_ix"), (F.coalesce(F.col(str(i)), F.lit(0)) / 100.0).alias("value")) for i in range(3)]))
    return cells.select("shot", "sample_ix", each.alias("z")).select("shot", F.lit("price").alias("diag"), "z.ch_ix", "sample_ix", F.col("sample_ix").cast("double").alias("t"), "z.value")


def status_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price of each line status, two channels; a year is a shot; days without a row of a status count 0."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").cast("long").alias("shot"), (F.dayofyear("l_shipdate") - 1).cast("long").alias("sample_ix"), F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("ch_ix"), cents("l_extendedprice").alias("c")
    )
    cells = rows.groupBy("shot", "sample_ix").pivot("ch_ix", [0, 1]).agg(F.sum("c"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("ch_ix"), (F.coalesce(F.col(str(i)), F.lit(0)) / 100.0).alias("value")) for i in range(2)]))
    return cells.select("shot", "sample_ix", each.alias("z")).select("shot", F.lit("status").alias("diag"), "z.ch_ix", "sample_ix", F.col("sample_ix").cast("double").alias("t"), "z.value")


def seconds(column: str):
    """Seconds since 2024-01-01 of a time without zone."""
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6 - EPOCH


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular samples: event types are channels, four groups of users are shots."""
    rows = table(spark, sf_dir, "events")
    at = seconds("ts")
    return rows.select(
        (F.col("user_id") % 4).alias("shot"),
        (F.array_position(F.array(*map(F.lit, EVENT_CHANNELS)), F.col("event_type")) - 1).cast("int").alias("ch_ix"),
        "event_id", at.alias("t"), "value",
    )


def event_grid(spark: SparkSession, sf_dir: str, hours: int = 4, by_shot: bool = False) -> DataFrame:
    """Mean value of each event type in even buckets, one shot or one for each group of users; empty buckets count 0."""
    bucket = F.floor(F.col("t") / (hours * 3600)).cast("long")
    shot = F.col("shot") if by_shot else F.lit(1).cast("long")
    cells = event_samples(spark, sf_dir).groupBy(shot.alias("shot"), bucket.alias("sample_ix")).pivot("ch_ix", [0, 1, 2, 3, 4]).agg(F.sum(F.round(F.col("value") * 100).cast("long")) / F.count(F.lit(1)) / 100.0)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("ch_ix"), F.coalesce(F.col(str(i)), F.lit(0.0)).alias("value")) for i in range(5)]))
    return cells.select("shot", "sample_ix", each.alias("z")).select("shot", F.lit("events").alias("diag"), "z.ch_ix", "sample_ix", F.col("sample_ix").cast("double").alias("t"), "z.value")


@source
def table_channel(spark: SparkSession, shot: int, path: str, channel: int) -> DataFrame:
    """One channel of the even event signal in a folder of tables, as the catalogue's source. What is fetched is kept in the shared folder."""
    from tideline.sources.files import written

    return written(event_grid(spark, path).where(F.col("ch_ix") == channel).withColumn("shot", F.lit(shot).cast("long")))


def features(spark: SparkSession, sf_dir: str, dims: int = 8) -> DataFrame:
    """Vectors as complex channel amplitudes: phases, amplitudes, a time, a frequency and the reference cluster."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.struct(F.get("e", 2 * i).alias("re"), F.get("e", 2 * i + 1).alias("im")))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("instance_id"), e.alias("e"), F.col("label").alias("cluster"))
    return rows.select(
        "instance_id", (F.col("instance_id") % 5).alias("shot"), (F.col("instance_id") * 0.001).alias("time"), (F.abs(F.get("e", F.lit(20))) * 1000).alias("freq"),
        F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.atan2(F.get("e", 2 * i + 1), F.get("e", 2 * i))).alias("phases"), pairs.alias("amp"), "cluster",
    )


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the feature shots: two currents, their ratio and a heating frequency."""
    rows = table(spark, sf_dir, "supplier")
    return rows.select((F.col("s_suppkey")).alias("shot"), (F.col("s_suppkey") * 2.0 + 1).alias("main_current"), (F.col("s_suppkey") + 0.5).alias("sec_current"), (F.col("s_suppkey") * 7.0).alias("heating_freq"))
