"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that this process has named for intermediate tables, in order.
MADE: list[str] = []
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes Spark's fast ``lower``; the rest is mapped letter by letter."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors both reach.

    It lies in ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary
    folder and a cluster gets a folder in the warehouse.
    """
    conf = spark.sparkContext.getConf()
    top = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not top:
        local = conf.get("spark.master", "local").split("[")[0] == "local"
        top = tempfile.mkdtemp(prefix="tideline-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/.tideline"
    MADE.append(f"{top.rstrip('/')}/tideline-{uuid.uuid4().hex}")
    return MADE[-1]


def discard(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Removes the intermediate tables from the ``since``-th on, but ``keep``; what is still to be read from them is lost."""
    for path in [p for p in MADE[since:] if p != keep]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        MADE.remove(path)


def stored(df: DataFrame) -> DataFrame:
    """The same rows read back from Parquet in the shared folder; this cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column's values as UTF-8 bytes; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]
