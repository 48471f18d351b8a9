"""Readers of delimited text, binary recorder files and web signals, and what is written and read back."""

from __future__ import annotations

import io
import json
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.registry import source

#: Folders that this process has named, in order.
MADE: list[str] = []
RECORDED = "name string, sample_ix long, t double, value double"


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one. Where there is none, a local master gets a temporary one and a cluster one in the warehouse."""
    conf = spark.sparkContext.getConf()
    top = conf.get("spark.checkpoint.dir")
    if not top:
        top = tempfile.mkdtemp() if conf.get("spark.master", "local").split("[")[0] == "local" else spark.conf.get("spark.sql.warehouse.dir")
    MADE.append(f"{top.rstrip('/')}/saved-{uuid.uuid4().hex}")
    return MADE[-1]


def discard(spark: SparkSession, since: int = 0) -> None:
    """Removes the folders named from the ``since``-th on; what is still to be read from them is lost."""
    for path in MADE[since:]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del MADE[since:]


def written(rows: DataFrame) -> DataFrame:
    """The same rows read back from the shared folder, for what is read in every iteration."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@source
def dsv(spark: SparkSession, path: str, shot: int, delimiter: str | None = None, comment: str = "#") -> DataFrame:
    """Delimited text: time, then one column for each channel, named channel_000 and so on.

    ``(shot)`` in the path stands for the shot number. Without a delimiter columns are parted by
    white space. Lines that begin with the comment sign, and what follows it, are left out.
    Lines are numbered by their time within the file.
    """
    from pyspark.sql import Window

    lines = spark.read.text(path.replace("(shot)", str(shot))).select(F.trim(F.substring_index("value", comment, 1)).alias("line"), "_metadata.file_path").where("line <> ''")
    parts = F.split("line", r"\s+" if delimiter is None else "\\Q" + delimiter + "\\E")
    numbers = F.transform(parts, lambda x: F.trim(x).try_cast("double"))  # what is no number is null
    rows = lines.select("file_path", numbers.alias("x")).select("file_path", F.get("x", F.lit(0)).alias("t"), F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0))).alias("x"))
    numbered = rows.withColumn("sample_ix", (F.row_number().over(Window.partitionBy("file_path").orderBy("t")) - 1).cast("long"))
    each = numbered.select("sample_ix", "t", F.posexplode("x").alias("ch_ix", "value"))
    return each.select(F.lit(shot).cast("long").alias("shot"), F.lit("dsv").alias("diag"), "ch_ix", "sample_ix", "t", "value", F.format_string("channel_%03d", "ch_ix").alias("channel"))


def parameters(text: str) -> dict[str, list[str]]:
    """Key and values of the lines ``x,key,value,...`` of a recorder's parameter file."""
    rows = (line.strip().split(",") for line in text.splitlines())
    return {r[1]: r[2:] for r in rows if len(r) > 1}


def sample_rate(p: dict[str, list[str]]) -> float:
    if "ClockSpeed" in p:
        return float(p["ClockSpeed"][0])
    if "SamplingClock" in p:
        return float(p["SamplingClock"][0]) / float(p.get("SamplingInterval", ["1"])[0])
    raise ValueError("the parameter file has no clock")


def decode(raw: bytes, p: dict[str, list[str]], gain: float = 1.0, centred: bool = False) -> np.ndarray:
    """Samples of a recorder file: unsigned offset binary, or two's complement if the parameters say so.

    ``centred`` takes off the offset of offset binary.
    """
    n = int(p["DataLength(byte)"][0]) // 2
    coding = p.get("BinaryCoding", ["offset_binary"])[0] if "ImageType" in p else "offset_binary"
    if "ImageType" in p and p["ImageType"][0] != "INT16":
        raise ValueError(f"unknown image type {p['ImageType'][0]}")
    if coding not in ("offset_binary", "shifted_2's_complementary"):
        raise ValueError(f"unknown binary coding {coding}")
    x = np.frombuffer(raw, "<u2" if coding == "offset_binary" else "<i2", count=n).astype(float)
    offset = 2.0 ** (int(p["Resolution(bit)"][0]) - 1) if coding == "offset_binary" and centred else 0.0
    return gain * (x - offset)


@source
def recorder(spark: SparkSession, folder: str, gain: float = 1.0, centred: bool = False) -> DataFrame:
    """All pairs of .prm and .dat files of a folder: name, sample_ix, t, value. A file is one row and is decoded where it is read."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)\.(prm|dat)$", 1).alias("name"), F.regexp_extract("path", r"\.(prm|dat)$", 1).alias("kind"), "content")
    pairs = files.where("kind <> ''").groupBy("name").pivot("kind", ["prm", "dat"]).agg(F.first("content"))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                p = parameters(bytes(r.prm).decode())
                x = decode(bytes(r.dat), p, gain, centred)
                yield pd.DataFrame({"name": r.name, "sample_ix": np.arange(len(x)), "t": np.arange(len(x)) / sample_rate(p), "value": x})

    return pairs.select("name", "prm", "dat").where("prm IS NOT NULL AND dat IS NOT NULL").mapInPandas(run, RECORDED)


#: Channels that are recorded with the opposite sign.
FLIPPED = ("MP5", "HMP13", "HMP05")


def flip_sign(samples: DataFrame, channel: str = "channel") -> DataFrame:
    """Values of the flipped channels negated; a leading minus in the name negates once more."""
    name = F.regexp_replace(channel, ".*-", "")
    sign = F.when(name.isin(*FLIPPED), -1.0).otherwise(1.0) * F.when(F.col(channel).startswith("-"), -1.0).otherwise(1.0)
    return samples.withColumn("value", F.col("value") * sign)


@source
def archive(spark: SparkSession, folder: str, shot: int, channel: str) -> DataFrame:
    """The channel of a shot from ``<shot>_<channel>.npz``, with the members signal and timebase; flipped channels are negated.

    What stands before the last minus of the channel's name is no part of the file's name. Archives
    that hold expressions instead of samples are an error: nothing stored in a file is evaluated.
    """

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as members:
                    if not {"signal", "timebase"} <= set(members.files):
                        raise ValueError(f"the archive has no signal and timebase but {sorted(members.files)}")
                    x, t = members["signal"].astype(float).ravel(), members["timebase"].astype(float).ravel()
                yield pd.DataFrame({"sample_ix": np.arange(len(x)), "t": t, "value": x})

    found = spark.read.format("binaryFile").load(f"{folder}/{shot}_{channel.split('-')[-1]}.npz").select("content").mapInPandas(run, "sample_ix long, t double, value double")
    named = found.select(F.lit(shot).cast("long").alias("shot"), F.lit("archive").alias("diag"), F.lit(0).alias("ch_ix"), "sample_ix", "t", "value", F.lit(channel).alias("channel"))
    return flip_sign(named)


@source
def web_signals(payloads: DataFrame) -> DataFrame:
    """Signals fetched from the web service: name, sample_ix, t, value.

    ``payloads`` has name, content (little-endian signed 16-bit samples) and the headers'
    signal_min, signal_delta, dim_t0 and dim_delta.
    """

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                x = np.frombuffer(bytes(r.content), "<i2")
                yield pd.DataFrame({"name": r.name, "sample_ix": np.arange(len(x)), "t": r.dim_t0 + r.dim_delta * np.arange(len(x)), "value": r.signal_min + r.signal_delta * x})

    return payloads.select("name", "content", "signal_min", "signal_delta", "dim_t0", "dim_delta").mapInPandas(run, RECORDED)


def web_headers(replies: DataFrame, xml: str = "xml") -> DataFrame:
    """Replies with signal_min, signal_delta, dim_t0 and dim_delta read from their XML header, in place of it."""
    values = [F.call_function("xpath_double", F.col(xml), F.lit(f"//{n}")).alias(n) for n in ("signal_min", "signal_delta", "dim_t0", "dim_delta")]
    return replies.select(*[c for c in replies.columns if c != xml], *values)


def with_query(url, query: str):
    """A URL with one more query parameter, before its fragment."""
    base, fragment = F.substring_index(url, "#", 1), F.regexp_extract(url, "(#.*)?$", 1)
    return F.concat(base, F.when(F.instr(base, "?") == 0, F.lit("?")).when(base.endswith("?"), F.lit("")).otherwise(F.lit("&")), F.lit(query), fragment)


def save_features(path: str, features: DataFrame, assignments: DataFrame, clusters: DataFrame, settings: dict) -> None:
    """Features, assignments and clusters as Parquet tables, and the settings as JSON, under one folder."""
    for name, df in (("features", features), ("assignments", assignments), ("clusters", clusters)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    features.sparkSession.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    lines = spark.read.text(f"{path}/settings").collect()
    if len(lines) != 1:
        raise ValueError(f"{path} holds no saved analysis")
    return (*(spark.read.parquet(f"{path}/{n}") for n in ("features", "assignments", "clusters")), json.loads(lines[0]["value"]))


def list_clusterings(spark: SparkSession, folder: str) -> DataFrame:
    """Settings (saved, name, value) of every clustering that is saved in a folder of its own below ``folder``."""
    saved = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/settings/[^/]*$", 1).alias("saved")
    lines = spark.read.text(f"{folder}/*/settings").select(saved, F.from_json("value", "map<string,string>").alias("settings"))
    return lines.select("saved", F.explode("settings").alias("name", "value"))


def append_objects(rows: DataFrame, path: str) -> None:
    """Rows of persisted objects are appended to their table."""
    rows.write.mode("append").parquet(path)


class Unavailable:
    """A remote source that needs a network and a client library. Its interface is the same; fetching is an error."""

    def __init__(self, kind: str):
        self.kind = kind

    def __call__(self, spark: SparkSession, shot: int, path: str, **options) -> DataFrame:
        raise NotImplementedError(f"{self.kind} needs a remote server; register a source of the same signature that returns samples")


for _kind in ("tree_path", "thin_client", "tree_http", "point_names"):
    source(type(_kind, (Unavailable,), {"__name__": _kind})(_kind))
