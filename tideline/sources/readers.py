"""Recorder files and archives as data sources of Spark: one partition for each file, and predicates on shots choose the files.

``register(spark)`` makes ``spark.read.format("recorder").load(folder)`` possible, and turns on the
session's spark.sql.python.filterPushdown.enabled, which the readers need to leave files out by
predicates on shot, diag and channel. Files are reached through their file system's URI, so that a
folder need not be local.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tideline.sources.files import decode, parameters, sample_rate

#: Samples in one batch.
SLICE = 1 << 18

# How one diagnostic's channels are stored in shots before its move.
MOVED_DIAG, MOVED_TO, MOVED_BEFORE, MOVED_BY, ONE_MORE_BEFORE = "FMD", "SX8O", 72380, 33, 26208


def stored_as(diag: str, channel: int, shot: int) -> tuple[str, int]:
    """The diagnostic and channel under which a channel's file is named in a shot."""
    if diag != MOVED_DIAG or shot >= MOVED_BEFORE:
        return diag, channel
    return MOVED_TO, channel + MOVED_BY + (shot < ONE_MORE_BEFORE) if channel else channel


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


TESTS = {EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x}


@dataclass
class File(InputPartition):
    path: str
    values: dict

    def __init__(self, path: str, values: dict):
        self.path, self.values = path, values


class FilesReader(DataSourceReader):
    """A partition for each file whose name fits; predicates on what the name says leave files out."""

    pattern = ""
    kinds: dict = {}

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.gain = float(options.get("gain", 1.0))
        self.centred = options.get("centred", "false").lower() == "true"
        self.chosen: list[tuple[str, object, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in self.kinds:
                self.chosen.append((f.attribute[0], TESTS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[File]:
        system, folder = opened(self.folder)
        out = []
        for info in system.get_file_info(fs.FileSelector(folder)):
            m = re.fullmatch(self.pattern, info.base_name)
            if m:
                values = {k: kind(m[k]) for k, kind in self.kinds.items()}
                if all(test(values[k], wanted) for k, test, wanted in self.chosen):
                    out.append(File(info.base_name, values))
        return sorted(out, key=lambda f: f.path)

    def content(self, name: str) -> bytes:
        system, folder = opened(self.folder)
        with system.open_input_stream(f"{folder}/{name}") as f:
            return f.read()

    def batches(self, values: dict, t: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(x), SLICE):
            n = len(x[a : a + SLICE])
            same = [pa.array([values[k]] * n, pa.string() if kind is str else pa.int64()) for k, kind in self.kinds.items()]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(a, a + n)), pa.array(t[a : a + n]), pa.array(x[a : a + n])], names=[*self.kinds, "sample_ix", "t", "value"])


class RecorderReader(FilesReader):
    pattern = r"(?P<diag>.+)-(?P<shot>\d+)-1-(?P<channel>\d+)\.prm"
    kinds = {"diag": str, "shot": int, "channel": int}

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        p = parameters(self.content(partition.path).decode())
        x = decode(self.content(partition.path[:-4] + ".dat"), p, self.gain, self.centred)
        yield from self.batches(partition.values, np.arange(len(x)) / sample_rate(p), x)


class RecorderWriter(DataSourceArrowWriter):
    """Writes 16-bit samples (diag, shot, channel, sample_ix, value), sorted by these, as pairs of files; the option rate gives the clock."""

    def __init__(self, options: dict):
        self.folder, self.rate = options["path"], float(options.get("rate", 1.0))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        held: dict[tuple, list[np.ndarray]] = {}
        for b in iterator:
            value = b["value"].to_numpy().astype("<i2")
            keys = list(zip(*(b[c].to_pylist() for c in ("diag", "shot", "channel")), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if z > a:
                    for key in [k for k in held if k != keys[a]]:
                        self.one(key, held.pop(key))
                    held.setdefault(keys[a], []).append(value[a:z])
        for key, parts in held.items():
            self.one(key, parts)
        return WriterCommitMessage()

    def one(self, key: tuple, parts: list[np.ndarray]) -> None:
        system, folder = opened(self.folder)
        raw = np.concatenate(parts).tobytes()
        system.create_dir(folder, recursive=True)
        facts = {"DataLength(byte)": len(raw), "Resolution(bit)": 16, "ImageType": "INT16", "BinaryCoding": "shifted_2's_complementary", "SamplingClock": self.rate}
        for kind, content in (("dat", raw), ("prm", "".join(f"{key[0]},{k},{v}\n" for k, v in facts.items()).encode())):
            with system.open_output_stream(f"{folder}/{key[0]}-{key[1]}-1-{key[2]}.{kind}") as f:
                f.write(content)


class Recorder(DataSource):
    """Pairs of .prm and .dat files named <diag>-<shot>-1-<channel>; options gain and centred. A pair is written again if its task is."""

    @classmethod
    def name(cls) -> str:
        return "recorder"

    def schema(self) -> str:
        return "diag string, shot long, channel long, sample_ix long, t double, value double"

    def reader(self, schema) -> DataSourceReader:
        return RecorderReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RecorderWriter(dict(self.options))


class ArchiveReader(FilesReader):
    pattern = r"(?P<shot>\d+)_(?P<channel>.+)\.npz"
    kinds = {"shot": int, "channel": str}

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        with np.load(io.BytesIO(self.content(partition.path)), allow_pickle=False) as members:
            if not {"signal", "timebase"} <= set(members.files):
                raise ValueError(f"{partition.path} has no signal and timebase but {sorted(members.files)}")
            yield from self.batches(partition.values, members["timebase"].astype(float).ravel(), members["signal"].astype(float).ravel() * self.gain)


class ArchiveWriter(DataSourceArrowWriter):
    """Writes samples (shot, channel, sample_ix, t, value), sorted by these, as archives."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = opened(self.folder)
        system.create_dir(folder, recursive=True)
        table = pa.Table.from_batches(list(iterator)).to_pandas()
        for (shot, channel), own in table.groupby(["shot", "channel"]):
            kept = io.BytesIO()
            np.savez(kept, signal=own["value"].to_numpy(), timebase=own["t"].to_numpy())
            with system.open_output_stream(f"{folder}/{shot}_{channel}.npz") as f:
                f.write(kept.getvalue())
        return WriterCommitMessage()


class Archive(DataSource):
    """Archives named <shot>_<channel>.npz with the members signal and timebase; nothing stored in them is evaluated. A task writes what it holds of its channels at once."""

    @classmethod
    def name(cls) -> str:
        return "signal_archive"

    def schema(self) -> str:
        return "shot long, channel string, sample_ix long, t double, value double"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Recorder, Archive):
        spark.dataSource.register(source)


def fetch(spark: SparkSession, folder: str, shots: list[int], diag: str, channel: int, **options: str) -> DataFrame:
    """Samples of one channel of several shots, wherever its files stood at the time."""
    register(spark)
    rows = spark.read.format("recorder").options(**options).load(folder)
    wanted = spark.createDataFrame([(s, *stored_as(diag, channel, s)) for s in shots], "shot long, diag string, channel long")
    named = rows.where(F.col("shot").isin(shots)).join(F.broadcast(wanted), ["shot", "diag", "channel"], "left_semi")
    return named.select("shot", F.lit(diag).alias("diag"), F.lit(channel).alias("ch_ix"), "sample_ix", "t", "value")
