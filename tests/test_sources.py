"""Readers, the catalogue and the streaming extension."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from tideline.operators import interpolate
from tideline.sources import catalog, files, synthetic
from tideline.streaming import live


def test_delimited_text(spark, tmp_path):
    for name, comment, sep in (("a.dat", "# t and channels\n", " "), ("b_(shot).csv", "", ",")):
        body = comment + "".join(sep.join(str(x) for x in (3 + i * 2e-6, *(i * 10 + c for c in range(16)))) + "\n" for i in range(10))
        (tmp_path / name.replace("(shot)", "12345")).write_text(body)
        rows = files.dsv(spark, str(tmp_path / name), 12345, None if sep == " " else ",")
        assert rows.count() == 160 and rows.agg(F.max("ch_ix")).first()[0] == 15
        last = rows.where("ch_ix = 15 AND sample_ix = 9").first()
        assert last["value"] == 105 and last["t"] == pytest.approx(3.000018) and last["channel"] == "channel_015" and last["shot"] == 12345


def test_recorder_files(spark, tmp_path):
    prm = "A,DataLength(byte),8\nA,Resolution(bit),12,2\nA,SamplingClock,1000\nA,SamplingInterval,2\n"
    (tmp_path / "one.prm").write_text(prm)
    (tmp_path / "one.dat").write_bytes(struct.pack("<4H", 2048, 2049, 0, 4095))
    (tmp_path / "two.prm").write_text(prm + "A,ImageType,INT16\nA,BinaryCoding,shifted_2's_complementary\nA,ClockSpeed,10\n")
    (tmp_path / "two.dat").write_bytes(struct.pack("<4h", -1, 0, 1, 2))
    got = {(r["name"], r["sample_ix"]): (r["t"], r["value"]) for r in files.recorder(spark, str(tmp_path), gain=2.0).collect()}
    assert got[("one", 1)] == (0.002, 4098.0) and got[("two", 0)] == (0.0, -2.0) and got[("two", 3)] == (pytest.approx(0.3), 4.0)
    assert files.decode(struct.pack("<1H", 2050), files.parameters("A,DataLength(byte),2\nA,Resolution(bit),12\n"), centred=True).tolist() == [2.0]
    with pytest.raises(ValueError):
        files.decode(b"", files.parameters("A,DataLength(byte),0\nA,Resolution(bit),12\nA,ImageType,INT8\n"))


def test_catalogue_layers_types_and_errors(spark, tmp_path):
    base = "[variabletypes]\nDevice__n = int\n[Device:A]\nacq_name = X\nn = 3\n[Acquisition:X]\nk = v\n"
    found = catalog.Catalog.from_texts(spark, base, "[Device:A]\nn = 5\n")
    assert found.get("Device", "A", "n") == 5 and found.section("Device", "A", n=7)["n"] == 7
    assert found.has("Device", "A", "N") and not found.has("Device", "B")
    assert catalog.device(found, "A")["acquisition"] == {"k": "v"}
    with pytest.raises(LookupError):
        catalog.acquisition(found, "none")
    with pytest.raises(catalog.UnknownVariableTypeError):
        catalog.Catalog.from_texts(spark, "[variabletypes]\nDevice__n = tuple\n[Device:A]\nn = 3\n")
    with pytest.raises(ValueError):
        catalog.Catalog.from_texts(spark)
    (tmp_path / "one.cfg").write_text(base)
    assert catalog.Catalog.from_files(spark, str(tmp_path / "one.cfg")).get("Device", "A", "n") == 3


def test_fetch_needs_a_known_source(spark):
    found = catalog.Catalog.from_texts(spark, "[Diagnostic:a]\ndata_fetcher = none\n[Diagnostic:b]\ndata_fetcher = thin_client\npath = p\n")
    with pytest.raises(LookupError):
        catalog.fetch(spark, found, "a", 1)
    with pytest.raises(NotImplementedError):
        catalog.fetch(spark, found, "b", 1)


def test_different_time_bases_may_be_an_error(spark):
    a, b = synthetic.sine(spark, n=50), synthetic.sine(spark, n=50, t0=1e-5, ch_ix=1)
    both = a.unionByName(b).drop("diag")
    with pytest.raises(ValueError):
        interpolate.multichannel(both, interpolate=False)
    out = interpolate.multichannel(both)
    assert out.count() == 100 and out.where("ch_ix = 1").agg(F.min("t")).first()[0] == 0.0


def test_streams(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").coalesce(2).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    runs = {
        "energy": live.windowed_energy(stream, "4 hours", "2 hours").writeStream.outputMode("complete"),
        "peaks": live.running_peak(stream.select("event_type", "value")).writeStream.outputMode("append"),
    }
    for name, w in runs.items():
        q = w.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    total = spark.read.parquet(f"{sf}/events.parquet").count()
    assert spark.table("energy").agg(F.sum("n")).first()[0] == 2 * total
    want = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.max(F.abs("value"))).collect()}
    assert {r[0]: r[1] for r in spark.table("peaks").groupBy("event_type").agg(F.max("peak")).collect()} == want
