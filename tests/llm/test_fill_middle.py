"""Fill-in-middle transformation against a plain version, and odd texts."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc

import duckdb
import pytest

from tests.compare import same
from tideline.llm import fill_middle, queries


def plain_version(text: str, doc_id: int, units: list[tuple[int, int]]) -> tuple:
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = [0, *(end for _, end in units)]
    pre, mid, suf = text[: at[a]], text[at[a] : at[b]], text[at[b] :]
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def made_texts() -> dict[int, str | None]:
    rng = random.Random(5)
    parts = ["a", "é", "漢", "😀", "\n", " ", "<", "P>", "<S", ">", "<M", "<P", "\x00", "word", "\r\n"]
    docs: dict[int, str | None] = {i: "".join(rng.choice(parts) for _ in range(rng.randrange(30))) for i in range(600)}
    docs |= {1000: None, 1001: "", 1002: "x", 1003: "<P>", 1004: "<<P><S", 1005: "long é\n" * 200_000}
    return docs


@pytest.mark.parametrize("unit", [fill_middle.CODE_POINT, r"\S+", r"[^\n]*\n", r"b"])
def test_same_as_a_list_of_units(spark, unit):
    docs = made_texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], "doc_id long, text string, form string, n int").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in fill_middle.transform(df, unit=unit, slice_bytes=1000).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        text = t or ""
        assert got[i] == plain_version(text, i, [m.span() for m in re.finditer(unit, text)])


def test_outputs_give_back_the_texts(spark):
    docs = made_texts()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    out = fill_middle.transform(df)
    rows = out.select("doc_id", "form", fill_middle.restored(out["output"], out["form"]).alias("back")).collect()
    assert {r["doc_id"]: r["back"] for r in rows} == {i: t or "" for i, t in docs.items()}
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_query_equals_its_sql(spark, tmp_path):
    df = spark.createDataFrame(list(made_texts().items()), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert same(queries.op13_fill_middle(spark, str(tmp_path)).toPandas(), con.execute(queries.ORACLES["op13_fill_middle"]).df()) == ""


def test_null_and_repeated_ids_empty_table_and_odd_bytes(spark):
    rows = [(None, "abc"), (None, "abc"), (7, "defgh"), (7, "defgh"), (7, "other"), (8, None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, output string")
    got = fill_middle.transform(df).collect()
    assert len(got) == len(rows) and len(set(got)) == 4
    assert fill_middle.transform(df.where("false")).collect() == []
    odd = spark.sql("SELECT 3L AS doc_id, cast(unhex('61FF62C3') AS string) AS text")
    back = fill_middle.transform(odd)
    assert back.select(fill_middle.restored(back["output"], back["form"]).alias("b")).first()["b"] == "a\ufffdb\ufffd"


def test_no_list_of_units_is_held():
    text = "ab" * 2_000_000
    unit = re.compile(fill_middle.CODE_POINT)
    tracemalloc.start()
    n = fill_middle.counted(unit, text)
    cut = fill_middle.ends(unit, text, n // 3, n - 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4_000_000 and cut == (n // 3, n - 1) and peak < 100_000
