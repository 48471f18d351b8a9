"""Pages that are nested deeply or left open, rows that repeat, and columns with clashing names."""

from __future__ import annotations

import random
import time
import tracemalloc
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tideline.llm import html_extract, secrets, substring

PAGES = {
    "nested": "<div>" * 100_000 + "x",
    "named": "".join(f'<div class="c{i}">' for i in range(30_000)) + "word " * 50,
    "quotes": "<b \"'" * 150_000,
    "last quote": "<b " * 150_000 + '"',
    "raw": "<script " * 60_000 + '"',
    "closing": "<i>" * 50_000 + "<b>" + "</u></b>" * 40_000,
    "across sections": "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000,
    "signs": "<" * 300_000,
    "comments": "<!--" * 150_000,
    "paragraphs": "<p>a" * 100_000,
    "words": "word " * 150_000,
}


@pytest.mark.parametrize("name", PAGES)
def test_long_odd_pages_take_time_and_memory_in_proportion(name):
    page = PAGES[name]
    began = time.time()
    html_extract.extract(page, html_extract.Weights())
    html_extract.evidence(*html_extract.pieces(page))
    assert time.time() - began < 30
    tracemalloc.start()
    html_extract.extract(page[:20_000], html_extract.Weights())
    assert tracemalloc.get_traced_memory()[1] < 40_000_000
    tracemalloc.stop()


def plain_tag_end(page: str, p: int) -> int | None:
    while p < len(page):
        if page[p] == ">":
            return p + 1
        if page[p] in "\"'":
            p = page.find(page[p], p + 1)
            if p < 0:
                return None
        p += 1
    return len(page)


def test_ends_of_tags_are_those_of_a_plain_search():
    rng = random.Random(1)
    for _ in range(3000):
        page = "".join(rng.choice("<b \"'>x") for _ in range(rng.randrange(60)))
        tags = html_extract.Tags(page)
        for p in range(len(page)):
            assert tags.end(p) == plain_tag_end(page, p), (page, p)


def plain_evidence(parsed):
    """Counts from the whole chain of each piece."""
    out = Counter()

    def around(node):
        return set() if node is None else set(node.own) | around(node.parent)

    chains = [around(p.node) for p in parsed]
    if not any(html_extract.MAIN & c for c in chains):
        return out
    for p, c in zip(parsed, chains, strict=True):
        inside = bool(html_extract.MAIN & c) and not any(map(html_extract.aside, c))
        if p.tag:
            out["cost:" + p.tag, inside] += 1
        elif n := len(p.words.split()):
            out["words", inside] += n
            for f in c:
                out[f, inside] += n
    return out


def test_evidence_and_weights_follow_the_chains():
    rng = random.Random(2)
    for _ in range(400):
        page = "".join(rng.choice(['<div class="a b">', '<div class="nav">', "<article>", "<p>", "</p>", "</div>", "</article>", "<i>", "</i>", "<br>", "some words ", "x", "<ul><li>", "</ul>"]) for _ in range(rng.randrange(40)))
        parsed, nodes = html_extract.pieces(page)
        assert +html_extract.evidence(parsed, nodes) == +plain_evidence(parsed)
        w = html_extract.Weights({"tag:article": 1.5, "part:a": -0.7, "part:b": 0.2, "part:nav": -3.0, "tag:p": 0.3, "tag:i": -0.1})
        _, keeps = html_extract.word_weights(nodes, w)
        for node in nodes:
            total, share, at = html_extract.PLAIN, 1.0, node
            while at is not None:
                odds = sum(w.feature.get(f, 0.0) for f in at.own if f.startswith("part:") or f in html_extract.MAIN or html_extract.aside(f))
                if odds:
                    total += share * max(-html_extract.CONTAINER, min(html_extract.CONTAINER, odds))
                    share /= 2
                at = at.parent
            assert keeps[node.place] == pytest.approx(total)


def test_clashing_columns(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = pages.withColumns({"__id": F.lit(1), "page": F.lit("x"), "text": F.lit("y"), "picked": F.lit(2)})
    assert html_extract.train(odd) == html_extract.train(pages)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clash = docs.withColumns({"__id": F.lit(1), "own": F.lit("x"), "picked": F.lit(2), "base": F.lit(3)})
    assert secrets.learnt(clash) == secrets.learnt(docs)


def test_many_repeats_of_a_row(spark):
    rng = random.Random(3)
    passage = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    docs = {1: "start " + passage, 2: passage + " end " + " ".join(f"v{i}" for i in range(80)), 3: "other " * 10 + passage}
    rows = [(i, t) for i, t in docs.items() for _ in range(5000 if i == 2 else 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    began = time.time()
    got = substring.dedup(df).drop("kept").groupBy("doc_id", "n_words", "n_removed", "kept_sha256").count().collect()
    assert time.time() - began < 90
    want = brute.window_dedup(docs)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want
    assert {r["doc_id"]: r["count"] for r in got} == {1: 3, 2: 5000, 3: 3}


def test_raw_elements_and_open_tags():
    texts = [w for w, tag, _, _ in html_extract.tokens("a<script>x < y</script >b<b class='c>d'>e<i f=\"g>h") if not tag]
    assert texts == ["a", "b", "e", "<", 'i f="g>h']
    assert [w for w, *_ in html_extract.tokens("<?php x ?>y<!-- z")] == ["y"]


def test_intermediate_tables_can_be_discarded(spark, tmp_path):
    import os

    from tideline.llm import common

    begin = len(common.MADE)
    common.stored(spark.range(3))
    second = common.stored(spark.range(5))
    paths = common.MADE[begin:]
    common.discard(spark, begin, paths[1])
    assert common.MADE[begin:] == paths[1:] and not os.path.exists(paths[0]) and second.count() == 5
    common.discard(spark, begin)
    assert len(common.MADE) == begin and not os.path.exists(paths[1])
