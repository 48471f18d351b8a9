"""Vectors, pages and the pipeline against plain versions, with odd rows."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tests.llm import brute
from tideline.llm import ann, html_extract


def compare(spark, vectors, k=10, **options):
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors.items()], "vec_id long, embedding array<float>, part string").repartition(3)
    exact = {i: [None if x is None else float(x) for x in r] if r is not None else None for i, r in ((r["vec_id"], r["embedding"]) for r in df.collect())}
    want = brute.nearest(exact, [i for i in vectors if i % 100 == 0], k)
    got: dict = {}
    for r in ann.search(df, df.where("vec_id % 100 = 0"), k, **options).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    return want, {q: [x for _, x in sorted(v.items())] for q, v in got.items()}


def test_few_vectors_are_searched_exactly(spark):
    rng = random.Random(3)
    vectors = {i: [rng.gauss(0, 1) for _ in range(8)] for i in range(1, 330)} | {100: [1.0] * 8, 0: [1.0] * 8, 50: [1.0] * 8, 300: [0.0] * 8, 200: None, 51: [float("nan")] * 8, 52: [None] * 8, 53: []}
    want, got = compare(spark, vectors)
    assert got.keys() == want.keys() == {0, 100}
    for q in want:
        assert [x for x, _ in got[q]] == [x for x, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])


def test_many_vectors_are_found(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    vectors = {i: [c + rng.gauss(0, 0.4) for c in centres[i % 20]] for i in range(3000)}
    vectors |= {i: [0.5] * 16 for i in range(3000, 4200)}  # one vector many times
    want, got = compare(spark, vectors, rows_per_part=200, block_rows=256, block_queries=8)
    hits = sum(len({x for x, _ in got[q]} & {x for x, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert got[3100] == [(i, 0.0) for i in range(3000, 3010)]
    assert all(got[q] == sorted(got[q], key=lambda p: (p[1], p[0])) for q in got)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(empty, empty).count() == 0


def test_parts_are_balanced():
    import numpy as np

    x = np.random.default_rng(0).normal(size=(640, 6))
    label = ann.balanced_parts(x, *ann.neighbour_graph(x, 8), 8)
    assert set(np.bincount(label)) == {80}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">One</a></li><li><a>Two words</a></li></ul></nav><!-- ad --><div class="ad">Buy this now please</div>
<article><h1>Head &amp; line</h1><p><b>First   block<br>goes
on</p><div class="ad">Inner advert text</div><p>Second &lt;b&gt; block of many more words that goes on for quite a while before it comes to its end</article>
<div class="sidebar">Read these other things today</div><section id="comments"><p>I like it a lot, says a reader</p></section>
<form>Sign up <input> here</form><footer>&copy; me</footer></body></html>"""


TEXT = "Head & line\n\nFirst block goes on\n\nSecond <b> block of many more words that goes on for quite a while before it comes to its end"


def test_main_text(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    weights = html_extract.train(pages)
    assert html_extract.extract(PAGE, weights) == TEXT
    plain = PAGE.replace('<div class="ad">Inner advert text</div>', '').replace("<article>", "<div class='story'>").replace("</article>", "</div>")
    assert html_extract.extract(plain, weights) == TEXT
    odd = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (None, "u", "<p>", 1), (3, "u", PAGE, 1), (3, "u", PAGE, 1), (4, "u", "<div" + " x" * 10_000, 1)], "page_id long, url string, html string, text int")
    got = [(r["page_id"], r["n_chars"]) for r in html_extract.main_text(odd, weights).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (None, 0), (3, len(TEXT)), (3, len(TEXT)), (4, 0)], key=str)
    empty = pages.limit(0)
    assert html_extract.main_text(empty, html_extract.train(empty)).count() == 0


def test_pages_give_their_article(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    weights = html_extract.train(pages)
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_extract.main_text(pages, weights).collect():
        inside = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", inside))
        assert r["text"] == "\n\n".join(x for x in blocks if x)


def test_best_run():
    assert html_extract.best_run([1, -2, 3, -1, 2, -5, 4]) == (2, 5)
    assert html_extract.best_run([-1, -2]) == (0, 0)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.stored(stage(spark, now, sf))
        kept[name] = {r["doc_id"] for r in now.collect()}
        if name != "byte_bpe":
            assert now.columns == docs.columns
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    assert len(kept["toxicity"] & toxic) <= 2  # the smallest table has eleven, some of them held out
    by: dict = {}
    for i in kept["toxicity"]:
        by.setdefault(brute.lower(texts[i].encode()), []).append(i)
    assert kept["exact_dedup"] == {max(ids) for ids in by.values()}
    near = brute.closure({i: brute.simhash(texts[i]) for i in kept["exact_dedup"]})
    assert kept["simhash_near_dedup"] == set(near.values())
    assert kept["mixing"] <= kept["simhash_near_dedup"] and kept["byte_bpe"] == kept["mixing"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == kept["byte_bpe"]


def test_pipeline_on_empty_documents(spark, sf):
    now = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
    assert now.count() == 0
