"""Long runs, crowded groups and odd rows."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tideline.llm import bpe, exact_dedup, lm, secrets, simhash, substring


def whole(text):
    """Token ids of every match of the pattern, found by another matcher."""
    import regex

    path, pattern = bpe.rank_file()
    enc = bpe.encoding(path, pattern)
    return [i for m in regex.finditer(pattern, text) for i in enc._encode_single_piece(m[0])]


@pytest.mark.parametrize("text", ["a" + " " * 4000 + "b", "a" + " " * 4000, "\n" * 3000 + "x y", "a" + "　" * 2000 + "b" + "\r\n" * 1500 + "'s it's", " " * 1000 + "\t" * 1000 + "1", "漢字" * 3000, "x" * 5000 + "12" * 5000 + "!'" * 5000])
def test_bpe_runs_are_matched_as_the_pattern_does(text):
    path, pattern = bpe.rank_file()
    for size in (bpe.PIECE, 100):
        assert bpe.encode(text, path, pattern, size).tolist() == whole(text)
    assert bpe.decode(bpe.encode(text, path, pattern), path, pattern) == text.encode()


def test_bpe_takes_a_million_of_anything(spark):
    texts = [" " * 1_000_000, "\n" * 1_000_000 + "x", "ab" * 500_000, "漢" * 300_000, "a1" * 500_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    rows = bpe.round_trip(df).collect()
    assert len(rows) == 6 and all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)


def test_secrets_in_a_text_of_many_matches(spark):
    table = [0.0] * secrets.SIZE**2
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(24)) + rng.choice(["", " token=abcdefgh", "x" * 20]) for _ in range(30_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = secrets.report(df, table, least=1.0).first()
    assert time.time() - began < 60
    want = ",".join(f"{k}:{a}:{b}" for a, b, k in brute.base_spans(text))
    assert row["spans"] == want and row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_secrets_are_added_where_no_base_span_is(spark):
    import re

    table = [0.1] * secrets.SIZE**2
    rng = random.Random(3)
    parts = ["token=abcdefgh", "x" * 16, "ab12" * 8, "secret: /" + "Q" * 20 + ".tail_of_the_value_is_long", "short", "password=abc", "AKIA" + "A1" * 10 + "zz", "zz" * 8 + "AKIA" + "B2" * 9, "k" * 30 + "api_key=123456", "."]
    docs = {i: rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randrange(40))) for i in range(200)}
    for r in secrets.report(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), table, least=0.5).collect():
        base = brute.base_spans(docs[r["doc_id"]])
        more = [m.span() for m in re.finditer(secrets.CANDIDATE, docs[r["doc_id"]])]
        free = [(a, b, "markov") for a, b in more if not any(x < b and a < y for x, y, _ in base)]
        order = ["assign", "access", "hex", "markov"]
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(base + free, key=lambda s: (s[0], order.index(s[2]))))


def test_secret_models_tell_held_out_strings_apart(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table, least = secrets.learnt(docs)
    samples = secrets.labelled_samples(docs).where(F.pmod(F.xxhash64("s"), F.lit(5)) == 0).where(F.col("s").rlike(f"^{secrets.CANDIDATE}$"))
    got = {r["label"]: (r["hits"], r["n"]) for r in samples.groupBy("label").agg(F.sum((secrets.ratio(F.col("s"), table) >= least).cast("int")).alias("hits"), F.count(F.lit(1)).alias("n")).collect()}
    assert got["random"][0] / got["random"][1] > 0.9
    assert got["ordinary"][0] / got["ordinary"][1] < 0.01


def test_substrings_of_long_runs_and_crowded_groups(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(70))
    docs = {0: "a " * 30_000, 1: "b " + "a " * 200, 2: None, 3: "", 4: "a b " * 2000, 5: "c " + "a b " * 60}
    for i in range(6, 120):
        docs[i] = " ".join(f"x{rng.randrange(40)}" for _ in range(rng.randrange(80))) + " " + passage + " " + " ".join(f"y{rng.randrange(3)}" for _ in range(rng.randrange(120)))
    df = spark.createDataFrame([(i, t, i) for i, t in docs.items()], "doc_id long, text string, first int").repartition(4)
    want = brute.window_dedup(docs)
    for sizes in ({}, {"largest_group": 4}):
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup(df, **sizes).collect()} == want
    assert len(substring.anchors([b"a"] * 20_000, 50, 8)[0]) == 1


def test_common_prefixes_of_word_numbers():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(0, 2, 12).astype(">u4") for _ in range(2))
        want = next((i for i in range(12) if a[i] != b[i]), 12)
        assert substring.common(a.tobytes(), b.tobytes()) == want


def test_exact_dedup_keeps_one_row_without_ties(spark):
    rows = [(None, "a", 1), (None, "A", 2), (1, "b", 1), (1, "B", 2), (2, "c", 1), (2, "c", 1), (3, "C", 9), (4, None, 1), (None, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, salt int")
    got = [(r["doc_id"], (r["text"] or "").lower()) for r in exact_dedup.keep_one(df, ties=False).collect()]
    assert sorted(got, key=str) == sorted([(None, "a"), (1, "b"), (3, "c"), (4, "")], key=str)
    assert exact_dedup.keep_one(df, ties=False).columns == df.columns


def test_exact_dedup_of_one_large_group(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("Same").alias("text"), F.lit(1).alias("digest"))
    got = exact_dedup.exact_groups(df).groupBy("keep_id", "group_size").count().collect()
    assert [(r["keep_id"], r["group_size"], r["count"]) for r in got] == [(4999, 5000, 5000)]


def test_simhash_null_and_repeated_ids_and_crowded_cells(spark, monkeypatch):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "q r s t u v w x"), (6, "q r s t u v w x"), (None, ""), (None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_groups(df).collect())
    assert got == sorted([("None", "5"), ("5", "5"), ("5", "5"), ("6", "5"), ("None", "None"), ("None", "None")])
    assert sorted(str(r["text"] or "") for r in simhash.keep_one(df).collect()) == ["", "", "a b c d e f", "q r s t u v w x"]
    monkeypatch.setattr(simhash, "DENSE", 20)
    rng = np.random.default_rng(1)
    fps = {int(rng.integers(1 << 63))}
    while len(fps) < 600:
        x = int(rng.choice(list(fps)))
        fps.add(x ^ sum(1 << b for b in {int(b) for b in rng.integers(63, size=rng.integers(1, 6))}))
    fp = dict(enumerate(sorted(fps)))
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(i, x) for i, x in fp.items()], "doc_id long, fp long"))).collect()}
    want = brute.closure(fp)
    assert all(root.get(fp[i], fp[i]) == fp[want[i]] for i in fp)


def test_lm_null_and_repeated_ids_long_and_empty_texts(spark):
    rows = [(None, "a b"), (1, "a b c"), (1, "a b c"), (2, ""), (3, None), (4, "w " * 200_000), (5, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, piece int")
    got = lm.score(df, block_bytes=1000).collect()
    assert len(got) == len(rows)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 5)} == {1}
    assert all(r["held_out"] in (True, False) for r in got) and {r["n_tokens"] for r in got if r["doc_id"] == 4} == {200_001}


def vectors_around(n, centres, seed, spread=0.3, dim=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dim))


def recall(spark, x, extra=(), **options):
    from tideline.llm import ann

    rows = [(i, v.tolist()) for i, v in enumerate(x)] + list(extra)
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, part int").repartition(4)
    want = brute.nearest(dict(rows), [i for i, _ in rows if i % 100 == 0])
    got: dict = {}
    for r in ann.search(df, df.where("vec_id % 100 = 0"), **options).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert got.keys() == want.keys()
    for q in got:
        found = [got[q][i] for i in range(1, len(got[q]) + 1)]
        assert found == sorted(found, key=lambda p: (p[1], p[0])) and len({v for v, _ in found}) == len(found) == len(want[q])
        exact = dict(brute.nearest(dict(rows), [q], len(rows))[q])
        assert all(s == pytest.approx(exact[v], abs=1e-12) for v, s in found)
    return sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_neighbours_are_routed_at_default_sizes(spark):
    x = vectors_around(2500, 40, 0)
    from tideline.llm import ann

    df = spark.createDataFrame([(i, v.tolist(), [i]) for i, v in enumerate(x)], "vec_id long, v array<double>, ids array<long>")
    tree, dim, needed = ann.train(df)
    assert tree.parts >= 8 and needed < tree.parts
    assert recall(spark, x) >= 0.9


def test_neighbours_of_a_second_cut_and_of_one_very_common_vector(spark):
    x = vectors_around(2400, 30, 1)
    x[600:1500] = x[0]
    assert recall(spark, x, [(2500, [1.0, 2.0]), (2600, [1.0, 2.5]), (5000, None)], rows_per_part=400, most_parts=4, rows_per_leaf=100, block_rows=64, coverage=0.97) >= 0.9


def test_repeated_vector_ids_count_once(spark):
    from tideline.llm import ann

    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [5.0, 0.1]), (2, [1.0, 0.0]), (3, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1), (0, 3, 3)]


def test_best_run_of_all_intervals():
    from tideline.llm import html_extract

    rng = random.Random(6)
    for _ in range(300):
        x = [rng.choice([-3, -1.5, -1, 0, 0.5, 1, 2]) for _ in range(rng.randrange(14))]
        best = max((sum(x[a:b]) for a in range(len(x)) for b in range(a, len(x) + 1)), default=0)
        a, b = html_extract.best_run(x)
        assert sum(x[a:b]) == pytest.approx(max(best, 0))


STORY = "<h1>Title here</h1><p>First paragraph of the story with <a href='x'>a link</a> in it and more words.</p><ul><li>one item</li><li>second item of the list</li></ul><p>Then it goes on for a while and comes to an end.</p>"
TOLD = "Title here\n\nFirst paragraph of the story with a link in it and more words.\n\none item\n\nsecond item of the list\n\nThen it goes on for a while and comes to an end."
AROUND = "<html><body><nav><ul><li><a>Home</a></li></ul></nav>%s<div class='sidebar'><p>Other stories</p></div><footer>Copyright</footer></body></html>"


def test_pages_in_containers_of_misleading_names(spark, sf):
    from tideline.llm import html_extract

    weights = html_extract.train(spark.read.parquet(f"{sf}/pages.parquet"))
    for box in ("<article>%s</article>", "<div class='story'>%s</div>", "<div class='social-share-story'>%s</div>", "<div class='search-results side'><article>%s</article></div>", "<main><div>%s</div></main>"):
        assert html_extract.extract(AROUND % (box % STORY), weights) == TOLD
    inner = STORY + "<div class='ad'><p>Buy this now</p></div><div id='comments'><p>I like it, says a reader of this page</p></div>"
    assert html_extract.extract(AROUND % f"<article>{inner}</article>", weights) == TOLD


def test_page_weights_are_smoothed_log_odds():
    import math

    from tideline.llm import html_extract as h

    w = h.learn({("words", True): 950, ("words", False): 150, ("part:x", True): 30, ("part:y", False): 3, ("cost:p", True): 9, ("cost:p", False): 9, ("cost:q", True): 8, ("cost:q", False): 6})
    inside, outside = 1000, 200
    even = (20 * inside / 1200, 20 * outside / 1200)
    assert w.feature["part:x"] == pytest.approx(math.log((30 + even[0]) / inside) - math.log(even[1] / outside))
    assert w.feature["part:y"] == pytest.approx(math.log(even[0] / inside) - math.log((3 + even[1]) / outside))
    assert w.tag["p"] == pytest.approx(0.5) and w.tag["q"] == pytest.approx(math.log(7 / 9) + 0.5)


def plain_grams(text):
    t = " " + (text or "").lower() + " "
    t = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t)
    return {t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)}


def bucket(gram):
    """Of one n-gram, by whole numbers."""
    h = ord(gram[0])
    for c in gram[1:]:
        h = (h * 0x9E3779B1 & 0xFFFFFFFF) ^ ord(c)
    x = (h + len(gram)) * 0x9E3779B1 & 0xFFFFFFFF
    return ((x ^ (x >> 15)) * 0x85EBCA77 & 0xFFFFFFFF) >> 11


def test_log_count_ratios_of_character_ngrams():
    import math

    from tideline.llm import toxicity

    texts = ["Bad bad day", "bäd\tthing", "good day", "漢字 good", "", "day"]
    y = np.array([1.0, 1, 0, 0, 0, 1])
    rows = [toxicity.distinct(np.concatenate(g)) if (g := toxicity.ngram_buckets(t.encode())) else np.zeros(0, np.uint32) for t in texts]
    for t, r in zip(texts, rows, strict=True):
        assert set(r.tolist()) == {bucket(g) for g in plain_grams(t)}
    ratio, seen = toxicity.log_count_ratios(rows, y, 1.0)
    grams = set().union(*map(plain_grams, texts))
    assert len({bucket(g) for g in grams}) == len(grams)
    for g in grams:
        one, none = (sum(g in plain_grams(t) for t, label in zip(texts, y, strict=True) if label == v) for v in (1, 0))
        assert ratio[bucket(g)] == pytest.approx(math.log((one + 1) / (3 + 2)) - math.log((none + 1) / (3 + 2)))
        assert seen[bucket(g)] == one + none


def test_classifier_is_the_plain_one_on_scaled_features():
    from tideline.llm import toxicity

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", *(["vile"] if i % 3 == 0 else ["kind"])]) for _ in range(12)) for i in range(600)]
    y = np.array([float("vile" in t) for t in texts])
    rows = [toxicity.distinct(np.concatenate(toxicity.ngram_buckets(t.encode()))) for t in texts]
    model = toxicity.fit_rows(rows, y, 0.3, 1.0, 200, 1e-4, 40)
    ratio, seen = toxicity.log_count_ratios(rows, y, 1.0)
    x = np.array([np.isin(model.buckets, r) for r in rows]) * ratio[model.buckets].astype(np.float32)
    w, b, m, v = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, 41):
        err = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        g = np.append(x.T @ err + 1e-4 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    assert model.weights == pytest.approx(w * ratio[model.buckets], abs=1e-3)
    dense = model.dense()
    for t in texts[:20]:
        assert toxicity.margin(t.encode(), dense, model.bias) == pytest.approx(model.bias + sum(float(dense[k]) for k in {bucket(g) for g in plain_grams(t)}), abs=1e-4)


def test_toxicity_null_and_repeated_ids_and_clashing_columns(spark):
    from tideline.llm import toxicity

    rows = [(i, "vile thing " * (i % 3 + 1) if i % 2 else "kind words " * (i % 4 + 1), 1.0, i) for i in range(80)] + [(None, "vile thing", 1.0, 0), (3, "vile thing ", 1.0, 0), (3, "vile thing ", 1.0, 0), (90, None, 0.0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, y int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(3, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df, toxicity.training_labels(labels))
    got = toxicity.score(df, model).withColumn("held_out", toxicity.held_out()).collect()
    assert len(got) == len(rows) and all(r["held_out"] in (True, False) for r in got)
    assert all((r["score"] >= 0.3) == (r["doc_id"] is None or r["doc_id"] % 2 == 1) for r in got if r["doc_id"] != 90)
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert toxicity.with_score(df, model).drop("__toxicity").columns == df.columns


def test_raking_is_the_plain_one(spark):
    from tideline.llm import mixing

    rng = random.Random(5)
    cells = {(f"s{a}", f"l{b}", f"t{c}"): rng.randrange(1, 1000) for a in range(5) for b in range(3) for c in range(3) if rng.random() < 0.8}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    stated = {"lang": {"l0": 2.0, "l1": 1.0, "l2": 1.0}}
    out = mixing.calibrate(df, 0.6, stated, 0.4).collect()
    total = sum(cells.values())
    want = {}
    for i, c in enumerate(("source", "lang", "topic")):
        names = sorted({k[i] for k in cells})
        p = {x: stated[c][x] if c in stated else sum(v for k, v in cells.items() if k[i] == x) ** 0.6 for x in names}
        want[i] = {x: v / sum(p.values()) for x, v in p.items()}
    w = {k: v / total for k, v in cells.items()}
    for _ in range(500):
        for i, shares in want.items():
            sums = {x: sum(v for k, v in w.items() if k[i] == x) for x in shares}
            w = {k: v * shares[k[i]] / sums[k[i]] for k, v in w.items()}
    ratio = {k: w[k] * total / cells[k] for k in cells}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(cells[k] * min(1, mid * ratio[k]) for k in cells) < 0.4 * total else (low, mid)
    for r in out:
        k = (r["source"], r["lang"], r["topic"])
        assert r["probability"] == pytest.approx(min(1, low * ratio[k]), rel=1e-6)


def test_samples_meet_their_targets(spark, sf):
    from tideline.llm import mixing, queries

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    many = docs.crossJoin(spark.range(30)).withColumn("doc_id", F.col("doc_id") * 1000 + F.col("id")).drop("id")
    out = mixing.mix(many, **queries.MIXTURE).where("tokens > 0")
    got = {r["topic"]: r["n"] for r in out.where("sampled").groupBy("topic").agg(F.sum("tokens").alias("n")).collect()}
    expected = {r["topic"]: r["n"] for r in out.groupBy("topic").agg(F.sum(F.col("tokens") * F.col("probability")).alias("n")).collect()}
    total = out.agg(F.sum("tokens")).first()[0]
    assert sum(got.values()) / total == pytest.approx(0.5, abs=0.03)
    assert all(got[t] / sum(got.values()) == pytest.approx(expected[t] / sum(expected.values()), abs=0.03) for t in expected)


def test_mixing_warns_if_targets_cannot_be_met(spark):
    from tideline.llm import mixing

    df = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="not settled"):
        mixing.rake(df, mixing.marginals(df, 1.0, {"source": {"a": 1.0, "b": 1.0}, "lang": {"x": 3.0, "y": 1.0}}), most=3)


def test_mixing_null_and_repeated_ids_and_clashing_columns(spark, empty_documents):
    from tideline.llm import mixing

    rows = [(None, "a b c", "s", "en", 1.0, "x"), (None, "a b c", None, "en", 1.0, "x"), (2, "a b", "s", None, 1.0, "x"), (2, "a b", "s", None, 1.0, "x"), (3, None, "s", "en", 0.0, "y"), (4, "word " * 100_000, "s", "en", 0.0, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, probability double, topic string")
    out = mixing.mix(df, token_yield=0.5).collect()
    assert len(out) == len(rows) and len({(r["probability"], r["sampled"]) for r in out if r["doc_id"] == 2}) == 1
    assert all(r["sampled"] for r in out if r["tokens"] == 0)
    assert mixing.sample(df, token_yield=0.5).columns == df.columns
    assert mixing.mix(empty_documents, token_yield=0.5).count() == 0


@pytest.fixture
def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")


def test_pipeline_stages_take_odd_rows(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "only here with a few words in it", None, "en", 1), (7_000_000, "", "s", "en", 0), (7_000_000, "", "s", "en", 0), (7_000_001, "twice the very same row of text", "s", "en", 0), (7_000_001, "twice the very same row of text", "s", "en", 0), (None, "TWICE the very same row of text", "s", "en", 0)], docs.select("doc_id", "text", "source", "lang", "n_chars").schema)
    both = docs.unionByName(odd).withColumn("score", F.lit(1)).withColumn("fp", F.lit("x"))
    now, sizes = both, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stored(stage(spark, now, sf))
        assert now.columns == both.columns
        sizes.append(now.count())
    assert sizes[0] >= 50 and sizes[1] < sizes[0] and sizes == sorted(sizes, reverse=True)
    left = now.where("doc_id >= 7000000 or doc_id is null").collect()
    assert len({(r["text"] or "").lower() for r in left}) == len(left)
    assert corpus_pipeline.STAGES[-1][1](spark, now, sf).count() == sizes[-1]
