"""Dedup, near-dedup, substrings, tokens, scores and secrets against plain versions, with odd rows."""

from __future__ import annotations

import hashlib

import pytest

from tests.llm import brute
from tideline.llm import bpe, exact_dedup, lm, mixing, queries, secrets, simhash, substring, toxicity

PASSAGE = " ".join(f"word{i}" for i in range(60))
ODD = {
    0: None, 1: "", 2: "   \n", 3: "A b C d E", 4: "a B c D e", 5: "a b c d e", 6: "Éa b", 7: "éa b",
    8: PASSAGE, 9: "start here " + PASSAGE + " and an end", 10: "x " * 80, 11: "x " * 80 + "y", 12: PASSAGE + " tail", 13: "a\tb\x0bc d e f",
    14: "long " + " ".join(f"w{i % 977}" for i in range(30_000)), 15: "token = tok", 16: "secret=token:abcdefgh token=token=abcdefgh", 17: "TOKEN: 'abc.def=' AKIA" + "Z9" * 8,
    18: "deadbeef" * 4 + "x" + "ab12" * 5, 19: "one two three four five six seven eight " * 20, 20: "one two three four five six seven eight " * 20 + "nine",
}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "src", i) for i, t in ODD.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, h int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")


@pytest.fixture(scope="module")
def real(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return df, {r["doc_id"]: r["text"] for r in df.collect()}


def groups(docs):
    by: dict = {}
    for i, t in docs.items():
        by.setdefault(brute.lower((t or "").encode()), []).append(i)
    return {i: (max(ids), len(ids), i == max(ids)) for ids in by.values() for i in ids}


def test_exact_dedup(odd, real):
    for df, docs in ((odd, ODD), real):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df).collect()}
        assert got == groups(docs)


def test_exact_dedup_compares_content_where_digests_collide(odd):
    from pyspark.sql import functions as F

    out = exact_dedup.exact_groups(odd, digest=lambda t: F.unhex(F.lit("00")))
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in out.collect()} == groups(ODD)


def test_exact_dedup_null_ids_and_repeats(spark, empty):
    df = spark.createDataFrame([(None, "a"), (1, "A"), (1, "a"), (None, "z")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df).collect()), key=str)
    assert got == sorted([(None, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (None, None, 1, True)], key=str)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.keep_one(df).count() == 3


def test_substring_dedup(odd, real, empty):
    for df, docs in ((odd, ODD), real):
        want = brute.window_dedup(docs)
        for sizes in ({}, {"largest_group": 2}, {"largest_group": 2, "most_nodes": 3}):
            got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup(df, **sizes).collect()}
            assert got == want
    assert substring.dedup(empty).count() == 0


def test_substring_dedup_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, PASSAGE), (3, PASSAGE), (3, PASSAGE), (2, PASSAGE + " x")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in substring.dedup(df).collect()), key=str)
    assert got == sorted([(None, 60), (3, 60), (3, 60), (2, 0)], key=str)


def test_simhash(odd, real, empty):
    for df, docs in ((odd, ODD), real):
        fp = {i: brute.simhash(t) for i, t in docs.items()}
        want = brute.closure(fp)
        got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(df).collect()}
        assert got == {i: (fp[i], want[i]) for i in docs}
    assert simhash.near_groups(empty).count() == 0


def test_simhash_links_crowded_cells(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(simhash, "DENSE", 40)
    rng = np.random.default_rng(1)
    fps = {int(rng.integers(1 << 63))}
    while len(fps) < 1500:  # chains of near fingerprints
        x = int(rng.choice(list(fps)))
        fps.add(x ^ sum(1 << b for b in {int(b) for b in rng.integers(63, size=rng.integers(1, 6))}))
    fp = dict(enumerate(sorted(fps)))
    a, b = simhash.links_in_run(np.zeros(len(fp), np.int64), np.array(list(fp.values()), np.uint64), 4, small=8)
    forest = simhash.Forest()
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert bin(x ^ y).count("1") <= 4
        forest.unite(x, y)
    want = brute.closure(fp)
    assert all((forest.root(fp[i]) == forest.root(fp[j])) == (want[i] == want[j]) for i, j in zip(range(1499), range(1, 1500), strict=True))
    prints = spark.createDataFrame([(i, x) for i, x in fp.items()], "doc_id long, fp long")
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(prints)).collect()}
    assert all(root.get(fp[i], fp[i]) == fp[want[i]] for i in fp)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300) if i != 150], "a long, b long")
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert root == {i: 0 if i <= 150 else 151 for i in range(301)}
    assert simhash.components(edges.limit(0)).count() == 0


def test_bpe_round_trip(odd, real, empty):
    path, pattern = bpe.rank_file()
    whole = bpe.encoding(path, pattern)
    for df, docs in ((odd, ODD), real):
        got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(df).collect()}
        for i, t in docs.items():
            ids = whole.encode_ordinary(t or "")
            raw = b"".join(x.to_bytes(4, "little") for x in ids)
            assert got[i] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.round_trip(empty).count() == 0


def test_bpe_cuts_are_safe():
    path, pattern = bpe.rank_file()
    text = ODD[14] + "\n\n  a  b.\n c" * 500 + " " * 3000 + "end of it."
    assert bpe.encode(text, path, pattern, 50).tolist() == bpe.encoding(path, pattern).encode_ordinary(text)
    assert "".join(bpe.pieces(text, 50)) == text


def test_lm_counts_and_base(odd, real, empty):
    for df, docs in ((odd, ODD), real):
        want = brute.base_scores(docs)
        rows = lm.score(df, block_bytes=200_000).collect()
        assert len(rows) == len(docs)
        for r in rows:
            w = want[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
            assert r["base_score"] == pytest.approx(w[4], abs=1e-6)
    assert lm.score(empty).count() == 0


def test_lm_gains_on_held_out_texts(real):
    rows = [r for r in lm.score(real[0]).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_lm_probabilities_add_up():
    grams = {(3, 1): 8, (3, 2): 2, (1, 2): 6, (1, 1): 2, (2, 3): 7, (3, 1, 2): 5, (1, 2, 3): 5, (0, 1): 3, (1, 0): 1}
    model = lm.build([10, 9, 10], 40, 12, grams, 10, 2)
    for state in [model.start, *model.bow, ()]:
        at = model.number(state)
        assert sum(10 ** model.follow(at, x)[1] for x in range(model.size)) == pytest.approx(1, abs=1e-9)


def test_secrets(odd, real, empty, spark):
    table = secrets.train(secrets.labelled_samples(real[0]))
    for df, docs in ((odd, ODD), real):
        for r in secrets.report(df, table).collect():
            want = brute.base_spans(docs[r["doc_id"]])
            text = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
            assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
            assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for *_, k in want) for n in ("assign", "access", "hex")]
            assert [s for s in r["spans"].split(",") if s and not s.startswith("markov")] == (text.split(",") if text else [])
    assert secrets.report(empty, table).count() == 0
    df = spark.createDataFrame([(1, "key Zk8fQ2vN7xPq3LwT9bRs and an_ordinary_identifier_name 4312345678901234")], "doc_id long, text string")
    assert secrets.report(df, table).first()["spans"] == "markov:4:24"


def test_toxicity(spark, real, sf, empty):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(real[0], toxicity.training_labels(labels))
    rows = toxicity.score(real[0], model).collect()
    got = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == real[0].count() and all(0 <= s <= 1 for s in got.values())
    known = [(got[r["doc_id"]] >= 0.3, r["toxic"] == 1) for r in labels.collect() if r["toxic"] is not None and r["doc_id"] in got]
    assert sum(a == b for a, b in known) / len(known) > 0.95
    inline = {r["doc_id"]: r["__toxicity"] for r in toxicity.with_score(real[0], model).collect()}
    assert inline == pytest.approx(got)
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_without_labels(spark, empty, odd):
    none = toxicity.train(empty, toxicity.training_labels(spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert all(r["score"] < 0.3 for r in toxicity.score(odd, none).collect())


def test_mixing_meets_its_marginals(spark, real, empty):
    from pyspark.sql import functions as F

    cells = mixing.described(real[0]).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    targets = {c: mixing.tempered(cells, c, 0.5) for c in ("source", "lang", "topic")}
    done = mixing.rake(cells, targets)
    want = {r["topic"]: r["share"] for r in targets["topic"].collect()}
    got = {r["topic"]: r["w"] for r in done.groupBy("topic").agg(F.sum("weight").alias("w")).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    assert mixing.mix(empty).count() == 0
    odd = spark.createDataFrame([(1, None, None, None), (None, "a b", "s", None), (2, "", "s", "en")], "doc_id long, text string, source string, lang string")
    assert mixing.mix(odd).count() == 3
    kept = mixing.sample(real[0])
    assert kept.columns == real[0].columns
    assert kept.count() == mixing.mix(real[0]).where("sampled").count()


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
