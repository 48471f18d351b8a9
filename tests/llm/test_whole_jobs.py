"""Operators do the whole job: nothing falls to cuts that grow with the table."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import lm, mixing, secrets


@pytest.fixture(scope="module")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").limit(200).cache()


def plain_automaton(texts):
    """The automaton over all words of the texts in memory, and the words' symbols."""
    words = Counter(w for raw in texts for w in lm.tokens(raw))
    starts = words.pop(lm.END)
    order = [*sorted(words), lm.END]
    symbols = {w: i + 1 for i, w in enumerate(order)}
    grams = Counter()
    for raw in texts:
        s = [symbols[w] for w in (lm.END, *lm.tokens(raw))]
        grams.update(zip(s, s[1:]))
        grams.update(zip(s, s[1:], s[2:]))
    n = sum(words.values()) + starts
    return lm.build([*(words[w] for w in order[:-1]), starts], n, len(order), dict(grams), starts, lm.MIN_COUNT), symbols


def test_lm_scores_are_those_of_the_automaton_over_all_words(real):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in real.collect()}
    model, symbols = plain_automaton([t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 10])
    for r in lm.score(real, block_bytes=200_000).collect():
        want = model.score([symbols.get(w, lm.TAIL) for w in lm.tokens(docs[r["doc_id"]])])
        assert r["score"] == pytest.approx(want, rel=1e-6)


def test_lm_keeps_rare_ngrams_however_large_the_corpus(spark):
    """A pair seen three times is an arc, however many other tokens there are."""
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10]
    held = next(i for i in range(200) if not zlib.crc32(str(i).encode()) % 10)
    texts = [(i, "rare pair") for i in train[:3]] + [(train[3], "rare x"), (train[4], "y pair")] + [(i, "a b c d " * 10_000) for i in train[5:60]] + [(train[60], " ".join(f"w{k}" for k in range(20_000)))]
    rows = lm.score(spark.createDataFrame([*texts, (held, "rare pair")], "doc_id long, text string")).where(f"doc_id = {held}").collect()
    assert rows[0]["score"] > -3


def test_one_odd_row_does_not_thin_the_mixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(1).select(*(F.lit({"doc_id": -1, "text": "one", "source": "own", "lang": "xx"}.get(c)).cast(t).alias(c) for c, t in docs.dtypes))
    shares = [corpus_pipeline.mix_sources(spark, d, sf).count() / d.count() for d in (docs, docs.unionByName(odd))]
    assert shares[1] > 0.85 and abs(shares[0] - shares[1]) < 0.03


def test_mixing_takes_targets_and_a_yield(spark, sf):
    rows = mixing.described(spark.read.parquet(f"{sf}/documents.parquet"))
    labels = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    targets = {"lang": {x: 1.0 for x in labels}}
    cells = mixing.calibrate(rows, targets=targets, token_yield=0.05)
    kept, total = cells.agg(F.sum(F.col("tokens") * F.col("probability")), F.sum("tokens")).first()
    assert kept / total == pytest.approx(0.05, rel=1e-6)
    assert all(0 <= r["probability"] <= 1 for r in cells.collect())
    for r in mixing.residuals(cells, targets=targets).where("by = 'lang'").collect():
        assert r["target"] == pytest.approx(1 / len(labels))
        assert r["share"] - r["target"] == pytest.approx(r["residual"])


def test_secret_models_learn_from_every_document(spark):
    """More documents than were once drawn, each with a word of its own; joined words fall into parts that count the same pairs of characters."""
    texts = [f"{'ghijklmnop'[i % 10] * (2 + i // 10)} stands here token=abcdefgh" for i in range(500)]
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    ordinary = {r["s"] for r in secrets.labelled_samples(docs).where("label = 'ordinary'").collect()}
    assert ordinary >= {t.split()[0] for t in texts} | {t.split()[0] + "_stands" for t in texts}
    assert not any("abcdefgh" in s for s in ordinary)
    words = secrets.ordinary_words(docs).where(~secrets.held("w")).select(F.explode(F.array(F.col("w"), secrets.joined())).alias("s"))
    made = secrets.made_strings(spark).where(~secrets.held("s"))
    whole = made.unionByName(words.select(F.lit("ordinary").alias("label"), "s"))
    assert secrets.train(secrets.training_strings(docs)) == secrets.train(whole)
    assert secrets.learnt(docs)[0] == secrets.train(whole)
