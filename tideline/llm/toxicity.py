"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import as_bytes, whole_text

BITS = 21
ORDERS = (3, 4, 5)
MULT = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Model:
    """Selected hash buckets, their weights (classifier weight times log-count ratio) and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.buckets] = self.weights
        return out


def ngram_buckets(raw: bytes) -> list[np.ndarray]:
    """Hash buckets of all character n-grams of the lower-cased, space-padded text, an array for each order."""
    text = " " + raw.decode("utf-8", "replace").lower() + " "
    x = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    h = x = np.where((x >= 9) & (x <= 13), np.uint32(32), x)
    out = []
    for n in range(2, max(ORDERS) + 1):
        h = (h[:-1] * MULT) ^ x[n - 1 :]
        if n in ORDERS:
            mixed = (h + np.uint32(n)) * MULT
            out.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS))
        if len(h) < 2:
            break
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def margin(raw: bytes, dense: np.ndarray, bias: float) -> float:
    """Sum of the weights of the distinct selected n-grams of the whole text, plus the bias."""
    hit = [b[dense[b] != 0] for b in ngram_buckets(raw)]
    return bias + float(dense[distinct(np.concatenate(hit))].sum(dtype=np.float64)) if hit else bias


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """By bucket: the log of the ratio of its smoothed document frequencies among labels 1 and 0, and how many rows have it."""
    df = np.zeros((2, 1 << BITS), np.int32)
    for b, label in zip(rows, y, strict=True):
        df[int(label), b] += 1
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    return np.log((df[1] + alpha) / (n1 + 2 * alpha)) - np.log((df[0] + alpha) / (n0 + 2 * alpha)), df.sum(0)


def fit_rows(rows: list[np.ndarray], y: np.ndarray, prior: float, alpha: float, features: int, l2: float, steps: int) -> Model:
    """Fit on rows given as arrays of distinct buckets.

    Log-count ratios come from document frequencies with add-alpha smoothing. The ``features``
    buckets of the largest ratio, weighted by the root of their frequency, enter a logistic
    regression with an L2 penalty on the unscaled weights. The bias is shifted from the
    sample's share of label 1 to ``prior``.
    """
    size, n1, n0 = 1 << BITS, int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -4.0)
    ratio, seen = log_count_ratios(rows, y, alpha)
    strength = np.where(seen >= 3, np.abs(ratio) * np.sqrt(np.minimum(seen, n1)), 0)
    chosen = np.sort(np.argsort(-strength, kind="stable")[: min(features, int((seen >= 3).sum()))])
    if not len(chosen):
        return Model(chosen, np.zeros(0, np.float32), -4.0)
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    scale, parts = ratio[chosen].astype(np.float32), []
    for at in range(0, len(rows), 256):  # the selected n-grams of some rows at a time, so that sums over them stay small
        cols = [c[c >= 0] for c in (place[b] for b in rows[at : at + 256])]
        parts.append((at, np.repeat(np.arange(len(cols), dtype=np.int32), [len(c) for c in cols]), np.concatenate(cols)))
    w, bias, mw, mb, vw, vb = np.zeros(len(chosen)), 0.0, 0.0, 0.0, 0.0, 0.0
    for t in range(1, steps + 1):  # Adam on the whole sample
        gw, gb, scaled = l2 * w, 0.0, (scale * w).astype(np.float32)
        for at, who, cols in parts:
            own = y[at : at + 256]
            z = np.clip(np.bincount(who, scaled[cols], len(own)) + bias, -30, 30)
            err = (1 / (1 + np.exp(-z)) - own) / len(y)
            gw += scale * np.bincount(cols, err[who], len(w))
            gb += err.sum()
        mw, mb, vw, vb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb, 0.99 * vw + 0.01 * gw**2, 0.99 * vb + 0.01 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.02 * (mw / c1) / (np.sqrt(vw / c2) + 1e-8)
        bias -= 0.02 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    shift = np.log(prior / (1 - prior)) - np.log(n1 / n0)
    return Model(chosen, (w * ratio[chosen]).astype(np.float32), float(bias + 0.5 * shift))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", sample_positive: int = 3000,
    sample_negative: int = 5000, alpha: float = 1.0, features: int = 60_000, l2: float = 1e-4, steps: int = 60,
) -> Model:
    """Fit the classifier on a bounded sample of labelled rows.

    ``labels`` has the id and the label (0 or 1). ``sample_positive`` and ``sample_negative``
    bound the ids of either label; those with the smallest hash of id and label are taken. All
    labels count for the share of label 1. The sample's n-grams are computed where its texts
    are read and fitted in one task; the driver gets at most ``features`` buckets and weights.
    Null labels take no part; an id with both labels is two rows. Of documents that repeat an id and
    a text the sample has one. Without rows of both labels every text scores low.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("y"))
    ids = known.withColumn("h", F.xxhash64("__id", "y"))
    share = ids.agg(F.avg("y").alias("p")).first()["p"]
    prior = min(max(share or 0.5, 0.01), 0.99)
    picked = ids.where("y = 1").orderBy("h", "__id").limit(sample_positive).unionByName(ids.where("y = 0").orderBy("h", "__id").limit(sample_negative))
    picked = picked.select("__id", "y").distinct()

    def grams(batches):
        for b in batches:
            sets = [distinct(np.concatenate(g)).astype("<u4").tobytes() if (g := ngram_buckets(t)) else b"" for t in as_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], names=["doc_id", "y", "grams"])

    def fit(t: pa.Table) -> pa.Table:
        m = fit_rows([np.frombuffer(g.as_buffer(), "<u4") for g in t.column("grams")], t.column("y").to_numpy().astype(float), prior, alpha, features, l2, steps)
        return pa.table({"buckets": [m.buckets.tolist()], "weights": [m.weights.astype(float).tolist()], "bias": [m.bias]}, schema=pa.schema([("buckets", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())), ("bias", pa.float64())]))

    # The sample's ids number at most sample_positive + sample_negative, so they can be broadcast.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    sample = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).select("doc_id", "y", "text").distinct().mapInArrow(grams, "doc_id long, y int, grams binary")
    got = sample.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fit, "buckets array<long>, weights array<double>, bias double").first()
    if got is None:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -4.0)
    return Model(np.array(got["buckets"], np.int64), np.array(got["weights"], np.float32), got["bias"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text, in one narrow pass.

    Null and empty texts score what the two spaces around them give, the bias alone. Long texts
    are scored whole. Repeated rows repeat their score; other columns are ignored.
    """

    def run(batches):
        dense = model.dense()
        for b in batches:
            z = np.array([margin(t, dense, model.bias) for t in as_bytes(b.column(1))], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "__toxicity") -> DataFrame:
    """``docs`` with a score column beside their own columns."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        dense = model.dense()
        z = np.array([margin(t, dense, model.bias) for t in as_bytes(texts)], float)
        return pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))), pa.float64())

    return docs.withColumn(name, run(whole_text(text_col)))


def held_out(id_col: str = "doc_id"):
    """Whether the remainder is 2; a null id is taken as an empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def training_labels(labels: DataFrame) -> DataFrame:
    """Ids and toxic labels; ids of remainder 2 stay out."""
    return labels.where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("label"))
