"""Periodic runs against plain versions; linear work on odd texts."""

from __future__ import annotations

import hashlib
import itertools
import random
import time
import zlib
from fractions import Fraction

import pytest

from tests.llm.brute import words as split
from tideline.llm import queries, repeats


def agreement(s, i, j):
    k = 0
    while j + k < len(s) and s[i + k] == s[j + k]:
        k += 1
    return k


def plain_next_smaller(s):
    nss, agree = [], []
    for i in range(len(s)):
        j = next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s))
        nss.append(j)
        agree.append(agreement(s, i, j) if j < len(s) else 0)
    return nss, agree


def plain_runs(s, least_length=24, least_exponent=3):
    out = []
    for p in range(1, len(s) // 2 + 1):
        i = 0
        while i + p < len(s):
            if s[i] != s[i + p]:
                i += 1
                continue
            a = i
            while i + p < len(s) and s[i] == s[i + p]:
                i += 1
            n = i + p - a
            if n >= max(least_length, least_exponent * p) and not any(s[a : a + n - q] == s[a + q : a + n] for q in range(1, p)):
                out.append((a, n, p))
    return sorted(out)


def periodic(rng, n, sigma):
    s = [rng.randrange(1, sigma + 1) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        a, p, length = rng.randrange(n), rng.randrange(1, 12), rng.randrange(1, 60)
        for i in range(a + p, min(n, a + length)):
            s[i] = s[i - p]
    return s


@pytest.mark.parametrize(("sigma", "most"), [(2, 11), (3, 7), (4, 5)])
def test_every_short_word(sigma, most):
    for n in range(1, most + 1):
        for s in itertools.product(range(1, sigma + 1), repeat=n):
            assert repeats.next_smaller([*s, 0], n) == plain_next_smaller(list(s))


def test_runs_of_random_and_periodic_words():
    rng = random.Random(7)
    for _ in range(1500):
        s = periodic(rng, rng.randrange(1, 120), rng.choice([1, 2, 2, 3, 6]))
        assert repeats.next_smaller([*s, 0], len(s)) == plain_next_smaller(s)
        for least in ((1, 2), (10, 2), (24, 3)):
            assert repeats.runs([b"%d" % x for x in s], *least) == plain_runs(s, *least)


def test_kept_words_are_those_outside_or_in_first_periods():
    rng = random.Random(8)
    for _ in range(500):
        s = periodic(rng, rng.randrange(1, 150), rng.choice([2, 3, 6]))
        words = [b"%d" % x for x in s]
        found = repeats.runs(words, 4, 2)
        gone = {i for a, n, p in found for i in range(a + p, a + n)}
        assert repeats.kept(words, found) == [w for i, w in enumerate(words) if i not in gone]


class Counted(list):
    """A list that counts how often it is read."""

    reads = 0

    def __getitem__(self, i):
        Counted.reads += 1
        return super().__getitem__(i)


def fibonacci(n):
    a, b = [1], [1, 2]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("make", [lambda n: [1] * n, lambda n: [1, 2] * (n // 2), lambda n: list(range(1, n + 1)), lambda n: list(range(n, 0, -1)), fibonacci, lambda n: ([1] * (n // 2 - 1) + [2]) * 2, lambda n: ([1] * 99 + [2]) * (n // 100)])
def test_symbols_are_read_a_bounded_number_of_times(make):
    for n in (10_000, 40_000):
        s = make(n)
        Counted.reads = 0
        repeats.next_smaller(Counted([*s, 0]), len(s))
        assert Counted.reads < 14 * n


def plain_row(doc_id, text):
    ws = split((text or "").encode())
    n, h = len(ws), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    number = {w: k for k, w in enumerate(dict.fromkeys(ws))}
    found = plain_runs([number[w] for w in ws])
    gone = {i for a, n, p in found for i in range(a + p, a + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    collapsed = b" ".join(w for i, w in enumerate(ws) if i not in gone)
    lines = "".join(f"{a},{n},{p}\n" for a, n, p in found)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines.encode()), sha(collapsed))


def test_query_equals_the_plain_version(spark, sf, tmp_path):
    rng = random.Random(9)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 6000]
    docs += [(10_000 + i, rng.choice([" ", "\n", " \t "]).join(f"w{x}é" for x in periodic(rng, rng.randrange(1, 250), 3))) for i in range(150)]
    docs += [(20_000, None), (20_001, ""), (20_002, " \x0b\x0c\x1c "), (20_003, "a " * 23), (20_004, "a " * 24), (20_005, "a b c d e f g h " * 3), (20_006, "a b c d e f g h i " * 2), (None, "x " * 30), (20_004, "a " * 24)]
    spark.createDataFrame([(i, t, "r", 1) for i, t in docs], "doc_id long, text string, runs string, collapsed int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((plain_row(i, t) for i, t in docs), key=repr)


def test_empty_table_and_a_million_equal_words(spark):
    df = spark.createDataFrame([(1, "a " * 1_000_000), (2, " ".join(map(str, range(300_000))))], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]], r["n"]) for r in repeats.collapse(df).selectExpr("doc_id", "n_words", "runs", "length(collapsed) n").collect()}
    assert got[1] == (1_000_000, [(0, 1_000_000, 1)], 1) and got[2][:2] == (300_000, [])
    assert time.time() - began < 60
    assert repeats.collapse(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        repeats.runs([b"a"], 1, 1)
