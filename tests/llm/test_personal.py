"""Personal data against a plain version: base spans, contexts, and the rounds over patterns and instances."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from tideline.llm import personal, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, hit: str) -> bool:
    n = re.sub(r"[^0-9]", "", hit)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in hit.split(".")), "card": lambda: 13 <= len(n) <= 19 and luhn(n), "phone": lambda: 9 <= len(n) <= 15}[kind]()


def matches(pattern: str, text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, the text from the match before and that to the next one."""
    spans = [m.span() for m in re.finditer(pattern, text)]
    bounds = [0, *(b for _, b in spans)], [*(a for a, _ in spans[1:]), len(text)]
    return [(a, b, text[x:a], text[b:y]) for (a, b), x, y in zip(spans, *bounds, strict=False)]


def plain_words(gap: str) -> list[str]:
    """Letters, marks, digits and : = stay; a label sign is joined to what stands before it."""
    out = ""
    for c in gap.lower():
        if c in ":=":
            out = out.rstrip(" ") + c + " "
        elif unicodedata.category(c)[0] in "LMN":
            out += c
        elif not out.endswith(" "):
            out += " "
    return out.split(" ") if not out else [w for w in out.split(" ") if w]


def patterns_around(left: str, right: str) -> list[str]:
    def word(ws, i):
        ok = -len(ws) <= i < len(ws) and not re.search("[0-9]", ws[i])
        return ws[i] if ok else None

    ws = plain_words(left)
    one, two, behind = word(ws, -1), word(ws, -2), word(plain_words(right), 0)
    out = []
    if one and re.search("[^:=][:=]$", one):
        out.append(f"{one} _")
    if one and two:
        out.append(f"{two} {one} _")
    if one and behind:
        out.append(f"{one} _ {behind}")
    return out


def plain_version(docs: list[tuple], least_members=3, confidence=0.8, accept=0.9, rounds=3, least_length=5):
    base, places = [], []
    for n, (_, text) in enumerate(docs):
        text = text or ""
        own = []
        for kind, pattern in BASE.items():
            for a, b, left, right in matches(pattern, text):
                if valid(kind, text[a:b]):
                    own.append((kind, a, b))
                    places.append((n, True, a, b, text[a:b].strip("@._+-").lower(), patterns_around(left, right)))
        base.append(own)
        for a, b, left, right in matches(r"[A-Za-z0-9@._+-]*[0-9@][A-Za-z0-9@._+-]*", text):
            hit = text[a:b]
            a += len(hit) - len(hit.lstrip("@._+-"))
            hit = hit.strip("@._+-")
            b = a + len(hit)
            if len(hit) >= least_length and re.search("[0-9@]", hit) and not any(x < b and a < y for _, x, y in own):
                places.append((n, False, a, b, hit.lower(), patterns_around(left, right)))
    edges: dict[str, set] = {}
    known = {i for _, seed, _, _, i, ps in places if seed}
    direct = {(p, i) for _, seed, _, _, i, ps in places if seed for p in ps}
    for *_, i, ps in places:
        for p in ps:
            edges.setdefault(p, set()).add(i)
    found: set[str] = set()
    for _ in range(rounds):
        member = lambda p, i: (p, i) in direct or i in found  # noqa: E731,B023
        share = {p: sum(member(p, i) for i in s) / len(s) for p, s in edges.items() if sum(member(p, i) for i in s) >= least_members}
        miss: dict[str, float] = {}
        for p, c in share.items():
            if confidence <= c < 1:
                for i in edges[p]:
                    if not member(p, i):
                        miss[i] = miss.get(i, 0.0) + math.log(1 - c)
        new = {i for i, m in miss.items() if round(1 - math.exp(m), 9) >= accept}
        if not new:
            break
        found |= new
    added = [[(a, b) for n, seed, a, b, i, _ in places if n == k and not seed and i in found] for k in range(len(docs))]
    out = []
    for (doc_id, _), own, more in zip(docs, base, added, strict=True):
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        spans = ",".join(filter(None, [text, ",".join(f"context:{a}:{b}" for a, b in sorted(more))]))
        out.append((doc_id, *(sum(k == kind for k, _, _ in own) for kind in BASE), hashlib.sha256(text.encode()).hexdigest(), spans))
    return out, found


def planted(rng: random.Random, n: int) -> list[tuple]:
    """Texts in which labels and word pairs stand before mails, phones and cards, and before strings that the base patterns don't know."""
    words = "the of and ré über zu mail note line".split()
    mail = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(99)}@h{rng.randrange(9)}.org"
    odd = lambda: rng.choice([f"u{rng.randrange(40)}@intern", f"ID-{rng.randrange(40, 60)}77", f"99{rng.randrange(30)}-00-1234"])
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(25)):
            kind = rng.random()
            if kind < 0.15:
                parts.append(rng.choice(["E-Mail : ", "contact: ", "write to ", "ask "]) + (mail() if rng.random() < 0.93 else odd()))
            elif kind < 0.2:
                parts.append(rng.choice(["order=", "total of ", "part ", "row "]) + odd())
            elif kind < 0.25:
                parts.append(f"call +1 ({rng.randrange(999):03}) 555-{rng.randrange(9999):04} now")
            else:
                parts.append(rng.choice(words) + rng.choice(["", ",", "."]))
        docs.append((i, " ".join(parts)))
    return docs


def odd_texts() -> list[tuple]:
    texts = [
        "a@b.c_d@e.f a@b a@b@c.d x..@y.z %@a.b.c.d-e", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.1.1 0000.0.0.0 .1.2.3.4.", "4111 1111 1111 1111 4111-1111-1111-1111 1 2  3 4111  1111 41111111111111111111",
        "+1 (017) 555-7713 +1 2 +123456789 +49 30 1234567 89 12 ++1 234 567 890( +1((((((((", "é漢 a@b.c 😀 1.2.3.4 \x00 x@y.z", "-a-b-1-- @@1@@ _12345_ 12345. .12345", "Tel.:+15550001111 mail=q@r.st;id:=55555", None, "", " \n\t",
    ]
    return [(1000 + i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("options", [{}, {"least_members": 2, "confidence": 0.5, "accept": 0.6, "rounds": 5}])
def test_same_as_the_plain_version(spark, options):
    docs = planted(random.Random(3), 300) + odd_texts() + [(1, "contact: a1@b.cd"), (1, "contact: a1@b.cd"), (None, "ask 12345")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, base string, __row int").repartition(3)
    want, found = plain_version(docs, **options)
    assert found
    got = [tuple(r) for r in personal.report(df, **options).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_query_over_documents(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op12_personal_data(spark, sf).collect()]
    assert sorted(got) == sorted(plain_version(docs)[0])


def test_labels_discover_unseen_identifiers(spark):
    texts = [f"Customer {i} wrote. Mail: user{i}@site.org, thanks." for i in range(20)] + ["Mail: jane.doe77@intranet, thanks", "Pages: 12345, thanks", "see jane.doe77@intranet"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(personal.KINDS[s["kind"]], s["start"], s["end"]) for s in r["added"]] for r in personal.find(df).collect()}
    assert got[20] == [("context", 6, 25)] and got[22] == [("context", 4, 23)]
    assert not any(got[i] for i in range(20)) and not got[21]


def test_odd_tables_and_long_texts_take_time_in_proportion(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert personal.report(df).collect() == []
    n = 200_000
    texts = ["a" * n, "1" * n, "1 " * n, "a." * n, "1." * n, "a@" * n, "a@b" * n, "-a" * n, "+1 " * n, "+1((" * n, "a@b.c " * (n // 4), "mail: 12345 " * (n // 8), ": " * n, "=" * n, "x@" + "y-" * n, "x" * n + "@y.z"]
    long = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    began = time.time()
    assert personal.report(long).select(F.sum("n_email")).first()[0] > 0
    assert time.time() - began < 120
