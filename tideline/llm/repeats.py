"""Periodic runs of words: linear-time runs on an ordered alphabet, from Lyndon arrays.

The method of Ellert and Fischer. For an order of the symbols, the next smaller suffix of each
place gives the longest Lyndon word that begins there. Every run (a maximal stretch with
smallest period p and length 2 p or more) has such a word as its root, for the order or for its
reverse. Suffixes are compared symbol by symbol, from left to right, and the farthest
extension that was ever matched is kept: what lies inside its copy was compared before and is
looked up, so that symbols are matched anew only beyond it. There is no suffix array or tree and
no fingerprint.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import as_bytes, whole_text

FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def next_smaller(s: list[int], n: int) -> tuple[list[int], list[int]]:
    """For each place the start of the next smaller suffix, and how far both suffixes agree.

    ``s`` has ``n`` symbols and a last one that is smaller than all. The places whose next smaller
    suffix isn't found yet form a chain: the one before ``r``, its previous smaller one, and so
    on; ``r`` is compared along it. ``far`` is the farthest place matched, and (``r0 - gap``,
    ``r0``) the last pair whose agreement reached it.

    * A pair inside the copy was compared ``gap`` to the left. Its agreement is looked up, and
      symbols are matched from ``far`` on if it reaches that place.
    * After a pair (x, r) that reached ``far``, the next of the chain, y, agrees with x for as far
      as is known. If that is shorter than (x, r), y is smaller than r; if it is longer, y is
      larger and agrees with r as far as x does; if it is equal, symbols are matched from ``far`` on.

    No chain leads from inside the copy to a place before ``r0``: it would have to pass a place
    whose copy was finished before.
    """
    nss, agree = [n] * n, [0] * n  # next smaller suffix
    pss, shared = [-1] * n, [0] * n  # previous smaller suffix
    r0 = far = gap = 0
    for r in range(1, n):
        at = r - 1
        if r >= far:  # nothing is known of this place; most pairs differ in their first symbol
            c = s[r]
            while at >= 0 and s[at] > c:
                nss[at] = r
                at = pss[at]
            if at < 0:
                continue
            if s[at] < c:
                pss[r] = at
                continue
            m, scan, reached = 0, True, True
        else:
            a, b = at - gap, r - gap
            m = shared[b] if pss[b] == a else agree[a]
            scan = reached = r + m >= far
            if scan:
                m = far - r
        while True:
            if scan:
                a, b = at + m, r + m
                while s[a] == s[b]:
                    a += 1
                    b += 1
                m, far, r0, gap = b - r, b, r, r - at
            if s[at + m] < s[r + m]:
                pss[r], shared[r] = at, m
                break
            nss[at], agree[at] = r, m
            last, at = at, pss[at]
            if at < 0:
                break
            if reached:
                e = shared[last]
                if e < m:
                    pss[r], shared[r] = at, e
                    break
                scan = e == m
            else:
                a, b = at - gap, r - gap
                m = shared[b] if pss[b] == a else agree[a]
                scan = reached = r + m >= far
                if scan:
                    m = far - r
    return nss, agree


def roots(s: list[int], n: int, least_length: int, least_exponent: int, out: set[tuple[int, int, int]]) -> None:
    """Adds the runs (start, length, period) whose roots are smallest in this order of symbols.

    A root that stands one period behind another of the same run is left out. The first root of a
    run begins less than a period behind the run's start, so that matching to the left takes less
    than a period for each run.
    """
    nss, agree = next_smaller(s, n)
    for i in [i for i, m in enumerate(agree) if m]:
        j, m = nss[i], agree[i]
        p = j - i
        least = max(least_length, least_exponent * p)
        if m + 2 * p <= least or (i >= p and nss[i - p] == i and agree[i - p] == m + p):
            continue
        a, b = i - 1, j - 1
        while a >= 0 and s[a] == s[b]:
            a -= 1
            b -= 1
        if j + m - a - 1 >= least:
            out.add((a + 1, j + m - a - 1, p))


def runs(words: list[bytes], least_length: int = 24, least_exponent: int = 3) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) that are long enough, by start, then period.

    Words are numbered in the order of their appearance, which is the order of the alphabet.
    """
    if least_exponent < 2:
        raise ValueError("runs have an exponent of 2 at least")
    n, number = len(words), {}
    s = [number.setdefault(w, len(number) + 1) for w in words]
    out: set[tuple[int, int, int]] = set()
    roots([*s, 0], n, least_length, least_exponent, out)
    roots([*(-x for x in s), -len(number) - 1], n, least_length, least_exponent, out)
    return sorted(out)


def kept(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    out, at, end = [], 0, 0
    for start, stop in sorted((a + p, a + n) for a, n, p in found):
        if stop > end:
            out += words[at : max(start, at)]
            at = end = stop
    return out + words[at:]


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 24, least_exponent: int = 3, slice_bytes: int = 1 << 24) -> DataFrame:
    """Periodic runs of words in every whole text, and the text with each run cut to its first period.

    Returns doc_id, n_words, runs (start, length, period in words from 0; by start, then period) of
    at least ``least_length`` words and ``least_exponent`` periods, and collapsed: the kept words
    joined by one space. A word is dropped if any run holds it behind its first period. One narrow
    pass, one row per input row; time and memory grow with the length of a text, whatever repeats
    in it.

    Words are what ASCII white space parts. Null and empty texts have no words, no runs and an
    empty result. Runs may overlap, and runs of equal places but other periods are listed each.
    Repeated rows and ids, null ids and other columns change nothing. Bytes that are no UTF-8
    become U+FFFD in the result. Results leave in slices of about ``slice_bytes``.
    """
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), spans, pa.string()), strict=True)], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches):
        for b in batches:
            rows, held = [], 0
            for doc_id, raw in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                words = raw.split()
                found = runs(words, least_length, least_exponent)
                text = b" ".join(kept(words, found) if found else words)
                rows.append((doc_id, len(words), [dict(zip(("start", "length", "period"), x, strict=True)) for x in found], text.decode("utf-8", "replace")))
                held += len(raw)
                if held > slice_bytes:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, FOUND)


def strongest(found: Column) -> Column:
    """The run with the greatest length over period, compared exactly; of equals the first. Null if there is none."""
    more = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(found, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, x: F.when(more(best, x), x).otherwise(best))
