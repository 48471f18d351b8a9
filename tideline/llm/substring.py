"""Substring deduplication with prefix-partitioned suffix trees.

A window is ``width`` consecutive words, and the suffix at its start matters to that depth. What
suffixes are grouped by varies in length: at first the window's anchor, the ``gram``-word
sequence in it with the smallest hash (the last of equals). Equal windows have equal anchors
at equal places, so that a group holds all suffixes that could share ``width`` words, and
groups of one document are left out before any text is moved. Neighbouring windows of one
anchor travel as one context. Equal contexts are one leaf: all but those of its smallest
document are repeats, and only the smallest goes on. Groups of several leaves that fit a task
are sorted as a suffix array; runs of neighbours whose common prefix is ``width`` words long are
the deep nodes of the tree, the repeats. Groups that are too large get longer keys: the
windows whose anchor lies at one of the places a to b share the words around it, all but
b - a of the window's; halving the places lengthens what is shared and splits the group, down
to whole windows, and each step drops what has become the only one of its kind.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import as_bytes, stored, whole_text

LARGEST = (1 << 63) - 1
STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(words: list[bytes], gram: int) -> np.ndarray:
    """Mixed 64-bit hash of every run of ``gram`` words."""
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = len(w) - gram + 1
    h = np.zeros(m, np.uint64)
    for j in range(gram):
        h = h * STEP + w[j : j + m]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def last_least(h: np.ndarray, span: int) -> np.ndarray:
    """Place of the least value, the last of equals, in every run of ``span`` values."""
    starts = len(h) - span + 1
    out = np.empty(starts, np.int64)
    for a in range(0, starts, 1 << 14):
        b = min(a + (1 << 14), starts)
        out[a:b] = span - 1 - np.lib.stride_tricks.sliding_window_view(h[a : b + span - 1], span)[:, ::-1].argmin(axis=1) + np.arange(a, b)
    return out


def anchors(words: list[bytes], width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every anchor, and the first and last start of the neighbouring windows that have it.

    In a run of one word every window has an anchor of its own place but the same hash, and they are taken together.
    """
    if len(words) < width:
        return (np.zeros(0, np.int64),) * 3
    h = gram_hashes(words, gram)
    own = h[last_least(h, width - gram + 1)]
    lo = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
    return own[lo].view(np.int64), lo, np.concatenate((lo[1:], [len(own)])) - 1


class Words:
    """A text's words joined by single spaces, of which runs of words are slices."""

    def __init__(self, words: list[bytes]):
        self.joined = b" ".join(words)
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1

    def run(self, first: int, n: int) -> bytes:
        return self.joined[self.ends[first - 1] + 1 if first else 0 : self.ends[first + n - 1]]


def common(a: bytes, b: bytes) -> int:
    """How many words two equally long sequences of 4-byte word numbers have in common from the start."""
    return (8 * len(a) - (int.from_bytes(a) ^ int.from_bytes(b)).bit_length()) // 32


def repeats(run: list[tuple[int, int, int, bytes]], width: int) -> list[tuple[int, int, int, int]]:
    """Window ranges (doc, key, first, last) of one group whose words also start in a smaller doc.

    ``run`` has (doc, key, first window, context). Equal contexts are one leaf: all but those of
    its smallest doc are repeats throughout. The leaves' suffixes are sorted, cut at ``width``
    words; the common prefix of each with the one before tells the nodes. A node of depth
    ``width`` is a maximal run of suffixes, and its smallest doc is its witness.
    """
    leaves: dict[bytes, list[tuple[int, int, int]]] = {}
    for doc, key, first, context in run:
        leaves.setdefault(context, []).append((doc, key, first))
    out, suffixes = [], []
    numbers: dict[bytes, int] = {}
    for n, (context, members) in enumerate(leaves.items()):
        words = context.split(b" ")
        least, windows = min(members)[0], len(words) - width + 1
        out += [(doc, key, first, first + windows - 1) for doc, key, first in members if doc > least]
        if len(leaves) > 1:
            row = np.array([numbers.setdefault(w, len(numbers)) for w in words], ">u4").tobytes()
            suffixes += [(row[4 * i : 4 * (i + width)], least, n, i) for i in range(windows)]
    suffixes.sort()
    flagged: dict[int, list[int]] = {}
    at = 0
    while at < len(suffixes):
        end = at + 1
        while end < len(suffixes) and common(suffixes[end - 1][0], suffixes[end][0]) >= width:
            end += 1
        witness = suffixes[at][1]  # suffixes of one node are sorted by doc
        for _, doc, n, i in suffixes[at + 1 : end]:
            if doc > witness:
                flagged.setdefault(n, []).append(i)
        at = end
    members = list(leaves.values())
    for n, found in flagged.items():
        least = min(members[n])[0]
        out += [(doc, key, first + a, first + b) for doc, key, first in members[n] if doc == least for a, b in runs(found)]
    return out


def runs(found: list[int]) -> list[tuple[int, int]]:
    """First and last of the runs of neighbouring numbers."""
    x = np.sort(np.array(found))
    cut = np.flatnonzero(np.diff(x) > 1)
    return list(zip(x[np.concatenate(([0], cut + 1))].tolist(), x[np.concatenate((cut, [len(x) - 1]))].tolist(), strict=True))


RANGES = "doc long, key long, first int, last int"


def range_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc", "key", "first", "last"])


def trees(contexts: DataFrame, width: int) -> DataFrame:
    """Repeated window ranges of groups that fit a task; groups come sorted and are held one at a time."""

    def run(batches):
        held, now, rows = None, {}, []
        for b in batches:
            cols = [c.to_pylist() for c in b.columns[:4]]
            for k, *rest, context in zip(*cols, as_bytes(b.column(4)), strict=True):
                if k != held:
                    if len(now) > 1:
                        rows += repeats(list(now), width)
                    held, now = k, {}
                now[*rest, context] = None  # rows that repeat are held once
            if len(rows) > 50_000:
                yield range_batch(rows)
                rows = []
        if len(now) > 1:
            rows += repeats(list(now), width)
        yield range_batch(rows)

    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.select("k", "doc", "key", "first", "context").repartition(n, "k").sortWithinPartitions("k").mapInArrow(run, RANGES)


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` (k, g, doc, first, last and more) of the groups k with several docs, written.

    With first_doc (the smallest doc of the group), least (that of the leaf g), leaves and
    windows of the group. The joins' sides are written tables, merged after a shuffle at every
    size, so that Spark can split the rows of a frequent key.
    """
    shared = stored(rows.groupBy("k").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("most")).where("first_doc < most").drop("most"))
    near = stored(rows.join(shared.hint("merge"), "k"))
    leaves = stored(near.groupBy("k", "g").agg(F.min("doc").alias("least"), F.max(F.col("last") - F.col("first") + 1).alias("w")))
    sizes = stored(leaves.groupBy("k").agg(F.count(F.lit(1)).alias("leaves"), F.sum("w").alias("windows")))
    known = stored(leaves.drop("w").join(sizes.hint("merge"), "k"))
    return stored(near.join(known.hint("merge"), ["k", "g"]))


def repeated(rows: DataFrame, what: str) -> DataFrame:
    return rows.where(what).select("doc", "key", "first", "last")


LEVEL = "k long, g long, a int, b int, doc long, key long, first int, last int, context binary"


def halved(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """Each context cut into the windows whose anchor lies in the first and in the second half of the places a to b.

    Their key is the hash of the words that all windows with an anchor at these places share.
    """

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for low, high, doc, key, first, context in zip(*(b.column(i).to_pylist() for i in range(5)), as_bytes(b.column(5)), strict=True):
                words = context.split(b" ")
                text, at = Words(words), last_least(gram_hashes(words, gram), width - gram + 1)
                place = at - np.arange(len(at))
                middle = (low + high) // 2
                for a, z in ((low, middle), (middle + 1, high)):
                    inside = np.flatnonzero((place >= a) & (place <= z))
                    keys = [xxhash.xxh3_64_intdigest(text.run(c, width - (z - a)), 64 * a + z) for c in (at[inside] - a).tolist()]
                    begin = 0
                    for end in range(1, len(inside) + 1):
                        if end == len(inside) or inside[end] != inside[end - 1] + 1 or keys[end] != keys[begin]:
                            i, n = int(inside[begin]), end - begin
                            own = text.run(i, width + n - 1)
                            out.append((keys[begin], xxhash.xxh3_64_intdigest(own), a, z, doc, key, first + i, first + i + n - 1, own))
                            begin = end
            cols = list(zip(*out, strict=True)) if out else [()] * 9
            signed = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[:2]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([*signed, *(pa.array(c, k) for c, k in zip(cols[2:], kinds, strict=True))], names=[x.split()[0] for x in LEVEL.split(", ")])

    return rows.select("a", "b", "doc", "key", "first", "context").mapInArrow(run, LEVEL)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, gram: int = 8, largest_group: int = 2048, most_nodes: int = 200_000) -> DataFrame:
    """Remove words covered by a window whose words also start in a document of smaller id.

    Returns doc_id, n_words, n_removed, kept (the kept words joined by one space) and
    kept_sha256. Words are those of the input, unchanged; windows are judged on the input.
    Null and empty texts have no words. A null id counts as the largest. Repeats within one id
    remove nothing. Repeated rows get the same result each, in time that grows with their number; rows of one id with different
    texts are judged row by row against smaller ids. Extra columns are ignored. Long texts
    are whole rows, and runs of one word are one context.

    Groups of more than ``largest_group`` leaves or ``most_nodes`` suffixes are split further;
    the result does not depend on either.
    """
    text = whole_text(text_col)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LARGEST)).alias("doc"), F.xxhash64(F.col(id_col).cast("long"), text).alias("key"), text.alias("text"))

    def find(batches):
        for b in batches:
            docs_, keys, found = b.column(0).to_numpy(), b.column(1).to_numpy(), []
            for raw in as_bytes(b.column(2)):
                words = raw.split()
                h, lo, hi = anchors(words, width, gram)
                whole = Words(words) if len(h) else None
                g = np.array([xxhash.xxh3_64_intdigest(whole.run(a, z - a + width)) for a, z in zip(lo.tolist(), hi.tolist(), strict=True)], np.uint64)
                found.append((h, g.view(np.int64), lo, hi))
            n = [len(f[0]) for f in found]
            h, g, lo, hi = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(g), pa.array(np.repeat(docs_, n)), pa.array(np.repeat(keys, n)), *(pa.array(x.astype(np.int32)) for x in (lo, hi))],
                names=["k", "g", "doc", "key", "first", "last"],
            )

    def cut(batches):
        for b in batches:
            out: list[tuple] = []
            for doc, key, raw, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
                whole = Words(raw.split())
                out += [(f["k"], doc, key, f["first"], f["crowded"], whole.run(f["first"], f["last"] - f["first"] + width)) for f in found]
                if len(out) > 20_000:
                    yield batch(out)
                    out = []
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = zip(*out, strict=True) if out else ((),) * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["k", "doc", "key", "first", "crowded", "context"])

    def contexts(rows: DataFrame) -> DataFrame:
        own = rows.groupBy("doc", "key").agg(F.collect_set(F.struct("k", "first", "last", crowded.alias("crowded"))).alias("anchors"))
        return texts.join(own, ["doc", "key"]).select("doc", "key", "text", "anchors").mapInArrow(cut, "k long, doc long, key long, first int, crowded boolean, context binary")

    crowded = (F.col("leaves") > largest_group) | (F.col("windows") > most_nodes)
    places = judged(stored(texts.mapInArrow(find, "k long, g long, doc long, key long, first int, last int")))
    ranges = repeated(places, "doc > least")
    going = places.where("doc = least and leaves > 1")
    if going.where(crowded).isEmpty():
        ranges = ranges.unionByName(trees(contexts(going), width))
    else:
        sent = stored(contexts(going))
        ranges = ranges.unionByName(trees(sent.where(~F.col("crowded")), width))
        level = sent.where("crowded").select(F.lit(0).alias("a"), F.lit(width - gram).alias("b"), "doc", "key", "first", "context")
        while not level.isEmpty():
            step = judged(stored(halved(level, width, gram)))
            ranges = ranges.unionByName(repeated(step, "case when a = b then doc > first_doc else doc > least end"))
            going = step.where("a < b and doc = least and leaves > 1")
            ranges = ranges.unionByName(trees(going.where(~crowded), width))
            level = going.where(crowded)
    # Repeated rows leave the same ranges; a set of them is no longer than the text has windows.
    gathered = ranges.groupBy("doc", "key").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))

    def remove(batches):
        for b in batches:
            out = []
            for raw, found in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = raw.split()
                change = np.zeros(len(words) + 1, np.int64)
                for r in found or ():
                    change[r["first"]] += 1
                    change[r["last"] + width] -= 1
                covered = np.cumsum(change[:-1]) > 0
                kept = b" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c) if found else b" ".join(words)
                out.append((len(words), int(covered.sum()), kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()))
            cols = zip(*out, strict=True) if out else ((),) * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc", "n_words", "n_removed", "kept", "kept_sha256"])

    done = texts.join(gathered, ["doc", "key"], "left").select("doc", "text", "ranges").mapInArrow(remove, "doc long, n_words long, n_removed long, kept string, kept_sha256 string")
    return done.select(F.when(F.col("doc") != LARGEST, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept", "kept_sha256")
