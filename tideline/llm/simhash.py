"""SimHash near-deduplication through a segment-popcount embedding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import as_bytes, stored, whole_text

#: Fingerprints are cut into 32 segments of two bits; the embedding is their bit counts (0, 1 or 2).
ODD_BITS = np.uint64(0x5555555555555555)
HALF = 16
#: A cell of more fingerprints than this is divided by the other half before pairs are compared.
DENSE = 4096


def fingerprint(raw: bytes, words: int = 4) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 if there are no words."""
    tokens = raw.lower().split()  # of bytes: lowers A-Z only, splits at \\x20 and \\x09-\\x0D only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    last = min(words, len(tokens)) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - last]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[last:].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(h)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id, key (a hash of id and text) and fp (the fingerprint's bits as a signed long) of every whole text."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in as_bytes(b.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=["doc_id", "key", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id long, key long, fp long")


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), whole_text(text_col))


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments, packed two bits each. Their Manhattan distance never exceeds the Hamming distance."""
    return fp - ((fp >> np.uint64(1)) & ODD_BITS)


def grid_keys(cells: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and lattice points within Manhattan distance 1 of each packed cell of ``segments`` coordinates."""
    rows, keys = [np.arange(len(cells))], [cells]
    for j in range(segments):
        step = np.uint64(1 << 2 * j)
        value = (cells >> np.uint64(2 * j)) & np.uint64(3)
        for ok, moved in ((value < 2, cells + step), (value > 0, cells - step)):
            rows.append(np.flatnonzero(ok))
            keys.append(moved[ok])
    return np.concatenate(rows), np.concatenate(keys)


def halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint numbers and grid keys of both halves.

    Two fingerprints at Hamming distance 4 or less are at Manhattan distance 2 or less in one
    half, so that a lattice point of that half is within distance 1 of both.
    """
    v = embed(fp)
    low, high = grid_keys(v & np.uint64(0xFFFFFFFF), HALF), grid_keys(v >> np.uint64(32), HALF)
    return np.concatenate((low[0], high[0])), np.concatenate((low[1], high[1] | np.uint64(1 << 32)))


def walk(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links in one cell: each reached fingerprint leaves the rest, so no pair is made twice."""
    rest = fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                front.extend(found)
                yield np.full(len(found), x, np.uint64), found


def links_in_cell(fps: np.ndarray, high: bool, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links in a cell of the high or low half.

    A crowded cell is regrouped by the quarters of the other half first: of at most 4 differing
    bits there, one quarter has 2 or fewer, and its grid points within distance 1 meet.
    """
    if len(fps) <= DENSE:
        yield from walk(fps, radius)
        return
    v = embed(fps)
    for quarter in (0, 1) if high else (2, 3):
        rows, keys = grid_keys((v >> np.uint64(16 * quarter)) & np.uint64(0xFFFF), 8)
        order = np.argsort(keys, kind="stable")
        rows, keys = rows[order], keys[order]
        for part in np.split(rows, np.flatnonzero(keys[1:] != keys[:-1]) + 1):
            if len(part) > 1:
                yield from walk(fps[part], radius)


def links_in_run(key: np.ndarray, fp: np.ndarray, radius: int, small: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among fingerprints with equal keys; ``key`` is sorted."""
    edge = np.flatnonzero(key[1:] != key[:-1]) + 1
    starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
    size = ends - starts
    a, b = [], []
    for k in np.flatnonzero(size > small).tolist():
        for x, y in links_in_cell(fp[starts[k] : ends[k]], bool(int(key[starts[k]]) >> 32 & 1), radius):
            a.append(x)
            b.append(y)
    left = np.repeat(np.where(size > small, 0, ends), size) - np.arange(len(key)) - 1  # how many follow in the run
    at = np.flatnonzero(left > 0)
    for shift in range(1, small):
        at = at[left[at] >= shift]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= radius]
        a.append(fp[near])
        b.append(fp[near + shift])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64),) * 2


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a < b, longs) that connect all pairs of distinct fingerprints at Hamming distance ``radius`` (4 at most) or less.

    Each task unites the links it has verified and sends one edge for each of their
    fingerprints, to the smallest that it is connected with, rather than all pairs. The
    fingerprints of a cell of more than ``DENSE`` are dealt to finer cells first: of at most 4
    differing bits in the other half, one quarter of it has 2 or fewer, and its grid points
    within distance 1 meet.
    """
    if not 0 <= radius <= 4:
        raise ValueError("radius must be from 0 to 4")

    def emit(batches):
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            row, key = halves(fp)
            for at in range(0, len(row), 200_000):
                cut = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[cut].view(np.int64)), pa.array(fp[row[cut]].view(np.int64))], names=["key", "fp"])

    def verify(batches):
        held_key, held_fp, united = np.zeros(0, np.int64), np.zeros(0, np.uint64), Forest()
        for last, batch in with_end(batches):
            if batch is not None:
                held_key = np.concatenate((held_key, np.asarray(batch.column(0))))
                held_fp = np.concatenate((held_fp, np.asarray(batch.column(1)).view(np.uint64)))
            whole = len(held_key) if last else int(np.searchsorted(held_key, held_key[-1])) if len(held_key) else 0
            if whole:
                a, b = links_in_run(held_key[:whole], held_fp[:whole], radius)
                held_key, held_fp = held_key[whole:], held_fp[whole:]
                pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1).view(np.int64)
                for x, y in zip(*pairs.tolist(), strict=True):
                    united.unite(x, y)
                if len(united) > 200_000:
                    yield united.stars()
                    united = Forest()
        yield united.stars()

    def refine(batches):
        for batch in batches:
            key, fp = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
            v, high = embed(fp), key >> 32 == 1
            for half in (0, 1):
                own = np.flatnonzero(high == (half == 1))
                for quarter in (0, 1) if half else (2, 3):
                    rows, place = grid_keys((v[own] >> np.uint64(16 * quarter)) & np.uint64(0xFFFF), 8)
                    finer = key[own][rows] | (quarter + 1 << 33) | place.astype(np.int64) << 36
                    yield pa.RecordBatch.from_arrays([pa.array(finer), pa.array(fp[own][rows].view(np.int64))], names=["key", "fp"])

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Fingerprints are few bytes, their grid points some fifty times as many: dealt out before, so that no task makes most of them.
    keyed = stored(prints.select("fp").distinct().repartition(n, F.xxhash64("fp")).mapInArrow(emit, "key long, fp long"))
    crowded = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > DENSE).select("key"))
    if not crowded.isEmpty():
        keyed = keyed.join(crowded, "key", "left_anti").unionByName(keyed.join(crowded, "key", "left_semi").mapInArrow(refine, "key long, fp long"))
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long").distinct()


class Forest:
    """Disjoint sets of numbers, the smallest of each set being its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def __len__(self) -> int:
        return len(self.up)

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def unite(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def stars(self) -> pa.RecordBatch:
        nodes = [x for x in self.up if self.root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([self.up[x] for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])


def with_end(batches):
    """(is it the end, batch) for every batch, then (True, None)."""
    for b in batches:
        yield False, b
    yield True, None


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node that has an edge.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends
    by doubling, and replaces the ends of all edges by their roots; edges within a root and repeated ones go, so
    that the edges shrink from round to round until none is left. Minima are combined before
    the shuffle, and each round is written to the shared folder.
    """
    now, total = stored(edges.select("a", "b").distinct()), None
    while total is None or not now.isEmpty():
        ends = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        while True:
            step = stored(followed(up.withColumn("old", F.col("root")), "root", up))
            up = step.select("node", "root")
            if step.where("root <> old").isEmpty():
                break
        total = up if total is None else stored(followed(total, "root", up))
        moved = followed(followed(now, "a", up), "b", up).where("a <> b")
        now = stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return total


def followed(rows: DataFrame, column: str, up: DataFrame) -> DataFrame:
    """``rows`` with the nodes of a column replaced by their roots."""
    steps = up.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    joined = rows.join(steps, F.col(column) == F.col("__node"), "left")
    return joined.select(*[F.coalesce("__root", column).alias(c) if c == column else F.col(c) for c in rows.columns])


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, key, fp, root (the smallest fingerprint of the component) and component_id of every row.

    What is joined is written before, so that Spark can split the rows of a large component or a frequent fingerprint.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    root = components(links(prints, radius))
    named = stored(first.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    smallest = stored(named.groupBy("root").agg(F.min("first_id").alias("component_id")))
    of_print = stored(named.select("fp", "root").join(smallest, "root"))
    return prints.join(of_print, "fp").select("doc_id", "key", "fp", "root", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """Fingerprint and component of every row.

    Texts are reduced to distinct fingerprints first, so that copies never form pairs. Grid
    cells of the popcount embedding give candidates; exact Hamming distances decide. Returns
    doc_id, fp (long) and component_id, the smallest doc_id reachable over links. Texts
    without words, null ones too, have fingerprint 0 and link like any other. Rows of null id
    take part in links but name no component unless all its ids are null. Repeated rows and
    extra columns do no harm. Long texts are fingerprinted whole.
    """
    return grouped(docs, id_col, text_col, words, radius).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One text of each component: of the rows whose id names it, or of all if no row has an id, the one of the smallest key.

    Rows that are equal in id and text stay together.
    """
    groups = grouped(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = groups.groupBy("root").agg(F.min("key").alias("__kept_key")).select("__kept_key")
    return docs.join(kept, row_key(id_col, text_col) == F.col("__kept_key"), "left_semi")
