"""LM scoring with a weighted backoff automaton.

Smoothed n-grams become states; a state without an arc for the next symbol follows its
failure arc, paying the backoff weight, to the state of its shorter suffix.

Every word is a symbol. A bigram or trigram becomes an arc if it occurs ``MIN_COUNT`` times in
the training texts, whatever their number, so that the automaton grows with the corpus. It is
never held whole: texts are packed into pieces; each piece asks for its distinct words,
bigrams and trigrams, sorted by hash and cut into ranges, and every range answers all pieces
that ask it, value by value in the order asked, so that answers need no keys. Counts are
gathered that way first, then the masses of the states. From them each piece builds the states,
arcs and failure arcs that its texts can reach, and each text is traversed once. One more symbol stands for all unseen
words, and the probabilities of all next symbols add up to 1.

Words are known by 64-bit hashes. n-grams are known by the first 40 bits within their range of
some million keys, so that one in some 100,000 may be taken for another; ranges of few keys,
as in tests, see none.

``build`` and ``Automaton`` are the same model held in memory, for small tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import as_bytes, stored, whole_text

END = b""
TAIL = 0
DELTA = 0.1
DISCOUNT = 0.5
MIN_COUNT = 2


def tokens(raw: bytes) -> list[bytes]:
    """Words in lower case (A-Z only), then the end."""
    out = raw.lower().split()
    out.append(END)
    return out


@dataclass
class Automaton:
    """Arcs and failure arcs.

    ``size`` symbols; a state is the tuple of symbols remembered. ``arcs`` holds the log10
    probability of a symbol after a state, ``bow`` the log10 backoff weight of a state, and
    ``unigram`` the log10 probability of each symbol without context. ``memo`` caches, for
    state number and symbol, the state reached and the log10 probability along failure arcs.
    """

    size: int
    unigram: list[float]
    arcs: dict[tuple[int, ...], float]
    bow: dict[tuple[int, ...], float]
    start: tuple[int, ...]
    numbers: dict[tuple[int, ...], int] = field(default_factory=dict)
    states: list[tuple[int, ...]] = field(default_factory=list)
    memo: dict[int, tuple[int, float]] = field(default_factory=dict)

    def number(self, state: tuple[int, ...]) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state]

    def follow(self, at: int, symbol: int) -> tuple[int, float]:
        """Along failure arcs until an arc for ``symbol`` exists, then along it."""
        state, cost = self.states[at], 0.0
        while state and (*state, symbol) not in self.arcs:
            cost += self.bow.get(state, 0.0)
            state = state[1:]
        cost += self.arcs[(*state, symbol)] if state else self.unigram[symbol]
        reached = (*state, symbol)
        while reached and reached not in self.bow:  # the longest suffix that is a state
            reached = reached[1:]
        self.memo[at * self.size + symbol] = out = (self.number(reached), cost)
        return out

    def score(self, symbols: list[int]) -> float:
        """log10 probability of a symbol sequence, in one traversal from left to right."""
        memo, size, total, at = self.memo, self.size, 0.0, self.number(self.start)
        for x in symbols:
            got = memo.get(at * size + x) or self.follow(at, x)
            at = got[0]
            total += got[1]
        return total


def build(symbol_counts: list[int], n: int, v: int, grams: dict[tuple[int, ...], int], starts: int, least: float, discount: float = DISCOUNT) -> Automaton:
    """Interpolated absolute discounting over the retained n-grams, in backoff form.

    ``symbol_counts`` are those of the symbols after TAIL; ``grams`` counts bigrams and
    trigrams, each text being preceded by an end symbol; ``starts`` is the number of texts.
    """
    size, whole = len(symbol_counts) + 1, n + DELTA * (v + 1)
    p1 = [0.0, *((c + DELTA) / whole for c in symbol_counts)]
    p1[TAIL] = max(1.0 - sum(p1), 1e-12)
    end = size - 1
    uni = dict(enumerate([n - sum(symbol_counts), *symbol_counts]))
    kept = {g: c for g, c in grams.items() if c >= least}
    arcs, bow = {}, {}
    prob: dict[tuple[int, ...], float] = {}
    for order in (2, 3):
        by: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for g, c in kept.items():
            if len(g) == order:
                by.setdefault(g[:-1], []).append((g[-1], c))
        for h, nexts in by.items():
            total = (starts if h == (end,) else uni[h[0]]) if order == 2 else grams.get(h, 0)
            total = max(total, sum(c for _, c in nexts))
            gamma = 1.0 - sum(c - discount for _, c in nexts) / total
            bow[h] = math.log10(gamma)
            for x, c in nexts:
                below = p1[x] if order == 2 else backed(h[1:], x, prob, bow, p1)
                prob[(*h, x)] = (c - discount) / total + gamma * below
    arcs = {g: math.log10(p) for g, p in prob.items()}
    start = (end,) if (end,) in bow else ()
    return Automaton(size, [math.log10(p) for p in p1], arcs, bow, start)


def backed(h: tuple[int, ...], x: int, prob: dict, bow: dict, p1: list[float]) -> float:
    if (*h, x) in prob:
        return prob[(*h, x)]
    return 10 ** bow.get(h, 0.0) * p1[x]


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 10 == 0


class Hashes(dict):
    """64-bit hashes of words; all are forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bigram and the trigram that end at each word of ``w`` (word hashes); 0 where there are too few before it."""
    two, three = np.zeros_like(w), np.zeros_like(w)
    two[1:] = mixed(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:] * np.uint64(0xD1B54A32D192ED03))
    three[2:] = mixed(two[1:-1] * np.uint64(0xAEF17502108EF2D9) + w[2:] * np.uint64(0xF1357AEA2E62A9C5))
    return two, three


def places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given sizes."""
    return (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte, the lowest bytes of all first, as many bytes as the largest needs, compressed."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : blob[0]] = planes.T
    return out.view("<u8").ravel()


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def placed(x: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct ones."""
    return np.searchsorted(distinct(x), x).astype(np.int32)


@dataclass
class Ranges:
    """How keys are cut into ``1 << bits`` ranges by their first bits; words keep 64 bits, n-grams 40 within their range."""

    bits: int

    def gram(self, key: np.ndarray) -> np.ndarray:
        drop = np.uint64(max(0, 24 - self.bits))
        return key >> drop << drop

    def bounds(self, keys: np.ndarray) -> np.ndarray:
        """Where each range begins in sorted keys, and the end."""
        firsts = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits) if self.bits else np.zeros(1, np.uint64)
        return np.append(np.searchsorted(keys, firsts), len(keys))

    def closed(self, keys: np.ndarray, gram: bool) -> bytes:
        """Sorted keys of one range as steps from one to the next."""
        drop = np.uint64(max(0, 24 - self.bits) if gram else 0)
        return packed(np.diff(keys >> drop, prepend=np.uint64(0)))

    def opened(self, blob: bytes, gram: bool) -> np.ndarray:
        return np.cumsum(unpacked(blob), dtype=np.uint64) << np.uint64(max(0, 24 - self.bits) if gram else 0)


PIECE = "piece long, bytes long, ids array<long>, held array<boolean>, sizes array<int>, texts binary"
WORD, TWO, THREE = 0, 1, 2
ASK = "part int, piece long, kind int, keys binary, n binary"
ANSWER = "part int, piece long, kind int, found binary, words long, known long"


def packed_texts(rows: DataFrame, piece_bytes: int) -> DataFrame:
    """The texts (columns doc_id, text, held_out) in rows of about ``piece_bytes``, written; a text is never cut."""

    def run(batches):
        made, held, waiting = 0, [], 0
        for b in batches:
            for row in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                held.append(row)
                waiting += len(row[1])
                if waiting >= piece_bytes:
                    yield one(held, made, waiting)
                    made, held, waiting = made + 1, [], 0
        if held:
            yield one(held, made, waiting)

    def one(held, made, waiting):
        ids, texts, out = zip(*held, strict=True)
        blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts).lower())
        values = ((TaskContext.get().partitionId() << 32) + made, waiting, list(ids), list(out), [len(x) for x in texts], blob)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["piece", "bytes", "ids", "held", "sizes", "texts"])

    return stored(rows.select("doc_id", "text", "held_out").mapInArrow(run, PIECE))


@dataclass
class Piece:
    """Word hashes of a piece's texts one after the other, an end before each, and the hashes of the n-grams that end at each word."""

    ids: list
    held: list
    lengths: np.ndarray
    at: np.ndarray
    word: np.ndarray
    two: np.ndarray
    three: np.ndarray

    def keys(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Where words (the first end of a text is none), bigrams or trigrams end, and their hashes."""
        where = np.flatnonzero(self.at >= max(1, kind)).astype(np.int32)
        return where, (self.word, self.two, self.three)[kind][where]


def opened(ids: list, held: list, sizes: list[int], texts: bytes, hashes: Hashes, ranges: Ranges) -> Piece:
    raw = zstandard.ZstdDecompressor().decompress(texts)
    ends = np.cumsum(sizes).tolist()
    lengths, parts, waiting, bytes_waiting = [], [], [], 0
    for begin, end in zip([0, *ends], ends, strict=False):
        waiting.append([END, *tokens(raw[begin:end])])
        bytes_waiting += end - begin
        if bytes_waiting > 1 << 20 or end == ends[-1]:
            lengths += map(len, waiting)
            parts.append(np.fromiter(map(hashes.__getitem__, chain.from_iterable(waiting)), np.uint64))
            waiting, bytes_waiting = [], 0
    if waiting:  # empty texts at the end
        lengths += map(len, waiting)
        parts.append(np.fromiter(map(hashes.__getitem__, chain.from_iterable(waiting)), np.uint64))
    word, lengths = np.concatenate(parts), np.array(lengths)
    two, three = gram_hashes(word)
    return Piece(ids, held, lengths, places(lengths), word, ranges.gram(two), ranges.gram(three))


def asks(pieces: DataFrame, ranges: Ranges) -> DataFrame:
    """For each piece, kind and range: its distinct keys and how often the piece's training texts have them."""

    def run(batches):
        hashes = Hashes()
        for b in batches:
            for row in b.to_pylist():
                p = opened(row["ids"], row["held"], row["sizes"], row["texts"], hashes, ranges)
                training = np.repeat(~np.array(p.held, bool), p.lengths)
                for kind in (WORD, TWO, THREE):
                    where, key = p.keys(kind)
                    yield asked(row["piece"], kind, *counted(key, training[where]), ranges)

    return pieces.select("piece", "ids", "held", "sizes", "texts").mapInArrow(run, ASK)


def counted(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each is counted."""
    known = np.sort(key[counts])
    first = np.flatnonzero(np.concatenate(([True], known[1:] != known[:-1]))) if len(known) else np.zeros(0, np.int64)
    every, n = distinct(np.concatenate((known[first], key[~counts]))), None
    n = np.zeros(len(every), np.int64)
    n[np.searchsorted(every, known[first])] = np.diff(np.append(first, len(known)))
    return every, n


def asked(piece: int, kind: int, keys: np.ndarray, n: np.ndarray, ranges: Ranges) -> pa.RecordBatch:
    at = ranges.bounds(keys)
    some = np.flatnonzero(np.diff(at))
    blobs = [(ranges.closed(keys[at[i] : at[i + 1]], kind > WORD), packed(n[at[i] : at[i + 1]])) for i in some]
    cols = [pa.array(some.astype(np.int32)), pa.array([piece] * len(some), pa.int64()), pa.array([kind] * len(some), pa.int32()), *(pa.array([x[j] for x in blobs], pa.binary()) for j in (0, 1))]
    return pa.RecordBatch.from_arrays(cols, names=["part", "piece", "kind", "keys", "n"])


def answers(asked: DataFrame, ranges: Ranges, value) -> DataFrame:
    """For each piece, kind and range, ``value(kind, sum over all pieces, is this piece the first to ask)`` of every key in the order asked.

    A range is one group. What many pieces ask for is in it once for each piece, so that no
    word or n-gram, however frequent, makes a range large. ``words`` and ``known`` of a range's first
    row have the sum over its words and how many of them are there.
    """

    def run(t: pa.Table) -> pa.Table:
        kinds, pieces, keys, ns = t.column("kind").to_numpy(), t.column("piece").to_numpy(), t.column("keys").to_pylist(), t.column("n").to_pylist()
        found, words, known = [b""] * len(kinds), np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
        for kind in sorted(set(kinds.tolist())):
            rows = np.flatnonzero(kinds == kind)
            rows = rows[np.argsort(pieces[rows])]
            each = [ranges.opened(keys[i], kind > WORD) for i in rows]
            cuts = np.cumsum([len(x) for x in each])
            key, n = np.concatenate(each), np.concatenate([unpacked(ns[i]) for i in rows])
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sums = np.add.reduceat(n[order], first)
            total, owner = np.empty(len(key), np.uint64), np.zeros(len(key), bool)
            total[order] = np.repeat(sums, np.diff(np.append(first, len(key))))
            owner[order[first]] = True
            for i, x in zip(rows, np.split(value(kind, total, owner), cuts[:-1]), strict=True):
                found[i] = packed(x)
            if kind == WORD:
                words[rows[0]], known[rows[0]] = int(sums.sum()), int((sums > 0).sum())
        return pa.table([t.column("part"), t.column("piece"), t.column("kind"), pa.array(found, pa.binary()), pa.array(words), pa.array(known)], names=["part", "piece", "kind", "found", "words", "known"])

    return asked.groupBy("part").applyInArrow(run, ANSWER)


def gathered(t: pa.Table) -> dict[int, np.ndarray]:
    """The answers to one piece by kind, in the order of its sorted keys."""
    rows = sorted(zip(t.column("kind").to_pylist(), t.column("part").to_pylist(), t.column("found").to_pylist(), strict=True))
    out: dict[int, list] = {}
    for kind, _, found in rows:
        out.setdefault(kind, []).append(unpacked(found))
    return {kind: np.concatenate(x) for kind, x in out.items()}


def of_piece(t: pa.Table, ranges: Ranges) -> Piece:
    row = t.select(["ids", "held", "sizes", "texts"]).to_pylist()[0]
    return opened(row["ids"], row["held"], row["sizes"], row["texts"], Hashes(), ranges)


#: Masses are summed in halves, and so need a discount of whole halves.
HALVES = round(2 * DISCOUNT)


def mass_asks(pieces: DataFrame, counts: DataFrame, ranges: Ranges) -> DataFrame:
    """For each piece: its words and repeated bigrams as histories, with the discounted counts of the arcs that it asked for first."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        p, got = of_piece(texts, ranges), gathered(found)
        known = {}
        for kind in (TWO, THREE):
            where, key = p.keys(kind)
            order = np.argsort(key)
            first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(key) else np.zeros(0, np.int64)
            value = got.get(kind, np.zeros(0, np.uint64)).astype(np.int64)
            own = np.flatnonzero(value & 1)
            before = where[order[first[own]]] - 1
            known[kind - 1] = ((p.word, p.two)[kind - TWO][before], 2 * (value[own] >> 1) - HALVES)
        two = distinct(p.keys(TWO)[1])
        two = two[got[TWO] > 1] if len(two) else two
        out = []
        for kind, histories in ((WORD, distinct(p.word)), (TWO, two)):
            key, value = known[kind]
            total = np.bincount(np.searchsorted(histories, key), value, len(histories)).astype(np.int64)
            out.append(asked(texts.column("piece")[0].as_py(), kind, histories, total, ranges))
        return pa.Table.from_batches(out)

    return pieces.groupBy("piece").cogroup(counts.groupBy("piece")).applyInArrow(run, ASK)


@dataclass
class Machine:
    """The part of the automaton that a piece's texts can reach, with the words, bigrams and trigrams numbered that they have.

    States are the empty one, words and bigrams. ``seen`` counts the words in training texts and ``unigram`` has the
    log10 probability of each in the empty state. ``arc2`` and ``arc3`` have that of the arc to the
    last word of each bigram and trigram from the state of the words before it, NaN where there is
    no arc. ``back1`` and ``back2`` have the log10 weight of the failure arc of each word and
    bigram that is a state, NaN of those that are none. The failure arc of a bigram leads to its last word if that
    is a state, else to the empty state. ``word``, ``two`` and ``three`` say what ends at each place of the piece.
    """

    word: np.ndarray
    two: np.ndarray
    three: np.ndarray
    seen: np.ndarray
    unigram: np.ndarray
    arc2: np.ndarray
    arc3: np.ndarray
    back1: np.ndarray
    back2: np.ndarray

    def score(self, begin: int, end: int) -> float:
        """log10 probability of the text between two places, of which the first is the end before it; one traversal that carries the state.

        The state is carried as the weights of its failure arcs: that of the last two words, if they are a
        state, and that of the last word, to which the first leads, if it is one (else NaN).
        """
        word, two, three = self.word[begin:end], self.two[begin:end], self.three[begin:end]
        follow = zip(*(x.tolist() for x in (self.unigram[word], self.arc2[two], self.arc3[three], self.back1[word], self.back2[two])), strict=True)
        fail1, fail2, total = next(follow)[3], math.nan, 0.0
        for free, arc2, arc3, next1, next2 in follow:
            if fail2 == fail2:
                if arc3 == arc3:
                    total += arc3
                    fail1, fail2 = next1, next2
                    continue
                total += fail2
            if fail1 == fail1:
                total += arc2 if arc2 == arc2 else fail1 + free
            else:
                total += free
            fail1, fail2 = next1, next2
        return total


def delivered(p: Piece, got: dict[int, np.ndarray], whole: float) -> Machine:
    """States, arcs and failure arcs of a piece from the answers: counts of its words, bigrams and trigrams, and the masses of its histories.

    The last bigram and trigram number stands for none, at the places of a text that have too few words before them.
    """
    none = np.zeros(0, np.uint64)
    word = placed(p.word)
    seen = got[WORD].astype(np.int64)
    p1 = (seen + DELTA) / whole

    def ending(kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of the n-gram that ends at each place, the counts of those that are arcs (else 0), and a place of each."""
        where, key = p.keys(kind)
        every = distinct(key)
        number = np.full(len(p.word), len(every), np.int32)
        number[where] = np.searchsorted(every, key)
        place = np.zeros(len(every), np.int32)
        place[number[where]] = where
        return number, got.get(kind, none).astype(np.int64) >> 1, place

    def states(mass: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The weight of each failure arc; NaN of what is no state."""
        return np.where(mass > 0, 1.0 - mass / np.maximum(seen, 1), np.nan)

    def arcs(count: np.ndarray, seen: np.ndarray, back: np.ndarray, below: np.ndarray) -> np.ndarray:
        return np.where(count > 0, (count - DISCOUNT) / np.maximum(seen, 1) + back * below, np.nan)

    two, n2, at2 = ending(TWO)
    three, n3, at3 = ending(THREE)
    mass2 = np.zeros(len(n2))
    mass2[n2 > 0] = got.get(TWO + 3, none) / 2
    back1, back2 = states(got[WORD + 3] / 2, seen), states(mass2, n2)
    before = word[at2 - 1]
    arc2 = arcs(n2, seen[before], back1[before], p1[word[at2]])
    last, history = two[at3], two[at3 - 1]
    fail = back1[word[at3 - 1]]
    below = np.where(np.isnan(arc2[last]), np.where(np.isnan(fail), 1.0, fail) * p1[word[at3]], arc2[last])
    arc3 = arcs(n3, n2[history], back2[history], below)
    with np.errstate(divide="ignore"):
        logs = [np.log10(np.append(x, np.nan)) for x in (arc2, arc3, back2)]
        return Machine(word, two, three, seen, np.log10(p1), logs[0], logs[1], np.log10(back1), logs[2])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, block_bytes: int = 8 << 20) -> DataFrame:
    """Score every whole text by counts and an automaton learnt from the ids whose crc32 mod 10 is not 0.

    Texts are packed into pieces of about ``block_bytes`` and keys cut into ranges of about
    as much text, so that the memory of a task does not grow with the table. A text is never
    cut: one of many million words needs memory for itself.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. Null and
    empty texts have one token, the end. A null id counts as held out. Repeated rows are
    learnt and scored as often as they occur. Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).withColumn("held_out", held_out("doc_id"))
    pieces = packed_texts(rows, block_bytes)
    total = pieces.agg(F.sum("bytes")).first()[0] or 0
    ranges = Ranges(max(0, math.ceil(math.log2(max(1, total / block_bytes)))))

    def count(kind: int, total: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return total if kind == WORD else np.where(total >= min_count, 2 * total + owner, 0)

    counts = stored(answers(asks(pieces, ranges), ranges, count))
    sums = counts.agg(F.sum("words").alias("n"), F.sum("known").alias("v")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    whole = n + DELTA * (v + 1)
    masses = answers(mass_asks(pieces, counts, ranges), ranges, lambda kind, total, owner: total)
    both = counts.select("part", "piece", "kind", "found").unionByName(masses.select("part", "piece", (F.col("kind") + 3).alias("kind"), "found"))

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        p, got = of_piece(texts, ranges), gathered(found)
        machine = delivered(p, got, whole)
        starts = np.cumsum(p.lengths) - p.lengths
        scores = [machine.score(begin, begin + n) for begin, n in zip(starts.tolist(), p.lengths.tolist(), strict=True)]
        known, base = (np.add.reduceat(np.where(p.at >= 1, x[machine.word], 0), starts) for x in (machine.seen > 0, machine.unigram))
        cols = (p.ids, p.held, p.lengths - 1, known, np.full(len(starts), n), base, scores)
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return pieces.groupBy("piece").cogroup(both.groupBy("piece")).applyInArrow(run, SCORES)
