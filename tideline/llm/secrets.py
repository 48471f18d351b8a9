"""Secret scans: patterns, and character Markov models of random strings against ordinary identifiers.

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import whole_text

#: The base patterns, the group that is measured and its least length.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (r"[0-9a-f]{24,}", 0, 24)}
#: Strings that the Markov models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET)


#: Running sums are taken in blocks of so many values: a fold copies what it has gathered at each step.
BLOCK = 64


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, although it stands in an inner function."""
    return F.get(F.transform(F.array(value), use), 0)


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each whole number of an array, 0 and all numbers before it added up by ``add`` (a sum or a maximum)."""

    def prefixes(numbers: Column, zero: Column) -> Column:
        step = lambda acc, x: F.struct(add(acc["sum"], x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
        return F.aggregate(numbers, F.struct(zero.alias("sum"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def block(v: Column, b: Column) -> Column:
        return F.slice(v, b * BLOCK + 1, F.lit(BLOCK))

    def of(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: F.aggregate(block(v, b), F.lit(0), add))
        return F.flatten(F.zip_with(blocks, prefixes(sums, F.lit(0)), lambda b, before: prefixes(block(v, b), before)))

    return bound(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<int>")))


SPANS = "array<struct<start:int,end:int,hit:string,size:int>>"


def found(text: Column, pattern: str, group: int, least: int) -> Column:
    """Start, end (code points) and text of the leftmost non-overlapping matches whose group is long enough.

    Splitting by the pattern gives the gaps between matches; summing the lengths of gaps and
    matches from left to right gives the places.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(hits), F.lit(1)))
    parts = F.transform(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), measured.alias("measured")),
        lambda p: F.struct(F.char_length(p["gap"]).alias("gap"), F.char_length(p["hit"]).alias("n"), p["hit"].alias("hit"), F.char_length(p["measured"]).alias("size")),
    )

    def placed_parts(p: Column) -> Column:
        starts = running(F.transform(p, lambda x: x["gap"] + x["n"]), lambda a, b: a + b)
        return F.zip_with(p, starts, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), x["hit"].alias("hit"), x["size"].alias("size")))

    return F.when(F.size(hits) > 0, F.filter(bound(parts, placed_parts), lambda s: s["size"] >= least)).otherwise(F.array().cast(SPANS))


def untouched(candidates: Column, base: Column) -> Column:
    """Candidates that no base span overlaps.

    Candidates and base spans are sorted by their starts. Candidates don't overlap each other, so
    that a candidate is touched if a base span before it reaches into it, or if the next
    span is a base span that begins in it.
    """
    both = F.array_sort(F.concat(
        F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["hit"].alias("hit"))),
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(None).cast("string").alias("hit"))),
    ))

    def free(m: Column) -> Column:
        reach = running(F.transform(m, lambda x: F.when(x["hit"].isNull(), x["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        rows = F.arrays_zip(m.alias("own"), F.slice(m, 2, F.size(m)).alias("next"), reach.alias("reach"))
        into = lambda r: r["next"].isNotNull() & r["next"]["hit"].isNull() & (r["next"]["start"] < r["own"]["end"])
        return F.transform(F.filter(rows, lambda r: r["own"]["hit"].isNotNull() & (r["reach"] <= r["own"]["start"]) & ~into(r)), lambda r: r["own"])

    return bound(both, free)


def ordinary_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """w and next: every word of every text with the one behind it (``id`` behind the last); what the base patterns find is left out of the texts."""
    words = docs.select(F.regexp_extract_all(F.regexp_replace(whole_text(text_col), f"{ASSIGN}|{ACCESS}|[0-9a-f]{{24,}}", " "), F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w"))
    behind = F.concat(F.slice("w", 2, F.size("w")), F.array(F.lit("id")))
    # An inner explode would be given a test for empty arrays below it, which matches the patterns once more.
    return words.select(F.explode_outer(F.arrays_zip(F.col("w").alias("w"), behind.alias("next"))).alias("z")).select("z.w", "z.next").where("w IS NOT NULL")


def joined() -> Column:
    """Neighbouring words joined as identifiers are."""
    return F.concat_ws("_", "w", "next")


def made_strings(spark: SparkSession, strings: int = 4000) -> DataFrame:
    """label and s: ``strings`` digests written in hexadecimal, base 64, lower-case and upper-case base 36 (random), and as many decimal numbers (ordinary)."""
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    packed = F.base64(F.unhex(digest))
    made = spark.range(strings, numPartitions=1).select(
        F.lit("random").alias("label"),
        F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 32))
        .when(F.col("id") % 4 == 1, F.substring(packed, 1, 40))
        .when(F.col("id") % 4 == 2, F.upper(F.regexp_replace(packed, "[^A-Za-z0-9]", "")))
        .otherwise(F.regexp_replace(packed, "[^A-Za-z0-9]", ""))
        .alias("s"),
    )
    numbers = spark.range(strings, numPartitions=1).select(F.lit("ordinary").alias("label"), F.regexp_replace(F.translate(digest, "abcdef", "012345"), "^0+", "").alias("s"))
    return made.unionByName(numbers)


def labelled_samples(docs: DataFrame, text_col: str = "text", strings: int = 4000) -> DataFrame:
    """label (random or ordinary) and s: made strings, and all words of all documents, alone and joined with the next."""
    words = ordinary_words(docs, text_col).select(F.lit("ordinary").alias("label"), F.explode(F.array(F.col("w"), joined())).alias("s"))
    return made_strings(docs.sparkSession, strings).unionByName(words)


def held(s: str) -> Column:
    """A fifth of the strings; joined words go with the first one."""
    return F.pmod(F.xxhash64(s), F.lit(5)) == 0


def training_strings(docs: DataFrame, text_col: str = "text", strings: int = 4000) -> DataFrame:
    """label, s and n, how often it stands there: what four fifths of the labelled strings consist of.

    Joined words fall into ``w_`` and ``_next``, which have the same pairs of characters, so that no more is grouped
    than the single words, however many pairs of words there are.
    """
    words = ordinary_words(docs, text_col).where(~held("w"))
    ends = words.select(F.explode(F.array(F.struct(F.col("w").alias("s"), F.lit(True).alias("first")), F.struct(F.col("next").alias("s"), F.lit(False).alias("first")))).alias("z"))
    ends = ends.groupBy("z.s", "z.first").agg(F.count(F.lit(1)).alias("n"))
    parts = F.when(F.col("first"), F.array(F.col("s"), F.concat("s", F.lit("_")))).otherwise(F.array(F.concat(F.lit("_"), "s")))
    made = made_strings(docs.sparkSession, strings).where(~held("s")).withColumn("n", F.lit(1).cast("long"))
    return made.unionByName(ends.select(F.lit("ordinary").alias("label"), F.explode(parts).alias("s"), "n"))


def train(samples: DataFrame, alpha: float = 0.5) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of every next character, flattened by character and next character.

    First-order models with add-alpha smoothing; strings count ``n`` times where there is such a column. At most
    2 x 67 x 67 counts reach the driver.
    """
    times = F.col("n") if "n" in samples.columns else F.lit(1)
    pairs = samples.where(F.char_length("s") > 1).select(
        "label", times.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.char_length("s") - 1), lambda i: F.substring(F.col("s"), i, F.lit(2)))).alias("pair")
    )
    counts: dict[str, dict[tuple[int, int], int]] = {"random": {}, "ordinary": {}}
    for r in pairs.groupBy("label", "pair").agg(F.sum("n").alias("n")).where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).collect():
        counts[r["label"]][(ALPHABET.index(r["pair"][0]), ALPHABET.index(r["pair"][1]))] = r["n"]
    table = {}
    for label, seen in counts.items():
        sums = [sum(seen.get((a, b), 0) for b in range(SIZE)) for a in range(SIZE)]
        table[label] = [math.log((seen.get((a, b), 0) + alpha) / (sums[a] + alpha * SIZE)) for a in range(SIZE) for b in range(SIZE)]
    return [r - o for r, o in zip(table["random"], table["ordinary"], strict=True)]


def ratio(s: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a candidate string."""
    known = F.array(*[F.lit(x) for x in table])
    place = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.zip_with(F.slice(place, 1, F.size(place) - 1), F.slice(place, 2, F.size(place) - 1), lambda a, b: a * SIZE + b)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + F.get(known, i))


def learnt(docs: DataFrame, text_col: str = "text", rate: float = 1e-3, strings: int = 4000) -> tuple[list[float], float]:
    """The table of ratios, and the least ratio of a secret.

    Both come from all labelled strings: four fifths of them train the models; the least ratio is the one that a
    share ``rate`` of the ordinary strings of 16 characters or more in the last fifth exceeds, to a hundredth.
    """
    table = train(training_strings(docs, text_col, strings))
    words = ordinary_words(docs, text_col).where(held("w")).select(F.explode(F.array(F.col("w"), joined())).alias("s"))
    numbers = made_strings(docs.sparkSession, strings).where("label = 'ordinary'").where(held("s")).select("s")
    ordinary = words.unionByName(numbers).where(F.char_length("s") >= 16)
    # Grouped first: there are as many different values as hundredths in their range, whatever the number of strings.
    ratios = ordinary.groupBy(F.round(ratio(F.col("s"), table), 2).alias("ratio")).agg(F.count(F.lit(1)).alias("n"))
    least = ratios.agg(F.percentile("ratio", 1 - rate, F.col("n"))).first()[0]
    return table, max(0.0, least or 0.0)


def placed(kind: int):
    """Turns a found string into (start, end, kind)."""
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def of_kind(kind: int):
    return lambda s: s["kind"] == kind


def scan(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text", least: float = 12.0) -> DataFrame:
    """Spans of secrets in every whole text.

    Returns doc_id and spans, an array of (start, end, kind), sorted by start, then kind in the
    order assign, access, hex, markov. Candidate strings whose log-likelihood ratio is at least
    ``least`` and that touch no base span are added as markov; of equals, the kind listed first
    comes first. Null and empty texts have none. Repeated rows repeat their result; other columns
    are ignored. The work on a long text grows with its length and the number of its matches.
    """
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), *[found(text, *how).alias(kind) for kind, how in BASE.items()], found(text, CANDIDATE, 0, 16).alias("candidate"))
    spans = [F.transform(F.col(kind), placed(k)) for k, kind in enumerate(BASE)]
    rows = rows.select("doc_id", F.concat(*spans).alias("base"), "candidate")
    plain = F.transform("candidate", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["hit"].alias("hit")))
    free = F.when((F.size("candidate") > 0) & (F.size("base") > 0), untouched(F.col("candidate"), F.col("base"))).otherwise(plain)
    rows = rows.select("doc_id", "base", free.alias("free"))
    odd = F.filter("free", lambda c: ratio(c["hit"], table) >= least)
    more = F.when(F.size("free") > 0, F.transform(odd, placed(len(BASE))))
    return rows.select("doc_id", F.col("base"), F.coalesce(F.concat("base", more), F.col("base")).alias("all"))


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in (*BASE, "markov")])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, table: list[float], **columns: str) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans as text."""
    out = scan(docs, table, **columns)
    count = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return out.select("doc_id", *count, F.sha2(F.encode(written(F.col("base")), "UTF-8"), 256).alias("base_sha256"), written(F.col("all")).alias("spans"))
