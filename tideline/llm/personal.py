"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that they don't know.

What the base patterns find are the seeds. Words around a seed are lexical patterns; patterns and
the instances (identifiers) that stand in them are a graph. A pattern is as sure as the share
of its instances that are known to be personal; an instance is as sure as its sure patterns
together. Both are scored in turn, each round on all that the rounds before have found.

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stored, whole_text
from tideline.llm.secrets import bound, running, untouched

#: The base patterns. They match what ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``, ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``,
#: ``[0-9]([\x20-]?[0-9])+`` and ``\+[0-9][\x20().0-9-]+[0-9]`` match, written so that no character is tried from more than a few places:
#: repeats give nothing back, and a match begins with its run of characters or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What can be an identifier: joined letters, digits and @._+- with a digit or an at sign.
CANDIDATE = r"(?<![A-Za-z0-9@._+-])(?=[A-Za-z._+-]*+[0-9@])[A-Za-z0-9@._+-]++"
EDGES = "@._+-"
#: A part of an address: at most 255.
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

def passes(kind: str):
    return lambda s: VALID[kind][1](s["hit"])


def of_kind(number: int):
    return lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def is_kind(number: int):
    return lambda s: s["kind"] == number


SEEN = "array<struct<start:int,end:int,hit:string,left:string,right:string>>"


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


VALID = {
    "email": (EMAIL, lambda hit: F.lit(True)),
    "ip": (IP, lambda hit: hit.rlike(rf"^(?:{PART}\.){{3}}{PART}$")),
    "card": (CARD, lambda hit: F.when(F.char_length(digits(hit)).between(13, 19), F.call_function("luhn_check", digits(hit))).otherwise(False)),
    "phone": (PHONE, lambda hit: F.char_length(digits(hit)).between(9, 15)),
}
KINDS = (*VALID, "context")


def spotted(text: Column, pattern: str) -> Column:
    """Start, end (code points) and text of the leftmost non-overlapping matches, with the text from the match before and to the next."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(h: Column) -> Column:
        def of(gaps: Column) -> Column:
            parts = F.zip_with(h, F.slice(gaps, 1, F.size(h)), lambda hit, gap: F.char_length(hit) + F.char_length(gap))
            rows = F.arrays_zip(running(parts, lambda a, b: a + b).alias("at"), F.slice(gaps, 1, F.size(h)).alias("left"), h.alias("hit"), F.slice(gaps, 2, F.size(h)).alias("right"))
            start = lambda r: r["at"] + F.char_length(r["left"])
            return F.transform(rows, lambda r: F.struct(start(r).alias("start"), (start(r) + F.char_length(r["hit"])).alias("end"), r["hit"].alias("hit"), r["left"].alias("left"), r["right"].alias("right")))

        return bound(F.split(text, pattern, -1), of)

    return bound(hits, lambda h: F.when(F.size(h) > 0, placed(h)).otherwise(F.array().cast(SEEN)))


def plain_words(gap: Column) -> Column:
    """Words of a stretch of text in lower case, parted by one space; what carries a digit is #, other signs than : and = are gone."""
    joined = F.regexp_replace(F.lower(gap), r"[^\p{L}\p{M}\p{N}:=]*+([:=])|[^\p{L}\p{M}\p{N}:=]++", "$1 ")
    return F.trim(joined)


def no_digit(word: Column) -> Column:
    return F.when(~word.rlike("[0-9]") & (word != ""), word)


def contexts(left: Column, right: Column) -> Column:
    """The lexical patterns of a place: a label before it, two words before it, a word on each side."""

    def of(words: Column) -> Column:
        one = F.substring_index(words, " ", -1)
        two = F.substring_index(F.substring(words, F.lit(1), F.char_length(words) - F.char_length(one) - 1), " ", -1)
        return patterns(no_digit(one), no_digit(two), no_digit(F.substring_index(plain_words(right), " ", 1)))

    def patterns(one: Column, two: Column, behind: Column) -> Column:
        label = F.when(one.rlike("[^:=][:=]$"), F.concat(one, F.lit(" _")))
        return F.array_compact(F.array(label, F.concat(two, F.lit(" "), one, F.lit(" _")), F.concat(one, F.lit(" _ "), behind)))

    return bound(plain_words(left), of)


def instance(hit: Column) -> Column:
    return F.lower(F.trim(hit, F.lit(EDGES)))


def seen(docs: DataFrame, id_col: str, text_col: str, least_length: int) -> DataFrame:
    """__row, doc_id, base spans by kind, and what the graph is made of: seeds and other candidates with their patterns. One pass over the texts."""
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), *[spotted(text, p).alias(kind) for kind, (p, _) in VALID.items()], spotted(text, CANDIDATE).alias("other"))
    rows = rows.select("doc_id", *[F.filter(kind, passes(kind)).alias(kind) for kind in VALID], "other")
    spans = [F.transform(kind, of_kind(k)) for k, kind in enumerate(VALID)]

    def trimmed(s: Column) -> Column:
        start = s["start"] + F.char_length(s["hit"]) - F.char_length(F.ltrim(s["hit"], F.lit(EDGES)))
        return F.struct(start.alias("start"), (start + F.char_length(instance(s["hit"]))).alias("end"), s["hit"].alias("hit"), s["left"].alias("left"), s["right"].alias("right"))

    usable = lambda s: (s["end"] - s["start"] >= least_length) & instance(s["hit"]).rlike("[0-9@]")
    rows = rows.select("doc_id", *VALID, F.concat(*spans).alias("base"), F.filter(F.transform("other", trimmed), usable).alias("other"))
    # The place in the array stands for the candidate while those are dropped that a base span overlaps.
    numbered = F.transform("other", lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.cast("string").alias("hit")))
    free = F.when(F.size("base") == 0, F.col("other")).otherwise(F.transform(untouched(numbered, F.col("base")), lambda s: F.get(F.col("other"), s["hit"].cast("int"))))
    rows = rows.select("doc_id", *VALID, "base", F.when(F.size("other") > 0, free).otherwise(F.col("other")).alias("other"))

    def known(seed: bool):
        return lambda s: F.struct(F.lit(seed).alias("seed"), s["start"].alias("start"), s["end"].alias("end"), instance(s["hit"]).alias("instance"), contexts(s["left"], s["right"]).alias("patterns"))

    places = F.concat(*[F.transform(kind, known(True)) for kind in VALID], F.transform("other", known(False)))
    return rows.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "base", places.alias("places"))


def spread(many: DataFrame, few: DataFrame, key: str, by: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """A join on ``key``, unique in ``few``, in which the rows of a frequent key are dealt to ``salts`` tasks by ``by``."""
    dealt = many.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    copies = few.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copies, [key, "__salt"], how).drop("__salt")


def bootstrap(places: DataFrame, least_members: int = 3, confidence: float = 0.8, accept: float = 0.9, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Scored patterns and discovered instances from places (seed, instance, patterns).

    The graph has an edge for each distinct pattern and instance, however often they meet. In each
    round a pattern with ``least_members`` known instances or more is kept if their share of its
    instances is at least ``confidence``; an instance is discovered if 1 less the product of
    (1 less the share) over its kept patterns is at least ``accept``. Rounds end after
    ``rounds``, or when nothing new is found. Returns patterns (pattern, members, instances,
    share) of the last round and instances (instance, score, round).
    """
    spark = places.sparkSession
    edges = places.select("seed", "instance", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("known"))
    edges = stored(edges)
    patterns, found = None, spark.createDataFrame([], "instance string, score double, round int")
    for number in range(1, rounds + 1):
        each = edges.groupBy("pattern").agg(F.count_if("known").alias("members"), F.count(F.lit(1)).alias("instances"))
        share = F.col("members") / F.col("instances")
        patterns = stored(each.withColumn("share", share).where((F.col("members") >= least_members) & (F.col("share") >= confidence)))
        open_edges = spread(edges.where("not known"), patterns.where("members < instances").select("pattern", "share"), "pattern", "instance")
        sure = F.round(1 - F.exp(F.sum(F.log(1 - F.col("share")))), 9)
        new = stored(open_edges.groupBy("instance").agg(sure.alias("score")).where(F.col("score") >= accept).withColumn("round", F.lit(number)))
        if new.isEmpty():
            break
        found = found.unionByName(new)
        if number < rounds:
            marked = spread(edges, new.select("instance", F.lit(True).alias("__new")), "instance", "pattern", how="left")
            edges = stored(marked.select("pattern", "instance", (F.col("known") | F.col("__new").isNotNull()).alias("known")))
    return patterns, found


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_members: int = 3, confidence: float = 0.8, accept: float = 0.9, rounds: int = 3) -> DataFrame:
    """Spans of personal data in every whole text.

    Returns doc_id, base and added: arrays of (kind, start, end), kinds numbered as in ``KINDS``,
    by kind, then start, in code points. Base spans are what the four patterns find, kind by kind,
    and may overlap each other. Added ones (kind ``context``) are all places of the discovered
    instances that no base span overlaps: strings of ``least_length`` characters or more with a
    digit or an at sign. See ``bootstrap`` for the other parameters.

    Null and empty texts have none. Repeated rows repeat their result and count once in the
    graph, whose edges are distinct; null ids are rows like any other; other columns are
    ignored. Work on a long text grows with its length and the number of its matches.
    """
    rows = stored(seen(docs, id_col, text_col, least_length))
    places = rows.select("__row", F.explode("places").alias("p")).select("__row", "p.*")
    _, found = bootstrap(places, least_members, confidence, accept, rounds)
    met = spread(places.where("not seed").select("__row", "start", "end", "instance"), found.select("instance"), "instance", "__row")
    added = met.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct(F.lit(len(VALID)).alias("kind"), "start", "end"))).alias("added"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.select("__row", "doc_id", "base").join(added, "__row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans as text."""
    counts = [F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(VALID)]
    return find(docs, **options).select("doc_id", *counts, F.sha2(F.encode(written(F.col("base")), "UTF-8"), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"))
