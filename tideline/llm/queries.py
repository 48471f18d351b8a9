"""The registered queries of this subpackage and their SQL; each covers a whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.llm import ann, fill_middle, html_extract, lm, mixing, personal, repeats, secrets, simhash, substring, toxicity
from tideline.llm.bpe import round_trip
from tideline.llm.common import table
from tideline.llm.exact_dedup import exact_groups


def op1_lm_scoring(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op3_byte_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return substring.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_simhash(spark, sf_dir):
    out = simhash.near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_extract.main_text(pages, html_extract.train(pages))


def op8_exact_dedup(spark, sf_dir):
    out = exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: The mixture asked for: shares of the topics as stated, sources and languages flattened, half of the tokens.
MIXTURE = {"targets": {"topic": {"prose": 0.8, "short": 0.1, "tabular": 0.06, "marked": 0.04}}, "token_yield": 0.5}


def op9_mixing(spark, sf_dir):
    out = mixing.mix(table(spark, sf_dir, "documents"), **MIXTURE)
    return out.withColumn("probability", F.round("probability", 6))


def op10_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ratios, least = secrets.learnt(docs)
    return secrets.report(docs, ratios, least=least)


def with_planted_runs(docs):
    """Of every tenth document (by the checksum of its id) the words from one place on repeat with one period; the others, and null ids, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(place, lambda i: F.get(words, i)), " ")).otherwise("")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.withColumn("text", F.when(h % 10 == 0, secrets.bound(words, repeated)).otherwise(F.col("text")))


def op11_periodic_runs(spark, sf_dir):
    out = repeats.collapse(with_planted_runs(table(spark, sf_dir, "documents")))
    best = repeats.strongest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return out.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def op12_personal_data(spark, sf_dir):
    return personal.report(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark, sf_dir):
    out = fill_middle.transform(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    digests = [F.sha2(F.encode(c, "UTF-8"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (back, "restored_sha256"))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_nearest_neighbours, op3_byte_bpe, op4_substring_dedup, op5_toxicity, op6_simhash, op7_html_extraction, op8_exact_dedup, op9_mixing, op10_secret_scan, op11_periodic_runs, op12_personal_data,
    op13_fill_middle,
)}

#: Lower-cases A-Z only.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op8_exact_dedup": f"""
WITH d AS (SELECT doc_id, {LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""",
    "op13_fill_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id::VARCHAR) AS s FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2, ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""",
    "op9_mixing": f"SELECT * REPLACE (round(probability, 6) AS probability) FROM ({mixing.mix_sql(**MIXTURE)})",
}
