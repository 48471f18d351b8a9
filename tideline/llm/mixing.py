"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stored, whole_text

#: Words are maximal runs without white space; they are counted as tokens here.
WORDS = r"[^\x20\x09-\x0D]+"
#: Marginals without stated targets are flattened to this power of their shares.
POWER = 0.7
CELLS_PER_TASK = 200_000


def topic_of(text: Column) -> Column:
    """A coarse topic from the shape of the text: marked up, tabular, short or prose."""
    return (
        F.when(text.rlike(r"[#$%&*]{3}"), "marked")
        .when(F.contains(text, F.lit("|")), "tabular")
        .when(F.char_length(text) < 400, "short")
        .otherwise("prose")
    )


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, source, lang, topic and tokens of every row; null labels become '' and null texts have 0 tokens."""
    text = whole_text(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        topic_of(text).alias("topic"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("tokens"),
    )


def tempered(cells: DataFrame, column: str, power: float) -> DataFrame:
    """Target shares of a marginal: its token shares raised to ``power`` and scaled to 1; of groups with tokens only."""
    shares = cells.groupBy(column).agg(F.sum("tokens").alias("t")).where("t > 0").select(column, F.pow(F.col("t").cast("double"), F.lit(power)).alias("p"))
    return shares.select(column, (F.col("p") / F.lit(float(shares.agg(F.sum("p")).first()[0] or 1.0))).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-10, most: int = 40) -> DataFrame:
    """Scale ``tokens`` of the cells so that the sums over each target column have the target shares.

    Each step sums the weights over one column and multiplies them by target over sum; the
    steps go round until no sum is off by more than ``tolerance`` of the total, or the largest gap closes no more. Cells whose
    group has no target get weight 0. The weights add up to 1. Only cells (distinct
    combinations), never rows, are joined; each round's result is written and reread. If targets
    contradict each other or empty cells, the steps may not settle in ``most`` rounds or at all:
    that is told by a warning, and ``residuals`` tells how far off the marginals are.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now, worst, before = cells.withColumn("weight", F.col("tokens") / F.lit(float(total or 1))), None, float("inf")
    for _ in range(most if total else 0):
        off = []
        for column, target in targets.items():
            sums = now.groupBy(column).agg(F.sum("weight").alias("__sum"))
            factor = sums.join(target, column, "left").select(
                column,
                F.when(F.col("__sum") > 0, F.coalesce("share", F.lit(0.0)) / F.col("__sum")).otherwise(0.0).alias("__factor"),
                F.abs(F.col("__sum") - F.coalesce("share", F.lit(0.0))).alias(f"__off_{column}"),
            )
            now = now.join(factor, column).withColumn("weight", F.col("weight") * F.col("__factor")).drop("__factor")
            off.append(f"__off_{column}")
        now = stored(now)
        worst = now.agg(F.max(F.greatest(*off) if len(off) > 1 else F.col(off[0]))).first()[0]
        now = now.drop(*off)
        if worst is None or worst <= tolerance or worst > 0.999 * before:
            break
        before = worst
    if worst is not None and worst > tolerance:
        warnings.warn(f"raking has not settled: a marginal is off by {worst:.2g} of the total", stacklevel=2)
    return now


def unit_hash(id_column: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    return F.conv(F.substring(F.md5(F.encode(F.concat(F.lit(seed), id_column.cast("string")), "UTF-8")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def given(cells: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """Target shares of a marginal as stated, scaled to 1 over the groups with tokens."""
    stated = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], f"{column} string, p double")
    stated = cells.groupBy(column).agg(F.sum("tokens").alias("t")).where("t > 0").join(stated, column).select(column, "p")
    return stated.select(column, (F.col("p") / F.lit(float(stated.agg(F.sum("p")).first()[0] or 1.0))).alias("share"))


def scale_for(ratio: DataFrame, token_yield: float) -> float:
    """The scale at which min(1, scale * ratio) is expected to keep ``token_yield`` of all tokens.

    The scale rises as cells reach 1, and with it the cells that do, until none is added. If the
    cells with a target have fewer tokens than that, all of them reach 1.
    """
    total = ratio.agg(F.sum("tokens")).first()[0] or 0
    scale = token_yield
    while total:
        full = F.col("ratio") * F.lit(scale) >= 1
        sums = ratio.where("ratio > 0").agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("tokens") * F.col("ratio"))).alias("rest")).first()
        if not sums["rest"]:
            break
        new = (token_yield * total - (sums["full"] or 0)) / sums["rest"]
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return scale


def calibrate(rows: DataFrame, power: float = POWER, targets: dict[str, dict[str, float]] | None = None, token_yield: float | None = None, tolerance: float = 1e-10) -> DataFrame:
    """source, lang, topic, tokens and probability of every cell of ``rows`` (as ``described`` gives them), written.

    ``targets`` states shares by column and label; the other marginals' targets are tempered
    token shares. A cell's ratio is its raked weight over its token share. Its probability is
    the ratio scaled so that ``token_yield`` of the tokens are kept, 1 at most; without a yield,
    so that the largest is 1. Cells without tokens get 1. ``residuals`` tells how far off the
    targets that is.
    """
    cells = stored(rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")))
    tasks = 1 + cells.count() // CELLS_PER_TASK
    cells = stored(cells.coalesce(tasks))
    shares = marginals(cells, power, targets)
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    ratio = rake(cells, shares, tolerance).withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") * float(total) / F.col("tokens")))
    if token_yield is None:
        scaled = F.col("ratio") / F.lit(ratio.agg(F.max("ratio")).first()[0] or 1.0)
    else:
        ratio = stored(ratio.coalesce(tasks))
        scaled = F.least(F.col("ratio") * F.lit(scale_for(ratio, token_yield)), F.lit(1.0))
    # ``least`` skips nulls.
    probability = F.when(F.col("ratio").isNull(), F.lit(1.0)).otherwise(scaled)
    return stored(ratio.select("source", "lang", "topic", "tokens", probability.alias("probability")).coalesce(tasks))


def marginals(cells: DataFrame, power: float, targets: dict[str, dict[str, float]] | None = None) -> dict[str, DataFrame]:
    """Target shares of every label by column, written; at most as many labels as cells."""
    stated, tasks = targets or {}, 1 + cells.count() // CELLS_PER_TASK
    return {c: stored((given(cells, c, stated[c]) if c in stated else tempered(cells, c, power)).coalesce(tasks)) for c in ("source", "lang", "topic")}


def residuals(cells: DataFrame, power: float = POWER, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """by, label, target, share and residual (share less target) of every group; ``cells`` as ``calibrate`` gives them."""
    kept = cells.withColumn("kept", F.col("tokens") * F.col("probability"))
    total = kept.agg(F.sum("kept")).first()[0] or 1.0
    out = None
    for c, target in marginals(cells, power, targets).items():
        sums = kept.where("tokens > 0").groupBy(c).agg((F.sum("kept") / F.lit(float(total))).alias("share")).join(target.withColumnRenamed("share", "target"), c, "left")
        one = sums.select(F.lit(c).alias("by"), F.col(c).alias("label"), F.coalesce("target", F.lit(0.0)).alias("target"), "share").withColumn("residual", F.col("share") - F.col("target"))
        out = one if out is None else out.unionByName(one)
    return out


def with_probability(rows: DataFrame, cells: DataFrame, labels: dict[str, Column], name: str = "probability") -> DataFrame:
    """``rows`` with the probability in column ``name``; ``labels`` has the columns that stand for source, lang and topic.

    The cells are read from a file whose size Spark knows, and so are broadcast only if small.
    """
    named = cells.select(F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("topic").alias("__topic"), F.col("probability").alias(name))
    same = [labels[c] == F.col(f"__{c}") for c in ("source", "lang", "topic")]
    return rows.join(named, same[0] & same[1] & same[2]).drop("__source", "__lang", "__topic")


def chosen(id_column: Column, probability: Column, seed: str) -> Column:
    return unit_hash(F.coalesce(id_column.cast("string"), F.lit("")), seed) < probability


def mix(docs: DataFrame, power: float = POWER, seed: str = "mix:", targets: dict[str, dict[str, float]] | None = None, token_yield: float | None = None, **columns: str) -> DataFrame:
    """Calibrated sampling probability and decision for every row.

    Token weights of the (source, language, topic) cells are raked to tempered or stated
    marginals (see ``calibrate``); a row is sampled if the hash of its id falls below its cell's probability. Rows of one id
    and cell share the decision. Rows in cells without tokens (null or empty texts only), which
    no token weight concerns, are sampled. A null id hashes as ''; null labels are cells of ''.
    Ties can't arise: a row's decision is its own. Long texts are counted whole. Other
    columns are ignored. An empty table gives no rows.

    Returns doc_id, source, lang, topic, tokens, probability and sampled.
    """
    rows = described(docs, **columns)
    out = with_probability(rows, calibrate(rows, power, targets, token_yield), {c: F.col(c) for c in ("source", "lang", "topic")})
    return out.withColumn("sampled", chosen(F.col("doc_id"), F.col("probability"), seed))


def sample(docs: DataFrame, power: float = POWER, seed: str = "mix:", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", targets: dict[str, dict[str, float]] | None = None, token_yield: float | None = None, tolerance: float = 1e-6) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns; the marginals are met to ``tolerance`` of all tokens."""
    cells = calibrate(described(docs, id_col, text_col, source_col, lang_col), power, targets, token_yield, tolerance)
    labels = {"source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")), "topic": topic_of(whole_text(text_col))}
    out = with_probability(docs, cells, labels, "__probability")
    return out.where(chosen(F.col(id_col), F.col("__probability"), seed)).drop("__probability")


def mix_sql(power: float = POWER, seed: str = "mix:", rounds: int = 40, documents: str = "documents", targets: dict[str, dict[str, float]] | None = None, token_yield: float = 0.5) -> str:
    """The same result in SQL with a yield, the rounds written out.

    The scale is that of the most probable cell that does not reach 1: what the yield leaves after
    the cells before it, over the sum of the ratios of the rest.
    """
    steps, last = [], "w0"
    for k in range(rounds):
        for c in ("source", "lang", "topic"):
            name = f"w{k + 1}_{c}"
            steps.append(f"{name} AS (SELECT c.* REPLACE (c.weight * coalesce(t.share, 0) / s.s AS weight) FROM {last} c JOIN (SELECT {c}, sum(weight) s FROM {last} GROUP BY 1) s USING ({c}) LEFT JOIN t_{c} t USING ({c}))")
            last = name

    def target(c: str) -> str:
        if c in (targets or {}):
            values = ", ".join(f"('{k}', {float(v)!r})" for k, v in targets[c].items())
            return f"SELECT {c}, p FROM (VALUES {values}) v({c}, p) WHERE {c} IN (SELECT {c} FROM cells WHERE tokens > 0)"
        return f"SELECT {c}, pow(sum(tokens)::DOUBLE, {power}) p FROM cells WHERE tokens > 0 GROUP BY 1"

    shares = ", ".join(f"t_{c} AS MATERIALIZED (SELECT {c}, p / sum(p) OVER () AS share FROM ({target(c)}))" for c in ("source", "lang", "topic"))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, coalesce(source, '') source, coalesce(lang, '') lang FROM {documents}),
r AS (SELECT doc_id, source, lang,
        CASE WHEN regexp_matches(t, '[#$%&*]{{3}}') THEN 'marked' WHEN contains(t, '|') THEN 'tabular' WHEN length(t) < 400 THEN 'short' ELSE 'prose' END AS topic,
        len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM d),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT tokens FROM r GROUP BY ALL),
total AS MATERIALIZED (SELECT sum(tokens)::DOUBLE AS n FROM cells),
{shares},
w0 AS (SELECT *, tokens / (SELECT n FROM total) AS weight FROM cells WHERE tokens > 0),
{", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in steps)},
q AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * (SELECT n FROM total) / tokens AS ratio FROM {last}),
s AS (SELECT ratio, ({token_yield!r} * (SELECT n FROM total) - sum(tokens) OVER (ORDER BY ratio DESC, source, lang, topic) + tokens) / sum(tokens * ratio) OVER (ORDER BY ratio, source DESC, lang DESC, topic DESC) AS scale FROM q WHERE ratio > 0),
p AS (SELECT source, lang, topic, least(1.0, ratio * coalesce((SELECT arg_max(scale, ratio) FROM s WHERE ratio * scale < 1), 1e300)) AS probability FROM q)
SELECT doc_id, source, lang, topic, tokens, coalesce(probability, 1.0) AS probability,
  ('0x' || substr(md5('{seed}' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < coalesce(probability, 1.0) AS sampled
FROM r LEFT JOIN p USING (source, lang, topic)"""
