"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import ascii_lower, stored, whole_text


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 128, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """Group rows whose texts are identical after lower-casing A-Z.

    Three combining stages, each of which compares the full content beside its digest:
    the map side of the first aggregation deduplicates within a task, its reduce side merges
    groups of one digest and one salt, and a second aggregation combines the winners of all
    salts. A group of any size therefore reaches a reducer as at most one row per map task,
    then as one row per salt. Verdicts return to the rows through digest and salt, so that the
    rows of a large group stay spread. Should two different contents share a digest, those rows are
    matched by content instead.

    Returns one row per input row: doc_id, keep_id, group_size, kept, digest (binary).
    Null text counts as empty. Empty texts form a group like any other. The largest non-null
    id stays. Rows that repeat one id share its verdict; a group whose ids are all null keeps
    no row apart (keep_id null, kept true for each). Other columns are ignored. Long texts are
    compared whole.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int").alias("salt"), ascii_lower(whole_text(text_col)).alias("norm"))
    base = base.withColumn("digest", digest(F.col("norm")))
    merged = base.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = merged.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))
    by_digest = stored(
        groups.groupBy("digest").agg(
            F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.first("salts").alias("salts")
        )
    )
    clear = by_digest.where("contents = 1").select("digest", F.explode("salts").alias("salt"), "keep_id", "group_size")
    verdicts = base.drop("norm").join(clear, ["digest", "salt"]).drop("salt")
    mixed = by_digest.where("contents > 1").select("digest")
    if not mixed.isEmpty():
        verdicts = verdicts.unionByName(base.drop("salt").join(mixed, "digest", "left_semi").join(groups.drop("salts"), ["digest", "norm"]).drop("norm"))
    return verdicts.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ties: bool = True) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns.

    Several rows of a group can have the id that stays, or all have none. Without ``ties`` the
    one of them whose columns have the smallest hash stays alone.
    """
    kept = stored(exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__kept_id"), F.col("digest").alias("__kept_digest")))
    own = sha256(ascii_lower(whole_text(text_col)))
    out = docs.join(kept, F.col(id_col).eqNullSafe(F.col("__kept_id")) & (own == F.col("__kept_digest")), "left_semi")
    if ties or kept.groupBy("__kept_digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return out
    first = Window.partitionBy("__kept_digest").orderBy(F.xxhash64(*docs.columns))
    return out.withColumn("__kept_digest", own).withColumn("__kept_row", F.row_number().over(first)).where("__kept_row = 1").select(*docs.columns)
