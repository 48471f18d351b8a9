"""Parsers and validators for shots, windows, settings, paths and channel names."""

from __future__ import annotations

import os.path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHOTS = r"^\s*\d+(\s*-\s*\d+)?(\s*,\s*\d+(\s*-\s*\d+)?)*\s*$"
WINDOW = r"^\s*\d+(\.\d+)?\s*-\s*\d+(\.\d+)?\s*$"
METHODS = ("k_means", "EM_VMM", "EM_GMM")


def valid_shots(s: Column) -> Column:
    return F.coalesce(s.rlike(SHOTS), F.lit(False))


def parse_shots(s: Column) -> Column:
    """Array of the shots in a string such as "1,6-9,12"; ranges include both ends; null if the string is not valid."""
    parts = F.split(F.regexp_replace(s, r"\s", ""), ",")
    ranges = F.transform(parts, lambda p: F.sequence(F.element_at(F.split(p, "-"), 1).cast("long"), F.element_at(F.split(p, "-"), -1).cast("long")))
    return F.when(valid_shots(s), F.flatten(ranges))


def shots_to_text(shots: Column) -> Column:
    """Shots, sorted and distinct, with runs written as ranges."""
    ordered = F.array_sort(F.array_distinct(shots))
    start = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def extend(runs: Column, x: Column) -> Column:
        last = F.element_at(runs, -1)
        longer = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["a"].alias("a"), x.alias("b"))))
        fresh = F.concat(runs, F.array(F.struct(x.alias("a"), x.alias("b"))))
        return F.when(F.size(runs) == 0, fresh).when(F.element_at(runs, F.when(F.size(runs) == 0, 1).otherwise(-1))["b"] + 1 == x, longer).otherwise(fresh)

    safe = F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), F.when(F.size(ordered) > 0, F.array(F.struct(F.get(ordered, F.lit(0)).cast("long").alias("a"), F.get(ordered, F.lit(0)).cast("long").alias("b")))).otherwise(start), lambda acc, x: extend(acc, x.cast("long")))
    return F.array_join(F.transform(safe, lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat_ws("-", r["a"].cast("string"), r["b"].cast("string")))), ",")


def in_shots(shot: Column, s: Column) -> Column:
    return F.coalesce(F.array_contains(parse_shots(s), shot.cast("long")), F.lit(False))


def valid_int(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^\s*[+-]?\d+\s*$"), F.lit(False))


def valid_float(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"), F.lit(False))


def valid_method(s: Column) -> Column:
    return F.coalesce(F.trim(s).isin(*METHODS), F.lit(False))


def parse_window(s: Column) -> Column:
    """[start, end] as integers of a window such as "300-1400"; null unless start < end."""
    ends = F.transform(F.split(F.regexp_replace(s, r"\s", ""), "-"), lambda x: x.cast("double").cast("long"))
    return F.when(s.rlike(WINDOW) & (F.element_at(F.when(s.rlike(WINDOW), ends), 1) < F.element_at(F.when(s.rlike(WINDOW), ends), 2)), ends)


def valid_window(s: Column) -> Column:
    return parse_window(s).isNotNull()


def in_window(t: Column, start: Column, end: Column) -> Column:
    """Strictly inside."""
    return (start < t) & (t < end)


def window_inside(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Is [a0, a1] part of [b0, b1]?"""
    return (b0 <= a0) & (a1 <= b1)


def window_label(start: Column, end: Column) -> Column:
    return F.concat_ws("_", start.cast("string"), end.cast("string"))


def parse_settings(text: Column) -> Column:
    """Map of the ``key: value`` lines of a settings text; other lines are left out and the last of equal keys counts."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")))
    # The pairs are made once for each text, not once more for each of its lines.
    last = F.transform(F.array(pairs), lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["key"] == p["key"])))
    return F.map_from_entries(F.get(last, F.lit(0)))


def settings_text(settings: Column) -> Column:
    """``key: value`` lines by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(settings)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def tree_path(path: Column) -> Column:
    r"""Tree, tag and node of a path such as \tree::tag.node."""
    pattern = r"^\\{0,2}([^:.]+)::([^:.]+)(.*)$"
    return F.struct(F.regexp_extract(path, pattern, 1).alias("tree"), F.regexp_extract(path, pattern, 2).alias("tag"), F.regexp_extract(path, pattern, 3).alias("node"))


def listed(rows: DataFrame, shot: str, lists: DataFrame, texts: str) -> DataFrame:
    """Rows whose shot stands in any of the valid texts."""
    known = lists.select(F.explode(parse_shots(F.col(texts))).alias("__shot")).distinct()
    return rows.join(known, F.col(shot) == F.col("__shot"), "left_semi")


def common_start(a: Column, b: Column) -> Column:
    """The longest string that both strings begin with."""
    n = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(a), F.lit(1))), lambda k: (k <= F.char_length(b)) & (F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)))
    return F.substring(a, F.lit(1), F.size(n))


def varying_parts(rows: DataFrame, name: str, *keys: str, pad: str = " ") -> DataFrame:
    """Rows with the common prefix and suffix of the names of their group, and what varies between them; see ``split_names``.

    Names are padded to one length. What the smallest and the largest name of a group have in
    common, all have.
    """
    width = rows.groupBy(*keys).agg(F.max(F.char_length(name)).alias("__width"))
    padded = rows.join(width, [*keys]).withColumn("__name", F.rpad(name, F.col("__width"), F.lit(pad)))

    def ends(df: DataFrame, column: str, alias: str) -> DataFrame:
        both = df.groupBy(*keys).agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
        return both.select(*keys, common_start(F.col("__low"), F.col("__high")).alias(alias), (F.col("__low") == F.col("__high")).alias(f"__one_{alias}"))

    rest = padded.join(ends(padded, "__name", "prefix"), [*keys]).withColumn("prefix", F.when(F.col("__one_prefix"), "").otherwise(F.col("prefix")))
    rest = rest.withColumn("__back", F.reverse(F.substring("__name", F.char_length("prefix") + 1, F.col("__width"))))
    done = rest.join(ends(rest, "__back", "suffix"), [*keys]).withColumn("suffix", F.when(F.col("__one_suffix"), "").otherwise(F.col("suffix")))
    out = done.withColumn("varying", F.reverse(F.substring("__back", F.char_length("suffix") + 1, F.col("__width")))).withColumn("suffix", F.reverse("suffix"))
    return out.select(*rows.columns, "prefix", "suffix", "varying")


def split_names(names: list[str], pad: str = " ") -> tuple[list[str], str, str]:
    """Varying parts, common prefix and common suffix of channel names padded to one length."""
    if len(set(names)) < 2:
        return list(names), "", ""
    width = max(map(len, names))
    padded = [n + pad * (width - len(n)) for n in names]
    prefix = os.path.commonprefix(padded)
    rest = [n[len(prefix) :] for n in padded]
    suffix = os.path.commonprefix([n[::-1] for n in rest])[::-1]
    return [n[: len(n) - len(suffix)] for n in rest], prefix, suffix
