"""The configuration catalogue: sections ``[Type:Name]`` with options, in layers, and what is fetched through it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.registry import SOURCES
from tideline.sources.files import written

# The section types, and the sections without a name.
TYPES = ("Device", "Diagnostic", "Acquisition", "CoordTransform")
SPECIAL = ("variabletypes", "global", "Plots")
OPTION_TYPES = ("str", "float", "int", "bool")


def parse(lines: DataFrame) -> DataFrame:
    """section and option rows of configuration texts: layer, section_type, name, option, value.

    ``lines`` has layer, line_no and line; a line belongs to the last section line before it. Lines lie in sampled
    ranges of their order, and each range's last section line is carried into those behind it, so that a layer may be long.
    """
    from tideline.operators import blocks

    head = F.regexp_extract("line", r"^\s*\[([^\]]+)\]\s*$", 1)
    told = lines.where(~F.col("line").rlike(r"^\s*([#;].*)?$")).select("layer", "line_no", "line", head.alias("head"))
    spread = blocks.ranged(told.withColumn("known", F.when(F.col("head") != "", F.col("head"))), "layer", "line_no")
    ends = spread.where("known IS NOT NULL").groupBy("layer", "__block").agg(F.max_by("known", "line_no").alias("last"))
    # A row for each layer and range.
    every = spread.select("layer", "__block").distinct().join(ends, ["layer", "__block"], "left")
    carried = every.select("layer", "__block", F.last("last", ignorenulls=True).over(Window.partitionBy("layer").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = F.last("known", ignorenulls=True).over(Window.partitionBy("layer", "__block").orderBy("line_no"))
    tagged = blocks.beside(spread, carried, "layer", "__block").withColumn("section", F.coalesce(inside, "before"))
    option = r"^\s*([^=:\s][^=:]*?)\s*[=:]\s*(.*?)\s*$"
    rows = tagged.where((F.col("head") == "") & F.col("section").isNotNull() & F.col("line").rlike(option))
    return rows.select(
        "layer", F.substring_index("section", ":", 1).alias("section_type"), F.when(F.instr("section", ":") > 0, F.regexp_replace("section", "^[^:]*:", "")).otherwise("").alias("name"),
        F.lower(F.regexp_extract("line", option, 1)).alias("option"), F.regexp_extract("line", option, 2).alias("value"),
    )


def merged(rows: DataFrame) -> DataFrame:
    """Of options given in several layers the one of the highest layer."""
    order = F.row_number().over(Window.partitionBy("section_type", "name", "option").orderBy(F.col("layer").desc()))
    return rows.withColumn("__n", order).where("__n = 1").drop("__n", "layer")


def invalid_sections(rows: DataFrame) -> DataFrame:
    """Sections that are not special and whose type is not allowed or that lack a name."""
    special = (F.col("name") == "") & F.col("section_type").isin(*SPECIAL)
    return rows.where(~special & (~F.col("section_type").isin(*TYPES) | (F.col("name") == ""))).select("section_type", "name").distinct()


def scan(rows: DataFrame, section_type: str = "Diagnostic") -> DataFrame:
    return rows.where(F.col("section_type") == section_type).select("name").distinct()


def typed(rows: DataFrame) -> DataFrame:
    """Options with their declared type and the value in a column of that type; text is the type of undeclared ones."""
    # Read twice, so written; the declared types are as few as the kinds of options and can be broadcast.
    rows = written(rows)
    kinds = rows.where("section_type = 'variabletypes'").select(F.split("option", "__").alias("k"), F.col("value").alias("kind"))
    kinds = kinds.select(F.lower(F.get("k", F.lit(0))).alias("__type"), F.get("k", F.lit(1)).alias("__option"), "kind")
    out = rows.where("section_type <> 'variabletypes'").join(F.broadcast(kinds), (F.lower("section_type") == F.col("__type")) & (F.col("option") == F.col("__option")), "left").drop("__type", "__option")
    out = out.withColumn("kind", F.coalesce("kind", F.lit("str")))
    true = F.lower("value").isin("true", "yes", "on", "1")
    return out.select(
        "section_type", "name", "option", "value", "kind", F.when(F.col("kind").isin("float", "int"), F.expr("try_cast(value AS double)")).alias("number"), F.when(F.col("kind") == "bool", true).alias("flag"), F.col("kind").isin(*OPTION_TYPES).alias("known_type")
    )


class UnknownVariableTypeError(ValueError):
    pass


class Catalog:
    """Merged options, for lookups from the driver; a catalogue is as small as its files."""

    def __init__(self, rows: DataFrame):
        self.rows = merged(rows) if "layer" in rows.columns else rows
        self.options: dict[tuple[str, str], dict[str, object]] = {}
        for r in typed(self.rows).collect():
            if not r["known_type"]:
                raise UnknownVariableTypeError(r["kind"])
            value = r["value"] if r["kind"] == "str" else r["flag"] if r["kind"] == "bool" else int(r["number"]) if r["kind"] == "int" else r["number"]
            self.options.setdefault((r["section_type"], r["name"]), {})[r["option"]] = value

    @classmethod
    def from_texts(cls, spark: SparkSession, *texts: str) -> Catalog:
        """Later texts override earlier ones."""
        lines = [(layer, i, line) for layer, text in enumerate(texts) for i, line in enumerate(text.splitlines())]
        if not lines:
            raise ValueError("no configuration could be read")
        return cls(parse(spark.createDataFrame(lines, "layer int, line_no int, line string")))

    @classmethod
    def from_files(cls, spark: SparkSession, *paths: str) -> Catalog:
        texts = ["\n".join(r["value"] for r in spark.read.text(p, wholetext=True).collect()) for p in paths]
        return cls.from_texts(spark, *texts)

    def section(self, section_type: str, name: str, **overrides) -> dict[str, object]:
        """A section's options; keyword arguments override them."""
        return {**self.options.get((section_type, name), {}), **overrides}

    def has(self, section_type: str, name: str, option: str | None = None) -> bool:
        found = self.options.get((section_type, name))
        return found is not None and (option is None or option.lower() in found)

    def get(self, section_type: str, name: str, option: str):
        return self.options[(section_type, name)][option.lower()]


def fetch(spark: SparkSession, catalog: Catalog, diagnostic: str, shot: int, then: Callable[[DataFrame], DataFrame] = lambda df: df, **overrides) -> DataFrame:
    """Samples of a diagnostic: its source is looked up by name, called with its options, finished by ``then`` and stamped with the shot.

    A diagnostic with options channel_1, channel_2 ... is an array: its channels are fetched in
    the order of their numbers and put on the first one's time base.
    """
    from tideline.operators.interpolate import multichannel

    options = catalog.section("Diagnostic", diagnostic, **overrides)
    names = [k for k in options if k.startswith("channel_") and k[8:].isdigit()]
    if names:
        parts = None
        for i, k in enumerate(sorted(names, key=lambda k: int(k[8:]))):
            one = fetch(spark, catalog, str(options[k]), shot, **overrides).withColumn("ch_ix", F.lit(i))
            one = one.select("shot", "ch_ix", "sample_ix", "t", "value")
            parts = one if parts is None else parts.unionByName(one)
        return then(multichannel(parts))
    kind = options.pop("data_fetcher", None)
    if kind not in SOURCES:
        raise LookupError(f"diagnostic {diagnostic!r} has no known source: {kind!r}")
    return then(SOURCES[kind](spark, shot=shot, **options).withColumn("shot", F.lit(shot).cast("long")))


def acquisition(catalog: Catalog, name: str, **overrides) -> dict[str, object]:
    if not catalog.has("Acquisition", name):
        raise LookupError(name)
    return catalog.section("Acquisition", name, **overrides)


def device(catalog: Catalog, name: str, **overrides) -> dict[str, object]:
    """A device's options and those of its acquisition."""
    if not catalog.has("Device", name):
        raise LookupError(name)
    own = catalog.section("Device", name, **overrides)
    return own | ({"acquisition": acquisition(catalog, str(own["acq_name"]))} if "acq_name" in own else {})


def scan_shots(scans: DataFrame, bad: DataFrame, *names: str) -> DataFrame:
    """scan, shot, start_time and end_time of the named scans, without the bad shots.

    ``scans`` has name, first_shot, last_shot, start_time and end_time, several rows for scans
    of several ranges; ``bad`` has name and shot.
    """
    rows = scans.where(F.col("name").isin(*names)) if names else scans
    every = rows.select(F.col("name").alias("scan"), F.explode(F.sequence("first_shot", "last_shot")).alias("shot"), "start_time", "end_time")
    return every.join(bad.select(F.col("name").alias("scan"), "shot"), ["scan", "shot"], "left_anti")
