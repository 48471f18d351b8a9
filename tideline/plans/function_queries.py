"""Queries on scalar functions, parsers, the catalogue, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import angles, geometry, text
from tideline.plans.base import EVENTS, query
from tideline.sources import files
from tideline.sources.tables import event_samples, table


def angles_of(spark, sf_dir):
    return event_samples(spark, sf_dir).select("event_id", ((F.col("event_id") % 977) * 0.037 - 18.05).alias("x"))


X = "x AS (SELECT event_id, (event_id % 977) * 0.037::DOUBLE - 18.05 AS x FROM events)"


@query(f"WITH {X}, m AS (SELECT event_id, x - 2 * pi() * floor(x / (2 * pi())) AS y FROM x) SELECT event_id, CASE WHEN y > pi() THEN y - 2 * pi() ELSE y END AS y FROM m -- y")
def wrap_pi(spark, sf_dir):
    return angles_of(spark, sf_dir).select("event_id", angles.wrap_pi(F.col("x")).alias("y"))


@query(f"WITH {X} SELECT event_id, (x - 1.3 + pi()) - 2 * pi() * floor((x - 1.3 + pi()) / (2 * pi())) + 1.3 - pi() AS y FROM x -- y")
def modtwopi(spark, sf_dir):
    return angles_of(spark, sf_dir).select("event_id", angles.modtwopi(F.col("x"), 1.3).alias("y"))


@query(f"WITH {X} SELECT event_id, (x - 0.5) - 3 * floor((x - 0.5) / 3) + 0.5 AS y FROM x -- y")
def remap_periodic(spark, sf_dir):
    return angles_of(spark, sf_dir).select("event_id", angles.remap_periodic(F.col("x"), 0.5, 3.0).alias("y"))


@query(f"WITH {X} SELECT event_id, sqrt(x * x + 4) AS size, atan2(2, x) AS angle, (x * x - 4) / (x * x + 4) AS ratio_re FROM x -- size angle ratio_re")
def complex_accessors(spark, sf_dir):
    z = angles.complex_struct(F.col("x"), F.lit(2.0))
    rows = angles_of(spark, sf_dir).select("event_id", z.alias("z"))
    ratio = angles.divide(F.col("z"), angles.conjugate(F.col("z")))
    return rows.select("event_id", angles.magnitude(F.col("z.re"), F.col("z.im")).alias("size"), angles.angle(F.col("z.re"), F.col("z.im")).alias("angle"), ratio["re"].alias("ratio_re"))


@query("SELECT event_id, ts > TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AS inside, user_id % 10 >= 2 AND user_id % 10 + 3 <= 9 AS subset, user_id || '_' || event_id AS label FROM events")
def window_predicates(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    u = F.col("user_id") % 10
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return rows.select("event_id", text.in_window(F.col("ts"), day("2024-01-10"), day("2024-01-20")).alias("inside"), text.window_inside(u, u + 3, F.lit(2), F.lit(9)).alias("subset"), text.window_label(F.col("user_id"), F.col("event_id")).alias("label"))


@query("SELECT o_orderkey AS id, 'k' AS key, (o_orderkey % 7)::VARCHAR AS value FROM orders UNION ALL SELECT o_orderkey, 'url', 'a:b' FROM orders")
def settings_io(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    body = F.concat(F.lit("k: 0\nno pair\nurl: a:b\nk:  "), (F.col("o_orderkey") % 7).cast("string"))
    return rows.select(F.col("o_orderkey").alias("id"), F.explode(text.parse_settings(body)).alias("key", "value"))


@query("SELECT p_partkey AS id, p_partkey % 5 + 0.25 AS c1, 2.0 AS c2, -1.5 AS c3 FROM part -- c1 c2 c3")
def get_coords_for_channel(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    z = geometry.parse_coords(F.concat((F.col("p_partkey") % 5 + 0.25).cast("string"), F.lit(", 2.0 ,-1.5")))
    return rows.select(F.col("p_partkey").alias("id"), z.alias("z")).select("id", "z.c1", "z.c2", "z.c3")


@query(f"WITH {EVENTS} SELECT event_id, CASE WHEN ch_ix = 0 THEN -value ELSE value END AS value FROM ev -- value")
def src_lhd_flip(spark, sf_dir):
    names = F.array(*map(F.lit, ["LHD-MP5", "HMP01", "MP1", "-MP5", "X-1"]))
    rows = event_samples(spark, sf_dir).withColumn("channel", F.get(names, F.col("ch_ix")))
    return files.flip_sign(rows, "channel").select("event_id", "value")


@query("SELECT shot, main_current, sec_current, sec_current / main_current AS kh FROM (SELECT s_suppkey AS shot, s_suppkey * 2.0 + 1 AS main_current, s_suppkey + 0.5 AS sec_current FROM supplier) -- main_current sec_current kh")
def src_h1(spark, sf_dir):
    from tideline.sources.tables import shots

    return shots(spark, sf_dir).select("shot", "main_current", "sec_current", (F.col("sec_current") / F.col("main_current")).alias("kh"))


@query("SELECT date_trunc('hour', ts) - INTERVAL (hour(ts) % 4) HOUR AS start, event_type, count(*) AS n, avg(value) AS mean, sum(value * value) AS energy FROM events GROUP BY ALL -- mean energy", digits=6)
def stream_windowed_energy(spark, sf_dir):
    """The streaming transform over a finite table."""
    from tideline.streaming import live

    out = live.windowed_energy(table(spark, sf_dir, "events"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    from tideline.streaming import live

    out = live.sessions(table(spark, sf_dir, "events"), "2 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_id FROM events")
def equal_except_for(spark, sf_dir):
    """Rows that differ only in an ignored column are equal; all events are compared and returned if so, none if not."""
    from tideline.operators.signals import equal_except_for as equal

    rows = table(spark, sf_dir, "events").select("event_id", "value")
    alike = equal(rows, rows.withColumn("value", F.lit(0.0)), ("value",)) and not equal(rows, rows.withColumn("value", F.lit(0.0)))
    return rows.select("event_id").where(F.lit(alike))
