"""What the registered queries share: registration, rounding and the SQL of the derived relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 4) -> Callable:
    """Registers a query under its function's name; doubles are rounded, in the SQL too (list them after ``--``)."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir), digits)
        if sql:
            text, _, doubles = sql.rpartition("--") if "--" in sql else (sql, "", "")
            changed = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split())
            ORACLES[f.__name__] = f"SELECT * REPLACE ({changed}) FROM ({text.strip()})" if changed else text.strip()
        return f

    return register


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


DAILY = """
cells AS (SELECT year(l_shipdate)::BIGINT AS shot, (dayofyear(l_shipdate) - 1)::BIGINT AS sample_ix,
                 CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS ch_ix, sum(round(l_extendedprice * 100)::BIGINT) AS c
          FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY ALL),
daily AS (SELECT s.shot, v.ch_ix, s.sample_ix, s.sample_ix::DOUBLE AS t, coalesce(c.c, 0)::DOUBLE / 100.0 AS value
          FROM (SELECT DISTINCT shot, sample_ix FROM cells) s CROSS JOIN (VALUES (0), (1), (2)) v(ch_ix)
          LEFT JOIN cells c ON c.shot = s.shot AND c.sample_ix = s.sample_ix AND c.ch_ix = v.ch_ix)"""

EVENTS = """
ev AS (SELECT user_id % 4 AS shot, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS ch_ix,
              event_id, epoch_us(ts) / 1e6 - 1704067200 AS t, value FROM events)"""

GRID = (
    EVENTS
    + """,
g0 AS (SELECT floor(t / 14400)::BIGINT AS sample_ix, ch_ix, sum(round(value * 100)::BIGINT)::DOUBLE / count(*) / 100.0 AS value FROM ev GROUP BY ALL),
grid AS (SELECT 1::BIGINT AS shot, v.ch_ix, s.sample_ix, s.sample_ix::DOUBLE AS t, coalesce(g0.value, 0.0) AS value
         FROM (SELECT DISTINCT sample_ix FROM g0) s CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(ch_ix) LEFT JOIN g0 ON g0.sample_ix = s.sample_ix AND g0.ch_ix = v.ch_ix)"""
)

FEATS = """
ph AS (SELECT vec_id AS instance_id, vec_id % 5 AS shot, vec_id * 0.001::DOUBLE AS time, abs(embedding[21]::DOUBLE) * 1000 AS freq, label AS cluster, i::INT AS dim,
              embedding[2 * i + 1]::DOUBLE AS re, embedding[2 * i + 2]::DOUBLE AS im, atan2(embedding[2 * i + 2]::DOUBLE, embedding[2 * i + 1]::DOUBLE) AS phase
       FROM embeddings, range(8) r(i))"""

KAPPA = "CASE WHEN r < 0.53 THEN 2 * r + pow(r, 3) + 5 * pow(r, 5) / 6 WHEN r < 0.85 THEN -0.4 + 1.39 * r + 0.43 / (1 - r) ELSE 1 / (2 * (1 - r)) END"

FITS = (
    FEATS
    + f""",
s0 AS (SELECT cluster, dim, count(*) AS n, avg(cos(phase)) AS c, avg(sin(phase)) AS s FROM ph GROUP BY ALL),
s1 AS (SELECT *, sqrt(c * c + s * s) AS r FROM s0),
fits AS (SELECT cluster, dim, n, atan2(s, c) AS mu, r, {KAPPA} AS kappa FROM s1)"""
)

#: Spectra of the even event signal: windows of 16, 8 apart, Hamming.
STFT = (
    GRID
    + """,
len AS (SELECT shot, ch_ix, count(*) AS n FROM grid GROUP BY ALL),
win AS (SELECT g.*, w.win_ix, g.sample_ix - w.win_ix * 8 AS k FROM grid g JOIN len USING (shot, ch_ix), range(1000) w(win_ix)
        WHERE w.win_ix * 8 < len.n - 16 AND g.sample_ix BETWEEN w.win_ix * 8 AND w.win_ix * 8 + 15),
spec AS (SELECT shot, ch_ix, win_ix, avg(t) AS t, f_ix::INT AS f_ix, round(f_ix / (16 * ((max(t) - min(t)) / 15)), 4) AS f,
                sum(value * (0.54 - 0.46 * cos(2 * pi() * k / 15)) / 16 * cos(2 * pi() * f_ix * k / 16)) AS re,
                -sum(value * (0.54 - 0.46 * cos(2 * pi() * k / 15)) / 16 * sin(2 * pi() * f_ix * k / 16)) AS im
         FROM win, range(9) f(f_ix) GROUP BY shot, ch_ix, win_ix, f_ix),
pow_ AS (SELECT shot, win_ix, f_ix, min(t) AS t, min(f) AS f, avg(re * re + im * im) AS power FROM spec GROUP BY ALL)"""
)
