"""Queries on samples: slices, scales, segments, joins on time and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import features, interpolate, signals, spectral, structures
from tideline.plans.base import DAILY, EVENTS, GRID, STFT, query
from tideline.sources.files import written
from tideline.sources.tables import daily, event_grid, event_samples

KEYS = ["shot", "ch_ix", "sample_ix", "t", "value"]


@query(f"""
WITH {DAILY}, r AS (SELECT * FROM daily WHERE t >= 0 AND t < 360),
m AS (SELECT *, value - avg(value) OVER (PARTITION BY shot, ch_ix) AS v FROM r), s AS (SELECT *, v / var_pop(v) OVER (PARTITION BY shot, ch_ix) AS x FROM m),
l AS (SELECT shot, max(sample_ix) + 1 AS n FROM s GROUP BY 1)
SELECT s.shot, w.seg_ix, ch_ix, count(*) AS n, min(t) AS t0, sum(x * x) * 1e6 AS energy FROM s JOIN l USING (shot), range(100) w(seg_ix)
WHERE seg_ix * 32 < l.n - 64 AND sample_ix BETWEEN seg_ix * 32 AND seg_ix * 32 + 63 GROUP BY ALL -- t0 energy""")
def flagship_segment_energy(spark, sf_dir):
    """Daily channels, cut, freed of their mean, normalised and segmented: the energy of each segment."""
    smp = signals.Signals(written(daily(spark, sf_dir))).reduce_time(0.0, 360.0).subtract_mean().normalise("var", separate=True).samples
    return signals.segment_energy(signals.segment(smp, 64, 2)).withColumn("energy", F.col("energy") * 1e6)


@query(f"WITH {DAILY} SELECT shot, ch_ix, sample_ix, t, value FROM daily WHERE t >= 100 AND t < 200.5 -- t value")
def reduce_time(spark, sf_dir):
    return signals.reduce_time(daily(spark, sf_dir), 100.0, 200.5).select(*KEYS)


@query(f"WITH {DAILY} SELECT shot, ch_ix, sample_ix, t, value FROM daily WHERE ch_ix = 1 -- t value")
def get_channel(spark, sf_dir):
    return signals.get_channel(daily(spark, sf_dir), 1).select(*KEYS)


@query(f"WITH {DAILY} SELECT shot, count(DISTINCT ch_ix) AS n_channels, count(DISTINCT sample_ix) AS n_samples, true AS equal_length FROM daily GROUP BY 1")
def n_channels_n_samples(spark, sf_dir):
    return signals.shape(daily(spark, sf_dir))


@query(f"WITH {DAILY} SELECT shot, ch_ix, sample_ix, t, value FROM daily WHERE sample_ix % 7 = 0 -- t value")
def downsample(spark, sf_dir):
    return signals.downsample(daily(spark, sf_dir), 7).select(*KEYS)


@query(f"WITH {DAILY} SELECT shot, ch_ix, sample_ix, t, value - avg(value) OVER (PARTITION BY shot, ch_ix) AS value FROM daily -- t value")
def subtract_mean(spark, sf_dir):
    return signals.subtract_mean(daily(spark, sf_dir)).select(*KEYS)


def normalise_sql(scale: str, separate: bool) -> str:
    joint = "s" if separate else "max(s) OVER (PARTITION BY shot)"
    return f"""WITH {DAILY}, o AS (SELECT *, {scale} OVER (PARTITION BY shot, ch_ix) AS s0 FROM daily), o1 AS (SELECT *, {"sqrt(s0)" if "value * value" in scale else "s0"} AS s FROM o),
o2 AS (SELECT *, {joint} AS scale FROM o1) SELECT shot, ch_ix, sample_ix, t, value / scale * 1000 AS value, scale / 1e8 AS scale FROM o2 -- t value scale"""


def normalise_query(name: str, method: str, scale: str, separate: bool) -> None:
    def f(spark, sf_dir):
        out = signals.normalise(daily(spark, sf_dir), method, separate)
        return out.select("shot", "ch_ix", "sample_ix", "t", (F.col("value") * 1000).alias("value"), (F.col("scale") / 1e8).alias("scale"))

    f.__name__ = name
    query(normalise_sql(scale, separate))(f)


for _sep in (False, True):
    _tail = "separate" if _sep else "joint"
    normalise_query(f"normalise_peak_{_tail}", "peak", "max(abs(value))", _sep)
    normalise_query(f"normalise_rms_{_tail}", "r", "avg(value * value)", _sep)
    normalise_query(f"normalise_var_{_tail}", "var", "var_pop(value)", _sep)


@query(f"""WITH {DAILY}, s AS (SELECT shot, ch_ix, max(abs(value)) AS scale FROM daily GROUP BY ALL) SELECT shot, sqrt(avg(scale * scale)) AS rms_scale FROM s GROUP BY 1 -- rms_scale""")
def rms_of_scales(spark, sf_dir):
    return signals.rms_of_scales(signals.scales(daily(spark, sf_dir), "peak", separate=True))


CONTIGUOUS = """d AS (SELECT shot, ch_ix, sample_ix, lead(t) OVER (PARTITION BY shot, ch_ix ORDER BY sample_ix) - t AS dt FROM {rel}),
f AS (SELECT shot, ch_ix, arg_min(dt, sample_ix) AS d0 FROM d WHERE dt IS NOT NULL GROUP BY ALL),
c AS (SELECT shot, ch_ix, max(pow(dt - d0, 2)) < pow(0.1 * min(d0), 2) AS contiguous FROM d JOIN f USING (shot, ch_ix) WHERE dt IS NOT NULL GROUP BY ALL)"""
ORDERED = f"{EVENTS}, e2 AS (SELECT shot, ch_ix, row_number() OVER (PARTITION BY shot, ch_ix ORDER BY t, event_id) - 1 AS sample_ix, t, value FROM ev), mixed AS (SELECT shot, ch_ix, sample_ix, t, value FROM daily UNION ALL SELECT shot, ch_ix, sample_ix, t, value FROM e2)"


def mixed(spark, sf_dir):
    """Even daily shots and uneven event shots."""
    from pyspark.sql import Window

    ev = event_samples(spark, sf_dir).withColumn("sample_ix", (F.row_number().over(Window.partitionBy("shot", "ch_ix").orderBy("t", "event_id")) - 1).cast("long"))
    return daily(spark, sf_dir).select(*KEYS).unionByName(ev.select(*KEYS))


@query(f"WITH {DAILY}, {ORDERED}, {CONTIGUOUS.format(rel='mixed')} SELECT * FROM c")
def is_contiguous(spark, sf_dir):
    return signals.contiguity(mixed(spark, sf_dir))


@query(f"WITH {DAILY}, {ORDERED}, {CONTIGUOUS.format(rel='mixed')} SELECT shot, ch_ix, sample_ix, t, value FROM mixed WHERE shot IN (SELECT shot FROM c GROUP BY 1 HAVING bool_and(contiguous)) -- t value")
def remove_noncontiguous(spark, sf_dir):
    return signals.remove_noncontiguous(mixed(spark, sf_dir))


@query(f"""WITH {DAILY}, l AS (SELECT shot, max(sample_ix) + 1 AS n FROM daily GROUP BY 1)
SELECT d.shot, w.seg_ix, ch_ix, count(*) AS n, min(t) AS t0, sum(value) AS total FROM daily d JOIN l USING (shot), range(200) w(seg_ix)
WHERE seg_ix * 25 < l.n - 50 AND sample_ix BETWEEN seg_ix * 25 AND seg_ix * 25 + 49 GROUP BY ALL -- t0 total""")
def segment(spark, sf_dir):
    rows = signals.segment(daily(spark, sf_dir), 50, 2)
    return rows.groupBy("shot", "seg_ix", "ch_ix").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.sum("value").alias("total"))


@query(f"WITH {DAILY} SELECT a.shot, sum(a.value * b.value) / 1e6 AS correlation FROM daily a JOIN daily b USING (shot, sample_ix) WHERE a.ch_ix = 0 AND b.ch_ix = 2 GROUP BY 1 -- correlation")
def correlate(spark, sf_dir):
    out = signals.correlate(daily(spark, sf_dir), 0, 2)
    return out.withColumn("correlation", F.col("correlation") / 1e6)


@query(f"WITH {GRID} SELECT a.shot, a.sample_ix - b.sample_ix AS lag, sum(a.value * b.value) AS correlation FROM grid a JOIN grid b USING (shot) WHERE a.ch_ix = 0 AND b.ch_ix = 1 GROUP BY ALL -- correlation", digits=3)
def correlate_full(spark, sf_dir):
    return signals.correlate(event_grid(spark, sf_dir), 0, 1, "full")


@query(f"WITH {DAILY}, d AS (SELECT shot, ch_ix, sample_ix, lead(value) OVER (PARTITION BY shot, sample_ix ORDER BY ch_ix) - value AS difference FROM daily) SELECT * FROM d WHERE difference IS NOT NULL -- difference")
def channel_differences(spark, sf_dir):
    return signals.neighbour_differences(daily(spark, sf_dir)).select("shot", "ch_ix", "sample_ix", "difference")


@query(f"WITH {DAILY} SELECT shot, ch_ix, sample_ix, sum(value) OVER (PARTITION BY shot, ch_ix ORDER BY sample_ix) AS running FROM daily -- running", digits=2)
def cumsum(spark, sf_dir):
    return signals.running_sum(daily(spark, sf_dir)).select("shot", "ch_ix", "sample_ix", "running")


@query(f"""WITH {GRID}, p AS (SELECT shot, ch_ix, sample_ix, atan2(sin(value), cos(value)) AS v FROM grid), d AS (SELECT *, v - lag(v) OVER w AS step FROM p WINDOW w AS (PARTITION BY shot, ch_ix ORDER BY sample_ix)),
j AS (SELECT *, CASE WHEN abs(step) > pi() THEN -2 * pi() * round(step / (2 * pi())) ELSE 0 END AS jump FROM d)
SELECT shot, ch_ix, sample_ix, v + sum(coalesce(jump, 0)) OVER (PARTITION BY shot, ch_ix ORDER BY sample_ix) AS value FROM j -- value""")
def phase_unwrap(spark, sf_dir):
    p = event_grid(spark, sf_dir).withColumn("value", F.atan2(F.sin("value"), F.cos("value")))
    return signals.unwrap(p).select("shot", "ch_ix", "sample_ix", "value")


INTERPOLATED = """k AS (SELECT shot, ch_ix, t, avg(value) AS value FROM ev GROUP BY ALL), q AS (SELECT DISTINCT k.shot, k.ch_ix, (h * 21600)::DOUBLE AS t FROM k, range(122) r(h)),
u AS (SELECT shot, ch_ix, t, value, 0 AS g FROM k UNION ALL SELECT shot, ch_ix, t, NULL, 1 FROM q),
b AS (SELECT *, last_value(CASE WHEN g = 0 THEN t END IGNORE NULLS) OVER lo AS t0, last_value(value IGNORE NULLS) OVER lo AS v0,
             last_value(CASE WHEN g = 0 THEN t END IGNORE NULLS) OVER hi AS t1, last_value(value IGNORE NULLS) OVER hi AS v1
      FROM u WINDOW lo AS (PARTITION BY shot, ch_ix ORDER BY t, g), hi AS (PARTITION BY shot, ch_ix ORDER BY t DESC, g))"""


@query(f"WITH {EVENTS}, {INTERPOLATED} SELECT shot, ch_ix, t, CASE WHEN t1 > t0 THEN v0 + (t - t0) / (t1 - t0) * (v1 - v0) ELSE coalesce(v0, v1) END AS value FROM b WHERE g = 1 -- t value")
def change_time_base(spark, sf_dir):
    grid = spark.range(4).select(F.col("id").alias("shot"), F.explode(F.sequence(F.lit(0), F.lit(121))).alias("h")).select("shot", (F.col("h") * 21600).cast("double").alias("t"))
    return interpolate.change_time_base(event_samples(spark, sf_dir), grid)


@query(f"""WITH {EVENTS}, first AS (SELECT shot, sample_ix, t FROM (SELECT shot, row_number() OVER (PARTITION BY shot ORDER BY t, event_id) - 1 AS sample_ix, t FROM ev WHERE ch_ix = 0)),
k AS (SELECT shot, ch_ix, t, avg(value) AS value FROM ev WHERE ch_ix > 0 GROUP BY ALL), q AS (SELECT DISTINCT f.shot, c.ch_ix, f.t FROM first f JOIN (SELECT DISTINCT shot, ch_ix FROM k) c USING (shot)),
u AS (SELECT shot, ch_ix, t, value, 0 AS g FROM k UNION ALL SELECT shot, ch_ix, t, NULL, 1 FROM q),
b AS (SELECT *, last_value(CASE WHEN g = 0 THEN t END IGNORE NULLS) OVER lo AS t0, last_value(value IGNORE NULLS) OVER lo AS v0,
             last_value(CASE WHEN g = 0 THEN t END IGNORE NULLS) OVER hi AS t1, last_value(value IGNORE NULLS) OVER hi AS v1
      FROM u WINDOW lo AS (PARTITION BY shot, ch_ix ORDER BY t, g), hi AS (PARTITION BY shot, ch_ix ORDER BY t DESC, g))
SELECT shot, ch_ix, t, CASE WHEN t1 > t0 THEN v0 + (t - t0) / (t1 - t0) * (v1 - v0) ELSE coalesce(v0, v1) END AS value FROM b WHERE g = 1
UNION ALL SELECT shot, 0, t, value FROM ev WHERE ch_ix = 0 -- t value""")
def src_multichannel(spark, sf_dir):
    """Event channels on the time base of the first one."""
    from pyspark.sql import Window

    ev = event_samples(spark, sf_dir).withColumn("sample_ix", (F.row_number().over(Window.partitionBy("shot", "ch_ix").orderBy("t", "event_id")) - 1).cast("long"))
    return interpolate.multichannel(ev.select(*KEYS))


@query(f"""WITH {EVENTS}, p AS (SELECT * FROM ev WHERE ch_ix = 0), c AS (SELECT DISTINCT shot, t FROM ev WHERE ch_ix = 1),
j AS (SELECT p.event_id, c.t, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(c.t - p.t), c.t) AS n FROM p JOIN c USING (shot)) SELECT event_id, t AS t_nearest FROM j WHERE n = 1 -- t_nearest""")
def nearest_index(spark, sf_dir):
    ev = event_samples(spark, sf_dir)
    out = interpolate.nearest(ev.where("ch_ix = 0").select("event_id", "shot", "t"), ev.where("ch_ix = 1").select("shot", "t"), "shot", "t", "t")
    return out.select("event_id", "t_nearest")


@query(f"""WITH {DAILY}, l AS (SELECT shot, max(sample_ix) + 1 AS n FROM daily GROUP BY 1),
a AS (SELECT DISTINCT d.shot, seg_ix, min(t) OVER (PARTITION BY d.shot, seg_ix) AS t0 FROM daily d JOIN l USING (shot), range(50) w(seg_ix) WHERE seg_ix * 30 < l.n - 30 AND sample_ix BETWEEN seg_ix * 30 AND seg_ix * 30 + 29)
SELECT shot, seg_ix, t0 AS t0_first, t0 + (CASE WHEN seg_ix % 2 = 0 THEN 0 ELSE 0.5 END) AS t0_second, seg_ix % 2 = 0 AS aligned FROM a -- t0_first t0_second""")
def seg_align(spark, sf_dir):
    seg = signals.segment(daily(spark, sf_dir), 30).groupBy("shot", "seg_ix").agg(F.min("t").alias("t0"))
    other = seg.withColumn("t0", F.col("t0") + F.when(F.col("seg_ix") % 2 == 0, 0.0).otherwise(0.5))
    return interpolate.align_segments(seg, other)


BAND = """l AS (SELECT shot, event_id AS id, t AS time, value AS freq, 1 AS side FROM ev WHERE event_id % 2 = 0), r AS (SELECT shot, event_id AS id, t AS time, value AS freq, 2 AS side FROM ev WHERE event_id % 2 = 1),
p AS (SELECT l.id AS l_id, r.id AS r_id FROM l JOIN r ON l.shot = r.shot AND abs(l.time - r.time) < 900 AND abs(l.freq - r.freq) < 20),
s AS (SELECT l_id, min(r_id) AS r_id FROM p GROUP BY 1 HAVING count(*) = 1), w AS (SELECT r_id, max(l_id) AS l_id FROM s GROUP BY 1)"""


def band_sides(spark, sf_dir):
    ev = event_samples(spark, sf_dir).select("shot", F.col("event_id").alias("id"), F.col("t").alias("time"), F.col("value").alias("freq"))
    return ev.where("id % 2 = 0"), ev.where("id % 2 = 1")


@query(f"""WITH {EVENTS}, {BAND} SELECT r.id, CASE WHEN w.l_id IS NULL THEN 'right' ELSE 'both' END AS origin, coalesce(n.shot, r.shot) AS shot, coalesce(n.time, r.time) AS time, coalesce(n.freq, r.freq) AS freq
FROM r LEFT JOIN w ON w.r_id = r.id LEFT JOIN l n ON n.id = w.l_id UNION ALL SELECT id, 'left', shot, time, freq FROM l WHERE id NOT IN (SELECT l_id FROM s) -- time freq""")
def combine_feature_sets(spark, sf_dir):
    return interpolate.combine_features(*band_sides(spark, sf_dir), time_width=900.0, freq_width=20.0)


@query(f"WITH {STFT} SELECT shot, ch_ix, win_ix, t, f_ix, f, re, im FROM spec -- t f re im")
def stft(spark, sf_dir):
    return spectral.stft(event_grid(spark, sf_dir), 16, 8)


@query(f"WITH {STFT} SELECT * FROM pow_ -- t f power", digits=3)
def spectral_mean_power(spark, sf_dir):
    return spectral.mean_power(spectral.stft(event_grid(spark, sf_dir), 16, 8))


@query(f"WITH {STFT} SELECT shot, win_ix, f_ix, min(t) AS t, min(f) AS f, ln(exp(sum(ln(sqrt(re * re + im * im))))) AS power FROM spec GROUP BY ALL -- t f power")
def spectral_product_power(spark, sf_dir):
    out = spectral.mean_power(spectral.stft(event_grid(spark, sf_dir), 16, 8), product=True)
    return out.withColumn("power", F.log("power"))


PEAKS = """b AS (SELECT *, lag(power) OVER w AS p0, lead(power) OVER w AS p1, avg(power) OVER m AS ma, count(*) OVER m AS c FROM pow_ WINDOW w AS (PARTITION BY shot, win_ix ORDER BY f_ix), m AS (PARTITION BY shot, win_ix ORDER BY f_ix ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
tops AS (SELECT *, power - CASE WHEN c = 5 THEN ma ELSE power END AS peak FROM b WHERE p0 < power AND power > p1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY shot, win_ix ORDER BY peak DESC, f_ix) AS n FROM tops), peaks AS (SELECT shot, win_ix, f_ix, t, f, power, peak FROM ranked WHERE n <= 2 AND f > 0.1 AND f < 0.4 AND peak > 0.5)"""


def peaks_of(spark, sf_dir):
    spectra = spectral.stft(event_grid(spark, sf_dir), 16, 8)
    return spectra, spectral.find_peaks(spectral.mean_power(spectra), 2, 0.1, 0.4, 0.5)


@query(f"WITH {STFT}, {PEAKS} SELECT * FROM peaks -- t f power peak", digits=3)
def find_peaks(spark, sf_dir):
    return peaks_of(spark, sf_dir)[1]


@query(f"""WITH {STFT}, b AS (SELECT *, lag(power) OVER w AS p0, lead(power) OVER w AS p1 FROM pow_ WINDOW w AS (PARTITION BY shot, win_ix ORDER BY f_ix)), tops AS (SELECT *, abs(power - p0) + abs(p1 - power) AS peak FROM b WHERE p0 < power AND power > p1),
r AS (SELECT *, row_number() OVER (PARTITION BY shot, win_ix ORDER BY peak DESC, f_ix) AS n FROM tops) SELECT shot, win_ix, f_ix, t, f, power, peak FROM r WHERE n <= 3 AND peak > 0 -- t f power peak""", digits=3)
def find_peaks_steps(spark, sf_dir):
    return spectral.find_peaks(spectral.mean_power(spectral.stft(event_grid(spark, sf_dir), 16, 8)), 3, moving=None, low=-1.0)


@query(f"WITH {STFT}, {PEAKS} SELECT s.shot, s.win_ix, s.f_ix, ch_ix, s.t AS time, s.f AS freq, re, im FROM spec s JOIN peaks USING (shot, win_ix, f_ix) -- time freq re im")
def return_values(spark, sf_dir):
    rows = spectral.gather(*peaks_of(spark, sf_dir))
    return rows.select("shot", "win_ix", "f_ix", F.posexplode("amp").alias("ch_ix", "z"), "time", "freq").select("shot", "win_ix", "f_ix", "ch_ix", "time", "freq", "z.re", "z.im")


@query(f"WITH {STFT}, {PEAKS} SELECT p.shot, p.win_ix, p.f_ix, ch_ix, re, im FROM peaks p JOIN spec s ON s.shot = p.shot AND s.win_ix = p.win_ix AND s.f_ix = 0 -- re im")
def return_values_dc(spark, sf_dir):
    rows = spectral.gather_dc(*peaks_of(spark, sf_dir))
    return rows.select("shot", "win_ix", "f_ix", F.posexplode("dc").alias("ch_ix", "z")).select("shot", "win_ix", "f_ix", "ch_ix", "z.re", "z.im")


@query(f"""WITH {STFT}, {PEAKS}, a AS (SELECT p.shot, p.win_ix, p.f_ix, ch_ix, atan2(im, re) AS a FROM peaks p JOIN spec s USING (shot, win_ix, f_ix)),
d AS (SELECT shot, win_ix, f_ix, ch_ix AS dim, lead(a) OVER (PARTITION BY shot, win_ix, f_ix ORDER BY ch_ix) - a AS d FROM a), m AS (SELECT *, d - 2 * pi() * floor(d / (2 * pi())) AS x FROM d WHERE d IS NOT NULL)
SELECT shot, win_ix, f_ix, dim, CASE WHEN x > pi() THEN x - 2 * pi() ELSE x END AS phase FROM m -- phase""")
def for_stft(spark, sf_dir):
    """Wrapped phase steps between neighbouring channels at spectral peaks."""
    rows = features.by_peaks(event_grid(spark, sf_dir), 16, 8, 2, 0.1, 0.4, 0.5)
    return rows.select("shot", "win_ix", "f_ix", F.posexplode("phases").alias("dim", "phase"))


@query(f"WITH {STFT}, r AS (SELECT *, row_number() OVER (PARTITION BY shot, ch_ix, win_ix ORDER BY re * re + im * im DESC, f_ix DESC) AS n FROM spec WHERE f >= 0.1) SELECT shot, ch_ix, win_ix, f AS freq, f_ix FROM r WHERE n = 1 -- freq")
def peak_freq(spark, sf_dir):
    return spectral.peak_freq(spectral.stft(event_grid(spark, sf_dir), 16, 8), low=0.1)


@query(f"WITH {STFT} SELECT a.shot, a.win_ix, a.f_ix, a.f, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im FROM spec a JOIN spec b USING (shot, win_ix, f_ix) WHERE a.ch_ix = 0 AND b.ch_ix = 3 -- f re im", digits=3)
def cps(spark, sf_dir):
    return spectral.cross_power(spectral.stft(event_grid(spark, sf_dir), 16, 8), 0, 3)


POINTS = "pts AS (SELECT i AS id, 1::BIGINT AS shot, i * 7.3 AS time, (i % 9) * 0.055 AS freq FROM range(20) r(i))"


def points(spark):
    return spark.range(20).select("id", F.lit(1).cast("long").alias("shot"), (F.col("id") * 7.3).alias("time"), ((F.col("id") % 9) * 0.055).alias("freq"))


@query(f"""WITH {STFT}, {POINTS}, a AS (SELECT id, arg_min(t, (abs(t - time), t)) AS t FROM pts JOIN (SELECT DISTINCT shot, t FROM spec) USING (shot) GROUP BY 1), b AS (SELECT id, arg_min(f, (abs(f - freq), f)) AS f FROM pts JOIN (SELECT DISTINCT shot, f FROM spec) USING (shot) GROUP BY 1)
SELECT id, t, f, ch_ix, re, im FROM a JOIN b USING (id) JOIN spec USING (t, f) -- t f re im""")
def spectrum_at_nearest_cell(spark, sf_dir):
    rows = spectral.spectrum_at(spectral.stft(event_grid(spark, sf_dir), 16, 8), points(spark))
    return rows.select("id", "t", "f", F.posexplode("amp").alias("ch_ix", "z")).select("id", "t", "f", "ch_ix", "z.re", "z.im")


@query(f"WITH {DAILY} SELECT shot, count(*) AS n, sum(value * value) / 1e9 AS energy FROM daily GROUP BY 1 -- energy")
def svd_energy(spark, sf_dir):
    """The energy of a decomposition equals the sum of squares of its samples."""
    out = structures.svd(daily(spark, sf_dir).withColumn("seg_ix", F.lit(0).cast("long")))
    n = daily(spark, sf_dir).groupBy("shot").agg(F.count(F.lit(1)).alias("n"))
    return out.join(n, "shot").select("shot", "n", (F.col("energy") / 1e9).alias("energy"))


@query(f"WITH {DAILY} SELECT a.shot, 0::BIGINT AS seg_ix, a.ch_ix AS ch_a, b.ch_ix AS ch_b, sum(a.value * b.value) / 1e9 AS product FROM daily a JOIN daily b USING (shot, sample_ix) WHERE a.ch_ix <= b.ch_ix GROUP BY ALL -- product")
def svd_gram(spark, sf_dir):
    out = structures.gram(daily(spark, sf_dir).withColumn("seg_ix", F.lit(0).cast("long")))
    return out.withColumn("product", F.col("product") / 1e9)


@query(f"WITH {DAILY}, a AS (SELECT * FROM daily WHERE ch_ix < 2) SELECT shot, ch_ix, sample_ix, value FROM a UNION ALL SELECT shot, ch_ix + 2, sample_ix, value FROM a -- value")
def channel_concat(spark, sf_dir):
    a = daily(spark, sf_dir).where("ch_ix < 2").select("shot", "ch_ix", "sample_ix", "value")
    return signals.stack_channels(a, a)


@query(f"WITH {DAILY}, {ORDERED} SELECT shot, ch_ix, sample_ix, value FROM mixed -- value")
def concat_shots(spark, sf_dir):
    rows = mixed(spark, sf_dir).select("shot", "ch_ix", "sample_ix", "value")
    return signals.stack_shots(rows.where("shot < 1000"), rows.where("shot >= 1000"))


@query(f"WITH {DAILY} SELECT shot, ch_ix, count(*) AS n, sum(value) AS total, min(t) AS t0, max(t) AS t1 FROM daily GROUP BY ALL -- total t0 t1", digits=2)
def pack_unpack(spark, sf_dir):
    rows = signals.unpack(signals.pack(daily(spark, sf_dir), "shot", "ch_ix"), "shot", "ch_ix")
    return rows.groupBy("shot", "ch_ix").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("t").alias("t0"), F.max("t").alias("t1"))


@query("SELECT DISTINCT user_id AS shot FROM events WHERE user_id NOT BETWEEN 20 AND 29")
def dataset_ops(spark, sf_dir):
    """Set semantics: added shots that are known change nothing, removed ones go."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("shot"))
    return signals.DataSet(users.where("shot < 40")).add(users.where("shot >= 10")).remove(users.where("shot BETWEEN 20 AND 29")).rows


@query("SELECT item_ix::INT AS item_ix, count(*) AS n FROM (SELECT 0 AS item_ix FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 1 FROM orders WHERE o_orderkey % 2 = 1) GROUP BY 1")
def ordered_dataset(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    data = signals.OrderedDataSet(rows.where("o_orderkey % 2 = 0").withColumn("item_ix", F.lit(0))).append(rows.where("o_orderkey % 2 = 1"))
    return data.rows.groupBy("item_ix").agg(F.count(F.lit(1)).alias("n"))
