"""Queries on decompositions, structures, filters, tapers and generated signals, over signals derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import bessel, tapers
from tideline.operators import features, filters, reports, signals, spectral, structures
from tideline.plans.base import DAILY, EVENTS, GRID, STFT, query
from tideline.sources import synthetic
from tideline.sources.files import written
from tideline.sources.tables import daily, event_grid, event_samples, status_days

#: Windows of 120 days of the three daily channels, and the squared singular values of each: the eigenvalues of the 3 x 3 Gram matrix by the trigonometric formula.
EIGEN = (
    DAILY
    + """,
last AS (SELECT shot, max(sample_ix) + 1 AS n FROM daily GROUP BY 1),
seg AS (SELECT d.shot, d.sample_ix // 120 AS seg_ix, sample_ix, max(CASE ch_ix WHEN 0 THEN value END) AS a, max(CASE ch_ix WHEN 1 THEN value END) AS b, max(CASE ch_ix WHEN 2 THEN value END) AS c
        FROM daily d JOIN last USING (shot) WHERE (d.sample_ix // 120 + 1) * 120 < n GROUP BY ALL),
gm AS (SELECT shot, seg_ix, sum(a * a) AS aa, sum(b * b) AS bb, sum(c * c) AS cc, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * c) AS bc FROM seg GROUP BY ALL),
g1 AS (SELECT *, (aa + bb + cc) / 3 AS q FROM gm),
g2 AS (SELECT *, sqrt((pow(aa - q, 2) + pow(bb - q, 2) + pow(cc - q, 2) + 2 * (ab * ab + ac * ac + bc * bc)) / 6) AS p FROM g1),
g3 AS (SELECT *, acos(greatest(-1.0, least(1.0, ((aa - q) * ((bb - q) * (cc - q) - bc * bc) - ab * (ab * (cc - q) - bc * ac) + ac * (ab * bc - (bb - q) * ac)) / (2 * p * p * p)))) / 3 AS phi FROM g2),
eig AS (SELECT shot, seg_ix, 3 * q AS total, n::INT AS number, CASE n WHEN 0 THEN q + 2 * p * cos(phi) WHEN 2 THEN q + 2 * p * cos(phi + 2 * pi() / 3) ELSE q - 2 * p * (cos(phi) + cos(phi + 2 * pi() / 3)) END AS s2 FROM g3, range(3) r(n))"""
)


def decomposed(spark, sf_dir):
    return structures.svd(signals.segment(written(daily(spark, sf_dir)), 120))


@query(f"WITH {EIGEN}, h AS (SELECT shot, seg_ix, -sum(s2 / total * ln(s2 / total)) / ln(3) AS entropy FROM eig GROUP BY ALL) SELECT shot, seg_ix, number, sqrt(s2) / 1e3 AS svs, s2 / total AS p, entropy FROM eig JOIN h USING (shot, seg_ix) -- svs p entropy")
def rep_svd(spark, sf_dir):
    return reports.rep_svd(decomposed(spark, sf_dir)).withColumn("svs", F.col("svs") / 1e3)


@query(f"WITH {EIGEN} SELECT shot, seg_ix, sum(s2) / total AS energy FROM eig WHERE number IN (0, 2) GROUP BY shot, seg_ix, total -- energy")
def rep_energy(spark, sf_dir):
    """Share of the first and third singular value."""
    return reports.rep_energy(decomposed(spark, sf_dir), (0, 2))


@query(f"""WITH {EIGEN}, w AS (SELECT shot, seg_ix, max(CASE number WHEN 0 THEN s2 / total END) AS p0, max(CASE number WHEN 2 THEN s2 / total END) AS p2 FROM eig GROUP BY ALL)
SELECT shot, seg_ix, v.step, v.number, CASE v.step WHEN 0 THEN p0 WHEN 1 THEN p0 + p2 ELSE p2 END AS energy FROM w, (VALUES (0, 0), (1, 2), (2, 0)) v(step, number) -- energy""")
def rep_running_energy(spark, sf_dir):
    """The first and the third singular value are chosen, then the first is taken off."""
    return reports.rep_running_energy(decomposed(spark, sf_dir), (0, 2, 0))


@query(f"WITH {EIGEN.replace('// 120', '// 100000').replace('* 120 < n', '* 100000 > n')} SELECT shot, seg_ix, number, sqrt(s2) / 1e3 AS svs, s2 / total AS p FROM eig -- svs p")
def svd_tree(spark, sf_dir):
    """Whole shots by the tree of reductions, in blocks of 64 days."""
    found = structures.long_svd(written(daily(spark, sf_dir)), 64, 4)
    return reports.rep_svd(found).select("shot", "seg_ix", "number", (F.col("svs") / 1e3).alias("svs"), "p")


@query(f"WITH {DAILY}, i AS (SELECT DISTINCT shot, sample_ix FROM daily) SELECT shot, number::INT AS number, 1.0::DOUBLE AS size, count(*) AS n FROM i, range(3) r(number) GROUP BY ALL -- size")
def svd_chronos(spark, sf_dir):
    """Chronos of whole shots have unit length."""
    smp = written(daily(spark, sf_dir))
    z = structures.chronos(smp, written(structures.long_svd(smp, 64, 4)), 64)
    return z.groupBy("shot", "number").agg(F.sum(F.col("chrono") * F.col("chrono")).alias("size"), F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT l_orderkey AS id, l_quantity * l_quantity AS s2 FROM lineitem), e AS (SELECT id, sum(s2) AS energy, max(s2) / sum(s2) AS p0, count(*) AS n, sum(s2) AS t FROM l GROUP BY 1)
SELECT id, any_value(energy) AS energy, any_value(p0) AS p0, CASE WHEN any_value(n) > 1 THEN -sum(s2 / t * ln(s2 / t)) / ln(any_value(n)) ELSE 0 END AS entropy FROM l JOIN e USING (id) GROUP BY id -- energy p0 entropy""")
def svd_energies_entropy(spark, sf_dir):
    """The quantities of an order are taken for its singular values."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list("l_quantity"), asc=False).alias("svs"))
    e = structures.energy_columns(F.col("svs"))
    return rows.select("id", e["energy"].alias("energy"), F.get(e["p"], F.lit(0)).alias("p0"), e["entropy"].alias("entropy"))


#: Two channels (line status) in windows of 120 days, freed of their mean and of unit rms: c is their product sum, so that the squared singular values are n + |c|
#: and n - |c| and the chronos go with x0 + x1 and x0 - x1, or the other way round. ``found`` has both groupings' structures.
TWO = """
cells AS (SELECT year(l_shipdate)::BIGINT AS shot, (dayofyear(l_shipdate) - 1)::BIGINT AS sample_ix, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS ch_ix, sum(round(l_extendedprice * 100)::BIGINT) AS c FROM lineitem GROUP BY ALL),
two AS (SELECT s.shot, v.ch_ix, s.sample_ix, s.sample_ix::DOUBLE AS t, coalesce(c.c, 0)::DOUBLE / 100.0 AS value FROM (SELECT DISTINCT shot, sample_ix FROM cells) s CROSS JOIN (VALUES (0), (1)) v(ch_ix)
        LEFT JOIN cells c ON c.shot = s.shot AND c.sample_ix = s.sample_ix AND c.ch_ix = v.ch_ix),
len AS (SELECT shot, max(sample_ix) + 1 AS n FROM two GROUP BY 1),
cut AS (SELECT d.*, sample_ix // 120 AS seg_ix FROM two d JOIN len USING (shot) WHERE (sample_ix // 120 + 1) * 120 < n),
mid AS (SELECT *, value - avg(value) OVER (PARTITION BY shot, seg_ix, ch_ix) AS v, row_number() OVER (PARTITION BY shot, seg_ix, ch_ix ORDER BY sample_ix) - 1 AS k FROM cut),
unit AS (SELECT *, v / sqrt(avg(v * v) OVER (PARTITION BY shot, seg_ix, ch_ix)) AS x, sqrt(avg(v * v) OVER (PARTITION BY shot, seg_ix, ch_ix)) AS scale FROM mid),
pair AS (SELECT shot, seg_ix, k, max(t) AS t, max(CASE ch_ix WHEN 0 THEN x END) AS x0, max(CASE ch_ix WHEN 1 THEN x END) AS x1, sqrt((max(CASE ch_ix WHEN 0 THEN scale * scale END) + max(CASE ch_ix WHEN 1 THEN scale * scale END)) / 2) AS rms FROM unit GROUP BY ALL),
base AS (SELECT shot, seg_ix, count(*) AS n, sum(x0 * x1) AS c, avg(t) AS time, max(CASE k WHEN 1 THEN t END) - max(CASE k WHEN 0 THEN t END) AS dt, max(rms) AS rms FROM pair GROUP BY ALL),
y AS (SELECT p.shot, p.seg_ix, k, n, x0 + sign(c) * x1 AS y0, x0 - sign(c) * x1 AS y1, x0, x1 FROM pair p JOIN base USING (shot, seg_ix)),
dft AS (SELECT shot, seg_ix, f::INT AS f, any_value(n) AS n, sum(y0 * cos(2 * pi() * f * k / n)) AS r0, -sum(y0 * sin(2 * pi() * f * k / n)) AS i0, sum(y1 * cos(2 * pi() * f * k / n)) AS r1, -sum(y1 * sin(2 * pi() * f * k / n)) AS i1,
               sum(x0 * cos(2 * pi() * f * k / n)) AS c0, -sum(x0 * sin(2 * pi() * f * k / n)) AS s0, sum(x1 * cos(2 * pi() * f * k / n)) AS c1, -sum(x1 * sin(2 * pi() * f * k / n)) AS s1 FROM y, range(120) r(f) WHERE f < n GROUP BY ALL),
top AS (SELECT shot, seg_ix, arg_max(f, r0 * r0 + i0 * i0) AS f0, arg_max(f, r1 * r1 + i1 * i1) AS f1 FROM dft WHERE f < n // 2 GROUP BY ALL),
gam AS (SELECT shot, seg_ix, pow(avg(sqrt(r0 * r0 + i0 * i0) * sqrt(r1 * r1 + i1 * i1)), 2) AS met FROM dft GROUP BY ALL),
all_ AS (SELECT b.*, f0, f1, met / (4 * (n + abs(c)) * (n - abs(c))) > 0.2 AS joint, (n + abs(c)) / (2.0 * n) AS pa, (n - abs(c)) / (2.0 * n) AS pb FROM base b JOIN top USING (shot, seg_ix) JOIN gam USING (shot, seg_ix)),
h AS (SELECT *, -(pa * ln(pa) + pb * ln(pb)) / ln(2) AS entropy, 2.0 * n AS energy FROM all_),
single AS (SELECT *, 0 AS fs_ix, 1::BIGINT AS svs_mask, f0 / (n * dt) AS freq, pa AS p, 0.0 AS a12, f0 AS at FROM h UNION ALL SELECT *, 1, 2, f1 / (n * dt), pb, 0.0, f1 FROM h),
threshold AS (SELECT * FROM single WHERE NOT joint UNION ALL SELECT *, 0, 3, f0 / (n * dt), 1.0, sqrt(pb / pa), f0 FROM h WHERE joint)"""


def structures_of(spark, sf_dir, **options):
    return structures.structures(signals.segment(written(status_days(spark, sf_dir)), 120), **options)


@query(f"WITH {TWO} SELECT shot, seg_ix, fs_ix, svs_mask, freq, p, a12, entropy FROM single -- freq p a12 entropy")
def flucstruc(spark, sf_dir):
    """Two daily channels; with two singular values the geometric grouping keeps them apart."""
    return structures_of(spark, sf_dir).select("shot", "seg_ix", "fs_ix", "svs_mask", "freq", "p", "a12", "entropy")


@query(f"WITH {TWO} SELECT shot, seg_ix, fs_ix, svs_mask, freq, p, a12 FROM threshold -- freq p a12")
def fs_group_threshold(spark, sf_dir):
    return structures_of(spark, sf_dir, group="threshold").select("shot", "seg_ix", "fs_ix", "svs_mask", "freq", "p", "a12")


@query(f"WITH {TWO} SELECT shot, seg_ix, fs_ix, freq, p, sqrt(p) * rms / 1e3 AS amplitude, p * energy * rms * rms / 1e9 AS adjusted_energy FROM threshold WHERE p > 0.45 AND freq > 0.01 AND freq < 0.4 -- freq p amplitude adjusted_energy")
def fs_valid(spark, sf_dir):
    out = structures.derived_amplitudes(structures.valid_structures(structures_of(spark, sf_dir, group="threshold"), 0.45, 1, 0.01, 0.4))
    return out.select("shot", "seg_ix", "fs_ix", "freq", "p", (F.col("amplitude") / 1e3).alias("amplitude"), (F.col("adjusted_energy") / 1e9).alias("adjusted_energy"))


@query(f"WITH {TWO} SELECT shot, seg_ix, fs_ix, p FROM threshold WHERE fs_ix = 0 -- p")
def fs_limit(spark, sf_dir):
    """The first structure of each segment."""
    return structures.first_structures(structures_of(spark, sf_dir, group="threshold"), 1).select("shot", "seg_ix", "fs_ix", "p")


@query(f"""WITH {TWO}, d AS (SELECT t.shot, t.seg_ix, t.fs_ix, CASE WHEN svs_mask = 3 THEN atan2(s1, c1) - atan2(s0, c0) WHEN (svs_mask = 1) = (c > 0) THEN 0 ELSE pi() END AS d FROM threshold t JOIN dft ON dft.shot = t.shot AND dft.seg_ix = t.seg_ix AND dft.f = t.at)
SELECT shot, seg_ix, fs_ix, place::INT AS place, abs(atan2(sin(d), cos(d))) AS dphase FROM d, range(2) r(place) -- dphase""")
def rep_fs_phase(spark, sf_dir):
    """Steps between the two channels, closed; as magnitudes, since half a turn has either sign."""
    return reports.rep_fs_phase(structures_of(spark, sf_dir, group="threshold")).withColumn("dphase", F.abs("dphase"))


@query(f"""WITH {TWO}, q AS (SELECT shot, time, CASE WHEN floor(time) = time THEN time END AS hit FROM threshold),
o AS (SELECT DISTINCT q.shot, q.time, (SELECT value FROM two WHERE two.shot = q.shot AND ch_ix = 0 AND t <= q.time ORDER BY t DESC LIMIT 1) AS v0, (SELECT max(t) FROM two WHERE two.shot = q.shot AND t <= q.time) AS t0,
             (SELECT value FROM two WHERE two.shot = q.shot AND ch_ix = 0 AND t >= q.time ORDER BY t LIMIT 1) AS v1, (SELECT min(t) FROM two WHERE two.shot = q.shot AND t >= q.time) AS t1 FROM q)
SELECT s.shot, seg_ix, fs_ix, s.time, freq, p, entropy, svs_mask, CASE WHEN t1 > t0 THEN v0 + (s.time - t0) / (t1 - t0) * (v1 - v0) ELSE v0 END AS other FROM threshold s JOIN o ON o.shot = s.shot AND o.time = s.time WHERE p > 0.05 -- time freq p entropy other""")
def single_shot_extraction(spark, sf_dir):
    """Structures with the first channel interpolated to their times."""
    smp = written(status_days(spark, sf_dir))
    out = features.by_structures(smp, 120, min_svs=1, other=signals.get_channel(smp, 0), group="threshold")
    return out.select("shot", "seg_ix", "fs_ix", "time", "freq", "p", "entropy", "svs_mask", F.get("other", F.lit(0)).alias("other"))


def psd_sql(channel: int) -> str:
    hann = "(0.5 - 0.5 * cos(2 * pi() * k / 15))"
    return f"""rate AS (SELECT shot, (count(*) - 1) / (max(t) - min(t)) AS rate FROM grid WHERE ch_ix = {channel} GROUP BY 1), hw AS (SELECT sum({hann} * {hann}) AS w2 FROM range(16) r(k)),
hs AS (SELECT shot, win_ix, avg(t) AS t, f_ix::INT AS f_ix, round(f_ix / (16 * ((max(t) - min(t)) / 15)), 4) AS f, sum(value * {hann} * cos(2 * pi() * f_ix * k / 16)) AS re, sum(value * {hann} * sin(2 * pi() * f_ix * k / 16)) AS im
       FROM win, range(9) f(f_ix) WHERE ch_ix = {channel} GROUP BY shot, win_ix, f_ix),
psd AS (SELECT shot, win_ix, t, f_ix, f, 10 * log10(CASE WHEN f_ix IN (0, 8) THEN 1 ELSE 2 END * (re * re + im * im) / (rate * w2)) AS psd_db FROM hs JOIN rate USING (shot), hw)"""


@query(f"WITH {STFT}, {psd_sql(0)} SELECT * FROM psd -- t f psd_db", digits=3)
def spectrogram(spark, sf_dir):
    return spectral.spectrogram(event_grid(spark, sf_dir), 16, 8)


@query(f"WITH {STFT}, {psd_sql(2)} SELECT * FROM psd -- t f psd_db", digits=3)
def rep_spectrogram(spark, sf_dir):
    return reports.rep_spectrogram(event_grid(spark, sf_dir), 16, 8, 2)


@query(f"WITH {STFT} SELECT shot, ch_ix, win_ix, f_ix, 20 * log10(sqrt(re * re + im * im)) AS db, f / 0.25 AS normalised FROM spec -- db normalised", digits=3)
def log_spectrum_and_frequencies(spark, sf_dir):
    out = spectral.log_spectrum(spectral.stft(event_grid(spark, sf_dir), 16, 8), 0.25)
    return out.select("shot", "ch_ix", "win_ix", "f_ix", "db", "normalised")


BAND = ((0.2, 0.4), (0.1, 0.55), 1.0, 10.0, 2.0)  # of a sampling rate of 2, so that 1 is the highest frequency


def recursion_sql() -> str:
    """The plain recursion over the samples of each channel, one row at a time."""
    order, band = filters.least_order(*BAND[:4])
    inner, carry = "SELECT n.shot, n.ch_ix, n.k, n.sample_ix, n.t, n.value AS o0, r.* EXCLUDE (shot, ch_ix, k, sample_ix, t, y) FROM r JOIN num n ON n.shot = r.shot AND n.ch_ix = r.ch_ix AND n.k = r.k + 1", []
    for j, (b0, b1, b2, a1, a2) in enumerate(map(lambda s: tuple(map(float, s)), filters.design(order, band))):
        inner = f"SELECT *, {b0!r}::DOUBLE * o{j} + u{j} AS o{j + 1} FROM ({inner})"
        carry += [f"{b1!r}::DOUBLE * o{j} - {a1!r}::DOUBLE * o{j + 1} + v{j} AS u{j}", f"{b2!r}::DOUBLE * o{j} - {a2!r}::DOUBLE * o{j + 1} AS v{j}"]
    n = len(carry) // 2
    start = ", ".join(f"0.0::DOUBLE AS u{j}, 0.0::DOUBLE AS v{j}" for j in range(n))
    first = f"SELECT shot, ch_ix, -1::BIGINT AS k, -1::BIGINT AS sample_ix, 0.0::DOUBLE AS t, 0.0::DOUBLE AS y, {start} FROM (SELECT DISTINCT shot, ch_ix FROM num)"
    return f"num AS (SELECT *, row_number() OVER (PARTITION BY shot, ch_ix ORDER BY sample_ix) - 1 AS k FROM grid), r AS ({first} UNION ALL SELECT shot, ch_ix, k, sample_ix, t, o{n} AS y, {', '.join(carry)} FROM ({inner}))"


@query(f"WITH RECURSIVE {GRID}, {recursion_sql()} SELECT shot, ch_ix, sample_ix, t, y AS value FROM r WHERE k >= 0 -- t value")
def butterworth_bandpass(spark, sf_dir):
    """In blocks of 32 samples, so that states are handed on."""
    return filters.bandpass(event_grid(spark, sf_dir), *BAND, size=32)


INSIDE = f"({tapers.KAISER!r}::DOUBLE * sqrt(greatest(0.0, 1 - pow(2.0 * k / 31 - 1, 2))))"
TAPER_SQL = {
    "none": "1.0", "hamming": "0.54 - 0.46 * cos(x)", "hann": "0.5 - 0.5 * cos(x)", "blackman": "0.42 - 0.5 * cos(x) + 0.08 * cos(2 * x)",
    "flat_top": "1.0 - 1.93 * cos(x) + 1.29 * cos(2 * x) - 0.388 * cos(3 * x) + 0.032 * cos(4 * x)", "bartlett": "1 - abs(2.0 * k / 31 - 1)", "wider": "sqrt(sqrt(abs(1 - cos(x))))",
    "kaiser": f"({bessel.sql_i0e(INSIDE)}) * exp({INSIDE} - {tapers.KAISER!r}) / ({bessel.sql_i0e(f'{tapers.KAISER!r}::DOUBLE')})",
}


@query(f"WITH {GRID}, w AS (SELECT shot, ch_ix, sample_ix // 32 AS win_ix, sample_ix % 32 AS k, 2 * pi() * (sample_ix % 32) / 31 AS x, value FROM grid) " + " UNION ALL ".join(f"SELECT '{n}' AS taper, shot, ch_ix, win_ix, sum(value * ({s})) AS total FROM w GROUP BY ALL" for n, s in TAPER_SQL.items()) + " -- total", digits=3)
def taper_windows(spark, sf_dir):
    """Event channels under each taper, in windows of 32."""
    k = F.col("sample_ix") % 32
    weighted = F.explode(F.array(*[F.struct(F.lit(n).alias("taper"), (F.col("value") * tapers.taper(n, k, 32)).alias("v")) for n in TAPER_SQL])).alias("w")
    rows = event_grid(spark, sf_dir).select("shot", "ch_ix", F.floor(F.col("sample_ix") / 32).alias("win_ix"), weighted)
    return rows.groupBy("w.taper", "shot", "ch_ix", "win_ix").agg(F.sum("w.v").alias("total"))


@query(f"WITH {EVENTS} SELECT event_id, t, 1.2 * sin(2 * pi() * 0.003 * t) AS value FROM ev -- t value", digits=6)
def src_sine(spark, sf_dir):
    """The generated signal at the times of the events."""
    return synthetic.sine_at(event_samples(spark, sf_dir), amplitude=1.2, freq=0.003).select("event_id", "t", "value")


@query("SELECT i AS sample_ix, i / 250.0 - 1 AS t FROM range((SELECT count(*) FROM events)) r(i) -- t")
def gen_timebase(spark, sf_dir):
    """As many samples as there are events."""
    return synthetic.timebase(spark, spark.read.parquet(f"{sf_dir}/events.parquet").count(), 250.0, -1.0)


@query(f"WITH {EVENTS} SELECT ch_ix, event_id, 0.7 * cos(2 * pi() * 24e-4 * t + 3 * (ch_ix * 2 * pi() / 5) + 0.2) + 0.5 * cos(2 * pi() * 37e-4 * t + 4 * (ch_ix * 2 * pi() / 5) + 0.3) AS value FROM ev -- value", digits=6)
def gen_multimode(spark, sf_dir):
    """Two rotating modes, seen by five channels at the times of the events."""
    modes = (synthetic.Mode(0.7, 24e-4, 3, 0.2), synthetic.Mode(0.5, 37e-4, 4, 0.3))
    return synthetic.modes_at(event_samples(spark, sf_dir), modes, 5).select("ch_ix", "event_id", "value")


@query(f"WITH {DAILY} SELECT shot, ch_ix, count(*) AS n, sum(value) AS total FROM daily WHERE t >= 30.5 AND t < 200 GROUP BY ALL -- total")
def get_array_data(spark, sf_dir):
    """A source's samples cut to a time range."""
    rows = features.array_samples(daily(spark, sf_dir), start=30.5, end=200.0)
    return rows.groupBy("shot", "ch_ix").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query(f"""WITH {DAILY}, c AS (SELECT shot AS key, t AS x, max(CASE ch_ix WHEN 0 THEN value END) AS y1, max(CASE ch_ix WHEN 1 THEN value END) AS y2 FROM daily GROUP BY ALL),
l AS (SELECT *, y1 - y2 AS d, lag(y1 - y2) OVER w AS d0, lag(x) OVER w AS x0, lag(y1) OVER w AS y0 FROM c WINDOW w AS (PARTITION BY key ORDER BY x))
SELECT key, x, y1, y2, sign(d)::INT AS sign, false AS crossing FROM l UNION ALL SELECT key, x0 + d0 / (d0 - d) * (x - x0), y0 + d0 / (d0 - d) * (y1 - y0), y0 + d0 / (d0 - d) * (y1 - y0), 0, true FROM l WHERE d0 * d < 0 -- x y1 y2""")
def rep_pos_neg_fill(spark, sf_dir):
    """Where two of the daily channels cross."""
    rows = daily(spark, sf_dir).groupBy(F.col("shot").alias("key"), F.col("t").alias("x")).pivot("ch_ix", [0, 1]).agg(F.max("value"))
    return reports.rep_pos_neg_fill(rows.withColumnsRenamed({"0": "y1", "1": "y2"}))


@query(f"WITH {DAILY}, n AS (SELECT shot, max(sample_ix) + 1 AS n FROM daily GROUP BY 1), g AS (SELECT d.shot, sample_ix // 30 AS seg_ix, min(t) AS t0 FROM daily d JOIN n USING (shot) WHERE (sample_ix // 30 + 1) * 30 < n GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY t0, shot, seg_ix) - 1 AS place FROM g -- t0")
def order_segments_by_start(spark, sf_dir):
    return signals.ordered_segments(signals.segment(daily(spark, sf_dir), 30))


@query("SELECT event_id, row_number() OVER (ORDER BY md5('7:' || event_id), event_id) - 1 AS place FROM events")
def shuffle(spark, sf_dir):
    """A permutation of all events."""
    return signals.shuffled(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"), "event_id", 7)


@query(f"WITH {TWO}, b AS (SELECT shot, seg_ix, max(CASE WHEN ch_ix = 0 AND (round(value * 100)::BIGINT) % 211 = 0 AND value > 0 THEN 1 ELSE 0 END) AS bad FROM cut GROUP BY ALL) SELECT shot, bad = 1 AS failed, count(*) AS segments FROM b GROUP BY ALL")
def shot_failures(spark, sf_dir):
    """Structures where some days have no value: the account of the segments that failed, beside the others."""
    smp = status_days(spark, sf_dir)
    gone = (F.col("ch_ix") == 0) & (F.round(F.col("value") * 100).cast("long") % 211 == 0) & (F.col("value") > 0)
    found = structures.structures(signals.segment(written(smp.withColumn("value", F.when(gone, float("nan")).otherwise(F.col("value")))), 120))
    out = structures.account(found).groupBy("shot", F.col("error").isNotNull().alias("failed")).agg(F.sum("segments").alias("segments"))
    return out.select("shot", "failed", "segments")


#: Spectra of the two daily channels in windows of 16, 8 apart.
TWO_SPECTRA = STFT[len(GRID) :].replace("FROM grid", "FROM two").replace("len AS", "sl AS").replace("JOIN len", "JOIN sl").replace("len.n", "sl.n")


@query(f"""WITH {TWO}{TWO_SPECTRA}, a AS (SELECT s.shot, s.seg_ix, s.fs_ix, arg_min(t, (abs(t - s.time), t)) AS t FROM threshold s JOIN (SELECT DISTINCT shot, t FROM spec) USING (shot) GROUP BY ALL),
b AS (SELECT s.shot, s.seg_ix, s.fs_ix, arg_min(f, (abs(f - s.freq), f)) AS f FROM threshold s JOIN (SELECT DISTINCT shot, f FROM spec) USING (shot) GROUP BY ALL)
SELECT shot, seg_ix, fs_ix, ch_ix, re / 1e3 AS re, im / 1e3 AS im FROM a JOIN b USING (shot, seg_ix, fs_ix) JOIN spec USING (shot, t, f) -- re im""", digits=3)
def single_shot_spectrum(spark, sf_dir):
    """Structures with the spectrum of each channel at their time and frequency."""
    smp = written(status_days(spark, sf_dir))
    out = features.by_structures(smp, 120, power_cutoff=0.0, min_svs=1, spectra=written(spectral.stft(smp, 16, 8)), group="threshold")
    rows = out.select("shot", "seg_ix", "fs_ix", F.posexplode("spectrum").alias("ch_ix", "z"))
    return rows.select("shot", "seg_ix", "fs_ix", "ch_ix", (F.col("z.re") / 1e3).alias("re"), (F.col("z.im") / 1e3).alias("im"))


#: Unit eigenvectors of the Gram matrix: of the products of two rows of the matrix less the eigenvalue the longest.
VECTORS = (
    EIGEN
    + """,
rows_ AS (SELECT e.*, aa - s2 AS a1, ab AS a2, ac AS a3, ab AS b1, bb - s2 AS b2, bc AS b3, ac AS c1, bc AS c2, cc - s2 AS c3 FROM eig e JOIN gm USING (shot, seg_ix)),
crosses AS (SELECT shot, seg_ix, number, s2, unnest([[a2 * b3 - a3 * b2, a3 * b1 - a1 * b3, a1 * b2 - a2 * b1], [a2 * c3 - a3 * c2, a3 * c1 - a1 * c3, a1 * c2 - a2 * c1], [b2 * c3 - b3 * c2, b3 * c1 - b1 * c3, b1 * c2 - b2 * c1]]) AS v FROM rows_),
vec AS (SELECT shot, seg_ix, number, any_value(s2) AS s2, arg_max(v, v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) AS v, sqrt(max(v[1] * v[1] + v[2] * v[2] + v[3] * v[3])) AS size FROM crosses GROUP BY ALL)"""
)


@query(f"WITH {VECTORS} SELECT shot, seg_ix, number, ch_ix::INT AS ch_ix, abs(v[ch_ix + 1]) / size AS topo FROM vec, range(3) r(ch_ix) -- topo", digits=3)
def rep_svd_topos(spark, sf_dir):
    """Weights as magnitudes: the sign of a singular vector is free."""
    return reports.rep_svd_topos(decomposed(spark, sf_dir)).withColumn("topo", F.abs("topo"))


@query(f"""WITH {VECTORS}, num AS (SELECT *, row_number() OVER (PARTITION BY shot, seg_ix ORDER BY sample_ix) - 1 AS k, count(*) OVER (PARTITION BY shot, seg_ix) AS n FROM seg),
ch AS (SELECT m.shot, m.seg_ix, number, k, n, (v[1] * a + v[2] * b + v[3] * c) / size / sqrt(s2) AS x FROM num m JOIN vec ON vec.shot = m.shot AND vec.seg_ix = m.seg_ix)
SELECT shot, seg_ix, number, f::INT AS f_ix, f / (any_value(n) * 1e-6 * 1000) AS f_khz, sqrt(pow(sum(x * cos(2 * pi() * f * k / n)), 2) + pow(sum(x * sin(2 * pi() * f * k / n)), 2)) AS magnitude
FROM ch, range(61) r(f) WHERE f <= n // 2 AND f / (n * 1e-6 * 1000) <= 200 GROUP BY shot, seg_ix, number, f -- f_khz magnitude""", digits=3)
def rep_svd_spectra(spark, sf_dir):
    """A day is taken for a microsecond."""
    return reports.rep_svd_spectra(decomposed(spark, sf_dir), 1e-6, 200.0).withColumn("f_ix", F.col("f_ix").cast("int"))
