"""Queries on features: fits, cluster tables, comparisons, clustering and reports."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tideline.functions import angles, bessel, geometry
from tideline.operators import cluster as clustering
from tideline.operators import features, reports, statistics
from tideline.plans.base import FEATS, FITS, STFT, query
from tideline.plans.signal_queries import POINTS, points
from tideline.sources import tables
from tideline.sources.tables import event_grid


def feats(spark, sf_dir):
    return tables.features(spark, sf_dir)


def long(spark, sf_dir):
    return statistics.long_phases(feats(spark, sf_dir).select("instance_id", "shot", "cluster", "phases"))


def fits(spark, sf_dir):
    return statistics.vm_fit(long(spark, sf_dir), "cluster", "dim")


@query(f"WITH {FITS} SELECT * FROM fits -- mu r kappa")
def vm_fit(spark, sf_dir):
    return fits(spark, sf_dir)


@query(f"WITH {FITS} SELECT cluster, dim, n, mu, greatest(0.1, least(300.0, kappa)) AS kappa FROM fits -- mu kappa")
def fit_von_mises(spark, sf_dir):
    """Fit to given assignments, concentrations held to their limits."""
    return statistics.vm_fit(long(spark, sf_dir), "cluster", "dim", clip=True).drop("r")


@query(f"""WITH {FEATS}, s0 AS (SELECT cluster, dim, count(*) AS n, sum(freq * cos(phase)) / sum(freq) AS c, sum(freq * sin(phase)) / sum(freq) AS s FROM ph GROUP BY ALL)
SELECT cluster, dim, n, atan2(s, c) AS mu, sqrt(c * c + s * s) AS r FROM s0 -- mu r""")
def vm_fit_weighted(spark, sf_dir):
    rows = statistics.long_phases(feats(spark, sf_dir).select("cluster", "freq", "phases"))
    return statistics.vm_fit(rows, "cluster", "dim", weight="freq").drop("kappa")


@query(f"WITH {FEATS}, m AS (SELECT cluster, dim, sum(freq * re) / sum(freq) AS mean FROM ph GROUP BY ALL) SELECT cluster, dim, m.mean, sqrt(sum(freq * pow(re - mean, 2)) / sum(freq)) AS std FROM ph JOIN m USING (cluster, dim) GROUP BY ALL -- mean std")
def gmm_fit(spark, sf_dir):
    rows = feats(spark, sf_dir).select("cluster", "freq", F.posexplode("amp").alias("dim", "z")).select("cluster", "freq", "dim", F.col("z.re").alias("value"))
    return statistics.gaussian_fit(rows, "cluster", "dim", weight="freq")


@query("""WITH s AS (SELECT event_type, avg(value) AS m, avg(ln(value)) AS l FROM events GROUP BY 1), t AS (SELECT *, ln(m) - l AS s FROM s), k AS (SELECT event_type, m, (3 - s + sqrt(pow(s - 3, 2) + 24 * s)) / (12 * s) AS shape FROM t)
SELECT event_type, shape, m / shape AS theta FROM k -- shape theta""")
def gamma_fit(spark, sf_dir):
    return statistics.gamma_fit(tables.table(spark, sf_dir, "events"), "event_type")


@query(f"""WITH {FEATS}, c AS (SELECT cluster, dim, atan2(sum(sin(phase)), sum(cos(phase))) AS centroid FROM ph GROUP BY ALL), d AS (SELECT cluster, dim, centroid, abs((phase - centroid) - 2 * pi() * floor((phase - centroid) / (2 * pi()))) AS d FROM ph JOIN c USING (cluster, dim))
SELECT cluster, dim, centroid, sum(pow(least(d, 2 * pi() - d), 2)) AS q FROM d GROUP BY ALL -- centroid q""")
def circular_mean_centroid(spark, sf_dir):
    return statistics.periodic_centroid(long(spark, sf_dir), "cluster", "dim")


@query(f"""WITH {FEATS}, x AS (SELECT cluster, dim, phase - 2 * pi() * floor(phase / (2 * pi())) AS x FROM ph),
c AS (SELECT a.cluster, a.dim, a.x AS cut, sum(CASE WHEN b.x <= a.x THEN b.x + 2 * pi() ELSE b.x END) AS s, sum(pow(CASE WHEN b.x <= a.x THEN b.x + 2 * pi() ELSE b.x END, 2)) AS q, count(*) AS n FROM x a JOIN x b ON a.cluster = b.cluster AND a.dim = b.dim GROUP BY a.cluster, a.dim, a.x)
SELECT cluster, dim, min(q - s * s / n) AS q FROM c GROUP BY ALL -- q""")
def exact_periodic_centroid(spark, sf_dir):
    return statistics.exact_periodic_centroid(long(spark, sf_dir), "cluster", "dim").drop("centroid")


SD = f"sqrt(-2 * ln(({bessel.sql_i1e('kappa')}) / ({bessel.sql_i0e('kappa')})))"
TIGHT = f"{FITS}, sd AS (SELECT *, degrees({SD}) AS sd FROM fits), tight AS (SELECT cluster, max(n) AS n, avg(kappa) AS kappa, avg(sd) AS sigma_eq, exp(avg(ln(sd))) AS sigma_bar FROM sd GROUP BY 1)"


@query(f"WITH {TIGHT} SELECT * FROM tight -- kappa sigma_eq sigma_bar")
def sigma_eq_sigma_bar(spark, sf_dir):
    return statistics.tightness(fits(spark, sf_dir))


@query(f"WITH {TIGHT} SELECT DISTINCT instance_id, cluster FROM ph WHERE cluster IN (SELECT cluster FROM tight WHERE sigma_eq < 97)")
def filter_by_kappa_cutoff(spark, sf_dir):
    return statistics.filter_clusters(feats(spark, sf_dir).select("instance_id", "cluster"), fits(spark, sf_dir), 97.0).select("instance_id", "cluster")


@query(f"WITH {TIGHT} SELECT cluster, n, kappa FROM tight WHERE kappa > 0.45 -- kappa")
def kappa_cutoff_clusters(spark, sf_dir):
    return statistics.passing(fits(spark, sf_dir), 0.45, "kappa").select("cluster", "n", "kappa")


@query(f"WITH {TIGHT} SELECT c::INT AS cutoff, sum(CASE WHEN sigma_eq < c THEN n ELSE 0 END)::BIGINT AS retained FROM tight, range(120) r(c) GROUP BY 1")
def kappa_curve(spark, sf_dir):
    return statistics.retention(fits(spark, sf_dir), "sigma_eq", 120)


@query(f"WITH {FEATS} SELECT cluster, count(DISTINCT instance_id) AS n FROM ph GROUP BY 1 HAVING count(DISTINCT instance_id) > 10")
def min_size(spark, sf_dir):
    return reports.large(feats(spark, sf_dir)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FEATS} SELECT shot, count(DISTINCT cluster) AS clusters, count(DISTINCT instance_id) AS members FROM ph GROUP BY 1")
def unique_count_distinct(spark, sf_dir):
    return feats(spark, sf_dir).groupBy("shot").agg(F.countDistinct("cluster").alias("clusters"), F.countDistinct("instance_id").alias("members"))


@query(f"WITH {FITS} SELECT p.instance_id, p.cluster, p.dim, p.phase, f.mu, f.kappa FROM ph p JOIN fits f USING (cluster, dim) -- phase mu kappa")
def cluster_join(spark, sf_dir):
    return long(spark, sf_dir).join(fits(spark, sf_dir), ["cluster", "dim"]).select("instance_id", "cluster", "dim", "phase", "mu", "kappa")


PAIRS = f"{FEATS}, one AS (SELECT DISTINCT instance_id, cluster FROM ph), two AS (SELECT DISTINCT instance_id, CASE WHEN instance_id % 11 = 0 THEN (cluster + 1) % 10 ELSE cluster // 2 * 2 END AS cluster FROM ph), sim AS (SELECT one.cluster AS first, two.cluster AS second, count(*) AS common FROM one JOIN two USING (instance_id) GROUP BY ALL)"


def two_clusterings(spark, sf_dir):
    one = feats(spark, sf_dir).select("instance_id", "cluster")
    other = F.when(F.col("instance_id") % 11 == 0, (F.col("cluster") + 1) % 10).otherwise(F.floor(F.col("cluster") / 2) * 2)
    return one, one.withColumn("cluster", other.cast("int"))


@query(f"WITH {PAIRS} SELECT * FROM sim")
def similarity_matrix(spark, sf_dir):
    return statistics.similarity(*two_clusterings(spark, sf_dir))


@query(f"WITH {PAIRS}, b AS (SELECT first, max(common) AS m, sum(common) AS n FROM sim GROUP BY 1) SELECT sum(m) / sum(n) AS accuracy FROM b -- accuracy")
def cluster_accuracy(spark, sf_dir):
    return statistics.accuracy(statistics.similarity(*two_clusterings(spark, sf_dir)))


@query(f"""WITH {PAIRS} SELECT 'first' AS side, first AS cluster, arg_max(second, (common, -second)) AS match, max(common) AS common, sum(common)::BIGINT AS members FROM sim GROUP BY first
UNION ALL SELECT 'second', second, arg_max(first, (common, -first)), max(common), sum(common)::BIGINT FROM sim GROUP BY second""")
def rep_compare_two(spark, sf_dir):
    return reports.rep_compare_two(*two_clusterings(spark, sf_dir))


@query()
def rep_compare_clusters(spark, sf_dir):
    """Greedy matching order of two clusterings."""
    found = statistics.greedy_matches(statistics.similarity(*two_clusterings(spark, sf_dir)))
    return spark.createDataFrame([(i, *m) for i, m in enumerate(found)], "place int, first int, second int, common long")


@query(f"WITH {TIGHT}, c AS (SELECT 'all' AS clustering, c::INT AS cutoff, sum(CASE WHEN sigma_bar < c THEN n ELSE 0 END)::BIGINT AS retained FROM tight, range(100) r(c) GROUP BY ALL) SELECT * FROM c UNION ALL SELECT 'same', cutoff, retained FROM c")
def rep_compare_kappas(spark, sf_dir):
    table = fits(spark, sf_dir)
    return reports.rep_compare_kappas({"all": table, "same": table}, "sigma_bar", 100)


@query("SELECT min(m) AS worst, max(m) AS best, avg(m) AS mean, stddev_pop(m) AS std, 0.0::DOUBLE AS sum_error FROM (SELECT greatest(a, 1 - a) AS m FROM (SELECT (vec_id % 101) / 100.0 AS a FROM embeddings)) -- worst best mean std")
def cluster_probabilities(spark, sf_dir):
    a = (F.col("vec_id") % 101) / 100.0
    return statistics.membership_quality(tables.table(spark, sf_dir, "embeddings").select(F.array(a, 1 - a).alias("z")))


HIST = "least(floor((phase + pi()) / (2 * pi() / {bins}))::INT, {last})"


@query(f"WITH {FEATS}, h AS (SELECT dim, {HIST.format(bins=180, last=179)} AS bin, count(*) AS count FROM ph GROUP BY ALL) SELECT *, count / sum(count) OVER (PARTITION BY dim) / (2 * pi() / 180) AS density FROM h -- density")
def hist180(spark, sf_dir):
    return statistics.histogram(long(spark, sf_dir), "dim", bins=180)


@query(f"WITH {FEATS}, h AS (SELECT dim, {HIST.format(bins=359, last=358)} AS bin, count(*) AS count FROM ph GROUP BY ALL) SELECT *, count / sum(count) OVER (PARTITION BY dim) / (2 * pi() / 359) AS density FROM h -- density")
def hist360(spark, sf_dir):
    return statistics.histogram(long(spark, sf_dir), "dim", bins=359)


@query(f"WITH {FEATS} SELECT a.cluster, a.dim AS dim_a, b.dim AS dim_b, covar_pop(a.phase, b.phase) AS covariance FROM ph a JOIN ph b USING (cluster, instance_id) GROUP BY ALL -- covariance")
def covariances(spark, sf_dir):
    return statistics.covariances(long(spark, sf_dir))


@query(f"WITH {FEATS} SELECT a.cluster, a.dim AS dim_a, b.dim AS dim_b, corr(a.phase, b.phase) AS covariance FROM ph a JOIN ph b USING (cluster, instance_id) GROUP BY ALL -- covariance")
def pearson(spark, sf_dir):
    return statistics.covariances(long(spark, sf_dir), pearson=True)


@query(f"WITH {FEATS}, c AS (SELECT a.cluster, a.dim AS i, b.dim AS j, covar_pop(a.phase, b.phase) AS v FROM ph a JOIN ph b USING (cluster, instance_id) GROUP BY ALL) SELECT cluster, avg(abs(v)) AS mean_abs FROM c WHERE i <> j GROUP BY 1 -- mean_abs")
def rep_covariances(spark, sf_dir):
    return statistics.mean_off_diagonal(statistics.covariances(long(spark, sf_dir)))


@query(f"WITH {FEATS}, s AS (SELECT cluster, count(DISTINCT instance_id) AS members FROM ph GROUP BY 1) SELECT *, members / sum(members) OVER () AS share FROM s -- share")
def pi_hat(spark, sf_dir):
    return statistics.shares(feats(spark, sf_dir))


@query(f"WITH {FEATS}, s AS (SELECT DISTINCT instance_id, shot FROM ph) SELECT s.instance_id, s.shot, CASE WHEN s_suppkey IS NULL THEN NULL ELSE (s_suppkey + 0.5) / (s_suppkey * 2.0 + 1) END AS kh, (s_suppkey * 7.0)::DOUBLE AS heating_freq FROM s LEFT JOIN supplier ON s_suppkey = shot -- kh heating_freq")
def meta_broadcast(spark, sf_dir):
    shots = tables.shots(spark, sf_dir).withColumn("kh", F.col("sec_current") / F.col("main_current"))
    return features.with_metadata(feats(spark, sf_dir), shots, "kh", "heating_freq").select("instance_id", "shot", "kh", "heating_freq")


RATIO = "z AS (SELECT a.instance_id, a.cluster, b.dim - 1 AS dim, (b.re * a.re + b.im * a.im) / (a.re * a.re + a.im * a.im) AS re, (b.im * a.re - b.re * a.im) / (a.re * a.re + a.im * a.im) AS im FROM ph a JOIN ph b ON a.instance_id = b.instance_id AND b.dim = a.dim + 1)"


@query(f"WITH {FEATS}, {RATIO} SELECT instance_id, dim, re, im FROM z -- re im", digits=3)
def complex_divide(spark, sf_dir):
    return features.between_channels(feats(spark, sf_dir)).select("instance_id", F.posexplode("ratio").alias("dim", "z")).select("instance_id", "dim", "z.re", "z.im")


@query(f"WITH {FEATS}, {RATIO} SELECT instance_id, dim, CASE WHEN atan2(im, re) < 0 THEN -sqrt(re * re + im * im) ELSE sqrt(re * re + im * im) END AS amplitude FROM z -- amplitude", digits=3)
def signed_amplitude(spark, sf_dir):
    rows = features.between_channels(feats(spark, sf_dir)).select("instance_id", F.posexplode("ratio").alias("dim", "z"))
    return rows.select("instance_id", "dim", angles.signed_amplitude(F.col("z")).alias("amplitude"))


SUMS = "t AS (SELECT instance_id, sum(re) AS sre, sum(im) AS sim FROM ph GROUP BY 1), n AS (SELECT p.instance_id, p.cluster, p.dim, (re * sre + im * sim) / (sre * sre + sim * sim) AS re, (im * sre - re * sim) / (sre * sre + sim * sim) AS im FROM ph p JOIN t USING (instance_id))"


@query(f"WITH {FEATS}, {SUMS} SELECT instance_id, dim, re, im FROM n -- re im", digits=3)
def channel_sum_normalisation(spark, sf_dir):
    return features.between_channels(feats(spark, sf_dir), "sum").select("instance_id", F.posexplode("ratio").alias("dim", "z")).select("instance_id", "dim", "z.re", "z.im")


@query(f"WITH {FEATS} SELECT cluster, dim AS ch_ix, avg((p.re * r.re + p.im * r.im) / (r.re * r.re + r.im * r.im)) AS re, avg((p.im * r.re - p.re * r.im) / (r.re * r.re + r.im * r.im)) AS im, count(*) AS n FROM ph p JOIN (SELECT instance_id, re, im FROM ph WHERE dim = 0) r USING (instance_id) GROUP BY ALL -- re im", digits=3)
def mode_num_analysis(spark, sf_dir):
    return features.mean_mode_vector(feats(spark, sf_dir))


@query(f"WITH {STFT}, {POINTS}, a AS (SELECT id, arg_min(t, (abs(t - time), t)) AS t FROM pts JOIN (SELECT DISTINCT shot, t FROM spec) USING (shot) GROUP BY 1), b AS (SELECT id, arg_min(f, (abs(f - freq), f)) AS f FROM pts JOIN (SELECT DISTINCT shot, f FROM spec) USING (shot) GROUP BY 1), s AS (SELECT id, t, f, ch_ix, re, im FROM a JOIN b USING (id) JOIN spec USING (t, f)) SELECT id, t, f, ch_ix, sqrt(re * re + im * im) AS amplitude, ch_ix * 60.0 AS probe FROM s -- t f amplitude probe")
def rep_pinpoint(spark, sf_dir):
    from tideline.operators import spectral

    probes = spark.range(5).select(F.col("id").cast("int").alias("ch_ix"), (F.col("id") * 60.0).alias("angle"))
    return reports.rep_pinpoint(spectral.stft(event_grid(spark, sf_dir), 16, 8), points(spark), probes).drop("phase")


TOTAL = "greatest(-6 * pi(), least(-2 * pi(), sum((phase + 2 * pi()) - 2 * pi() * floor((phase + 2 * pi()) / (2 * pi())) - 2 * pi())))"


@query(f"WITH {FEATS} SELECT instance_id, cluster, min(time) AS time, min(freq) AS freq, {TOTAL} AS total_phase FROM ph GROUP BY ALL -- time freq total_phase", digits=3)
def rep_time_freq(spark, sf_dir):
    return reports.rep_time_freq(feats(spark, sf_dir))


@query(f"WITH {FEATS} SELECT instance_id, cluster, min(time) * 2 AS kh, min(freq) / 1000 AS freq_khz, {TOTAL} AS total_phase FROM ph GROUP BY ALL -- kh freq_khz total_phase", digits=3)
def rep_kh_freq(spark, sf_dir):
    return reports.rep_kh_freq(feats(spark, sf_dir).withColumn("kh", F.col("time") * 2))


@query(f"WITH {FITS}, x AS (SELECT cluster, dim, i::INT AS i, -pi() + i * (2 * pi() / 299) AS x, mu, kappa FROM fits, range(300) r(i)) SELECT cluster, dim, i, x, exp(kappa * (cos(x - mu) - 1)) / (2 * pi() * ({bessel.sql_i0e('kappa')})) AS density FROM x -- x density")
def von_mises_pdf(spark, sf_dir):
    return statistics.vm_curves(fits(spark, sf_dir))


@query(f"""WITH {FITS}, h AS (SELECT cluster, dim, {HIST.format(bins=359, last=358)} AS bin, count(*) AS count FROM ph GROUP BY ALL), d AS (SELECT *, count / sum(count) OVER (PARTITION BY cluster, dim) / (2 * pi() / 359) AS density, -pi() + (bin + 0.5) * (2 * pi() / 359) AS x FROM h)
SELECT cluster, dim, bin, count, density, exp(kappa * (cos(x - mu) - 1)) / (2 * pi() * ({bessel.sql_i0e('kappa')})) AS fitted FROM d JOIN fits USING (cluster, dim) -- density fitted""")
def rep_vm_distributions(spark, sf_dir):
    return reports.rep_vm_distributions(feats(spark, sf_dir), fits(spark, sf_dir))


@query(f"""WITH {FITS}, h AS (SELECT dim, {HIST.format(bins=60, last=59)} AS bin, count(*) AS count FROM ph GROUP BY ALL), d AS (SELECT *, count / sum(count) OVER (PARTITION BY dim) / (2 * pi() / 60) AS density FROM h),
g AS (SELECT f.dim, b::INT AS bin, -pi() + (b + 0.5) * (2 * pi() / 60) AS x, mu, kappa, n / sum(n) OVER (PARTITION BY f.dim, b) AS w FROM fits f, range(60) r(b)), m AS (SELECT dim, bin, sum(w * exp(kappa * (cos(x - mu) - 1)) / (2 * pi() * ({bessel.sql_i0e('kappa')}))) AS mixture FROM g GROUP BY ALL)
SELECT m.dim, m.bin, coalesce(count, 0) AS count, coalesce(density, 0) AS density, mixture FROM m LEFT JOIN d USING (dim, bin) -- density mixture""")
def rep_dim_hist(spark, sf_dir):
    return reports.rep_dim_hist(feats(spark, sf_dir), fits(spark, sf_dir), 60)


@query(f"""WITH {FEATS}, {SUMS}, p AS (SELECT dim, 're' AS part, re AS v FROM n UNION ALL SELECT dim, 'im', im FROM n), h AS (SELECT dim, part, least(floor((v + pi()) / (2 * pi() / 40))::INT, 39) AS bin, count(*) AS count FROM p WHERE v BETWEEN -pi() AND pi() GROUP BY ALL)
SELECT *, count / sum(count) OVER (PARTITION BY dim, part) / (2 * pi() / 40) AS density FROM h -- density""")
def rep_dim_hist_gmm_gmm(spark, sf_dir):
    return reports.rep_dim_hist_gmm_gmm(feats(spark, sf_dir), 40)


@query(f"""WITH {FEATS}, {RATIO}, a AS (SELECT dim, CASE WHEN atan2(im, re) < 0 THEN -sqrt(re * re + im * im) ELSE sqrt(re * re + im * im) END AS v FROM z), h AS (SELECT dim, least(floor((v + 5) / 0.25)::INT, 39) AS bin, count(*) AS count FROM a WHERE v BETWEEN -5 AND 5 GROUP BY ALL)
SELECT *, count / sum(count) OVER (PARTITION BY dim) / 0.25 AS density FROM h -- density""")
def rep_dim_hist_vmm_gmm(spark, sf_dir):
    return reports.rep_dim_hist_vmm_gmm(feats(spark, sf_dir), 40)


MAGS = "m AS (SELECT instance_id, cluster, dim, sqrt(re * re + im * im) AS m, count(*) OVER w AS c, sum(sqrt(re * re + im * im)) OVER w AS total, sqrt(sum(re * re + im * im) OVER w) AS norm FROM ph WINDOW w AS (PARTITION BY instance_id))"


@query(f"WITH {FEATS}, {MAGS}, h AS (SELECT dim, least(floor(m / total / 0.02)::INT, 49) AS bin, count(*) AS count FROM m GROUP BY ALL) SELECT *, count / sum(count) OVER (PARTITION BY dim) / 0.02 AS density FROM h -- density")
def rep_dim_hist_amps(spark, sf_dir):
    return reports.rep_dim_hist_amps(feats(spark, sf_dir), 50)


def normal_clusters(rows, *keys):
    """Normal parameters of the reference clusters."""
    return rows.groupBy("cluster", *keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count(F.lit(1)).alias("n"))


def mixture_sql(rows: str, keys: str, low: str, width: str, bins: int) -> str:
    """Histogram and mixture of normal clusters of ``rows`` (cluster, keys, v)."""
    mid = f"({low} + (bin + 0.5) * {width})"
    return f"""g AS (SELECT cluster, {keys}, avg(v) AS mean, stddev_pop(v) AS std, count(*) AS n FROM {rows} GROUP BY ALL), w AS (SELECT *, n / sum(n) OVER (PARTITION BY {keys}) AS share FROM g),
c AS (SELECT {keys}, bin::INT AS bin, sum(share * exp(-pow(({mid} - mean) / std, 2) / 2) / (std * sqrt(2 * pi()))) AS mixture FROM w, range({bins}) b(bin) GROUP BY ALL),
h AS (SELECT {keys}, least(floor((v - {low}) / {width})::INT, {bins - 1}) AS bin, count(*) AS count FROM {rows} WHERE v >= {low} AND v <= {low} + {bins} * {width} GROUP BY ALL), d AS (SELECT *, count / sum(count) OVER (PARTITION BY {keys}) / {width} AS density FROM h)
SELECT {keys}, bin, coalesce(count, 0) AS count, coalesce(density, 0) AS density, mixture FROM c LEFT JOIN d USING ({keys}, bin) -- density mixture"""


@query(f"WITH {FEATS}, {SUMS}, p AS (SELECT cluster, dim, 're' AS part, re AS v FROM n UNION ALL SELECT cluster, dim, 'im', im FROM n), {mixture_sql('p', 'dim, part', '-pi()', '(2 * pi() / 180)', 180)}")
def rep_dim_hist_gmm_gmm_mixture(spark, sf_dir):
    rows = feats(spark, sf_dir)
    return reports.rep_dim_hist_gmm_gmm(rows, parameters=normal_clusters(reports.complex_parts(rows), "dim", "part"))


@query(f"WITH {FEATS}, {RATIO}, a AS (SELECT cluster, dim, CASE WHEN atan2(im, re) < 0 THEN -sqrt(re * re + im * im) ELSE sqrt(re * re + im * im) END AS v FROM z), {mixture_sql('a', 'dim', '-5', '(10.0 / 180)', 180)}")
def rep_dim_hist_vmm_gmm_mixture(spark, sf_dir):
    rows = feats(spark, sf_dir)
    return reports.rep_dim_hist_vmm_gmm(rows, parameters=normal_clusters(reports.neighbour_ratios(rows), "dim"))


@query(f"WITH {FEATS}, {RATIO}, h AS (SELECT dim, least(floor((atan2(im, re) + pi()) / (2 * pi() / 180))::INT, 179) AS bin, count(*) AS count FROM z GROUP BY ALL) SELECT *, count / sum(count) OVER (PARTITION BY dim) / (2 * pi() / 180) AS density FROM h -- density")
def rep_ratio_angle_hist(spark, sf_dir):
    return reports.rep_ratio_angle_hist(feats(spark, sf_dir))


@query(f"WITH {FEATS}, {MAGS}, a AS (SELECT cluster, dim, m / total AS v FROM m), {mixture_sql('a', 'dim', '0', '(1.0 / 180)', 180)}")
def rep_dim_hist_amps_mixture(spark, sf_dir):
    rows = feats(spark, sf_dir)
    return reports.rep_dim_hist_amps(rows, parameters=normal_clusters(reports.amplitude_shares(rows), "dim"))


@query(f"WITH {TIGHT} SELECT a.instance_id, a.cluster, a.dim, a.phase AS x, b.phase AS y FROM ph a JOIN ph b ON a.instance_id = b.instance_id AND b.dim = a.dim + 1 WHERE a.instance_id % 2 = 0 AND a.cluster IN (SELECT cluster FROM tight WHERE kappa > 0.4) -- x y")
def rep_phase_vs_phase(spark, sf_dir):
    return reports.rep_phase_vs_phase(feats(spark, sf_dir), fits(spark, sf_dir), 0.4, 2)


@query(f"WITH {FITS}, x AS (SELECT instance_id, p.cluster, p.dim, (phase - mu + pi()) - 2 * pi() * floor((phase - mu + pi()) / (2 * pi())) + mu - pi() AS v FROM ph p JOIN fits USING (cluster, dim)) SELECT instance_id, cluster, dim, sum(v) OVER (PARTITION BY instance_id ORDER BY dim) / (2 * pi()) AS phase FROM x -- phase", digits=3)
def rep_phase_lines(spark, sf_dir):
    return reports.rep_phase_lines(feats(spark, sf_dir), fits(spark, sf_dir), 0.0, cumulative=True)


@query(f"WITH {FEATS}, {MAGS} SELECT cluster, dim, avg(m / (total / c)) AS mean, stddev_pop(m / (total / c)) AS std, count(*) AS n FROM m GROUP BY ALL -- mean std")
def rep_amp_lines(spark, sf_dir):
    return reports.rep_amp_lines(feats(spark, sf_dir))


@query(f"WITH {FEATS}, {SUMS} SELECT cluster, dim, avg(re) AS re, avg(im) AS im FROM n GROUP BY ALL -- re im", digits=3)
def rep_re_im_lines(spark, sf_dir):
    return reports.rep_re_im_lines(feats(spark, sf_dir))


@query(f"""WITH {FEATS}, t AS (SELECT instance_id, cluster, k::INT AS k, sum(re * cos(2 * pi() * k * dim / 8) + im * sin(2 * pi() * k * dim / 8)) AS re, sum(im * cos(2 * pi() * k * dim / 8) - re * sin(2 * pi() * k * dim / 8)) AS im FROM ph, range(8) r(k) GROUP BY ALL),
a AS (SELECT *, sqrt(re * re + im * im) AS a FROM t) SELECT instance_id, cluster, k, a / max(a) OVER (PARTITION BY instance_id) AS amp FROM a -- amp""")
def rep_fft_amp_lines(spark, sf_dir):
    return reports.rep_fft_amp_lines(feats(spark, sf_dir), 8)


@query(f"WITH {FEATS}, {MAGS}, r AS (SELECT *, norm / sqrt(c) AS rms FROM m), l AS (SELECT *, avg(rms) OVER (PARTITION BY cluster) AS mean_rms FROM r) SELECT cluster, dim, avg(m / norm) AS mean, stddev_pop(m / norm) AS std, count(*) AS n FROM l WHERE rms > mean_rms GROUP BY ALL -- mean std")
def rep_interferometer(spark, sf_dir):
    return reports.rep_interferometer(feats(spark, sf_dir))


@query(f"WITH {TIGHT} SELECT DISTINCT instance_id, cluster, time * 3 AS kh, freq * sqrt(time + 1) AS freq FROM ph WHERE cluster IN (SELECT cluster FROM tight WHERE kappa > 0.4) -- kh freq")
def rep_single_kh(spark, sf_dir):
    rows = feats(spark, sf_dir).withColumn("kh", F.col("time") * 3).withColumn("ne", F.col("time") + 1)
    return reports.rep_single_kh(rows, fits(spark, sf_dir), 0.4, "ne")


@query(f"WITH {FITS} SELECT cluster, dim + 1 AS place, sum(mu) OVER (PARTITION BY cluster ORDER BY dim) / (2 * pi()) AS turns FROM fits UNION ALL SELECT DISTINCT cluster, 0, 0.0 FROM fits -- turns")
def rep_cumulative_phases(spark, sf_dir):
    return reports.rep_cumulative_phases(fits(spark, sf_dir))


GAUSS = f"{FEATS}, gs AS (SELECT cluster, dim, avg(re) AS mean, stddev_pop(re) AS std FROM ph GROUP BY ALL)"


def gauss(spark, sf_dir):
    rows = feats(spark, sf_dir).select("cluster", F.posexplode("amp").alias("dim", "z")).select("cluster", "dim", F.col("z.re").alias("value"))
    return statistics.gaussian_fit(rows, "cluster", "dim")


@query(f"WITH {GAUSS} SELECT cluster, dim, mean, mean - std AS low, mean + std AS high FROM gs -- mean low high")
def rep_emm_gmm_amps(spark, sf_dir):
    return reports.rep_gmm_amps(gauss(spark, sf_dir))


@query(f"WITH {GAUSS}, x AS (SELECT cluster, dim, i::INT AS i, -1 + i * (2.0 / 99) AS x, mean, std FROM gs, range(100) r(i)) SELECT cluster, dim, i, x, exp(-pow((x - mean) / std, 2) / 2) / (std * sqrt(2 * pi())) AS density FROM x -- x density", digits=3)
def rep_gmm_gmm_distributions(spark, sf_dir):
    return reports.rep_gmm_gmm_distributions(gauss(spark, sf_dir), 100, -1.0, 1.0)


@query(f"WITH {TIGHT}, k AS (SELECT DISTINCT instance_id, shot, cluster, time, freq FROM ph WHERE shot = 3 AND cluster IN (SELECT cluster FROM tight WHERE kappa > 0.3)) SELECT cluster, time, freq FROM k WHERE cluster IN (SELECT cluster FROM k GROUP BY 1 HAVING count(*) > 1) -- time freq")
def rep_specgram_overlay(spark, sf_dir):
    return reports.rep_specgram_overlay(feats(spark, sf_dir), fits(spark, sf_dir), 3, 0.3)


@query(f"WITH {FEATS} SELECT DISTINCT cluster, shot, time, freq FROM ph WHERE cluster IN (1, 4) -- time freq")
def rep_cluster_overlay(spark, sf_dir):
    return reports.rep_cluster_overlay(feats(spark, sf_dir), (1, 4))


@query(f"WITH {FEATS}, e AS (SELECT instance_id, dim, phase FROM ph UNION ALL SELECT instance_id, 8, phase + 2 * pi() FROM ph WHERE dim = 0) SELECT * FROM e -- phase")
def rep_join_ends(spark, sf_dir):
    out = reports.rep_join_ends(feats(spark, sf_dir).select("instance_id", "phases"), "phases", 2 * math.pi)
    return statistics.long_phases(out)


@query(f"WITH {FEATS} SELECT instance_id, 2 * dim AS place, cos(phase) AS v FROM ph UNION ALL SELECT instance_id, 2 * dim + 1, sin(phase) FROM ph -- v")
def sin_cos_embedding(spark, sf_dir):
    return feats(spark, sf_dir).select("instance_id", F.posexplode(angles.embedded(F.col("phases"))).alias("place", "v"))


@query(f"WITH {FEATS} SELECT instance_id, dim, CASE WHEN abs(phase) < 0.05 THEN 0 ELSE phase END AS phase FROM ph -- phase")
def zero_small_phases(spark, sf_dir):
    return statistics.long_phases(feats(spark, sf_dir).select("instance_id", angles.zero_small(F.col("phases"), 0.05).alias("phases")))


@query(f"WITH {FEATS} SELECT instance_id, dim, sum(phase) OVER (PARTITION BY instance_id ORDER BY dim) AS phase FROM ph -- phase")
def cumulative_phase_arrays(spark, sf_dir):
    return statistics.long_phases(feats(spark, sf_dir).select("instance_id", angles.cumulative(F.col("phases")).alias("phases")))


EM = f"""{FITS}, w0 AS (SELECT cluster, count(DISTINCT instance_id) / (SELECT count(DISTINCT instance_id) FROM ph)::DOUBLE AS w FROM ph GROUP BY 1), k1 AS (SELECT cluster, dim, mu, greatest(0.1, least(300.0, kappa)) AS kappa FROM fits),
j AS (SELECT p.instance_id, k.cluster, sum(kappa * cos(phase - mu) - ln(2 * pi()) - (ln({bessel.sql_i0e('kappa')}) + kappa)) + min(ln(w)) AS lp FROM ph p JOIN k1 k USING (dim) JOIN w0 ON w0.cluster = k.cluster GROUP BY ALL),
z AS (SELECT instance_id, cluster, exp(lp - max(lp) OVER (PARTITION BY instance_id)) / sum(exp(lp - mx)) OVER (PARTITION BY instance_id) AS z FROM (SELECT *, max(lp) OVER (PARTITION BY instance_id) AS mx FROM j))"""


def reference_mixture(spark, sf_dir) -> tuple[clustering.Mixture, list[int]]:
    """The von Mises mixture fitted to the reference clusters, and their names; clusters times dimensions are collected."""
    params: dict = {}
    for r in statistics.vm_fit(long(spark, sf_dir), "cluster", "dim", clip=True).orderBy("cluster", "dim").collect():
        params.setdefault(r["cluster"], []).append((r["mu"], r["kappa"], r["n"]))
    table = np.array(list(params.values()))
    return clustering.Mixture(table[:, 0, 2] / table[:, 0, 2].sum(), table[:, :, 0], table[:, :, 1], table.shape[1]), list(params)


def memberships(spark, sf_dir):
    """instance_id and z by the mixture's own expectation step, and the names of the clusters."""
    model, names = reference_mixture(spark, sf_dir)
    return clustering.assign_rows(feats(spark, sf_dir), "phases", model.memberships).select("instance_id", "z"), names


@query(f"WITH {EM} SELECT instance_id, cluster, z FROM z -- z", digits=3)
def em_vmm_e_step(spark, sf_dir):
    z, names = memberships(spark, sf_dir)
    return z.select("instance_id", F.posexplode("z").alias("i", "z")).select("instance_id", F.get(F.array(*map(F.lit, names)), F.col("i")).alias("cluster"), "z")


@query(f"WITH {EM} SELECT k.cluster, p.dim, atan2(sum(z * sin(phase)), sum(z * cos(phase))) AS mu, sqrt(pow(sum(z * cos(phase)), 2) + pow(sum(z * sin(phase)), 2)) / sum(z) AS r FROM z k JOIN ph p USING (instance_id) GROUP BY ALL -- mu r", digits=3)
def em_vmm_m_step(spark, sf_dir):
    """One pass of sums and the maximisation of the mixture that users run."""
    model, names = reference_mixture(spark, sf_dir)
    k, d = model.loc.shape
    got = clustering.sums_by_start(feats(spark, sf_dir), "phases", lambda x: clustering.expectation_sums(x, model, False)[None], 1, k + 2 * k * d + 2)[0]
    new = clustering.maximise(got[:-2], model, 1)
    c, s = (got[k + i * k * d : k + (i + 1) * k * d].reshape(k, d) for i in (0, 1))
    r = np.hypot(c, s) / got[:k, None]
    return spark.createDataFrame([(n, j, float(new.loc[i, j]), float(r[i, j])) for i, n in enumerate(names) for j in range(d)], "cluster int, dim int, mu double, r double")


@query(f"WITH {EM} SELECT instance_id, arg_max(cluster, (round(z, 9), -cluster)) AS cluster FROM z GROUP BY 1")
def argmax_cluster(spark, sf_dir):
    z, names = memberships(spark, sf_dir)
    best = F.array_position(F.transform("z", lambda x: F.round(x, 9)), F.array_max(F.transform("z", lambda x: F.round(x, 9)))) - 1
    return z.select("instance_id", F.get(F.array(*map(F.lit, names)), best.cast("int")).alias("cluster"))


def sizes(found):
    return found.assignments.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.min("probability").alias("least_sure"))


def registered(name: str, column: str, **settings):
    def f(spark, sf_dir):
        rows = feats(spark, sf_dir).withColumn("values", reports.magnitudes(F.col("amp")))
        return sizes(clustering.cluster(rows, name, **settings))

    f.__name__ = column
    query()(f)


registered("k_means", "cluster_k_means")
registered("k_means_periodic", "cluster_k_means_periodic")
registered("EM_VMM", "cluster_em_vmm")
registered("EM_GMM", "cluster_em_gmm")
registered("EM_GMM", "cluster_em_gmm_full", covariance_type="full")
registered("EM_GMM2", "cluster_em_gmm2")
registered("EM_VMM_GMM", "cluster_em_vmm_gmm")
registered("EM_GMM_GMM", "cluster_em_gmm_gmm")
registered("EM_GMM_GMM2", "cluster_em_gmm_gmm2")
