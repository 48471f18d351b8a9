"""Queries on the remaining reports and on what is written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import reports, signals
from tideline.plans.base import DAILY, FEATS, query
from tideline.plans.structure_queries import decomposed
from tideline.sources import files
from tideline.sources.tables import daily, features


@query(f"WITH {DAILY} SELECT shot, ch_ix, sample_ix, t, value FROM daily WHERE sample_ix % 10 = 0 -- t value")
def rep_signals(spark, sf_dir):
    return reports.rep_signals(daily(spark, sf_dir), 10)


@query(f"""WITH {DAILY}, g AS (SELECT *, sample_ix // 120 AS seg_ix FROM daily), n AS (SELECT shot, max(sample_ix) + 1 AS n FROM daily GROUP BY 1)
SELECT shot, seg_ix, sum(value * value) / 1e9 AS energy FROM g JOIN n USING (shot) WHERE (seg_ix + 1) * 120 < n GROUP BY ALL -- energy""")
def svd_rebuilt_energy(spark, sf_dir):
    """The energy of a segment from its vectors: the squared singular values, spread over the channels by the weights."""
    found = decomposed(spark, sf_dir)
    weights = reports.rep_svd_topos(found).groupBy("shot", "seg_ix", "number").agg(F.sum(F.col("topo") * F.col("topo")).alias("size"))
    values = reports.rep_svd(found).select("shot", "seg_ix", "number", "svs")
    return values.join(weights, ["shot", "seg_ix", "number"]).groupBy("shot", "seg_ix").agg((F.sum(F.col("svs") * F.col("svs") * F.col("size")) / 1e9).alias("energy"))


@query(f"""WITH {FEATS}, g AS (SELECT * FROM (VALUES (0, 0, 1.0, 0.0), (0, 1, 2.0, 0.0), (0, 2, 0.0, 1.0), (1, 0, 1.0, 1.0), (1, 1, 1.0, 0.0), (1, 2, 1.0, 0.0)) v(coil, dim, gr, gi)),
f AS (SELECT * FROM (VALUES (0, 0, 0.6), (0, 1, 0.8), (0, 2, 0.0), (1, 0, 0.8), (1, 1, 0.6), (1, 2, 0.0)) v(coil, dim, w)),
z AS (SELECT instance_id, g.coil, ph.dim, (re * gr + im * gi) / (gr * gr + gi * gi) AS re, (im * gr - re * gi) / (gr * gr + gi * gi) AS im FROM ph JOIN g ON g.coil = instance_id % 2 AND g.dim = ph.dim),
n AS (SELECT *, sqrt(sum(re * re + im * im) OVER (PARTITION BY instance_id)) AS size FROM z), p AS (SELECT instance_id, n.coil, sum(re / size * w) AS re, sum(im / size * w) AS im FROM n JOIN f USING (coil, dim) GROUP BY ALL)
SELECT instance_id, coil, re, im, sqrt(re * re + im * im) AS radius FROM p -- re im radius""")
def rep_polarisation(spark, sf_dir):
    rows = features(spark, sf_dir).select("instance_id", (F.col("instance_id") % 2).cast("int").alias("coil"), F.slice("amp", 1, 3).alias("axes"))
    gains = spark.createDataFrame([(0, [(1.0, 0.0), (2.0, 0.0), (0.0, 1.0)]), (1, [(1.0, 1.0), (1.0, 0.0), (1.0, 0.0)])], "coil int, gain array<struct<re:double,im:double>>")
    turns = [(0, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]), (1, [[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])]
    frames = spark.createDataFrame([(c, r, [0.6, 0.8, 0.0]) for c, r in turns], "coil int, rotation array<array<double>>, field array<double>")
    return reports.rep_polarisation(rows, gains, frames).drop("angle")


@query(f"WITH {FEATS} SELECT DISTINCT instance_id, shot, cluster, time, freq FROM ph -- time freq")
def sink_feature_roundtrip(spark, sf_dir):
    rows = features(spark, sf_dir)
    path = files.shared_folder(spark)
    files.save_features(path, rows.drop("cluster"), rows.select("instance_id", "cluster"), rows.select("cluster").distinct(), {"method": "reference"})
    saved, assigned, _, _ = files.load_features(spark, path)
    return saved.join(assigned, "instance_id").select("instance_id", "shot", "cluster", "time", "freq")


@query("""SELECT 'all' AS saved, 'n_rows' AS name, count(*)::VARCHAR AS value FROM embeddings
UNION ALL SELECT 'low', 'n_rows', count(*)::VARCHAR FROM embeddings WHERE vec_id % 5 < 2""")
def list_clusterings(spark, sf_dir):
    """The settings of two saved clusterings, one of all shots and one of the first two."""
    path, rows = files.shared_folder(spark), features(spark, sf_dir)
    for name, part in (("all", rows), ("low", rows.where("shot < 2"))):
        files.save_features(f"{path}/{name}", part.drop("cluster"), part.select("instance_id", "cluster"), part.select("cluster").distinct(), {"n_rows": part.count()})
    return files.list_clusterings(spark, path)


@query(f"""WITH {DAILY} SELECT shot, ch_ix, row_number() OVER (PARTITION BY shot, ch_ix ORDER BY t) - 1 AS sample_ix, t, value,
'channel_' || lpad(ch_ix::VARCHAR, 3, '0') AS channel FROM daily -- t value""")
def src_dsv(spark, sf_dir):
    """The daily channels written as delimited text, a file for each shot, and read back."""
    path = files.shared_folder(spark)
    lines = daily(spark, sf_dir).groupBy("shot", "t").pivot("ch_ix", [0, 1, 2]).agg(F.first("value")).select("shot", F.concat_ws(" ", "t", "0", "1", "2").alias("value"))
    lines.repartition("shot").write.partitionBy("shot").text(path)
    first, last = lines.agg(F.min("shot"), F.max("shot")).first()
    found = [files.dsv(spark, f"{path}/shot=(shot)", shot) for shot in range(first, last + 1)]
    return signals.stack_shots(*found).drop("diag")


@query("SELECT event_type AS name, count(*) * 2 AS n FROM events GROUP BY 1")
def sink_orm(spark, sf_dir):
    """Objects appended twice are there twice."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("name"))
    path = files.shared_folder(spark)
    files.append_objects(rows, path)
    files.append_objects(rows, path)
    return spark.read.parquet(path).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
