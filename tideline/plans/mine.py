"""The whole batch flow: samples of many shots to peaks, clusters within shots, tight clusters, clusters over all shots."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import parse_settings
from tideline.operators import cluster as clustering
from tideline.operators import features as extraction
from tideline.operators import signals, statistics
from tideline.sources import files


# The default settings.
@dataclass
class Settings:
    shots: str = "159243"
    times: str = "300-1400"
    probe_array: str = "DIIID_toroidal_mag"
    n_cpus: int = 1
    n_clusters: int = 16
    n_iterations: int = 20
    start: str = "k_means"
    method: str = "EM_VMM"
    freq_range: str = "50-250"
    seed: int = 743
    n_peaks: int = 20
    cutoff_by: str = "sigma_eq"
    cutoff_value: float = 80.0
    filter_items: str = "EM_VMM_kappas"
    partition: str = "short"
    run_time: float = 15.0
    mem: str = "115G"
    nfft: int = 1024
    step: int = 256

    @classmethod
    def from_text(cls, text: str) -> Settings:
        """Settings from ``key: value`` lines; a key may be shortened if it stays unambiguous. What is missing has its default."""
        kinds = {f.name: f.type for f in fields(cls)}
        found = {}
        for line in text.splitlines():
            key, colon, value = line.partition(":")
            names = [n for n in kinds if n == key.strip()] or [n for n in kinds if colon and key.strip() and n.startswith(key.strip())]
            if len(names) == 1:
                found[names[0]] = {"int": int, "float": float, "str": str}[str(kinds[names[0]])](value.strip())
        return cls(**found)

    def text(self) -> str:
        return "\n".join(f"{k}: {v}" for k, v in asdict(self).items())

    def band(self) -> tuple[float, float]:
        low, high = self.freq_range.split("-")
        return float(low), float(high)


def settings_table(rows: DataFrame, text: str) -> DataFrame:
    """Every setting (name, value as text) of each row's settings text, by unambiguously shortened keys, completed by the defaults."""
    rest = [c for c in rows.columns if c != text]
    names = [f.name for f in fields(Settings)]
    meant = {n[:i]: [m for m in names if m.startswith(n[:i])] for n in names for i in range(1, len(n) + 1)} | {n: [n] for n in names}
    #: The setting that each unambiguous key stands for.
    known = F.create_map(*[F.lit(x) for key, found in meant.items() if len(found) == 1 for x in (key, found[0])])

    pairs = F.transform(F.map_entries(parse_settings(F.col(text))), lambda e: F.struct(F.try_element_at(known, e["key"]).alias("name"), e["value"].alias("value")))
    given = F.map_from_entries(F.filter(pairs, lambda p: p["name"].isNotNull()))
    # A text's own settings are looked up row by row; a join with the table of defaults would parse each text once for every partition of it.
    completed = lambda g: F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(F.try_element_at(g, F.lit(k)), F.lit(str(v))).alias("value")) for k, v in asdict(Settings()).items()])
    return rows.select(*rest, F.explode(F.get(F.transform(F.array(given), completed), 0)).alias("__z")).select(*rest, "__z.name", "__z.value")


def shot_clusters(features: DataFrame, settings: Settings, iterations: int | None = None) -> DataFrame:
    """instance_id, shot and cluster of every feature, each shot clustered by itself in its own task; written.

    A shot that fails stops no other. It gives one row with its error and nothing else.
    """
    import numpy as np
    import pandas as pd

    k, seed, most = settings.n_clusters, settings.seed, iterations or settings.n_iterations

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return found_in(pdf).assign(error=None)
        except (ValueError, TypeError, FloatingPointError, np.linalg.LinAlgError) as bad:
            return pd.DataFrame({"instance_id": [None], "shot": [pdf["shot"].iloc[0]], "cluster": [None], "error": [f"{type(bad).__name__}: {bad}"]})

    def found_in(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["phases"].tolist(), float)
        if not np.isfinite(x).all():
            raise ValueError("phases are missing or not finite")
        n = min(k, len(x))
        embedded = np.concatenate((np.cos(x), np.sin(x)), axis=1)
        centres = clustering.plus_plus(embedded, n, np.random.default_rng(seed))
        near = ((embedded[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        zero = clustering.Mixture(np.full(n, 1 / n), np.zeros((n, x.shape[1])), np.ones((n, x.shape[1])), x.shape[1])
        z = np.eye(n)[near]
        model = clustering.maximise(np.concatenate((z.sum(0), (z.T @ np.cos(x)).ravel(), (z.T @ np.sin(x)).ravel())), zero, len(x))
        for _ in range(most):
            model = clustering.maximise(clustering.expectation_sums(x, model, False)[:-2], model, len(x))
        return pdf[["instance_id", "shot"]].assign(cluster=model.memberships(x).argmax(1).astype("int32"))

    return files.written(features.select("instance_id", "shot", "phases").groupBy("shot").applyInPandas(run, "instance_id long, shot long, cluster int, error string"))


def failures(clusters: DataFrame) -> DataFrame:
    """The shots that failed, with their errors."""
    return clusters.where("error IS NOT NULL").select("shot", "error")


def per_shot(features: DataFrame, settings: Settings, iterations: int | None = None) -> DataFrame:
    """Rows of the clusters that are tight within their own shot."""
    return tight_rows(features, shot_clusters(features, settings, iterations), settings)


def tight_rows(features: DataFrame, clusters: DataFrame, settings: Settings) -> DataFrame:
    found = clusters.where("error IS NULL").drop("error")
    rows = features.join(found, ["instance_id", "shot"])
    fits = statistics.vm_fit(statistics.long_phases(rows.select("shot", "cluster", "phases")), "shot", "cluster", "dim", clip=True)
    keyed = fits.withColumn("cluster", F.struct("shot", "cluster"))
    tight = statistics.passing(keyed, settings.cutoff_value, settings.cutoff_by).select("cluster.shot", "cluster.cluster")
    return rows.join(tight, ["shot", "cluster"], "left_semi").drop("cluster")


def mine(samples: DataFrame, settings: Settings | None = None, window: tuple[float, float] | None = None, two_level: bool = True) -> tuple[DataFrame, clustering.Clustering]:
    """Features of the peaks of all shots, and their clustering, whose details have ``failures``: the shots that failed, with their errors."""
    settings = settings or Settings()
    if window:
        samples = signals.reduce_time(samples, *window)
    low, high = settings.band()
    features = extraction.by_peaks(samples, settings.nfft, settings.step, settings.n_peaks, low, high)
    features = files.written(features)
    failed = None
    if two_level:
        clusters = shot_clusters(features, settings)
        failed = failures(clusters)
        features = files.written(tight_rows(features, clusters, settings))
    extra = {"n_iterations": settings.n_iterations, "start": settings.start} if settings.method == "EM_VMM" else {}
    found = clustering.cluster(features, settings.method, n_clusters=settings.n_clusters, seed=settings.seed, **extra)
    found.details["failures"] = failed
    return features, found


def save(path: str, features: DataFrame, found: clustering.Clustering, settings: Settings | None = None) -> None:
    """The result of an analysis; its own settings are kept beside those of the clustering."""
    kept = {**found.settings, "analysis": asdict(settings)} if settings else found.settings
    files.save_features(path, features, found.assignments, found.table(features.sparkSession), kept)


def settings_from_result(spark, path: str) -> Settings:
    """The settings that a saved analysis was made with."""
    saved = files.load_features(spark, path)[3]
    if "analysis" not in saved:
        raise LookupError(f"{path} was saved without settings of an analysis")
    return Settings(**saved["analysis"])


def restore(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    return files.load_features(spark, path)
