"""K-Means on the spectrum of a point: how far its nearest points are apart, and how often each is visited."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions import geo
from waymark.materialize import cut_lineage
from waymark.operators.lookups import target_point
from waymark.operators.ranking import consecutive_distance, nearest_lists, sample_point_per_group

# Executors need not have this package: the functions below travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PLACE = ["customer_id", "lat", "lon"]
K = fixed.SPECTRUM_POINTS
STEP_NAMES = [f"step_{i}" for i in range(1, K)]
SHARE_NAMES = [f"share_{i}" for i in range(1, K + 1)]

#: K-Means starts from each of these, and the best run counts.
SEEDS = (0, 1, 2)


def target_visits(tx: DataFrame, target: str) -> DataFrame:
    """Visits per customer and place, with `d2` to the customer's known target; customers without one are left out."""
    lat, lon = target_point(target)
    visits = tx.filter(lat.isNotNull() & lon.isNotNull()).groupBy(*PLACE).agg(
        F.count(F.lit(1)).alias("visits"), F.min(F.struct(lat.alias("lat"), lon.alias("lon"))).alias("_target")
    )
    apart = geo.squared_distance(F.col("lat"), F.col("lon"), F.col("_target.lat"), F.col("_target.lon"))
    return visits.withColumn("d2", apart).drop("_target")


def qualified(visits: DataFrame, *conditions) -> DataFrame:
    """Rows of the customers for whom every aggregate condition holds."""
    wanted = conditions[0]
    for c in conditions[1:]:
        wanted = wanted & c
    kept = visits.groupBy("customer_id").agg(wanted.alias("_kept")).filter("_kept").select("customer_id")
    return visits.join(kept, "customer_id", "left_semi")


def inside(radius: float):
    return F.col("d2") <= radius * radius


def point_spectrum(anchors: DataFrame, visits: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Nine columns per anchor: four squared steps along its five nearest points, and their visit shares, and `also` of the anchor.

    For customers with at least five places; places further down stay NULL. Customers of few places are answered in place,
    from the list of their points; only those of many go by ranked rows.
    """
    total = F.sum("visits").alias("_total")
    lists, ranked = nearest_lists(anchors, visits, K, ["customer_id"], ["visits"], also, [total])
    near = [F.get("_found", F.lit(i)) for i in range(K)]

    def step(p, q):
        return geo.squared_distance(q["near_lat"], q["near_lon"], p["near_lat"], p["near_lon"])

    out = lists.select(
        *PLACE, *also, *[step(p, q).alias(name) for p, q, name in zip(near, near[1:], STEP_NAMES)],
        *[(p["visits"] / F.col("_total")).alias(name) for p, name in zip(near, SHARE_NAMES)])
    if ranked is None:
        return out
    totals = visits.groupBy("customer_id").agg(total)
    steps = consecutive_distance(ranked)

    def at(rank, column):
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    wide = steps.groupBy(*PLACE).agg(
        *[at(i + 1, "step_d2").alias(f"step_{i}") for i in range(1, K)],
        *[at(i, "visits").alias(f"_visits_{i}") for i in range(1, K + 1)],
    )
    if also:
        wide = wide.join(anchors.select(*PLACE, *also), PLACE)
    return out.unionByName(wide.join(totals, "customer_id").select(
        *PLACE, *also, *STEP_NAMES, *[(F.col(f"_visits_{i}") / F.col("_total")).alias(f"share_{i}") for i in range(1, K + 1)]
    ))


def with_vector(spectra: DataFrame) -> DataFrame:
    return spectra.withColumn("features", array_to_vector(F.array(*STEP_NAMES, *SHARE_NAMES)))


def spectrum_training_set(tx: DataFrame, target: str = "home", radius: float = fixed.RADIUS) -> DataFrame:
    """Spectra of the points near the target, from the visits within one degree of it."""
    visits = target_visits(tx, target).filter(F.col("d2") < fixed.SPECTRUM_REACH_SQUARED)
    visits = cut_lineage(qualified(visits, F.count(F.lit(1)) >= K, F.count_if(inside(radius)) > 0))
    return point_spectrum(visits.filter(inside(radius)), visits)


def spectrum_background_set(tx: DataFrame, target: str = "home", radius: float = fixed.RADIUS, seed: int = 0) -> DataFrame:
    """Spectrum of one random point outside the radius, of customers with at least five such points."""
    visits = cut_lineage(qualified(target_visits(tx, target), F.count_if(~inside(radius)) >= K))
    return point_spectrum(sample_point_per_group(visits.filter(~inside(radius)), seed), visits)


def distance_to_centroid(vectors: DataFrame, model: KMeansModel | DataFrame, features: str = "features") -> DataFrame:
    """Add `prediction` and `centroid_distance`, to the nearest centre of a model or of a table (prediction, center).

    A table of centres has as many rows as clusters, like a model; of equally near ones the smallest number counts, and
    a vector that is null gets null.
    """
    if isinstance(model, DataFrame):
        return _distance_to_nearest(vectors, model, features)
    spark = vectors.sparkSession
    centers = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, _center array<double>"
    )
    placed = model.transform(vectors).withColumn("_values", vector_to_array(features))
    return (
        placed.join(F.broadcast(centers), "prediction")
        .withColumn("centroid_distance", _apart(F.col("_values"), F.col("_center")))
        .drop("_values", "_center")
    )


def _apart(values, center):
    squares = F.zip_with(values, center, lambda x, c: (x - c) * (x - c))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x))


def _distance_to_nearest(vectors: DataFrame, centers: DataFrame, features: str) -> DataFrame:
    rows = sorted((int(r["prediction"]), [float(x) for x in r["center"]]) for r in centers.select("prediction", "center").collect())
    if not rows:
        raise ValueError("no centres")
    listed = F.array(*[F.struct(F.lit(i).alias("prediction"), F.array(*[F.lit(x) for x in c]).alias("center")) for i, c in rows])
    # A list of one vector, so that it is unpacked once and not for each centre.
    nearest = F.transform(F.array(vector_to_array(features)), lambda values: F.array_min(F.transform(listed, lambda c: F.struct(
        _apart(values, c["center"]).alias("distance"), c["prediction"].alias("prediction")))))[0]
    nearest = F.when(F.col(features).isNotNull(), nearest)
    placed = vectors.withColumn("_nearest", nearest)
    return placed.withColumns({"prediction": F.col("_nearest.prediction"), "centroid_distance": F.col("_nearest.distance")}).drop("_nearest")


def fit_kmeans(vectors: DataFrame, k: int, seeds: Sequence[int] = SEEDS, features: str = "features",
               max_iter: int = 20) -> KMeansModel:
    """Best of one run per seed, by training cost."""
    models = [
        KMeans(k=k, tol=fixed.KMEANS_TOLERANCE, seed=s, maxIter=max_iter, featuresCol=features).fit(vectors) for s in seeds
    ]
    return min(models, key=lambda m: m.summary.trainingCost)


@dataclass
class KMeansRun:
    """One (k, seed): its centres, the sum of squared distances to them, and the mean distance."""

    centers: np.ndarray
    cost: float
    mean_distance: float


#: Numbers in one matrix of distances, which should stay in a processor's cache.
MATRIX_SIZE = 1 << 16


def nearest_centers(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the first of its nearest centres and the squared distance to it, both as summed component by component.

    One product of matrices gives all distances up to rounding. Where it leaves more than one centre, or no number, all are summed.
    """
    width = x.shape[1]
    far = (centers * centers).sum(axis=1)
    rough = x @ (-2 * centers.T) + far
    own = rough.argmin(axis=1)
    slack = 32 * (width + 4) * np.finfo(float).eps * ((x * x).sum(axis=1) + far.max())
    unsure = np.flatnonzero(np.count_nonzero(rough <= (rough[np.arange(len(x)), own] + slack)[:, None], axis=1) != 1)
    if len(unsure):
        d2 = np.zeros((len(unsure), len(centers)))
        for i in range(width):
            d2 += (x[unsure, i, None] - centers[None, :, i]) ** 2
        own[unsure] = d2.argmin(axis=1)
    least = np.zeros(len(x))
    for i in range(width):
        least += (x[:, i] - centers[own, i]) ** 2
    return own, least


SUMS = "k int, seed int, cluster int, n long, sums array<double>, distance double, cost double"


def assignment_sums(vectors: DataFrame, runs: Mapping[tuple[int, int], np.ndarray], features: str = "features") -> DataFrame:
    """One scan for all runs: for each (k, seed, cluster) its rows, their sum by component, and the sums of their distances
    and squared distances to its centre. Clusters without rows have none; vectors that are null take no part.

    `runs` holds the centres of each (k, seed). A task gives one row for each cluster, however many vectors it reads.
    """
    runs = {run: np.asarray(c, dtype=float) for run, c in runs.items()}
    every = np.concatenate(list(runs.values()))
    width = every.shape[1]
    bounds = np.cumsum([0, *[len(c) for c in runs.values()]])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = np.zeros(len(every), dtype=np.int64), np.zeros((len(every), width))
        distance, cost = np.zeros(len(every)), np.zeros(len(every))
        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack(batch["x"].to_numpy())
            for low, high in zip(bounds, bounds[1:]):
                size = high - low
                step = max(1, MATRIX_SIZE // size)
                for at in range(0, len(rows), step):
                    x = rows[at:at + step]
                    own, least = nearest_centers(x, every[low:high])
                    n[low:high] += np.bincount(own, minlength=size)
                    cost[low:high] += np.bincount(own, least, minlength=size)
                    distance[low:high] += np.bincount(own, np.sqrt(least), minlength=size)
                    for i in range(width):
                        sums[low:high, i] += np.bincount(own, x[:, i], minlength=size)
        used = np.flatnonzero(n)
        if not len(used):
            return
        run = np.searchsorted(bounds, used, side="right") - 1
        named = np.array(list(runs), dtype=np.int32).reshape(-1, 2)[run]
        yield pd.DataFrame({"k": named[:, 0], "seed": named[:, 1], "cluster": (used - bounds[run]).astype(np.int32), "n": n[used],
                            "sums": list(sums[used]), "distance": distance[used], "cost": cost[used]})

    arrays = vectors.filter(F.col(features).isNotNull()).select(vector_to_array(features).alias("x"))
    return arrays.mapInPandas(partial, SUMS).groupBy("k", "seed", "cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"),
        F.sum("distance").alias("distance"), F.sum("cost").alias("cost"),
    )


def _spread(centers: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """At most k of the weighted centres, drawn by weight times squared distance to those drawn before."""
    draw, least, taken = weights.astype(float), np.full(len(centers), np.inf), []
    while len(taken) < min(k, len(centers)) and draw.sum() > 0:
        taken.append(rng.choice(len(centers), p=draw / draw.sum()))
        least = np.minimum(least, ((centers - centers[taken[-1]]) ** 2).sum(axis=1))
        draw = weights * least
    return centers[taken]


def starting_centers(vectors: DataFrame, ks: Sequence[int], seeds: Sequence[int] = SEEDS,
                     features: str = "features") -> dict[tuple[int, int], np.ndarray]:
    """Centres to start each (k, seed) from: one short fit of the largest k for each seed, whose centres the smaller ones draw from."""
    starts = {}
    for seed in seeds:
        model = KMeans(k=max(ks), seed=seed, maxIter=1, tol=fixed.KMEANS_TOLERANCE, featuresCol=features).fit(vectors)
        centers = np.array(model.clusterCenters())
        weights = np.array(model.summary.clusterSizes[:len(centers)], dtype=float)
        for k in ks:
            starts[k, seed] = centers if k >= len(centers) else _spread(centers, weights, k, np.random.default_rng([seed, k]))
    return starts


def fit_kmeans_sizes(vectors: DataFrame, ks: Sequence[int], seeds: Sequence[int] = SEEDS, features: str = "features",
                     max_iter: int = 20, tol: float = fixed.KMEANS_TOLERANCE) -> dict[tuple[int, int], KMeansRun]:
    """All sizes and seeds together: a round reads the vectors once, whatever the number of runs.

    A run leaves the rounds when none of its centres moves farther than `tol`. A cluster that loses all rows keeps its
    centre. What reaches the driver is one row for each cluster: the sum of all k, times the seeds.
    """
    stored = cut_lineage(vectors.filter(F.col(features).isNotNull()).select(features))
    if stored.isEmpty():
        return {}
    centers = starting_centers(stored, ks, seeds, features)
    moving = set(centers)
    for _ in range(max_iter):
        if not moving:
            break
        moved = {run: centers[run].copy() for run in moving}
        for r in assignment_sums(stored, {run: centers[run] for run in sorted(moving)}, features).collect():
            moved[r["k"], r["seed"]][r["cluster"]] = np.array(r["sums"]) / r["n"]
        moving = {run for run, now in moved.items() if ((now - centers[run]) ** 2).sum(axis=1).max() > tol * tol}
        centers.update(moved)
    totals = assignment_sums(stored, centers, features).groupBy("k", "seed").agg(
        F.sum("cost").alias("cost"), (F.sum("distance") / F.sum("n")).alias("mean_distance")).collect()
    return {(r["k"], r["seed"]): KMeansRun(centers[r["k"], r["seed"]], r["cost"], r["mean_distance"]) for r in totals}


def kmeans_score_by_k(vectors: DataFrame, ks: Sequence[int] = fixed.KMEANS_SIZES, seeds: Sequence[int] = SEEDS,
                      features: str = "features") -> DataFrame:
    """(k, mean_distance): mean distance to the own centre for each number of clusters, by the run of least cost. No rows without vectors."""
    runs, best = fit_kmeans_sizes(vectors, list(ks), seeds, features), {}
    for (k, _), run in sorted(runs.items()):
        if k not in best or run.cost < best[k].cost:
            best[k] = run
    return vectors.sparkSession.createDataFrame(
        [(k, float(run.mean_distance)) for k, run in best.items()], "k int, mean_distance double")


def spectrum_separation_test(tx: DataFrame, model: KMeansModel | DataFrame, target: str = "home",
                             radius: float = fixed.RADIUS, seed: int = 0) -> DataFrame:
    """Per customer the centroid distance of a random point near the target, the smallest among the points
    outside, and whether the near one is smaller."""
    visits = target_visits(tx, target).filter(F.col("d2") <= fixed.SPECTRUM_REACH_SQUARED)
    visits = cut_lineage(qualified(
        visits, F.count_if(inside(radius)) > 0, F.count(F.lit(1)) >= K, F.count_if(~inside(radius)) > 0
    ))
    picked = sample_point_per_group(visits.filter(inside(radius)), seed).withColumn("_in", F.lit(True))
    anchors = picked.unionByName(visits.filter(~inside(radius)).select(*PLACE).withColumn("_in", F.lit(False)))
    measured = distance_to_centroid(with_vector(point_spectrum(anchors, visits, ["_in"])), model)
    return (
        measured.groupBy("customer_id")
        .agg(F.min(F.when(F.col("_in"), F.col("centroid_distance"))).alias("in_distance"),
             F.min(F.when(~F.col("_in"), F.col("centroid_distance"))).alias("out_distance"))
        .withColumn("separated", F.when(F.col("in_distance") < F.col("out_distance"), 1.0).otherwise(0.0))
    )


METRICS = ["mean", "variance", "min", "max", "numNonZeros", "normL1", "normL2"]


def column_statistics(vectors: DataFrame, features: str = "features") -> DataFrame:
    """One row per component: mean, variance, min, max, count, non-zeros and norms."""
    one = vectors.select(Summarizer.metrics("count", *METRICS).summary(F.col(features)).alias("s"))
    lists = [vector_to_array(F.col(f"s.{m}")).alias(m) for m in METRICS]
    wide = one.select(F.col("s.count").alias("count"), F.arrays_zip(*lists).alias("_rows"))
    return wide.select("count", F.posexplode("_rows").alias("component", "_row")).select(
        "component", "count", *[F.col(f"_row.{m}").alias(m) for m in METRICS]
    )


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns minus their mean, divided by the population deviation where it is not zero."""
    # One row of moments: they become literals, and the second pass needs no join.
    m = df.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns],
               *[F.stddev_pop(c).alias(f"dev_{c}") for c in columns]).first()

    def scored(c):
        centred, dev = F.col(c) - F.lit(m[f"mean_{c}"]), m[f"dev_{c}"]
        return centred / F.lit(dev) if dev else centred

    return df.withColumns({c: scored(c) for c in columns})


def label_entropy(df: DataFrame, cluster: str = "prediction", label: str = "label") -> DataFrame:
    """Entropy of the labels in each cluster, in nats."""
    counts = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(cluster).agg(F.sum("_n").alias("_all"))
    share = F.col("_n") / F.col("_all")
    return counts.join(totals, cluster).groupBy(cluster).agg(F.sum(-share * F.log(share)).alias("entropy"))
