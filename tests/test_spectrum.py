"""K-Means of several sizes in one scan, and distances to a table of centres, against plain loops."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from waymark.plans import spectrum


def vectors(spark, rows):
    df = spark.createDataFrame([(i, None if r is None else [float(x) for x in r]) for i, r in enumerate(rows)], "id long, x array<double>")
    return df.withColumn("features", F.when(F.col("x").isNotNull(), array_to_vector(F.coalesce("x", F.array(F.lit(0.0))))))


def blobs(seed=0, groups=6, rows=150, width=3):
    rnd = np.random.default_rng(seed)
    return np.concatenate([rnd.normal(10 * rnd.random(width), 0.4, (rows, width)) for _ in range(groups)])


def brute_sums(rows, centers):
    found = {}
    for x in rows:
        d2 = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centers]
        own = d2.index(min(d2))
        n, sums, distance, cost = found.get(own, (0, np.zeros(len(x)), 0.0, 0.0))
        found[own] = n + 1, sums + x, distance + min(d2) ** 0.5, cost + min(d2)
    return found


@pytest.mark.parametrize("matrix", [1, 40, 4_000_000])
def test_sums_of_several_runs_in_one_scan(spark, monkeypatch, matrix):
    monkeypatch.setattr(spectrum, "MATRIX_SIZE", matrix)
    # Repeated rows, ties between centres, a centre nobody is near, a null.
    rows = [(0, 0), (0, 0), (1, 0), (2, 0), (2, 2), (-3, 1)]
    runs = {(2, 0): np.array([[0, 0], [2, 0]]), (2, 7): np.array([[2, 2], [2, 2]]), (3, 0): np.array([[0, 0], [90, 90], [2, 1]])}
    df = vectors(spark, [*rows, None]).repartition(3)
    got = {(r["k"], r["seed"], r["cluster"]): r for r in spectrum.assignment_sums(df, runs).collect()}
    want = {(*run, c): v for run, centers in runs.items() for c, v in brute_sums(np.array(rows, dtype=float), centers).items()}
    assert set(got) == set(want)
    for key, (n, sums, distance, cost) in want.items():
        r = got[key]
        assert r["n"] == n and r["sums"] == pytest.approx(list(sums))
        assert r["distance"] == pytest.approx(distance) and r["cost"] == pytest.approx(cost)


def test_all_sizes_together_are_no_worse_than_one_after_another(spark):
    rows = blobs()
    df = vectors(spark, rows).cache()
    ks = [2, 6, 12]
    runs = spectrum.fit_kmeans_sizes(df, ks, seeds=(0, 1, 2))
    assert set(runs) == {(k, s) for k in ks for s in (0, 1, 2)}
    for k in ks:
        best = min((runs[k, s] for s in (0, 1, 2)), key=lambda r: r.cost)
        assert best.centers.shape == (k, 3)
        alone = spectrum.fit_kmeans(df, k)
        assert best.cost <= alone.summary.trainingCost * 1.05
        totals = brute_sums(rows, best.centers).values()
        assert best.cost == pytest.approx(sum(t[3] for t in totals))
        assert best.mean_distance == pytest.approx(sum(t[2] for t in totals) / len(rows))
        # Settled: every centre is the mean of its rows, but for the last move.
        assert all(np.abs(t[1] / t[0] - best.centers[c]).max() < 0.05 for c, t in brute_sums(rows, best.centers).items())
    # The library draws its starting points by partition, and stored partitions come back in any order.
    scores = {r["k"]: r["mean_distance"] for r in spectrum.kmeans_score_by_k(df, ks).collect()}
    assert scores == pytest.approx({k: min((runs[k, s] for s in (0, 1, 2)), key=lambda r: r.cost).mean_distance for k in ks}, rel=0.05)


def test_rounds_read_the_vectors_once_for_all_runs(spark, monkeypatch):
    scans, plain = [], spectrum.assignment_sums

    def counted(vectors, runs, features="features"):
        scans.append(len(runs))
        return plain(vectors, runs, features)

    monkeypatch.setattr(spectrum, "assignment_sums", counted)
    spectrum.fit_kmeans_sizes(vectors(spark, blobs(1)), list(range(2, 12)), seeds=(0, 1), max_iter=5)
    assert len(scans) <= 6 and scans[0] == 20 and scans[-1] == 20


def test_few_equal_and_no_vectors(spark):
    assert spectrum.kmeans_score_by_k(vectors(spark, [None]), [2, 3]).count() == 0
    same = spectrum.kmeans_score_by_k(vectors(spark, [(1, 2)] * 9), [2, 3], seeds=(0,)).collect()
    assert [(r["k"], r["mean_distance"]) for r in same] == [(2, 0.0), (3, 0.0)]
    few = {r["k"]: r["mean_distance"] for r in spectrum.kmeans_score_by_k(vectors(spark, [(0, 0), (0, 4), (9, 9)]), [1, 3, 8], seeds=(0,)).collect()}
    assert few[3] == few[8] == 0.0 and few[1] > 0


def test_distance_to_a_table_of_centers(spark):
    centers = spark.createDataFrame([(4, [0.0, 0.0]), (2, [3.0, 4.0]), (9, [3.0, 4.0])], "prediction int, center array<double>")
    df = vectors(spark, [(0, 0), (3, 4), (6, 8), None])
    got = {r["id"]: (r["prediction"], r["centroid_distance"]) for r in spectrum.distance_to_centroid(df, centers).collect()}
    assert got[0] == (4, 0.0) and got[1] == (2, 0.0) and got[2] == (2, 5.0) and got[3] == (None, None)
    with pytest.raises(ValueError):
        spectrum.distance_to_centroid(df, centers.limit(0))


def test_nearest_centres_are_those_of_plain_sums():
    rnd = np.random.default_rng(3)
    lattice = np.stack(np.meshgrid([0.0, 1.0, 2.0], [0.0, 1.0, 2.0]), axis=-1).reshape(-1, 2)
    far = 1e8 + rnd.random((50, 2))
    for x, centers in [(rnd.random((300, 9)), rnd.random((40, 9))), (lattice, lattice[[0, 2, 2, 6, 8]]), (far, far[:7]),
                       (np.array([[1.0, np.nan], [np.inf, 0.0], [0.5, 0.0]]), lattice[:2]), (rnd.random((5, 1)), rnd.random((1, 1)))]:
        d2 = np.zeros((len(x), len(centers)))
        with np.errstate(all="ignore"):
            for i in range(x.shape[1]):
                d2 += (x[:, i, None] - centers[None, :, i]) ** 2
            own, least = spectrum.nearest_centers(x, centers)
        assert own.tolist() == d2.argmin(axis=1).tolist()
        np.testing.assert_array_equal(least, d2.min(axis=1))
