import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from waymark import materialize
from waymark.operators import components, density, radius

# A CSV of x, y, label: 749 points with the known result of eps 0.3 and 10 points. Given by the caller.
LABELLED = os.environ.get("LABELLED_POINTS", "")


def near(p, q, r):
    return (p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) <= r * r


def brute_components(points, eps):
    points = sorted(set(points))
    parent = {p: p for p in points}

    def find(p):
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    for i, p in enumerate(points):
        for q in points[i + 1:]:
            if near(p, q, eps):
                parent[find(p)] = find(q)
    groups = defaultdict(set)
    for p in points:
        groups[find(p)].add(p)
    return {frozenset(g) for g in groups.values()}


def partition(rows):
    groups = defaultdict(set)
    for r in rows:
        groups[(r["customer_id"], r["cluster_id"])].add((r["lat"], r["lon"]))
    out = defaultdict(set)
    for (customer, _), g in groups.items():
        out[customer].add(frozenset(g))
    return out


def scattered(seed, n, spread, step=None):
    rnd = random.Random(seed)
    pick = (lambda: round(rnd.uniform(-spread, spread) / step) * step) if step else (lambda: rnd.uniform(-spread, spread))
    return [(pick(), pick()) for _ in range(n)]


@pytest.mark.parametrize("direct_pairs", [density.DIRECT_PAIRS, 0])
def test_cluster_points_equals_brute_force(spark, direct_pairs):
    data = {
        "sparse": scattered(1, 300, 0.25), "lattice": scattered(2, 300, 0.2, 0.007),
        "dense": scattered(3, 300, 0.03), "one": [(55.0, 37.0)], "far": scattered(4, 60, 20.0),
        # A long chain over many tiles, and two dense heaps just too far apart.
        "chain": [(i * 0.019, 3.0 + i * 0.003) for i in range(400)],
        "heaps": [(0.0001 * i, 0.0001 * j) for i in range(12) for j in range(12)]
                 + [(0.0001 * i, 0.0211 + 0.0001 * 11 + 0.0001 * j - 0.0011) for i in range(12) for j in range(12)],
    }
    rows = [(c, *p) for c, ps in data.items() for p in ps]
    df = spark.createDataFrame(rows, "customer_id string, lat double, lon double")
    got = partition(density.cluster_points(df, 0.02, direct_pairs=direct_pairs).collect())
    for customer, points in data.items():
        assert got[customer] == brute_components(points, 0.02), customer


def test_cluster_ids_do_not_depend_on_row_order(spark):
    rows = [("c", *p) for p in scattered(5, 200, 0.1)]
    def run(r):
        df = spark.createDataFrame(r, "customer_id string, lat double, lon double")
        return {(x["lat"], x["lon"]): x["cluster_id"] for x in density.cluster_points(df, 0.02).collect()}
    assert run(rows) == run(rows[::-1])


def brute_dbscan(points, eps, k):
    """points: list with repeats. Returns {point: (role, frozenset of core points | None)}"""
    places = sorted(set(points))
    core = [p for p in places if sum(near(p, q, eps) for q in points) >= k]
    comps = brute_components(core, eps) if core else set()
    size = density.cell_size(eps)
    def key(c):
        return min((int(p[0] // size), int(p[1] // size)) for p in c)
    out = {}
    for p in places:
        if p in core:
            out[p] = ("core", next(c for c in comps if p in c))
        else:
            around = [c for c in comps if any(near(p, q, eps) for q in c)]
            out[p] = ("border", min(around, key=key)) if around else ("noise", None)
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_dbscan_equals_brute_force(spark, k):
    points = scattered(6, 250, 0.15) + scattered(7, 150, 0.1, 0.007)
    df = spark.createDataFrame(points, "lat double, lon double")
    got = {(r["lat"], r["lon"]): (r["role"], r["cluster_id"]) for r in density.dbscan(df, 0.02, k).collect()}
    want = brute_dbscan(points, 0.02, k)
    assert {p: v[0] for p, v in got.items()} == {p: v[0] for p, v in want.items()}
    pairs = {(got[p][1], want[p][1]) for p in want}
    assert len(pairs) == len({g for g, _ in pairs}) == len({w for _, w in pairs})


def test_dbscan_eight_points(spark):
    places = [(0, 0), (1, 0), (-21, 0), (21, 0), (-21, 0), (21, 0), (-21, 0), (-22, 0)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in places], "lat double, lon double")
    one = density.dbscan(df, 1.0, 1).groupBy("cluster_id").agg(F.sum("weight").alias("n")).collect()
    assert sorted(r["n"] for r in one) == [2, 2, 4]
    three = {(r["lat"], r["role"]) for r in density.dbscan(df, 1.0, 3).collect()}
    assert three == {(-21.0, "core"), (-22.0, "core"), (0.0, "noise"), (1.0, "noise"), (21.0, "noise")}


def test_dbscan_with_weights_and_a_minimum_per_group(spark):
    df = spark.createDataFrame(
        [("a", 0.0, 0.0, 3, 4), ("a", 0.0, 0.01, 1, 4), ("b", 0.0, 0.0, 3, 5), ("b", 0.0, 0.01, 1, 5)],
        "g string, lat double, lon double, w int, k int")
    roles = {(r["g"], r["lon"]): r["role"] for r in density.dbscan(df, 0.02, "k", by=["g"], weight="w").collect()}
    assert roles == {("a", 0.0): "core", ("a", 0.01): "core", ("b", 0.0): "noise", ("b", 0.01): "noise"}


@pytest.mark.skipif(not os.path.exists(LABELLED), reason="LABELLED_POINTS not set")
def test_dbscan_on_labelled_points(spark):
    df = spark.read.csv(LABELLED, schema="lat double, lon double, label int")
    got = density.dbscan(df.select("lat", "lon"), 0.3, 10)
    pairs = df.join(got, ["lat", "lon"]).groupBy("label", "cluster_id").count().collect()
    assert sorted((r["label"], r["count"]) for r in pairs) == [(0, 18), (1, 243), (2, 245), (3, 243)]
    assert {r["label"] for r in pairs if r["cluster_id"] is None} == {0}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [("p", None, i, i + 1) for i in range(200)] + [("s", None, 1000, i) for i in range(300, 400)]
    df = spark.createDataFrame(edges, "g string, _tile long, u long, v long")
    got = {(r["g"], r["node"]): r["root"] for r in components.connected_components(df, ["g"]).collect()}
    assert {v for (g, _), v in got.items() if g == "p"} == {0}
    assert {v for (g, _), v in got.items() if g == "s"} == {300}
    assert len(got) == 201 + 101


def test_tile_rows_over_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        edges = [(f"g{g}", g % 3, i, i + 1) for g in range(9) for i in range(40)]
        df = spark.createDataFrame(edges, "g string, _tile long, u long, v long")
        got = components.tile_components(df, ["g"]).collect()
        assert len(got) == 9 * 41 and {r["root"] for r in got} == {0}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("hot_rows", [4096, 5])
def test_radius_join_equals_brute_force(spark, hot_rows):
    a, b = scattered(8, 150, 0.1, 0.007), scattered(9, 150, 0.1)
    left = spark.createDataFrame(sorted(set(a)), "lat double, lon double")
    right = spark.createDataFrame(sorted(set(b)), "r_lat double, r_lon double")
    got = {((r["lat"], r["lon"]), (r["r_lat"], r["r_lon"])) for r in radius.radius_join(left, right, 0.02, hot_rows=hot_rows).collect()}
    assert got == {(p, q) for p in set(a) for q in set(b) if near(p, q, 0.02)}


@pytest.mark.parametrize("block_size, tree_rows", [(256, 256), (3, 256), (3, 4)])
def test_aggregates_over_blocks_equal_brute_force(spark, block_size, tree_rows):
    points = sorted(set(scattered(10, 120, 0.05)))
    df = spark.createDataFrame([(*p, i % 4, i) for i, p in enumerate(points)], "lat double, lon double, w int, v int")
    got = {(r["lat"], r["lon"]): r["s"] for r in
           radius.radius_aggregate(df, df, 0.02, "v", "s", block_size=block_size, tree_rows=tree_rows, leaf_rows=4).collect()}
    assert got == {p: sum(i for i, q in enumerate(points) if near(p, q, 0.02)) for p in points}
    grouped = df.withColumn("g", F.lit("g"))
    total = radius.pair_distance_sum(grouped, ["g"], "w", block_size=block_size).collect()[0]["distance_sum"]
    want = sum((i % 4) * (j % 4) * ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5
               for i, p in enumerate(points) for j, q in enumerate(points))
    assert total == pytest.approx(want)


def test_coordinates_far_from_zero(spark):
    """A thousand million radii away cells are still told apart; farther on they aren't, which is an error."""
    def clusters(at):
        points = [(at + x, -at + y) for x in (0.0, 0.5, 4.0) for y in (0.0, 0.5, 4.0)]
        df = spark.createDataFrame(points, "lat double, lon double")
        found = {}
        for r in density.dbscan(df, 1.0, 1).collect():
            found.setdefault(r["cluster_id"], set()).add((r["lat"] - at, r["lon"] + at))
        return sorted(sorted(c) for c in found.values())

    assert clusters(1e9) == clusters(0.0) and len(clusters(0.0)) == 4
    with pytest.raises(Exception, match="larger radius"):
        clusters(1e10)


@pytest.mark.parametrize("array_rows", [256, 40, 0])
def test_groups_as_arrays_and_as_cells_give_the_same(spark, array_rows):
    data = {"few": scattered(21, 30, 0.05), "lattice": scattered(22, 60, 0.1, 0.007), "many": scattered(23, 200, 0.1), "one": [(55.0, -0.0)]}
    rows = [(c, *p, i % 3) for c, ps in data.items() for i, p in enumerate(ps)]
    rows += [(None, 1.0, 1.0, 1), (None, 1.0, 1.001, 1), ("few", None, 1.0, 1), ("gone", 1.0, None, 1)]
    df = spark.createDataFrame(rows, "customer_id string, lat double, lon double, w int")
    found = density.cluster_points(df, 0.02, array_rows=array_rows).collect()
    got = partition(r for r in found if r["customer_id"] in data and r["lat"] is not None)
    for customer, points in data.items():
        assert got[customer] == brute_components(points, 0.02), customer
    # What lacks a key or coordinate is near nothing.
    loose = {(r["customer_id"], r["lat"], r["lon"]): r["cluster_id"] for r in found if None in (r["customer_id"], r["lat"], r["lon"])}
    assert len(loose) == 4 and loose["few", None, 1.0] is None and loose[None, 1.0, 1.0] is not None
    counts = {(r["customer_id"], r["lat"], r["lon"]): r["near_count"] for r in radius.near_point_count(df, 0.02, array_rows=array_rows).collect()}
    assert counts == {(c, *p): sum(near(p, q, 0.02) for q in set(ps)) for c, ps in data.items() for p in ps}
    sums = {r["customer_id"]: r["s"] for r in radius.pair_distance_sums(df.dropna(), ["customer_id"], {"s": "w"}, block_size=max(array_rows, 1)).collect()}
    for customer, points in data.items():
        want = sum((i % 3) * (j % 3) * ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5 for i, p in enumerate(points) for j, q in enumerate(points))
        assert sums[customer] == pytest.approx(want), customer


def _exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_small_groups_move_once(spark):
    rows = [(f"c{c}", *p, 1) for c in range(20) for p in set(scattered(c, 20, 0.1))]
    df = materialize.cut_lineage(spark.createDataFrame(rows, "customer_id string, lat double, lon double, w int"))
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in kept:
            spark.conf.set(k, "-1")
        assert _exchanges(density.cluster_points(df, 0.02).filter("lat is not null")) <= 2
        assert _exchanges(radius.near_point_count(df, 0.02)) == 1
        assert _exchanges(radius.pair_distance_sums(df, ["customer_id"], {"s": "w"})) == 1
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("array_rows", [256, 40, 0])
def test_dbscan_of_groups_as_arrays_and_as_cells(spark, array_rows):
    data = {"few": scattered(31, 30, 0.05), "lattice": scattered(32, 60, 0.1, 0.007), "many": scattered(33, 150, 0.12), "one": [(55.0, 37.0)]}
    rows = [(c, *p) for c, ps in data.items() for p in ps] + [(None, 1.0, 1.0), ("few", None, 1.0), ("few", 0.0, 1e10)]
    df = spark.createDataFrame(rows, "customer_id string, lat double, lon double")
    found = density.dbscan(df, 0.02, 3, by=["customer_id"], array_rows=array_rows)
    assert found.columns == ["customer_id", "lat", "lon", "weight", "cluster_id", "role"]
    got = {}
    for r in found.collect():
        got.setdefault(r["customer_id"], {})[r["lat"], r["lon"]] = (r["role"], r["cluster_id"], r["weight"])
    assert got["few"].pop((0.0, 1e10)) == ("noise", None, 1) and set(got) == set(data)
    for customer, points in data.items():
        want = brute_dbscan(points, 0.02, 3)
        assert {p: v[0] for p, v in got[customer].items()} == {p: v[0] for p, v in want.items()}
        pairs = {(got[customer][p][1], want[p][1]) for p in want}
        assert len(pairs) == len({g for g, _ in pairs}) == len({w for _, w in pairs})
        assert {p: v[2] for p, v in got[customer].items()} == {p: points.count(p) for p in want}
