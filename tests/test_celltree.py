"""Trees of cells, and what is built on them, against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from waymark.operators import celltree, radius, ranking


def uneven(n, seed, key="hot"):
    """A wide scatter, a line, a lattice with many equal distances, and a clump a millionth as wide as all."""
    rng = random.Random(seed)
    points = {(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(n // 4)}
    points |= {(i / 10, 7.0) for i in range(n // 4)} | {(float(i % 12), float(i // 12)) for i in range(n // 4)}
    points |= {(1 + rng.uniform(0, 1e-4), 1 + rng.uniform(0, 1e-4)) for _ in range(n // 4)}
    return [(key, *p) for p in sorted(points)]


def table(spark, rows):
    return spark.createDataFrame(rows, "g string, lat double, lon double").repartition(4)


def d2(p, q):
    return (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2])


@pytest.mark.parametrize("leaf_rows", [1, 7])
def test_a_tree_holds_every_point_once(spark, leaf_rows):
    rows = uneven(240, 1) + [("one", 5.0, 5.0)] + uneven(40, 2, "other")
    tree = celltree.build(celltree.two_sides(table(spark, rows), table(spark, rows[::2]), ["g"]), ["g"], leaf_rows)
    located = tree.located.collect()
    assert sorted((r["g"], r["lat"], r["lon"]) for r in located) == sorted(rows)
    groups = {g: (sum(x[0] == g for x in rows), sum(x[0] == g for x in rows[::2])) for g in ("hot", "one", "other")}
    assert {r["g"]: (r["asks"], r["holds"]) for r in tree.roots.collect()} == groups
    held = {}
    for r in located:
        held.setdefault(r["leaf"], []).append(r)
    steps = tree.steps.collect()
    boxes = {r["child"]: r for r in steps if r["leaf"]}
    assert set(boxes) == set(held)
    for leaf, points in held.items():
        box = boxes[leaf]
        assert box["asks"] == len(points) <= leaf_rows
        assert (box["lat0"], box["lat1"]) == (min(p["lat"] for p in points), max(p["lat"] for p in points))
        assert (box["lon0"], box["lon1"]) == (min(p["lon"] for p in points), max(p["lon"] for p in points))
    # Children make up their parent; above names every cell over a leaf.
    size = {r["child"]: r["asks"] for r in steps} | {r["cell"]: r["asks"] for r in tree.roots.collect()}
    for cell in {r["cell"] for r in steps}:
        assert sum(r["asks"] for r in steps if r["cell"] == cell) == size[cell]
    above = tree.above.collect()
    for cell in size:
        assert sum(size[r["leaf"]] for r in above if r["cell"] == cell) == size[cell]


@pytest.mark.parametrize("limits", [{"plain_rows": 20, "tree_rows": 70, "leaf_rows": 6}, {"plain_rows": 2, "tree_rows": 2, "leaf_rows": 3}])
def test_nearest_points_of_a_hot_customer(spark, limits):
    rows = uneven(200, 3) + uneven(60, 4, "cool") + [("two", 0.0, 0.0), ("two", 1.0, 0.0)]
    # Anchors that are no points, far outside too.
    anchors = rows[::3] + [("hot", 1e3, -1e3), ("hot", 3.25, 3.25), ("cool", 0.1, 0.1), ("nobody", 1.0, 1.0)]
    points = table(spark, rows).withColumn("name", F.concat("lat", F.lit("/"), "lon"))
    got = {}
    for r in ranking.nearest_points_k(table(spark, anchors), points, 4, by=["g"], keep=["name"], **limits).collect():
        got.setdefault((r["g"], r["lat"], r["lon"]), []).append((r["rank"], r["d2"], r["near_lat"], r["near_lon"], r["name"] is not None))
    want = {}
    for a in anchors:
        order = sorted((d2(a, p), p[1], p[2]) for p in rows if p[0] == a[0])[:4]
        if order:
            want[a] = [(i + 1, *o, True) for i, o in enumerate(order)]
    assert {a: sorted(v) for a, v in got.items()} == want


@pytest.mark.parametrize("leaf_rows, group", [(60, []), (5, ["kind"])])
def test_sums_within_a_radius_of_a_hot_group(spark, leaf_rows, group):
    rows = uneven(240, 5) + uneven(60, 6, "cool")
    others = [(*p, i % 3, i) for i, p in enumerate(rows)] + [(*p, 0, 1) for p in rows[::2]]
    df = spark.createDataFrame(others, "g string, lat double, lon double, kind int, v long").repartition(4)
    got = radius.radius_aggregate(table(spark, rows), df, 2.0, "v", "s", by=["g"], group=group, block_size=10, tree_rows=30, leaf_rows=leaf_rows).collect()
    want = {}
    for p in rows:
        for o in others:
            if o[0] == p[0] and d2(p, o) <= 4.0:
                key = (*p, *([o[3]] if group else []))
                want[key] = want.get(key, 0) + o[4]
    assert {(r["g"], r["lat"], r["lon"], *[r[c] for c in group]): r["s"] for r in got} == want and len(got) == len(want)


def test_covered_cells_are_not_looked_into(spark):
    rng = random.Random(7)
    rows = [("hot", rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(3000)]
    tree = celltree.build(celltree.two_sides(table(spark, rows), table(spark, rows), ["g"]), ["g"], 20)
    leaves, covered = celltree.descend(tree, ["g"], celltree.within(0.4))
    n = {r["child"]: r["asks"] for r in tree.steps.collect()}
    border = sum(n[r["_a"]] * n[r["_p"]] for r in leaves.collect())
    inside = sum(n[r["_a"]] * n[r["_p"]] for r in covered.collect())
    exact = sum(d2(p, q) <= 0.16 for p in rows[::30] for q in rows) * 30
    assert inside <= exact * 1.2 and border + inside >= exact * 0.8
    # Nine million pairs in all; those point by point are on the border only.
    assert border < 2_500_000 and inside > border


def test_work_grows_with_points_not_pairs(spark):
    def seconds(n):
        rng = random.Random(8)
        df = table(spark, [("hot", rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(n)]).cache()
        df.count()
        start = time.perf_counter()
        assert ranking.nearest_points_k(df, df, 5, by=["g"]).count() == 5 * n
        return time.perf_counter() - start

    # Eight thousand meet as blocks, all with all; sixteen thousand in a tree.
    seconds(9_000)
    assert seconds(16_000) <= 2.5 * seconds(8_000)


def test_hot_cells_of_a_join_are_cut(spark):
    """A third of the rows in one cell, another third in a clump narrower than any cell."""
    rng = random.Random(9)
    spread = {(rng.uniform(0, 2), rng.uniform(0, 2)) for _ in range(1000)}
    clump = {(9 + rng.uniform(0, 1e-7), 9 + rng.uniform(0, 1e-7)) for _ in range(1000)}
    rest = {(rng.uniform(-40, 40), rng.uniform(-40, 40)) for _ in range(1000)}
    rows = sorted(spread | clump | rest)
    right = spark.createDataFrame([("x", *p) for p in rows], "g string, r_lat double, r_lon double")
    asked = rows[::40]
    left = spark.createDataFrame([("x", *p) for p in asked] + [("y", 1.0, 1.0)], "g string, lat double, lon double")
    got = radius.radius_join(left, right, 1.0, by=["g"], hot_rows=50).collect()
    want = {(p, q) for p in asked for q in rows if d2((0, *p), (0, *q)) <= 1.0}
    assert {((r["lat"], r["lon"]), (r["r_lat"], r["r_lon"])) for r in got} == want and len(got) == len(want)
    # Rows of a key: no more than a few times the limit, however they lie.
    probe, placed = radius._probe(left, "lat", "lon", 1.0), radius._placed(right, "r_lat", "r_lon", 1.0)
    _, cut, keys = radius._cut_cells(probe, placed, ("lat", "r_lat"), ("lon", "r_lon"), 1.0, ["g"], 50)
    sizes = [r["count"] for r in cut.groupBy(*keys).count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 110
    assert max(r["count"] for r in placed.groupBy("g", "_cx", "_cy").count().collect()) >= 1000
