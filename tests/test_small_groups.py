"""Small groups resolved in place, against brute force, with missing values."""

import math

import pytest
from pyspark.sql import functions as F

from waymark.operators import radius, surroundings

R = 0.02


@pytest.fixture(scope="module")
def visits(spark):
    rows = [(f"C{i % 7}" if i % 19 else None, 55 + (i * 7919 % 23) * 0.007 if i % 17 else None, 37 + (i * 31 % 29) * 0.007,
             [i % 5, i % 3, None] if i % 11 == 0 else [i % 50] if i % 4 else [] if i % 3 else None) for i in range(150)]
    rows += [("C1", 55.0, 37.0, [7]), ("C1", 55.0, 37.0, [8]), ("lone", 10.0, 10.0, [None])]
    return spark.createDataFrame(rows, "customer_id string, lat double, lon double, mccs array<int>")


def near(a, b):
    return None not in (a.lat, b.lat, a.lon, b.lon) and (a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2 <= R * R


@pytest.mark.parametrize("rows", [1000, 4])
def test_codes_near_each_place(visits, rows):
    every, wanted = [r for r in visits.collect() if r.customer_id], {}
    for a in every:
        used = [m for b in every if a.customer_id == b.customer_id and near(a, b) for m in b.mccs or []]
        if used:
            wanted[a.customer_id, a.lat, a.lon] = sorted({m for m in used if m is not None})
    found = surroundings.near_mccs(visits, R, array_rows=rows).collect()
    assert len(found) == len(wanted) and {(r.customer_id, r.lat, r.lon): sorted(r.near_mccs) for r in found} == wanted


def test_codes_near_places_form_no_pairs_in_the_plan(visits):
    """Each code of a place was a row that met four cells: a customer of a few places now moves once and meets itself in place."""
    plan = surroundings.near_mccs(visits, R)._jdf.queryExecution().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("rows", [1000, 4])
def test_counts_near_each_place(visits, rows):
    every = {(r.customer_id, r.lat, r.lon): r for r in visits.collect() if r.customer_id}
    wanted = {k: sum(a.customer_id == b.customer_id and near(a, b) for b in every.values()) for k, a in every.items()}
    found = {(r[0], r[1], r[2]): r.near_count for r in radius.near_point_count(visits, R, array_rows=rows).collect()}
    assert found == {k: n for k, n in wanted.items() if n}


@pytest.mark.parametrize("rows", [1000, 8])
def test_sums_of_distances(visits, rows):
    points = visits.filter("customer_id is not null and (lat is not null or customer_id = 'C3')").select(
        "customer_id", "lat", "lon", F.when(F.col("lon") < 37.15, F.round(F.col("lon") * 100) % 7).alias("n")).filter(
        "customer_id <> 'C4' or n is not null").distinct()
    groups = {}
    for r in points.collect():
        groups.setdefault(r.customer_id, []).append(r)
    found = {r[0]: r for r in radius.pair_distance_sums(points, ["customer_id"], {"heavy": "n", "plain": None}, rows).collect()}
    assert set(found) == set(groups)
    for key, own in groups.items() if rows == 1000 else ():
        for name, weight in (("heavy", lambda r: r.n), ("plain", lambda r: 1)):
            pairs = [weight(a) * weight(b) * math.dist((a.lat, a.lon), (b.lat, b.lon)) for a in own for b in own
                     if None not in (a.lat, b.lat, weight(a), weight(b))]
            assert found[key][name] == pytest.approx(sum(pairs))

