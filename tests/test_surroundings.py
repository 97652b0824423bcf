import random
from collections import defaultdict

from waymark.operators import surroundings


def test_buildings_that_the_same_places_reach_are_one(spark):
    rnd = random.Random(3)
    spots = [(55 + rnd.uniform(0, 0.05), 37 + rnd.uniform(0, 0.05)) for _ in range(5)]
    flats = [(i, 55 + rnd.uniform(-0.03, 0.08), 37 + rnd.uniform(-0.03, 0.08), rnd.choice([None, 0, 3, 7, -2])) for i in range(3000)]
    flats += [(None, *flats[0][1:]), (None, None, 37.0, 5)]
    apartments = spark.createDataFrame(flats, "apartment_id long, lat double, lon double, units int")
    places = spark.createDataFrame([(f"c{i % 2}", i % 3, *p) for i, p in enumerate(spots)], "customer_id string, cluster_id long, lat double, lon double")
    reached = lambda p, f: f[1] is not None and (p[0] - f[1]) * (p[0] - f[1]) + (p[1] - f[2]) * (p[1] - f[2]) <= 0.02 * 0.02

    sets = {(frozenset(i for i, p in enumerate(spots) if reached(p, f)), f[1] // 0.02, f[2] // 0.02) for f in flats if any(reached(p, f) for p in spots)}
    alike = surroundings._reached_alike(places, apartments, 0.02).collect()
    assert len(alike) == len(sets) < 100
    want = defaultdict(int)
    for c in {(f"c{i % 2}", i % 3) for i in range(5)}:
        own = [p for i, p in enumerate(spots) if (f"c{i % 2}", i % 3) == c]
        want[c] = sum(f[3] or 0 for f in flats if any(reached(p, f) for p in own))
    got = {(r["customer_id"], r["cluster_id"]): r["cluster_units"] for r in surroundings.cluster_apartment_units(places, apartments).collect()}
    assert got == dict(want)
