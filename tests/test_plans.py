import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from waymark.operators import lookups, ranking, surroundings
from waymark.plans import classify, features, propagate, spectrum


def near(p, q, r):
    return (p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) <= r * r


def transactions(spark, seed=0, customers=6, rows=40, spread=0.08):
    rnd, out = random.Random(seed), []
    places = [(55 + rnd.uniform(0, spread), 37 + rnd.uniform(0, spread)) for _ in range(30)]
    for c in range(customers):
        home = (55 + rnd.uniform(0, spread), 37 + rnd.uniform(0, spread))
        for _ in range(rows):
            p = rnd.choice(places)
            out.append((f"c{c}", *p, date(2017, 1, 1) + timedelta(rnd.randrange(300)), rnd.choice([1, 5, 9]), rnd.choice([643, 840]),
                        rnd.choice(["A", "B"]), *home))
    names = ["customer_id", "lat", "lon", "date", "mcc", "currency", "country", "home_lat", "home_lon"]
    kinds = "customer_id string, lat double, lon double, date date, mcc int, currency int, country string, home_lat double, home_lon double"
    return spark.createDataFrame(out, kinds), [dict(zip(names, r)) for r in out]


@pytest.fixture(scope="module")
def prepared(spark):
    df, rows = transactions(spark)
    rnd = random.Random(1)
    flats = [(i, 55 + rnd.uniform(0, 0.08), 37 + rnd.uniform(0, 0.08), rnd.randrange(0, 90)) for i in range(400)]
    # Two buildings at one place, and one with as many flats as another: both count.
    flats += [(1000, flats[0][1], flats[0][2], flats[0][3]), (1001, flats[1][1], flats[1][2], flats[0][3])]
    apartments = spark.createDataFrame(flats, "apartment_id long, lat double, lon double, units int")
    shops = surroundings.shop_index(df, df, surroundings.mcc_home_weights(df))
    table = features.prepare_features(df, features.Surroundings(apartments, shops), "home")
    vectors = features.feature_vectors(*[lookups.category_dictionary(df, df, c) for c in ("country", "mcc", "currency")])
    return df, rows, flats, features.with_vectors(table, vectors).cache()


def test_features_equal_brute_force(prepared):
    _, rows, flats, table = prepared
    by_customer = defaultdict(list)
    for r in rows:
        by_customer[r["customer_id"]].append(r)
    got = {(r["customer_id"], r["lat"], r["lon"]): r for r in table.collect()}
    expected = 0
    for customer, tx in by_customer.items():
        home = (tx[0]["home_lat"], tx[0]["home_lon"])
        if not any(near((t["lat"], t["lon"]), home, 0.06) for t in tx):
            assert not any(k[0] == customer for k in got)
            continue
        places = sorted({(t["lat"], t["lon"]) for t in tx})
        expected += len(places)
        members = defaultdict(list)
        for p in places:
            members[got[(customer, *p)]["cluster_id"]].append(p)
        for cluster in members.values():
            reach = {f for f in flats if any(near(p, f[1:3], 0.02) for p in cluster)}
            for p in cluster:
                row = got[(customer, *p)]
                mine = [t for t in tx if (t["lat"], t["lon"]) == p]
                all_tx = [t for t in tx if (t["lat"], t["lon"]) in cluster]
                units = sum(f[3] for f in flats if near(p, f[1:3], 0.02))
                total = sum(f[3] for f in reach)
                assert row["apartments_percent"] == pytest.approx(units / total if total else 0)
                assert row["near_count"] == sum(near(p, q, 0.02) for q in places)
                assert row["visit_ratio"] == pytest.approx(len(mine) / len(all_tx))
                span = (max(t["date"] for t in mine) - min(t["date"] for t in mine)).days
                assert row["duration"] == span
                assert row["date_ratio"] == (span // len(mine) if span else 1.0)
                assert row["label"] == (1.0 if near(p, home, 0.02) else 0.0)
                density = sum(((a["lat"] - b["lat"]) ** 2 + (a["lon"] - b["lon"]) ** 2) ** 0.5 for a in all_tx for b in all_tx)
                assert row["density"] == pytest.approx(density / row["near_count"])
                assert row["cluster_points"] == len(cluster)
                assert row["cluster_weekend_share"] == pytest.approx(sum(t["date"].weekday() >= 5 for t in all_tx) / len(all_tx))
                assert sorted(row["mccs"]) == sorted({t["mcc"] for t in mine})
    assert expected == len(got)


def test_vector_layout(prepared):
    row = prepared[3].first()
    n = len(features.CLUSTER_NUMBERS)
    assert len(row["features"]) == n + 2 + len(features.POINT_NUMBERS) + 3 + 2
    values = row["features"].toArray()
    assert values[n:n + 2].tolist() == [float(row["country"] == c) for c in ("A", "B")]
    assert values[-2:].tolist() == [float(row["currency"] == c) for c in (643, 840)]


def test_unlabelled_customers_are_kept_and_adaptive_labels_reach_further(spark):
    df = spark.createDataFrame([("a", 55.0, 37.0, 55.05, 37.0), ("b", 55.0, 37.0, None, None), ("c", 55.0, 37.0, 56.0, 37.0)],
                               "customer_id string, lat double, lon double, home_lat double, home_lon double")
    assert {r[0] for r in lookups.keep_near_target(df, "home").select("customer_id").collect()} == {"a", "b"}
    visits = df.withColumnsRenamed({"home_lat": "target_lat", "home_lon": "target_lon"})
    wide = features.label_radius(visits, adaptive=True).withColumn("label", features.point_label())
    assert {r["customer_id"]: r["label"] for r in wide.collect()} == {"a": 1.0, "b": 0.0, "c": 1.0}


def test_classifier_round_trip(spark, prepared, tmp_path):
    table = prepared[3].select("customer_id", "lat", "lon", "label", "features")
    model = classify.train_point_classifier(table, folds=2, rounds=2, depth=3, seed=3)
    classify.save_model(model, str(tmp_path / "m"))
    again = classify.load_model(str(tmp_path / "m"))
    one, two = (sorted(map(tuple, classify.predict_points(m, table).collect())) for m in (model, again))
    assert one == two and len(one) == table.select("customer_id").distinct().count()
    assert dict(map(tuple, classify.best_params(spark, model).collect()))["maxIter"] == "2"
    with pytest.raises(ValueError):
        classify.classifier("other")


@pytest.mark.parametrize("limits", [{}, {"plain_rows": 4}, {"plain_rows": 4, "tree_rows": 8, "leaf_rows": 3}])
def test_nearest_points_in_plain_and_crowded_groups(spark, limits):
    rnd = random.Random(2)
    points = [("a", rnd.uniform(0, 1), rnd.uniform(0, 1), i) for i in range(30)] + [("b", 0.0, 0.0, 1), ("b", 0.5, 0.5, 2)]
    df = spark.createDataFrame(points, "customer_id string, lat double, lon double, visits int")
    got = defaultdict(list)
    for r in ranking.nearest_points_k(df, df, 5, keep=["visits"], **limits).sort("rank").collect():
        got[(r["customer_id"], r["lat"], r["lon"])].append((r["near_lat"], r["near_lon"], r["visits"]))
    for c, x, y, _ in points:
        order = sorted(((p[1] - x) ** 2 + (p[2] - y) ** 2, p[1], p[2], p[3]) for p in points if p[0] == c)
        assert got[(c, x, y)] == [o[1:] for o in order[:5]]


def test_most_visited_other_point(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 5), ("a", 2.0, 1.0, 3), ("a", 0.0, 1.0, 3), ("b", 1.0, 1.0, 1)],
                               "customer_id string, lat double, lon double, visits int")
    got = {(r["customer_id"], r["lat"]): r["top_lat"] for r in ranking.most_visited_point(df).collect()}
    assert got == {("a", 1.0): 0.0, ("a", 2.0): 1.0, ("a", 0.0): 1.0}


def test_spectrum_of_a_point(spark):
    line = spark.createDataFrame([("a", float(i), 0.0, i + 1) for i in range(6)], "customer_id string, lat double, lon double, visits int")
    row = spectrum.point_spectrum(line.filter("lat = 0"), line).first()
    assert [row[c] for c in spectrum.STEP_NAMES] == [1.0] * 4
    assert [row[c] for c in spectrum.SHARE_NAMES] == pytest.approx([i / 21 for i in range(1, 6)])


def test_standardize_leaves_constant_columns_centred(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "a double, b double")
    assert sorted(map(tuple, spectrum.standardize(df, ["a", "b"]).collect())) == [(-1.0, 0.0), (1.0, 0.0)]


def brute_counts(test, train, least):
    out = {}
    for x, xs in test.items():
        for y, ys in train.items():
            if len(xs & ys) >= least:
                out[(x, y)] = len(xs & ys)
    return out


@pytest.mark.parametrize("least", [1, 2, 4])
def test_shared_counts_find_all_pairs(spark, least):
    rnd = random.Random(least)
    # Three places that nearly everybody visits, and many that few do.
    pick = lambda: {(float(p), 0.0) for p in rnd.sample(range(1, 4), rnd.randint(1, 3)) + rnd.sample(range(10, 40), rnd.randint(2, 12))}
    test, train = {f"t{i}": pick() for i in range(40)}, {f"k{i}": pick() for i in range(40)}
    visits = spark.createDataFrame([(c, *p) for c, ps in test.items() for p in ps], "customer_id string, lat double, lon double")
    known = spark.createDataFrame([(c, *p) for c, ps in train.items() for p in ps], "customer_id string, lat double, lon double")
    got = {(r[0], r[1]): r[2] for r in propagate.shared_counts(visits, known, least)
           .select("test_customer_id", "train_customer_id", "shared").collect()}
    assert got == brute_counts(test, train, least)


def test_propagation_takes_several_rounds(spark):
    points = lambda first: [(float(first + i), 1.0) for i in range(4)]
    train = spark.createDataFrame([("k", *p, 50.0, 30.0) for p in points(1)], "customer_id string, lat double, lon double, home_lat double, home_lon double")
    # t1 covers all points of k; t2 covers all points of t1 but not of k alone.
    chain = {"t1": points(1) + points(11), "t2": points(11) + points(1) + points(21), "t3": points(90)}
    test = spark.createDataFrame([(c, *p) for c, ps in chain.items() for p in ps], "customer_id string, lat double, lon double")
    got = {r["customer_id"]: (r["target_lat"], r["target_lon"]) for r in propagate.propagate_targets(train, test, "home").collect()}
    assert got == {"k": (50.0, 30.0), "t1": (50.0, 30.0), "t2": (50.0, 30.0)}


def test_characteristic_points_need_most_visitors_in_one_place(spark):
    rows = []
    for i in range(10):  # nine of ten live together
        rows.append((f"a{i}", 1.0, 1.0, 50.0 + (0.001 * i if i < 9 else 1.0), 30.0))
    for i in range(10):  # eight of ten
        rows.append((f"b{i}", 2.0, 1.0, 50.0 + (0.001 * i if i < 8 else float(i)), 30.0))
    rows += [("a0", 1.0, 1.0, 50.0, 30.0), ("z", 3.0, 1.0, None, None)]
    train = spark.createDataFrame(rows, "customer_id string, lat double, lon double, home_lat double, home_lon double")
    got = {(r["lat"], r["customer_id"]) for r in propagate.characteristic_points(train, "home").collect()}
    assert got == {(1.0, f"a{i}") for i in range(9)}


def test_hot_customer_and_hot_place(spark):
    """A third of all rows in one customer, most of them at one place, must not change any result."""
    rnd = random.Random(4)
    rows = [("hot", 55.0, 37.0)] * 3000 + [("hot", 55 + rnd.random() / 50, 37 + rnd.random() / 50) for _ in range(600)]
    rows += [(f"c{i % 50}", 55 + rnd.random() / 10, 37 + rnd.random() / 10) for i in range(3000)]
    df = spark.createDataFrame(rows, "customer_id string, lat double, lon double").repartition(4)
    from waymark.operators.density import cluster_points
    from waymark.operators.radius import near_point_count, pair_distance_sum

    points = sorted({r[1:] for r in rows if r[0] == "hot"})
    clusters = cluster_points(df, 0.02).filter("customer_id = 'hot'").select("cluster_id").distinct().count()
    assert clusters == 1
    counts = {(r["lat"], r["lon"]): r["near_count"] for r in near_point_count(df, 0.02).filter("customer_id = 'hot'").collect()}
    assert counts == {p: sum(near(p, q, 0.02) for q in points) for p in points}
    total = pair_distance_sum(df.distinct(), ["customer_id"]).filter("customer_id = 'hot'").first()["distance_sum"]
    assert total == pytest.approx(sum(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5 for p in points for q in points))


def test_buildings_with_a_negative_number_of_flats_count_down(spark):
    from waymark.operators.surroundings import cluster_apartment_units

    clustered = spark.createDataFrame([(1, 7, 0.0, 0.0), (1, 7, 0.0, 0.01)], "customer_id long, cluster_id long, lat double, lon double")
    apartments = spark.createDataFrame([(1, 0.0, 0.001, 10), (2, 0.001, 0.0, -3), (3, 0.0, 0.011, -8), (4, 5.0, 5.0, 100)],
                                       "apartment_id long, lat double, lon double, units int")
    assert [tuple(r) for r in cluster_apartment_units(clustered, apartments, 0.02).collect()] == [(1, 7, -1)]


def test_the_split_rounds_its_fraction(spark):
    from waymark.operators.ranking import portable_hash, split_train_test

    df = spark.range(20_000).withColumnRenamed("id", "customer_id")
    draw = F.pmod(portable_hash(0, F.col("customer_id")), F.lit(1000))
    assert split_train_test(df, 0.57).filter((draw == 569) & ~F.col("is_training")).count() == 0


def test_lookup_join_does_not_shuffle_the_big_side(spark):
    from waymark.operators.lookups import lookup_join

    codes = spark.range(1000).groupBy((F.col("id") % 50).alias("code")).agg(F.sum("id").alias("value"))
    big = spark.range(1000).withColumn("code", F.col("id") % 60)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_join(big, codes, "code", "value", -1)
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.filter("value = -1").count() == 160
        assert lookup_join(big, codes, "code", "value", -1, broadcast_rows=10).filter("value = -1").count() == 160
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rounds_that_look_at_changes_only_equal_full_rounds(spark):
    """Random customers of three homes who share places, one of them hot, against rounds in plain Python."""
    rnd = random.Random(12)
    homes = {c: (50.0 + i, 30.0) for i, c in enumerate("abc")}
    places = {c: [(float(i), float(j)) for j in range(14)] for i, c in enumerate("abc")}

    def visited(c):
        mine = rnd.sample(places[c], rnd.randint(4, 7))
        return {*mine, (9.0, 9.0), *([rnd.choice(places[rnd.choice("abc")])] if rnd.random() < 0.3 else [])}

    kinds = {f"k{i}": rnd.choice("abc") for i in range(6)} | {f"t{i:02d}": rnd.choice("abc") for i in range(40)}
    visits = {c: visited(kind) for c, kind in kinds.items()}
    train = spark.createDataFrame([(c, *p, *homes[kinds[c]]) for c, ps in visits.items() if c[0] == "k" for p in ps],
                                  "customer_id string, lat double, lon double, home_lat double, home_lon double")
    test = spark.createDataFrame([(c, *p) for c, ps in visits.items() if c[0] == "t" for p in ps], "customer_id string, lat double, lon double")
    got = {r[0]: (r[1], r[2]) for r in propagate.propagate_targets(train, test, "home", share=0.5).collect()}
    want, rounds = {c: k for c, k in kinds.items() if c[0] == "k"}, 0
    while True:
        visitors = defaultdict(list)
        for c in want:
            for p in visits[c]:
                visitors[p].append(c)
        own = defaultdict(set)
        for p, cs in visitors.items():
            # Homes lie far apart, so a cluster is all visitors of one home.
            home, n = Counter(want[c] for c in cs).most_common(1)[0]
            if n >= 0.9 * len(cs):
                for c in cs:
                    if want[c] == home:
                        own[c].add(p)
        found = {}
        for c in kinds.keys() - want.keys():
            shared = min(((-len(own[k] & visits[c]), k) for k in own), default=(0, None))
            if -shared[0] >= 4 and -shared[0] >= 0.5 * len(own[shared[1]]):
                found[c] = want[shared[1]]
        if not found:
            break
        rounds += 1
        want |= found
    assert rounds >= 2 and got == {c: homes[k] for c, k in want.items()}


def test_customers_at_the_same_hot_places_are_matched_as_one(spark):
    hot = [(float(i), 1.0) for i in range(1, 7)]
    train = [(f"k{i:03d}", *p, 50.0, 30.0 + i / 1e6) for i in range(150) for p in hot]
    train += [(f"z{i}", float(j), 2.0, 50.0, 30.0) for i in range(3) for j in range(1, 6)]
    test = [(f"t{i:03d}", *p) for i in range(150) for p in hot] + [(f"u{i}", float(j), 2.0) for i in range(3) for j in range(1, 5 + i)] + [("v", 1.0, 1.0)]
    known = spark.createDataFrame(train, "customer_id string, lat double, lon double, target_lat double, target_lon double")
    asked = spark.createDataFrame(test, "customer_id string, lat double, lon double")
    firsts = {r[0]: r[1] for r in propagate.merged_sets(asked, "customer_id").collect()}
    assert {firsts[f"t{i:03d}"] for i in range(150)} == {"t000"} and [firsts[f"u{i}"] for i in range(3)] == ["u0", "u1", "u2"]
    got = {r["customer_id"]: tuple(r)[1:] for r in propagate.match_by_shared_points(asked, known).collect()}
    assert got == {f"t{i:03d}": ("k000", 6, 50.0, 30.0) for i in range(150)} | {"u1": ("z0", 5, 50.0, 30.0), "u2": ("z0", 5, 50.0, 30.0)}


def test_unvisited_weight_with_very_many_categories(spark):
    """Ten thousand codes near one place: the work grows with their number, not with its square."""
    n = 10_000
    weights = [(1.0, 1.0, i, 1.0 / (1 + i % 7)) for i in range(n)] + [(2.0, 2.0, 5, 0.5)]
    used = {"a": list(range(0, n, 2)), "b": [], "c": list(range(n)), "d": [5, 5, None, n + 1]}
    rows = [(c, 1.0, 1.0, codes) for c, codes in used.items()] + [("a", 2.0, 2.0, [5]), ("b", 2.0, 2.0, [6]), ("b", 3.0, 3.0, [6]), ("e", 1.0, 1.0, [])]
    rows += [(f"x{i}", 1.0, 1.0, list(range(i, n, 3))) for i in range(60)]
    got = {(r["customer_id"], r["lat"]): r["unvisited_shop_weight"] for r in surroundings.unvisited_shop_weight(
        spark.createDataFrame(rows, "customer_id string, lat double, lon double, near_mccs array<int>"),
        spark.createDataFrame(weights, "lat double, lon double, mcc int, weight double")).collect()}
    for c, lat, _, codes in rows:
        assert got[(c, lat)] == pytest.approx(sum(w for y, _, m, w in weights if y == lat and m not in set(codes)))
    assert len(got) == len(rows)
