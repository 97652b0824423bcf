"""Known places handed on between customers who share characteristic points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark import fixed
from waymark.materialize import Written, cut_lineage
from waymark.operators.density import dbscan
from waymark.operators.lookups import exclude_defined, keep_defined, shared_point_join, target_point

POINT = ["lat", "lon"]


def known_visits(train: DataFrame, target: str) -> DataFrame:
    """One row per place and train customer with the customer's known target."""
    t_lat, t_lon = target_point(target)
    best = F.min(F.struct(t_lat.alias("t_lat"), t_lon.alias("t_lon"))).alias("_t")
    return train.filter(t_lat > 0).groupBy(*POINT, "customer_id").agg(best).select(
        *POINT, "customer_id", F.col("_t.t_lat").alias("target_lat"), F.col("_t.t_lon").alias("target_lon")
    )


def characteristic_points(train: DataFrame, target: str, share: float = fixed.SHARED_POINT_SHARE,
                          radius: float = fixed.RADIUS) -> DataFrame:
    """(lat, lon, customer_id, target_lat, target_lon): places whose visitors live close together.

    The targets of the visitors of a place are clustered; the place stays, with the customers of
    its largest cluster, when that holds at least `share` of them. Among equal clusters the one with the smaller id counts.
    """
    return _characteristic(cut_lineage(known_visits(train, target)), share, radius)


def _characteristic(visits: DataFrame, share: float, radius: float = fixed.RADIUS) -> DataFrame:
    """`characteristic_points` of what `known_visits` returns. Places don't depend on each other."""
    named = visits.withColumnsRenamed({"lat": "p_lat", "lon": "p_lon", "target_lat": "lat", "target_lon": "lon"})
    sizes = named.groupBy("p_lat", "p_lon").agg(F.count(F.lit(1)).alias("_n"))
    # The number of visitors decides on the minimum; equal targets are merged first, with their number.
    merged = named.groupBy("p_lat", "p_lon", *POINT).agg(F.count(F.lit(1)).alias("_w")).join(sizes, ["p_lat", "p_lon"])
    merged = merged.withColumn("_least", F.least(F.lit(fixed.CHARACTERISTIC_MIN_POINTS), F.col("_n")))
    clusters = cut_lineage(dbscan(merged, radius, "_least", by=["p_lat", "p_lon"], weight="_w").filter("role <> 'noise'"))
    largest = (
        clusters.groupBy("p_lat", "p_lon", "cluster_id").agg(F.sum("weight").alias("_size"))
        .groupBy("p_lat", "p_lon").agg(F.min(F.struct((-F.col("_size")).alias("_s"), "cluster_id")).alias("_best"))
        .join(sizes, ["p_lat", "p_lon"])
        .filter(-F.col("_best._s") / F.col("_n") >= share)
        .select("p_lat", "p_lon", F.col("_best.cluster_id").alias("cluster_id"))
    )
    members = clusters.join(largest, ["p_lat", "p_lon", "cluster_id"], "left_semi").select("p_lat", "p_lon", *POINT)
    return named.join(members, ["p_lat", "p_lon", *POINT], "left_semi").select(
        F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), "customer_id",
        F.col("lat").alias("target_lat"), F.col("lon").alias("target_lon"),
    )


def _without_commonest(rows: DataFrame, owner: str, frequency: DataFrame, n: int) -> DataFrame:
    """Rows of each owner without its n commonest places."""
    if n <= 0:
        return rows
    order = Window.partitionBy(owner).orderBy(F.desc("_freq"), F.desc("lat"), F.desc("lon"))
    common = (
        rows.join(frequency, POINT).withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= n).select(owner, *POINT)
    )
    return rows.join(common, [owner, *POINT], "left_anti")


def candidate_pairs(test_points: DataFrame, train_points: DataFrame, min_points: int) -> DataFrame:
    """Pairs of customers that may share `min_points` places: all that do, and few others.

    Two customers with t places in common still have one in common after each drops its t - 1
    commonest, in one order for all. So the places that a large part of the customers visits make
    no pairs, unless a customer has nothing else.
    """
    frequency = (
        test_points.select(*POINT).unionByName(train_points.select(*POINT))
        .groupBy(*POINT).agg(F.count(F.lit(1)).alias("_freq"))
    )
    left = _without_commonest(test_points, "test_customer_id", frequency, min_points - 1)
    right = _without_commonest(train_points, "train_customer_id", frequency, min_points - 1)
    return left.join(right, POINT).select("test_customer_id", "train_customer_id").distinct()


def _visited(test: DataFrame, characteristic: DataFrame) -> DataFrame:
    """(test_customer_id, lat, lon): the characteristic places that test customers visit."""
    return shared_point_join(test, characteristic.select(*POINT).distinct()).select("test_customer_id", *POINT)


def shared_counts(test: DataFrame, characteristic: DataFrame, min_points: int) -> DataFrame:
    """(test_customer_id, train_customer_id, shared) of all pairs with at least `min_points` common places."""
    train_points = characteristic.select(F.col("customer_id").alias("train_customer_id"), *POINT)
    return _pair_counts(cut_lineage(_visited(test, characteristic)), train_points, min_points)


def _pair_counts(test_points: DataFrame, train_points: DataFrame, min_points: int) -> DataFrame:
    """`shared_counts` of the places of both sides.

    Of each candidate pair the customer with fewer places is expanded, and its places are looked up among the other's.
    """
    def rich(rows, owner, name):
        sizes = rows.groupBy(owner).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) >= min_points)
        return rows.join(sizes.select(owner), owner, "left_semi"), sizes

    test, train = "test_customer_id", "train_customer_id"
    (test_points, test_sizes), (train_points, train_sizes) = rich(test_points, test, "_n_test"), rich(train_points, train, "_n_train")
    pairs = candidate_pairs(test_points, train_points, min_points).join(test_sizes, test).join(train_sizes, train)
    smaller = F.col("_n_test") <= F.col("_n_train")
    from_test = pairs.filter(smaller).select(test, train).join(test_points, test).join(train_points, [train, *POINT], "left_semi")
    from_train = pairs.filter(~smaller).select(test, train).join(train_points, train).join(test_points, [test, *POINT], "left_semi")
    return (
        from_test.select(test, train).unionByName(from_train.select(test, train))
        .groupBy(test, train).agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= min_points)
    )


def merged_sets(points: DataFrame, owner: str) -> DataFrame:
    """(owner, _first): for each owner the smallest one with the same set of places.

    Sets are told apart by their size and two sums of hashes that don't depend on the order, 128 bits in all, so that no set is collected.
    """
    place = F.xxhash64(*POINT).cast("decimal(20,0)")
    same = ["_n", "_sum", "_xor"]
    known = points.groupBy(owner).agg(F.count(F.lit(1)).alias("_n"), F.sum(place).alias("_sum"), F.bit_xor(F.xxhash64(F.lit("set"), *POINT)).alias("_xor"))
    return known.join(known.groupBy(*same).agg(F.min(owner).alias("_first")), same).select(owner, "_first")


def match_by_shared_points(test: DataFrame, characteristic: DataFrame, share: float = fixed.SHARED_CUSTOMER_SHARE,
                           min_points: int = fixed.SHARED_MIN_POINTS) -> DataFrame:
    """(customer_id, train_customer_id, shared, target_lat, target_lon) of the test customers that match.

    Each takes the train customer with most common places, the smaller id on ties. The match counts
    when there are at least `min_points` of them and they are `share` of that customer's own characteristic points.
    Pairs below `min_points` can neither count nor beat one that does, so they are not formed. Customers with the same
    set of places are one: on the train side the one with the smallest id, which wins the ties, on the test side all get one match.
    """
    own = characteristic.groupBy(F.col("customer_id").alias("train_customer_id")).agg(
        F.count(F.lit(1)).alias("_own"),
        F.min(F.struct("target_lat", "target_lon")).alias("_target"),
    )
    visited = cut_lineage(_visited(test, characteristic))
    members = cut_lineage(merged_sets(visited, "test_customer_id"))
    firsts = merged_sets(characteristic, "customer_id").filter("customer_id = _first").select("customer_id")
    test_points = visited.join(members.filter("test_customer_id = _first").select("test_customer_id"), "test_customer_id", "left_semi")
    train_points = characteristic.join(firsts, "customer_id", "left_semi").select(F.col("customer_id").alias("train_customer_id"), *POINT)
    best = (
        _pair_counts(test_points, train_points, min_points).groupBy(F.col("test_customer_id").alias("_first"))
        .agg(F.min(F.struct((-F.col("shared")).alias("_s"), "train_customer_id")).alias("_best"))
        .select("_first", "_best.train_customer_id", (-F.col("_best._s")).alias("shared"))
    )
    matched = best.join(own, "train_customer_id").filter(F.col("shared") / F.col("_own") >= share)
    return members.join(matched, "_first").select(
        F.col("test_customer_id").alias("customer_id"), "train_customer_id", "shared", "_target.target_lat", "_target.target_lon")


def propagate_targets(train: DataFrame, test: DataFrame, target: str, point_share: float = fixed.SHARED_POINT_SHARE,
                      share: float = fixed.SHARED_CUSTOMER_SHARE, min_points: int = fixed.SHARED_MIN_POINTS) -> DataFrame:
    """(customer_id, target_lat, target_lon) of all train customers and of the test customers resolved.

    Resolved customers join the train side until a round resolves none. Every round resolves at least one, so this ends.
    Only places and targets are carried, not transactions. A round clusters only the places that the customers of the
    round before visit, and matches only test customers who share a characteristic place with a customer whose
    characteristic places may have changed: for all others the last answer holds.
    """
    t_lat, t_lon = target_point(target)
    pick = F.min(F.struct(t_lat.alias("target_lat"), t_lon.alias("target_lon"))).alias("_t")
    resolved = train.groupBy("customer_id").agg(pick).select("customer_id", "_t.target_lat", "_t.target_lon")
    visits = Written(known_visits(train, target))
    open_rows = Written(test.select("customer_id", *POINT).distinct())
    characteristic = Written(_characteristic(visits.df, point_share))
    asked = open_rows.df
    while True:
        found = cut_lineage(match_by_shared_points(asked, characteristic.df, share, min_points).select("customer_id", "target_lat", "target_lon"))
        if found.isEmpty():
            return resolved
        resolved = resolved.unionByName(found)
        gained = Written(keep_defined(open_rows.df, found).join(found.filter("target_lat > 0"), "customer_id"))
        touched = Written(gained.df.select(*POINT).distinct())
        more, left = Written(visits.df.unionByName(gained.df)), Written(exclude_defined(open_rows.df, found))
        renewed = Written(_characteristic(more.df.join(touched.df, POINT, "left_semi"), point_share))
        before = characteristic.df.join(touched.df, POINT, "left_semi")
        current = Written(characteristic.df.join(touched.df, POINT, "left_anti").unionByName(renewed.df))
        # Whoever gained or lost a characteristic place, with all places they have or had.
        changed = before.select("customer_id").unionByName(renewed.df.select("customer_id")).distinct()
        places = current.df.unionByName(before).join(changed, "customer_id", "left_semi").select(*POINT).distinct()
        again = left.df.join(places, POINT, "left_semi").select("customer_id").distinct()
        asked = cut_lineage(left.df.join(again, "customer_id", "left_semi"))
        for old in (visits, open_rows, characteristic, gained, touched, renewed):
            old.drop()
        visits, open_rows, characteristic = more, left, current


def characteristic_home_work(train: DataFrame, test: DataFrame) -> DataFrame:
    """(customer_id, home_lat, home_lon, work_lat, work_lon) after both propagations."""
    def named(target):
        return propagate_targets(train, test, target).withColumnsRenamed(
            {"target_lat": f"{target}_lat", "target_lon": f"{target}_lon"}
        )
    return named("home").join(named("work"), "customer_id", "full")
