"""Features of customer points and of their clusters.

The transactions are read once, into one row per customer and place; everything later works on that much
smaller table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions import calendar, geo
from waymark.materialize import Packed, packed
from waymark.operators import surroundings
from waymark.operators.density import cluster_points
from waymark.operators.lookups import target_point
from waymark.operators.radius import near_point_count, pair_distance_sums

PLACE = ["customer_id", "lat", "lon"]
CLUSTER = ["customer_id", "cluster_id"]
HOLIDAY_NAMES = [f"holiday_{k}" for k in range(fixed.HOLIDAY_BUCKETS)]
WEEKDAY_NAMES = [f"weekday_{k}" for k in range(7)]
POINT_NUMBERS = [
    "visit_ratio", "density", "near_count", "apartments_percent", "date_ratio", "duration", "unvisited_shop_weight",
    *HOLIDAY_NAMES, *WEEKDAY_NAMES,
]
CLUSTER_NUMBERS = [
    "cluster_points", "cluster_duration", "cluster_date_ratio", "cluster_avg_near", "cluster_weekend_share",
    "cluster_weekday_share", "cluster_avg_distance",
]


def holiday_counts() -> list:
    bucket = calendar.holiday_bucket(F.col("date"))
    return [F.count_if(bucket == k).alias(name) for k, name in enumerate(HOLIDAY_NAMES)]


def weekday_counts() -> list:
    day = calendar.weekday_index(F.col("date"))
    return [F.count_if(day == k).alias(name) for k, name in enumerate(WEEKDAY_NAMES)]


def point_table(tx: DataFrame, target: str | None = None, targets: Sequence[str] = ()) -> DataFrame:
    """One row per customer and place: counts, dates, categories, first currency and country.

    With a `target` also its known point as `target_lat` and `target_lon`, and for each of `targets` the known point under
    its own name. "First" is by date, then by value. The categories of a place are at most the list of category codes.
    """
    none = F.lit(None).cast("double")
    lat, lon = target_point(target) if target else (none, none)

    def known(name):
        own_lat, own_lon = target_point(name)
        return F.min(F.struct(own_lat.alias(f"{name}_lat"), own_lon.alias(f"{name}_lon"))).alias(f"_{name}")

    table = tx.groupBy(*PLACE).agg(
        F.count(F.lit(1)).alias("n_tx"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.collect_set("mcc").alias("mccs"),
        F.min(F.struct("date", "currency")).alias("first_currency"),
        F.min(F.struct("date", "country")).alias("first_country"),
        F.min(F.struct(lat.alias("target_lat"), lon.alias("target_lon"))).alias("_target"),
        *[known(name) for name in targets],
        *holiday_counts(), *weekday_counts(),
    )
    points = ["_target", *[f"_{name}" for name in targets]]
    return table.select("*", *[f"{p}.*" for p in points]).drop(*points)


def keep_near_known(visits: DataFrame, radius: float = fixed.KEEP_RADIUS) -> DataFrame:
    """The filter by distance to the target, on the point table."""
    near = geo.within_radius(F.col("lat"), F.col("lon"), F.col("target_lat"), F.col("target_lon"), radius)
    kept = visits.filter(near | F.col("target_lat").isNull()).select("customer_id").distinct()
    return visits.join(kept, "customer_id", "left_semi")


def label_radius(visits: DataFrame, adaptive: bool = False) -> DataFrame:
    """Add `label_radius`: 0.02, or with `adaptive` the customer's own smallest distance where larger."""
    if not adaptive:
        return visits.withColumn("label_radius", F.lit(fixed.RADIUS))
    apart = geo.distance(F.col("lat"), F.col("lon"), F.col("target_lat"), F.col("target_lon"))
    least = visits.groupBy("customer_id").agg(F.greatest(F.min(apart), F.lit(fixed.RADIUS)).alias("label_radius"))
    return visits.join(least, "customer_id").withColumn("label_radius", F.coalesce("label_radius", F.lit(fixed.RADIUS)))


def point_label():
    near = geo.within_radius(
        F.col("lat"), F.col("lon"), F.col("target_lat"), F.col("target_lon"), F.col("label_radius")
    )
    return F.when(near, 1.0).otherwise(0.0)


def clustered_points(tx: DataFrame, target: str | None = None, radius: float = fixed.RADIUS,
                     adaptive: bool = False) -> DataFrame:
    """Point table of the kept customers, with cluster, number of near points and label. Stored.

    The point table is stored before anyone is left out, as it is read twice for that.
    """
    table = Packed(point_table(tx, target))
    visits = Packed(label_radius(keep_near_known(table.df), adaptive))
    table.drop()
    clustered = packed(_clustered(visits.df, radius).withColumn("label", point_label()).drop("label_radius"))
    visits.drop()
    return clustered


def _clustered(visits: DataFrame, radius: float) -> DataFrame:
    return visits.join(cluster_points(visits, radius), PLACE).join(near_point_count(visits, radius), PLACE)


def cluster_features(clustered: DataFrame) -> DataFrame:
    """One row per cluster, all from the point table; `density_sum` is the distance over all ordered pairs of its transactions."""
    days = [F.sum(n) for n in WEEKDAY_NAMES]
    n_tx = F.sum("n_tx")
    first, last = F.min("first_date"), F.max("last_date")
    numbers = clustered.groupBy(*CLUSTER).agg(
        n_tx.alias("cluster_n_tx"),
        F.count(F.lit(1)).alias("cluster_points"),
        F.datediff(last, first).alias("cluster_duration"),
        calendar.date_ratio(first, last, n_tx).alias("cluster_date_ratio"),
        F.avg("near_count").alias("cluster_avg_near"),
        ((days[5] + days[6]) / n_tx).alias("cluster_weekend_share"),
        (sum(days[1:5], days[0]) / n_tx).alias("cluster_weekday_share"),
        F.min("first_country").alias("_country"),
        F.max("label").alias("cluster_label"),
    )
    apart = pair_distance_sums(clustered, CLUSTER, {"_apart": None, "density_sum": "n_tx"})
    return (
        numbers.join(apart, CLUSTER)
        .withColumn("cluster_avg_distance",
                    F.when(F.col("cluster_points") > 1, 10 - F.col("_apart") / F.col("cluster_points")).otherwise(0.0))
        .withColumn("country", F.col("_country.country"))
        .drop("_country", "_apart")
    )


@dataclass
class Surroundings:
    """What the features need to know about all places, whoever visits them."""

    apartments: DataFrame
    shops: DataFrame


def point_features(clustered: DataFrame, around: Surroundings, clusters: DataFrame,
                   radius: float = fixed.RADIUS) -> DataFrame:
    """One row per customer and place, stored; `clusters` is what `cluster_features` returns.

    Each part is a table of its own: as one plan of seventy stages, planned anew after every stage, they filled the driver.
    The parts go when they are put together.
    """
    places = Packed(clustered.select("lat", "lon").distinct())
    units = Packed(surroundings.district_apartment_units(places.df, around.apartments, radius))
    cluster_units = Packed(surroundings.cluster_apartment_units(clustered, around.apartments, radius))
    weights = Packed(surroundings.shop_weights_near(places.df, around.shops, radius))
    unvisited = Packed(surroundings.unvisited_shop_weight(surroundings.near_mccs(clustered, radius), weights.df))
    part = F.when(F.coalesce("cluster_units", F.lit(0)) == 0, 0.0).otherwise(F.col("units") / F.col("cluster_units"))
    # Joins by place and by cluster move all rows, so each is a job of its own, whose shuffles go before the next.
    by_place = Packed(clustered.join(units.df, ["lat", "lon"]).join(unvisited.df, PLACE))
    unvisited.drop()
    points = packed(
        by_place.df.join(clusters.select(*CLUSTER, "cluster_n_tx", "density_sum").join(cluster_units.df, CLUSTER, "left"), CLUSTER)
        .select(
            *PLACE, "cluster_id", "label", "mccs",
            F.col("first_currency.currency").alias("currency"),
            (F.col("n_tx") / F.col("cluster_n_tx")).alias("visit_ratio"),
            (F.col("density_sum") / F.col("near_count")).alias("density"),
            "near_count",
            part.alias("apartments_percent"),
            calendar.date_ratio(F.col("first_date"), F.col("last_date"), F.col("n_tx")).alias("date_ratio"),
            F.datediff("last_date", "first_date").alias("duration"),
            "unvisited_shop_weight", *HOLIDAY_NAMES, *WEEKDAY_NAMES,
        )
    )
    for table in (places, units, cluster_units, weights, by_place):
        table.drop()
    return points


def prepare_features(tx: DataFrame, around: Surroundings, target: str | None = None,
                     radius: float = fixed.RADIUS, adaptive: bool = False) -> DataFrame:
    """One row per customer and place: label, cluster features, point features. No vectors yet."""
    return _features(clustered_points(tx, target, radius, adaptive), around, radius)


def features_of_visits(visits: DataFrame, around: Surroundings, radius: float = fixed.RADIUS) -> DataFrame:
    """`prepare_features` without labels, from a stored point table. Every customer of the table is kept."""
    clustered = packed(_clustered(visits, radius).withColumn("label", F.lit(0.0)))
    return _features(clustered, around, radius).drop("label", "cluster_label")


def target_labels(visits: DataFrame, target: str, adaptive: bool = False) -> DataFrame:
    """(customer_id, lat, lon, label) for one of the `targets` of a point table.

    Only customers whose target is known and who have a place near it are kept. Their clusters and features are the same
    for every target, so only these labels need to be made anew.
    """
    lat, lon = target_point(target)
    known = visits.select(*PLACE, lat.alias("target_lat"), lon.alias("target_lon")).filter("target_lat is not null")
    return label_radius(keep_near_known(known), adaptive).select(*PLACE, point_label().alias("label"))


def _features(clustered: DataFrame, around: Surroundings, radius: float) -> DataFrame:
    clusters = packed(cluster_features(clustered))
    points = point_features(clustered, around, clusters, radius)
    return points.join(clusters.select(*CLUSTER, *CLUSTER_NUMBERS, "country", "cluster_label"), CLUSTER)


def _dictionary(values: DataFrame) -> list[str]:
    """A code list as text; these are short by nature and form the vector's layout."""
    return [str(r["value"]) for r in values.sort("idx").collect()]


def feature_vectors(countries: DataFrame, mccs: DataFrame, currencies: DataFrame) -> PipelineModel:
    """Cluster numbers, country, point numbers, categories and currency as one vector.

    A value outside a dictionary leaves its part of the vector zero.
    """
    def marks(column, dictionary):
        model = CountVectorizerModel.from_vocabulary(_dictionary(dictionary), f"_{column}_list", f"_{column}_marks")
        return model.setBinary(True)

    assembler = VectorAssembler(
        inputCols=[*CLUSTER_NUMBERS, "_country_marks", *POINT_NUMBERS, "_mccs_marks", "_currency_marks"],
        outputCol="features",
    )
    return PipelineModel([marks("country", countries), marks("mccs", mccs), marks("currency", currencies), assembler])


def with_vectors(features: DataFrame, model: PipelineModel) -> DataFrame:
    lists = features.withColumns({
        "_country_list": F.array(F.coalesce("country", F.lit(""))),
        "_mccs_list": F.transform("mccs", lambda m: m.cast("string")),
        "_currency_list": F.array(F.col("currency").cast("string")),
    })
    out = model.transform(lists)
    return out.drop(*[c for c in out.columns if c.startswith("_")])
