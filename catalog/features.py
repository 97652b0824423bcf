"""Features of places and clusters, for train customers and their homes."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog import relations, views
from catalog.registry import query
from catalog.views import near, sql
from waymark.materialize import cut_lineage, packed
from waymark.operators import surroundings
from waymark.operators.radius import near_point_count as count_near
from waymark.operators.radius import pair_distance_sums
from waymark.plans import features as P
from waymark.plans import predict

R = 0.02
PLACE, CLUSTER = ["customer_id", "lat", "lon"], ["customer_id", "cluster_id"]


def clustered(spark, sf_dir):
    return views.stored(spark, sf_dir, "clustered", lambda: P.clustered_points(views.train(spark, sf_dir), "home"))


def around(spark, sf_dir):
    train, test = views.train(spark, sf_dir), views.test(spark, sf_dir)
    shops = views.stored(spark, sf_dir, "shops", lambda: cut_lineage(
        surroundings.shop_index(train, test, surroundings.mcc_home_weights(train))))
    return P.Surroundings(views.apartments(spark, sf_dir), shops)


def cluster_table(spark, sf_dir):
    return views.stored(spark, sf_dir, "cluster_features", lambda: packed(P.cluster_features(clustered(spark, sf_dir))))


def point_table(spark, sf_dir):
    return views.stored(spark, sf_dir, "point_features", lambda: P.point_features(
        clustered(spark, sf_dir), around(spark, sf_dir), cluster_table(spark, sf_dir)))


def dictionaries(spark, sf_dir):
    made = relations._dictionaries(spark, sf_dir)
    return [made[c] for c in ("country", "mcc", "currency")]


def r6(column, name=None):
    return F.round(column, 6).alias(name or column)


# Points.

_BUCKET = """CASE WHEN dayofyear(date) BETWEEN 1 AND 8 THEN 0 WHEN dayofyear(date) BETWEEN 53 AND 57 THEN 1 WHEN dayofyear(date) = 67 THEN 2
WHEN dayofyear(date) BETWEEN 118 AND 121 THEN 3 WHEN dayofyear(date) BETWEEN 125 AND 129 THEN 4 WHEN dayofyear(date) BETWEEN 160 AND 163 THEN 5
WHEN dayofyear(date) BETWEEN 307 AND 310 THEN 6 ELSE -1 END"""
_HOLIDAYS = ", ".join(f"count(*) FILTER ({_BUCKET} = {k}) AS holiday_{k}" for k in range(8))
_WEEKDAYS = ", ".join(f"count(*) FILTER (isodow(date) = {k + 1}) AS weekday_{k}" for k in range(7))


@query(sql(f"SELECT customer_id, lat, lon, {_HOLIDAYS} FROM tx GROUP BY customer_id, lat, lon", "tx"))
def holiday_counts(spark, sf_dir):
    return views.tx(spark, sf_dir).groupBy(*PLACE).agg(*P.holiday_counts())


@query(sql(f"SELECT customer_id, lat, lon, {_WEEKDAYS} FROM tx GROUP BY customer_id, lat, lon", "tx"))
def weekday_counts(spark, sf_dir):
    return views.tx(spark, sf_dir).groupBy(*PLACE).agg(*P.weekday_counts())


def _marks(column):
    return F.array_join(F.transform(vector_to_array(column), lambda x: x.cast("int").cast("string")), "")


def _marked(spark, sf_dir, column):
    model = P.feature_vectors(*dictionaries(spark, sf_dir)).stages[{"country": 0, "mccs": 1, "currency": 2}[column]]
    points = P.point_table(views.tx(spark, sf_dir))
    lists = {"mccs": F.transform("mccs", lambda m: m.cast("string")),
             "currency": F.array(F.col("first_currency.currency").cast("string"))}
    marked = model.transform(points.select(*PLACE, lists[column].alias(f"_{column}_list")))
    return marked.select(*PLACE, _marks(F.col(f"_{column}_marks")).alias("marks"))


@query(sql("""SELECT p.customer_id, p.lat, p.lon, string_agg(CASE WHEN k.mcc IS NULL THEN '0' ELSE '1' END, '' ORDER BY d.mcc) AS marks
FROM (SELECT DISTINCT customer_id, lat, lon FROM tx) p CROSS JOIN (SELECT DISTINCT mcc FROM tx) d
LEFT JOIN (SELECT DISTINCT customer_id, lat, lon, mcc FROM tx) k
ON k.customer_id = p.customer_id AND k.lat = p.lat AND k.lon = p.lon AND k.mcc = d.mcc GROUP BY p.customer_id, p.lat, p.lon""", "tx"))
def mcc_multi_hot(spark, sf_dir):
    return _marked(spark, sf_dir, "mccs")


_FIRST_CURRENCY = """SELECT customer_id, lat, lon, currency FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, lat, lon ORDER BY date, currency) AS place
FROM tx) WHERE place = 1"""


@query(sql(f"""SELECT customer_id, lat, lon, CASE currency WHEN 643 THEN '100' WHEN 840 THEN '010' ELSE '001' END AS marks FROM ({_FIRST_CURRENCY})""", "tx"))
def currency_one_hot(spark, sf_dir):
    return _marked(spark, sf_dir, "currency")


@query(sql("""SELECT c.customer_id, c.cluster_id, string_agg(CASE WHEN d.country = c.country THEN '1' ELSE '0' END, '' ORDER BY d.country) AS marks
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, cluster_id ORDER BY date, country) AS place FROM cluster_tx) c
CROSS JOIN (SELECT DISTINCT country FROM tx) d WHERE place = 1 GROUP BY c.customer_id, c.cluster_id""", "cluster_tx"))
def country_one_hot(spark, sf_dir):
    model = P.feature_vectors(*dictionaries(spark, sf_dir)).stages[0]
    clusters = cluster_table(spark, sf_dir).select(*CLUSTER, F.array("country").alias("_country_list"))
    return model.transform(clusters).select(*CLUSTER, _marks(F.col("_country_marks")).alias("marks"))


@query(sql("""SELECT p.customer_id, p.lat, p.lon, round(CAST(p.n_tx AS DOUBLE) / cluster_n_tx, 6) AS visit_ratio
FROM points p JOIN cluster_totals t USING (customer_id, cluster_id)""", "points", "cluster_totals"))
def point_visit_ratio(spark, sf_dir):
    return point_table(spark, sf_dir).select(*PLACE, r6("visit_ratio"))


@query(sql(f"""SELECT a.customer_id, a.lat, a.lon, count(*) AS near_count FROM (SELECT DISTINCT customer_id, lat, lon FROM tx) a
JOIN (SELECT DISTINCT customer_id, lat, lon FROM tx) b ON a.customer_id = b.customer_id AND {near('a.lat', 'a.lon', 'b.lat', 'b.lon', R)}
GROUP BY a.customer_id, a.lat, a.lon""", "tx"))
def near_point_count(spark, sf_dir):
    from catalog.relations import all_places

    return count_near(all_places(spark, sf_dir), R)


_POINT_DATES = """SELECT customer_id, lat, lon, CAST(date_diff('day', d0, d1) AS INTEGER) AS duration,
CASE WHEN d1 > d0 THEN floor(CAST(date_diff('day', d0, d1) AS DOUBLE) / n_tx) ELSE 1.0::DOUBLE END AS date_ratio FROM places"""


@query(sql(f"SELECT customer_id, lat, lon, date_ratio FROM ({_POINT_DATES})", "places"))
def point_date_ratio(spark, sf_dir):
    return point_table(spark, sf_dir).select(*PLACE, "date_ratio")


@query(sql(f"SELECT customer_id, lat, lon, duration FROM ({_POINT_DATES})", "places"))
def point_duration(spark, sf_dir):
    return point_table(spark, sf_dir).select(*PLACE, "duration")


_PERCENT = """SELECT p.customer_id, p.lat, p.lon, round(CASE WHEN coalesce(c.cluster_units, 0) = 0 THEN 0.0
ELSE CAST(coalesce(u.units, 0) AS DOUBLE) / c.cluster_units END, 6) AS apartments_percent
FROM points p LEFT JOIN place_units u ON u.lat = p.lat AND u.lon = p.lon LEFT JOIN cluster_units c USING (customer_id, cluster_id)"""


@query(sql(_PERCENT, "points", "place_units", "cluster_units"))
def apartments_percent(spark, sf_dir):
    return point_table(spark, sf_dir).select(*PLACE, r6("apartments_percent"))


_DENSITY = """SELECT p.customer_id, p.lat, p.lon, round(c.tx_sum / n.near_count, 6) AS density
FROM points p JOIN cluster_pairs c USING (customer_id, cluster_id) JOIN near_counts n ON n.customer_id = p.customer_id AND n.lat = p.lat AND n.lon = p.lon"""


@query(sql(_DENSITY, "points", "cluster_pairs", "near_counts"))
def point_density(spark, sf_dir):
    return point_table(spark, sf_dir).select(*PLACE, r6("density"))


@query(sql("SELECT customer_id, lat, lon, round(unvisited_shop_weight, 6) AS unvisited_shop_weight FROM unvisited", "unvisited"))
def unvisited_shop_weight(spark, sf_dir):
    base, shops = clustered(spark, sf_dir), around(spark, sf_dir).shops
    weights = surroundings.shop_weights_near(base, shops)
    return surroundings.unvisited_shop_weight(surroundings.near_mccs(base), weights).select(*PLACE, r6("unvisited_shop_weight"))


_LABEL = f"CASE WHEN {near('lat', 'lon', 't_lat', 't_lon', R)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


@query(sql(f"SELECT customer_id, lat, lon, {_LABEL} AS label FROM places", "places"))
def point_label(spark, sf_dir):
    return clustered(spark, sf_dir).select(*PLACE, "label")


# Clusters.

@query(sql("SELECT customer_id, cluster_id, round(tx_sum, 6) AS tx_sum, round(point_sum, 6) AS point_sum FROM cluster_pairs", "cluster_pairs"))
def pairwise_within_group(spark, sf_dir):
    base = clustered(spark, sf_dir)
    return pair_distance_sums(base, CLUSTER, {"tx_sum": "n_tx", "point_sum": None}).select(*CLUSTER, r6("tx_sum"), r6("point_sum"))


@query(sql("SELECT customer_id, cluster_id, CAST(cluster_units AS BIGINT) AS cluster_units FROM cluster_units", "cluster_units"))
def cluster_apartment_units(spark, sf_dir):
    return surroundings.cluster_apartment_units(clustered(spark, sf_dir), views.apartments(spark, sf_dir))


@query(sql("SELECT customer_id, cluster_id, cluster_points FROM cluster_totals", "cluster_totals"))
def cluster_point_count(spark, sf_dir):
    return cluster_table(spark, sf_dir).select(*CLUSTER, "cluster_points")


_CLUSTER_DATES = """SELECT customer_id, cluster_id, CAST(date_diff('day', d0, d1) AS INTEGER) AS cluster_duration,
CASE WHEN d1 > d0 THEN floor(CAST(date_diff('day', d0, d1) AS DOUBLE) / cluster_n_tx) ELSE 1.0::DOUBLE END AS cluster_date_ratio FROM cluster_totals"""


@query(sql(f"SELECT customer_id, cluster_id, cluster_date_ratio FROM ({_CLUSTER_DATES})", "cluster_totals"))
def cluster_date_ratio(spark, sf_dir):
    return cluster_table(spark, sf_dir).select(*CLUSTER, "cluster_date_ratio")


@query(sql(f"SELECT customer_id, cluster_id, cluster_duration FROM ({_CLUSTER_DATES})", "cluster_totals"))
def cluster_duration(spark, sf_dir):
    return cluster_table(spark, sf_dir).select(*CLUSTER, "cluster_duration")


_AVG_NEAR = """SELECT customer_id, cluster_id, round(avg(near_count), 6) AS cluster_avg_near FROM points
JOIN near_counts USING (customer_id, lat, lon) GROUP BY customer_id, cluster_id"""


@query(sql(_AVG_NEAR, "points", "near_counts"))
def cluster_avg_near(spark, sf_dir):
    return cluster_table(spark, sf_dir).select(*CLUSTER, r6("cluster_avg_near"))


_SHARES = """SELECT customer_id, cluster_id, round(avg(CASE WHEN isodow(date) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS cluster_weekend_share,
round(avg(CASE WHEN isodow(date) <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS cluster_weekday_share FROM cluster_tx GROUP BY customer_id, cluster_id"""


@query(sql(f"SELECT customer_id, cluster_id, cluster_weekend_share FROM ({_SHARES})", "cluster_tx"))
def cluster_weekend_share(spark, sf_dir):
    return cluster_table(spark, sf_dir).select(*CLUSTER, r6("cluster_weekend_share"))


@query(sql(f"SELECT customer_id, cluster_id, cluster_weekday_share FROM ({_SHARES})", "cluster_tx"))
def cluster_weekday_share(spark, sf_dir):
    return cluster_table(spark, sf_dir).select(*CLUSTER, r6("cluster_weekday_share"))


_AVG_DISTANCE = """SELECT customer_id, cluster_id, round(CASE WHEN cluster_points > 1 THEN 10 - point_sum / cluster_points ELSE 0.0 END, 6) AS cluster_avg_distance
FROM cluster_totals JOIN cluster_pairs USING (customer_id, cluster_id)"""


@query(sql(_AVG_DISTANCE, "cluster_totals", "cluster_pairs"))
def cluster_avg_distance(spark, sf_dir):
    return cluster_table(spark, sf_dir).select(*CLUSTER, r6("cluster_avg_distance"))


_CLUSTER_LABEL = f"SELECT customer_id, cluster_id, max({_LABEL}) AS cluster_label FROM points GROUP BY customer_id, cluster_id"


@query(sql(_CLUSTER_LABEL, "points"))
def cluster_label(spark, sf_dir):
    return cluster_table(spark, sf_dir).select(*CLUSTER, "cluster_label")


_COUNTRY = """SELECT customer_id, cluster_id, country FROM (SELECT customer_id, cluster_id, country,
row_number() OVER (PARTITION BY customer_id, cluster_id ORDER BY date, country) AS place FROM cluster_tx) WHERE place = 1"""
_CLUSTER_ALL = f"""SELECT t.customer_id, t.cluster_id, t.cluster_points, d.cluster_duration, d.cluster_date_ratio, n.cluster_avg_near,
s.cluster_weekend_share, s.cluster_weekday_share, a.cluster_avg_distance, c.country, l.cluster_label
FROM cluster_totals t JOIN ({_CLUSTER_DATES}) d USING (customer_id, cluster_id) JOIN ({_AVG_NEAR}) n USING (customer_id, cluster_id)
JOIN ({_SHARES}) s USING (customer_id, cluster_id) JOIN ({_AVG_DISTANCE}) a USING (customer_id, cluster_id)
JOIN ({_COUNTRY}) c USING (customer_id, cluster_id) JOIN ({_CLUSTER_LABEL}) l USING (customer_id, cluster_id)"""
_USED = ["cluster_totals", "points", "near_counts", "cluster_tx", "cluster_pairs"]
_ROUND_CLUSTER = ["cluster_avg_near", "cluster_weekend_share", "cluster_weekday_share", "cluster_avg_distance"]


@query(sql(_CLUSTER_ALL, *_USED))
def cluster_features(spark, sf_dir):
    table = P.cluster_features(clustered(spark, sf_dir))
    return table.select(*CLUSTER, *[r6(c) if c in _ROUND_CLUSTER else c for c in P.CLUSTER_NUMBERS], "country", "cluster_label")


_POINT_ALL = f"""SELECT p.customer_id, p.lat, p.lon, p.cluster_id, {_LABEL.replace('(lat', '(p.lat').replace('(lon', '(p.lon')} AS label,
round(CAST(p.n_tx AS DOUBLE) / t.cluster_n_tx, 6) AS visit_ratio, d.density, n.near_count, a.apartments_percent, e.date_ratio, e.duration,
round(u.unvisited_shop_weight, 6) AS unvisited_shop_weight, h.* EXCLUDE (customer_id, lat, lon), f.currency
FROM points p JOIN cluster_totals t USING (customer_id, cluster_id) JOIN ({_DENSITY}) d USING (customer_id, lat, lon)
JOIN near_counts n USING (customer_id, lat, lon) JOIN ({_PERCENT}) a USING (customer_id, lat, lon)
JOIN ({_POINT_DATES}) e USING (customer_id, lat, lon) JOIN unvisited u USING (customer_id, lat, lon)
JOIN (SELECT customer_id, lat, lon, {_HOLIDAYS}, {_WEEKDAYS} FROM kept GROUP BY customer_id, lat, lon) h USING (customer_id, lat, lon)
JOIN ({_FIRST_CURRENCY}) f USING (customer_id, lat, lon)"""
_USED_POINT = [*_USED, "place_units", "cluster_units", "unvisited"]
_ROUND_POINT = ["visit_ratio", "density", "apartments_percent", "unvisited_shop_weight"]


def _rounded_points(columns):
    return [r6(c) if c in _ROUND_POINT + _ROUND_CLUSTER else c for c in columns]


@query(sql(_POINT_ALL, *_USED_POINT))
def point_features(spark, sf_dir):
    table = P.point_features(clustered(spark, sf_dir), around(spark, sf_dir), cluster_table(spark, sf_dir))
    return table.select(*PLACE, "cluster_id", "label", "currency", *_rounded_points(P.POINT_NUMBERS))


@query(sql(f"SELECT * FROM ({_POINT_ALL}) JOIN ({_CLUSTER_ALL}) USING (customer_id, cluster_id)", *_USED_POINT))
def prepare_features(spark, sf_dir):
    """The whole way from transactions to features, without the tables other queries store."""
    train, test = views.train(spark, sf_dir), views.test(spark, sf_dir)
    shops = cut_lineage(surroundings.shop_index(train, test, surroundings.mcc_home_weights(train)))
    table = P.prepare_features(train, P.Surroundings(views.apartments(spark, sf_dir), shops), "home")
    return table.select(*PLACE, "cluster_id", "label", "cluster_label", "currency", "country",
                        *_rounded_points([*P.POINT_NUMBERS, *P.CLUSTER_NUMBERS]))


# The test customers, whose target is not known, in the place of the train customers near theirs.
UNLABELLED = {"kept": ("SELECT * FROM tx WHERE NOT is_train", ["tx"])}


@query(sql(f"SELECT * FROM ({_POINT_ALL}) JOIN ({_CLUSTER_ALL}) USING (customer_id, cluster_id)", *_USED_POINT, replaced=UNLABELLED))
def prepare_features_unlabelled(spark, sf_dir):
    """The features of customers without a target: all are kept, and no place has a label."""
    table = P.prepare_features(views.test(spark, sf_dir), around(spark, sf_dir))
    return table.select(*PLACE, "cluster_id", "label", "cluster_label", "currency", "country",
                        *_rounded_points([*P.POINT_NUMBERS, *P.CLUSTER_NUMBERS]))


_BOTH = {"kept": (f"SELECT * FROM tx WHERE NOT is_train OR (home_lat IS NOT NULL OR work_lat IS NOT NULL) AND {relations.md5_number(chr(39) + '0' + chr(39), 'customer_id')} % 1000 < 700", ["tx"])}
_TARGET_LABEL = """CASE WHEN {near} AND {t}_lat IS NOT NULL AND customer_id IN
(SELECT customer_id FROM kept WHERE {reach}) THEN 1 WHEN {t}_lat IS NOT NULL AND customer_id IN (SELECT customer_id FROM kept WHERE {reach}) THEN 0 END AS {t}_label"""
_TARGET_LABELS = ", ".join(_TARGET_LABEL.format(
    t=t, near=near("lat", "lon", f"{t}_lat", f"{t}_lon", R), reach=near("lat", "lon", f"{t}_lat", f"{t}_lon", 0.06)) for t in ("home", "work"))


@query(sql(f"""SELECT * EXCLUDE (label, cluster_label) FROM ({_POINT_ALL}) JOIN ({_CLUSTER_ALL}) USING (customer_id, cluster_id)
JOIN (SELECT DISTINCT customer_id, lat, lon, is_train, {_TARGET_LABELS} FROM kept) USING (customer_id, lat, lon)""", *_USED_POINT, replaced=_BOTH))
def features_for_both_targets(spark, sf_dir):
    """What `home_and_work` learns from and predicts: features made once, with a label for each target."""
    train, test = views.train(spark, sf_dir), views.test(spark, sf_dir)
    visits = predict.visits_of_both(train, test)
    table = cut_lineage(P.features_of_visits(visits, around(spark, sf_dir)))
    for target in predict.TARGETS:
        known = P.target_labels(visits, target).withColumn("label", F.col("label").cast("int"))
        table = table.join(known.withColumnRenamed("label", f"{target}_label"), PLACE, "left")
    table = table.withColumn("is_train", F.col("customer_id").startswith("1")).withColumn("customer_id", F.expr("substring(customer_id, 2)"))
    return table.select(*PLACE, "cluster_id", "is_train", "home_label", "work_label", "currency", "country",
                        *_rounded_points([*P.POINT_NUMBERS, *P.CLUSTER_NUMBERS]))
