"""Joins, aggregates, set operations and ranking on the transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views
from catalog.registry import query
from catalog.views import double, near, sql
from waymark.materialize import cut_lineage
from waymark.operators import lookups, radius, ranking, surroundings

R = 0.02


def _places(tx):
    return tx.select("customer_id", "lat", "lon").distinct()


def all_places(spark, sf_dir):
    return views.stored(spark, sf_dir, "places", lambda: cut_lineage(_places(views.tx(spark, sf_dir))))


ALL_PLACES = "SELECT DISTINCT customer_id, lat, lon FROM tx"
ALL_PAIRS = f"""SELECT a.customer_id, a.lat, a.lon, b.lat AS near_lat, b.lon AS near_lon FROM ({ALL_PLACES}) a
JOIN ({ALL_PLACES}) b ON a.customer_id = b.customer_id AND {near('a.lat', 'a.lon', 'b.lat', 'b.lon', R)}"""


@query(sql(f"""SELECT a.apartment_id, b.apartment_id AS other_id FROM apartments a JOIN apartments b
ON {near('a.lat', 'a.lon', 'b.lat', 'b.lon', 0.0075)}""", "apartments"))
def radius_join(spark, sf_dir):
    a = views.apartments(spark, sf_dir).select("apartment_id", "lat", "lon")
    b = a.select(F.col("apartment_id").alias("other_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    return radius.radius_join(a, b, 0.0075).select("apartment_id", "other_id")


@query(sql("SELECT lat, lon, apartment_id, units FROM near_apartments", "near_apartments"))
def district_apartments(spark, sf_dir):
    found = surroundings.district_apartments(views.tx(spark, sf_dir), views.apartments(spark, sf_dir))
    return found.select("lat", "lon", "apartment_id", "units")


@query(sql("""SELECT tx.customer_id, tx.lat, tx.lon, count(*) AS n, CAST(max(coalesce(u.units, 0)) AS BIGINT) AS units
FROM tx LEFT JOIN place_units u ON u.lat = tx.lat AND u.lon = tx.lon GROUP BY tx.customer_id, tx.lat, tx.lon""", "tx", "place_units"))
def district_apartment_units(spark, sf_dir):
    tx = views.tx(spark, sf_dir)
    units = surroundings.district_apartment_units(cut_lineage(tx.select("lat", "lon").distinct()), views.apartments(spark, sf_dir))
    counts = tx.groupBy("customer_id", "lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    return lookups.lookup_join(counts, units, ["lat", "lon"], "units", 0)


@query(sql(ALL_PAIRS, "tx"))
def customer_near_pairs(spark, sf_dir):
    return radius.customer_near_pairs(all_places(spark, sf_dir), R)


@query(sql(f"""SELECT customer_id, count(*) AS n, CAST(sum(mcc) AS BIGINT) AS mcc_sum FROM tx WHERE customer_id IN
(SELECT customer_id FROM tx WHERE home_lat IS NULL OR {near('lat', 'lon', 'home_lat', 'home_lon', 0.06)}) GROUP BY customer_id""", "tx"))
def keep_near_target(spark, sf_dir):
    kept = lookups.keep_near_target(views.tx(spark, sf_dir), "home")
    return kept.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.sum("mcc").alias("mcc_sum"))


@query(sql("""SELECT tx.customer_id, tx.terminal_id, coalesce(weight, -1.0) AS weight FROM tx LEFT JOIN
(SELECT * FROM weights WHERE mcc % 4 > 0) w ON w.mcc = tx.mcc""", "tx", "weights"))
def lookup_join(spark, sf_dir):
    weights = surroundings.mcc_home_weights(views.train(spark, sf_dir)).filter("mcc % 4 > 0")
    return lookups.lookup_join(views.tx(spark, sf_dir), weights, "mcc", "weight", -1.0).select("customer_id", "terminal_id", "weight")


# Customers of which every third counts as resolved.
_RESOLVED = "CAST(substr(customer_id, 2) AS BIGINT) % 3 = 0"


@query(sql(f"SELECT customer_id, count(*) AS n FROM tx WHERE NOT is_train AND {_RESOLVED} GROUP BY customer_id", "tx"))
def keep_defined(spark, sf_dir):
    test = views.test(spark, sf_dir)
    resolved = test.filter(_RESOLVED).select("customer_id").distinct()
    return lookups.keep_defined(test, resolved).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql(f"SELECT customer_id, count(*) AS n FROM tx WHERE NOT is_train AND NOT ({_RESOLVED}) GROUP BY customer_id", "tx"))
def exclude_defined(spark, sf_dir):
    test = views.test(spark, sf_dir)
    resolved = test.filter(_RESOLVED).select("customer_id").distinct()
    return lookups.exclude_defined(test, resolved).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT mcc, count(*) AS n FROM tx WHERE is_train GROUP BY mcc", "tx"))
def mcc_counts(spark, sf_dir):
    return surroundings.mcc_counts(views.train(spark, sf_dir))


@query(sql(f"""SELECT mcc, count(*) AS n, count(*) FILTER ({near('lat', 'lon', 'home_lat', 'home_lon', R)}) AS n_near
FROM tx WHERE is_train GROUP BY mcc""", "tx"))
def mcc_near_home_counts(spark, sf_dir):
    return surroundings.mcc_near_home_counts(views.train(spark, sf_dir))


@query(sql("SELECT mcc, weight FROM weights", "weights"))
def mcc_home_weights(spark, sf_dir):
    return surroundings.mcc_home_weights(views.train(spark, sf_dir))


@query(sql("SELECT lat, lon, mcc, weight, CAST(floor(lat / 0.02::DOUBLE) AS INTEGER) AS cell_x, CAST(floor(lon / 0.02::DOUBLE) AS INTEGER) AS cell_y FROM shops", "shops"))
def shop_index(spark, sf_dir):
    from waymark.functions import geo

    train, test = views.train(spark, sf_dir), views.test(spark, sf_dir)
    shops = surroundings.shop_index(train, test, surroundings.mcc_home_weights(train))
    return shops.select("lat", "lon", "mcc", "weight", geo.grid_cell(F.col("lat"), R).alias("cell_x"), geo.grid_cell(F.col("lon"), R).alias("cell_y"))


def _dictionaries(spark, sf_dir):
    """All three, from one scan for the session."""
    return views.stored(spark, sf_dir, "dictionaries", lambda: lookups.category_dictionaries([views.tx(spark, sf_dir)], ["country", "mcc", "currency"]))


def _dictionary(column):
    return sql(f"SELECT {column} AS value, CAST(row_number() OVER (ORDER BY {column}) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT {column} FROM tx)", "tx")


@query(_dictionary("country"))
def category_dictionary_country(spark, sf_dir):
    return _dictionaries(spark, sf_dir)["country"]


@query(_dictionary("mcc"))
def category_dictionary_mcc(spark, sf_dir):
    return _dictionaries(spark, sf_dir)["mcc"]


@query(_dictionary("currency"))
def category_dictionary_currency(spark, sf_dir):
    return _dictionaries(spark, sf_dir)["currency"]


@query(sql("SELECT lat, lon, mcc, date FROM (SELECT lat, lon, mcc, CAST(date AS VARCHAR) AS date FROM tx)", "tx"))
def union_train_test(spark, sf_dir):
    both = lookups.union_train_test(views.train(spark, sf_dir), views.test(spark, sf_dir), ["lat", "lon", "mcc", "date"])
    return both.withColumn("date", F.col("date").cast("string"))


@query(sql(ALL_PLACES, "tx"))
def distinct_values(spark, sf_dir):
    return lookups.distinct_values(views.tx(spark, sf_dir), ["customer_id", "lat", "lon"])


# Ranking. The score is a made-up but fixed function of the row.
_SCORED = """SELECT customer_id, lat, lon, CAST(max(mcc % 17) AS DOUBLE) / 17 AS score,
CASE WHEN min(currency) = 643 THEN 1.0 ELSE 0.0 END AS label FROM tx GROUP BY customer_id, lat, lon"""
_BEST = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, lat, lon) AS place FROM ({_SCORED})) WHERE place = 1"""


def _scored(spark, sf_dir):
    return views.tx(spark, sf_dir).groupBy("customer_id", "lat", "lon").agg(
        (F.max(F.col("mcc") % 17).cast("double") / 17).alias("score"),
        F.when(F.min("currency") == 643, 1.0).otherwise(0.0).alias("label"))


@query(sql(f"SELECT customer_id, lat, lon, score FROM ({_BEST})", "tx"))
def best_point_per_customer(spark, sf_dir):
    return ranking.best_point_per_customer(_scored(spark, sf_dir))


@query(sql(f"SELECT round(avg(CAST(label AS DOUBLE)), 9) AS hit_rate FROM ({_BEST})", "tx"))
def top1_hit_rate(spark, sf_dir):
    return ranking.top1_hit_rate(_scored(spark, sf_dir)).select(F.round("hit_rate", 9).alias("hit_rate"))


_VISITS = "SELECT customer_id, lat, lon, count(*) AS visits FROM tx GROUP BY customer_id, lat, lon"
_NEAREST = f"""SELECT * FROM (SELECT a.customer_id, a.lat, a.lon, b.lat AS near_lat, b.lon AS near_lon, b.visits,
(a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon) AS d2,
row_number() OVER (PARTITION BY a.customer_id, a.lat, a.lon ORDER BY (a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon), b.lat, b.lon) AS rank
FROM ({_VISITS}) a JOIN ({_VISITS}) b ON a.customer_id = b.customer_id) WHERE rank <= 5"""


def _nearest(spark, sf_dir, before=False):
    visits = views.stored(spark, sf_dir, "visits", lambda: cut_lineage(ranking.visit_counts(views.tx(spark, sf_dir))))
    return ranking.nearest_points_k(visits, visits, 5, keep=["visits"], before=before)


@query(sql(f"SELECT customer_id, lat, lon, near_lat, near_lon, visits, round(d2, 12) AS d2, CAST(rank AS INTEGER) AS rank FROM ({_NEAREST})", "tx"))
def nearest_points_k(spark, sf_dir):
    return _nearest(spark, sf_dir).withColumn("d2", F.round("d2", 12))


@query(sql(f"""SELECT customer_id, lat, lon, CAST(rank AS INTEGER) AS rank, round((near_lat - p_lat) * (near_lat - p_lat) + (near_lon - p_lon) * (near_lon - p_lon), 12) AS step_d2
FROM (SELECT *, lag(near_lat) OVER (PARTITION BY customer_id, lat, lon ORDER BY rank) AS p_lat,
lag(near_lon) OVER (PARTITION BY customer_id, lat, lon ORDER BY rank) AS p_lon FROM ({_NEAREST}))""", "tx"))
def consecutive_distance(spark, sf_dir):
    steps = ranking.consecutive_distance(_nearest(spark, sf_dir, before=True))
    return steps.select("customer_id", "lat", "lon", "rank", F.round("step_d2", 12).alias("step_d2"))


@query(sql("""SELECT customer_id, CAST(date AS VARCHAR) AS date, CAST(gap AS INTEGER) AS gap_days FROM (SELECT customer_id, date,
date_diff('day', lag(date) OVER (PARTITION BY customer_id ORDER BY date), date) AS gap FROM (SELECT DISTINCT customer_id, date FROM tx))
WHERE gap IS NOT NULL""", "tx"))
def date_gaps(spark, sf_dir):
    return ranking.date_gaps(views.tx(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))


@query(sql(f"""SELECT customer_id, lat, lon, top_lat, top_lon, top_visits FROM (SELECT a.customer_id, a.lat, a.lon, b.lat AS top_lat, b.lon AS top_lon, b.visits AS top_visits,
row_number() OVER (PARTITION BY a.customer_id, a.lat, a.lon ORDER BY b.visits DESC, b.lat, b.lon) AS rank
FROM ({_VISITS}) a JOIN ({_VISITS}) b ON a.customer_id = b.customer_id AND (a.lat <> b.lat OR a.lon <> b.lon)) WHERE rank = 1""", "tx"))
def most_visited_point(spark, sf_dir):
    visits = views.stored(spark, sf_dir, "visits", lambda: cut_lineage(ranking.visit_counts(views.tx(spark, sf_dir))))
    return ranking.most_visited_point(visits)


@query(sql("""SELECT lat, lon, CAST(row_number() OVER (ORDER BY lat DESC, lon) - 1 AS BIGINT) AS position
FROM (SELECT lat, lon FROM tx UNION SELECT lat, lon FROM apartments)""", "tx", "apartments"))
def sort_points(spark, sf_dir):
    tx, homes = views.tx(spark, sf_dir), views.apartments(spark, sf_dir)
    return ranking.sort_points(tx.select("lat", "lon").unionByName(homes.select("lat", "lon")))


def md5_number(*values: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(values)})), 1, 6) AS BIGINT)"


@query(sql(f"""SELECT customer_id, {md5_number("'7'", 'customer_id')} % 1000 < 300 AS is_training, count(*) AS n FROM tx GROUP BY customer_id""", "tx"))
def split_train_test(spark, sf_dir):
    split = ranking.split_train_test(views.tx(spark, sf_dir), 0.3, seed=7)
    return split.groupBy("customer_id", "is_training").agg(F.count(F.lit(1)).alias("n"))


def millionths(name: str) -> str:
    return f"CAST(CAST(floor({name} * 1000000 + {double(0.5)}) AS BIGINT) AS VARCHAR)"


DRAW = md5_number("'0'", "customer_id", millionths("lat"), millionths("lon"))


@query(sql(f"""SELECT customer_id, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY draw, lat, lon) AS place
FROM (SELECT customer_id, lat, lon, {DRAW} AS draw FROM ({ALL_PLACES}))) WHERE place = 1""", "tx"))
def sample_point_per_group(spark, sf_dir):
    return ranking.sample_point_per_group(views.tx(spark, sf_dir).select("customer_id", "lat", "lon"))
