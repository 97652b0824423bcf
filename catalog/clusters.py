"""Clustering of points, and the spectrum of a point."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from catalog import views
from catalog.registry import query
from catalog.relations import _NEAREST, all_places, md5_number, millionths
from catalog.views import cell, double, near, sql
from waymark.materialize import cut_lineage
from waymark.operators import density, ranking
from waymark.plans import spectrum

R = 0.02
PLACE = ["customer_id", "lat", "lon"]
views.BLOCKS.update({
    "all_places": ("SELECT DISTINCT customer_id, lat, lon FROM tx", ["tx"]),
    "all_near": (f"""SELECT a.customer_id, a.lat, a.lon, b.lat AS n_lat, b.lon AS n_lon FROM all_places a
JOIN all_places b ON a.customer_id = b.customer_id AND {near('a.lat', 'a.lon', 'b.lat', 'b.lon', R)}""", ["all_places"]),
    "all_reach": (views._reach("all_reach", "all_places", "all_near"), ["all_places", "all_near"]),
    "cores": ("SELECT customer_id, lat, lon FROM all_near GROUP BY customer_id, lat, lon HAVING count(*) >= 3", ["all_near"]),
    "core_near": ("""SELECT n.* FROM all_near n JOIN cores a USING (customer_id, lat, lon)
JOIN cores b ON b.customer_id = n.customer_id AND b.lat = n.n_lat AND b.lon = n.n_lon""", ["all_near", "cores"]),
    "core_reach": (views._reach("core_reach", "cores", "core_near"), ["cores", "core_near"]),
    "core_labels": ("SELECT customer_id, lat, lon, min(cell) AS cluster_id FROM core_reach GROUP BY customer_id, lat, lon", ["core_reach"]),
    "lattice": (f"""SELECT DISTINCT floor(lat * 100 + {double(0.5)}) AS i, floor(lon * 100 + {double(0.5)}) AS j FROM tx""", ["tx"]),
    "lattice_reach": (f"""SELECT i, j, {cell('i', 'j', density.cell_size(6.0))} AS cell FROM lattice
UNION SELECT b.i, b.j, r.cell FROM lattice_reach r JOIN lattice b ON (r.i - b.i) * (r.i - b.i) + (r.j - b.j) * (r.j - b.j) <= 36""", ["lattice"]),
    "home_visits": ("""SELECT customer_id, lat, lon, count(*) AS visits,
(lat - min(home_lat)) * (lat - min(home_lat)) + (lon - min(home_lon)) * (lon - min(home_lon)) AS d2
FROM tx WHERE is_train GROUP BY customer_id, lat, lon""", ["tx"]),
})


@query(sql("SELECT customer_id, lat, lon, min(cell) AS cluster_id FROM all_reach GROUP BY customer_id, lat, lon", "all_reach"))
def cluster_customer_points(spark, sf_dir):
    return density.cluster_points(all_places(spark, sf_dir), R)


@query(sql("SELECT i / 100 AS lat, j / 100 AS lon, min(cell) AS cluster_id FROM lattice_reach GROUP BY i, j", "lattice_reach"))
def cluster_global_points(spark, sf_dir):
    return density.cluster_global_points(views.tx(spark, sf_dir))


@query(sql(f"""SELECT customer_id, min(cell) AS cluster_id, count(*) AS n FROM (SELECT tx.customer_id, l.cell FROM tx JOIN
(SELECT i, j, min(cell) AS cell FROM lattice_reach GROUP BY i, j) l ON l.i = floor(lat * 100 + {double(0.5)}) AND l.j = floor(lon * 100 + {double(0.5)}))
GROUP BY customer_id, cell""", "tx", "lattice_reach"))
def assign_global_cluster(spark, sf_dir):
    tx = views.tx(spark, sf_dir)
    found = density.assign_global_cluster(tx, density.cluster_global_points(tx))
    return found.groupBy("customer_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql("""SELECT p.customer_id, p.lat, p.lon, coalesce(c.cluster_id, b.cluster_id, 0) AS cluster_id,
CASE WHEN c.cluster_id IS NOT NULL THEN 'core' WHEN b.cluster_id IS NOT NULL THEN 'border' ELSE 'noise' END AS role
FROM all_places p LEFT JOIN core_labels c USING (customer_id, lat, lon)
LEFT JOIN (SELECT n.customer_id, n.lat, n.lon, min(l.cluster_id) AS cluster_id FROM all_near n
JOIN core_labels l ON l.customer_id = n.customer_id AND l.lat = n.n_lat AND l.lon = n.n_lon GROUP BY n.customer_id, n.lat, n.lon) b
ON b.customer_id = p.customer_id AND b.lat = p.lat AND b.lon = p.lon""", "all_places", "all_near", "core_labels"))
def dbscan(spark, sf_dir):
    return density.dbscan(all_places(spark, sf_dir), R, 3, by=["customer_id"]).drop("weight").fillna(0, ["cluster_id"])


# Spectra.

_STEPS = [(f"max(CASE WHEN rank = {i + 1} THEN step END)", f"step_{i}", 12) for i in range(1, 5)]
_PARTS = [(f"max(CASE WHEN rank = {i} THEN CAST(visits AS DOUBLE) / total END)", f"share_{i}", 6) for i in range(1, 6)]
_ROUNDED = ", ".join(f"round({text}, {digits}) AS {name}" for text, name, digits in _STEPS + _PARTS)
_EXACT = f"[{', '.join(text for text, _, _ in _STEPS + _PARTS)}] AS x"


def _spectrum_sql(nearest: str, totals: str, columns: str = _ROUNDED) -> str:
    return f"""SELECT customer_id, lat, lon, {columns} FROM (SELECT n.*, t.total,
(near_lat - lag(near_lat) OVER w) * (near_lat - lag(near_lat) OVER w) + (near_lon - lag(near_lon) OVER w) * (near_lon - lag(near_lon) OVER w) AS step
FROM ({nearest}) n JOIN ({totals}) t USING (customer_id) WINDOW w AS (PARTITION BY n.customer_id, n.lat, n.lon ORDER BY rank)) GROUP BY customer_id, lat, lon"""


def _nearest_sql(visits: str) -> str:
    d2 = "(a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)"
    return f"""SELECT * FROM (SELECT a.customer_id, a.lat, a.lon, b.lat AS near_lat, b.lon AS near_lon, b.visits,
row_number() OVER (PARTITION BY a.customer_id, a.lat, a.lon ORDER BY {d2}, b.lat, b.lon) AS rank
FROM {visits} a JOIN {visits} b ON a.customer_id = b.customer_id) WHERE rank <= 5"""


def _rounded(df):
    return df.select(*PLACE, *[F.round(c, 12).alias(c) for c in spectrum.STEP_NAMES], *[F.round(c, 6).alias(c) for c in spectrum.SHARE_NAMES])


@query(sql(_spectrum_sql(_NEAREST, "SELECT customer_id, count(*) AS total FROM tx GROUP BY customer_id"), "tx"))
def point_spectrum(spark, sf_dir):
    visits = views.stored(spark, sf_dir, "visits", lambda: cut_lineage(ranking.visit_counts(views.tx(spark, sf_dir))))
    return _rounded(spectrum.point_spectrum(visits, visits))


views.BLOCKS.update({
    "spectrum_visits": (f"""SELECT * FROM home_visits WHERE d2 < 1 AND customer_id IN (SELECT customer_id FROM home_visits WHERE d2 < 1
GROUP BY customer_id HAVING count(*) >= 5 AND count(*) FILTER (d2 <= {double(R * R)}) > 0)""", ["home_visits"]),
    "background_visits": (f"""SELECT * FROM home_visits WHERE customer_id IN (SELECT customer_id FROM home_visits
GROUP BY customer_id HAVING count(*) FILTER (NOT d2 <= {double(R * R)}) >= 5)""", ["home_visits"]),
})


@query(sql(f"""SELECT s.* FROM ({_spectrum_sql(_nearest_sql('spectrum_visits'), 'SELECT customer_id, sum(visits) AS total FROM spectrum_visits GROUP BY customer_id')}) s
JOIN (SELECT customer_id, lat, lon FROM spectrum_visits WHERE d2 <= {double(R * R)}) USING (customer_id, lat, lon)""", "spectrum_visits"))
def spectrum_training_set(spark, sf_dir):
    return _rounded(spectrum.spectrum_training_set(views.train(spark, sf_dir)))


_DRAW = md5_number("'0'", "customer_id", millionths("lat"), millionths("lon"))


@query(sql(f"""SELECT s.* FROM ({_spectrum_sql(_nearest_sql('background_visits'), 'SELECT customer_id, sum(visits) AS total FROM background_visits GROUP BY customer_id')}) s
JOIN (SELECT customer_id, lat, lon FROM (SELECT customer_id, lat, lon, row_number() OVER (PARTITION BY customer_id ORDER BY {_DRAW}, lat, lon) AS place
FROM background_visits WHERE NOT d2 <= {double(R * R)}) WHERE place = 1) USING (customer_id, lat, lon)""", "background_visits"))
def spectrum_background_set(spark, sf_dir):
    return _rounded(spectrum.spectrum_background_set(views.train(spark, sf_dir)))


def _training_vectors(spark, sf_dir):
    return views.stored(spark, sf_dir, "spectra", lambda: cut_lineage(
        spectrum.with_vector(spectrum.spectrum_training_set(views.train(spark, sf_dir)))))


def _spectrum_model(spark, sf_dir):
    return views.stored(spark, sf_dir, "spectrum_model", lambda: spectrum.fit_kmeans(_training_vectors(spark, sf_dir), 150))


_TOTAL = "SELECT customer_id, sum(visits) AS total FROM {} GROUP BY customer_id"
_BUCKET = md5_number("'0'", "customer_id") + " % 10"
views.BLOCKS.update({
    # Ten customers' first spectra serve as centres.
    "spectrum_centers": (f"""SELECT CAST({_BUCKET} AS INTEGER) AS prediction, arg_min(x, (customer_id, lat, lon)) AS center
FROM ({_spectrum_sql(_nearest_sql('spectrum_visits'), _TOTAL.format('spectrum_visits'), _EXACT)}) s
JOIN (SELECT customer_id, lat, lon FROM spectrum_visits WHERE d2 <= {double(R * R)}) USING (customer_id, lat, lon) GROUP BY 1""", ["spectrum_visits"]),
    "both_visits": (f"""SELECT * FROM home_visits WHERE d2 <= 1 AND customer_id IN (SELECT customer_id FROM home_visits WHERE d2 <= 1
GROUP BY customer_id HAVING count(*) >= 5 AND count(*) FILTER (d2 <= {double(R * R)}) > 0 AND count(*) FILTER (NOT d2 <= {double(R * R)}) > 0)""", ["home_visits"]),
    "both_anchors": (f"""SELECT customer_id, lat, lon, near FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, near ORDER BY {_DRAW}, lat, lon) AS place
FROM (SELECT *, d2 <= {double(R * R)} AS near FROM both_visits)) WHERE place = 1 OR NOT near""", ["both_visits"]),
    "both_distances": (f"""SELECT customer_id, near, min(list_distance(x, center)) AS distance
FROM ({_spectrum_sql(_nearest_sql('both_visits'), _TOTAL.format('both_visits'), _EXACT)}) s JOIN both_anchors USING (customer_id, lat, lon)
CROSS JOIN spectrum_centers GROUP BY customer_id, near""", ["both_visits", "both_anchors", "spectrum_centers"]),
    "separated": ("""SELECT customer_id, min(distance) FILTER (near) AS inside, min(distance) FILTER (NOT near) AS outside FROM both_distances
GROUP BY customer_id""", ["both_distances"]),
})
_STATISTICS = """count(*) AS count, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS variance,
round(min(x), 6) AS min, round(max(x), 6) AS max, round(CAST(count(*) FILTER (x <> 0) AS DOUBLE), 6) AS "numNonZeros",
round(sum(abs(x)), 6) AS "normL1", round(sqrt(sum(x * x)), 6) AS "normL2\""""


@query(sql(f"""SELECT component, {_STATISTICS} FROM (SELECT 0 AS component, inside AS x FROM separated
UNION ALL SELECT 1, outside FROM separated
UNION ALL SELECT 2, CASE WHEN inside < outside THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM separated) GROUP BY component""", "separated"))
def spectrum_separation_test(spark, sf_dir):
    """Column statistics of (near distance, outside distance, near is smaller), one row per component, by a table of ten centres."""
    first = F.min_by(vector_to_array("features"), F.struct(*PLACE)).alias("center")
    bucket = F.pmod(ranking.portable_hash(0, F.col("customer_id")), F.lit(10)).cast("int").alias("prediction")
    centers = _training_vectors(spark, sf_dir).groupBy(bucket).agg(first)
    table = spectrum.spectrum_separation_test(views.train(spark, sf_dir), centers)
    vectors = table.select(array_to_vector(F.array("in_distance", "out_distance", "separated")).alias("features"))
    stats = spectrum.column_statistics(vectors)
    return stats.select("component", "count", *[F.round(m, 6).alias(m) for m in spectrum.METRICS])


@query()
def kmeans_score_by_k(spark, sf_dir):
    return spectrum.kmeans_score_by_k(_training_vectors(spark, sf_dir))


def _vectors(spark, sf_dir):
    return views.embeddings(spark, sf_dir).select(
        "vec_id", "label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))


# The first vector of each label serves as a centre.
_LABEL_CENTERS = """SELECT CAST(label AS INTEGER) AS prediction, arg_min(CAST(embedding AS DOUBLE[]), vec_id) AS center
FROM embeddings WHERE label IS NOT NULL GROUP BY label"""


def _label_centers(spark, sf_dir):
    rows = views.embeddings(spark, sf_dir).filter("label is not null")
    first = F.min_by(F.transform("embedding", lambda x: x.cast("double")), "vec_id").alias("center")
    return rows.groupBy(F.col("label").cast("int").alias("prediction")).agg(first)


@query(f"""SELECT vec_id, prediction, round(distance, 6) AS centroid_distance FROM (SELECT vec_id, prediction, distance,
row_number() OVER (PARTITION BY vec_id ORDER BY distance, prediction) AS place FROM (SELECT vec_id, prediction,
list_distance(CAST(embedding AS DOUBLE[]), center) AS distance FROM embeddings CROSS JOIN ({_LABEL_CENTERS}))) WHERE place = 1""")
def distance_to_centroid(spark, sf_dir):
    placed = spectrum.distance_to_centroid(_vectors(spark, sf_dir), _label_centers(spark, sf_dir))
    return placed.select("vec_id", "prediction", F.round("centroid_distance", 6).alias("centroid_distance"))


@query(f"""SELECT k, 0 AS seed, cluster, count(*) AS n, round(sum(distance), 6) AS distance, round(sum(distance * distance), 6) AS cost,
round(sum(first), 6) AS first, round(sum(last), 6) AS last
FROM (SELECT k, CAST(prediction AS INTEGER) AS cluster, distance, first, last, row_number() OVER (PARTITION BY vec_id, k ORDER BY distance, prediction) AS place
FROM (SELECT vec_id, k, prediction, list_distance(CAST(embedding AS DOUBLE[]), center) AS distance, CAST(embedding[1] AS DOUBLE) AS first,
CAST(embedding[-1] AS DOUBLE) AS last FROM embeddings CROSS JOIN ({_LABEL_CENTERS}) JOIN (VALUES (2), (5), (10)) sizes(k) ON prediction < k))
WHERE place = 1 GROUP BY k, cluster""")
def kmeans_assignment_sums(spark, sf_dir):
    """What one round of K-Means reads off the vectors, for three sizes in one scan."""
    centers = {r["prediction"]: r["center"] for r in _label_centers(spark, sf_dir).collect()}
    runs = {(k, 0): np.array([centers[c] for c in sorted(centers) if c < k]) for k in (2, 5, 10)}
    sums = spectrum.assignment_sums(_vectors(spark, sf_dir), runs)
    return sums.select("k", "seed", "cluster", "n", *[F.round(c, 6).alias(c) for c in ("distance", "cost")],
                       F.round(F.col("sums")[0], 6).alias("first"), F.round(F.element_at("sums", -1), 6).alias("last"))


@query(f"""SELECT CAST(component AS INTEGER) AS component, {_STATISTICS}
FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS component FROM embeddings) GROUP BY component""")
def column_statistics(spark, sf_dir):
    stats = spectrum.column_statistics(_vectors(spark, sf_dir))
    return stats.select("component", "count", *[F.round(m, 6).alias(m) for m in spectrum.METRICS])


@query(sql("""SELECT apartment_id, round((lat - avg(lat) OVER ()) / stddev_pop(lat) OVER (), 6) AS lat,
round((lon - avg(lon) OVER ()) / stddev_pop(lon) OVER (), 6) AS lon,
round((units - avg(units) OVER ()) / stddev_pop(units) OVER (), 6) AS units, 0.0::DOUBLE AS one FROM apartments""", "apartments"))
def standardize(spark, sf_dir):
    rows = views.apartments(spark, sf_dir).select("apartment_id", "lat", "lon", "units", F.lit(1.0).alias("one"))
    scored = spectrum.standardize(rows, ["lat", "lon", "units", "one"])
    return scored.select("apartment_id", *[F.round(c, 6).alias(c) for c in ("lat", "lon", "units", "one")])


@query("""SELECT prediction, round(sum(-p * ln(p)), 6) AS entropy FROM (SELECT prediction, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY prediction) AS p
FROM (SELECT vec_id % 7 AS prediction, label, count(*) AS n FROM embeddings GROUP BY 1, 2)) GROUP BY prediction""")
def label_entropy(spark, sf_dir):
    rows = views.embeddings(spark, sf_dir).select((F.col("vec_id") % 7).alias("prediction"), "label")
    return spectrum.label_entropy(rows).withColumn("entropy", F.round("entropy", 6))
