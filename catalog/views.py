"""The given tables as transactions, apartments and families of customers.

The SQL texts run unchanged in Spark and in the checking engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark import session

TABLES = ["lineitem", "orders", "part", "supplier", "nation", "customer", "embeddings"]

TX = """
SELECT concat('C', CAST(o_custkey AS STRING)) AS customer_id,
  o_custkey % 5 < 4 AS is_train,
  CAST(o_orderdate AS DATE) AS date,
  p_size AS mcc,
  CASE l_suppkey % 3 WHEN 0 THEN 643 WHEN 1 THEN 840 ELSE 978 END AS currency,
  n_name AS country,
  CASE l_suppkey % 5 WHEN 0 THEN 'Moskva' WHEN 1 THEN 'SPB' WHEN 2 THEN 'G. MOSKVA' WHEN 3 THEN NULL ELSE n_name END AS city_raw,
  CAST(l_suppkey AS STRING) AS terminal_id,
  l_extendedprice AS amount,
  CASE WHEN l_linenumber % 2 = 1 THEN 0 ELSE 1 END AS from_pos,
  CAST(55.0 AS DOUBLE) + CAST((l_suppkey * 7919) % 23 AS DOUBLE) * CAST(0.007 AS DOUBLE) AS lat,
  CAST(37.0 AS DOUBLE) + CAST((l_suppkey * 104729) % 29 AS DOUBLE) * CAST(0.007 AS DOUBLE) AS lon,
  CASE WHEN o_custkey % 5 < 4 THEN CAST(55.0013 AS DOUBLE) + CAST((o_custkey * 7919) % 23 AS DOUBLE) * CAST(0.007 AS DOUBLE) + CAST(CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS DOUBLE) END AS home_lat,
  CASE WHEN o_custkey % 5 < 4 THEN CAST(37.0017 AS DOUBLE) + CAST((o_custkey * 104729) % 29 AS DOUBLE) * CAST(0.007 AS DOUBLE) END AS home_lon,
  CASE WHEN o_custkey % 5 < 4 AND o_custkey % 7 > 0 THEN CAST(55.0031 AS DOUBLE) + CAST((o_custkey * 6101) % 23 AS DOUBLE) * CAST(0.007 AS DOUBLE) END AS work_lat,
  CASE WHEN o_custkey % 5 < 4 AND o_custkey % 7 > 0 THEN CAST(37.0011 AS DOUBLE) + CAST((o_custkey * 3571) % 29 AS DOUBLE) * CAST(0.007 AS DOUBLE) END AS work_lon
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
"""

APARTMENTS = """
SELECT p_partkey AS apartment_id,
  CAST(55.0003 AS DOUBLE) + CAST((p_partkey * 7919) % 161 AS DOUBLE) * CAST(0.001 AS DOUBLE) AS lat,
  CAST(37.0004 AS DOUBLE) + CAST((p_partkey * 104729) % 203 AS DOUBLE) * CAST(0.001 AS DOUBLE) AS lon,
  1950 + p_partkey % 70 AS year,
  concat('1..', CAST(p_size % 20 + 1 AS STRING)) AS floors,
  p_size AS units, p_partkey % 3 AS parking
FROM part
"""

FAMILY = """
SELECT o_custkey AS customer_id, o_custkey % 3 < 2 AS is_train,
  CAST(55.0 AS DOUBLE) + CAST((o_custkey - o_custkey % 3) % 600 AS DOUBLE) * CAST(0.05 AS DOUBLE) + CAST(o_orderkey % 6 AS DOUBLE) * CAST(0.007 AS DOUBLE) AS lat,
  CAST(37.0 AS DOUBLE) + CAST(o_custkey - o_custkey % 600 AS DOUBLE) * CAST(0.001 AS DOUBLE) AS lon,
  CASE WHEN o_custkey % 3 < 2 THEN CAST(55.0013 AS DOUBLE) + CAST((o_custkey - o_custkey % 3) % 600 AS DOUBLE) * CAST(0.05 AS DOUBLE) + CAST(o_custkey % 3 AS DOUBLE) * CAST(0.001 AS DOUBLE) + CAST(CASE WHEN o_custkey % 12 = 1 THEN 1 ELSE 0 END AS DOUBLE) END AS home_lat,
  CASE WHEN o_custkey % 3 < 2 THEN CAST(37.0017 AS DOUBLE) + CAST(o_custkey - o_custkey % 600 AS DOUBLE) * CAST(0.001 AS DOUBLE) END AS home_lon
FROM orders
"""

# Chains of five customers: the first is known, each shares four places with the one before, and all visit one place.
CHAIN = """
SELECT c_custkey AS customer_id, c_custkey % 5 = 0 AS is_train,
  CAST(55.0 AS DOUBLE) + CAST((c_custkey - c_custkey % 5) % 3000 AS DOUBLE) * CAST(0.05 AS DOUBLE) + CAST(n_nationkey AS DOUBLE) * CAST(0.001 AS DOUBLE) AS lat,
  CAST(37.0 AS DOUBLE) + CAST(c_custkey - c_custkey % 3000 AS DOUBLE) * CAST(0.001 AS DOUBLE) AS lon,
  CASE WHEN c_custkey % 5 = 0 THEN CAST(55.0013 AS DOUBLE) + CAST((c_custkey - c_custkey % 5) % 3000 AS DOUBLE) * CAST(0.05 AS DOUBLE) END AS home_lat,
  CASE WHEN c_custkey % 5 = 0 THEN CAST(37.0017 AS DOUBLE) + CAST(c_custkey - c_custkey % 3000 AS DOUBLE) * CAST(0.001 AS DOUBLE) END AS home_lon
FROM customer JOIN nation ON n_nationkey BETWEEN c_custkey % 5 * 4 - 4 AND c_custkey % 5 * 4 + 3
UNION ALL SELECT c_custkey, c_custkey % 5 = 0, CAST(54.5 AS DOUBLE), CAST(36.5 AS DOUBLE),
  CASE WHEN c_custkey % 5 = 0 THEN CAST(55.0013 AS DOUBLE) + CAST((c_custkey - c_custkey % 5) % 3000 AS DOUBLE) * CAST(0.05 AS DOUBLE) END,
  CASE WHEN c_custkey % 5 = 0 THEN CAST(37.0017 AS DOUBLE) + CAST(c_custkey - c_custkey % 3000 AS DOUBLE) * CAST(0.001 AS DOUBLE) END
FROM customer
"""

# Transactions as text fields in the layout of the input files, with the kinds of dirt they have.
RAW_FIELDS = """
SELECT customer_id, is_train, terminal_id, date AS true_date, mcc AS true_mcc, currency AS true_currency, country, city_raw,
  round(log10(amount), 6) AS true_amount,
  lat AS true_lat, lon AS true_lon, from_pos, home_lat, home_lon, work_lat, work_lon,
  CASE WHEN mcc % 9 = 0 THEN '' WHEN mcc % 9 = 1 THEN concat('"5,', CAST(100 + mcc AS STRING), '"') ELSE CAST(mcc AS STRING) END AS mcc_text,
  CASE WHEN currency = 643 THEN '' ELSE concat(CAST(currency AS STRING), '.0') END AS currency_text,
  CASE WHEN mcc % 13 = 0 THEN '2017-13-99' ELSE CAST(date AS STRING) END AS date_text,
  concat('"shop ""RADON"", no ', terminal_id, '"') AS address_text
FROM tx
"""


def double(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def near(a_lat: str, a_lon: str, b_lat: str, b_lon: str, radius: float) -> str:
    return (f"(({a_lat} - {b_lat}) * ({a_lat} - {b_lat}) + ({a_lon} - {b_lon}) * ({a_lon} - {b_lon})"
            f" <= {double(radius * radius)})")


def cell(lat: str, lon: str, size: float) -> str:
    return (f"(CAST(floor({lat} / {double(size)}) AS BIGINT) * 4294967296"
            f" + CAST(floor({lon} / {double(size)}) AS BIGINT))")


SIZE = 0.02 * 0.7071

_COMPONENTS = """
SELECT customer_id, lat, lon, min(cell) AS cluster_id FROM {reach} GROUP BY customer_id, lat, lon"""


def _reach(name: str, points: str, links: str) -> str:
    return f"""
SELECT customer_id, lat, lon, {cell('lat', 'lon', SIZE)} AS cell FROM {points}
UNION
SELECT l.customer_id, l.n_lat, l.n_lon, r.cell FROM {name} r
JOIN {links} l ON l.customer_id = r.customer_id AND l.lat = r.lat AND l.lon = r.lon"""


# Building blocks of the checking SQL: name -> (text, blocks it reads).
BLOCKS: dict[str, tuple[str, list[str]]] = {
    "tx": (TX, []),
    "apartments": (APARTMENTS, []),
    "family": (FAMILY, []),
    "chain": (CHAIN, []),
    "raw": (RAW_FIELDS, ["tx"]),
    # Train transactions of customers with one within 0.06 of home.
    "kept": (f"""SELECT * FROM tx WHERE is_train AND customer_id IN
(SELECT customer_id FROM tx WHERE is_train AND {near('lat', 'lon', 'home_lat', 'home_lon', 0.06)})""", ["tx"]),
    "places": ("""SELECT customer_id, lat, lon, count(*) AS n_tx, min(date) AS d0, max(date) AS d1,
min(home_lat) AS t_lat, min(home_lon) AS t_lon FROM kept GROUP BY customer_id, lat, lon""", ["kept"]),
    "near_places": (f"""SELECT a.customer_id, a.lat, a.lon, b.lat AS n_lat, b.lon AS n_lon, b.n_tx AS n_n_tx
FROM places a JOIN places b ON a.customer_id = b.customer_id AND {near('a.lat', 'a.lon', 'b.lat', 'b.lon', 0.02)}""", ["places"]),
    "near_counts": ("SELECT customer_id, lat, lon, count(*) AS near_count FROM near_places GROUP BY customer_id, lat, lon", ["near_places"]),
    "reach": (_reach("reach", "places", "near_places"), ["places", "near_places"]),
    "clusters": (_COMPONENTS.format(reach="reach"), ["reach"]),
    "points": ("SELECT p.*, c.cluster_id FROM places p JOIN clusters c USING (customer_id, lat, lon)", ["places", "clusters"]),
    "cluster_totals": ("""SELECT customer_id, cluster_id, sum(n_tx) AS cluster_n_tx, count(*) AS cluster_points,
min(d0) AS d0, max(d1) AS d1 FROM points GROUP BY customer_id, cluster_id""", ["points"]),
    "cluster_pairs": ("""SELECT a.customer_id, a.cluster_id,
sum(a.n_tx * b.n_tx * sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon))) AS tx_sum,
sum(sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon))) AS point_sum
FROM points a JOIN points b ON a.customer_id = b.customer_id AND a.cluster_id = b.cluster_id
GROUP BY a.customer_id, a.cluster_id""", ["points"]),
    "cluster_tx": ("SELECT k.*, c.cluster_id FROM kept k JOIN clusters c USING (customer_id, lat, lon)", ["kept", "clusters"]),
    "weights": (f"""SELECT mcc, CAST(sum(CASE WHEN {near('lat', 'lon', 'home_lat', 'home_lon', 0.02)} THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS weight
FROM tx WHERE is_train GROUP BY mcc
HAVING sum(CASE WHEN {near('lat', 'lon', 'home_lat', 'home_lon', 0.02)} THEN 1 ELSE 0 END) > 0""", ["tx"]),
    "shops": ("SELECT DISTINCT tx.lat, tx.lon, tx.mcc, weight FROM tx JOIN weights ON tx.mcc = weights.mcc", ["tx", "weights"]),
    "near_used": ("""SELECT DISTINCT n.customer_id, n.lat, n.lon, k.mcc FROM near_places n
JOIN kept k ON k.customer_id = n.customer_id AND k.lat = n.n_lat AND k.lon = n.n_lon""", ["near_places", "kept"]),
    "shops_near": (f"""SELECT p.lat, p.lon, s.mcc, s.weight FROM (SELECT DISTINCT lat, lon FROM places) p
JOIN shops s ON {near('p.lat', 'p.lon', 's.lat', 's.lon', 0.02)}""", ["places", "shops"]),
    "unvisited": ("""SELECT p.customer_id, p.lat, p.lon, coalesce(sum(CASE WHEN u.mcc IS NULL THEN s.weight END), 0.0) AS unvisited_shop_weight
FROM places p LEFT JOIN shops_near s ON s.lat = p.lat AND s.lon = p.lon
LEFT JOIN near_used u ON u.customer_id = p.customer_id AND u.lat = p.lat AND u.lon = p.lon AND u.mcc = s.mcc
GROUP BY p.customer_id, p.lat, p.lon""", ["places", "shops_near", "near_used"]),
    "near_apartments": (f"""SELECT p.lat, p.lon, a.apartment_id, a.units FROM (SELECT DISTINCT lat, lon FROM tx) p
JOIN apartments a ON {near('p.lat', 'p.lon', 'a.lat', 'a.lon', 0.02)}""", ["tx", "apartments"]),
    "place_units": ("SELECT lat, lon, sum(units) AS units FROM near_apartments GROUP BY lat, lon", ["near_apartments"]),
    "cluster_units": ("""SELECT customer_id, cluster_id, sum(units) AS cluster_units FROM
(SELECT DISTINCT p.customer_id, p.cluster_id, a.apartment_id, a.units FROM points p JOIN near_apartments a ON a.lat = p.lat AND a.lon = p.lon)
GROUP BY customer_id, cluster_id""", ["points", "near_apartments"]),
}


def sql(query: str, *uses: str, replaced: dict[str, tuple[str, list[str]]] | None = None) -> str:
    """`query` after the building blocks it uses and those they need. `replaced` blocks stand for others of their name."""
    blocks, ordered = {**BLOCKS, **(replaced or {})}, []

    def add(name):
        for needed in blocks[name][1]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in uses:
        add(name)
    head = ",\n".join(f"{name} AS ({blocks[name][0]})" for name in ordered)
    return f"WITH RECURSIVE {head}\n{query}"


_stored: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of one session share. `forget` drops them all."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


def forget() -> None:
    _stored.clear()


def load(spark: SparkSession, sf_dir: str) -> None:
    session.tune(spark)
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    load(spark, sf_dir)
    return spark.sql(text)


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, TX)


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx(spark, sf_dir).filter("is_train")


def test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx(spark, sf_dir).filter("not is_train").drop("home_lat", "home_lon", "work_lat", "work_lon")


def apartments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, APARTMENTS)


def family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, FAMILY)


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, CHAIN)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, f"WITH tx AS ({TX}) {RAW_FIELDS}")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "SELECT vec_id, embedding, label FROM embeddings")
