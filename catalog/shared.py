"""Known places handed on between customers of a family."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views
from catalog.registry import query
from catalog.views import SIZE, cell, near, sql
from waymark.operators import lookups
from waymark.plans import propagate

R = 0.02
# The family view has homes only; work lies half a degree away, unknown for every fourth customer.
WORK_LAT = "CASE WHEN customer_id % 4 > 0 THEN home_lat + CAST(0.5 AS DOUBLE) END"
WORK_LON = "CASE WHEN customer_id % 4 > 0 THEN home_lon END"


def _sides(spark, sf_dir):
    family = views.family(spark, sf_dir)
    train = family.filter("is_train").withColumns({"work_lat": F.expr(WORK_LAT), "work_lon": F.expr(WORK_LON)})
    return train, family.filter("not is_train").select("customer_id", "lat", "lon")


def _blocks(t: str, lat: str, lon: str, family: str = "family", share: str = "shared = own") -> None:
    """Checking SQL for one target: characteristic points, the best match per test customer, the matches that count."""
    place = "p_lat, p_lon"
    views.BLOCKS.update({
        f"{t}_known": (f"""SELECT lat AS p_lat, lon AS p_lon, customer_id, min({lat}) AS lat, min({lon}) AS lon
FROM {family} WHERE is_train AND {lat} > 0 GROUP BY 1, 2, 3""", [family]),
        f"{t}_sizes": (f"SELECT {place}, count(*) AS n FROM {t}_known GROUP BY {place}", [f"{t}_known"]),
        f"{t}_near": (f"""SELECT a.p_lat, a.p_lon, a.customer_id, a.lat, a.lon, b.customer_id AS other, b.lat AS o_lat, b.lon AS o_lon
FROM {t}_known a JOIN {t}_known b ON a.p_lat = b.p_lat AND a.p_lon = b.p_lon AND {near('a.lat', 'a.lon', 'b.lat', 'b.lon', R)}""", [f"{t}_known"]),
        f"{t}_core": (f"""SELECT p_lat, p_lon, customer_id, lat, lon FROM {t}_near JOIN {t}_sizes USING (p_lat, p_lon)
GROUP BY p_lat, p_lon, customer_id, lat, lon, n HAVING count(*) >= least(4, n)""", [f"{t}_near", f"{t}_sizes"]),
        f"{t}_reach": (f"""SELECT p_lat, p_lon, customer_id, {cell('lat', 'lon', SIZE)} AS cell FROM {t}_core
UNION SELECT n.p_lat, n.p_lon, n.other, r.cell FROM {t}_reach r JOIN {t}_near n USING (p_lat, p_lon, customer_id)
JOIN {t}_core c ON c.p_lat = n.p_lat AND c.p_lon = n.p_lon AND c.customer_id = n.other""", [f"{t}_core", f"{t}_near"]),
        f"{t}_core_label": (f"SELECT p_lat, p_lon, customer_id, min(cell) AS label FROM {t}_reach GROUP BY 1, 2, 3", [f"{t}_reach"]),
        f"{t}_label": (f"""SELECT * FROM {t}_core_label UNION ALL SELECT n.p_lat, n.p_lon, n.customer_id, min(l.label) FROM {t}_near n
JOIN {t}_core_label l ON l.p_lat = n.p_lat AND l.p_lon = n.p_lon AND l.customer_id = n.other
WHERE NOT EXISTS (SELECT 1 FROM {t}_core_label c WHERE c.p_lat = n.p_lat AND c.p_lon = n.p_lon AND c.customer_id = n.customer_id)
GROUP BY 1, 2, 3""", [f"{t}_core_label", f"{t}_near"]),
        f"{t}_largest": (f"""SELECT p_lat, p_lon, label FROM (SELECT p_lat, p_lon, label, count(*) AS size,
row_number() OVER (PARTITION BY p_lat, p_lon ORDER BY count(*) DESC, label) AS place FROM {t}_label GROUP BY p_lat, p_lon, label)
JOIN {t}_sizes USING (p_lat, p_lon) WHERE place = 1 AND CAST(size AS DOUBLE) / n >= CAST('0.9' AS DOUBLE)""", [f"{t}_label", f"{t}_sizes"]),
        f"{t}_characteristic": (f"""SELECT k.p_lat AS lat, k.p_lon AS lon, k.customer_id, k.lat AS target_lat, k.lon AS target_lon
FROM {t}_known k JOIN {t}_label l USING (p_lat, p_lon, customer_id) JOIN {t}_largest USING (p_lat, p_lon, label)""",
                                [f"{t}_known", f"{t}_label", f"{t}_largest"]),
        f"{t}_match": (f"""SELECT customer_id, train_customer_id, shared, target_lat, target_lon FROM
(SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY shared DESC, train_customer_id) AS place FROM
(SELECT v.customer_id, c.customer_id AS train_customer_id, count(*) AS shared FROM
(SELECT DISTINCT customer_id, lat, lon FROM {family} WHERE NOT is_train AND lat > 0) v JOIN {t}_characteristic c USING (lat, lon) GROUP BY 1, 2))
JOIN (SELECT customer_id AS train_customer_id, count(*) AS own, min(target_lat) AS target_lat, min(target_lon) AS target_lon
FROM {t}_characteristic GROUP BY 1) USING (train_customer_id) WHERE place = 1 AND {share} AND shared >= 4""", [f"{t}_characteristic", family]),
        # One round: every family has a single test customer. Chains have more, see below.
        f"{t}_final": (f"""SELECT customer_id, min({lat}) AS target_lat, min({lon}) AS target_lon FROM {family} WHERE is_train GROUP BY customer_id
UNION ALL SELECT customer_id, target_lat, target_lon FROM {t}_match""", [family, f"{t}_match"]),
    })


_blocks("home", "home_lat", "home_lon")
_blocks("work", f"({WORK_LAT})", f"({WORK_LON})")


@query(sql("SELECT lat, lon, customer_id, target_lat, target_lon FROM home_characteristic", "home_characteristic"))
def characteristic_points(spark, sf_dir):
    return propagate.characteristic_points(_sides(spark, sf_dir)[0], "home")


@query(sql("""SELECT DISTINCT v.customer_id AS test_customer_id, c.lat, c.lon, c.customer_id, c.target_lat, c.target_lon
FROM (SELECT * FROM family WHERE NOT is_train AND lat > 0) v JOIN home_characteristic c USING (lat, lon)""", "home_characteristic"))
def shared_point_join(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    return lookups.shared_point_join(test, propagate.characteristic_points(train, "home"))


@query(sql("SELECT customer_id, train_customer_id, shared, target_lat, target_lon FROM home_match", "home_match"))
def match_by_shared_points(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    return propagate.match_by_shared_points(test, propagate.characteristic_points(train, "home"))


@query(sql("SELECT customer_id, target_lat, target_lon FROM home_final", "home_final"))
def propagate_targets(spark, sf_dir):
    return propagate.propagate_targets(*_sides(spark, sf_dir), "home")


@query(sql("""SELECT customer_id, h.target_lat AS home_lat, h.target_lon AS home_lon, w.target_lat AS work_lat, w.target_lon AS work_lon
FROM home_final h FULL JOIN work_final w USING (customer_id)""", "home_final", "work_final"))
def characteristic_home_work(spark, sf_dir):
    return propagate.characteristic_home_work(*_sides(spark, sf_dir))


# Rounds of a chain: each has the table of the round before, with those it resolved as known. Four resolve someone; the fifth finds none.
ROUNDS = 5
for _i in range(ROUNDS):
    _source = f"chain_{_i}" if _i else "chain"
    _blocks(f"round_{_i}", "home_lat", "home_lon", _source, "2 * shared >= own")
    views.BLOCKS[f"chain_{_i + 1}"] = (f"""SELECT c.customer_id, c.is_train OR m.customer_id IS NOT NULL AS is_train, lat, lon,
coalesce(home_lat, target_lat) AS home_lat, coalesce(home_lon, target_lon) AS home_lon FROM {_source} c LEFT JOIN round_{_i}_match m ON m.customer_id = c.customer_id""",
                                        [_source, f"round_{_i}_match"])


@query(sql(f"""SELECT customer_id, min(home_lat) AS target_lat, min(home_lon) AS target_lon FROM chain_{ROUNDS} WHERE is_train GROUP BY customer_id""", f"chain_{ROUNDS}"))
def propagate_targets_rounds(spark, sf_dir):
    chain = views.chain(spark, sf_dir)
    return propagate.propagate_targets(chain.filter("is_train"), chain.filter("not is_train").select("customer_id", "lat", "lon"), "home", share=0.5)
