"""Nearest points of small groups, answered in place: order of values, very many anchors, and what moves or is sorted."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import ranking
from waymark.plans import spectrum

ROW = "customer_id string, lat double, lon double, visits int"


def brute(points, x, y, k):
    """As Spark orders values: what is missing first, what is no number last."""
    def place(v):
        return (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v)

    def apart(p):
        return None if None in (x, y, p[0], p[1]) else (x - p[0]) ** 2 + (y - p[1]) ** 2
    return sorted(points, key=lambda p: (place(apart(p)), place(p[0]), place(p[1]), p[2]))[:k]


def shown(values):
    return [tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in row) for row in values]


@pytest.mark.parametrize("asking_rows", [1024, 3])
def test_order_with_ties_missing_and_odd_coordinates(spark, monkeypatch, asking_rows):
    monkeypatch.setattr(ranking, "ASKING_ROWS", asking_rows)
    rnd = random.Random(4)
    nan = float("nan")
    groups = {
        "lattice": [(float(i % 4), float(i // 4), i) for i in range(16)], "one": [(1.0, 1.0, 1)],
        "missing": [(1.0, 2.0, 1), (None, 2.0, 2), (3.0, None, 3), (0.5, 0.5, 4), (None, None, 5)],
        "odd": [(1.0, nan, 1), (2.0, 2.0, 2), (nan, nan, 3), (0.0, None, 4)],
        "random": [(rnd.random(), rnd.random(), i) for i in range(40)], None: [(1.0, 1.0, 1), (2.0, 2.0, 2)],
    }
    df = spark.createDataFrame([(g, *p) for g, points in groups.items() for p in points], ROW)
    anchors = [(g, *p[:2]) for g, points in groups.items() for p in points] + [("random", 0.0, 9.0), ("nobody", 0.0, 0.0)]
    asked = spark.createDataFrame(anchors, "customer_id string, lat double, lon double")
    got = {}
    for r in ranking.nearest_points_k(asked, df, 3, keep=["visits"], before=True).sort("rank").collect():
        found = got.setdefault(shown([(r["customer_id"], r["lat"], r["lon"])])[0], [])
        assert r["rank"] == len(found) + 1
        assert shown([(r["before_lat"], r["before_lon"])]) == shown([found[-1][:2] if found else (None, None)])
        found.append((r["near_lat"], r["near_lon"], r["visits"]))
    want = {shown([(g, x, y)])[0]: shown(brute(groups[g], x, y, 3)) for g, x, y in anchors if g in groups and g}
    assert {a: shown(v) for a, v in got.items()} == want


@pytest.mark.parametrize("plain_rows", [128, 4])
def test_steps_are_the_same_with_and_without_the_point_before(spark, plain_rows):
    rnd = random.Random(5)
    df = spark.createDataFrame([(rnd.choice("abc"), rnd.random(), rnd.random(), i) for i in range(60)], ROW)
    one, two = (ranking.consecutive_distance(ranking.nearest_points_k(df, df, 5, keep=["visits"], plain_rows=plain_rows, before=b)) for b in (False, True))
    assert one.columns == two.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_small_groups_are_neither_ranked_by_windows_nor_joined(spark, tmp_path):
    spark.createDataFrame([("a", float(i), 0.0, i + 1) for i in range(6)], ROW).write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    steps = ranking.consecutive_distance(ranking.nearest_points_k(df, df, 5, keep=["visits"], before=True))
    for out in (steps, spectrum.point_spectrum(df, df), spectrum.point_spectrum(df.filter("lat > 1"), df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan


def test_spectrum_keeps_columns_of_its_anchors(spark, monkeypatch):
    df = spark.createDataFrame([(c, float(i), 0.0, i + 1) for c in "ab" for i in range(6 if c == "a" else 9)], ROW)
    anchors = df.select("customer_id", "lat", "lon", (F.col("lat") > 3).alias("far"))
    lists = ranking.nearest_lists
    monkeypatch.setattr(spectrum, "nearest_lists", lambda *a: lists(*a, plain_rows=7))
    both = sorted(map(tuple, spectrum.point_spectrum(anchors, df, ["far"]).collect()))
    monkeypatch.setattr(spectrum, "nearest_lists", lists)
    assert both == sorted(map(tuple, spectrum.point_spectrum(anchors, df, ["far"]).collect()))
    assert len(both) == 15 and all(r[3] == (r[1] > 3) for r in both)
