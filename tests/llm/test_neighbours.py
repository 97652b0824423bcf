import math
import random

import pytest

from waymark.llm import neighbours


def brute(rows, k, every):
    points = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {p for p in points if p[0] % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in points if i != q and len(w) == len(v))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


def vectors():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(40)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6),
             (410, [1.0, 2.0]), (411, [3.0, -1.0]), (420, [0.5]), (430, []), (431, []), (440, [0.0] * 6), (450, [1e6] * 6), (460, [-1e6] * 6), (500, rows[0][1])]
    return rows


@pytest.mark.parametrize("rules", [
    neighbours.SearchRules(), neighbours.SearchRules(k=3, every=10, shard_rows=40, leaf_rows=4, query_rows=5), neighbours.SearchRules(every=1, shard_rows=90, leaf_rows=1)])
def test_top_k_equals_brute_force(spark, rules):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors()], "vec_id long, embedding array<double>, shard string, own int").repartition(5)
    got = neighbours.top_k(df, rules).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(vectors(), rules.k, rules.every)


def test_products_beyond_doubles(spark):
    rows = [(i, [float(2 ** 22 + i), float(-(2 ** 21) + 3 * i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in neighbours.top_k(df, neighbours.SearchRules(every=5, leaf_rows=3)).collect()} == brute(rows, 5, 5)


def test_equal_vectors_and_empty_table(spark):
    rows = [(i, [1.0, 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in neighbours.top_k(df, neighbours.SearchRules(every=25, shard_rows=10, leaf_rows=3)).collect()} == brute(rows, 5, 25)
    assert neighbours.top_k(df.limit(0)).count() == 0
