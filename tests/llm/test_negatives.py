import math
import random

import numpy as np
import pytest

from waymark.llm import negatives


def brute(rows, rules):
    points = [(n, i, label, tuple(math.floor(256 * x) for x in v)) for n, (i, label, v) in enumerate(rows)
              if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in {p[1:] for p in points if p[1] % rules.every == 0}:
        scored = [(-sum(x * y for x, y in zip(v, w)), i, n, other) for n, i, other, w in points if i != a and len(w) == len(v)]
        for s, p, n, _ in sorted(x for x in scored if x[3] == label)[:rules.positives]:
            inside = sorted((t, i) for t, i, _, other in scored if other != label and rules.low * -s <= 100 * -t <= rules.high * -s)
            out += [(a, p, rank, i, -s, -t) for rank, (t, i) in enumerate(inside[:rules.negatives], 1)]
    return sorted(out)


def rows():
    rng = random.Random(4)
    out = [(i, rng.choice([0, 0, 0, 1, 2, 3]), [rng.gauss(0.3, 1) for _ in range(7)]) for i in range(260)]
    # Equal vectors under other ids and labels, a repeated row and a repeated anchor, an id with two vectors.
    out += [(300 + i, i % 3, out[i][2]) for i in range(30)] + [out[3], out[50], (51, 0, out[9][2]), (100, 2, out[8][2])]
    out += [(350, None, [1.0] * 7), (351, 1, None), (352, 1, [1.0, None] + [0.0] * 5), (400, 1, [float("nan")] * 7), (450, 1, [float("-inf")] * 7), (None, 1, [1.0] * 7)]
    return out + [(500, 1, [2.0, 1.0]), (501, 1, [2.0, 3.0]), (502, 0, [1.0, 2.0]), (550, 1, []), (551, 1, []), (552, 2, []), (600, 9, [0.5] * 7), (650, 0, [0.0] * 7)]


@pytest.mark.parametrize("rules", [
    negatives.MiningRules(), negatives.MiningRules(every=10, anchor_rows=7, shard_rows=40, tile=(3, 5), leaf=1),
    negatives.MiningRules(positives=2, negatives=6, low=-50, high=120, every=25, shard_rows=30, most_shards=3, tile=(8, 16), leaf=2)])
def test_hard_negatives_equal_brute_force(spark, rules):
    df = spark.createDataFrame([(i, v, label, "x", 1, [2]) for i, label, v in rows()], "vec_id long, embedding array<double>, label int, tile string, own int, scores array<int>")
    got = negatives.hard_negatives(df.repartition(5), rules)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows(), rules)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_one_label_and_empty_table(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0], 3) for i in range(60)], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(df).count() == 0
    assert negatives.hard_negatives(df.limit(0)).count() == 0
    # All scores equal: the window above decides, ties go to the smaller id.
    mixed = [(i, i % 2, [1.0, 1.0]) for i in range(60)]
    wide = negatives.MiningRules(high=100)
    got = negatives.hard_negatives(spark.createDataFrame(mixed, "vec_id long, label int, embedding array<float>"), wide)
    assert sorted(tuple(r) for r in got.collect()) == brute(mixed, wide)


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (64, 64, 64), (33, 65, 130), (2, 0, 3), (0, 4, 5)])
@pytest.mark.parametrize("size", [100, 2 ** 20, 2 ** 30, 2 ** 62])
def test_strassen_is_exact(shape, size):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-size, size, shape[:2]), rng.integers(-size, size, shape[1:])
    # Modulo 2 ** 64, as all intermediate sums are.
    exact = (a.astype(object) @ b.astype(object)) if shape[1] else np.zeros((shape[0], shape[2]), object)
    wrapped = np.array([[(int(x) + 2 ** 63) % 2 ** 64 - 2 ** 63 for x in row] for row in exact], object).reshape(exact.shape)
    for leaf in (1, 8):
        assert (negatives.strassen(a, b, leaf).astype(object) == wrapped).all()


def test_scores_beyond_64_bits_raise(spark):
    df = spark.createDataFrame([(i, [1e9 * 2 ** 20, 1.0], i % 2) for i in range(60)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits"):
        negatives.hard_negatives(df).collect()
