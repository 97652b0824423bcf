import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from waymark.llm import mixing


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in held]
        level = (total - sum(3 * sizes[s] for s in held)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in held else weight[s] * level for s in order}
        held |= over


@pytest.mark.parametrize("bins", [4096, 1, 3])
def test_targets_and_words_taken(odd, bins):
    rows = mixing.mix(odd, mixing.MixRules(bins=bins)).collect()
    assert len(rows) == odd.count()
    sizes, taken, largest, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    want = water(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 for s in sizes) and all(r["source_size"] == sizes[r["source"]] for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in sizes)


def test_many_sources_with_limits(spark):
    rng = random.Random(2)
    sizes = {f"s{i}": int(rng.paretovariate(0.7)) for i in range(200)} | {None: 5, "z": 0, "é": 3}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size bigint").repartition(7)
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = water(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())


def test_reruns_agree_and_heavy_weights_come_first(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a" + "b"), F.lit(" c")).alias("text"), F.when(F.col("id") % 3 < 2, "big").otherwise("few").alias("source"))
    weight = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    first = mixing.mix(docs, weight=weight).collect()
    assert sorted(first) == sorted(mixing.mix(docs.repartition(5), weight=weight).collect())
    taken = [sum(r["taken"] for r in first if r["source"] == "big" and r["doc_id"] % 2 == k) for k in (0, 1)]
    assert taken[0] > 1.5 * taken[1] > 0


def test_crowded_bins_are_cut_until_few_rows_are_sorted(spark):
    """Texts of numbers weigh 0.1, so nearly half of a source falls into the last of the first bins."""
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("123 456"), F.col("id"), F.when(F.col("id") % 5 == 0, "7 8 9")).alias("text"),
        F.when(F.col("id") % 3 < 2, "a").otherwise("b").alias("source"))
    docs = docs.unionByName(docs.filter("doc_id < 300")).unionByName(docs.filter("doc_id = 7").select("doc_id", "text", F.lit("c").alias("source")))
    want = {}
    keyed = mixing._measured(docs, mixing.MixRules(), None).collect()
    got = [sorted(mixing.mix(docs, mixing.MixRules(bins=bins, sorted_rows=rows)).collect()) for bins, rows in ((4096, 10 ** 9), (4096, 16), (64, 1))]
    assert got[0] == got[1] == got[2]
    for source in "abc":
        own = sorted((r["_key"], r["doc_id"], r["_tie"], r["_size"]) for r in keyed if r["source"] == source)
        target = next(r["target"] for r in got[0] if r["source"] == source)
        size, total = sum(r[3] for r in own), 0
        rest = target - int(target // size) * size
        for _, doc_id, _, n in own:
            want.setdefault((source, doc_id), []).append(n * (int(target // size) + (rest > 0 and total + n / 2 <= rest)))
            total += n
    found = {}
    for r in got[0]:
        found.setdefault((r["source"], r["doc_id"]), []).append(r["taken"])
    # Equal rows are ordered at will, but all that equal the last one taken are taken.
    assert sum(sorted(found[k]) != sorted(want[k]) for k in want) <= 3


def test_mixture_keeps_columns(odd, nothing):
    out = mixing.mixture(odd)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "print", "key", "row", "size", "source_size", "target", "taken"]
    want = [r for r in mixing.mix(odd).collect() if r["taken"] > 0]
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in out.collect()) == sorted((r["doc_id"] or -1, r["taken"]) for r in want)
    assert mixing.mix(nothing).count() == 0 and mixing.mixture(nothing).count() == 0
