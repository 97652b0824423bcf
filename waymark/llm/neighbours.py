"""Exact top-k by inner product, with a KD-tree for each shard.

Vectors are made integers: floor(256 * x). Shards of bounded size are dealt by a hash of the id and indexed: the points are
split at the median of the widest dimension until leaves are small, and every leaf keeps its tight bounding box. The index
is written once.

Queries are looked for in blocks. For a query q and a box [low, high] no inner product exceeds sum(max(q * low, q * high)).
A query visits the leaves of a shard by that bound, best first, and stops below its kth score. That score is propagated: a
first pass over one shard gives each query a kth score, and the second pass over all other shards starts with it. Ties go to
the smaller id, so only boxes strictly below the kth score are left out.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id or with components
beyond 2 ** 62 as integers. Vectors meet those of
their own length only. Repeated ids are candidates of their own; a query that is repeated is answered once for each distinct vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.common import travels
from waymark.materialize import Written

travels(__name__)


@dataclass(frozen=True)
class SearchRules:
    k: int = 5
    every: int = 50
    scale: float = 256.0
    shard_rows: int = 8_192
    leaf_rows: int = 64
    query_rows: int = 2_048


def usable(vectors: DataFrame, rules: SearchRules) -> DataFrame:
    """(vec_id, v, dim) with integer components."""
    big = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(rules.scale)))
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(2.0 ** 62 / rules.scale)), F.lit(False)))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), big.alias("v"), F.size("embedding").alias("dim"))


def leaves_of(points: np.ndarray, leaf_rows: int) -> list[np.ndarray]:
    """Rows of each leaf of a KD-tree: median splits of the dimension in which the box is widest."""
    open_, leaves = [np.arange(len(points))], []
    while open_:
        rows = open_.pop()
        own = points[rows]
        width = own.max(axis=0) - own.min(axis=0) if points.shape[1] else np.zeros(0)
        if len(rows) <= leaf_rows or not width.size or width.max() == 0:
            leaves += [rows[i:i + leaf_rows] for i in range(0, len(rows), leaf_rows)]
            continue
        order = np.argpartition(own[:, int(width.argmax())], len(rows) // 2)
        open_ += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return leaves


def _index(batches: Iterator[pa.RecordBatch], leaf_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, dim, vec_id, v), sorted by shard and dim -> one row for each tree: ids, points and boxes, leaf by leaf."""
    held: list[tuple] = []
    key = None

    def built() -> pa.RecordBatch:
        points = np.array([r[3] for r in held], np.int64).reshape(len(held), key[1])
        ids = np.array([r[2] for r in held], np.int64)
        leaves = leaves_of(points, leaf_rows)
        order = np.concatenate(leaves)
        low, high = (np.array([f(points[rows], axis=0) for rows in leaves]).reshape(len(leaves), key[1]) for f in (np.min, np.max))
        ends = np.cumsum([len(x) for x in leaves])
        return pa.RecordBatch.from_arrays([
            pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()),
            *[pa.array([np.ascontiguousarray(x, np.int64).tobytes()]) for x in (ids[order], points[order], ends, low, high)]],
            ["shard", "dim", "ids", "points", "ends", "low", "high"])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:2] != key and held:
                yield built()
                held = []
            key = row[:2]
            held.append(row)
    if held:
        yield built()


def top_of(q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, tree: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score) of at least the best k of a tree with a score of `least` or more, for each query."""
    # Products of large components must not be rounded.
    kind = np.float64 if np.abs(q).max(initial=0) * max(1, np.abs(tree["points"]).max(initial=0)) * max(1, q.shape[1]) < 2 ** 53 else np.int64
    q, points, low, high = (x.astype(kind) for x in (q, tree["points"], tree["low"], tree["high"]))
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    least = least.astype(kind)
    best_score = np.full((len(q), k), np.iinfo(np.int64).min, np.int64)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    starts = np.concatenate(([0], tree["ends"][:-1]))
    live = np.arange(len(q))
    for step in range(bound.shape[1]):
        live = live[bound[live, order[live, step]] >= least[live]]
        if not len(live):
            break
        leaf = order[live, step]
        by_leaf = np.argsort(leaf, kind="stable")
        for group in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
            who, one = live[group], leaf[group[0]]
            rows = slice(starts[one], tree["ends"][one])
            score = np.rint(q[who] @ points[rows].T).astype(np.int64) if kind is np.float64 else q[who] @ points[rows].T
            ids = np.broadcast_to(tree["ids"][rows], score.shape)
            score = np.where(ids == q_ids[who, None], np.iinfo(np.int64).min, score)
            ids = np.where(score == np.iinfo(np.int64).min, np.iinfo(np.int64).max, ids)
            score, ids = np.concatenate((best_score[who], score), axis=1), np.concatenate((best_id[who], ids), axis=1)
            top = np.lexsort((ids, -score.astype(np.float64) if kind is np.float64 else ~score), axis=1)[:, :k]
            best_score[who], best_id[who] = np.take_along_axis(score, top, 1), np.take_along_axis(ids, top, 1)
        kth = best_score[live, k - 1]
        least[live] = np.maximum(least[live], np.where(kth == np.iinfo(np.int64).min, least[live], kth))
    row, column = np.nonzero(best_score > np.iinfo(np.int64).min)
    return row, best_id[row, column], best_score[row, column]


def _search(batches: Iterator[pa.RecordBatch], rules: SearchRules) -> Iterator[pa.RecordBatch]:
    """Rows (shard, dim, block, tree or null, query_id, v, least), the tree first in each (shard, dim, block)."""
    tree, key, held = None, None, []

    def answered() -> pa.RecordBatch:
        q = np.array([r[1] for r in held], np.int64).reshape(len(held), key[1])
        ids = np.array([r[0] for r in held], np.int64)
        least = np.array([np.iinfo(np.int64).min // 2 if r[2] is None else r[2] for r in held], np.int64)
        row, vec, score = top_of(q, ids, least, tree, rules.k)
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(vec), pa.array(score), pa.array(np.array([r[3] for r in held], np.int64)[row])], ["query_id", "vec_id", "score", "own"])

    for batch in batches:
        for shard, dim, block, index, query, v, least, own in zip(*[c.to_pylist() for c in batch.columns]):
            if (shard, dim, block) != key or len(held) >= rules.query_rows:
                if held and tree is not None:
                    yield answered()
                held = []
                if (shard, dim, block) != key:
                    tree, key = None, (shard, dim, block)
            if index is not None:
                tree = {c: np.frombuffer(x, np.int64) for c, x in index.items()}
                for c, rows in (("points", "ids"), ("low", "ends"), ("high", "ends")):
                    tree[c] = tree[c].reshape(len(tree[rows]), dim)
            else:
                held.append((query, v, least, own))
    if held and tree is not None:
        yield answered()


def _answers(trees: DataFrame, queries: DataFrame, rules: SearchRules) -> DataFrame:
    """Best k of each query in each (shard, dim) that it names."""
    blocks = queries.select("shard", "dim", "block").distinct()
    index = F.struct("ids", "points", "ends", "low", "high").alias("index")
    left = trees.join(blocks, ["shard", "dim"]).select(
        "shard", "dim", "block", index, *[F.lit(None).cast(t).alias(c) for c, t in (("query_id", "long"), ("v", "array<bigint>"), ("least", "long"), ("own", "long"))])
    right = queries.select("shard", "dim", "block", F.lit(None).cast(left.schema["index"].dataType).alias("index"), "query_id", "v", "least", "own")
    return (
        left.unionByName(right).repartition("shard", "dim", "block")
        .sortWithinPartitions("shard", "dim", "block", F.col("index").isNull())
        .mapInArrow(lambda b: _search(b, rules), "query_id long, vec_id long, score long, own long")
    )


def _best(answers: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("own").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, rules: SearchRules = SearchRules()) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by `every`, its `k` highest scores among all other rows."""
    points = Written(usable(vectors, rules)).df
    # One row for each length of vectors.
    sizes = {r["dim"]: max(1, math.ceil(r["count"] / rules.shard_rows)) for r in points.groupBy("dim").count().collect()}
    if not sizes:
        return points.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).filter(F.lit(False))
    shards = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("dim"))
    points = points.withColumn("shards", shards)
    tree_rows = points.select(F.pmod(F.xxhash64("vec_id", "v"), "shards").cast("int").alias("shard"), "dim", "vec_id", "v")
    trees = Written(tree_rows.repartition("shard", "dim").sortWithinPartitions("shard", "dim").mapInArrow(
        lambda b: _index(b, rules.leaf_rows), "shard int, dim int, ids binary, points binary, ends binary, low binary, high binary")).df
    asked = points.filter(F.col("vec_id") % rules.every == 0).dropDuplicates(["vec_id", "v"]).withColumn("own", F.xxhash64("vec_id", "v"))
    blocks = max(1, math.ceil(asked.count() / rules.query_rows))
    asked = Written(asked.select(F.col("vec_id").alias("query_id"), "v", "dim", "shards", "own", F.pmod("own", F.lit(blocks)).alias("block"),
                                 F.pmod(F.xxhash64("own"), "shards").cast("int").alias("home"))).df
    first = Written(_answers(trees, asked.withColumn("shard", F.col("home")).withColumn("least", F.lit(None).cast("long")), rules)).df
    known = first.groupBy("own").agg(F.when(F.count(F.lit(1)) >= rules.k, F.min("score")).alias("least"))
    rest = asked.join(known, "own", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).filter("shard <> home")
    return _best(first.unionByName(_answers(trees, rest, rules)), rules.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
