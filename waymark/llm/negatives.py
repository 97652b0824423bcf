"""Hard negatives by exact inner products, multiplied by Strassen's recursion.

Vectors are made integers: floor(256 * x). An anchor's positives are the best other rows of its label; the negatives of an
anchor and a positive are the best rows of other labels whose score lies within a window below the positive's.

Anchors are dealt into tiles of bounded size, candidates into shards; a task streams the candidates of one shard past one
tile of anchors. Blocks of both are multiplied by Strassen's recursion on 64-bit integers, padded with zeros to even sides.
Its additions are exact, as integers modulo 2 ** 64 form a ring: only the scores themselves have to fit. Every anchor carries a
heap of its best k in the task, and heaps of several tasks merge by one ranking of k rows each. The first pass makes the
heaps of positives, within the rows of one label; the second pass makes one heap for each positive's window, among all rows.

Rows with a null id, a null label, a null vector, or any null or non-finite component take no part. Vectors meet those of their own length
only. Ties go to the smaller id. Repeated rows are candidates of their own, but no row with the anchor's id is its positive or
negative; an anchor that is repeated with the same label and vector is answered once. Components of 2 ** 62 and more as
integers, and vectors whose products may not fit in 64 bits, raise an error. An empty table has no rows in its result, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.common import small, travels
from waymark.materialize import Written

travels(__name__)

NONE = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max
#: Products of doubles are exact below this.
EXACT = 2.0 ** 53


@dataclass(frozen=True)
class MiningRules:
    """`low` and `high` bound a negative's score in percent of the positive's. The other numbers lay out the work only."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    every: int = 50
    scale: float = 256.0
    anchor_rows: int = 8_192
    shard_rows: int = 8_192
    most_shards: int = 64
    tile: tuple[int, int] = (512, 4_096)
    leaf: int = 32


def usable(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, v, dim) with integer components."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)))
    present = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return vectors.filter(present).filter(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"), F.size("embedding").alias("dim"))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two matrices of 64-bit integers; by doubles where no partial sum can be rounded."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if 0 <= largest < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _even(a: np.ndarray) -> np.ndarray:
    rows, columns = a.shape[0] % 2, a.shape[1] % 2
    return np.pad(a, ((0, rows), (0, columns))) if rows or columns else a


def strassen(a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """The product of two matrices of 64-bit integers by seven products of their quarters, down to sides of `leaf`."""
    m, n = a.shape[0], b.shape[1]
    if min(m, n, a.shape[1]) <= leaf:
        return _product(a, b)
    a, b = _even(a), _even(b)
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of each row of two matrices, ties to the smaller id; NONE and NO_ID fill up."""
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


class Heaps:
    """A tile of anchors, each with the best `k` candidates of every slot: scores from `low` to `high` of the slot."""

    def __init__(self, anchors: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray, k: int, same: bool, rules: MiningRules):
        self.anchors, self.low, self.high, self.k, self.same, self.rules = anchors, low, high, k, same, rules
        self.score = np.full((*low.shape, k), NONE, np.int64)
        self.id = np.full((*low.shape, k), NO_ID, np.int64)
        self.weight = float(np.abs(anchors["v"].astype(np.float64)).sum(axis=1).max(initial=0))

    def meet(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        """Candidates in the order of their ids."""
        if self.weight * float(np.abs(v).max(initial=0)) >= 2.0 ** 62:
            raise OverflowError("inner products of these vectors do not fit in 64 bits")
        rows, columns = self.rules.tile
        for c in range(0, len(ids), columns):
            there = slice(c, c + columns)
            for a in range(0, len(self.low), rows):
                here = slice(a, a + rows)
                score = strassen(self.anchors["v"][here], np.ascontiguousarray(v[there].T), self.rules.leaf)
                fit = (self.anchors["label"][here, None] == labels[there]) == self.same
                fit &= self.anchors["vec_id"][here, None] != ids[there]
                for slot in range(self.low.shape[1]):
                    inside = fit & (score >= self.low[here, slot, None]) & (score <= self.high[here, slot, None])
                    self._keep(a, slot, np.where(inside, score, NONE), ids[there])

    def _keep(self, start: int, slot: int, score: np.ndarray, ids: np.ndarray) -> None:
        top = score.max(axis=1, initial=NONE)
        rows = np.flatnonzero((top > NONE) & (top >= self.score[start:start + len(score), slot, -1]))
        if not len(rows):
            return
        score, at = score[rows], np.arange(len(rows))
        found, whose = np.full((len(rows), self.k), NONE, np.int64), np.full((len(rows), self.k), NO_ID, np.int64)
        for place in range(min(self.k, score.shape[1])):
            # The first of equal scores has the smallest id.
            best = score.argmax(axis=1)
            found[:, place] = score[at, best]
            whose[:, place] = np.where(found[:, place] > NONE, ids[best], NO_ID)
            score[at, best] = NONE
        rows += start
        self.score[rows, slot], self.id[rows, slot] = best_of(
            np.concatenate((self.score[rows, slot], found), axis=1), np.concatenate((self.id[rows, slot], whose), axis=1), self.k)

    def rows(self) -> pa.RecordBatch:
        row, slot, place = np.nonzero(self.score > NONE)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.anchors["own"][row]), pa.array(slot.astype(np.int32)), pa.array(self.id[row, slot, place]), pa.array(self.score[row, slot, place])],
            ["own", "slot", "vec_id", "score"])


UNIT = ["dim", "grp", "tile", "shard"]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dim)
    if (np.abs(v) >= 2 ** 62).any() or (v == NONE).any():
        raise OverflowError("a component does not fit in 62 bits")
    return v


def _windows(scores: list[list[int]], rules: MiningRules) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the negatives' scores for each positive of each anchor; empty windows where there is none."""
    low, high = np.full((len(scores), rules.positives), 1, np.int64), np.zeros((len(scores), rules.positives), np.int64)
    for row, own in enumerate(scores):
        for slot, score in enumerate(own):
            low[row, slot], high[row, slot] = -(-rules.low * score // 100), rules.high * score // 100
    return low, high


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of a batch with the same unit and kind of row."""
    keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*UNIT, "candidate"]])
    starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else []
    for start, end in zip(starts, [*starts[1:], len(keys)]):
        yield tuple(int(x) for x in keys[start]), batch.slice(start, end - start)


def _mine(batches: Iterator[pa.RecordBatch], rules: MiningRules, same: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit, the anchors of each before its candidates -> the heaps of each unit."""
    unit, waiting, heaps = None, [], None

    def made() -> Heaps:
        anchors = {c: np.concatenate([w[c] for w in waiting]) for c in ("own", "vec_id", "label", "v")}
        if same:
            low, high = np.full((len(anchors["own"]), 1), NONE + 1, np.int64), np.full((len(anchors["own"]), 1), NO_ID, np.int64)
        else:
            low, high = _windows([x for w in waiting for x in w["scores"]], rules)
        return Heaps(anchors, low, high, rules.positives if same else rules.negatives, same, rules)

    for batch in batches:
        for (*key, candidate), part in _runs(batch):
            if key != unit:
                if heaps is not None:
                    yield heaps.rows()
                unit, waiting, heaps = key, [], None
            columns = {c: part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("own", "vec_id", "label")}
            columns["v"] = _matrix(part.column("v"), key[0])
            if not candidate:
                waiting.append(columns | {"scores": part.column("scores").to_pylist()})
            elif waiting:
                heaps = heaps or made()
                heaps.meet(columns["vec_id"], columns["label"], columns["v"])
    if heaps is not None:
        yield heaps.rows()


def _heaps(anchors: DataFrame, candidates: DataFrame, shards: int, rules: MiningRules, same: bool) -> DataFrame:
    """(own, slot, vec_id, score) of each unit. Anchors have (own, vec_id, label, v, dim, scores); groups are labels or, for the windows, all rows."""
    grp = F.col("label") if same else F.lit(0).cast("long")
    anchors, candidates = anchors.withColumn("grp", grp), candidates.withColumn("grp", grp)
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    # One row for each group and shard, so that a shuffle join on it, where it's too long to broadcast, has no hot key.
    tiles = anchors.groupBy("dim", "grp").agg(F.ceil(F.count(F.lit(1)) / rules.anchor_rows).cast("int").alias("tiles"))
    tiles = small(tiles.select("dim", "grp", "tiles", every))
    key = ["dim", "grp", "shard"]
    dealt = anchors.withColumn("shard", F.pmod(F.xxhash64("own"), F.lit(shards)).cast("int")).join(tiles, key)
    left = dealt.withColumn("tile", F.pmod(F.xxhash64("own", F.lit(1)), "tiles").cast("int")).drop("shard").select(
        "dim", "grp", "tile", every, F.lit(0).alias("candidate"), "own", "vec_id", "label", "v", "scores")
    right = candidates.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")).join(tiles, key).select(
        "dim", "grp", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "shard", F.lit(1).alias("candidate"),
        F.lit(0).cast("long").alias("own"), "vec_id", "label", "v", F.lit(None).cast("array<bigint>").alias("scores"))
    return (
        left.unionByName(right).repartition(*UNIT).sortWithinPartitions(*UNIT, "candidate", "vec_id")
        .mapInArrow(lambda b: _mine(b, rules, same), "own long, slot int, vec_id long, score long")
    )


def _best(heaps: DataFrame, k: int) -> DataFrame:
    """The heaps of all units, merged."""
    order = W.partitionBy("own", "slot").orderBy(F.desc("score"), "vec_id")
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, rules: MiningRules = MiningRules()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows whose id is divisible by `every`.

    `vectors` has vec_id, embedding and label. Ranks count the negatives of an anchor and a positive from 1.
    """
    points = Written(usable(vectors, rules.scale))
    shards = max(1, min(rules.most_shards, -(-points.df.count() // rules.shard_rows)))
    anchors = points.df.filter(F.col("vec_id") % rules.every == 0).distinct().withColumn("own", F.monotonically_increasing_id())
    anchors = Written(anchors.withColumn("scores", F.lit(None).cast("array<bigint>")))
    positives = _best(_heaps(anchors.df, points.df, shards, rules, same=True), rules.positives)
    mine = F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), "score"))).alias("mine")
    # At most `positives` to an anchor.
    paired = Written(anchors.df.drop("scores").join(positives.groupBy("own").agg(mine), "own").withColumn("scores", F.col("mine.score")))
    negatives = _best(_heaps(paired.df, points.df, shards, rules, same=False), rules.negatives)
    mined = F.element_at("mine", F.col("slot") + 1)
    return paired.df.select("own", F.col("vec_id").alias("anchor_id"), "mine").join(negatives, "own").select(
        "anchor_id", mined["positive_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        mined["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def mined_sql(relabel: str) -> str:
    """Checking SQL. `relabel` is the label of a row as SQL over vec_id and label."""
    return f"""
WITH points AS (
  SELECT row_number() OVER () AS row, vec_id, {relabel} AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.row, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM points a JOIN points c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
positives AS (
  SELECT anchor_id, row, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.row ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
    n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT * FROM ranked WHERE rank <= 3
"""
