"""Top rows per group, sampling and splitting.

Whole groups are never gathered: arg-max is a plain aggregate with partial results, and `row_number() <= k`
keeps at most k rows per group in every task before the shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import geo
from waymark.materialize import cut_lineage
from waymark.operators import celltree
from waymark.operators.blocks import BLOCK_SIZE, TREE_ROWS, fields, meet, split_crowded
from waymark.sources.lines import add_row_id

# Executors need not have this package: the functions below travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points of a group that are held as one array.
PLAIN_ROWS = 128
#: Anchors of a group that are held with them.
ASKING_ROWS = 8 * PLAIN_ROWS
#: Distances that one step holds.
STEP_PAIRS = 1 << 19


def best_point_per_customer(scored: DataFrame, score: str = "score", keep: Sequence[str] = ()) -> DataFrame:
    """The point with the highest score of each customer, smaller latitude and longitude first on ties."""
    best = F.min(F.struct((-F.col(score)).alias("_low"), "lat", "lon", *keep)).alias("_best")
    return scored.groupBy("customer_id").agg(best).select(
        "customer_id", "_best.lat", "_best.lon", (-F.col("_best._low")).alias(score), *[f"_best.{c}" for c in keep]
    )


def top1_hit_rate(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Share of customers whose best point carries the label."""
    return best_point_per_customer(scored, score, [label]).agg(F.avg(label).alias("hit_rate"))


def visit_counts(tx: DataFrame, by: Sequence[str] = ("customer_id",)) -> DataFrame:
    return tx.groupBy(*by, "lat", "lon").agg(F.count(F.lit(1)).alias("visits"))


def nearest_points_k(anchors: DataFrame, points: DataFrame, k: int = 5, by: Sequence[str] = ("customer_id",),
                     keep: Sequence[str] = (), plain_rows: int = PLAIN_ROWS, tree_rows: int = TREE_ROWS,
                     leaf_rows: int = celltree.LEAF_ROWS, before: bool = False) -> DataFrame:
    """For each anchor its k nearest distinct points in the same group, itself included.

    Result: `by`, lat, lon of the anchor, rank, near_lat, near_lon, d2 and `keep` of the near point; with `before` also
    before_lat and before_lon, the near point of the rank before. A group of up to `plain_rows`
    points is one array, in which all its anchors are answered. In larger ones each pair of blocks gives its own k nearest, and a last ranking
    merges them. Groups beyond `tree_rows` become trees of cells first: cells that hold k points bound the kth distance, and a
    leaf of anchors meets the leaves within that bound only.
    """
    by, keep = list(by), list(keep)
    lists, rest = nearest_lists(anchors, points, k, by, keep, plain_rows=plain_rows, tree_rows=tree_rows, leaf_rows=leaf_rows)
    at, near = F.col("_place"), F.col("_near")
    earlier = F.get("_found", at - 1)
    found = lists.select(*by, "lat", "lon", "_found", F.posexplode("_found").alias("_place", "_near")).select(
        *by, "lat", "lon", geo.squared_distance(F.col("lat"), F.col("lon"), near["near_lat"], near["near_lon"]).alias("d2"), "_near.*", (at + 1).alias("rank"),
        *([earlier[c].alias(c.replace("near", "before")) for c in ("near_lat", "near_lon")] if before else []))
    if rest is None:
        return found
    return found.unionByName(_with_before(rest, by) if before else rest)


def _with_before(ranked: DataFrame, by: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*by, "lat", "lon").orderBy("rank")
    return ranked.withColumns({c.replace("near", "before"): F.lag(c).over(order) for c in ("near_lat", "near_lon")})


def nearest_lists(anchors: DataFrame, points: DataFrame, k: int, by: Sequence[str], keep: Sequence[str] = (), also: Sequence[str] = (),
                  totals: Sequence[Column] = (), plain_rows: int = PLAIN_ROWS, tree_rows: int = TREE_ROWS,
                  leaf_rows: int = celltree.LEAF_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(the anchors in groups of up to `plain_rows` points, ranked rows as `nearest_points_k` gives them for those in larger groups, or None without any).

    The first has one row for each anchor: `by`, lat, lon, `also` of the anchor, `totals` (aggregates of the group's points) and
    `_found`, the k nearest in order as (near_lat, near_lon, `keep`). Anchors and points of a group move once and meet in
    place. Groups with very many anchors are joined to their points instead, one row for each anchor.
    """
    by, keep, also = list(by), list(keep), list(also)
    # Points and anchors each are distinct.
    near = points.select(*by, F.col("lat").alias("near_lat"), F.col("lon").alias("near_lon"), *keep)
    asking = anchors.select(*by, "lat", "lon", *also)
    plain, crowded = split_crowded(near, by, plain_rows)
    few, many = (plain.withColumnsRenamed({"near_lat": "lat", "near_lon": "lon"}).select(asking.columns), None) if anchors is points and set(also) <= set(keep) \
        else split_crowded(asking, by, ASKING_ROWS)
    near_row, ask_row = F.struct("near_lat", "near_lon", *keep), F.struct("lat", "lon", *also)
    held = plain.select(*by, near_row.alias("_p"), F.lit(None).cast(few.select(ask_row.alias("x")).schema["x"].dataType).alias("_a"))
    asked = few.select(*by, F.lit(None).cast(plain.select(near_row.alias("x")).schema["x"].dataType).alias("_p"), ask_row.alias("_a"))
    sums = [*totals]
    together = held.unionByName(asked).dropna(subset=by).repartition(*by).select("*", "_p.*")
    groups = together.groupBy(*by).agg(F.array_sort(F.collect_list("_p")).alias("_all"), F.collect_list("_a").alias("_ask"), *sums).filter("size(_all) > 0")
    names = [c for c in groups.columns if c not in (*by, "_all", "_ask")]

    picks = array_nearest(*[F.col(c) for c in ("_ask.lat", "_ask.lon", "_all.near_lat", "_all.near_lon")], k)
    # Where a coordinate is missing or no number, Spark's order of values decides.
    odd = F.exists("_ask", lambda a: _odd(a["lat"], a["lon"])) | F.exists("_all", lambda p: _odd(p["near_lat"], p["near_lon"]))
    width = F.least(F.lit(k), F.size("_all"))
    answered = F.transform("_ask", lambda a, i: F.struct(a.alias("_a"), F.when(F.col("_odd"), _nearest_in_order(a["lat"], a["lon"], k)).otherwise(
        F.transform(F.slice("_picks", i * F.col("_width") + 1, F.col("_width")), lambda j: F.get("_all", j))).alias("_found")))
    ready = groups.withColumns({"_picks": picks, "_odd": odd, "_width": width})
    lists = ready.select(*by, *names, F.explode(answered).alias("_one")).select(*by, "_one._a.*", *names, "_one._found")
    if many is not None:
        arrays = plain.groupBy(*by).agg(F.collect_list(near_row).alias("_all"), *sums)
        joined = many.drop("_n_blocks").join(arrays, by).select(*by, "lat", "lon", *also, *names, _nearest_in_order(F.col("lat"), F.col("lon"), k).alias("_found"))
        lists = lists.unionByName(joined)
    if crowded is None:
        return lists, None
    asking = asking.select(*by, "lat", "lon")
    blocks, hot = split_crowded(crowded.drop("_n_blocks"), by, tree_rows)
    found = _nearest_over_blocks(asking, blocks, k, by, by, keep)
    if hot is not None:
        left, right = _leaves_within_reach(asking, hot.drop("_n_blocks"), k, by, leaf_rows)
        found = found.unionByName(_nearest_over_blocks(left, right, k, by, ["_leaf"], keep))
    return lists, found


def _odd(lat: Column, lon: Column) -> Column:
    return lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon)


def _nearest_in_order(lat: Column, lon: Column, k: int) -> Column:
    """The first k of `_all` by distance, latitude, longitude, with what is missing first."""
    measured = F.transform("_all", lambda p: F.struct(
        geo.squared_distance(lat, lon, p["near_lat"], p["near_lon"]).alias("d2"), p["near_lat"].alias("near_lat"), p["near_lon"].alias("near_lon"), p.alias("_near")))
    return F.transform(F.slice(F.array_sort(measured), 1, k), lambda f: f["_near"])


def nearest_rows(a_lat: np.ndarray, a_lon: np.ndarray, asks: np.ndarray, p_lat: np.ndarray, p_lon: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For anchors and points that come group after group, `asks` and `sizes` of them: the places within the group of each anchor's
    min(k, size) nearest points, of equally near ones the earlier, one anchor after another; and how many that are in each group."""
    width = np.minimum(sizes, k)
    first, group = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), asks)
    own = width[group]
    ends = np.cumsum(own)
    out = np.empty(ends[-1] if len(ends) else 0, dtype=np.int32)
    for n in np.unique(sizes[group]):
        rows = np.flatnonzero(sizes[group] == n)
        step = max(1, STEP_PAIRS // max(1, int(n)))
        for at in range(0, len(rows) if n else 0, step):
            some = rows[at:at + step]
            points = first[group[some]][:, None] + np.arange(n)
            d_lat, d_lon = a_lat[some][:, None] - p_lat[points], a_lon[some][:, None] - p_lon[points]
            best = np.argsort(d_lat * d_lat + d_lon * d_lon, axis=1, kind="stable")[:, :k]
            out[(ends[some] - own[some])[:, None] + np.arange(best.shape[1])] = best
    return out, width * asks


def array_nearest(a_lat: Column, a_lon: Column, p_lat: Column, p_lon: Column, k: int) -> Column:
    """`nearest_rows` of arrays, one group a row."""
    def resolve(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for columns in batches:
            asks, sizes = (columns[i].str.len().to_numpy(dtype=np.int64) for i in (0, 2))
            if not asks.sum():
                yield pd.Series([np.empty(0, dtype=np.int32)] * len(asks), dtype=object)
                continue
            y, x, lat, lon = (np.concatenate(c.to_numpy()).astype(float) for c in columns)
            found, numbers = nearest_rows(y, x, asks, lat, lon, sizes, k)
            ends = np.cumsum(numbers)
            yield pd.Series([found[end - n:end] for end, n in zip(ends, numbers)], dtype=object)

    return F.pandas_udf(resolve, "array<int>")(a_lat, a_lon, p_lat, p_lon)


def _nearest_over_blocks(asking: DataFrame, near: DataFrame, k: int, by: list[str], keys: list[str], keep: list[str]) -> DataFrame:
    """The k nearest of all points with the same `keys`, ranked, by blocks of bounded size."""
    schema = T.StructType([*fields(asking, *by, "lat", "lon"), T.StructField("d2", T.DoubleType()), *fields(near, "near_lat", "near_lon", *keep)])
    found = meet(asking, near, keys, BLOCK_SIZE, lambda p, q: nearest_in(p, q, k, list(schema.names)), schema)
    order = Window.partitionBy(*by, "lat", "lon").orderBy("d2", "near_lat", "near_lon")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _leaves_within_reach(asking: DataFrame, near: DataFrame, k: int, by: list[str], leaf_rows: int) -> tuple[DataFrame, DataFrame]:
    """Anchors with the leaf that holds them, and for each leaf the points that may be among the k nearest of its anchors."""
    near = cut_lineage(near)
    asking = asking.join(near.select(*by).distinct(), by, "left_semi").distinct()
    tree = celltree.build(celltree.two_sides(asking, near.withColumnsRenamed({"near_lat": "lat", "near_lon": "lon"}), by), by, leaf_rows)
    leaves, _ = celltree.descend(tree, by, celltree.keep_nearest(k))
    spot = tree.located.select(*by, F.col("lat").alias("near_lat"), F.col("lon").alias("near_lon"), F.col("leaf").alias("_p"))
    left = asking.join(tree.located, [*by, "lat", "lon"]).select(*by, "lat", "lon", F.col("leaf").alias("_leaf"))
    return left, leaves.join(near.join(spot, [*by, "near_lat", "near_lon"]).drop(*by), "_p").drop("_p").withColumnRenamed("_a", "_leaf")


def nearest_in(anchors: pd.DataFrame, points: pd.DataFrame, k: int, columns: list[str]) -> pd.DataFrame:
    """The k nearest of a block of points for each of a block of anchors, by distance, latitude, longitude."""
    if anchors.empty or points.empty:
        return pd.DataFrame(columns=columns)
    points = points.sort_values(["near_lat", "near_lon"], ignore_index=True)
    d_lat = anchors["lat"].to_numpy()[:, None] - points["near_lat"].to_numpy()
    d_lon = anchors["lon"].to_numpy()[:, None] - points["near_lon"].to_numpy()
    d2 = d_lat * d_lat + d_lon * d_lon
    first = np.argsort(d2, axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(len(anchors)), first.shape[1])
    own = [c for c in columns if c in anchors.columns]
    out = pd.concat([anchors[own].iloc[row].reset_index(drop=True),
                     points[[c for c in columns if c not in own and c != "d2"]].iloc[first.ravel()].reset_index(drop=True)], axis=1)
    out["d2"] = np.take_along_axis(d2, first, axis=1).ravel()
    return out[columns]


def consecutive_distance(ranked: DataFrame, by: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Squared distance of each ranked point to the one before; NULL for the first. A table that already knows the point
    before, as `nearest_points_k` tells with `before`, is neither moved nor sorted."""
    known = {"before_lat", "before_lon"} <= set(ranked.columns)
    steps = ranked if known else _with_before(ranked, by)
    step = geo.squared_distance(F.col("near_lat"), F.col("near_lon"), F.col("before_lat"), F.col("before_lon"))
    return steps.withColumn("step_d2", step).drop("before_lat", "before_lon")


def date_gaps(tx: DataFrame, by: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Days between neighbouring distinct dates. A group has no more rows here than the calendar days."""
    order = Window.partitionBy(*by).orderBy("date")
    gaps = tx.select(*by, "date").distinct().withColumn("gap_days", F.datediff("date", F.lag("date").over(order)))
    return gaps.filter(F.col("gap_days").isNotNull())


def most_visited_point(visits: DataFrame, by: Sequence[str] = ("customer_id",)) -> DataFrame:
    """For each point the most visited other point of the customer; ties to smaller coordinates.

    The two most visited points of a customer answer it for all their points.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("visits"), "lat", "lon")
    top = (
        visits.withColumn("_rank", F.row_number().over(order)).filter("_rank <= 2")
        .groupBy(*by).pivot("_rank", [1, 2])
        .agg(F.first(F.struct("lat", "lon", "visits")))
    )
    first = (F.col("lat") == F.col("`1`.lat")) & (F.col("lon") == F.col("`1`.lon"))
    other = F.when(first, F.col("2")).otherwise(F.col("1"))
    return (
        visits.select(*by, "lat", "lon").join(top, list(by)).withColumn("_other", other)
        .filter(F.col("_other").isNotNull())
        .select(*by, "lat", "lon", F.col("_other.lat").alias("top_lat"), F.col("_other.lon").alias("top_lon"),
                F.col("_other.visits").alias("top_visits"))
    )


def sort_points(points: DataFrame, name: str = "position") -> DataFrame:
    """Distinct points numbered from 0, north to south, then west to east."""
    south = points.select("lat", "lon").distinct().withColumn("_south", -F.col("lat"))
    return add_row_id(south, ["_south", "lon"], name).drop("_south")


def portable_hash(seed: int, *values: Column) -> Column:
    """An integer below 2^24, the same in every SQL engine that has md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[v.cast("string") for v in values])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("bigint")


def split_train_test(df: DataFrame, train_fraction: float, seed: int = 0, key: str = "customer_id") -> DataFrame:
    """Add `is_training`. The key decides, so a customer never is on both sides."""
    return df.withColumn("is_training", F.pmod(portable_hash(seed, F.col(key)), F.lit(1000)) < round(train_fraction * 1000))


def sample_point_per_group(points: DataFrame, seed: int = 0, by: Sequence[str] = ("customer_id",)) -> DataFrame:
    """One pseudo-random point per group: the smallest hash of its place, in millionths of a degree."""
    millionths = lambda name: F.floor(F.col(name) * 1000000 + 0.5).cast("bigint")
    draw = portable_hash(seed, *[F.col(c) for c in by], millionths("lat"), millionths("lon"))
    picked = F.min(F.struct(draw.alias("_draw"), "lat", "lon")).alias("_picked")
    return points.groupBy(*by).agg(picked).select(*by, "_picked.lat", "_picked.lon")
