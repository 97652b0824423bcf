"""Joins and aggregates of points within a radius.

The distance test alone would be a nested-loop join. A grid gives it an equality key: cells
are two radii wide, so the circle of one point meets at most four of them. The probing side is
expanded to those cells, the other side sits in its own cell, and the exact test follows.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import geo
from waymark.materialize import cut_lineage
from waymark.operators import celltree
from waymark.operators.blocks import ARRAY_ROWS, BLOCK_SIZE, TREE_ROWS, arrays_of, fields, meet, split_crowded
from waymark.operators.components import array_distance_sums, array_near_counts

# Executors need not have this package: the functions below travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL_RADII = 2
#: Rows of a cell from which a join cuts it, and how often it's halved at most: a circle meets 9 x 9 of the smallest cells or so.
HOT_ROWS = 4096
MOST_LEVELS = 3


def _probe(df: DataFrame, lat: str, lon: str, radius: float) -> DataFrame:
    size = radius * CELL_RADII
    return (
        df.withColumn("_cx", F.explode(geo.cells_in_reach(F.col(lat), radius, size)))
        .withColumn("_cy", F.explode(geo.cells_in_reach(F.col(lon), radius, size)))
    )


def _placed(df: DataFrame, lat: str, lon: str, radius: float) -> DataFrame:
    size = radius * CELL_RADII
    return df.withColumn("_cx", F.floor(F.col(lat) / size)).withColumn("_cy", F.floor(F.col(lon) / size))


def _cut_cells(probe: DataFrame, placed: DataFrame, lat: tuple[str, str], lon: tuple[str, str], radius: float, by: list[str],
               hot_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the keys of a join whose cells hold about `hot_rows` rows of `placed` at most.

    A hot cell is cut into 4 ** level smaller ones, and only points near it probe at that level: those that the circle may
    meet. What still is hot then, a clump of points narrower than a cell, is dealt out by hash. The cells listed are counted,
    and broadcast where they are few.
    """
    size = radius * CELL_RADII
    keys = [*by, "_cx", "_cy"]
    rows = F.col("count") / hot_rows
    hot = cut_lineage(placed.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(
        *keys, F.least(F.ceil(F.log2(rows) / 2), F.lit(MOST_LEVELS)).cast("int").alias("_level")))
    if hot.isEmpty():
        return probe, placed, keys
    hot, cut = celltree.counted(hot), [*by, "_level", "_cx", "_cy"]
    level = F.coalesce("_level", F.lit(0))
    parts = F.expr("shiftleft(1L, coalesce(_level, 0))")
    width = F.lit(size) / parts

    def within_cell(at: str, cell: str) -> Column:
        """Indexes of the smaller cells of a cell that the circle may meet. Halving a width is exact, so none is lost to rounding."""
        reach = radius * (1 + geo.SLACK)
        low, high = F.col(cell) * parts, (F.col(cell) + 1) * parts - 1
        return F.sequence(F.greatest(low, F.floor((F.col(at) - reach) / width)), F.least(high, F.floor((F.col(at) + reach) / width)))

    placed = placed.join(hot, keys, "left").withColumns(
        {"_level": level, "_cx": F.floor(F.col(lat[1]) / width), "_cy": F.floor(F.col(lon[1]) / width)})
    probe = (
        probe.join(hot, keys, "left").withColumns({"_xs": within_cell(lat[0], "_cx"), "_ys": within_cell(lon[0], "_cy"), "_level": level})
        .withColumn("_cx", F.explode("_xs")).withColumn("_cy", F.explode("_ys")).drop("_xs", "_ys")
    )
    shares = cut_lineage(placed.filter("_level > 0").groupBy(*cut).count().filter(F.col("count") > 2 * hot_rows).select(
        *cut, F.ceil(rows).cast("int").alias("_shares")))
    shares = celltree.counted(shares)
    n = F.coalesce("_shares", F.lit(1))
    placed = placed.join(shares, cut, "left").withColumn("_share", F.pmod(F.xxhash64(lat[1], lon[1]), n).cast("int")).drop("_shares")
    probe = probe.join(shares, cut, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), n - 1))).drop("_shares")
    return probe, placed, [*cut, "_share"]


def radius_join(left: DataFrame, right: DataFrame, radius: float, *, left_on=("lat", "lon"),
                right_on=("r_lat", "r_lon"), by: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """All pairs within `radius`, also equal in the `by` columns; the left side is expanded.

    Give distinct points where rows repeat: the result is one row per pair. Cells with more than `hot_rows` rows of
    the right side are cut.
    """
    lat, lon = zip(left_on, right_on)
    probe, placed, keys = _cut_cells(_probe(left, *left_on, radius), _placed(right, *right_on, radius), lat, lon, radius, list(by), hot_rows)
    near = geo.within_radius(F.col(left_on[0]), F.col(left_on[1]), F.col(right_on[0]), F.col(right_on[1]), radius)
    return probe.join(placed, keys).filter(near).drop("_cx", "_cy", "_level", "_share")


def radius_aggregate(points: DataFrame, others: DataFrame, radius: float, value: str, name: str, *,
                     by: Sequence[str] = (), group: Sequence[str] = (), block_size: int = BLOCK_SIZE,
                     tree_rows: int = TREE_ROWS, leaf_rows: int = celltree.LEAF_ROWS) -> DataFrame:
    """For every point the sum of `value` over the others within `radius`, per `group`.

    Both tables have `lat` and `lon`; `points` should be distinct in (`by`, lat, lon). The result
    has (`by`, lat, lon, `group`, `name`) and only rows with at least one other point in reach.
    Pairs are summed in the task that finds them. Crowded cells of the grid arrive as blocks. Those beyond `tree_rows`
    become trees of smaller cells: a cell wholly within the radius of a cell of points adds its sums as they are, and
    only leaves that the circle's border may cross meet point by point.
    """
    keys = [*by, "_cx", "_cy"]
    whole = dict(others.dtypes)[value] in ("int", "bigint", "smallint", "tinyint")
    kind = "bigint" if whole else "double"
    placed = _placed(
        others.select(*by, *group, F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"),
                      F.col(value).cast(kind).alias("_value")),
        "o_lat", "o_lon", radius,
    )
    probe = _probe(points.select(*by, "lat", "lon"), "lat", "lon", radius)
    plain, crowded = split_crowded(placed, keys, block_size)
    pairs = probe.join(plain, keys).filter(geo.within_radius(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"), radius))
    single = pairs.select(*by, "lat", "lon", *group, F.col("_value").alias("_sum"))

    if crowded is not None:
        blocks, hot = split_crowded(crowded.drop("_n_blocks"), keys, tree_rows)
        asking = probe.select(*keys, "lat", "lon")
        schema = T.StructType([*fields(probe, *by, "lat", "lon"), *fields(placed, *group, "_value")])
        met = meet(asking, blocks.fillna(0, ["_value"]), keys, block_size,
                   lambda p, o: sums_within(p, o, [*by, "lat", "lon"], list(group), radius), schema)
        single = single.unionByName(met.select(*by, "lat", "lon", *group, F.col("_value").alias("_sum")))
        if hot is not None:
            single = single.unionByName(_tree_sums(asking, hot.drop("_n_blocks"), keys, list(by), list(group), radius, leaf_rows))
    return single.groupBy(*by, "lat", "lon", *group).agg(F.sum("_sum").alias(name))


def _tree_sums(probe: DataFrame, others: DataFrame, keys: list[str], by: list[str], group: list[str], radius: float, leaf_rows: int) -> DataFrame:
    """(by, lat, lon, group, _sum) of the probing points in very crowded cells, in parts that are summed by the caller."""
    # One row for each place and group, with the sum of its rows.
    others = cut_lineage(others.fillna(0, ["_value"]).groupBy(*keys, *group, "o_lat", "o_lon").agg(F.sum("_value").alias("_value")))
    probe = cut_lineage(probe.join(others.select(*keys).distinct(), keys, "left_semi"))
    tree = celltree.build(celltree.two_sides(probe, others.withColumnsRenamed({"o_lat": "lat", "o_lon": "lon"}), keys), keys, leaf_rows)
    leaves, covered = celltree.descend(tree, keys, celltree.within(radius))
    asking = cut_lineage(probe.join(tree.located, [*keys, "lat", "lon"]).select(*by, "lat", "lon", F.col("leaf").alias("_a")))
    spot = tree.located.select(*keys, F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.col("leaf").alias("_p"))
    held = cut_lineage(others.join(spot, [*keys, "o_lat", "o_lon"]).select("_p", *group, "o_lat", "o_lon", "_value"))
    total = F.sum("_value").alias("_value")
    # Covered cells: sums of leaves make sums of cells, which are added up for each leaf of probing points.
    leaf_sums = held.groupBy("_p", *group).agg(total)
    cell_sums = leaf_sums.join(tree.above.withColumnsRenamed({"leaf": "_p", "cell": "_cell"}), "_p").groupBy(F.col("_cell").alias("_p"), *group).agg(total)
    inside = covered.join(cell_sums, "_p").groupBy("_a", *group).agg(total)
    by_leaf = inside.join(tree.above.withColumnRenamed("cell", "_a"), "_a").groupBy(F.col("leaf").alias("_a"), *group).agg(total)
    out = [*by, "lat", "lon", *group, F.col("_value").alias("_sum")]
    whole = asking.join(by_leaf, "_a").select(*out)
    # Leaves on the border.
    border = leaves.join(held, "_p").select("_a", *group, "o_lat", "o_lon", "_value")
    schema = T.StructType([*fields(asking, *by, "lat", "lon"), *fields(held, *group, "_value")])
    crossed = meet(asking, border, ["_a"], BLOCK_SIZE, lambda p, o: sums_within(p, o, [*by, "lat", "lon"], group, radius), schema)
    return whole.unionByName(crossed.select(*out))


def sums_within(points: pd.DataFrame, others: pd.DataFrame, columns: list[str], group: list[str], radius: float) -> pd.DataFrame:
    """Summed `_value` of the others within `radius` of each point, per `group`, where there are any."""
    if points.empty or others.empty:
        return pd.DataFrame(columns=[*columns, *group, "_value"])
    if group:
        others = others.sort_values(group, ignore_index=True)
        starts = np.flatnonzero(~others.duplicated(group).to_numpy())
    else:
        starts = np.zeros(1, np.int64)
    d_lat = points["lat"].to_numpy()[:, None] - others["o_lat"].to_numpy()
    d_lon = points["lon"].to_numpy()[:, None] - others["o_lon"].to_numpy()
    near = d_lat * d_lat + d_lon * d_lon <= radius * radius
    total = np.add.reduceat(np.where(near, others["_value"].to_numpy(), 0), starts, axis=1)
    row, which = np.nonzero(np.logical_or.reduceat(near, starts, axis=1))
    out = points[columns].iloc[row].reset_index(drop=True)
    for name in group:
        out[name] = others[name].iloc[starts[which]].to_numpy()
    out["_value"] = total[row, which]
    return out


def customer_near_pairs(points: DataFrame, radius: float, by: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Pairs of distinct points of one customer within `radius`, each way and with itself."""
    distinct = points.select(*by, "lat", "lon").distinct()
    near = distinct.select(*by, F.col("lat").alias("near_lat"), F.col("lon").alias("near_lon"))
    return radius_join(distinct, near, radius, right_on=("near_lat", "near_lon"), by=by)


def near_point_count(points: DataFrame, radius: float, by: Sequence[str] = ("customer_id",), array_rows: int = ARRAY_ROWS) -> DataFrame:
    """Number of distinct points of the customer within `radius` of each, itself included.

    A group of up to `array_rows` rows is one array that counts in place; larger ones meet cell by cell.
    """
    by = list(by)
    if not by:
        return _near_by_cells(points, radius, by)
    known = points.select(*by, "lat", "lon").dropna()
    arrays, crowded = arrays_of(known, by, ["lat", "lon"], array_rows)
    counted = F.zip_with("_all", "_counts", lambda p, n: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), n.alias("near_count")))
    arrays = arrays.withColumn("_counts", array_near_counts(F.col("_all.lat"), F.col("_all.lon"), radius))
    found = arrays.select(*by, F.explode(counted).alias("_p")).select(*by, "_p.*").filter("near_count > 0")
    return found if crowded is None else found.unionByName(_near_by_cells(crowded, radius, by))


def _near_by_cells(points: DataFrame, radius: float, by: list[str]) -> DataFrame:
    distinct = points.select(*by, "lat", "lon").distinct()
    return radius_aggregate(distinct, distinct.withColumn("_one", F.lit(1)), radius, "_one", "near_count", by=by)


def pair_distance_sum(points: DataFrame, keys: Sequence[str], weight: str | None = None,
                      name: str = "distance_sum", block_size: int = BLOCK_SIZE) -> DataFrame:
    """`pair_distance_sums` with one weight."""
    return pair_distance_sums(points, keys, {name: weight}, block_size)


def pair_distance_sums(points: DataFrame, keys: Sequence[str], weights: dict[str, str | None], block_size: int = BLOCK_SIZE) -> DataFrame:
    """Per group, for each name and weight, the sum of w_p * w_q * distance(p, q) over all ordered pairs of its points; None weighs 1.

    Points should be distinct, with their multiplicity as a weight. Groups up to `block_size` are one array that is summed in
    place; larger ones are spread over their pairs of blocks. Points move once for all weights.
    """
    keys, own = list(keys), [f"w{i}" for i in range(len(weights))]
    weighed = [(F.col(w).cast("double") if w else F.lit(1.0)).alias(c) for c, w in zip(own, weights.values())]
    arrays, crowded = arrays_of(points.select(*keys, "lat", "lon", *weighed), keys, ["lat", "lon", *own], block_size, repeats=True)
    none = F.lit(0.0)

    def total(w):
        def with_others(p):
            return F.aggregate("_all", none, lambda a, q: a + F.coalesce(p[w] * q[w] * geo.distance(p["lat"], p["lon"], q["lat"], q["lon"]), none))
        known = F.exists("_all", lambda p: (p[w] + p["lat"] + p["lon"]).isNotNull())
        return F.when(known, F.aggregate("_all", none, lambda a, p: a + with_others(p)))

    # Where a place, a weight or a number is missing, the sums go pair by pair.
    odd = F.exists("_all", lambda p: (every := sum((p[w] for w in own), p["lat"] + p["lon"])).isNull() | F.isnan(every))
    sums = array_distance_sums(F.col("_all.lat"), F.col("_all.lon"), [F.col(f"_all.{w}") for w in own])
    small = arrays.withColumns({"_sums": sums, "_odd": odd}).select(
        *keys, *[F.when(F.col("_odd"), total(c)).otherwise(F.get("_sums", F.lit(i))).alias(name) for i, (c, name) in enumerate(zip(own, weights))])
    if crowded is None:
        return small

    schema = T.StructType([*fields(crowded, *keys), *[T.StructField(c, T.DoubleType()) for c in own]])
    sums = meet(crowded, crowded, keys, block_size, lambda p, q: pair_sums(p, q, keys, own), schema, half=True)
    return small.unionByName(sums.groupBy(*keys).agg(*[F.sum(c).alias(name) for c, name in zip(own, weights)]))


def pair_sums(points: pd.DataFrame, others: pd.DataFrame, keys: list[str], weights: list[str]) -> pd.DataFrame:
    """Weighted sums of distances between two blocks; a pair of different blocks counts in both orders."""
    if points.empty or others.empty:
        return pd.DataFrame(columns=[*keys, *weights])
    d_lat = points["lat"].to_numpy()[:, None] - others["lat"].to_numpy()
    d_lon = points["lon"].to_numpy()[:, None] - others["lon"].to_numpy()
    apart = np.sqrt(d_lat * d_lat + d_lon * d_lon)
    both = 1 if points["_i"].iloc[0] == points["_j"].iloc[0] else 2
    out = points[keys].head(1).copy()
    for w in weights:
        out[w] = both * (points[w].to_numpy() @ apart @ others[w].to_numpy())
    return out
