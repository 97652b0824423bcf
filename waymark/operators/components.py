"""Connected components of a graph that splits into independent groups."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.materialize import Written, cut_lineage

# Executors need not have this package: the functions below travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def smallest_reachable(codes_a: np.ndarray, codes_b: np.ndarray, n: int) -> np.ndarray:
    """Component label, as some member's code, of each of n nodes."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[codes_a], label[codes_b])
        np.minimum.at(label, codes_a, low)
        np.minimum.at(label, codes_b, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


#: Pairs of rows that one step compares.
STEP_PAIRS = 1 << 19


def steps(sizes: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of as many whole groups as make up to STEP_PAIRS pairs, at least one, and both ends of all pairs within a group."""
    ends, pairs, at = np.cumsum(sizes), np.cumsum(sizes.astype(np.int64) ** 2), 0
    while at < len(sizes):
        done = pairs[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(pairs, done + STEP_PAIRS, side="right")))
        own = sizes[at:upto]
        width = np.repeat(own, own)
        a = np.repeat(np.arange(len(width)), width)
        b = np.arange(len(a)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(np.repeat(np.cumsum(own) - own, own), width)
        yield slice(ends[at] - sizes[at], ends[upto - 1]), a, b
        at = upto


def _smallest_of(label: np.ndarray, cell: np.ndarray) -> np.ndarray:
    smallest = np.full(len(cell), np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, cell)
    return smallest[label]


def smallest_cells(lat: np.ndarray, lon: np.ndarray, cell: np.ndarray, sizes: np.ndarray, eps: float) -> np.ndarray:
    """For rows that come group after group, `sizes` rows each, the smallest cell of each row's component.

    Two rows of a group are linked when they are in one cell or within eps.
    """
    out = np.empty(len(cell), dtype=np.int64)
    for rows, a, b in steps(sizes):
        y, x, c = lat[rows], lon[rows], cell[rows]
        d_lat, d_lon = y[a] - y[b], x[a] - x[b]
        linked = (d_lat * d_lat + d_lon * d_lon <= eps * eps) | (c[a] == c[b])
        out[rows] = _smallest_of(smallest_reachable(a[linked], b[linked], len(c)), c)
    return out


def near_counts(lat: np.ndarray, lon: np.ndarray, sizes: np.ndarray, eps: float) -> np.ndarray:
    """For rows that come group after group, the number of rows of the group within eps of each, itself included."""
    out = np.empty(len(lat), dtype=np.int64)
    for rows, a, b in steps(sizes):
        d_lat, d_lon = lat[rows][a] - lat[rows][b], lon[rows][a] - lon[rows][b]
        out[rows] = np.bincount(a[d_lat * d_lat + d_lon * d_lon <= eps * eps], minlength=rows.stop - rows.start)
    return out


def distance_sums(lat: np.ndarray, lon: np.ndarray, weights: Sequence[np.ndarray], sizes: np.ndarray) -> list[np.ndarray]:
    """For rows that come group after group, each group's sum of w_a * w_b * distance(a, b) over all ordered pairs, for each of `weights`."""
    out = [np.zeros(len(sizes)) for _ in weights]
    group = np.repeat(np.arange(len(sizes)), sizes)
    for rows, a, b in steps(sizes):
        d_lat, d_lon = lat[rows][a] - lat[rows][b], lon[rows][a] - lon[rows][b]
        apart = np.sqrt(d_lat * d_lat + d_lon * d_lon)
        own = group[rows]
        first, n = (int(own[0]), int(own[-1]) - int(own[0]) + 1) if len(own) else (0, 0)
        for total, w in zip(out, weights):
            total[first:first + n] += np.bincount(own[a] - first, w[rows][a] * w[rows][b] * apart, minlength=n)
    return out


CORE, BORDER, NOISE = range(3)


def density_cells(lat: np.ndarray, lon: np.ndarray, cx: np.ndarray, cy: np.ndarray, weight: np.ndarray, least: np.ndarray,
                  sizes: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows that come group after group, role and cluster of each: the smallest cell of the core rows linked to a core row,
    the smallest cluster within eps of a border row, 0 for noise."""
    roots, roles = np.zeros(len(lat), dtype=np.int64), np.full(len(lat), NOISE, dtype=np.int32)
    for rows, a, b in steps(sizes):
        y, x, i, j, w = lat[rows], lon[rows], cx[rows], cy[rows], weight[rows]
        d_lat, d_lon = y[a] - y[b], x[a] - x[b]
        near, same = d_lat * d_lat + d_lon * d_lon <= eps * eps, (i[a] == i[b]) & (j[a] == j[b])
        around, within = np.zeros(len(y), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
        np.add.at(around, a[near], w[b[near]])
        np.add.at(within, a[same], w[b[same]])
        core = (around >= least[rows]) | (within >= least[rows])
        if (core & ((np.abs(i) >= 1 << 31) | (np.abs(j) >= 1 << 31))).any():
            raise ValueError("a coordinate is over 2 ** 31 cells from zero; use a larger radius")
        linked, reached = core[a] & core[b] & (near | same), ~core[a] & core[b] & near
        found = _smallest_of(smallest_reachable(a[linked], b[linked], len(y)), i * (1 << 32) + j)
        close = np.full(len(y), np.iinfo(np.int64).max)
        np.minimum.at(close, a[reached], found[b[reached]])
        border = np.bincount(a[reached], minlength=len(y)) > 0
        roots[rows] = np.where(core, found, np.where(border, close, 0))
        roles[rows] = np.where(core, CORE, np.where(border, BORDER, NOISE))
    return roots, roles


def array_density(columns: Sequence[Column], eps: float) -> Column:
    """`density_cells` of arrays (lat, lon, cx, cy, weight, least), one group a row: arrays `roots` and `roles`."""
    def resolve(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for arrays in batches:
            sizes = arrays[0].str.len().to_numpy(dtype=np.int64)
            if not len(sizes):
                yield pd.DataFrame({"roots": [], "roles": []}, dtype=object)
                continue
            found, cuts = density_cells(*[np.concatenate(c.to_numpy()) for c in arrays], sizes, eps), np.cumsum(sizes)[:-1]
            yield pd.DataFrame({"roots": np.split(found[0], cuts), "roles": np.split(found[1], cuts)} if len(cuts) else {"roots": [found[0]], "roles": [found[1]]})

    return F.pandas_udf(resolve, "roots array<bigint>, roles array<int>")(*columns)


def array_near_counts(lat: Column, lon: Column, eps: float) -> Column:
    """`near_counts` of arrays, one group a row."""
    def resolve(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for columns in batches:
            sizes = columns[0].str.len().to_numpy(dtype=np.int64)
            if not len(sizes):
                yield pd.Series([], dtype=object)
                continue
            found = near_counts(*[np.concatenate(c.to_numpy()) for c in columns], sizes, eps)
            yield pd.Series(np.split(found, np.cumsum(sizes)[:-1]))

    return F.pandas_udf(resolve, T.ArrayType(T.LongType()))(lat, lon)


def array_distance_sums(lat: Column, lon: Column, weights: Sequence[Column]) -> Column:
    """`distance_sums` of arrays, one group a row: an array with a sum for each of `weights`. Arrays hold no nulls."""
    def resolve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            sizes = columns[0].str.len().to_numpy(dtype=np.int64)
            if not len(sizes):
                yield pd.Series([], dtype=object)
                continue
            y, x, *w = (np.concatenate(c.to_numpy()) for c in columns)
            yield pd.Series(list(np.stack(distance_sums(y, x, w, sizes), axis=1)))

    return F.pandas_udf(resolve, T.ArrayType(T.DoubleType()))(lat, lon, *weights)


def array_components(lat: Column, lon: Column, cell: Column, eps: float) -> Column:
    """`smallest_cells` of arrays, one group a row."""
    def resolve(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for columns in batches:
            sizes = columns[0].str.len().to_numpy(dtype=np.int64)
            if not len(sizes):
                yield pd.Series([], dtype=object)
                continue
            found = smallest_cells(*[np.concatenate(c.to_numpy()) for c in columns], sizes, eps)
            yield pd.Series(np.split(found, np.cumsum(sizes)[:-1]))

    return F.pandas_udf(resolve, T.ArrayType(T.LongType()))(lat, lon, cell)


def _tile_roots(edges: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """Smallest node of each component, for edges of any number of tiles at once."""
    ends = pd.concat([
        edges[[*by, "_tile", "u"]].rename(columns={"u": "node"}),
        edges[[*by, "_tile", "v"]].rename(columns={"v": "node"}),
    ], ignore_index=True)
    code = np.zeros(len(ends), dtype=np.int64)
    for name in [*by, "_tile", "node"]:
        part, values = pd.factorize(ends[name], use_na_sentinel=False)
        code, _ = pd.factorize(code * max(len(values), 1) + part)
    n, half = int(code.max()) + 1, len(edges)
    label = smallest_reachable(code[:half], code[half:], n)
    nodes = np.empty(n, dtype=np.int64)
    nodes[code] = ends["node"].to_numpy()
    smallest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, nodes)
    first = np.unique(code, return_index=True)[1]
    out = ends.iloc[first][by].reset_index(drop=True)
    out["node"], out["root"] = nodes, smallest[label]
    return out


def _resolve_tiles(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by tile. The last tile of a batch may go on in the next, so it waits."""
    keys, held = [*by, "_tile"], None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if batch.empty:
            continue
        last = batch[keys].iloc[-1]
        open_rows = np.logical_and.reduce(
            [(batch[k] == last[k]).to_numpy() | (batch[k].isna().to_numpy() & pd.isna(last[k])) for k in keys]
        )
        held, done = batch[open_rows], batch[~open_rows]
        if len(done):
            yield _tile_roots(done, by)
    if held is not None and len(held):
        yield _tile_roots(held, by)


def tile_components(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Components inside each (`by`, `_tile`), as (`by`, node, root).

    A tile is a key of bounded size, so that a group with a third of all edges is worked on by many tasks.
    """
    fields = [f for f in edges.schema.fields if f.name in by]
    fields.sort(key=lambda f: list(by).index(f.name))
    schema = T.StructType([*fields, T.StructField("node", T.LongType()), T.StructField("root", T.LongType())])
    keys = list(by)
    return (
        edges.select(*by, "_tile", "u", "v")
        .repartition(*by, "_tile").sortWithinPartitions(*by, "_tile")
        .mapInPandas(lambda batches: _resolve_tiles(batches, keys), schema)
    )


def label_components(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Smallest node of the component of every node in `edges` (`by`, u, v): (`by`, node, root).

    Each round takes the smallest label among the neighbours and then the label of that
    label, so the rounds grow with the logarithm of the longest path.
    """
    by = list(by)
    both = edges.select(*by, "u", "v").unionByName(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
    links = Written(both.filter("u <> v").distinct())
    labels = Written(links.df.groupBy(*by, F.col("u").alias("node")).agg(F.min("v").alias("_near"))
                     .select(*by, "node", F.least("node", "_near").alias("root")))
    while True:
        near = (
            links.df.join(labels.df.select(*by, F.col("node").alias("v"), "root"), [*by, "v"])
            .groupBy(*by, F.col("u").alias("node")).agg(F.min("root").alias("_near"))
        )
        hop = labels.df.select(*by, F.col("node").alias("_near"), F.col("root").alias("_far"))
        step = (
            labels.df.join(near, [*by, "node"])
            .withColumn("_near", F.least("root", "_near"))
            .join(hop, [*by, "_near"], "left")
            .select(*by, "node", F.least("_near", "_far").alias("new_root"), "root")
        )
        # The round is written once; old and new root side by side show whether anything moved.
        moved = Written(step)
        labels.drop()
        settled = moved.df.filter("new_root < root").isEmpty()
        labels = moved
        labels.df = moved.df.select(*by, "node", F.col("new_root").alias("root"))
        if settled:
            links.drop()
            return labels.df


def connected_components(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Components of `edges` (`by`, `_tile`, u, v), where edges that leave a tile have a NULL `_tile`.

    Tiles are resolved locally after one shuffle. What is left is the graph between tiles,
    with one node per local component.
    """
    by = list(by)
    local = Written(tile_components(edges.filter("_tile is not null"), by)).df
    end = local.select(*by, F.col("node").alias("_end"), F.col("root").alias("_root"))
    crossing = edges.filter("_tile is null").select(*by, "u", "v")
    for side in ("u", "v"):
        crossing = (
            crossing.withColumnRenamed(side, "_end").join(end, [*by, "_end"], "left")
            .withColumn(side, F.coalesce("_root", "_end")).drop("_end", "_root")
        )
    crossing = cut_lineage(crossing.filter("u <> v").distinct())
    if crossing.isEmpty():
        return local
    between = label_components(crossing, by).withColumnRenamed("root", "_top")
    # Nodes whose edges all cross are in `between` only; the other roots map through it.
    inside = (
        local.join(between.withColumnRenamed("node", "root"), [*by, "root"], "left")
        .select(*by, "node", F.coalesce("_top", "root").alias("root"))
    )
    alone = between.join(local, [*by, "node"], "left_anti").select(*by, "node", F.col("_top").alias("root"))
    return inside.unionByName(alone)
