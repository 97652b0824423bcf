"""Density clustering (Ester et al., KDD 1996) on a grid.

Cells are narrow enough that two points of a cell are always within eps. So a cell is one
node of the cluster graph, has at most 20 neighbours, and the graph grows with the occupied cells
and not with the near pairs. Whether two neighbouring cells touch is decided from a
few outer points per cell; only undecided pairs look at more points, and crowded ones do so
on finer and finer grids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.materialize import Written
from waymark.operators.blocks import ARRAY_ROWS, arrays_of
from waymark.operators.components import array_components, array_density, connected_components
from waymark.operators.radius import radius_aggregate

TILE_CELLS = 128
# Points within eps are at most this many cells apart on each axis.
REACH_CELLS = 2
# Cells meet in squares of this many cells a side, so a join key never has more than its square.
MEETING_CELLS = 8
# Undecided cell pairs with up to this many point pairs are compared point by point.
DIRECT_PAIRS = 4096
FINEST_LEVEL = 40

OUTLINE = ["n", "lo_lat", "hi_lat", "lo_lon", "hi_lon"]


def cell_size(eps: float) -> float:
    return eps * geo.DIAGONAL_FIT


def pack_cell(cx: Column, cy: Column) -> Column:
    """One integer per cell. Both indexes have to fit 32 bits with their sign: farther cells raise an error."""
    far = (F.abs(cx) >= 1 << 31) | (F.abs(cy) >= 1 << 31)
    packed = cx.cast("bigint") * F.lit(1 << 32) + cy.cast("bigint")
    return F.when(far, F.raise_error(F.lit("a coordinate is over 2 ** 31 cells from zero; use a larger radius"))).otherwise(packed)


def cell_id(lat: Column, lon: Column, eps: float) -> Column:
    return pack_cell(F.floor(lat / cell_size(eps)), F.floor(lon / cell_size(eps)))


def _outline(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group the count and the bounds of its points."""
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("lat").alias("lo_lat"), F.max("lat").alias("hi_lat"),
        F.min("lon").alias("lo_lon"), F.max("lon").alias("hi_lon"),
    )


def _judge(pairs: DataFrame, eps: float) -> DataFrame:
    """Add `touch`: true where all points of a and b are within eps, NULL where some may be.
    Pairs without any go. Two single points are always decided."""
    def apart(axis):
        return F.col(f"b_lo_{axis}") - F.col(f"a_hi_{axis}"), F.col(f"a_lo_{axis}") - F.col(f"b_hi_{axis}")

    def least(axis):
        return F.greatest(F.lit(0.0), *apart(axis))

    def most(axis):
        return F.greatest(F.col(f"b_hi_{axis}") - F.col(f"a_lo_{axis}"), F.col(f"a_hi_{axis}") - F.col(f"b_lo_{axis}"))

    touch = most("lat") * most("lat") + most("lon") * most("lon") <= eps * eps
    may = least("lat") * least("lat") + least("lon") * least("lon") <= eps * eps * (1 + geo.SLACK)
    single = (F.col("a_n") == 1) & (F.col("b_n") == 1)
    return pairs.filter(may & (touch | ~single)).withColumn("touch", F.when(touch, True))


def _side(side: str, names: Sequence[str]) -> list[Column]:
    return [F.col(name).alias(f"{side}_{name}") for name in names]


def link_cells(points: DataFrame, eps: float, by: Sequence[str] = (), direct_pairs: int = DIRECT_PAIRS) -> DataFrame:
    """Neighbouring cells with points within eps: (`by`, `_tile`, u, v), `_tile` NULL where they differ.

    `points` are distinct in (`by`, lat, lon) and have `_cx`, `_cy`.
    """
    by = list(by)
    cells = _outline(points, [*by, "_cx", "_cy"])
    a, b = cells.withColumnsRenamed({"_cx": "a_cx", "_cy": "a_cy"}), cells.withColumnsRenamed({"_cx": "b_cx", "_cy": "b_cy"})

    def square(index):
        return F.floor(index / MEETING_CELLS)

    def squares(first, last):
        return F.explode(F.sequence(square(first), square(last)))

    probe = (
        a.select(*by, "a_cx", "a_cy", *_side("a", OUTLINE))
        .withColumn("_kx", squares(F.col("a_cx"), F.col("a_cx") + REACH_CELLS))
        .withColumn("_ky", squares(F.col("a_cy") - REACH_CELLS, F.col("a_cy") + REACH_CELLS))
    )
    placed = b.select(
        *by, "b_cx", "b_cy", *_side("b", OUTLINE),
        square(F.col("b_cx")).alias("_kx"), square(F.col("b_cy")).alias("_ky"),
    )
    after = (F.col("b_cx") > F.col("a_cx")) | ((F.col("b_cx") == F.col("a_cx")) & (F.col("b_cy") > F.col("a_cy")))
    reach = (F.col("b_cx") - F.col("a_cx") <= REACH_CELLS) & (F.abs(F.col("b_cy") - F.col("a_cy")) <= REACH_CELLS)
    near = probe.join(placed, [*by, "_kx", "_ky"]).filter(after & reach)
    root = ["a_cx", "a_cy", "b_cx", "b_cy"]
    judged = Written(_judge(near, eps).select(*by, *root, "a_n", "b_n", "touch")).df
    links = judged.filter("touch").select(*by, *root)
    open_pairs = judged.filter("touch is null")

    direct = open_pairs.filter(F.col("a_n") * F.col("b_n") <= direct_pairs)
    links = links.unionByName(_touch_by_points(points, direct.select(*by, *root), eps, by, root))
    crowded = open_pairs.filter(F.col("a_n") * F.col("b_n") > direct_pairs)
    if not crowded.isEmpty():
        links = links.unionByName(_touch_by_refining(points, crowded.select(*by, *root), eps, by, root, direct_pairs))

    def tile(side):
        return pack_cell(F.floor(F.col(f"{side}_cx") / TILE_CELLS), F.floor(F.col(f"{side}_cy") / TILE_CELLS))

    return links.select(
        *by, F.when(tile("a") == tile("b"), tile("a")).alias("_tile"),
        pack_cell(F.col("a_cx"), F.col("a_cy")).alias("u"), pack_cell(F.col("b_cx"), F.col("b_cy")).alias("v"),
    )


def _touch_by_points(points, pairs, eps, by, root):
    def side(name):
        return points.select(
            *by, F.col("_cx").alias(f"{name}_cx"), F.col("_cy").alias(f"{name}_cy"),
            F.col("lat").alias(f"{name}_lat"), F.col("lon").alias(f"{name}_lon"),
        )
    found = pairs.join(side("a"), [*by, "a_cx", "a_cy"]).join(side("b"), [*by, "b_cx", "b_cy"])
    near = geo.within_radius(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"), eps)
    return found.filter(near).select(*by, *root).distinct()


def _touch_by_refining(points, pairs, eps, by, root, direct_pairs):
    """Halve the cells of undecided pairs until their bounds decide. Work follows the border
    between the two cells, not the product of their points."""
    size, accepted, level = cell_size(eps), None, 0
    a_root, b_root = ["_ra_x", "_ra_y"], ["_rb_x", "_rb_y"]
    open_pairs = pairs.select(*by, *[F.col(c).alias(r) for c, r in zip(root, a_root + b_root)], *root)
    while True:
        level += 1
        fine = size / (1 << level)
        # The fine index halves to the coarse one exactly: sizes differ by a power of two.
        children = _outline(
            points.withColumn("_fx", F.floor(F.col("lat") / fine)).withColumn("_fy", F.floor(F.col("lon") / fine)),
            [*by, "_fx", "_fy"],
        )
        up = lambda name: F.floor(F.col(name) / 2)

        def child(side):
            return children.select(
                *by, up("_fx").alias(f"{side}_cx"), up("_fy").alias(f"{side}_cy"),
                F.col("_fx").alias(f"{side}_fx"), F.col("_fy").alias(f"{side}_fy"), *_side(side, OUTLINE),
            )

        pairs_now = open_pairs.join(child("a"), [*by, "a_cx", "a_cy"]).join(child("b"), [*by, "b_cx", "b_cy"])
        judged = Written(
            _judge(pairs_now, eps).select(*by, *a_root, *b_root, F.col("a_fx").alias("a_cx"), F.col("a_fy").alias("a_cy"),
                    F.col("b_fx").alias("b_cx"), F.col("b_fy").alias("b_cy"), "a_n", "b_n", "touch")
        ).df
        roots = [*by, *a_root, *b_root]
        new = judged.filter("touch").select(*roots).distinct()
        accepted = new if accepted is None else accepted.unionByName(new)
        still = judged.filter("touch is null").join(new, roots, "left_anti")
        few = F.col("a_n") * F.col("b_n") <= (direct_pairs if level < FINEST_LEVEL else (1 << 62))
        fine_points = points.withColumn("_cx", F.floor(F.col("lat") / fine)).withColumn("_cy", F.floor(F.col("lon") / fine))
        direct = _touch_by_points(fine_points, still.filter(few).select(*roots, *root), eps, by, [*a_root, *b_root])
        accepted = accepted.unionByName(direct)
        open_pairs = Written(still.filter(~few).select(*roots, *root)).df
        if open_pairs.isEmpty():
            names = dict(zip(a_root + b_root, root))
            return accepted.distinct().withColumnsRenamed(names)


def _placed(points: DataFrame, eps: float) -> DataFrame:
    size = cell_size(eps)
    return points.withColumn("_cx", F.floor(F.col("lat") / size)).withColumn("_cy", F.floor(F.col("lon") / size))


def _component_of_points(placed: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """Points with `cluster_id`, the smallest cell of their component."""
    roots = connected_components(links, by).withColumnRenamed("node", "_cell")
    return (
        placed.withColumn("_cell", pack_cell(F.col("_cx"), F.col("_cy")))
        .join(roots, [*by, "_cell"], "left")
        .withColumn("cluster_id", F.coalesce("root", "_cell"))
        .drop("root", "_cell", "_cx", "_cy")
    )


def cluster_points(points: DataFrame, eps: float, by: Sequence[str] = ("customer_id",),
                   direct_pairs: int = DIRECT_PAIRS, array_rows: int = ARRAY_ROWS) -> DataFrame:
    """Clusters of distinct points under eps and one point per cluster at least: (`by`, lat, lon, cluster_id).

    Every point is then a core point, so the clusters are the components of the near pairs.
    `cluster_id` is the packed smallest grid cell of the cluster: the same in every run.
    A group of up to `array_rows` rows is one array that is resolved in place; larger ones become graphs of cells.
    """
    by = list(by)
    own = points.select(*by, "lat", "lon")
    if not by:
        return _cluster_by_cells(own, eps, by, direct_pairs)
    # What a key or coordinate is missing of is near nothing.
    alone = F.greatest(*[F.col(c).isNull() for c in [*by, "lat", "lon"]])
    loose = own.filter(alone).distinct().withColumn("cluster_id", cell_id(F.col("lat"), F.col("lon"), eps))
    # The same arrays as those of `near_point_count`, so a plan with both moves the points once.
    arrays, crowded = arrays_of(own.dropna(), by, ["lat", "lon"], array_rows)
    cells = F.transform("_all", lambda p: cell_id(p["lat"], p["lon"], eps))
    roots = array_components(F.col("_all.lat"), F.col("_all.lon"), cells, eps)
    placed = F.explode(F.zip_with("_all", "_roots", lambda p, root: F.struct(
        p["lat"].alias("lat"), p["lon"].alias("lon"), root.alias("cluster_id"))))
    found = arrays.withColumn("_roots", roots).select(*by, placed.alias("_p")).select(*by, "_p.*")
    if crowded is not None:
        found = found.unionByName(_cluster_by_cells(crowded, eps, by, direct_pairs))
    return found.unionByName(loose)


def _cluster_by_cells(points: DataFrame, eps: float, by: list[str], direct_pairs: int) -> DataFrame:
    placed = Written(_placed(points.distinct(), eps)).df
    return _component_of_points(placed, link_cells(placed, eps, by, direct_pairs), by)


def dbscan(points: DataFrame, eps: float, min_points: int | str, by: Sequence[str] = (),
           weight: str | None = None, direct_pairs: int = DIRECT_PAIRS, array_rows: int = ARRAY_ROWS) -> DataFrame:
    """DBSCAN per `by` group: (`by`, lat, lon, weight, cluster_id, role).

    Rows at one place count as many points, `weight` of them where given. A point is core when at
    least `min_points` (a number, or a column that is constant in the group) lie within eps, itself included. Role is
    core, border or noise. A border point takes the smallest cluster_id among the core points in
    reach; noise has none. A group of up to `array_rows` places is one array that is resolved in place, unless weights
    may be null; larger ones go by cells.
    """
    by = list(by)
    least = F.col(min_points) if isinstance(min_points, str) else F.lit(min_points)
    merged = points.groupBy(*by, "lat", "lon").agg(
        F.sum(F.col(weight).cast("bigint") if weight else F.lit(1)).cast("bigint").alias("weight"),
        F.max(least).cast("bigint").alias("_least"),
    )
    placed = Written(_placed(merged, eps)).df
    if not by or (weight and points.schema[weight].nullable):
        return _dbscan_by_cells(placed, eps, by, direct_pairs)
    columns = ["lat", "lon", "_cx", "_cy", "weight", "_least"]
    arrays, crowded = arrays_of(placed.dropna(), by, columns, array_rows, repeats=True)
    found = arrays.withColumn("_found", array_density([F.col(f"_all.{c}") for c in columns], eps))
    rows = F.explode(F.arrays_zip("_all", F.col("_found.roots").alias("root"), F.col("_found.roles").alias("role"))).alias("_p")
    found = found.select(*by, rows).select(
        *by, "_p._all.lat", "_p._all.lon", "_p._all.weight", F.when(F.col("_p.role") < 2, F.col("_p.root")).alias("cluster_id"),
        F.element_at(F.array(*[F.lit(r) for r in ("core", "border", "noise")]), F.col("_p.role") + 1).alias("role"))
    return found if crowded is None else found.unionByName(_dbscan_by_cells(Written(crowded).df, eps, by, direct_pairs))


def _dbscan_by_cells(placed: DataFrame, eps: float, by: list[str], direct_pairs: int) -> DataFrame:
    cell = [*by, "_cx", "_cy"]
    # A cell of min_points is all core. Only the others count neighbours, and those are few per cell.
    full = placed.groupBy(*cell).agg(F.sum("weight").alias("_cell_weight"))
    sized = placed.join(full, cell).withColumn("_full", F.col("_cell_weight") >= F.col("_least"))
    sparse = sized.filter("not _full")
    counted = radius_aggregate(sparse, placed, eps, "weight", "_near", by=by)
    marked = Written(
        sized.join(counted, [*by, "lat", "lon"], "left")
        .withColumn("core", F.col("_full") | (F.coalesce("_near", F.lit(0)) >= F.col("_least")))
        .drop("_near", "_full", "_cell_weight", "_least")
    ).df
    core = marked.filter("core").drop("core")
    clustered = Written(_component_of_points(core, link_cells(core, eps, by, direct_pairs), by)).df
    others = marked.filter("not core").drop("core", "_cx", "_cy")
    reached = (
        radius_aggregate(others, clustered, eps, "weight", "_n", by=by, group=["cluster_id"])
        .groupBy(*by, "lat", "lon").agg(F.min("cluster_id").alias("cluster_id"))
    )
    rest = others.join(reached, [*by, "lat", "lon"], "left").withColumn(
        "role", F.when(F.col("cluster_id").isNull(), "noise").otherwise("border")
    )
    return clustered.withColumn("role", F.lit("core")).unionByName(rest)


def cluster_global_points(points: DataFrame, eps_units: int = 6, base: int = 100) -> DataFrame:
    """Clusters of rounded points: (lat, lon, cluster_id), one row per distinct rounded point.

    Points are rounded to 1/base and compared in whole units of that lattice, where pairs lie exactly on
    the limit; only the output is divided. Use `assign_global_cluster` to look points up.
    """
    units = points.select(
        geo.lattice_index(F.col("lat"), base).cast("double").alias("lat"),
        geo.lattice_index(F.col("lon"), base).cast("double").alias("lon"),
    ).distinct()
    return cluster_points(units, float(eps_units), by=()).select(
        (F.col("lat") / base).alias("lat"), (F.col("lon") / base).alias("lon"), "cluster_id"
    )


def assign_global_cluster(points: DataFrame, clusters: DataFrame, base: int = 100) -> DataFrame:
    """Add the `cluster_id` of each point's rounded place."""
    found = clusters.select(F.col("lat").alias("_r_lat"), F.col("lon").alias("_r_lon"), "cluster_id")
    return (
        points.withColumn("_r_lat", geo.round_coordinate(F.col("lat"), base))
        .withColumn("_r_lon", geo.round_coordinate(F.col("lon"), base))
        .join(found, ["_r_lat", "_r_lon"], "left").drop("_r_lat", "_r_lon")
    )
