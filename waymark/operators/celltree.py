"""Crowded groups as trees of square cells, compared cell by cell.

The points of a group lie in one square, which is cut into sixteen cells, these again, until a cell holds few points. Every
cell knows its tight bounds and how many of its points ask and how many are asked for. The tree is walked down together with itself: a
pair of cells that the bounds decide goes no further, and the others are replaced by the pairs of their children. A cell
thus meets the cells around it only, no key is hot, and what is left are pairs of leaves.

Bounds are compared by the arithmetic of the exact test, whose steps are monotone: a decided pair is decided as its points would be.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.materialize import Written, cut_lineage
from waymark.operators.lookups import BROADCAST_ROWS

LEAF_ROWS = 256
#: A cell is cut into 4 ** STEP children; cells are told apart down to 2 ** -DEPTH of the square's side.
STEP, DEPTH = 2, 48
#: Levels that are counted in one go.
STRIDE = 4 * STEP
BOX = ["lat0", "lat1", "lon0", "lon1"]


@dataclass(frozen=True)
class CellTree:
    #: One row for each group: keys, cell, asks, holds, leaf and the bounds.
    roots: DataFrame
    #: (cell, child; asks, holds, leaf, bounds of the child); a leaf is its own child.
    steps: DataFrame
    #: Keys, lat, lon and the leaf of each point.
    located: DataFrame
    #: (leaf, cell) for each leaf and every cell that holds it.
    above: DataFrame


def counted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, a stored table, marked for broadcast if it has no more than `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _bounds(lat0="lat", lat1="lat", lon0="lon", lon1="lon") -> list[Column]:
    return [F.min(lat0).alias("lat0"), F.max(lat1).alias("lat1"), F.min(lon0).alias("lon0"), F.max(lon1).alias("lon1")]


def _index(at: str, low: str) -> Column:
    steps = F.floor((F.col(at) - F.col(low)) / F.col("_side") * F.lit(float(1 << DEPTH)))
    return F.least(steps, F.lit((1 << DEPTH) - 1))


def _at(level: str | int) -> list[Column]:
    """The cell of a point, or of a deeper cell, at a level."""
    return [F.expr(f"shiftright(_fx, cast({DEPTH} - {level} as int))").alias("cx"), F.expr(f"shiftright(_fy, cast({DEPTH} - {level} as int))").alias("cy")]


def two_sides(asking: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, lat, lon, asks, holds): the distinct points of two tables, with 1 for those in the first and in the second."""
    def side(df, asks, holds):
        return df.select(*keys, "lat", "lon", F.lit(asks).alias("asks"), F.lit(holds).alias("holds"))

    return side(asking, 1, 0).unionByName(side(held, 0, 1)).groupBy(*keys, "lat", "lon").agg(F.max("asks").alias("asks"), F.max("holds").alias("holds"))


def build(points: DataFrame, keys: Sequence[str], leaf_rows: int = LEAF_ROWS) -> CellTree:
    """The trees of all groups of `points`, which `two_sides` makes.

    Each round counts the cells of its finest level and rolls them up, so that points are grouped once a round however many levels
    there are. Points of cells that still are crowded go into the next round.
    """
    keys = list(keys)
    cell = [*keys, "level", "cx", "cy"]
    parents = {"_px": F.expr(f"shiftright(cx, {STEP})"), "_py": F.expr(f"shiftright(cy, {STEP})")}
    extent = F.greatest(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon"))
    squares = points.groupBy(*keys).agg(F.min("lat").alias("_lat"), F.min("lon").alias("_lon"), F.when(extent > 0, extent).otherwise(1.0).alias("_side"))
    left = Written(points.join(squares, keys).select(
        *keys, "lat", "lon", "asks", "holds", _index("lat", "_lat").alias("_fx"), _index("lon", "_lon").alias("_fy")))
    cells, located, top = None, None, 0
    while True:
        finest = min(top + STRIDE, DEPTH)
        number = [F.count(F.lit(1)).alias("n"), F.sum("asks").alias("asks"), F.sum("holds").alias("holds")]
        fine = Written(left.df.groupBy(*keys, *_at(finest)).agg(*number, *_bounds()))
        known = ["n", "asks", "holds", *BOX]
        spread = fine.df.select(
            *keys, F.explode(F.sequence(F.lit(top), F.lit(finest), F.lit(STEP))).alias("level"), F.col("cx").alias("_x"), F.col("cy").alias("_y"), *known)
        spread = spread.select(
            *keys, "level", F.expr(f"shiftright(_x, {finest} - level)").alias("cx"), F.expr(f"shiftright(_y, {finest} - level)").alias("cy"), "_x", "_y", *known)
        sums = spread.groupBy(*cell).agg(*[F.sum(c).alias(c) for c in known[:3]], *_bounds(*BOX))
        crowded = sums.filter(F.col("n") > leaf_rows).select(
            *keys, (F.col("level") + STEP).alias("level"), F.col("cx").alias("_px"), F.col("cy").alias("_py"))
        inner = sums.withColumns(parents).join(crowded, [*keys, "level", "_px", "_py"], "left_semi").drop("_px", "_py")
        # The first level is that of the whole group, or one that an earlier round has counted.
        made = inner if top else inner.unionByName(sums.filter(F.col("level") == 0))
        made = Written(made.withColumn("leaf", (F.col("n") <= leaf_rows) | (F.col("level") >= DEPTH)).withColumn("cell", F.monotonically_increasing_id())).df
        made = made.withColumn("cell", F.col("cell") + F.lit(top) * F.lit(1 << 56)) if top else made
        cells = made if cells is None else cells.unionByName(made)
        leaf_of = spread.join(made.filter("leaf").select(*cell, F.col("cell").alias("leaf")), cell).select(*keys, F.col("_x").alias("cx"), F.col("_y").alias("cy"), "leaf")
        # Crowded cells of the finest level are left out first: they would be hot keys.
        still = made.filter(~F.col("leaf") & (F.col("level") == finest)).select(*keys, "cx", "cy")
        here = left.df.select(*keys, "lat", "lon", "asks", "holds", "_fx", "_fy", *_at(finest))
        more = not still.isEmpty()
        found = (here.join(counted(still), [*keys, "cx", "cy"], "left_anti") if more else here).join(leaf_of, [*keys, "cx", "cy"]).select(*keys, "lat", "lon", "leaf")
        located = found if located is None else located.unionByName(found)
        if not more:
            break
        left, top = Written(here.join(counted(still), [*keys, "cx", "cy"], "left_semi").drop("cx", "cy")), finest
    parent = cells.select(*keys, (F.col("level") + STEP).alias("level"), F.col("cx").alias("_px"), F.col("cy").alias("_py"), F.col("cell").alias("_parent"))
    shown = ["asks", "holds", "leaf", *BOX]
    children = cells.withColumns(parents).join(parent, [*keys, "level", "_px", "_py"]).select(F.col("_parent").alias("cell"), F.col("cell").alias("child"), *shown)
    own = cells.filter("leaf").select("cell", F.col("cell").alias("child"), *shown)
    chain = cells.filter("leaf").select(
        *keys, F.col("cell").alias("leaf"), F.explode(F.expr(f"sequence(0L, cast(level as long), {STEP}L)")).alias("_level"), "level", "cx", "cy")
    above = chain.select(*keys, "leaf", F.col("_level").cast("int").alias("level"), *[F.expr(f"shiftright({c}, cast(level - _level as int))").alias(c) for c in ("cx", "cy")])
    return CellTree(cells.filter(F.col("level") == 0).select(*keys, "cell", *shown), cut_lineage(children.unionByName(own)),
                    located, above.join(cells.select(*cell, "cell"), cell).select("leaf", "cell"))


def nearest_possible(a: str = "a_", p: str = "p_") -> Column:
    """The least squared distance that two boxes allow."""
    def gap(axis):
        return F.greatest(F.lit(0.0), F.col(f"{p}{axis}0") - F.col(f"{a}{axis}1"), F.col(f"{a}{axis}0") - F.col(f"{p}{axis}1"))

    return gap("lat") * gap("lat") + gap("lon") * gap("lon")


def farthest_possible(a: str = "a_", p: str = "p_") -> Column:
    """The largest squared distance that two boxes allow."""
    def span(axis):
        return F.greatest(F.col(f"{p}{axis}1") - F.col(f"{a}{axis}0"), F.col(f"{a}{axis}1") - F.col(f"{p}{axis}0"))

    return span("lat") * span("lat") + span("lon") * span("lon")


def _side(steps: DataFrame, name: str, points: str) -> DataFrame:
    """Cells or steps with points that count on one side of a pair, named for that side."""
    inner = "child" in steps.columns
    renamed = {"child" if inner else "cell": name, points: f"{name}_n", "leaf": f"{name}_leaf", **{c: f"{name}_{c}" for c in BOX}}
    rows = steps.filter(F.col(points) > 0).drop(*{"asks", "holds"} - {points})
    return (rows.withColumnRenamed("cell", f"_{name}") if inner else rows).withColumnsRenamed(renamed)


def descend(tree: CellTree, keys: Sequence[str], decide: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(pairs of leaves, covered pairs), each with _a and _p, the cells that ask and the cells that hold.

    `decide` is given pairs of cells, (a, a_n, a_leaf, a_lat0, ..., p, ...), and returns those that count, with `covered` for the pairs that
    need no closer look.
    """
    pairs = _side(tree.roots, "a", "asks").join(_side(tree.roots, "p", "holds"), list(keys)).drop(*keys)
    a_steps, p_steps = _side(tree.steps, "a", "asks"), _side(tree.steps, "p", "holds")
    both, names, rounds = F.col("a_leaf") & F.col("p_leaf"), [F.col("a").alias("_a"), F.col("p").alias("_p")], []
    while True:
        met = Written(decide(pairs)).df
        rounds.append(met.filter("covered or (a_leaf and p_leaf)").select(*names, "covered"))
        further = met.filter(~F.col("covered") & ~both).select(*names)
        if further.isEmpty():
            done = rounds[0]
            for more in rounds[1:]:
                done = done.unionByName(more)
            return done.filter("not covered").drop("covered"), done.filter("covered").drop("covered")
        pairs = further.join(a_steps, "_a").join(p_steps, "_p").drop("_a", "_p")


def keep_nearest(k: int) -> Callable[[DataFrame], DataFrame]:
    """Decides for the k nearest points: of a cell of anchors' pairs, those stay that may hold one of them.

    Cells that hold k points bound the kth distance by the farthest of their points; a cell beyond that bound goes.
    """
    def decide(pairs: DataFrame) -> DataFrame:
        order = Window.partitionBy("a").orderBy("_far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        reached = F.when(F.sum("p_n").over(order) >= k, F.col("_far"))
        bounded = pairs.withColumn("_far", farthest_possible()).withColumn("_reached", reached)
        limit = F.min("_reached").over(Window.partitionBy("a"))
        kept = bounded.withColumn("_limit", limit).filter(F.col("_limit").isNull() | (nearest_possible() <= F.col("_limit")))
        return kept.drop("_far", "_reached", "_limit").withColumn("covered", F.lit(False))

    return decide


def within(radius: float) -> Callable[[DataFrame], DataFrame]:
    """Decides for the points within a radius: pairs of cells wholly within it are covered, those wholly beyond it go."""
    def decide(pairs: DataFrame) -> DataFrame:
        square = F.lit(radius * radius)
        return pairs.filter(nearest_possible() <= square).withColumn("covered", farthest_possible() <= square)

    return decide
