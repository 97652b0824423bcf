"""Crowded groups, cut into blocks.

Several operators compare every point of a group with every other. Groups up to a size do so
in a plain join. A larger group would be one hot task and one row per pair, so both of its sides are cut
into blocks of about `size` rows by hash, and every pair of blocks is a key of its own. A pair of blocks meets as two
small tables in one vectorised step. No pair of a crowded group becomes a row.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need not have this package: the functions below travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_SIZE = 1024
#: Rows of a group up to which it is held as one array.
ARRAY_ROWS = 256
#: Rows of a group up to which all its blocks meet; larger ones become trees of cells (see celltree).
TREE_ROWS = 8 * BLOCK_SIZE


def split_crowded(df: DataFrame, keys: Sequence[str], size: int = BLOCK_SIZE) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups up to `size`, rows of larger groups with `_n_blocks`, or None without any).

    Counts the groups once, so `df` should be cheap to read. Mostly no group is crowded, and
    the plan then needs neither the lookup nor the second branch.
    """
    crowded = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > size)
        .select(*keys, F.ceil(F.col("_n") / size).cast("int").alias("_n_blocks"))
    )
    if crowded.isEmpty():
        return df, None
    return df.join(crowded, list(keys), "left_anti"), df.join(crowded, list(keys))


def arrays_of(df: DataFrame, keys: Sequence[str], columns: Sequence[str], size: int = ARRAY_ROWS,
              repeats: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(`keys` and the distinct rows of `columns` as one array `_all`, rows of groups with more than `size` rows, or None without any).

    With `repeats` equal rows stay. Rows without a key are in no array. A small group moves once and meets itself in place. What is joined to the arrays on more than `keys` can stay where they are.
    """
    plain, crowded = split_crowded(df, keys, size)
    together = plain.select(*keys, *columns).dropna(subset=list(keys)).repartition(*keys)
    together = together if repeats else together.distinct()
    arrays = together.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("_all"))
    return arrays, None if crowded is None else crowded.drop("_n_blocks")


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], size: int, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
         schema: T.StructType, half: bool = False) -> DataFrame:
    """`fn` of every pair of blocks, `left` by `right`, of each value of `keys` that both sides have.

    The blocks' numbers are the columns `_i` and `_j`. With `half` only pairs with _i <= _j meet, for a table with itself.
    """
    keys = list(keys)

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    parts = blocks(left, "_n_left").join(blocks(right, "_n_right"), keys)

    def dealt(df: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))
        rows = df.join(parts, keys).withColumn(own, F.pmod(F.xxhash64(*df.columns), F.col(n_own)).cast("int")).withColumn(other, every)
        rows = rows.filter("_i <= _j") if half else rows
        # New names for the same columns, as both sides may come from one table.
        return rows.select(*[F.col(c).alias(c) for c in [*df.columns, "_i", "_j"]])

    by = [*keys, "_i", "_j"]
    first, second = dealt(left, "_i", "_n_left", "_j", "_n_right"), dealt(right, "_j", "_n_right", "_i", "_n_left")
    return first.groupBy(*by).cogroup(second.groupBy(*by)).applyInPandas(lambda a, b: fn(a, b), schema)


def fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]
