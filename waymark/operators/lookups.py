"""Equi-joins, filters and set operations on customers and points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions import geo
from waymark.materialize import cut_lineage


def target_point(target: str) -> tuple[Column, Column]:
    """The columns of the known home or work."""
    return F.col(f"{target}_lat"), F.col(f"{target}_lon")


#: Rows of a lookup table up to which it is broadcast.
BROADCAST_ROWS = 200_000


def lookup_join(df: DataFrame, table: DataFrame, on: str | Sequence[str], value: str, default, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add `value` from a table with one row per key, `default` where it has none.

    The table is written and counted. Up to `broadcast_rows` rows it is broadcast, so `df` isn't shuffled on a hot key;
    larger ones are joined by a shuffle, whose skewed partitions AQE splits.
    """
    keys = [on] if isinstance(on, str) else list(on)
    stored = cut_lineage(table.select(*keys, value))
    found = df.join(F.broadcast(stored) if stored.count() <= broadcast_rows else stored, keys, "left")
    return found.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def keep_near_target(tx: DataFrame, target: str, radius: float = fixed.KEEP_RADIUS) -> DataFrame:
    """All rows of customers with a row within `radius` of their target, or with a row without one."""
    lat, lon = target_point(target)
    near = geo.within_radius(F.col("lat"), F.col("lon"), lat, lon, radius)
    kept = tx.filter(near | lat.isNull() | lon.isNull()).select("customer_id").distinct()
    return tx.join(kept, "customer_id", "left_semi")


def shared_point_join(test: DataFrame, characteristic: DataFrame) -> DataFrame:
    """Test customers at the exact place of a characteristic point."""
    visited = test.filter("lat > 0").select(F.col("customer_id").alias("test_customer_id"), "lat", "lon").distinct()
    return visited.join(characteristic, ["lat", "lon"])


def keep_defined(tx: DataFrame, resolved: DataFrame) -> DataFrame:
    return tx.join(resolved.select("customer_id"), "customer_id", "left_semi")


def exclude_defined(tx: DataFrame, resolved: DataFrame) -> DataFrame:
    return tx.join(resolved.select("customer_id"), "customer_id", "left_anti")


def assemble_predictions(customers: DataFrame, work: DataFrame, home: DataFrame) -> DataFrame:
    """One row per customer with predicted work and home (customer_id, lat, lon each), 0.0 for none."""
    def named(points, kind):
        return points.select("customer_id", F.col("lat").alias(f"_{kind}_LAT_"), F.col("lon").alias(f"_{kind}_LON_"))

    joined = (
        customers.select("customer_id").distinct()
        .join(named(work, "WORK"), "customer_id", "left").join(named(home, "HOME"), "customer_id", "left")
    )
    names = ["_WORK_LAT_", "_WORK_LON_", "_HOME_LAT_", "_HOME_LON_"]
    return joined.select(F.col("customer_id").alias("_ID_"), *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def result_summary(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.count(F.lit(1)).alias("results"),
        F.count_if(F.col("_WORK_LAT_") > 0).alias("work_found"),
        F.count_if(F.col("_HOME_LAT_") > 0).alias("home_found"),
    )


def union_train_test(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All rows of both, of the named columns."""
    return train.select(*columns).unionByName(test.select(*columns))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def category_dictionaries(tables: Sequence[DataFrame], columns: Sequence[str]) -> dict[str, DataFrame]:
    """(value, idx) for each column: the distinct values of all tables, numbered from 0 in their order, null first.

    The columns are stacked, so each table is read once. For columns whose text gives the value back: codes, names, dates.
    """
    from waymark.sources.lines import add_row_id

    kinds = dict(tables[0].select(*columns).dtypes)
    both = tables[0].select(*columns)
    for more in tables[1:]:
        both = both.unionByName(more.select(*columns))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_pair")
    values = cut_lineage(both.select(pairs).select("_pair.column", "_pair.value").distinct())
    return {c: add_row_id(values.filter(F.col("column") == c).select(F.col("value").cast(kinds[c]).alias("value")), ["value"], "idx") for c in columns}


def category_dictionary(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """`category_dictionaries` of one column of two tables."""
    return category_dictionaries([train, test], [column])[column]
