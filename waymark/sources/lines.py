"""Raw CSV lines to string columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import text
from waymark.materialize import Written

CSV_OPTIONS = {"sep": ",", "quote": '"', "escape": "\\", "mode": "PERMISSIVE"}
ODD_LINE = "_odd_line"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def drop_header(lines: DataFrame, marker: str, column: str = "value") -> DataFrame:
    """Without any line that holds the marker text."""
    return lines.filter(~F.contains(F.col(column), F.lit(marker)))


def repair_lines(lines: DataFrame, repairs: dict[str, str] | None = None, column: str = "value") -> DataFrame:
    return lines.withColumn(column, text.repair_line(F.col(column), repairs))


def split_csv_lines(lines: DataFrame, names: Sequence[str], column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """String columns `names` in the order of the fields. A line with too few or too many fields is read
    as far as it goes and shows up whole in `_odd_line`. A line is parsed once: as an array that is exploded, since filters on the
    fields would otherwise be pushed below the parser and parse the line again for each mention of a field."""
    schema = ", ".join(f"`{n}` string" for n in [*names, ODD_LINE])
    options = {**CSV_OPTIONS, "columnNameOfCorruptRecord": ODD_LINE}
    parsed = F.from_csv(F.col(column), schema, options)
    return lines.select(*keep, F.explode(F.array(parsed)).alias("_fields")).select(*keep, "_fields.*")


def pad_columns(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns, trimmed, NULL where the row has none."""
    have = set(rows.columns)
    return rows.select(
        *[c for c in rows.columns if c not in names],
        *[(F.trim(F.col(n)) if n in have else F.lit(None).cast("string")).alias(n) for n in names],
    )


def add_row_id(df: DataFrame, order_by: Sequence[str] = (), name: str = "id", start: int = 0) -> DataFrame:
    """A unique id per row. With `order_by`, dense ids in that order.

    Dense ids come from a range-partitioned, sorted table: place in the partition plus
    the size of the partitions before. No row passes through a single task.
    """
    if not order_by:
        return df.withColumn(name, F.monotonically_increasing_id())
    ranged = Written(
        df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
        .withColumn("_at", F.monotonically_increasing_id())
    ).df
    part = F.shiftright("_at", 33)
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect()
    # One entry per partition of the table, not per row; the partition's number is its place in the array.
    rows_of = {r["_part"]: r["_n"] for r in sizes}
    offset, offsets = start, []
    for p in range(max(rows_of, default=0) + 1):
        offsets.append(offset)
        offset += rows_of.get(p, 0)
    known = F.array(*[F.lit(o).cast("bigint") for o in offsets])
    return ranged.withColumn(name, F.element_at(known, (part + 1).cast("int")) + place).drop("_at")
