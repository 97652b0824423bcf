"""CSV and GeoJSON output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions import text


def write_predictions(predictions: DataFrame, path: str, single_file: bool = False) -> None:
    """Customer, work and home as CSV with a header. One file only for results of modest size."""
    rows = predictions.select(*fixed.PREDICTION_COLUMNS)
    (rows.coalesce(1) if single_file else rows).write.option("header", True).csv(path)


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def _coordinate(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit(0.0)).cast("string"), F.lit("null"))


def transaction_fields(df: DataFrame) -> list[Column]:
    """The fields of the export, as text; missing coordinates are the text null."""
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    return [
        F.col("id").cast("string"),
        F.coalesce(F.col("amount"), F.lit(0.0)).cast("string"),
        F.col("amount_power10").cast("string"),
        _quoted(text.bare_text(F.col("atm_address"))),
        _coordinate("atm_lat"), _coordinate("atm_lon"),
        _quoted(empty("city")), _quoted(empty("country")), _quoted(empty("currency")), _quoted(empty("customer_id")),
        F.col("mcc").cast("string"),
        _quoted(text.bare_text(F.col("pos_address"))),
        _coordinate("pos_lat"), _coordinate("pos_lon"),
        _quoted(empty("terminal_id")),
        F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("")),
        F.col("lat").cast("string"), F.col("lon").cast("string"),
        F.col("operation_type").cast("string"),
    ]


def transaction_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(",", *transaction_fields(df)).alias("value"))


def train_lines(df: DataFrame) -> DataFrame:
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0)).cast("string")
    target = [zero("home_lat"), zero("home_lon"), _coordinate("work_lat"), _coordinate("work_lon")]
    return df.select(F.concat_ws(",", *transaction_fields(df), *target).alias("value"))


def export_transactions_csv(df: DataFrame, path: str) -> None:
    transaction_lines(df).write.text(path)


def export_train_csv(df: DataFrame, path: str) -> None:
    train_lines(df).write.text(path)


def geojson_feature(feature_id, lat, lon, hint, preset) -> Column:
    """One point as a GeoJSON feature; coordinates are latitude first, as the map viewer wants them."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        feature_id.alias("id"),
        F.struct(F.lit("Point").alias("type"), F.array(lat, lon).alias("coordinates")).alias("geometry"),
        F.struct(hint.alias("hintContent")).alias("properties"),
        F.struct(preset.alias("preset")).alias("options"),
    ))


def geojson_features(df: DataFrame) -> DataFrame:
    """customer_id and one feature per row, from id, lat, lon, hint, preset."""
    return df.select("customer_id", "id", _feature().alias("value"))


def _document_rows(df: DataFrame) -> DataFrame:
    """What the lines of `geojson_documents` are made of: the fields of the features, and two rows more for each customer."""
    fields = ["id", "lat", "lon", "hint", "preset"]
    ends = df.select("customer_id").distinct().withColumn("part", F.explode(F.array(F.lit(0), F.lit(2)))).select(
        "customer_id", F.struct("part", F.lit(0).cast("bigint").alias("id")).alias("_line"),
        *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in fields])
    features = df.select("customer_id", F.struct(F.lit(1).alias("part"), F.col("id").cast("bigint").alias("id")).alias("_line"), *fields)
    return ends.unionByName(features)


def _feature() -> Column:
    return geojson_feature(F.col("id"), F.col("lat"), F.col("lon"), F.col("hint"), F.col("preset"))


def _document_line() -> Column:
    sentinel = geojson_feature(F.lit(-1), F.lit(0.0), F.lit(0.0), F.lit(""), F.lit(fixed.SENTINEL_PRESET))
    part = F.col("_line.part")
    return F.when(part == 0, F.lit(fixed.DOCUMENT_OPENING)).when(part == 2, F.concat(sentinel, F.lit("]}"))).otherwise(F.concat(_feature(), F.lit(",")))


def geojson_documents(df: DataFrame) -> DataFrame:
    """The lines of one FeatureCollection per customer, with `_line` as their order.

    A document opens, has one feature a line, and closes with the sentinel feature -1. Lines are sorted rows, so
    a customer with very many points never becomes one value.
    """
    return _document_rows(df).select("customer_id", "_line", _document_line().alias("value"))


def export_geojson(df: DataFrame, path: str, documents: bool = True, buckets: int = 64, compression: str | None = None) -> None:
    """Lines of (customer_id, value) as JSON, in a folder per hash bucket of the customers.

    A customer's values in the order of the files are one document, or with documents=False one feature each. Files are
    ranges of customers and lines, so a customer with very many points is spread over several. The fields are sorted, and
    become text where they are written. `compression` is one of Spark's codecs for text, such as gzip; a feature has ten times
    the bytes of its fields, and little of that remains.
    """
    rows = _document_rows(df) if documents else df.select("customer_id", "id", "lat", "lon", "hint", "preset").withColumn("_line", F.col("id"))
    value = _document_line() if documents else _feature()
    order = ["bucket", "customer_id", "_line"]
    (
        rows.withColumn("bucket", F.pmod(F.xxhash64("customer_id"), F.lit(buckets)).cast("int"))
        .repartitionByRange(*order).sortWithinPartitions(*order).select("bucket", "customer_id", value.alias("value"))
        .write.partitionBy("bucket").json(path, compression=compression)
    )
