"""Transactions and apartments from CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions import text
from waymark.sources import lines as L


def _fields(lines: DataFrame, header: str, names: list[str], repairs, keep=()) -> DataFrame:
    rows = L.repair_lines(L.drop_header(lines, header), repairs)
    return L.pad_columns(L.split_csv_lines(rows, names, keep=keep).drop(L.ODD_LINE), names)


def resolve_point(df: DataFrame) -> DataFrame:
    """`lat`, `lon`: the ATM point where its latitude is positive, else the POS point."""
    at_atm = F.col("atm_lat") > 0
    return df.withColumns({
        "lat": F.when(at_atm, F.col("atm_lat")).otherwise(F.col("pos_lat")),
        "lon": F.when(at_atm, F.col("atm_lon")).otherwise(F.col("pos_lon")),
    })


def operation_type(pos_lat=None):
    """0 for a purchase at a POS point, 1 for anything else."""
    return F.when((F.col("pos_lat") if pos_lat is None else pos_lat) > 0, 0).otherwise(1)


def clean_transactions(fields: DataFrame, city_names=None) -> DataFrame:
    """Typed columns from string fields. Home and work are converted where present."""
    coordinates = [c for c in fields.columns if c.endswith("_lat") or c.endswith("_lon")]
    typed = fields.withColumns({
        "amount": F.when(F.col("amount").isNotNull(), text.clean_numeric(F.col("amount"))),
        "city": text.normalize_city(F.col("city"), city_names),
        "country": F.coalesce("country", F.lit("")),
        "currency": text.clean_currency(F.col("currency")),
        "customer_id": F.coalesce("customer_id", F.lit("")),
        "mcc": text.clean_mcc(F.col("mcc")),
        "date": text.clean_date(F.col("date")),
        **{c: text.clean_coordinate(F.col(c)) for c in coordinates},
    })
    return resolve_point(typed).withColumns({
        "amount_power10": text.unscale_amount(F.col("amount")),
        "operation_type": operation_type(),
    })


def valid_transactions(df: DataFrame) -> DataFrame:
    """Rows with a point of positive latitude and a date."""
    return df.filter((F.col("lat") > 0) & F.col("date").isNotNull())


def parse_test_transactions(lines: DataFrame, repairs=None, city_names=None) -> DataFrame:
    return valid_transactions(clean_transactions(
        _fields(lines, fixed.TRANSACTION_HEADER, fixed.TEST_COLUMNS, repairs), city_names))


def parse_train_transactions(lines: DataFrame, repairs=None, city_names=None) -> DataFrame:
    return valid_transactions(clean_transactions(
        _fields(lines, fixed.TRANSACTION_HEADER, fixed.TRAIN_COLUMNS, repairs), city_names))


def parse_apartments(lines: DataFrame) -> DataFrame:
    rows = L.drop_header(lines, fixed.APARTMENT_HEADER)
    rows = L.pad_columns(L.split_csv_lines(rows, fixed.APARTMENT_COLUMNS).drop(L.ODD_LINE), fixed.APARTMENT_COLUMNS)
    floors = F.split("floors", r"\.\.")
    return rows.select(
        text.clean_numeric(F.col("lat")).alias("lat"),
        text.clean_numeric(F.col("lon")).alias("lon"),
        F.col("year").try_cast("int").alias("year"),
        F.coalesce(F.when(F.size(floors) >= 2, F.element_at(floors, -1).try_cast("int")), F.lit(1)).alias("floor"),
        F.coalesce(F.col("units").try_cast("int"), F.lit(1)).alias("units"),
        F.coalesce(F.col("parking").try_cast("int"), F.lit(0)).alias("parking"),
    )


def read_test_transactions(spark: SparkSession, path: str, **options) -> DataFrame:
    return L.add_row_id(parse_test_transactions(L.read_lines(spark, path), **options))


def read_train_transactions(spark: SparkSession, path: str, **options) -> DataFrame:
    return L.add_row_id(parse_train_transactions(L.read_lines(spark, path), **options))


def read_apartments(spark: SparkSession, path: str) -> DataFrame:
    return L.add_row_id(parse_apartments(L.read_lines(spark, path)), name="apartment_id")
