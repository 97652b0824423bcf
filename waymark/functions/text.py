"""Cleaning of text fields. Nothing here fails on bad input, also under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark import fixed

NUMBER = r"^[+-]?\d+(\.\d+)?$"


def clean_numeric(text: Column, default: float | None = 0.0) -> Column:
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def clean_mcc(text: Column) -> Column:
    code = F.regexp_replace(text, '[,"]', "").try_cast("int")
    return F.coalesce(code, F.lit(fixed.DEFAULT_MCC))


def clean_currency(text: Column, default: int = fixed.DEFAULT_CURRENCY) -> Column:
    """Numbers beyond an integer count as missing."""
    return F.coalesce(clean_numeric(text, default).try_cast("int"), F.lit(default))


def clean_date(text: Column) -> Column:
    return text.try_cast("date")


def clean_coordinate(text: Column) -> Column:
    """A coordinate, or NULL where it is missing or the 0.0 that stands for missing."""
    return F.nullif(clean_numeric(text, None), F.lit(0.0))


def normalize_city(city: Column, names: dict[str, list[str]] | None = None) -> Column:
    """Upper case, known spellings to one name. `names` is a short dictionary, kept as a literal map."""
    names = fixed.CITY_NAMES if names is None else names
    pairs = [F.lit(text) for name, spellings in names.items() for s in spellings for text in (s, name)]
    upper = F.upper(F.coalesce(city, F.lit(fixed.UNKNOWN_CITY)))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), upper), upper) if pairs else upper


def unscale_amount(amount: Column) -> Column:
    """The amounts are decimal logarithms; a missing one counts as 10^0."""
    return F.pow(F.lit(10.0), F.coalesce(amount, F.lit(0.0)))


def repair_line(line: Column, repairs: dict[str, str] | None = None) -> Column:
    repairs = fixed.LINE_REPAIRS if repairs is None else repairs
    for broken, fixed_text in repairs.items():
        line = F.replace(line, F.lit(broken), F.lit(fixed_text))
    return line


def bare_text(text: Column) -> Column:
    """Text without quotes and backslashes, empty instead of NULL."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r'["\\]', "")
