"""Scalar cleaning rules as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_year(text: Column) -> Column:
    """First run of four digits as an int, else NULL ('2010-2015' gives 2010)."""
    return F.regexp_extract(text.cast("string"), r"(\d{4})", 1).try_cast("int")


def extract_runtime(text: Column) -> Column:
    """First digit run as an int ('142 min' gives 142), else NULL."""
    return F.regexp_extract(text.cast("string"), r"(\d+)", 1).try_cast("int")


def clean_votes(text: Column) -> Column:
    """Vote count without thousands separators; anything unreadable or NULL counts 0."""
    plain = F.regexp_replace(text.cast("string"), ",", "")
    return F.coalesce(plain.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def number(text: Column) -> Column:
    """Numeric value or NULL ('N/A' gives NULL)."""
    return text.try_cast("double")
