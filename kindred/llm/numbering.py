"""Gapless numbers for the rows of large groups, without one task holding a group."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SLICE = 20_000


def numbered(rows: DataFrame, group: str, order: list[str], name: str, per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... within each `group`.

    Rows are dealt into hash slices of their `order` columns, counted by (group, slice), and numbered inside a slice; the
    counts of the slices before give the offset. Numbers follow the slices, then `order`; rows equal in all of `order` are
    interchangeable and must be few. Only (group, slice) counts are windowed by group: one row for `per_slice` rows.
    """
    n = max(1, -(-rows.count() // per_slice))
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = sliced.groupBy(group, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_slice").orderBy(*order)
    local = sliced.withColumn("_row", F.row_number().over(inside) - 1)
    return local.join(offsets, [group, "_slice"]).withColumn(name, (F.col("_offset") + F.col("_row")).cast("long")).drop("_slice", "_row", "_offset")
