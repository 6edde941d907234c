"""The ranking rule shared by every top-n operator."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import materialize

RANK_DIGITS = 9
OUTPUT_DIGITS = 6


def top_n(
    df: DataFrame,
    n: int,
    partition: Sequence[str],
    score: str = "score",
    tie: str = "item_id",
    first: Sequence[Column] = (),
    digits: int | None = OUTPUT_DIGITS,
) -> DataFrame:
    """Keep the n best rows per partition: score rounded to 9 digits descending, then id ascending.

    ``first`` holds sort keys that go before the score. ``digits=None`` leaves the scores unrounded, for
    lists that are combined further. Row numbers compared with a constant let
    Spark prune every partition to n rows before the shuffle, so a hot key never gathers in a task.
    """
    order = [*first, F.round(F.col(score), RANK_DIGITS).desc(), F.col(tie).asc()]
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    kept = ranked.filter(F.col("rank") <= n)
    return kept if digits is None else kept.withColumn(score, F.round(F.col(score), digits))


def rank_by(df: DataFrame, n: int, partition: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the n first rows per partition in the given order, numbered from 1."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


ROWS_PER_SLICE = 100_000


def number_rows(df: DataFrame, order: str, tie: str | None = None, name: str = "row") -> DataFrame:
    """Number all rows from 0 by a column without ordering the table in one task.

    Rows are dealt by sampled ranges of (order, tie), so an outlier or a crowded region does not fill one slice, and numbered
    inside their slice; the counts of the slices before it are added. The dealt rows are checkpointed, as a second sample could
    deal them otherwise. Only one count for ROWS_PER_SLICE rows meets in one task. Rows equal in both columns share a slice.
    """
    keys = [order, *([tie] if tie else [])]
    slices = max(1, -(-df.count() // ROWS_PER_SLICE))
    sliced = materialize(df.repartitionByRange(slices, *keys).withColumn("_slice", F.spark_partition_id()))
    before = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")
    ).drop("_n")
    inside = Window.partitionBy("_slice").orderBy(*keys)
    return sliced.join(before, "_slice").withColumn(
        name, F.col("_before") + F.row_number().over(inside) - 1
    ).drop("_slice", "_before")
