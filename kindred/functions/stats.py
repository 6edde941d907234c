"""Exact medians and ranges of whole columns without gathering a column in one task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
# The bracket is ten times wider than the percentiles' largest error in rank, so it always holds the middle.
BRACKET, PERCENTILE_ACCURACY = 0.001, 10_000


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column that has values: (feature, lo, hi, median).

    The values are counted first, so repeats collapse before any shuffle. Approximate percentiles just
    below and above the middle bracket the median, whatever outliers there are; its rank is located in a
    histogram of at most BUCKETS rows within the bracket, and only the values of the one or two buckets
    that hold it are ordered.
    """
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    counts = (
        doubles.unpivot([], list(columns), "feature", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    span = counts.groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("total")
    )
    brackets = doubles.agg(*[F.percentile_approx(c, [0.5 - BRACKET, 0.5 + BRACKET], PERCENTILE_ACCURACY).alias(c) for c in columns])
    brackets = brackets.unpivot([], list(columns), "feature", "bracket").select(
        "feature", F.col("bracket")[0].alias("from"), F.col("bracket")[1].alias("upto")
    )
    width = F.col("upto") - F.col("from")
    place = F.floor((F.col("value") - F.col("from")) / F.nullif(width, F.lit(0.0)) * (BUCKETS - 1))
    slot = F.when(F.col("value") < F.col("from"), -1).when(F.col("value") > F.col("upto"), BUCKETS).otherwise(F.coalesce(place, F.lit(0)))
    slotted = counts.join(span, "feature").join(brackets, "feature").withColumn("slot", slot.cast("int"))
    running = Window.partitionBy("feature").orderBy("slot")
    first_rank = F.floor((F.col("total") - 1) / 2)
    last_rank = F.floor(F.col("total") / 2)
    slots = (
        slotted.groupBy("feature", "slot")
        .agg(F.sum("n").alias("slot_n"), F.first("total").alias("total"))
        .withColumn("before_slot", F.sum("slot_n").over(running) - F.col("slot_n"))
        .filter((F.col("before_slot") <= last_rank) & (F.col("before_slot") + F.col("slot_n") > first_rank))
        .select("feature", "slot", "before_slot")
    )
    inside = Window.partitionBy("feature", "slot").orderBy("value")
    placed = (
        slotted.join(slots, ["feature", "slot"])
        .withColumn("start", F.col("before_slot") + F.sum("n").over(inside) - F.col("n"))
        .withColumn("stop", F.col("start") + F.col("n"))
    )
    def holds(rank: Column) -> Column:
        return (F.col("start") <= rank) & (F.col("stop") > rank)

    middle = placed.groupBy("feature").agg(
        F.max(F.when(holds(first_rank), F.col("value"))).alias("low_mid"),
        F.max(F.when(holds(last_rank), F.col("value"))).alias("high_mid"),
    )
    return span.join(middle, "feature").select(
        "feature", "lo", "hi", ((F.col("low_mid") + F.col("high_mid")) / 2).alias("median")
    )


def stats_lookup(df: DataFrame, columns: Sequence[str]) -> Column:
    """The statistics as one map column feature -> (lo, hi, median), a scalar subquery of bounded size."""
    entries = F.collect_list(F.struct("feature", F.struct("lo", "hi", "median").alias("stats")))
    return column_stats(df, columns).agg(F.map_from_entries(entries).alias("m")).scalar()
