"""Exact percentiles of many groups, however many distinct values one of them has."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import materialize

# Values of a group that are ordered in one task; a group with more is narrowed down first.
ROWS_AT_ONCE = 1_000_000
# Size of the sketches, the places at which they are read, and a share of ranks that is wide of their error.
SKETCH, STEPS, MARGIN = 800, 128, 0.01


def _narrowed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets (group, rank, lo, hi, before, size) with brackets of values [lo, hi] that hold a few hundredths of the values.

    `before` counts the group's values below lo and `size` those in the bracket. A sketch proposes two values a and b, exact
    counts decide: the answer is one of them, or lies below, between or above them. As a and b themselves are left out of every
    bracket, brackets shrink whatever the sketch proposes.
    """
    within = rows.join(targets, "group").filter(F.col("value").between(F.col("lo"), F.col("hi")))
    steps = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    sketches = within.groupBy("group", "rank").agg(F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("value", SKETCH), steps).alias("steps"))
    share = (F.col("rank") - F.col("before")) / F.col("size")
    low = F.greatest(F.lit(0), F.floor((share - MARGIN) * STEPS)).cast("int")
    high = F.least(F.lit(STEPS), F.ceil((share + MARGIN) * STEPS)).cast("int")
    proposed = targets.join(sketches, ["group", "rank"]).select("*", F.get("steps", low).alias("a"), F.get("steps", high).alias("b"))
    proposed = materialize(proposed.drop("steps"))
    value, a, b = F.col("value"), F.col("a"), F.col("b")
    counted = rows.join(proposed, "group").filter(value.between(F.col("lo"), F.col("hi"))).groupBy(*proposed.columns).agg(
        F.count_if(value < a).alias("under_a"), F.count_if(value <= a).alias("to_a"), F.count_if(value < b).alias("under_b"),
        F.count_if(value <= b).alias("to_b"), F.max(F.when(value < a, value)).alias("last_under_a"), F.min(F.when(value > a, value)).alias("first_over_a"),
        F.max(F.when(value < b, value)).alias("last_under_b"), F.min(F.when(value > b, value)).alias("first_over_b"),
    )
    place = F.col("rank") - F.col("before")

    def either(below, at_a, between, at_b, above) -> Column:
        columns = [F.col(x) if isinstance(x, str) else x for x in (below, at_a, between, at_b, above)]
        found = F.when(place < F.col("under_a"), columns[0]).when(place < F.col("to_a"), columns[1])
        return found.when(place < F.col("under_b"), columns[2]).when(place < F.col("to_b"), columns[3]).otherwise(columns[4])

    return counted.select(
        "group", "rank", either("lo", "a", "first_over_a", "b", "first_over_b").alias("lo"),
        either("last_under_a", "a", "last_under_b", "b", "hi").alias("hi"),
        (F.col("before") + either(F.lit(0), "under_a", "to_a", "under_b", "to_b")).alias("before"),
        either("under_a", F.col("to_a") - F.col("under_a"), F.col("under_b") - F.col("to_a"), F.col("to_b") - F.col("under_b"), F.col("size") - F.col("to_b")).alias("size"),
    )


def group_percentiles(rows: DataFrame, shares: Sequence[float], at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """(group, share, value): percentiles of (group, value), interpolated between the two values next to the place.

    A group of more than `at_once` values is cut down round by round to brackets around the two ranks that are asked for; then
    the values of the brackets are counted and ordered. Null values count for nothing.
    """
    rows = rows.filter("value is not null").select("group", F.col("value").cast("double").alias("value"))
    ends = rows.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    asked = ends.select("*", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    asked = materialize(asked.withColumn("place", (F.col("size") - 1) * F.col("share")))
    targets = asked.select("group", "lo", "hi", "size", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    targets = materialize(targets.select("group", "rank", "lo", "hi", F.lit(0).cast("long").alias("before"), "size"))
    wide = (F.col("size") > at_once) & (F.col("lo") < F.col("hi"))
    while not targets.filter(wide).isEmpty():
        targets = materialize(_narrowed(rows, targets.filter(wide)).unionByName(targets.filter(~wide)))
    known = targets.filter("lo = hi").select("group", "rank", F.col("lo").alias("value"))
    open_ = targets.filter("lo < hi")
    counts = rows.join(open_.select("group", "rank", "lo", "hi", "before"), "group").filter(F.col("value").between(F.col("lo"), F.col("hi")))
    counts = counts.groupBy("group", "rank", "before", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("group", "rank").orderBy("value"))
    found = counts.withColumn("upto", upto).filter("rank < upto and rank >= upto - n").select("group", "rank", "value")
    values = known.unionByName(found)
    low = values.select("group", F.col("rank").alias("low"), F.col("value").alias("low_value"))
    high = values.select("group", F.col("rank").alias("high"), F.col("value").alias("high_value"))
    placed = asked.select("group", "share", "place", F.floor("place").alias("low"), F.ceil("place").alias("high"))
    part = F.col("place") - F.col("low")
    return placed.join(low, ["group", "low"]).join(high, ["group", "high"]).select(
        "group", "share", F.when(part == 0, F.col("low_value")).otherwise((1 - part) * F.col("low_value") + part * F.col("high_value")).alias("value")
    )
