"""The user view kept current by deltas of events, added and taken back, without reading all activity again."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.operators.activity import action_counts, with_favourites
from kindred.sources.log import Log

COUNTS = ["view_count", "save_count", "search_count", "events"]


def _per_day(activity: DataFrame) -> DataFrame:
    days = activity.filter("user_id is not null").withColumn("day", F.to_date("ts"))
    return days.groupBy("user_id", "day").agg(*action_counts(), F.count(F.lit(1)).alias("events"))


def _merge(stored: DataFrame) -> DataFrame:
    """One row for each user and day: the newest row that stands for the whole day, and what was added after it."""
    whole = F.max(F.when(F.col("whole"), F.col("version"))).over(Window.partitionBy("user_id", "day"))
    valid = stored.withColumn("_whole", whole).filter("_whole is null or version > _whole or (whole and version = _whole)")
    sums = [F.sum(c).alias(c) for c in COUNTS]
    return valid.groupBy("user_id", "day").agg(*sums, F.max("last_active_at").alias("last_active_at"), F.bool_or("whole").alias("whole"), F.max("version").alias("version"))


def user_view(spark: SparkSession, folder: str, most: int = 16) -> Log:
    return Log(spark, folder, _merge, most)


def apply_delta(view: Log, number: int, added: DataFrame, removed: DataFrame | None = None, activity: DataFrame | None = None) -> bool:
    """Takes the events of a delta into the view; a number that counts already changes nothing.

    Added events are counted per user and day and add up with what is stored. A removed event may have been its user's latest, so
    the days of removed events are counted anew: from `activity`, all events as they are after the delta, of these users and
    days only. Events without a user are left out; those without a time have a day of their own. An event must not come twice.
    """
    fresh = _per_day(added).withColumn("whole", F.lit(False))
    if removed is not None:
        touched = removed.filter("user_id is not null").select(F.col("user_id").alias("_user"), F.to_date("ts").alias("_day")).distinct()

        def same(df: DataFrame):
            return (df["user_id"] == F.col("_user")) & df["day"].eqNullSafe(F.col("_day"))

        left = activity.withColumn("day", F.to_date("ts"))
        counted = _per_day(left.join(touched, same(left), "left_semi").drop("day"))
        anew = touched.join(counted, same(counted), "left").select(
            F.col("_user").alias("user_id"), F.col("_day").alias("day"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS],
            "last_active_at", F.lit(True).alias("whole"),
        )
        fresh = fresh.join(touched, same(fresh), "left_anti").unionByName(anew)
    return view.append(number, fresh)


def read_user_view(view: Log, preferences: DataFrame, fanout: bool = False) -> DataFrame:
    """What `user_features` gives for all events that the view has taken in."""
    counts = _merge(view.read()).groupBy("user_id").agg(*[F.sum(c).alias(c) for c in COUNTS], F.max("last_active_at").alias("last_active_at"))
    return with_favourites(counts.filter("events > 0").drop("events"), preferences, fanout)
