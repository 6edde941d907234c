"""Adapters from the star-schema parquet tables to the model: ratings, catalogue, activity and the rest."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.session import stored


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """One row per purchase line: (user_id, item_id, rating); a pair may repeat."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
        (F.col("l_quantity") / 5).alias("rating"),
    )


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (user_id, item_id) with the mean rating, joined and averaged once: every step of a query reads the stored rows."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return stored(
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
        .agg((F.avg("l_quantity") / 5).alias("rating"))
    )


def casts(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, cast) with the distinct supplier names of an item as one comma string."""
    supplied = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()
    names = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    return (
        supplied.join(names, supplied.l_suppkey == names.s_suppkey)
        .groupBy(F.col("l_partkey").alias("item_id"))
        .agg(F.array_join(F.array_sort(F.collect_set("s_name")), ", ").alias("cast"))
    )


def catalogue(spark: SparkSession, folder: str, with_cast: bool = False) -> DataFrame:
    """Items from the part table in the canonical layout."""
    sold = table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("votes"))
    parts = table(spark, folder, "part")
    items = parts.join(sold, parts.p_partkey == sold.l_partkey, "left").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        F.regexp_replace("p_name", " ", ", ").alias("genre"),
        F.col("p_brand").alias("director"),
        (F.col("p_size") + 1970).alias("year"),
        ((F.col("p_retailprice") - 900) / 10).alias("rating"),
        F.coalesce("votes", F.lit(0)).alias("votes"),
        F.coalesce("votes", F.lit(0)).cast("double").alias("popularity"),
        F.col("p_type").alias("plot"),
        F.col("p_partkey").alias("pos"),
    )
    if not with_cast:
        return items
    return items.join(casts(spark, folder), "item_id", "left")


def text_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Items from the documents table: the whole text is the plot."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("plot"), F.col("lang").alias("language"),
        F.col("source").alias("director"), F.col("doc_id").alias("pos"),
    )


# Event type of the events table -> action of the activity log.
ACTIONS = {
    "view": "view",
    "click": "search",
    "purchase": "add_watchlist",
    "signup": "onboarding_complete",
    "error": "remove_watchlist",
}


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, user_id, action, item_id, ts, value) from the events table."""
    return activity_of(table(spark, folder, "events"))


def activity_of(events: DataFrame) -> DataFrame:
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[F.col("event_type")]
    return events.select(
        "event_id", "user_id", action.alias("action"),
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        F.col("ts").cast("timestamp").alias("ts"), "value",
    )


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.lower(F.regexp_replace("c_name", "#", "_")).alias("username"),
        F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("bio"),
        (F.col("c_acctbal") > 0).alias("onboarding_completed"),
    )


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """(trace_id, pos, type, data) from the conversations table."""
    return traces_of(table(spark, folder, "conversations"))


def traces_of(turns: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("role") == "user", "request")
        .when(F.col("role") == "assistant", "prediction")
        .otherwise("external_api")
    )
    return turns.select(
        F.col("conv_id").alias("trace_id"), F.col("turn").alias("pos"), kind.alias("type"), F.col("text").alias("data")
    )


def embedding_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(id, dims, ws) of the dense vectors, as they are stored: one row each."""
    ws = F.transform("embedding", lambda w: w.cast("double"))
    return table(spark, folder, "embeddings").filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").alias("id"), F.when(F.size("embedding") > 0, F.sequence(F.lit(0), F.size("embedding") - 1)).otherwise(F.array().cast("array<int>")).alias("dims"), ws.alias("ws")
    )
