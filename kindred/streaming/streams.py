"""Structured Streaming forms of ingest and activity analytics.

Each reads a folder of landed files, keeps state only within its watermark and stores offsets and state
in ``checkpoint``. ``availableNow`` empties the backlog and stops, which is how a resumable batch runs.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kindred.functions.ranking import rank_by
from kindred.operators import activity as act
from kindred.operators.clean import dedupe_first
from kindred.sources.log import Log


def read_folder(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.load(path)


def run(df: DataFrame, path: str, checkpoint: str, mode: str = "append", kind: str = "parquet") -> StreamingQuery:
    """Write what has arrived to a file sink and stop."""
    return df.writeStream.format(kind).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start()


def interaction_ingest(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Valid interaction events, once per event id within the watermark."""
    return (
        events.filter("user_id is not null and action is not null and ts is not null")
        .withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    )


WRONG_EVENT = "action is null or ts is null or event_id is null"


ID_BUCKETS = 16


def ingest_with_quarantine(events: DataFrame, good: str, bad: str, checkpoint: str, no_user: str | None = None) -> StreamingQuery:
    """Every valid event once to one folder, malformed ones to another, however late they arrive.

    A batch writes folders of its own, by bucket of the event id and day of the event, and looks for its ids in the same
    buckets of all earlier batches, whatever their day; a retry repeats it exactly. There is no watermark, so no late event
    is lost. Well-formed events without a user go with a reason to `no_user`, by default the folder of malformed ones with
    `_no_user` added to its name.
    """
    spark = events.sparkSession
    no_user = no_user or f"{bad.rstrip('/')}_no_user"

    def write(batch: DataFrame, number: int) -> None:
        batch.filter(WRONG_EVENT).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.filter(f"user_id is null and not ({WRONG_EVENT})").withColumn("reason", F.lit("no user")).write.mode("overwrite").parquet(f"{no_user}/batch={number}")
        fresh = batch.filter(f"user_id is not null and not ({WRONG_EVENT})").dropDuplicates(["event_id"])
        fresh = fresh.withColumns({"bucket": F.pmod(F.xxhash64("event_id"), F.lit(ID_BUCKETS)).cast("int"), "day": F.to_date("ts")})
        if number > 0:
            kind = fresh.schema["event_id"].dataType.simpleString()
            stored = spark.read.schema(f"event_id {kind}, batch int, bucket int").parquet(good).filter(F.col("batch") < number)
            own = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
            known = stored.filter(F.col("bucket").isin(own)).select("event_id")
            fresh = fresh.join(known, "event_id", "left_anti")
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket", "day").parquet(f"{good}/batch={number}")

    def store(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # written three times, read from its files once
        try:
            write(kept, number)
        finally:
            kept.unpersist()

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity_counts_windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, lateness: str = "1 day") -> DataFrame:
    return act.activity_counts(events.withWatermark("ts", lateness), width, slide)


def session_stream(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """Closed sessions of every user."""
    late = events.filter("user_id is not null").withWatermark("ts", lateness)
    return late.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("events")).select(
        "user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events"
    )


def _newest_counts(stored: DataFrame) -> DataFrame:
    return stored.groupBy("window_start", "window_end", "item_id").agg(F.max_by("n", "version").alias("n"), F.max("version").alias("version"))


def trending_log(spark: SparkSession, path: str, most: int = 16) -> Log:
    return Log(spark, path, _newest_counts, most)


def trending_windowed(events: DataFrame, path: str, checkpoint: str, width: str = "1 day", slide: str = "6 hours",
                      lateness: str = "1 day") -> StreamingQuery:
    """Counts per window and item in update mode; each batch stores the counts that changed.

    A batch is a numbered part of a log that is merged now and then, so a batch that runs twice counts once and reading costs
    the same after many batches.
    """
    counts = act.item_counts(events.withWatermark("ts", lateness), width, slide)
    log = trending_log(events.sparkSession, path)

    def store(batch: DataFrame, number: int) -> None:
        log.append(number, batch)

    return counts.writeStream.outputMode("update").foreachBatch(store).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()


def read_trending(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """The n most used items per window from the newest stored counts."""
    newest = _newest_counts(trending_log(spark, path).read()).drop("version")
    return rank_by(newest, n, ["window_start"], [F.col("n").desc(), F.col("item_id")])


def _merged_traces(stored: DataFrame) -> DataFrame:
    return stored.groupBy("trace_id").agg(
        F.max("request").alias("request"), F.max("prediction").alias("prediction"), F.sum("external_calls").alias("external_calls"),
        F.max("version").alias("version"),
    )


def trace_log(spark: SparkSession, path: str, most: int = 16) -> Log:
    return Log(spark, path, _merged_traces, most)


def trace_stream(traces: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Trace records kept current: each batch stores its own audit rows in a log, readers combine them.

    A trace's latest request and prediction are maxima by position and its calls are a sum, so partial
    records of batches merge exactly and no state is held.
    """
    log = trace_log(traces.sparkSession, path)

    def store(batch: DataFrame, number: int) -> None:
        def latest(kind: str):
            at = F.when(F.col("type") == kind, F.col("pos"))
            return F.max(F.when(at.isNotNull(), F.struct(at.alias("pos"), "data"))).alias(kind)

        log.append(number, batch.groupBy("trace_id").agg(
            latest("request"), latest("prediction"), F.count_if(F.col("type") == "external_api").alias("external_calls")
        ))

    return traces.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_trace_records(spark: SparkSession, path: str) -> DataFrame:
    merged = _merged_traces(trace_log(spark, path).read())
    return merged.select("trace_id", F.col("request.data").alias("request"), F.col("prediction.data").alias("prediction"), "external_calls")


def answered_requests(traces: DataFrame, within: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Stream-stream join of requests with the predictions that follow within an interval (traces with ``ts``)."""
    asked = traces.filter("type = 'request'").select(F.col("trace_id").alias("trace_id"), F.col("ts").alias("asked_at"), F.col("data").alias("request"))
    told = traces.filter("type = 'prediction'").select(F.col("trace_id").alias("told_id"), F.col("ts").alias("told_at"), F.col("data").alias("prediction"))
    near = F.expr(f"trace_id = told_id and told_at >= asked_at and told_at <= asked_at + interval {within}")
    return asked.withWatermark("asked_at", lateness).join(told.withWatermark("told_at", lateness), near)


def catalogue_delta_stream(pages: DataFrame, path: str, checkpoint: str, key: str = "item_id") -> StreamingQuery:
    """Merge arriving catalogue pages: only ids that are not stored yet are added, the first one wins.

    A batch writes its own folder and looks only at folders of earlier batches, so a retry repeats it exactly.
    """
    spark = pages.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        fresh = dedupe_first(batch, key)
        if number > 0:
            stored = spark.read.schema(f"{key} {fresh.schema[key].dataType.simpleString()}, batch int").parquet(path).filter(F.col("batch") < number)
            fresh = fresh.join(stored.select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
