"""CSV, JSON and parquet sources and sinks, and made-up sample tables."""

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.ranking import number_rows

# Other spellings of the ratings columns.
RATING_ALIASES = {"userId": "user_id", "movieId": "movie_id", "item_id": "movie_id"}
RATING_COLUMNS = ("user_id", "movie_id", "rating")


def read_csv(spark: SparkSession, path: str, required: Sequence[str] = (), types: dict[str, str] | None = None,
             multi_line: bool = False, position: str | None = None) -> DataFrame:
    """CSV with a header and quoted fields; columns are strings unless ``types`` says otherwise.

    ``position`` names a column that is added, unless the file has it: a text that sorts like the rows in their files, files by
    name. It tells which of several rows with one id came first.

    A missing file and missing required columns are errors; the latter names them. ``multi_line`` allows
    line breaks inside quotes, at the price of one task per file.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    try:
        names = reader.option("multiLine", multi_line).csv(path).columns
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"file not found: {path}") from error
        raise
    check_columns(names, required)
    types = types or {}
    schema = T.StructType([T.StructField(n, T.DataType.fromDDL(types.get(n, "string"))) for n in names])
    rows = reader.schema(schema).csv(path)
    if position is None or position in names:
        return rows
    digits = [F.lpad(c.cast("string"), 20, "0") for c in (F.col("_metadata.file_block_start"), F.monotonically_increasing_id())]
    return rows.withColumn(position, F.concat_ws("|", "_metadata.file_path", *digits))


def check_columns(names: Sequence[str], required: Sequence[str]) -> None:
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def load_catalogue(spark: SparkSession, path: str, required: Sequence[str] = (), **options) -> DataFrame:
    """Catalogue rows with their ingest position ``pos``."""
    return read_csv(spark, path, required, **{"position": "pos"} | options)


def load_ratings(spark: SparkSession, path: str, **options) -> DataFrame:
    """(user_id, item_id, rating) from a ratings CSV; camelCase headers are accepted."""
    raw = read_csv(spark, path, **options)
    raw = raw.withColumnsRenamed({k: v for k, v in RATING_ALIASES.items() if k in raw.columns})
    check_columns(raw.columns, RATING_COLUMNS)
    return raw.select("user_id", F.col("movie_id").alias("item_id"), F.col("rating").try_cast("double").alias("rating"))


def dataset_summary(items: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row: items, ratings, users, rated items, mean ratings per user."""
    size = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ratings.agg(
        F.count(F.lit(1)).alias("ratings"), F.count_distinct("user_id").alias("users"),
        F.count_distinct("item_id").alias("rated_items"),
    ).select(size.alias("items"), "ratings", "users", "rated_items",
             F.try_divide(F.col("ratings"), F.col("users")).alias("ratings_per_user"))


MADE_UP = ["Harbour", "Meadow", "Orbit", "Lantern", "Quarry", "Velvet", "Winter"]


def _draw(seed: int, salt: str, low: int, high: int, *keys: str) -> Column:
    """Repeatable integer in low..high from a row's key, by a digest that other engines have too."""
    return F.pmod(_digest(f"{salt}{seed}", *keys), F.lit(high - low + 1)) + low


def _digest(salt: str, *keys: str | Column) -> Column:
    """32 bits of the MD5 of ``key|key|salt``."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def synth_catalogue(rows: DataFrame, seed: int = 42) -> DataFrame:
    """One made-up item per row of ``rows`` (n, counting from 1): every value depends on n and the seed only."""
    def draw(salt: str, low: int, high: int) -> Column:
        return _draw(seed, salt, low, high, "n")

    def pick(salt: str) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in MADE_UP]), draw(salt, 1, len(MADE_UP)).cast("int"))

    return rows.select(
        F.format_string("made%09d", F.col("n").cast("long")).alias("imdb_id"),
        F.concat_ws(" ", pick("t1"), pick("t2"), F.col("n").cast("string")).alias("title"),
        draw("year", 1970, 2023).cast("int").alias("year"),
        F.array_join(F.array_distinct(F.array(pick("g1"), pick("g2"))), ", ").alias("genre"),
        (draw("rating", 50, 95) / 10).alias("imdb_rating"),
        draw("meta", 30, 100).cast("int").alias("metascore"),
        F.concat(draw("runtime", 80, 180).cast("string"), F.lit(" min")).alias("runtime"),
        F.concat_ws(" ", pick("d1"), draw("d2", 1, 9).cast("string")).alias("director"),
        F.concat(pick("a1"), F.lit(" "), draw("a2", 10, 19).cast("string"), F.lit(", "), pick("a3"), F.lit(" "), draw("a4", 20, 29).cast("string")).alias("actors"),
        F.concat_ws(" ", pick("p1"), F.lit("and"), pick("p2"), F.lit("meet"), pick("p3")).alias("plot"),
        F.element_at(F.array(F.lit("xx"), F.lit("yy")), draw("language", 1, 2).cast("int")).alias("language"),
        F.concat(F.lit("Land "), draw("country", 1, 5).cast("string")).alias("country"),
        draw("votes", 1000, 100000).alias("imdb_votes"),
    )


def sample_rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", "n")


def synth_ratings(users: DataFrame, items: DataFrame, low: int = 5, high: int = 29, seed: int = 42) -> DataFrame:
    """low..high distinct items per user with ratings 1..10, the same on every run.

    Each user draws numbered slots and looks their items up by position, so users never meet the
    whole catalogue. Slots that hit the same item count once; spare slots make up for them. A user's slots stay in one row until
    the spare ones are dropped.
    """
    ids = items.select("item_id").distinct().withColumn("h", _digest(f"item{seed}", "item_id"))
    size = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = number_rows(ids, "h", "item_id", "place").drop("h")
    slots = F.sequence(F.lit(0), F.lit(4 * high))
    places = F.array_distinct(F.transform(slots, lambda slot: F.pmod(_digest(f"slot{seed}", F.col("user_id"), slot), F.col("size"))))
    kept = users.select("user_id").distinct().withColumn("size", size).select(
        "user_id", F.explode(F.slice(places, F.lit(1), _draw(seed, "count", low, high, "user_id").cast("int"))).alias("place")
    )
    return kept.join(placed, "place").select(
        "user_id", "item_id", _draw(seed, "rating", 1, 10, "user_id", "item_id").cast("double").alias("rating")
    )


def csv_sink(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV files with a header; Spark's committer makes a job's output appear as a whole."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


TRACE_SCHEMA = (
    "trace_id string, run_id string, timestamp string, type string, data string, api string, status string, "
    "latency_ms double, metrics string, params string, _corrupt string"
)


def trace_append(entries: DataFrame, path: str) -> None:
    """Append trace entries as JSON lines. A ``seconds`` column becomes latency_ms with two digits."""
    if "seconds" in entries.columns:
        entries = entries.withColumn("latency_ms", F.round(F.col("seconds") * 1000, 2)).drop("seconds")
    entries.write.mode("append").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace entries of JSON lines; unreadable lines are left out."""
    rows = spark.read.schema(TRACE_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter("_corrupt is null").drop("_corrupt")


def save_tables(folder: str, tables: dict[str, DataFrame]) -> None:
    """Write fitted state (catalogue, term weights, factors ...) as parquet tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
