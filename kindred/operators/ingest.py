"""Catalogue ingest: credits, genre ids, filters, enrichment and merging."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.ranking import number_rows
from kindred.operators.clean import dedupe_first

BATCHES_PER_SLICE = 10_000

PAYLOAD_SCHEMA = (
    "id bigint, genres array<struct<name string>>, release_date string, overview string, "
    "credits struct<crew array<struct<job string, name string>>, cast array<struct<name string>>>"
)

# Genre ids of the movie API and their names.
GENRE_NAMES = {
    12: "Adventure", 14: "Fantasy", 16: "Animation", 18: "Drama", 27: "Horror", 28: "Action", 35: "Comedy",
    36: "History", 37: "Western", 53: "Thriller", 80: "Crime", 99: "Documentary", 878: "Science Fiction",
    9648: "Mystery", 10402: "Music", 10749: "Romance", 10751: "Family", 10752: "War", 10770: "TV Movie",
}

# Fixed values: (votes, rating) floors of the quality tiers, strictest first.
QUALITY_TIERS = {"strict": (5, 3.0), "loose": (1, 3.0), "any": (1, 0.0)}


def union_catalogues(catalogues: Sequence[DataFrame], key: str = "item_id") -> DataFrame:
    """One catalogue from several with differing columns; of equal ids the earlier catalogue's first row stays."""
    union = None
    for origin, items in enumerate(catalogues):
        tagged = items.withColumn("origin", F.lit(origin))
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    first = Window.partitionBy(key).orderBy("origin", "pos")
    return union.withColumn("_row", F.row_number().over(first)).filter("_row = 1").drop("_row")


def extract_credits(payloads: DataFrame, missing: str | None = None, max_cast: int = 5) -> DataFrame:
    """(id, genre, director, cast, year, overview) from the JSON column ``payload``.

    The cast is cut to ``max_cast`` names before empty ones drop out; ``missing`` fills what is not there.
    """
    parsed = payloads.select(F.from_json("payload", PAYLOAD_SCHEMA).alias("p")).select("p.*")
    director = F.get(F.filter("credits.crew", lambda c: c["job"] == "Director"), F.lit(0))["name"]
    cast = F.filter(F.slice(F.col("credits.cast.name"), 1, max_cast), lambda x: x.isNotNull() & (x != ""))
    genres = F.filter(F.col("genres.name"), lambda x: x.isNotNull() & (x != ""))

    def joined(names: Column) -> Column:
        return F.coalesce(F.when(F.size(names) > 0, F.array_join(names, ", ")), F.lit(missing).cast("string"))

    return parsed.select(
        "id", joined(genres).alias("genre"), F.coalesce(director, F.lit(missing).cast("string")).alias("director"),
        joined(cast).alias("cast"), F.substring("release_date", 1, 4).alias("year"), "overview",
    )


def map_genre_ids(ids: Column, limit: int = 3) -> Column:
    """The first three genre ids as names, 'Unknown' for an unknown id."""
    names = F.create_map(*[F.lit(x) for pair in GENRE_NAMES.items() for x in pair])
    return F.array_join(F.transform(F.slice(ids, 1, limit), lambda x: F.coalesce(F.try_element_at(names, x), F.lit("Unknown"))), ", ")


def quality_filter(items: DataFrame, min_votes: int = 5, min_rating: float = 3.0, page: int | None = None,
                   page_size: int = 20) -> DataFrame:
    """Items with enough votes and rating that are not adult; with ``page`` one page of them by popularity."""
    kept = items.filter((F.col("votes") >= min_votes) & (F.col("rating") >= min_rating))
    if "adult" in items.columns:
        kept = kept.filter(~F.coalesce("adult", F.lit(False)))
    if page is None:
        return kept
    return kept.orderBy(F.col("popularity").desc(), F.col("item_id")).offset((page - 1) * page_size).limit(page_size)


def quality_tiers(items: DataFrame, tiers: dict[str, tuple[int, float]] = QUALITY_TIERS) -> DataFrame:
    """(tier, items) for each threshold pair, in one pass."""
    counted = items.agg(*[
        F.count_if((F.col("votes") >= votes) & (F.col("rating") >= rating)).alias(name)
        for name, (votes, rating) in tiers.items()
    ])
    return counted.unpivot([], list(tiers), "tier", "items")


def needs_enrichment(items: DataFrame, columns: Sequence[str] = ("genre", "cast"), marker: str | None = None) -> DataFrame:
    """Rows where any of the columns is NULL (or equals ``marker``). Columns that are not there count as missing."""
    for c in columns:
        if c not in items.columns:
            items = items.withColumn(c, F.lit(marker).cast("string"))
    test = F.lit(False)
    for c in columns:
        test = test | (F.col(c).isNull() if marker is None else F.col(c) == marker)
    return items.filter(F.coalesce(test, F.lit(False)))


def overlay_existing(items: DataFrame, existing: DataFrame, columns: Sequence[str] = ("genre", "director", "year", "cast"),
                     key: str = "item_id") -> DataFrame:
    """Replace the columns by the values of earlier enriched rows; ids without one get NULL."""
    present = [c for c in columns if c in existing.columns]
    once = dedupe_first(existing, key).select(key, *[F.col(c).alias(f"{c}_existing") for c in present])
    kept = [c for c in items.columns if c not in columns]
    values = [(F.col(f"{c}_existing") if c in present else F.lit(None).cast("string")).alias(c) for c in columns]
    return items.select(*kept).join(once, key, "left").select(*kept, *values)


def apply_enrichment(items: DataFrame, results: DataFrame, columns: Sequence[str] = ("genre", "director", "cast", "year"),
                     key: str = "item_id", failed: str | None = None, order: str = "pos") -> DataFrame:
    """Take the columns from successful results (``ok``). Failed rows keep their values, or become ``failed``.

    Of several results of one id the last by ``order`` counts.
    """
    if order not in results.columns:
        raise ValueError(f"no position {order!r} to tell which of several results of one {key} came last")
    told = F.max_by(F.struct("ok", *[F.col(c).alias(f"{c}_new") for c in columns]), order)
    news = results.groupBy(key).agg(told.alias("_told")).select(key, "_told.*")
    updated = {}
    for c in columns:
        value = F.when(F.col("ok"), F.col(f"{c}_new"))
        if failed is not None:
            value = value.when(~F.col("ok"), F.lit(failed))
        updated[c] = value.otherwise(F.col(c))
    return items.join(news, key, "left").withColumns(updated).drop("ok", *[f"{c}_new" for c in columns])


def append_dedupe(existing: DataFrame, new: DataFrame, key: str = "item_id") -> DataFrame:
    """Existing rows and the new ones whose id is not there yet; the first of equal new ids wins."""
    fresh = dedupe_first(new, key).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def enrichment_report(results: DataFrame, batch_size: int = 100, order: str = "pos") -> DataFrame:
    """(batch, ok, failed, total_ok, remaining) per batch of rows in order."""
    numbered = number_rows(results.select(order, "ok"), order).withColumn("batch", F.floor(F.col("row") / batch_size) + 1)
    batches = numbered.groupBy("batch").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))
    batches = batches.withColumn("slice", F.floor(F.col("batch") / BATCHES_PER_SLICE))
    sums = batches.groupBy("slice").agg(F.sum("ok").alias("s_ok"), F.sum(F.col("ok") + F.col("failed")).alias("s_all"))
    earlier = Window.orderBy("slice")  # one row per slice of batches
    before = sums.select(
        "slice", (F.sum("s_ok").over(earlier) - F.col("s_ok")).alias("ok_before"), (F.sum("s_all").over(earlier) - F.col("s_all")).alias("all_before")
    )
    running = Window.partitionBy("slice").orderBy("batch")
    total = results.agg(F.count(F.lit(1)).alias("n")).scalar()
    done = F.col("all_before") + F.sum(F.col("ok") + F.col("failed")).over(running)
    return batches.join(before, "slice").select(
        "batch", "ok", "failed", (F.col("ok_before") + F.sum("ok").over(running)).alias("total_ok"), (total - done).alias("remaining")
    )
