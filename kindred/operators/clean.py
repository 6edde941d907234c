"""Catalogue cleaning: aliases, defaults, numbers, duplicates."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import scalars
from kindred.functions.stats import stats_lookup

# Accepted names of the id column, first match wins.
ID_NAMES = ("item_id", "imdb_id", "id", "movie_id")


def id_name(columns: Sequence[str], fall_back: bool = False) -> str | None:
    for name in ID_NAMES:
        if name in columns:
            return name
    return columns[0] if fall_back else None


def dedupe_first(items: DataFrame, key: str = "item_id", order: str = "pos") -> DataFrame:
    """Keep the first row of every id in ingest order."""
    first = Window.partitionBy(key).orderBy(order)
    return items.withColumn("_row", F.row_number().over(first)).filter("_row = 1").drop("_row")


def pick(columns: Sequence[str], *names: str) -> Column | None:
    """The first of ``names`` that the frame has."""
    for name in names:
        if name in columns:
            return F.col(name)
    return None


def canonicalize(items: DataFrame) -> DataFrame:
    """Alias columns to the canonical names and fill missing text; numbers are parsed, not yet imputed."""
    have = items.columns
    out: dict[str, Column] = {}
    for name, default, sources in (
        ("title", "Unknown", ("title",)),
        ("genre", "Unknown", ("genre", "genres")),
        ("director", "Unknown", ("director",)),
        ("actors", "Unknown", ("cast", "actors")),
    ):
        source = pick(have, *sources)
        if source is not None:
            out[name] = F.coalesce(source, F.lit(default))
    plot = pick(have, "plot", "overview")
    out["plot"] = F.lit("") if plot is None else F.coalesce(plot, F.lit(""))
    year = pick(have, "year", "release_date")
    if year is not None:
        out["year"] = scalars.extract_year(year)
    rating = pick(have, "imdb_rating", "vote_average", "rating")
    if rating is not None:
        out["rating"] = scalars.number(rating)
    if "metascore" in have:
        out["metascore"] = scalars.number(F.col("metascore"))
    runtime = pick(have, "runtime")
    out["runtime_minutes"] = F.lit(None).cast("int") if runtime is None else scalars.extract_runtime(runtime)
    votes = pick(have, "imdb_votes", "vote_count", "votes")
    if votes is not None:
        out["votes"] = scalars.clean_votes(votes)
    key = id_name(have)
    replaced = {"imdb_rating", "vote_average", "imdb_votes", "vote_count", "runtime", "genres", "overview", "release_date"}
    rest = [F.col(c) for c in have if c not in out and c not in replaced and c != key]
    lead = [F.col(key).alias("item_id")] if key else []
    return items.select(*lead, *[c.alias(n) for n, c in out.items()], *rest)


def impute_median(items: DataFrame, columns: Sequence[str] = ("rating", "metascore"), stats: Column | None = None) -> DataFrame:
    """Fill gaps with the column median; a rating column without any value becomes 0."""
    present = [c for c in columns if c in items.columns]
    if not present:
        return items
    items = items.withColumn("_stats", stats_lookup(items, present) if stats is None else stats)
    filled = {}
    for c in present:
        last = [F.lit(0.0)] if c == "rating" else []
        filled[c] = F.coalesce(F.col(c), F.col("_stats")[c]["median"], *last)
    return items.withColumns(filled).drop("_stats")


def tidy_catalogue(items: DataFrame, order: str | None = "pos") -> DataFrame:
    """Deduplicate and canonicalise. ``order`` is the ingest position that decides which duplicate stays.

    Without that column, rows with an id cannot be deduplicated, which is an error; ``order=None`` says that ids are unique.
    """
    key = id_name(items.columns)
    if key and order is not None:
        if order not in items.columns:
            raise ValueError(f"no ingest position {order!r} to tell which of several rows with one {key} came first")
        items = dedupe_first(items, key, order)
    return canonicalize(items)


def clean_catalogue(items: DataFrame, order: str | None = "pos") -> DataFrame:
    """Deduplicate, canonicalise and impute."""
    return impute_median(tidy_catalogue(items, order))


def complete_rows(items: DataFrame) -> DataFrame:
    """Items whose genre, director and year are known."""
    return items.filter(
        "genre is not null and director is not null and year is not null and genre <> 'Unknown' and director <> 'Unknown'"
    )
