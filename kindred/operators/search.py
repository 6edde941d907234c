"""Titles: resolving, indexing, linking and completing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.ranking import rank_by
from kindred.operators.grams import best_similar


def resolve_title(requests: DataFrame, items: DataFrame, keep: str = "first", trim: bool = False) -> DataFrame:
    """(request, item_id, error): the id itself if known, else the first (or last) item with that title, any case."""
    def key(c: Column) -> Column:
        return F.lower(F.trim(c) if trim else c)

    choose = F.min_by if keep == "first" else F.max_by
    titles = items.groupBy(key(F.col("title")).alias("key")).agg(choose("item_id", "pos").alias("by_title"))
    ids = items.select(F.col("item_id").cast("string").alias("request"), F.col("item_id").alias("by_id")).distinct()
    found = F.coalesce("by_id", "by_title")
    return (
        requests.select("request").distinct().join(ids, "request", "left")
        .withColumn("key", key(F.col("request"))).join(titles, "key", "left")
        .select("request", found.alias("item_id"),
                F.when(found.isNull(), F.concat(F.lit("Movie '"), "request", F.lit("' not found"))).alias("error"))
    )


def link_title_year(wanted: DataFrame, items: DataFrame) -> DataFrame:
    """(title, year, item_id): first item with the title and, where a year is asked, that year."""
    title = F.lower(F.trim("title"))
    by_title = items.groupBy(title.alias("key")).agg(F.min_by("item_id", "pos").alias("any_year"))
    by_year = items.groupBy(title.alias("key"), "year").agg(F.min_by("item_id", "pos").alias("same_year"))
    return (
        wanted.select("title", "year", title.alias("key"))
        .join(by_title, "key", "left").join(by_year, ["key", "year"], "left")
        .select("title", "year", F.when(F.col("year").isNull(), F.col("any_year")).otherwise(F.col("same_year")).alias("item_id"))
    )


def title_index(items: DataFrame) -> DataFrame:
    """(title, candidates, first_id): how many items carry a title and which came first."""
    return items.groupBy("title").agg(
        F.count(F.lit(1)).alias("candidates"), F.min_by("item_id", "pos").alias("first_id")
    )


def title_candidates(items: DataFrame, titles: DataFrame) -> DataFrame:
    """All (title, item_id, year) of the asked titles, in long form so a popular title never becomes one row."""
    return items.select("title", "item_id", "year").join(titles.select("title").distinct(), "title", "left_semi")


def autocomplete(queries: DataFrame, items: DataFrame, n: int = 10, cutoff: float = 0.4) -> DataFrame:
    """Completions of each query of two or more characters: (query, item_id, title, year, rank).

    Up to n titles that start with the query, filled up with similar titles, then their items. Prefixes are
    an equi-join on the prefixes of the distinct titles that have the length of a query. Similar titles come from an
    index of the titles' q-grams (grams.py).
    """
    asked = queries.select(F.lower(F.trim("query")).alias("query")).filter(F.length("query") >= 2).distinct()
    titles = items.select("title").distinct().withColumn("key", F.lower("title"))
    sizes = asked.select(F.length("query").alias("size")).distinct().agg(F.collect_list("size")).scalar()  # the few lengths asked for
    lengths = F.explode(F.array_intersect(F.sequence(F.lit(2), F.length("key")), sizes)).alias("size")
    prefixes = titles.filter(F.length("key") >= 2).select("title", "key", lengths).select("title", F.substring(F.col("key"), F.lit(1), F.col("size")).alias("query"))
    starts = rank_by(prefixes.join(asked, "query", "left_semi"), n, ["query"], [F.col("title").asc()]).withColumn("stage", F.lit(1))
    have = starts.groupBy("query").agg(F.count(F.lit(1)).alias("have"))
    short = asked.join(have, "query", "left").filter(F.coalesce("have", F.lit(0)) < n)
    fuzzy = best_similar(short.select("query"), titles, starts, n, cutoff)
    listed = starts.select("query", "title", "stage", "rank").unionByName(
        fuzzy.select("query", "title", F.lit(2).alias("stage"), "rank")
    )
    place = [F.col("stage"), F.col("rank")]
    chosen = rank_by(listed.withColumn("place", F.struct(*place)).drop("rank"), n, ["query"], [F.col("place")])
    per_title = rank_by(items.select("title", "item_id", "year", "pos"), n, ["title"], [F.col("pos")]).drop("rank")
    return rank_by(
        chosen.select("query", "title", "place").join(per_title, "title"), n, ["query"], [F.col("place"), F.col("pos")]
    ).select("query", "item_id", "title", "year", "rank")
