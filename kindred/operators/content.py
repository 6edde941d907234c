"""Content-based neighbours, recommendations and catalogue look-ups."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.ranking import OUTPUT_DIGITS, rank_by, top_n
from kindred.functions.text import known_names, name_list
from kindred.operators import features
from kindred.operators import similarity as sim
from kindred.session import stored

_JOINER = "\u0001"


def rating_column(items: DataFrame) -> Column:
    """The rating of a catalogue by column presence: vote_average, then imdb_rating, then rating."""
    for name in ("vote_average", "imdb_rating", "rating"):
        if name in items.columns:
            return F.col(name)
    return F.lit(0.0)


def content_cosine(weights: DataFrame, size: sim.Extent) -> DataFrame:
    """(a, b, sim) of all item pairs that share a term."""
    return sim.cosine_pairs(features.tfidf_cells(weights), normalized=True, size=size)


def feature_cosine(items: DataFrame) -> DataFrame:
    """(a, b, sim) of all item pairs over genre flags and normalised numbers."""
    return sim.cosine_pairs(features.feature_cells(items), size=features.feature_extent(items))


def similar_content(
    weights: DataFrame, size: sim.Extent, n: int = 10, targets: DataFrame | None = None, min_similarity: float | None = None
) -> DataFrame:
    """(item_id, neighbour_id, score, rank): nearest items by text.

    With ``min_similarity`` all items at or above it count, at 0 also those that share no term, which fill short lists up.
    Without it only items that share a term count.
    """
    ids = None if targets is None else targets.select(F.col("item_id").alias("id"))
    floor = sim.ABOVE_ZERO if min_similarity is None else min_similarity
    found = sim.cosine_topn(features.tfidf_cells(weights), n, ids, floor=floor, normalized=True, size=size)
    return found.withColumnRenamed("item_id", "neighbour_id").withColumnRenamed("target_id", "item_id")


def recommend_for_liked(
    liked: DataFrame, weights: DataFrame, items: DataFrame, size: sim.Extent, n: int = 10, exclude: DataFrame | None = None,
    digits: int | None = OUTPUT_DIGITS,
) -> DataFrame:
    """Top-n items per user by mean similarity to the liked items that are in the catalogue.

    The mean of cosines to several unit vectors is the product with their mean vector, so each user becomes
    one profile vector and no liked-by-candidate pairs are formed.
    """
    weights = stored(weights)  # read for the profiles and for the candidates
    known = liked.select("user_id", "item_id").join(items.select("item_id"), "item_id", "left_semi")
    per_user = known.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_known"))
    # An item's terms travel as one row to its users, and everything of a user meets there.
    texts = weights.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    met = known.join(texts, "item_id").select("user_id", "terms").repartition("user_id").select("user_id", F.explode("terms").alias("t"))
    profiles = (
        met.groupBy("user_id", F.col("t.term").alias("term")).agg(F.sum("t.weight").alias("w"))
        .join(per_user, "user_id")
        .select(F.col("user_id").alias("id"), F.col("term").alias("dim"), (F.col("w") / F.col("n_known")).alias("w"))
    )
    barred = liked.select(F.col("user_id").alias("id"), F.col("item_id").alias("dim"))
    if exclude is not None:
        barred = barred.unionByName(exclude.select(F.col("user_id").alias("id"), F.col("item_id").alias("dim"))).distinct()
    users = liked.select("user_id").distinct().count()
    found = sim.block_topn(sim.pack(profiles), sim.pack(features.tfidf_cells(weights)), n, users, size.rows, exclude=barred, digits=digits)
    return found.withColumnRenamed("target_id", "user_id")


def _pattern(words: Sequence[str], literal: bool) -> str:
    return "(?i)" + "|".join(rf"\Q{w}\E" if literal else w for w in words)


def recommend_by_features(
    items: DataFrame,
    genres: Sequence[str] | None = None,
    directors: Sequence[str] | None = None,
    min_rating: float | None = None,
    year_range: tuple[int, int] | None = None,
    n: int = 10,
    literal: bool = False,
) -> DataFrame:
    """Items that meet every given preference, best rating first. Names are regular expressions unless ``literal``."""
    rating = rating_column(items)
    if genres:
        items = items.filter(F.col("genre").rlike(_pattern(genres, literal)))
    if directors:
        items = items.filter(F.col("director").rlike(_pattern(directors, literal)))
    if min_rating is not None:
        items = items.filter(rating >= min_rating)
    if year_range is not None:
        items = items.filter(F.col("year").between(*year_range))
    return items.select("item_id", "title", "genre", rating.alias("rating"), "year", "director").orderBy(
        F.col("rating").desc_nulls_last(), F.col("item_id")
    ).limit(n)


def recommend_by_genre(items: DataFrame, genres: Sequence[str], n: int = 10, min_rating: float | None = None,
                       literal: bool = False) -> DataFrame:
    return recommend_by_features(items, genres, None, min_rating, None, n, literal).drop("director")


def item_info(targets: DataFrame, items: DataFrame) -> DataFrame:
    """Details of the asked items with defaults for what is missing; unknown ids give no row."""
    def text(name: str, default: str) -> Column:
        return (F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in items.columns else F.lit(default)).alias(name)

    rating = rating_column(items)
    details = items.select(
        "item_id", text("title", "Unknown"), text("genre", "Unknown"), text("year", "Unknown"),
        F.coalesce(rating, F.lit(0.0)).alias("rating"), text("director", "Unknown"), text("actors", "Unknown"),
        text("plot", "No plot available"),
    )
    return targets.select("item_id").join(details, "item_id")


def _better(rating: str = "rating", *more: str) -> list[Column]:
    return [F.col(rating).desc_nulls_last(), *[F.col(m).desc_nulls_last() for m in more], F.col("neighbour_id").asc()]


def _targets(items: DataFrame, targets: DataFrame | None) -> DataFrame:
    return items if targets is None else items.join(targets.select("item_id").distinct(), "item_id", "left_semi")


def _from_shortlist(targets: DataFrame, shortlist: DataFrame, key: str, n: int, order: list[Column]) -> DataFrame:
    """Answer targets from n+1 pre-ranked candidates per key: one of them can only be the target itself.

    A key's candidates are one sorted list, so the answer is cut from it and no candidate is sorted again for a target. Only where
    an id has several rows their candidates are ranked together.
    """
    own = targets.groupBy("item_id").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias(key))
    lists = shortlist.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour_id", "rating"))).alias("listed"))
    others = F.filter("listed", lambda x: x["neighbour_id"] != F.col("item_id"))
    cut = own.filter("copies = 1").join(lists, key).select("item_id", F.posexplode(F.slice(others, 1, n)).alias("at", "found"))
    repeated = targets.join(own.filter("copies > 1").select("item_id"), "item_id", "left_semi")
    joined = repeated.select("item_id", key).join(shortlist.drop("rank"), key).filter("item_id <> neighbour_id")
    found = cut.select("item_id", "found.neighbour_id", "found.rating", (F.col("at") + 1).alias("rank"))
    return found.unionByName(rank_by(joined, n, ["item_id"], order).select("item_id", "neighbour_id", "rating", "rank")).select(
        "item_id", "neighbour_id", F.round("rating", 6).alias("score"), "rank"
    )


# Sets of up to so many genres offer all their subsets; of wider ones too many would exist.
MOST_GENRES = 8


def _subsets(names: Column) -> Column:
    """All non-empty subsets of a sorted array, joined."""
    masks = F.sequence(F.lit(1), F.shiftleft(F.lit(1), MOST_GENRES) - 1)
    own = F.filter(masks, lambda m: m < F.pow(F.lit(2), F.size(names)))
    return F.transform(own, lambda m: F.array_join(F.filter(names, lambda _, i: F.getbit(m, i) == 1), _JOINER))


def _overlaps(wanted: DataFrame, best: DataFrame) -> DataFrame:
    """(genres, neighbour_id, rating, shared) for sets that meet on a genre."""
    flat = best.select(F.col("genres").alias("other"), "names").distinct().select("other", F.explode("names").alias("name"))
    pairs = wanted.select("genres", F.explode("names").alias("name")).join(flat, "name").groupBy("genres", "other").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.join(best.select(F.col("genres").alias("other"), "neighbour_id", "rating"), "other").drop("other")


def similar_genre(items: DataFrame, n: int = 10, targets: DataFrame | None = None, most: int = MOST_GENRES) -> DataFrame:
    """Other items that share a genre: most shared genres first, then rating.

    Items with equal genre sets are interchangeable as to overlap, so only the n+1 best of each set can
    ever be listed. Every subset of genres keeps a list of the n+1 best items that have all of them, pruned before the shuffle.
    A set reads the lists of its own subsets and no other set: an item that shares exactly the genres U is among the n+1 best
    only if it is so in the list of U, as all that come before it there share U too. The longest subset that lists it is U.
    Sets of more than `most` genres would have too many subsets; they meet the others on single genres.
    """
    rating = rating_column(items).cast("double")
    tagged = items.select(
        "item_id", rating.alias("rating"), F.array_sort(known_names(F.col("genre"))).alias("names")
    ).filter(F.size("names") > 0).withColumn("genres", F.array_join("names", _JOINER))
    best = rank_by(
        tagged.select("genres", "names", F.col("item_id").alias("neighbour_id"), "rating"), n + 1, ["genres"], _better()
    ).drop("rank")
    asked = _targets(tagged, targets)
    sets = asked.select("genres", "names").distinct()
    narrow = F.size("names") <= min(most, MOST_GENRES)
    lists = rank_by(
        best.filter(narrow).select(F.explode(_subsets(F.col("names"))).alias("subset"), "neighbour_id", "rating"), n + 1, ["subset"], _better()
    ).drop("rank")
    subsets = sets.filter(narrow).select("genres", F.explode(_subsets(F.col("names"))).alias("subset"))
    shared = F.size(F.split("subset", _JOINER))
    listed = subsets.join(lists, "subset").groupBy("genres", "neighbour_id", "rating").agg(F.max(shared).cast("long").alias("shared"))
    overlap = listed.unionByName(_overlaps(sets.filter(~narrow), best)).unionByName(_overlaps(sets.filter(narrow), best.filter(~narrow)))
    order = [F.col("shared").desc(), *_better()]
    shortlist = rank_by(overlap, n + 1, ["genres"], order)
    return _from_shortlist(asked, shortlist, "genres", n, order)


def same_director(items: DataFrame, n: int = 10, targets: DataFrame | None = None) -> DataFrame:
    """Other items of the same director by rating."""
    known = items.filter("director is not null and director <> 'Unknown'").select(
        "item_id", "director", rating_column(items).cast("double").alias("rating")
    )
    best = rank_by(known.withColumnRenamed("item_id", "neighbour_id"), n + 1, ["director"], _better())
    return _from_shortlist(_targets(known, targets), best, "director", n, _better())


def popular_that_year(items: DataFrame, n: int = 10, targets: DataFrame | None = None) -> DataFrame:
    """Other items of the same year by rating, then popularity."""
    popularity = F.col("popularity") if "popularity" in items.columns else F.lit(0.0)
    known = items.select(
        "item_id", F.substring(F.col("year").cast("string"), 1, 4).alias("year"),
        rating_column(items).cast("double").alias("rating"), popularity.cast("double").alias("popularity"),
    ).filter("year is not null and year <> 'Unknown'")
    order = _better("rating", "popularity")
    best = rank_by(known.withColumnRenamed("item_id", "neighbour_id"), n + 1, ["year"], order)
    return _from_shortlist(_targets(known, targets), best, "year", n, order)


def categorized(items: DataFrame, weights: DataFrame, size: sim.Extent, n: int = 10, targets: DataFrame | None = None) -> DataFrame:
    """The four lists of every target: (item_id, category, neighbour_id, score, rank)."""
    lists = {
        "similar_genre": similar_genre(items, n, targets),
        "same_director": same_director(items, n, targets),
        "popular_that_year": popular_that_year(items, n, targets),
        "similar_content": similar_content(weights, size, n, targets),
    }
    union = None
    for name, found in lists.items():
        tagged = found.select("item_id", F.lit(name).alias("category"), "neighbour_id", "score", "rank")
        union = tagged if union is None else union.unionByName(tagged)
    return union


def _actor_items(items: DataFrame) -> DataFrame:
    names = F.array_distinct(F.filter(name_list(F.lower(F.col("cast"))), lambda x: x != ""))
    return items.select(
        F.explode(names).alias("actor"), "item_id",
        F.coalesce(rating_column(items).cast("double"), F.lit(0.0)).alias("rating"),
    )


def items_by_actor(items: DataFrame, n: int = 20, actors: DataFrame | None = None) -> DataFrame:
    """Best rated items of every actor (or of the names in ``actors``), matched by whole lower-case name."""
    if "cast" not in items.columns:
        return items.sparkSession.createDataFrame([], "actor string, item_id bigint, score double, rank int")
    cast = _actor_items(items)
    if actors is not None:
        cast = cast.join(actors.select(F.lower(F.trim("actor")).alias("actor")).distinct(), "actor", "left_semi")
    return top_n(cast.withColumnRenamed("rating", "score"), n, ["actor"])


def actor_profile(items: DataFrame, actors: DataFrame, reach: int = 100) -> DataFrame:
    """Count, mean rating, five best items and all ids over an actor's best ``reach`` items; zeros for unknown names."""
    cast = _actor_items(items).join(actors.select(F.lower(F.trim("actor")).alias("actor")).distinct(), "actor", "left_semi")
    films = rank_by(cast, reach, ["actor"], [F.col("rating").desc(), F.col("item_id")])
    told = films.join(items.select("item_id", "title", F.col("year").cast("string").alias("year"), "genre"), "item_id")
    entry = F.struct("rank", F.col("item_id").alias("movie_id"), "title", "rating", "year", "genre")
    stats = told.groupBy("actor").agg(
        F.count(F.lit(1)).alias("total_movies"), F.round(F.avg("rating"), 2).alias("average_rating"),
        F.array_sort(F.collect_list(entry)).alias("films"),
    )
    asked = actors.select(F.col("actor").alias("actor_name"), F.lower(F.trim("actor")).alias("actor")).distinct()
    return asked.join(stats, "actor", "left").select(
        "actor_name",
        F.coalesce("total_movies", F.lit(0)).alias("total_movies"),
        F.coalesce("average_rating", F.lit(0.0)).alias("average_rating"),
        F.coalesce(F.slice("films", 1, 5), F.array().cast(stats.schema["films"].dataType)).alias("top_movies"),
        F.coalesce(F.col("films.movie_id").cast("array<string>"), F.array().cast("array<string>")).alias("all_movie_ids"),
    )


def item_cast(items: DataFrame) -> DataFrame:
    """(item_id, title, cast array): the cast column, else actors; 'Unknown' and NULL give an empty list."""
    def usable(name: str) -> Column:
        if name not in items.columns:
            return F.lit(None).cast("string")
        return F.nullif(F.nullif(F.col(name), F.lit("")), F.lit("Unknown"))

    packed = F.coalesce(usable("cast"), usable("actors"))
    names = F.when(packed.isNull(), F.array().cast("array<string>")).otherwise(name_list(packed))
    return items.select("item_id", "title", names.alias("cast"))
