"""Text and numeric features of a catalogue."""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.stats import stats_lookup
from kindred.functions.text import ENGLISH_STOP_WORDS, is_stop_word, known_names, tokens
from kindred.operators.similarity import Extent

MAX_BROADCAST_TERMS = 100_000
NUMERIC_FEATURES = ("rating", "metascore", "runtime_minutes", "year")


def genre_vocabulary(items: DataFrame) -> DataFrame:
    """Distinct genre names without the missing markers."""
    return items.select(F.explode(known_names(F.col("genre"))).alias("name")).distinct()


def genre_flags(items: DataFrame, match: str = "token") -> DataFrame:
    """Long one-hot form: (item_id, name) for every genre an item carries.

    ``match='substring'`` also sets a genre whose name only occurs inside the genre string. That form joins the substrings of
    the distinct genre strings with the vocabulary.
    """
    if match == "token":
        return items.select("item_id", F.explode(known_names(F.col("genre"))).alias("name"))
    strings = items.select("genre").distinct()
    upto = lambda n: F.sequence(F.lit(1), n)
    size = F.length("genre")
    parts = F.flatten(F.transform(upto(size), lambda i: F.transform(upto(size - i + 1), lambda n: F.substring(F.col("genre"), i, n))))
    found = strings.filter(size > 0).select("genre", F.explode(F.array_distinct(parts)).alias("name"))
    hits = found.join(genre_vocabulary(items).select("name").distinct(), "name", "left_semi")
    return items.select("item_id", "genre").join(hits, "genre").select("item_id", "name")


def genre_onehot(items: DataFrame, names: Sequence[str]) -> DataFrame:
    """Wide one-hot columns ``genre_<name>`` for a given (bounded) vocabulary."""
    have = known_names(F.col("genre"))
    return items.select("*", *[F.array_contains(have, n).cast("int").alias(f"genre_{n}") for n in names])


def combined_text(columns: Sequence[str]) -> Column:
    """Plot, genre, director and actors (those present) joined by blanks."""
    present = [c for c in ("plot", "genre", "director", "actors") if c in columns]
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in present]) if present else F.lit("")


def minmax_normalize(items: DataFrame, columns: Sequence[str] = NUMERIC_FEATURES, stats: Column | None = None) -> DataFrame:
    """Median-fill and scale to 0..1: adds ``<c>_normalized`` for each present column (NULL if it has no values).

    ``stats`` are known statistics; filling gaps with the median changes none of them.
    """
    present = [c for c in columns if c in items.columns]
    items = items.withColumn("_stats", stats_lookup(items, present) if stats is None else stats)
    scaled = []
    for c in present:
        s = F.col("_stats")[c]
        value = F.coalesce(F.col(c).cast("double"), s["median"])
        spread = s["hi"] - s["lo"]
        scaled.append(
            F.when(spread == 0, 0.0).otherwise((value - s["lo"]) / F.nullif(spread, F.lit(0.0))).alias(f"{c}_normalized")
        )
    return items.select("*", *scaled).drop("_stats")


def term_counts(items: DataFrame, text: str, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """(item_id, term, tf) over the whole texts."""
    words = items.select("item_id", F.explode(tokens(F.col(text))).alias("term"))
    kept = F.col("term").isNotNull() & ~is_stop_word(F.col("term"), stop_words)  # a join asks for non-null terms
    return words.filter(kept).groupBy("item_id", "term").agg(
        F.count(F.lit(1)).alias("tf")
    )


def tfidf(
    items: DataFrame,
    text: str = "combined_text",
    max_features: int = 1000,
    stop_words: Iterable[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """(item_id, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), scaled to length 1 per item.

    The vocabulary is the ``max_features`` most frequent terms (ties by term). It is a top-k of fixed size,
    so it is broadcast; beyond MAX_BROADCAST_TERMS Spark picks the join.
    """
    counts = term_counts(items, text, stop_words)
    total = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    vocabulary = (
        counts.groupBy("term").agg(F.sum("tf").alias("total_tf"), F.count(F.lit(1)).alias("df"))
        .orderBy(F.col("total_tf").desc(), F.col("term")).limit(max_features)
        .select("term", (F.log((1 + total) / (1 + F.col("df"))) + 1).alias("idf"))
    )
    if max_features <= MAX_BROADCAST_TERMS:
        vocabulary = F.broadcast(vocabulary)
    weighted = counts.join(vocabulary, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("item_id")))
    return weighted.select("item_id", "term", (F.col("raw") / norm).alias("weight"))


def tfidf_cells(weights: DataFrame) -> DataFrame:
    return weights.select(F.col("item_id").alias("id"), F.col("term").alias("dim"), F.col("weight").alias("w"))


def tfidf_extent(items: DataFrame, max_features: int = 1000) -> Extent:
    """Bound of the TF-IDF vectors: one per item, never longer than the vocabulary."""
    return Extent(items.count(), max_features)


def feature_extent(items: DataFrame, columns: Sequence[str] = NUMERIC_FEATURES) -> Extent:
    """Bound of the feature vectors: one per item, as long as the most genres of an item and the numbers."""
    names = F.size(known_names(F.col("genre"))) if "genre" in items.columns else F.lit(0)
    row = items.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max(names), F.lit(0)).alias("most")).first()
    return Extent(row["rows"], row["most"] + len([c for c in columns if c in items.columns]))


def feature_cells(items: DataFrame, columns: Sequence[str] = NUMERIC_FEATURES) -> DataFrame:
    """Sparse cells (id, dim, w) of the genre flags and normalised numbers; absent values are 0."""
    present = [c for c in columns if c in items.columns]
    if not present and "genre" not in items.columns:
        raise ValueError("no genre or numeric feature column in the catalogue")
    parts = []
    if "genre" in items.columns:
        parts.append(genre_flags(items).select(
            F.col("item_id").alias("id"), F.concat(F.lit("genre_"), F.col("name")).alias("dim"), F.lit(1.0).alias("w")
        ))
    if present:
        names = [f"{c}_normalized" for c in present]
        scaled = minmax_normalize(items, present).select(F.col("item_id").alias("id"), *names)
        parts.append(scaled.unpivot(["id"], names, "dim", "w").filter("w <> 0"))
    cells = parts[0]
    for more in parts[1:]:
        cells = cells.unionByName(more)
    return cells
