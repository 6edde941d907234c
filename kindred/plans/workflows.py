"""Multi-step plans over the operators."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.stats import stats_lookup
from kindred.operators import clean, collab, content, features, metrics
from kindred.operators.similarity import Extent


def with_text(items: DataFrame) -> DataFrame:
    return items.withColumn("combined_text", features.combined_text(items.columns))


def preprocess(
    items: DataFrame, order: str = "pos", max_features: int = 1000, store: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Clean, featurise and weigh a raw catalogue: (catalogue with normalised numbers, term weights).

    One set of column statistics serves filling and scaling. With ``store`` the tidy catalogue is written
    there first and both results read it, so the raw table is scanned once.
    """
    tidy = with_text(clean.tidy_catalogue(items, order))
    if store:
        tidy.write.mode("overwrite").parquet(store)
        tidy = items.sparkSession.read.parquet(store)
    numeric = [c for c in features.NUMERIC_FEATURES if c in tidy.columns]
    stats = stats_lookup(tidy, numeric)
    filled = clean.impute_median(tidy, stats=stats)
    return features.minmax_normalize(filled, numeric, stats), features.tfidf(tidy, max_features=max_features)


def content_model(items: DataFrame, max_features: int = 1000) -> tuple[DataFrame, Extent]:
    """Term weights of a cleaned catalogue and their size bound."""
    return features.tfidf(with_text(items), max_features=max_features), features.tfidf_extent(items, max_features)


def evaluate_user_based(ratings: DataFrame, n: int = 10, k_values: Sequence[int] = (5, 10), min_rating: float = 8.0,
                        bucket=None) -> DataFrame:
    """Fit on the train split, recommend, and score against the well rated held-out items of each user."""
    split = collab.train_test_split(ratings, bucket=bucket)
    train = split.filter("not is_test").drop("is_test")
    relevant = split.filter(F.col("is_test") & (F.col("rating") >= min_rating)).select("user_id", "item_id")
    recs = collab.recommend_user_based(train, n)
    return metrics.evaluate_recommendations(recs, relevant, k_values)


def coverage_of_similar(weights: DataFrame, size: Extent, items: DataFrame, n: int = 10, targets: DataFrame | None = None) -> DataFrame:
    """Share of the catalogue that shows up in the targets' lists of similar items."""
    listed = content.similar_content(weights, size, n, targets).select(F.col("neighbour_id").alias("item_id"))
    return metrics.catalog_coverage(listed, items)
