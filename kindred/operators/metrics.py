"""Prediction errors and ranking metrics, for all users of a table at once.

Recommendations are (user_id, item_id, rank) with ranks 1..n; relevant items are (user_id, item_id).
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.collab import hash_bucket
from kindred.session import materialize


def rmse_of(truth: str = "rating", predicted: str = "score") -> Column:
    error = F.col(truth) - F.col(predicted)
    return F.sqrt(F.avg(error * error))


def mae_of(truth: str = "rating", predicted: str = "score") -> Column:
    return F.avg(F.abs(F.col(truth) - F.col(predicted)))


ERRORS: dict[str, Callable[[str, str], Column]] = {"rmse": rmse_of, "mae": mae_of}


def evaluate_predictions(pairs: DataFrame, metrics: Sequence[str] = ("rmse", "mae"), truth: str = "rating", predicted: str = "score") -> DataFrame:
    return pairs.agg(*[ERRORS[m](truth, predicted).alias(m) for m in metrics])


def _marked(recs: DataFrame, relevant: DataFrame) -> DataFrame:
    known = relevant.select("user_id", "item_id").distinct().withColumn("hit", F.lit(1))
    return recs.select("user_id", "item_id", "rank").join(known, ["user_id", "item_id"], "left").na.fill(0, ["hit"])


def _users(recs: DataFrame, relevant: DataFrame) -> DataFrame:
    sizes = relevant.select("user_id", "item_id").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    return recs.select("user_id").distinct().join(sizes, "user_id", "full_outer").na.fill(0, ["n_relevant"])


def ranking_metrics(recs: DataFrame, relevant: DataFrame, k_values: Sequence[int] = (5, 10)) -> DataFrame:
    """(user_id, k, precision, recall, f1). Precision divides by the recommendations kept, not by k."""
    cuts = F.explode(F.array(*[F.lit(k) for k in k_values])).alias("k")
    kept = _marked(recs, relevant).select("*", cuts).filter("rank <= k")
    counts = kept.groupBy("user_id", "k").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("hit").alias("hits")
    )
    base = _users(recs, relevant).select("user_id", "n_relevant", cuts)
    joined = base.join(counts, ["user_id", "k"], "left").na.fill(0, ["kept", "hits"])
    scored = joined.select(
        "user_id", "k",
        F.coalesce(F.try_divide("hits", "kept"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("hits", "n_relevant"), F.lit(0.0)).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def hit_rate(recs: DataFrame, relevant: DataFrame) -> DataFrame:
    """(user_id, hit_rate): 1.0 if anything recommended is relevant."""
    hits = _marked(recs, relevant).groupBy("user_id").agg(F.max("hit").cast("double").alias("hit_rate"))
    return _users(recs, relevant).select("user_id").join(hits, "user_id", "left").na.fill(0.0, ["hit_rate"])


def _running_hits(recs: DataFrame, relevant: DataFrame) -> DataFrame:
    """Hits up to each rank. A user's list is a top-n, so the window holds n rows."""
    so_far = Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return _marked(recs, relevant).withColumn("hits", F.sum("hit").over(so_far))


def average_precision(recs: DataFrame, relevant: DataFrame) -> DataFrame:
    """(user_id, average_precision): precision at each hit, summed, over the number of relevant items."""
    gained = _running_hits(recs, relevant).filter("hit = 1").groupBy("user_id").agg(
        F.sum(F.col("hits") / F.col("rank")).alias("gained")
    )
    return _users(recs, relevant).join(gained, "user_id", "left").select(
        "user_id", F.coalesce(F.try_divide(F.coalesce("gained", F.lit(0.0)), "n_relevant"), F.lit(0.0)).alias("average_precision")
    )


def ndcg_at_k(recs: DataFrame, gains: DataFrame, k: int = 10) -> DataFrame:
    """(user_id, ndcg) with linear gain; ``gains`` is (user_id, item_id, gain)."""
    def discounted(place: str) -> Column:
        return F.sum(F.col("gain") / F.log2(F.col(place) + 1))

    got = recs.filter(F.col("rank") <= k).select("user_id", "item_id", "rank").join(
        gains.select("user_id", "item_id", "gain"), ["user_id", "item_id"]
    ).groupBy("user_id").agg(discounted("rank").alias("dcg"))
    best = Window.partitionBy("user_id").orderBy(F.col("gain").desc(), F.col("item_id"))
    ideal = gains.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).groupBy("user_id").agg(
        discounted("place").alias("ideal")
    )
    users = recs.select("user_id").unionByName(gains.select("user_id")).distinct()
    return users.join(got, "user_id", "left").join(ideal, "user_id", "left").select(
        "user_id", F.coalesce(F.try_divide(F.coalesce("dcg", F.lit(0.0)), "ideal"), F.lit(0.0)).alias("ndcg")
    )


def catalog_coverage(recs: DataFrame, items: DataFrame, approximate: bool = False) -> DataFrame:
    """One row (recommended, catalogue, coverage); NULL coverage for an empty catalogue."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    size = items.agg(count("item_id").alias("n")).scalar()
    return recs.agg(count("item_id").alias("recommended")).withColumn("catalogue", size).withColumn(
        "coverage", F.try_divide("recommended", "catalogue")
    )


def evaluate_recommendations(recs: DataFrame, relevant: DataFrame, k_values: Sequence[int] = (5, 10)) -> DataFrame:
    """Per user and k: precision, recall, f1, and the user's hit rate and average precision."""
    return (
        ranking_metrics(recs, relevant, k_values)
        .join(hit_rate(recs, relevant), "user_id").join(average_precision(recs, relevant), "user_id")
    )


def precision_recall_points(recs: DataFrame, relevant: DataFrame, max_k: int = 20) -> DataFrame:
    """(user_id, k, precision, recall) for every k up to the list's length."""
    running = _running_hits(recs.filter(F.col("rank") <= max_k), relevant)
    return running.join(_users(recs, relevant), "user_id").select(
        "user_id", F.col("rank").alias("k"), (F.col("hits") / F.col("rank")).alias("precision"),
        F.coalesce(F.try_divide("hits", "n_relevant"), F.lit(0.0)).alias("recall"),
    )


def cross_validate(ratings: DataFrame, predict: Callable[[DataFrame, DataFrame], DataFrame], n_folds: int = 5, seed: int = 42,
                   bucket: Column | None = None) -> DataFrame:
    """(fold, n, rmse, mae): fit on the other folds, predict this one. ``predict(train, pairs)`` gives score per pair.

    ``bucket`` is a column 0..n_folds-1, by default a hash of the pair. The ratings are computed once for all folds.
    """
    fold_of = hash_bucket(["user_id", "item_id"], n_folds, seed) if bucket is None else bucket
    folded = materialize(ratings.withColumn("fold", fold_of))
    report = None
    for fold in range(n_folds):
        train, held = folded.filter(F.col("fold") != fold).drop("fold"), folded.filter(F.col("fold") == fold).drop("fold")
        scored = held.join(predict(train, held.select("user_id", "item_id")), ["user_id", "item_id"])
        row = scored.agg(F.count(F.lit(1)).alias("n"), rmse_of().alias("rmse"), mae_of().alias("mae"))
        row = row.select(F.lit(fold).alias("fold"), "n", "rmse", "mae")
        report = row if report is None else report.unionByName(row)
    return report
