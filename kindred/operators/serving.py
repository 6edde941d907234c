"""Answers for a few targets from stored vectors; nothing is fitted, and no stored vector is shuffled.

``cells`` is (id, dim, w) in buckets of id (`sources.store`). The targets are a short list of ids from a request: their vectors
come from their own buckets and are broadcast, which is bounded by the list and the longest vector.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.ranking import OUTPUT_DIGITS, top_n
from kindred.operators import similarity as sim

MOST_TARGETS = 1000


def _few(targets: Sequence) -> list:
    ids = list(dict.fromkeys(targets))
    if len(ids) > MOST_TARGETS:
        raise ValueError(f"at most {MOST_TARGETS} targets at once; whole tables of targets go to the operators for tables")
    return ids


def stored_topn(
    asked: DataFrame, cells: DataFrame, n: int, floor: float | None = sim.ABOVE_ZERO, skip_self: bool = False, exclude: DataFrame | None = None,
    clip: tuple[float, float] | None = None,
) -> DataFrame:
    """(target_id, item_id, score, rank): the n best stored vectors for each asked one, by the sum of products.

    The sums need no exchange, as the vectors lie in buckets of their id; what then moves is n rows of a target and task.
    """
    left = asked.select(F.col("id").alias("target_id"), "dim", F.col("w").alias("_w"))
    met = cells.join(F.broadcast(left), "dim")
    if skip_self:
        met = met.filter("id <> target_id")
    score = F.sum(F.col("w") * F.col("_w"))
    if clip is not None:
        score = F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), score))
    found = met.groupBy("id", "target_id").agg(score.alias("score")).withColumnRenamed("id", "item_id")
    if floor is not None:
        found = found.filter(F.col("score") >= floor)
    if exclude is not None:
        found = found.join(F.broadcast(exclude), ["target_id", "item_id"], "left_anti")
    return top_n(found, n, ["target_id"], digits=OUTPUT_DIGITS)


def similar_content(weights: DataFrame, targets: Sequence, n: int = 10) -> DataFrame:
    """(item_id, neighbour_id, score, rank) of the asked items, from stored unit vectors (id, dim, w)."""
    asked = weights.filter(F.col("id").isin(_few(targets)))
    return stored_topn(asked, weights, n, skip_self=True).withColumnsRenamed({"item_id": "neighbour_id", "target_id": "item_id"})


def mf_recommend(users: DataFrame, items: DataFrame, ratings: DataFrame, targets: Sequence, n: int = 10, low: float = 0.0, high: float = 10.0) -> DataFrame:
    """(user_id, item_id, score, rank): the asked users' unrated items by stored factors, clipped to the scale of the ratings.

    ``users`` and ``items`` are factor cells (id, dim, w); ``ratings`` lies in buckets of user_id.
    """
    ids = _few(targets)
    rated = ratings.filter(F.col("user_id").isin(ids)).select(F.col("user_id").alias("target_id"), "item_id")
    found = stored_topn(users.filter(F.col("id").isin(ids)), items, n, floor=None, exclude=rated, clip=(low, high))
    return found.withColumnRenamed("target_id", "user_id")


def factor_cells(factors: DataFrame) -> DataFrame:
    """Factor arrays as cells (id, dim, w)."""
    return factors.select(F.col(factors.columns[0]).alias("id"), F.posexplode("factors").alias("dim", "w"))
