"""Times the headline queries over whole tables and prints one JSON line.

BENCH_SF_DIR names the folder of parquet tables, BENCH_CPUS the number of local cores.
"""

import json
import os
import re
import time

from kindred.operators import collab, content, factor, features, serving
from kindred.plans.catalog import QUERIES
from kindred.session import local_session, scratch_folder
from kindred.sources import warehouse
from kindred.sources.store import Store

HEADLINE = [
    "similar_content", "similar_items", "similar_users", "recommend_user_based", "recommend_item_based", "recommend_for_liked",
    "similar_genre", "same_director", "popular_that_year", "tfidf", "preprocess_catalogue", "predict_user_based", "user_features",
    "session_funnel", "trending_windowed", "evaluate_recommendations", "autocomplete", "mf_fit", "hybrid_weighted",
]


def one_target(spark, folder):
    """The same answers for a single user or item, which is what a request asks for; `stored` ones from saved state."""
    ratings = warehouse.ratings(spark, folder)
    user, item = ratings.select("user_id").limit(1), ratings.select("item_id").limit(1)
    docs = warehouse.text_catalogue(spark, folder)
    weights, size = features.tfidf(docs, "plot"), features.tfidf_extent(docs)
    store = Store(spark, scratch_folder(spark))
    users, items = factor.mf_fit(ratings)
    store.save({
        "weights": (features.tfidf_cells(weights), "id"), "users": (serving.factor_cells(users), "id"),
        "items": (serving.factor_cells(items), "id"), "ratings": (ratings, "user_id"),
    })
    state = store.load()
    one_user, one_item = user.first()[0], docs.select("item_id").first()[0]
    return {
        "one_similar_content_stored": lambda: serving.similar_content(state["weights"], [one_item]),
        "one_mf_recommend_stored": lambda: serving.mf_recommend(state["users"], state["items"], state["ratings"], [one_user]),
        "one_similar_content": lambda: content.similar_content(weights, size, targets=docs.select("item_id").limit(1)),
        "one_similar_items": lambda: collab.similar_items(ratings, targets=item),
        "one_recommend_user_based": lambda: collab.recommend_user_based(ratings, targets=user),
        "one_predict_user_based": lambda: collab.predict_user_based(ratings, user.join(item)),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    for name, query in one_target(spark, folder).items():
        start = time.time()
        query().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None,
        "similar_content_ms_per_item": round(1000 * seconds["similar_content"] / documents, 3),
    }))


if __name__ == "__main__":
    main()
