"""Similarities, neighbours and single-method recommendations."""

from pyspark.sql import functions as F

from kindred.operators import collab, content, factor, features
from kindred.operators import similarity as sim
from kindred.plans import workflows
from kindred.plans.catalog.registry import (
    CASTS, CATALOGUE, DOC_TEXT, GENRES, ITEM_SIMS, ITEM_TEXT, LIKED, ORACLES, RATINGS, TFIDF, USER_SIMS,
    best, for_liked, item_based, query, user_based, with_,
)
from kindred.session import scratch_folder
from kindred.sources import warehouse as wh
from kindred.sources.store import Store


def _rounded_pairs(pairs):
    return pairs.withColumn("sim", F.round("sim", 6))


@query("user_cosine", with_(RATINGS, USER_SIMS, "SELECT t AS a, s AS b, round(sim, 6) AS sim FROM sims WHERE t < s"))
def _(spark, folder):
    return _rounded_pairs(collab.user_cosine(wh.ratings(spark, folder)))


@query("item_cosine", with_(RATINGS, ITEM_SIMS, "SELECT t AS a, s AS b, round(sim, 6) AS sim FROM sims WHERE t < s"))
def _(spark, folder):
    return _rounded_pairs(collab.item_cosine(wh.ratings(spark, folder)))


@query("similar_users", with_(RATINGS, USER_SIMS, "found AS (SELECT t AS user_id, s AS neighbour_id, sim AS score FROM sims)",
                              best("found", 5, "user_id", "user_id, neighbour_id", "neighbour_id")))
def _(spark, folder):
    return collab.similar_users(wh.ratings(spark, folder))


@query("similar_items", with_(RATINGS, ITEM_SIMS, "found AS (SELECT t AS item_id, s AS neighbour_id, sim AS score FROM sims)",
                              best("found", 5, "item_id", "item_id, neighbour_id", "neighbour_id")))
def _(spark, folder):
    return collab.similar_items(wh.ratings(spark, folder))


DOC_SIMS = """doc_sims AS (SELECT a.item_id, b.item_id AS neighbour_id, sum(a.w * b.w) AS score
  FROM weights a JOIN weights b ON a.term = b.term AND a.item_id <> b.item_id GROUP BY 1, 2)"""


def doc_weights(spark, folder):
    docs = wh.text_catalogue(spark, folder)
    return features.tfidf(docs, "plot"), features.tfidf_extent(docs)


@query("content_cosine", with_(DOC_TEXT, TFIDF, DOC_SIMS, "SELECT item_id AS a, neighbour_id AS b, round(score, 6) AS sim FROM doc_sims WHERE item_id < neighbour_id"))
def _(spark, folder):
    return _rounded_pairs(content.content_cosine(*doc_weights(spark, folder)))


FEATURE_SIMS = """flags AS (SELECT item_id AS id, 'g' || name AS dim, 1.0::DOUBLE AS w FROM genres),
numbers AS (SELECT item_id AS id, 'rating' AS dim, (rating - (SELECT min(rating) FROM catalogue)) / (SELECT max(rating) - min(rating) FROM catalogue) AS w FROM catalogue
  UNION ALL SELECT item_id, 'year', (year - (SELECT min(year) FROM catalogue)) / (SELECT max(year) - min(year) FROM catalogue) FROM catalogue),
cells AS (SELECT * FROM flags UNION ALL SELECT * FROM numbers WHERE w <> 0),
lens AS (SELECT id, sqrt(sum(w * w)) AS n FROM cells GROUP BY 1),
feature_sims AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) / any_value(x.n * y.n) AS sim FROM cells a JOIN cells b ON a.dim = b.dim AND a.id < b.id
  JOIN lens x ON a.id = x.id JOIN lens y ON b.id = y.id GROUP BY 1, 2)"""


@query("feature_cosine", with_(CATALOGUE, GENRES, FEATURE_SIMS, "SELECT a, b, round(sim, 6) AS sim FROM feature_sims"))
def _(spark, folder):
    return _rounded_pairs(content.feature_cosine(wh.catalogue(spark, folder)))


@query("similar_embeddings", """WITH cells AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS w, generate_subscripts(embedding, 1) AS dim FROM embeddings),
lens AS (SELECT id, sqrt(sum(w * w)) AS n FROM cells GROUP BY 1),
found AS (SELECT a.id AS item_id, b.id AS neighbour_id, sum(a.w * b.w) / any_value(x.n * y.n) AS score FROM cells a JOIN cells b ON a.dim = b.dim AND a.id <> b.id
  JOIN lens x ON a.id = x.id JOIN lens y ON b.id = y.id GROUP BY 1, 2)
""" + best("found WHERE score > 0", 10, "item_id", "item_id, neighbour_id", "neighbour_id"))
def _(spark, folder):
    rows = wh.embedding_rows(spark, folder)
    found = sim.dense_topn(rows, rows, 10)
    return found.withColumnRenamed("item_id", "neighbour_id").withColumnRenamed("target_id", "item_id")


_EMBEDDED = """WITH cells AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS w, generate_subscripts(embedding, 1) AS dim FROM embeddings),
lens AS (SELECT id, sqrt(sum(w * w)) AS n FROM cells GROUP BY 1),
"""


@query("least_negative_embeddings", _EMBEDDED + """found AS (SELECT a.id AS item_id, b.id AS neighbour_id, -sum(a.w * b.w) / any_value(x.n * y.n) AS score
  FROM cells a JOIN cells b ON a.dim = b.dim AND a.id <> b.id JOIN lens x ON a.id = x.id JOIN lens y ON b.id = y.id WHERE a.id % 100 = 0 GROUP BY 1, 2)
""" + best("found", 10, "item_id", "item_id, neighbour_id", "neighbour_id"))
def _(spark, folder):
    """The vectors most opposed to every hundredth one: all similarities count, of either sign."""
    rows = wh.embedding_rows(spark, folder)
    asked = rows.filter("id % 100 = 0").withColumn("ws", F.transform("ws", lambda w: -w))
    found = sim.dense_topn(asked, rows, 10, floor=None)
    return found.withColumnRenamed("item_id", "neighbour_id").withColumnRenamed("target_id", "item_id")


@query("large_products", _EMBEDDED + """found AS (SELECT a.id AS item_id, b.id AS neighbour_id, sum(round(a.w * 1000) * round(b.w * 1000)) * 1e7 AS score
  FROM cells a JOIN cells b ON a.dim = b.dim AND a.id <> b.id WHERE a.id % 100 = 0 GROUP BY 1, 2)
""" + best("found", 10, "item_id", "item_id, neighbour_id", "neighbour_id"))
def _(spark, folder):
    """Inner products far above 10**10, and far below -10**4, rank like any others."""
    whole = wh.embedding_rows(spark, folder).withColumn("ws", F.transform("ws", lambda w: F.round(w * 1000)))
    asked = whole.filter("id % 100 = 0").withColumn("ws", F.transform("ws", lambda w: w * 1e7))
    found = sim.block_topn(asked, whole, 10, asked.count(), whole.count(), skip_self=True, floor=None)
    return found.withColumnRenamed("item_id", "neighbour_id").withColumnRenamed("target_id", "item_id")


@query("similar_content_threshold", with_(DOC_TEXT, TFIDF, DOC_SIMS, best("doc_sims WHERE score >= 0.3", 10, "item_id", "item_id, neighbour_id", "neighbour_id")))
def _(spark, folder):
    return content.similar_content(*doc_weights(spark, folder), min_similarity=0.3)


@query("similar_content", with_(DOC_TEXT, TFIDF, DOC_SIMS, best("doc_sims", 10, "item_id", "item_id, neighbour_id", "neighbour_id")))
def _(spark, folder):
    return content.similar_content(*doc_weights(spark, folder))


def _asked(key: str, other: str, skip: int) -> str:
    """Predictions of all rated pairs; the pair's own rating takes no part."""
    return f"""near AS (SELECT a.user_id, a.item_id, sim, r.rating, row_number() OVER (PARTITION BY a.user_id, a.item_id ORDER BY round(sim, 9) DESC, s) AS place
  FROM ratings a JOIN ratings r ON a.{other} = r.{other} JOIN sims ON t = a.{key} AND s = r.{key}),
scored AS (SELECT user_id, item_id, sum(sim * rating) / sum(sim) AS score FROM near WHERE place > {skip} AND place <= {10 + skip} GROUP BY 1, 2)
SELECT user_id, item_id, round(coalesce(score, 0), 6) AS score FROM ratings LEFT JOIN scored USING (user_id, item_id)"""


def _joined(sims: str, asked: str) -> str:
    return "WITH " + RATINGS + ",\n" + sims + ",\n" + asked


@query("predict_user_based", _joined(USER_SIMS, _asked("user_id", "item_id", 0)))
def _(spark, folder):
    r = wh.ratings(spark, folder)
    return collab.predict_user_based(r, r).withColumn("score", F.round("score", 6))


@query("predict_item_based", _joined(ITEM_SIMS, _asked("item_id", "user_id", 0)))
def _(spark, folder):
    r = wh.ratings(spark, folder)
    return collab.predict_item_based(r, r).withColumn("score", F.round("score", 6))


@query("predict_user_based_skip_top", _joined(USER_SIMS, _asked("user_id", "item_id", 1)))
def _(spark, folder):
    r = wh.ratings(spark, folder)
    return collab.predict_user_based(r, r, neighbours="skip_top").withColumn("score", F.round("score", 6))


@query("recommend_user_based", with_(RATINGS, user_based(10), "SELECT * FROM cf"))
def _(spark, folder):
    return collab.recommend_user_based(wh.ratings(spark, folder))


@query("recommend_item_based", with_(RATINGS, item_based(10), "SELECT * FROM cf"))
def _(spark, folder):
    return collab.recommend_item_based(wh.ratings(spark, folder))


def _signed(key: str, other: str, tail: str) -> str:
    """Predictions from ratings around zero. Rows similar by 0 add nothing, but rank before rows with a negative similarity."""
    return f"""WITH ratings AS (SELECT o_custkey AS user_id, l_partkey AS item_id, floor(avg(l_quantity)) - 25 AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING floor(avg(l_quantity)) <> 25),
norms AS (SELECT {key}, sqrt(sum(rating * rating)) AS n FROM ratings GROUP BY 1),
dots AS (SELECT a.{key} AS t, b.{key} AS s, sum(a.rating * b.rating) AS dot FROM ratings a JOIN ratings b ON a.{other} = b.{other} AND a.{key} <> b.{key} GROUP BY 1, 2),
sims AS (SELECT t, s, dot / (x.n * y.n) AS sim FROM dots JOIN norms x ON t = x.{key} JOIN norms y ON s = y.{key} WHERE dot <> 0),
filled AS (SELECT {other}, count(*) AS n FROM ratings GROUP BY 1),
met AS (SELECT t AS {key}, r.{other}, sim, r.rating, row_number() OVER (PARTITION BY t, r.{other} ORDER BY round(sim, 9) DESC, s) AS p,
  count(*) FILTER (sim > 0) OVER (PARTITION BY t, r.{other}) AS above, count(*) FILTER (sim < 0) OVER (PARTITION BY t, r.{other}) AS below
  FROM sims JOIN ratings r ON s = r.{key}),
near AS (SELECT met.*, CASE WHEN sim > 0 THEN p ELSE n - (own.rating IS NOT NULL)::INT - below + p - above END AS place
  FROM met JOIN filled USING ({other}) LEFT JOIN ratings own USING (user_id, item_id)),
scored AS (SELECT user_id, item_id, sum(sim * rating) / sum(abs(sim)) AS score FROM near WHERE place <= 10 GROUP BY 1, 2)
""" + tail


_ASKED = "SELECT user_id, item_id, round(coalesce(score, 0), 6) AS score FROM ratings LEFT JOIN scored USING (user_id, item_id)"
_LISTED = ", fresh AS (SELECT * FROM scored ANTI JOIN ratings USING (user_id, item_id) WHERE score > 0)\n" + best("fresh", 10, "user_id", "user_id, item_id")


def signed_ratings(spark, folder):
    """Ratings around zero, as mean-centring gives them, in whole numbers that every engine adds alike."""
    return wh.ratings(spark, folder).select("user_id", "item_id", (F.floor(F.col("rating") * 5 + 1e-6) - 25).cast("double").alias("rating")).filter("rating <> 0")


@query("predict_user_based_signed", _signed("user_id", "item_id", _ASKED))
def _(spark, folder):
    r = signed_ratings(spark, folder)
    return collab.predict_user_based(r, r).withColumn("score", F.round("score", 6))


@query("predict_item_based_signed", _signed("item_id", "user_id", _ASKED))
def _(spark, folder):
    r = signed_ratings(spark, folder)
    return collab.predict_item_based(r, r).withColumn("score", F.round("score", 6))


@query("recommend_user_based_signed", _signed("user_id", "item_id", _LISTED))
def _(spark, folder):
    return collab.recommend_user_based(signed_ratings(spark, folder))


@query("recommend_item_based_signed", _signed("item_id", "user_id", _LISTED))
def _(spark, folder):
    return collab.recommend_item_based(signed_ratings(spark, folder))


_SIGNED_SIMS = _signed("user_id", "item_id", "").split("filled AS")[0].rstrip().rstrip(",")
_SIGNED_ITEM_SIMS = _signed("item_id", "user_id", "").split("filled AS")[0].rstrip().rstrip(",")


@query("user_cosine_signed", _SIGNED_SIMS + " SELECT t AS a, s AS b, round(sim, 6) AS sim FROM sims WHERE t < s")
def _(spark, folder):
    return _rounded_pairs(collab.user_cosine(signed_ratings(spark, folder)))


@query("similar_users_signed", _SIGNED_SIMS + ", found AS (SELECT t AS user_id, s AS neighbour_id, sim AS score FROM sims WHERE sim > 0) "
       + best("found", 5, "user_id", "user_id, neighbour_id", "neighbour_id"))
def _(spark, folder):
    return collab.similar_users(signed_ratings(spark, folder))


@query("similar_items_signed", _SIGNED_ITEM_SIMS + ", found AS (SELECT t AS item_id, s AS neighbour_id, sim AS score FROM sims WHERE sim > 0) "
       + best("found", 5, "item_id", "item_id, neighbour_id", "neighbour_id"))
def _(spark, folder):
    return collab.similar_items(signed_ratings(spark, folder))


@query("user_liked", with_(RATINGS, LIKED, "SELECT user_id, item_id FROM liked"))
def _(spark, folder):
    return collab.user_liked(wh.ratings(spark, folder)).select("user_id", "item_id")


def item_model(spark, folder):
    items = wh.catalogue(spark, folder, with_cast=True).withColumnRenamed("cast", "actors")
    return (items, *workflows.content_model(items))


def liked_list(spark, folder, n, digits=6, users=None):
    """Content recommendations of all users, or of those given."""
    items, weights, size = item_model(spark, folder)
    liked = collab.user_liked(wh.ratings(spark, folder))
    liked = liked if users is None else liked.join(users, "user_id", "left_semi")
    return content.recommend_for_liked(liked, weights, items, size, n, digits=digits)


@query("recommend_for_liked", with_(RATINGS, CATALOGUE, CASTS, ITEM_TEXT, TFIDF, for_liked(10), "SELECT * FROM cb"))
def _(spark, folder):
    return liked_list(spark, folder, 10)


@query("mf_fit")
def _(spark, folder):
    users, items = factor.mf_fit(wh.ratings(spark, folder))
    name = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).alias("id"), F.posexplode("factors").alias("factor", "value"))
    return name(users, "user").unionByName(name(items, "item"))


@query("mf_fit_krylov")
def _(spark, folder):
    """The factors to a residual of a thousandth, with the rounds that took."""
    found = factor.mf_fit_krylov(wh.ratings(spark, folder), tolerance=1e-3)
    told = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).alias("id"), F.posexplode("factors").alias("factor", "value"))
    return told(found.users, "user").unionByName(told(found.items, "item")).withColumn("rounds", F.lit(found.rounds))


@query("mf_fit_als")
def _(spark, folder):
    users, items = factor.mf_fit_als(wh.ratings(spark, folder))
    return users.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), "factors").unionByName(
        items.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "factors")
    )


@query("mf_predict")
def _(spark, folder):
    r = wh.ratings(spark, folder)
    return factor.mf_predict(r, *factor.mf_fit(r))


# Given factors: the vectors of even ids are users, those of odd ids items; the scale makes some products pass both limits.
FACTORS = """cells AS (SELECT vec_id, unnest(embedding)::DOUBLE * 5 AS w, generate_subscripts(embedding, 1) AS dim FROM embeddings),
u AS (SELECT vec_id // 2 AS user_id, dim, w FROM cells WHERE vec_id % 2 = 0),
v AS (SELECT vec_id // 2 AS item_id, dim, w FROM cells WHERE vec_id % 2 = 1),
products AS (SELECT user_id, item_id, greatest(0, least(10, sum(u.w * v.w))) AS score FROM u JOIN v USING (dim) GROUP BY 1, 2),
unrated AS (SELECT * FROM products ANTI JOIN ratings USING (user_id, item_id)),
"""


def given_factors(spark, folder):
    rows = wh.embedding_rows(spark, folder)
    return tuple(
        rows.filter(f"id % 2 = {rest}").select(F.floor(F.col("id") / 2).alias(name), F.transform("ws", lambda w: w * 5).alias("factors"))
        for rest, name in ((0, "user_id"), (1, "item_id"))
    )


@query("mf_predict_given", "WITH " + RATINGS + ", " + FACTORS + """last AS (SELECT 1)
SELECT user_id, item_id, round(coalesce(score, 0), 6) AS score FROM ratings LEFT JOIN products USING (user_id, item_id)""")
def _(spark, folder):
    return factor.mf_predict(wh.ratings(spark, folder), *given_factors(spark, folder)).withColumn("score", F.round("score", 6))


@query("mf_recommend_given", "WITH " + RATINGS + ", " + FACTORS + f"mf AS ({best('unrated', 10, 'user_id', 'user_id, item_id')}) SELECT * FROM mf")
def _(spark, folder):
    return factor.mf_recommend(wh.ratings(spark, folder), *given_factors(spark, folder))


@query("similar_content_stored", ORACLES["similar_content"])
def _(spark, folder):
    """The nearest texts of all items from reloaded term weights."""
    weights, size = doc_weights(spark, folder)
    state = Store(spark, scratch_folder(spark))
    state.save({"weights": (weights, "item_id")})
    return content.similar_content(state.load()["weights"], size)


@query("mf_recommend_stored", ORACLES["mf_recommend_given"])
def _(spark, folder):
    """The lists of all users from reloaded factors and ratings."""
    users, items = given_factors(spark, folder)
    state = Store(spark, scratch_folder(spark))
    state.save({"users": (users, "user_id"), "items": (items, "item_id"), "ratings": (wh.ratings(spark, folder), "user_id")})
    tables = state.load()
    return factor.mf_recommend(tables["ratings"], tables["users"], tables["items"])


@query("mf_recommend")
def _(spark, folder):
    r = wh.ratings(spark, folder)
    return factor.mf_recommend(r, *factor.mf_fit(r))
