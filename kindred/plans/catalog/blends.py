"""Blends, presentation and explanations."""

from pyspark.sql import functions as F

from kindred.functions.ranking import rank_by
from kindred.operators import blend, collab, content, explain, factor
from kindred.plans.catalog.lookups import ALL_LISTS, ITEM_LIST, category_lists
from kindred.plans.catalog.neighbours import FACTORS, given_factors, item_model, liked_list
from kindred.plans.catalog.registry import (
    CASTS, CATALOGUE, ITEM_SIMS, ITEM_TEXT, LIKED, ORACLES, RATINGS, TFIDF, USER_SIMS, best, for_liked, item_based, query, user_based, with_,
)
from kindred.sources import warehouse as wh

BOTH = (RATINGS, CATALOGUE, CASTS, ITEM_TEXT, TFIDF, user_based(20, False), for_liked(20, False))


def both_lists(spark, folder):
    return collab.recommend_user_based(wh.ratings(spark, folder), 20, digits=None), liked_list(spark, folder, 20, None)


WEIGHTED = """mixed AS (SELECT user_id, item_id, sum(score) AS score FROM (SELECT user_id, item_id, score * 0.6 AS score FROM cf
  UNION ALL SELECT user_id, item_id, score * 0.4 FROM cb) GROUP BY 1, 2)"""


@query("hybrid_weighted", with_(*BOTH, WEIGHTED, best("mixed", 10, "user_id", "user_id, item_id")))
def _(spark, folder):
    return blend.hybrid_weighted(*both_lists(spark, folder), cf_weight=0.6, cb_weight=0.4)


@query("hybrid_switching", with_(*BOTH, """enough AS (SELECT user_id FROM ratings WHERE rating > 0 GROUP BY 1 HAVING count(*) >= 40),
chosen AS (SELECT user_id, item_id, score FROM cf SEMI JOIN enough USING (user_id) UNION ALL
  SELECT user_id, item_id, score FROM cb ANTI JOIN enough USING (user_id))""", best("chosen", 10, "user_id", "user_id, item_id")))
def _(spark, folder):
    ratings = wh.ratings(spark, folder)
    enough = blend.enough_ratings(ratings, 40)
    cf = collab.recommend_user_based(ratings, 20, digits=None, targets=enough)
    others = ratings.select("user_id").distinct().join(enough, "user_id", "left_anti")
    return blend.hybrid_switching(ratings, cf, liked_list(spark, folder, 20, None, others), min_user_ratings=40)


@query("hybrid_cascade", with_(*BOTH, """sure AS (SELECT user_id, item_id, score, 1 AS stage FROM cf WHERE score >= 8),
staged AS (FROM sure UNION ALL SELECT user_id, item_id, score, 2 FROM cb ANTI JOIN sure USING (user_id, item_id))""",
                               best("staged", 10, "user_id", "user_id, item_id, stage", first="stage, ")))
def _(spark, folder):
    return blend.hybrid_cascade(*both_lists(spark, folder), cf_threshold=8.0)


COMBINED = """pairs AS (SELECT user_id, item_id, coalesce(cf.score, 0) AS cf_score, coalesce(cb.score, 0) AS cb_score
  FROM cf FULL JOIN cb USING (user_id, item_id)),
combined AS (SELECT *, cf_score > 0 AND cb_score > 0 AS in_both, (cf_score + cb_score) / 2 * CASE WHEN cf_score > 0 AND cb_score > 0 THEN 1.2 ELSE 1 END AS score FROM pairs),
feature_list AS (""" + best("combined", 10, "user_id", "user_id, item_id, cf_score, cb_score, in_both") + ")"


@query("hybrid_feature_combo", with_(*BOTH, COMBINED, "SELECT * REPLACE (round(cf_score, 6) AS cf_score, round(cb_score, 6) AS cb_score) FROM feature_list"))
def _(spark, folder):
    found = blend.feature_combination(*both_lists(spark, folder))
    return found.withColumns({c: F.round(c, 6) for c in ("cf_score", "cb_score")})


@query("hybrid_mf_given", with_(RATINGS, CATALOGUE, CASTS, ITEM_TEXT, TFIDF, for_liked(20, False), FACTORS + f"""mf AS ({best('unrated', 20, 'user_id', 'user_id, item_id', digits=False)}),
mixed AS (SELECT user_id, item_id, sum(score) AS score FROM (SELECT user_id, item_id, score / 10 * 0.6 AS score FROM mf
  UNION ALL SELECT user_id, item_id, score * 0.4 FROM cb) GROUP BY 1, 2)""", best("mixed", 10, "user_id", "user_id, item_id")))
def _(spark, folder):
    mf = factor.mf_recommend(wh.ratings(spark, folder), *given_factors(spark, folder), n=20, digits=None)
    return blend.hybrid_mf(mf, liked_list(spark, folder, 20, None))


@query("hybrid_mf")
def _(spark, folder):
    r = wh.ratings(spark, folder)
    return blend.hybrid_mf(factor.mf_recommend(r, *factor.mf_fit(r), n=20, digits=None), liked_list(spark, folder, 20, None))


@query("recommend_dispatch", with_(*BOTH, WEIGHTED, f"""hybrid AS ({best('mixed', 20, 'user_id', 'user_id, item_id')}),
methods AS (SELECT 'cf' AS method, * FROM cf UNION ALL SELECT 'cb', * FROM cb UNION ALL SELECT 'hybrid', * FROM hybrid),
requests AS (SELECT c_custkey AS user_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'cf' WHEN 'MACHINERY' THEN 'content' WHEN 'HOUSEHOLD' THEN 'hybrid' ELSE 'cb' END AS method,
  c_nationkey % 5 + 3 AS n FROM customer)""", "SELECT user_id, method, item_id, round(score, 6) AS score, rank FROM requests JOIN methods USING (user_id, method) WHERE rank <= n"))
def _(spark, folder):
    method = F.when(F.col("c_mktsegment") == "BUILDING", "cf").when(F.col("c_mktsegment") == "MACHINERY", "content").when(
        F.col("c_mktsegment") == "HOUSEHOLD", "hybrid").otherwise("cb")
    asked = wh.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), method.alias("method"), (F.col("c_nationkey") % 5 + 3).alias("n")
    )
    wants = lambda *names: asked.filter(F.col("method").isin(*names)).select("user_id").distinct()
    cf = collab.recommend_user_based(wh.ratings(spark, folder), 20, digits=None, targets=wants("cf", "hybrid"))
    cb = liked_list(spark, folder, 20, None, wants("cb", "content", "hybrid"))
    both = [part.join(wants("hybrid"), "user_id", "left_semi") for part in (cf, cb)]
    return blend.dispatch(asked, {"cf": cf, "cb": cb, "hybrid": blend.hybrid_weighted(*both, 20, 0.6, 0.4)}).withColumn("score", F.round("score", 6))


@query("recommend_requests", with_(*BOTH, WEIGHTED, f"hybrid AS ({best('mixed', 20, 'user_id', 'user_id, item_id')})", FACTORS + f"""mf AS ({best('unrated', 20, 'user_id', 'user_id, item_id', digits=False)})""",
ITEM_LIST, """lists AS (SELECT 'cf' AS method, * FROM cf UNION ALL SELECT 'cb', * FROM cb UNION ALL SELECT 'mf', * FROM mf UNION ALL SELECT 'hybrid', * FROM hybrid),
requests AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 11 > 0 THEN c_custkey END AS user_id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 7 END AS asked,
  ['cf', 'cb', 'mf', 'hybrid', 'other'][c_custkey % 5 + 1] AS method, c_nationkey % 5 + 3 AS n FROM customer)""", """
SELECT request_id, method AS answered_by, item_id, round(score, 6) AS score, rank FROM requests JOIN lists USING (user_id, method) WHERE asked IS NULL AND rank <= n
UNION ALL SELECT request_id, 'item', neighbour_id, score, rank FROM requests JOIN content_list ON asked = item_id WHERE rank <= n"""))
def _(spark, folder):
    """Each method works for the users that ask for it, and similar items are looked up for the items that are named."""
    key = F.col("c_custkey")
    asked = wh.table(spark, folder, "customer").select(
        key.alias("request_id"), F.when(key % 11 > 0, key).alias("user_id"), F.when(key % 4 == 0, key + 7).alias("item_id"),
        F.get(F.array(*[F.lit(m) for m in ("cf", "cb", "mf", "hybrid", "other")]), (key % 5).cast("int")).alias("method"), (F.col("c_nationkey") % 5 + 3).alias("n"),
    )
    of_users = asked.filter("item_id is null and user_id is not null")
    wants = lambda *names: of_users.filter(F.col("method").isin(*names)).select("user_id").distinct()
    ratings = wh.ratings(spark, folder)
    cf = collab.recommend_user_based(ratings, 20, digits=None, targets=wants("cf", "hybrid"))
    cb = liked_list(spark, folder, 20, None, wants("cb", "hybrid"))
    mf = factor.mf_recommend(ratings, *given_factors(spark, folder), n=20, targets=wants("mf"), digits=None)
    both = [part.join(wants("hybrid"), "user_id", "left_semi") for part in (cf, cb)]
    items, weights, size = item_model(spark, folder)
    named = asked.filter("item_id is not null").select("item_id").distinct().join(items.select("item_id"), "item_id", "left_semi")
    similar = content.similar_content(weights, size, 10, named)
    lists = {"cf": cf, "cb": cb, "mf": mf, "hybrid": blend.hybrid_weighted(*both, 20, 0.6, 0.4)}
    return blend.answer(asked, lists, similar).withColumn("score", F.round("score", 6))


@query("recs_denormalize", with_(*ALL_LISTS, """SELECT l.item_id, category, neighbour_id, score, rank, title, CAST(year AS VARCHAR) AS year,
  round(rating, 6) AS rating, genre, director, substring(plot, 1, 200) AS overview FROM lists l JOIN catalogue c ON neighbour_id = c.item_id"""))
def _(spark, folder):
    items, lists = category_lists(spark, folder)
    return blend.denormalize(lists, items).withColumn("rating", F.round("rating", 6))


@query("recs_summary_lines", with_(*ALL_LISTS, """counts AS (SELECT item_id, count(*) FILTER (WHERE category = 'similar_content') AS content,
  count(*) FILTER (WHERE category = 'same_director') AS director FROM lists GROUP BY 1)""", """
SELECT item_id, 0 AS line_no, 'Recommendations based on ''' || item_id || '''' AS line FROM counts
UNION ALL SELECT item_id, 1, 'Found ' || content || ' content matches' FROM counts
UNION ALL SELECT item_id, 2, 'Found ' || director || ' director matches' FROM counts"""))
def _(spark, folder):
    return blend.summary_lines(category_lists(spark, folder)[1])


# Explanations are asked for what each user rated best, so that every user and whole tables take part.
TOP_RATED = """recs AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(rating, 9) DESC, item_id) AS place
  FROM ratings) WHERE place <= 10)"""


def top_rated(ratings, n=10):
    return rank_by(ratings, n, ["user_id"], [F.round("rating", 9).desc(), F.col("item_id")]).select("user_id", "item_id")


@query("explain_user_cf", with_(RATINGS, USER_SIMS, TOP_RATED, "found AS (SELECT t AS user_id, s AS neighbour_id, sim AS score FROM sims)",
    f"near AS ({best('found', 5, 'user_id', 'user_id, neighbour_id', 'neighbour_id')})",
    "told AS (SELECT r.user_id, r.item_id, count(x.rating) AS n, avg(x.rating) AS mean FROM recs r LEFT JOIN near USING (user_id) LEFT JOIN ratings x ON x.user_id = neighbour_id AND x.item_id = r.item_id GROUP BY 1, 2)", """
SELECT user_id, item_id, n AS n_users, round(coalesce(mean, 0), 6) AS average_rating, CASE WHEN n > 0 THEN 'This movie is recommended because ' || n ||
  ' users similar to you rated it highly (average rating: ' || printf('%.1f', mean) || '/10). These users have similar taste to yours based on their past ratings.'
  ELSE 'This movie is recommended based on collaborative filtering.' END AS text FROM told"""))
def _(spark, folder):
    r = wh.ratings(spark, folder)
    told = explain.explain_user_cf(top_rated(r), collab.similar_users(r), r)
    return told.select("user_id", "item_id", "n_users", F.round("average_rating", 6).alias("average_rating"), "text")


@query("explain_item_cf", with_(RATINGS, CATALOGUE, ITEM_SIMS, TOP_RATED, "found AS (SELECT t AS item_id, s AS neighbour_id, sim AS score FROM sims)",
    f"near AS ({best('found', 5, 'item_id', 'item_id, neighbour_id', 'neighbour_id')})",
    """seen AS (SELECT r.user_id, r.item_id, title, row_number() OVER (PARTITION BY r.user_id, r.item_id ORDER BY rank) AS place, rank FROM recs r JOIN near USING (item_id)
  JOIN ratings x ON x.user_id = r.user_id AND x.item_id = neighbour_id JOIN catalogue c ON c.item_id = neighbour_id),
told AS (SELECT user_id, item_id, count(*) AS n, string_agg(title, ', ' ORDER BY place) FILTER (WHERE place <= 3) AS names FROM seen GROUP BY 1, 2)""", """
SELECT user_id, item_id, coalesce(n, 0) AS n_items, CASE WHEN n > 0 THEN 'This movie is recommended because it''s similar to movies you liked, such as: ' || names || '.'
  ELSE 'This movie is recommended based on similar movies.' END AS text FROM recs LEFT JOIN told USING (user_id, item_id)"""))
def _(spark, folder):
    r = wh.ratings(spark, folder)
    told = explain.explain_item_cf(top_rated(r), collab.similar_items(r), r, wh.catalogue(spark, folder))
    return told.select("user_id", "item_id", "n_items", "text")


PEOPLE = """people AS (SELECT DISTINCT l_partkey AS item_id, s_name AS actor FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
genre_rows AS (SELECT DISTINCT item_id, unnest(string_split(genre, ', ')) AS name FROM catalogue)"""
SEEN = """seen AS (SELECT r.user_id, r.item_id, f.item_id AS liked_id FROM recs r JOIN first_liked f USING (user_id))"""


@query("explain_content", with_(RATINGS, CATALOGUE, TOP_RATED, LIKED, PEOPLE,
    "first_liked AS (SELECT * FROM liked QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY item_id) <= 5)", SEEN,
    """g AS (SELECT user_id, s.item_id, list_sort(list(DISTINCT a.name)) AS names FROM seen s JOIN genre_rows a ON a.item_id = s.item_id
  JOIN genre_rows b ON b.item_id = liked_id AND a.name = b.name GROUP BY 1, 2),
d AS (SELECT user_id, s.item_id, max(a.director) AS director FROM seen s JOIN catalogue a ON a.item_id = s.item_id
  JOIN catalogue b ON b.item_id = liked_id AND a.director = b.director GROUP BY 1, 2),
p AS (SELECT user_id, s.item_id, list_sort(list(DISTINCT a.actor)) AS names FROM seen s JOIN people a ON a.item_id = s.item_id
  JOIN people b ON b.item_id = liked_id AND a.actor = b.actor GROUP BY 1, 2),
told AS (SELECT r.user_id, r.item_id, coalesce(array_to_string(g.names, '|'), '') AS genres, director, coalesce(array_to_string(p.names[1:3], '|'), '') AS actors,
  concat_ws(' and ', 'shares genres (' || array_to_string(g.names[1:2], ', ') || ')', 'same director (' || director || ')',
  'common actors (' || array_to_string(p.names[1:2], ', ') || ')') AS why
  FROM recs r LEFT JOIN g USING (user_id, item_id) LEFT JOIN d USING (user_id, item_id) LEFT JOIN p USING (user_id, item_id))""", """
SELECT user_id, item_id, genres, director, actors, CASE WHEN why <> '' THEN 'This movie is recommended because it ' || why || ' with movies you enjoyed.'
  ELSE 'This movie has similar content to movies you liked.' END AS text FROM told"""))
def _(spark, folder):
    r = wh.ratings(spark, folder)
    items = wh.catalogue(spark, folder, with_cast=True).withColumnRenamed("cast", "actors")
    told = explain.explain_content(top_rated(r), collab.user_liked(r), items)
    return told.select("user_id", "item_id", F.array_join("genres", "|").alias("genres"), "director", F.array_join("actors", "|").alias("actors"), "text")


@query("explain_hybrid", with_(*BOTH, COMBINED, """SELECT user_id, item_id, CASE WHEN cf_score > cb_score THEN 'collaborative_filtering' ELSE 'content_based' END AS primary_reason,
  CASE WHEN in_both THEN 'This movie is recommended for multiple reasons: ' || CASE WHEN cf_score > cb_score THEN 'similar users also enjoyed it' ELSE 'it matches your content preferences' END
  || '. Additionally, it scores well on both user similarity (' || printf('%.2f', cf_score) || ') and content similarity (' || printf('%.2f', cb_score) || ').'
  ELSE 'This movie is recommended because ' || CASE WHEN cf_score > cb_score THEN 'similar users also enjoyed it' ELSE 'it matches your content preferences' END || '.' END AS text
  FROM feature_list"""))
def _(spark, folder):
    told = explain.explain_hybrid(blend.feature_combination(*both_lists(spark, folder)))
    return told.select("user_id", "item_id", "primary_reason", "text")


@query("feature_importance", with_(RATINGS, CATALOGUE, TOP_RATED, LIKED, PEOPLE, "first_liked AS (SELECT * FROM liked)", SEEN,
    """total AS (SELECT user_id, count(*) AS n FROM liked GROUP BY 1),
g AS (SELECT DISTINCT user_id, s.item_id, liked_id FROM seen s JOIN genre_rows a ON a.item_id = s.item_id JOIN genre_rows b ON b.item_id = liked_id AND a.name = b.name),
p AS (SELECT DISTINCT user_id, s.item_id, liked_id FROM seen s JOIN people a ON a.item_id = s.item_id JOIN people b ON b.item_id = liked_id AND a.actor = b.actor),
marks AS (SELECT s.user_id, s.item_id, (g.liked_id IS NOT NULL)::INT AS genre, (a.director = b.director)::INT AS director, (p.liked_id IS NOT NULL)::INT AS actors,
  (abs(a.year - b.year) <= 5)::INT AS year FROM seen s JOIN catalogue a ON a.item_id = s.item_id JOIN catalogue b ON b.item_id = liked_id
  LEFT JOIN g ON g.user_id = s.user_id AND g.item_id = s.item_id AND g.liked_id = s.liked_id
  LEFT JOIN p ON p.user_id = s.user_id AND p.item_id = s.item_id AND p.liked_id = s.liked_id)""", """
SELECT user_id, item_id, round(sum(genre) / any_value(n), 6) AS genre, round(sum(director) / any_value(n), 6) AS director,
  round(sum(actors) / any_value(n), 6) AS actors, round(sum(year) / any_value(n), 6) AS year, 0.0::DOUBLE AS rating FROM marks JOIN total USING (user_id) GROUP BY 1, 2"""))
def _(spark, folder):
    r = wh.ratings(spark, folder)
    items = wh.catalogue(spark, folder, with_cast=True).withColumnRenamed("cast", "actors")
    found = explain.feature_importance(top_rated(r), collab.user_liked(r), items)
    return found.select("user_id", "item_id", *[F.round(c, 6).alias(c) for c in ("genre", "director", "actors", "year", "rating")])


# The same explanations of the lists that the recommenders really give: the parts after the asked pairs stay as they are.
def _why(key: str, *lists: str) -> str:
    asked, rest = ORACLES[key].split(TOP_RATED + ",\n")
    return "WITH " + ",\n".join(lists) + ",\n" + rest.replace("near", "five")


@query("explain_user_cf_recommended", _why("explain_user_cf", RATINGS, user_based(10), "recs AS (SELECT user_id, item_id FROM cf)"))
def _(spark, folder):
    r = wh.ratings(spark, folder)
    told = explain.explain_user_cf(collab.recommend_user_based(r), collab.similar_users(r), r)
    return told.select("user_id", "item_id", "n_users", F.round("average_rating", 6).alias("average_rating"), "text")


@query("explain_item_cf_recommended", _why("explain_item_cf", RATINGS, CATALOGUE, item_based(10), "recs AS (SELECT user_id, item_id FROM cf)"))
def _(spark, folder):
    r = wh.ratings(spark, folder)
    told = explain.explain_item_cf(collab.recommend_item_based(r), collab.similar_items(r), r, wh.catalogue(spark, folder))
    return told.select("user_id", "item_id", "n_items", "text")


@query("explain_content_recommended", _why("explain_content", RATINGS, CATALOGUE, CASTS, ITEM_TEXT, TFIDF, for_liked(10), "recs AS (SELECT user_id, item_id FROM cb)")
       .replace(LIKED + ",\npeople", "people"))
def _(spark, folder):
    r = wh.ratings(spark, folder)
    items = wh.catalogue(spark, folder, with_cast=True).withColumnRenamed("cast", "actors")
    told = explain.explain_content(liked_list(spark, folder, 10), collab.user_liked(r), items)
    return told.select("user_id", "item_id", F.array_join("genres", "|").alias("genres"), "director", F.array_join("actors", "|").alias("actors"), "text")


@query("feature_importance_recommended", _why("feature_importance", *BOTH, WEIGHTED, f"recs AS (SELECT user_id, item_id FROM ({best('mixed', 10, 'user_id', 'user_id, item_id')}))")
       .replace(LIKED + ",\npeople", "people"))
def _(spark, folder):
    r = wh.ratings(spark, folder)
    items = wh.catalogue(spark, folder, with_cast=True).withColumnRenamed("cast", "actors")
    recs = blend.hybrid_weighted(*both_lists(spark, folder), cf_weight=0.6, cb_weight=0.4)
    found = explain.feature_importance(recs, collab.user_liked(r), items)
    return found.select("user_id", "item_id", *[F.round(c, 6).alias(c) for c in ("genre", "director", "actors", "year", "rating")])
