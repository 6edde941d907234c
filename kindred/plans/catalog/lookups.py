"""Catalogue look-ups, categories, actors, titles."""

from pyspark.sql import functions as F

from kindred.operators import content, search
from kindred.plans.catalog.registry import CASTS, CATALOGUE, GENRES, TFIDF, query, with_
from kindred.plans import workflows
from kindred.sources import warehouse as wh


@query("recommend_by_genre", with_(CATALOGUE, """SELECT item_id, title, genre, round(rating, 6) AS rating, year FROM catalogue
  WHERE regexp_matches(genre, '(?i)widget|ring') AND rating >= 2 ORDER BY rating DESC, item_id LIMIT 10"""))
def _(spark, folder):
    found = content.recommend_by_genre(wh.catalogue(spark, folder), ["widget", "RING"], 10, 2.0)
    return found.withColumn("rating", F.round("rating", 6))


@query("recommend_by_features", with_(CATALOGUE, """SELECT item_id, title, genre, round(rating, 6) AS rating, year, director FROM catalogue
  WHERE regexp_matches(genre, '(?i)widget|ring') AND regexp_matches(director, '(?i)brand#1|brand#2') AND rating >= 1
  AND year BETWEEN 1975 AND 2015 ORDER BY rating DESC, item_id LIMIT 10"""))
def _(spark, folder):
    found = content.recommend_by_features(wh.catalogue(spark, folder), ["widget", "ring"], ["Brand#1", "Brand#2"], 1.0, (1975, 2015))
    return found.withColumn("rating", F.round("rating", 6))


@query("item_info", with_(CATALOGUE, """SELECT l.item_id, title, genre, CAST(year AS VARCHAR) AS year, round(rating, 6) AS rating, director,
  'Unknown' AS actors, plot FROM (SELECT l_partkey AS item_id FROM lineitem) l JOIN catalogue USING (item_id)"""))
def _(spark, folder):
    asked = wh.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("item_id"))
    return content.item_info(asked, wh.catalogue(spark, folder)).withColumn("rating", F.round("rating", 6))


def _ranked(source: str, order: str) -> str:
    return f"""SELECT item_id, neighbour_id, round(rating, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {order}rating DESC, {{more}}neighbour_id) AS rank FROM {source}) WHERE rank <= 10"""


SHARED = """shared AS (SELECT a.item_id, b.item_id AS neighbour_id, count(*) AS overlap FROM genres a JOIN genres b
  ON a.name = b.name AND a.item_id <> b.item_id GROUP BY 1, 2),
by_genre AS (SELECT s.item_id, neighbour_id, overlap, rating FROM shared s JOIN catalogue c ON neighbour_id = c.item_id)"""
BY_DIRECTOR = "by_director AS (SELECT a.item_id, b.item_id AS neighbour_id, b.rating FROM catalogue a JOIN catalogue b ON a.director = b.director AND a.item_id <> b.item_id)"
BY_YEAR = "by_year AS (SELECT a.item_id, b.item_id AS neighbour_id, b.rating, b.popularity FROM catalogue a JOIN catalogue b ON a.year = b.year AND a.item_id <> b.item_id)"
GENRE_LIST = _ranked("by_genre", "overlap DESC, ").replace("{more}", "")
DIRECTOR_LIST = _ranked("by_director", "").replace("{more}", "")
YEAR_LIST = _ranked("by_year", "").replace("{more}", "popularity DESC, ")


@query("similar_genre", with_(CATALOGUE, GENRES, SHARED, GENRE_LIST))
def _(spark, folder):
    return content.similar_genre(wh.catalogue(spark, folder))


@query("same_director", with_(CATALOGUE, BY_DIRECTOR, DIRECTOR_LIST))
def _(spark, folder):
    return content.same_director(wh.catalogue(spark, folder))


@query("popular_that_year", with_(CATALOGUE, BY_YEAR, YEAR_LIST))
def _(spark, folder):
    return content.popular_that_year(wh.catalogue(spark, folder))


ITEM_LIST = """item_sims AS (SELECT a.item_id, b.item_id AS neighbour_id, sum(a.w * b.w) AS score FROM weights a JOIN weights b
  ON a.term = b.term AND a.item_id <> b.item_id GROUP BY 1, 2),
content_list AS (SELECT item_id, neighbour_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY item_id ORDER BY round(score, 9) DESC, neighbour_id) AS rank FROM item_sims) WHERE rank <= 10)"""
PLAIN_TEXT = "texts AS (SELECT item_id, concat_ws(' ', plot, genre, director) AS body FROM catalogue)"
CATEGORIES = f"""lists AS (SELECT 'similar_genre' AS category, * FROM ({GENRE_LIST}) UNION ALL SELECT 'same_director', * FROM ({DIRECTOR_LIST})
  UNION ALL SELECT 'popular_that_year', * FROM ({YEAR_LIST}) UNION ALL SELECT 'similar_content', * FROM content_list)"""
ALL_LISTS = (CATALOGUE, GENRES, SHARED, BY_DIRECTOR, BY_YEAR, PLAIN_TEXT, TFIDF, ITEM_LIST, CATEGORIES)


def category_lists(spark, folder):
    items = wh.catalogue(spark, folder)
    return items, content.categorized(items, *workflows.content_model(items))


@query("categorized", with_(*ALL_LISTS, "SELECT item_id, category, neighbour_id, score, rank FROM lists"))
def _(spark, folder):
    return category_lists(spark, folder)[1]


ACTORS = """cast_rows AS (SELECT DISTINCT lower(s_name) AS actor, l_partkey AS item_id, rating FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN catalogue ON l_partkey = item_id)"""


@query("items_by_actor", with_(CATALOGUE, ACTORS, """SELECT actor, item_id, round(rating, 6) AS score, CAST(rank AS INTEGER) AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY round(rating, 9) DESC, item_id) AS rank FROM cast_rows) WHERE rank <= 20"""))
def _(spark, folder):
    return content.items_by_actor(wh.catalogue(spark, folder, with_cast=True))


@query("actor_profile", with_(CATALOGUE, ACTORS, """films AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY rating DESC, item_id) AS rank FROM cast_rows
  QUALIFY rank <= 100)""", """SELECT s_name AS actor_name, count(item_id) AS total_movies, coalesce(round(avg(rating), 2), 0) AS average_rating,
  coalesce(string_agg(item_id, ',' ORDER BY rank) FILTER (WHERE rank <= 5), '') AS top_ids, coalesce(string_agg(item_id, ',' ORDER BY rank), '') AS all_ids
  FROM supplier LEFT JOIN films ON lower(s_name) = actor GROUP BY 1"""))
def _(spark, folder):
    actors = wh.table(spark, folder, "supplier").select(F.col("s_name").alias("actor"))
    found = content.actor_profile(wh.catalogue(spark, folder, with_cast=True), actors)
    return found.select(
        "actor_name", "total_movies", "average_rating",
        F.array_join(F.col("top_movies.movie_id").cast("array<string>"), ",").alias("top_ids"), F.array_join("all_movie_ids", ",").alias("all_ids"),
    )


@query("item_cast", with_(CATALOGUE, CASTS, "SELECT item_id, title, replace(coalesce(names, ''), ', ', '|') AS \"cast\" FROM catalogue LEFT JOIN casts USING (item_id)"))
def _(spark, folder):
    found = content.item_cast(wh.catalogue(spark, folder, with_cast=True))
    return found.withColumn("cast", F.array_join("cast", "|"))


@query("resolve_title", with_(CATALOGUE, """wanted AS (SELECT upper(p_name) AS request FROM part UNION SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem),
titles AS (SELECT lower(title) AS k, arg_min(item_id, pos) AS id FROM catalogue GROUP BY 1)""", """
SELECT request, coalesce(c.item_id, t.id) AS item_id, CASE WHEN coalesce(c.item_id, t.id) IS NULL THEN 'Movie ''' || request || ''' not found' END AS error
  FROM wanted LEFT JOIN catalogue c ON request = CAST(c.item_id AS VARCHAR) LEFT JOIN titles t ON lower(request) = k"""))
def _(spark, folder):
    names = wh.table(spark, folder, "part").select(F.upper("p_name").alias("request"))
    ids = wh.table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("request"))
    return search.resolve_title(names.unionByName(ids), wh.catalogue(spark, folder))


@query("link_title_year", with_(CATALOGUE, """wanted AS (SELECT p_name AS title, CASE WHEN l_linenumber > 1 THEN CAST(1970 + p_size AS INTEGER) END AS year
  FROM lineitem JOIN part ON l_partkey = p_partkey),
by_title AS (SELECT lower(title) AS k, arg_min(item_id, pos) AS id FROM catalogue GROUP BY 1),
by_year AS (SELECT lower(title) AS k, year, arg_min(item_id, pos) AS id FROM catalogue GROUP BY 1, 2)""", """
SELECT w.title, w.year, CASE WHEN w.year IS NULL THEN t.id ELSE y.id END AS item_id FROM wanted w
  LEFT JOIN by_title t ON lower(w.title) = t.k LEFT JOIN by_year y ON lower(w.title) = y.k AND w.year = y.year"""))
def _(spark, folder):
    lines = wh.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_linenumber")
    wanted = lines.join(wh.table(spark, folder, "part"), "p_partkey").select(
        F.col("p_name").alias("title"), F.when(F.col("l_linenumber") > 1, F.col("p_size") + 1970).alias("year")
    )
    return search.link_title_year(wanted, wh.catalogue(spark, folder))


@query("title_index", with_(CATALOGUE, "SELECT title, count(*) AS candidates, min(pos) AS first_id FROM catalogue GROUP BY 1"))
def _(spark, folder):
    return search.title_index(wh.catalogue(spark, folder))


@query("autocomplete", with_(CATALOGUE, """asked AS (SELECT DISTINCT lower(p_type) AS query FROM part UNION SELECT DISTINCT lower(substring(p_name, 1, 3)) FROM part),
titles AS (SELECT DISTINCT title FROM catalogue),
starts AS (SELECT query, title, 1 AS stage, row_number() OVER (PARTITION BY query ORDER BY title) AS rank FROM asked JOIN titles
  ON starts_with(lower(title), query) QUALIFY rank <= 10),
short AS (SELECT query FROM asked LEFT JOIN starts USING (query) GROUP BY 1 HAVING count(title) < 10),
alike AS (SELECT query, title, 1 - levenshtein(query, lower(title)) / greatest(length(query), length(title)) AS score FROM short, titles),
fuzzy AS (SELECT query, title, 2 AS stage, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, title) AS rank FROM alike
  ANTI JOIN starts USING (query, title) WHERE score >= 0.4 QUALIFY rank <= 10),
chosen AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY stage, rank) AS place FROM (FROM starts UNION ALL FROM fuzzy) QUALIFY place <= 10)""", """
SELECT query, item_id, title, year, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY place, pos) AS n
  FROM (SELECT query, title, place FROM chosen) JOIN catalogue USING (title)) WHERE n <= 10"""))
def _(spark, folder):
    parts = wh.table(spark, folder, "part")
    asked = parts.select(F.col("p_type").alias("query")).unionByName(parts.select(F.substring("p_name", 1, 3).alias("query")))
    return search.autocomplete(asked, wh.catalogue(spark, folder))
