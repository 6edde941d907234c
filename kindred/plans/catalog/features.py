"""Cleaning and features."""

from pyspark.sql import functions as F

from kindred.functions import scalars
from kindred.operators import clean, collab, features
from kindred.plans import workflows
from kindred.plans.catalog.registry import CATALOGUE, DOC_TEXT, GENRES, RATINGS, TFIDF, query, with_
from kindred.session import scratch_folder
from kindred.sources import files
from kindred.sources import warehouse as wh


def raw_catalogue(spark, folder):
    """One untidy row per order line, so item ids repeat: text years, votes with commas, gaps."""
    lines = wh.table(spark, folder, "lineitem").join(
        wh.table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_size"), "l_partkey"
    )
    return lines.select(
        F.col("l_partkey").alias("id"), F.when(F.col("l_linenumber") > 1, F.col("p_name")).alias("title"),
        F.when(F.col("l_returnflag") != "N", F.regexp_replace("p_name", " ", ", ")).alias("genres"),
        F.when(F.col("l_linestatus") == "O", F.col("p_brand")).alias("director"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("release_date"),
        F.when(F.col("l_tax") > 0.01, (F.col("l_quantity") / 5).cast("string")).otherwise("N/A").alias("vote_average"),
        F.when(F.col("l_discount") > 0.01, F.format_number(F.col("l_extendedprice").cast("bigint"), 0)).otherwise("abc").alias("vote_count"),
        F.concat(F.col("p_size").cast("string"), F.lit(" min")).alias("runtime"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").alias("qty"),
    )


RAW = """raw AS (SELECT l_partkey AS id, CASE WHEN l_linenumber > 1 THEN p_name END AS title,
  CASE WHEN l_returnflag <> 'N' THEN replace(p_name, ' ', ', ') END AS genres, CASE WHEN l_linestatus = 'O' THEN p_brand END AS director,
  l_shipdate, CASE WHEN l_tax > 0.01 THEN l_quantity / 5 END AS stars,
  CASE WHEN l_discount > 0.01 THEN trunc(l_extendedprice)::BIGINT ELSE 0 END AS votes, p_size AS runtime,
  l_orderkey * 8 + l_linenumber AS pos, l_quantity AS qty FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("dedupe_first", with_(RAW, "SELECT id, min(pos) AS pos FROM raw GROUP BY 1"))
def _(spark, folder):
    return clean.dedupe_first(raw_catalogue(spark, folder), "id").select("id", "pos")


@query("canonicalize", with_(RAW, """SELECT id AS item_id, coalesce(title, 'Unknown') AS title, coalesce(genres, 'Unknown') AS genre,
  coalesce(director, 'Unknown') AS director, '' AS plot, CAST(year(l_shipdate) AS INTEGER) AS year, stars AS rating, votes,
  runtime AS runtime_minutes FROM raw"""))
def _(spark, folder):
    return clean.canonicalize(raw_catalogue(spark, folder)).drop("pos", "qty")


@query("extract_year", """SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year,
  TRY_CAST(regexp_extract(o_orderpriority || CAST(trunc(o_totalprice) AS BIGINT), '(\\d{4})', 1) AS INTEGER) AS price_digits FROM orders""")
def _(spark, folder):
    orders = wh.table(spark, folder, "orders")
    span = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("–2030"))
    price = F.concat("o_orderpriority", F.floor("o_totalprice").cast("string"))
    return orders.select(F.col("o_orderkey").alias("id"), scalars.extract_year(span).alias("year"), scalars.extract_year(price).alias("price_digits"))


@query("extract_runtime", "SELECT p_partkey AS id, p_size AS minutes, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS brand_no, NULL::INTEGER AS none FROM part")
def _(spark, folder):
    return wh.table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), scalars.extract_runtime(F.concat("p_size", F.lit(" min"))).alias("minutes"),
        scalars.extract_runtime(F.col("p_brand")).alias("brand_no"), scalars.extract_runtime(F.col("p_type")).alias("none"),
    )


@query("clean_votes", """SELECT l_orderkey, l_partkey, l_linenumber, trunc(l_extendedprice)::BIGINT AS votes, 0::BIGINT AS bad FROM lineitem""")
def _(spark, folder):
    packed = F.format_number(F.floor("l_extendedprice"), 0)
    return wh.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", scalars.clean_votes(packed).alias("votes"), scalars.clean_votes(F.col("l_returnflag")).alias("bad")
    )


@query("coerce_numeric", with_(RAW, "SELECT id, pos, qty, stars AS rating FROM raw"))
def _(spark, folder):
    return raw_catalogue(spark, folder).select("id", "pos", "qty", scalars.number(F.col("vote_average")).alias("rating"))


@query("impute_median", with_(RAW, "SELECT id, pos, qty, coalesce(stars, (SELECT median(stars) FROM raw)) AS rating FROM raw"))
def _(spark, folder):
    rows = raw_catalogue(spark, folder).select("id", "pos", "qty", scalars.number(F.col("vote_average")).alias("rating"))
    return clean.impute_median(rows)


@query("complete_rows", with_(RAW, "SELECT id AS item_id, pos, qty FROM raw WHERE genres IS NOT NULL AND director IS NOT NULL"))
def _(spark, folder):
    return clean.complete_rows(clean.canonicalize(raw_catalogue(spark, folder))).select("item_id", "pos", "qty")


@query("genre_onehot", with_(CATALOGUE, GENRES, "SELECT item_id, name FROM genres"))
def _(spark, folder):
    return features.genre_flags(wh.catalogue(spark, folder))


@query("genre_substring", with_(CATALOGUE, GENRES, """SELECT item_id, name FROM catalogue JOIN (SELECT DISTINCT name FROM genres) ON contains(genre, name)"""))
def _(spark, folder):
    return features.genre_flags(wh.catalogue(spark, folder), match="substring")


@query("combined_text", with_(CATALOGUE, "SELECT item_id, concat_ws(' ', plot, genre, director) AS combined_text FROM catalogue"))
def _(spark, folder):
    return workflows.with_text(wh.catalogue(spark, folder)).select("item_id", "combined_text")


@query("minmax_normalize", with_(CATALOGUE, """SELECT item_id,
  round((rating - (SELECT min(rating) FROM catalogue)) / (SELECT max(rating) - min(rating) FROM catalogue), 6) AS rating_normalized,
  round((year - (SELECT min(year) FROM catalogue)) / (SELECT max(year) - min(year) FROM catalogue), 6) AS year_normalized FROM catalogue"""))
def _(spark, folder):
    scaled = features.minmax_normalize(wh.catalogue(spark, folder), ["rating", "year"])
    return scaled.select("item_id", *[F.round(c, 6).alias(c) for c in ("rating_normalized", "year_normalized")])


@query("tfidf", with_(DOC_TEXT, TFIDF, "SELECT item_id, term, round(w, 6) AS weight FROM weights"))
def _(spark, folder):
    weights = features.tfidf(wh.text_catalogue(spark, folder), "plot")
    return weights.withColumn("weight", F.round("weight", 6))


@query("user_item", with_(RATINGS, "SELECT user_id, item_id, round(rating, 6) AS rating FROM ratings"))
def _(spark, folder):
    return collab.user_item(wh.raw_ratings(spark, folder)).withColumn("rating", F.round("rating", 6))


@query("mean_center", with_(RATINGS, "SELECT user_id, item_id, round(rating - avg(rating) OVER (PARTITION BY user_id), 9) + 0.0::DOUBLE AS rating FROM ratings"))
def _(spark, folder):
    return collab.mean_center(wh.ratings(spark, folder)).select("user_id", "item_id", (F.round("rating", 9) + F.lit(0.0)).alias("rating"))


@query("train_test_split", with_(RATINGS, """SELECT user_id, item_id, (user_id * 7919 + item_id * 104729 + 42) % 100 >= 80 AS is_test FROM ratings"""))
def _(spark, folder):
    split = collab.train_test_split(wh.ratings(spark, folder), bucket=collab.id_bucket("user_id", "item_id", 100))
    return split.select("user_id", "item_id", "is_test")


_ITEM_ONLY_TEXT = "texts AS (SELECT item_id, concat_ws(' ', plot, genre, director) AS body FROM catalogue)"


@query("preprocess_catalogue", with_(CATALOGUE, _ITEM_ONLY_TEXT, TFIDF, """SELECT item_id, year, round((rating - (SELECT min(rating) FROM catalogue))
  / (SELECT max(rating) - min(rating) FROM catalogue), 6) AS rating_normalized, term, round(w, 6) AS weight
  FROM catalogue JOIN weights USING (item_id)"""))
def _(spark, folder):
    source, path = wh.catalogue(spark, folder).drop("pos"), scratch_folder(spark) + "/csv"
    again = source.filter("item_id % 5 = 0").withColumns({"plot": F.lit("a later row of the same id"), "year": F.lit(1900)})
    files.csv_sink(source.unionByName(again), path)
    loaded = files.load_catalogue(spark, path, types=dict(source.dtypes))
    items, weights = workflows.preprocess(loaded, store=scratch_folder(spark) + "/tidy")
    return items.join(weights, "item_id").select(
        "item_id", "year", F.round("rating_normalized", 6).alias("rating_normalized"), "term", F.round("weight", 6).alias("weight")
    )
