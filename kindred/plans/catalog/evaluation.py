"""Errors, ranking metrics, coverage, cross-validation."""

from pyspark.sql import functions as F

from kindred.functions.ranking import rank_by
from kindred.operators import collab, factor, metrics
from kindred.plans import workflows
from kindred.plans.catalog.neighbours import DOC_SIMS, doc_weights
from kindred.plans.catalog.registry import CATALOGUE, DOC_TEXT, RATINGS, TFIDF, USER_SIMS, query, user_based, with_
from kindred.sources import warehouse as wh

ITEM_MEANS = "scored AS (SELECT r.*, avg(rating) OVER (PARTITION BY item_id) AS score FROM ratings r)"


def item_means(spark, folder):
    r = wh.ratings(spark, folder)
    return r.join(r.groupBy("item_id").agg(F.avg("rating").alias("score")), "item_id")


def _rounded(df, *columns):
    """Nine digits: ratios of small counts often end exactly on half a millionth, which engines round differently."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query("rmse", with_(RATINGS, ITEM_MEANS, "SELECT round(sqrt(avg((rating - score) ** 2)), 9) AS rmse FROM scored"))
def _(spark, folder):
    return _rounded(item_means(spark, folder).agg(metrics.rmse_of().alias("rmse")), "rmse")


@query("mae", with_(RATINGS, ITEM_MEANS, "SELECT round(avg(abs(rating - score)), 9) AS mae FROM scored"))
def _(spark, folder):
    return _rounded(item_means(spark, folder).agg(metrics.mae_of().alias("mae")), "mae")


@query("evaluate_predictions", with_(RATINGS, USER_SIMS, """near AS (SELECT a.user_id, a.item_id, sim, r.rating, row_number() OVER (PARTITION BY a.user_id, a.item_id ORDER BY round(sim, 9) DESC, s) AS place
  FROM ratings a JOIN ratings r ON a.item_id = r.item_id JOIN sims ON t = a.user_id AND s = r.user_id),
scored AS (SELECT user_id, item_id, sum(sim * rating) / sum(sim) AS score FROM near WHERE place <= 10 GROUP BY 1, 2)""", """
SELECT round(sqrt(avg((rating - coalesce(score, 0)) ** 2)), 9) AS rmse, round(avg(abs(rating - coalesce(score, 0))), 9) AS mae
  FROM ratings LEFT JOIN scored USING (user_id, item_id)"""))
def _(spark, folder):
    r = wh.ratings(spark, folder)
    scored = r.join(collab.predict_user_based(r, r), ["user_id", "item_id"])
    return _rounded(metrics.evaluate_predictions(scored), "rmse", "mae")


# A user's ten most sold items as recommendations and their ratings from 8 up as what is relevant.
RECS = """recs AS (SELECT user_id, item_id, CAST(rank AS INTEGER) AS rank FROM (SELECT r.*, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, item_id) AS rank
  FROM ratings r JOIN catalogue USING (item_id)) WHERE rank <= 10),
relevant AS (SELECT user_id, item_id FROM ratings WHERE rating >= 8),
sizes AS (SELECT user_id, count(*) AS n_relevant FROM relevant GROUP BY 1),
marked AS (SELECT r.*, (v.item_id IS NOT NULL)::INT AS hit FROM recs r LEFT JOIN relevant v USING (user_id, item_id)),
users AS (SELECT user_id, coalesce(n_relevant, 0) AS n_relevant FROM (SELECT DISTINCT user_id FROM recs) FULL JOIN sizes USING (user_id)),
counts AS (SELECT user_id, k, count(*) AS kept, sum(hit) AS hits FROM marked, (VALUES (5), (10)) AS t(k) WHERE rank <= k GROUP BY 1, 2),
scores AS (SELECT user_id, k, coalesce(hits / nullif(kept, 0), 0) AS p, coalesce(hits / nullif(n_relevant, 0), 0) AS r
  FROM (SELECT * FROM users, (VALUES (5), (10)) AS t(k)) LEFT JOIN counts USING (user_id, k)),
rates AS (SELECT user_id, coalesce(max(hit), 0)::DOUBLE AS hit_rate FROM users LEFT JOIN marked USING (user_id) GROUP BY 1),
running AS (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY rank) AS hits FROM marked),
precisions AS (SELECT user_id, coalesce(sum(hits / rank) FILTER (WHERE hit = 1), 0) / nullif(any_value(n_relevant), 0) AS ap FROM users LEFT JOIN running USING (user_id) GROUP BY 1)"""
BASE = (RATINGS, CATALOGUE, RECS)


def recs_and_relevant(spark, folder):
    r = wh.ratings(spark, folder)
    sold = wh.catalogue(spark, folder).select("item_id", "votes")
    recs = rank_by(r.join(sold, "item_id"), 10, ["user_id"], [F.col("votes").desc(), F.col("item_id")])
    return recs.select("user_id", "item_id", "rank"), r.filter("rating >= 8").select("user_id", "item_id")


@query("precision_at_k", with_(*BASE, "SELECT user_id, k, round(p, 9) AS precision FROM scores"))
def _(spark, folder):
    return _rounded(metrics.ranking_metrics(*recs_and_relevant(spark, folder)).select("user_id", "k", "precision"), "precision")


@query("recall_at_k", with_(*BASE, "SELECT user_id, k, round(r, 9) AS recall FROM scores"))
def _(spark, folder):
    return _rounded(metrics.ranking_metrics(*recs_and_relevant(spark, folder)).select("user_id", "k", "recall"), "recall")


@query("f1_at_k", with_(*BASE, "SELECT user_id, k, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1 FROM scores"))
def _(spark, folder):
    return _rounded(metrics.ranking_metrics(*recs_and_relevant(spark, folder)).select("user_id", "k", "f1"), "f1")


@query("hit_rate", with_(*BASE, "SELECT user_id, hit_rate FROM rates"))
def _(spark, folder):
    return metrics.hit_rate(*recs_and_relevant(spark, folder))


@query("average_precision", with_(*BASE, "SELECT user_id, round(coalesce(ap, 0), 9) AS average_precision FROM precisions"))
def _(spark, folder):
    return _rounded(metrics.average_precision(*recs_and_relevant(spark, folder)), "average_precision")


@query("ndcg_at_k", with_(*BASE, """got AS (SELECT user_id, sum(rating / log2(rank + 1)) AS dcg FROM recs JOIN ratings USING (user_id, item_id) GROUP BY 1),
ideal AS (SELECT user_id, sum(rating / log2(place + 1)) AS best FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS place FROM ratings)
  WHERE place <= 10 GROUP BY 1)""", "SELECT user_id, round(coalesce(dcg, 0) / best, 9) AS ndcg FROM ideal LEFT JOIN got USING (user_id)"))
def _(spark, folder):
    recs, _ = recs_and_relevant(spark, folder)
    return _rounded(metrics.ndcg_at_k(recs, wh.ratings(spark, folder).withColumnRenamed("rating", "gain"), 10), "ndcg")


@query("catalog_coverage", with_(*BASE, """SELECT count(DISTINCT item_id) AS recommended, (SELECT count(*) FROM catalogue) AS catalogue,
  round(count(DISTINCT item_id) / (SELECT count(*) FROM catalogue), 9) AS coverage FROM recs"""))
def _(spark, folder):
    recs, _ = recs_and_relevant(spark, folder)
    return _rounded(metrics.catalog_coverage(recs, wh.catalogue(spark, folder)), "coverage")


EVALUATED = """SELECT user_id, k, round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1, hit_rate,
  round(coalesce(ap, 0), 9) AS average_precision FROM scores JOIN rates USING (user_id) JOIN precisions USING (user_id)"""
MEASURES = ("precision", "recall", "f1", "average_precision")


@query("evaluate_recommendations", with_(*BASE, EVALUATED))
def _(spark, folder):
    return _rounded(metrics.evaluate_recommendations(*recs_and_relevant(spark, folder)), *MEASURES)


@query("precision_recall_points", with_(*BASE, """SELECT user_id, rank AS k, round(hits / rank, 9) AS precision, round(coalesce(hits / nullif(n_relevant, 0), 0), 9) AS recall
  FROM running JOIN users USING (user_id)"""))
def _(spark, folder):
    return _rounded(metrics.precision_recall_points(*recs_and_relevant(spark, folder)), "precision", "recall")


_SPLIT = """split AS (SELECT *, (user_id * 7919 + item_id * 104729 + 42) % 100 >= 80 AS is_test FROM all_ratings),
ratings AS (SELECT user_id, item_id, rating FROM split WHERE NOT is_test)"""
_HELD = RECS.split("relevant AS", 1)[1].split(",\n", 1)[1]


@query("evaluate_user", with_(RATINGS.replace("ratings AS", "all_ratings AS", 1), _SPLIT, user_based(10), "recs AS (SELECT user_id, item_id, rank FROM cf)",
                              "relevant AS (SELECT user_id, item_id FROM split WHERE is_test AND rating >= 8)", _HELD, EVALUATED))
def _(spark, folder):
    found = workflows.evaluate_user_based(wh.ratings(spark, folder), bucket=collab.id_bucket("user_id", "item_id", 100))
    return _rounded(found, *MEASURES)


def _item_means(train, pairs):
    means = train.groupBy("item_id").agg(F.avg("rating").alias("score"))
    return pairs.join(means, "item_id", "left").select("user_id", "item_id", F.coalesce("score", F.lit(0.0)).alias("score"))


@query("cross_validate_item_means", with_(RATINGS, """folded AS (SELECT *, (user_id * 7919 + item_id * 104729 + 42) % 5 AS fold FROM ratings),
totals AS (SELECT item_id, fold, sum(rating) AS s, count(*) AS n FROM folded GROUP BY 1, 2),
whole AS (SELECT item_id, sum(s) AS s, sum(n) AS n FROM totals GROUP BY 1),
scored AS (SELECT f.fold, f.rating, CASE WHEN w.n > t.n THEN (w.s - t.s) / (w.n - t.n) ELSE 0 END AS score
  FROM folded f JOIN whole w USING (item_id) JOIN totals t USING (item_id, fold))""", """
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, round(sqrt(avg((rating - score) * (rating - score))), 6) AS rmse, round(avg(abs(rating - score)), 6) AS mae FROM scored GROUP BY 1"""))
def _(spark, folder):
    """Every fold predicted by the items' means in the other folds."""
    found = metrics.cross_validate(wh.ratings(spark, folder), _item_means, bucket=collab.id_bucket("user_id", "item_id", 5))
    return found.withColumns({"rmse": F.round("rmse", 6), "mae": F.round("mae", 6)})


@query("cross_validate")
def _(spark, folder):
    def by_factors(train, pairs):
        return factor.mf_predict(pairs, *factor.mf_fit_als(train))

    return metrics.cross_validate(wh.ratings(spark, folder), by_factors)


@query("coverage_job", with_(DOC_TEXT, TFIDF, DOC_SIMS, """listed AS (SELECT neighbour_id FROM doc_sims
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, neighbour_id) <= 10)""", """
SELECT count(DISTINCT neighbour_id) AS recommended, (SELECT count(*) FROM documents) AS catalogue,
  round(count(DISTINCT neighbour_id) / (SELECT count(*) FROM documents), 9) AS coverage FROM listed"""))
def _(spark, folder):
    found = workflows.coverage_of_similar(*doc_weights(spark, folder), wh.text_catalogue(spark, folder))
    return _rounded(found, "coverage")
