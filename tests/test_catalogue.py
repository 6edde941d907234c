"""Cleaning, features, look-ups, explanations and blends on the literal fixtures."""

import pytest
from pyspark.sql import functions as F

from kindred import session
from kindred.operators import blend, clean, content, explain, features, ingest, search
from kindred.sources import files

TITLES = [
    ("k1", "Salt Road", "Travel", 2011, 7.9, "Ada Quist", "Ivo Blum, Rosa Tan"),
    ("k2", "The Long Alibi", "Mystery, Travel", 1983, 7.4, "Jun Okafor", "Pia Lund, Sol Reyes"),
    ("k3", "The Glass Harbour", "Heist, Mystery, Travel", 2016, 6.8, "Mika Stone", "Lee Adair, Noa Finch"),
    ("k4", "Paper Kites", "Travel", 2013, 6.1, "Ravi Holm", "Bea Cole, Uli Marsh"),
    ("k5", "Second Spring", "Music, Travel", 2012, 6.1, "Tess Vale", "Oda Grey, Finn Moss"),
]


@pytest.fixture(scope="module")
def titles(spark):
    rows = [(*t, n) for n, t in enumerate(TITLES)]
    return spark.createDataFrame(rows, "item_id string, title string, genre string, year int, rating double, director string, actors string, pos int")


def ids(df):
    return [r["item_id"] for r in df.collect()]


def test_recommend_by_genre_and_features(titles):
    assert ids(content.recommend_by_genre(titles, ["travel"], 3, 6.5)) == ["k1", "k2", "k3"]
    found = content.recommend_by_features(titles, ["Travel"], None, 6.1, (2010, 2014), 3)
    assert ids(found) == ["k1", "k4", "k5"]


def test_similar_genre_prefers_overlap(titles, spark):
    target = spark.createDataFrame([("k3",)], "item_id string")
    found = content.similar_genre(titles, 10, target).orderBy("rank").collect()
    assert [r["neighbour_id"] for r in found] == ["k2", "k1", "k4", "k5"]


def test_similar_genre_equals_brute_force(spark):
    names = ["A", "B", "C", "D"]
    rows = [(i, ", ".join(n for b, n in enumerate(names) if (i * 7 % 16) >> b & 1) or "Unknown", float(i * 13 % 10)) for i in range(60)]
    items = spark.createDataFrame(rows, "item_id bigint, genre string, rating double")
    sets = {i: set(g.split(", ")) - {"Unknown"} for i, g, _ in rows}
    rating = {i: r for i, _, r in rows}
    want = set()
    for t in sets:
        near = sorted((-len(sets[t] & sets[o]), -rating[o], o) for o in sets if o != t and sets[t] & sets[o])[:3]
        want |= {(t, o, rank + 1) for rank, (_, _, o) in enumerate(near)}
    for most in (8, 2, 0):
        got = {(r["item_id"], r["neighbour_id"], r["rank"]) for r in content.similar_genre(items, 3, most=most).collect()}
        assert got == want
    wide = spark.createDataFrame([(1, ",".join("ABCDEFGHIJ"), 1.0), (2, "A,B", 2.0), (3, "A,Z", 3.0)], "item_id bigint, genre string, rating double")
    got = [(r["item_id"], r["neighbour_id"]) for r in content.similar_genre(wide, 3).orderBy("item_id", "rank").collect()]
    assert got == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 2), (3, 1)]


def test_similar_genre_with_many_sets_in_one_genre(spark):
    """100,000 distinct sets share a genre: their pairs would be 10 billion."""
    n = 100_000
    pair = F.array_join(F.array(F.lit("All"), F.concat(F.lit("a"), F.floor(F.col("id") / 320)), F.concat(F.lit("b"), F.col("id") % 320)), ", ")
    items = spark.range(n).select(F.col("id").alias("item_id"), pair.alias("genre"), (F.hash("id") % 1000).cast("double").alias("rating"))
    targets = spark.range(0, n, 20_000).select(F.col("id").alias("item_id"))
    rows = {r["item_id"]: (set(r["genre"].split(", ")), r["rating"]) for r in items.collect()}
    want = set()
    for t in range(0, n, 20_000):
        near = sorted((-len(rows[t][0] & s), -rating, i) for i, (s, rating) in rows.items() if i != t)[:5]
        want |= {(t, i, k + 1) for k, (_, _, i) in enumerate(near)}
    every = content.similar_genre(items, 5)
    assert {(r["item_id"], r["neighbour_id"], r["rank"]) for r in content.similar_genre(items, 5, targets).collect()} == want
    assert {(r["item_id"], r["neighbour_id"], r["rank"]) for r in every.join(targets, "item_id").collect()} == want
    assert every.count() == 5 * n


def test_explanations(titles, spark):
    recs = spark.createDataFrame([("u", "k4")], "user_id string, item_id string")
    liked = spark.createDataFrame([("u", "k1"), ("u", "k5")], "user_id string, item_id string")
    told = explain.explain_content(recs, liked, titles).first()
    assert (told["genres"], told["director"], told["actors"]) == (["Travel"], None, [])
    assert told["text"] == "This movie is recommended because it shares genres (Travel) with movies you enjoyed."
    weight = explain.feature_importance(recs, liked, titles).first()
    assert tuple(weight[2:]) == (1.0, 0.0, 0.0, 1.0, 0.0)
    both = explain.explain_hybrid(spark.createDataFrame([(0.31, 0.64)], "cf_score double, cb_score double")).first()
    assert both["primary_reason"] == "content_based" and "(0.31)" in both["text"] and "(0.64)" in both["text"]


def test_cleaning_of_untidy_rows(spark):
    rows = [
        ("a", "2011", "7.5", "40", "96 min", "1,204", "Travel", 0), ("b", "1983", "6.5", "90", "118 min", "33,017", "Mystery, Travel", 1),
        ("c", "2016", "5.5", "50", "101 min", "880", "Heist, Mystery", 2), ("d", "2003–2007", "N/A", None, None, "many", None, 3),
        ("e", "soon", None, "n/a", "long", None, "Unknown", 4), ("a", "1955", "2.0", "3", "7 min", "9", "Other", 5),
    ]
    raw = spark.createDataFrame(rows, "imdb_id string, year string, imdb_rating string, metascore string, runtime string, imdb_votes string, genre string, pos int")
    got = {r["item_id"]: r for r in clean.clean_catalogue(raw).collect()}
    assert [got[x]["year"] for x in "abcde"] == [2011, 1983, 2016, 2003, None]
    assert [got[x]["rating"] for x in "abcde"] == [7.5, 6.5, 5.5, 6.5, 6.5]
    assert [got[x]["runtime_minutes"] for x in "abcde"] == [96, 118, 101, None, None]
    assert [got[x]["votes"] for x in "abcde"] == [1204, 33017, 880, 0, 0]
    assert got["d"]["metascore"] == 50 and got["d"]["genre"] == "Unknown"
    known = clean.clean_catalogue(raw.filter("imdb_id in ('a', 'b', 'c') and pos < 3"))
    with pytest.raises(ValueError, match="position"):
        clean.clean_catalogue(raw.drop("pos"))
    scaled = features.minmax_normalize(known, ["rating", "metascore"]).orderBy("item_id").collect()
    assert [round(r["rating_normalized"], 6) for r in scaled] == [1.0, 0.5, 0.0]
    assert [r["metascore_normalized"] for r in scaled] == [0.0, 1.0, 0.2]
    assert [r["name"] for r in features.genre_vocabulary(known).orderBy("name").collect()] == ["Heist", "Mystery", "Travel"]


def test_tfidf_weights(spark):
    items = spark.createDataFrame([(1, "red red cat"), (2, "the cat"), (3, "")], "item_id bigint, combined_text string")
    got = {(r["item_id"], r["term"]): r["weight"] for r in features.tfidf(items).collect()}
    import math
    cat, red = math.log(4 / 3) + 1, 2 * (math.log(4 / 2) + 1)
    norm = math.hypot(cat, red)
    assert got == {(1, "cat"): pytest.approx(cat / norm), (1, "red"): pytest.approx(red / norm), (2, "cat"): pytest.approx(1.0)}


def test_titles(titles, spark):
    asked = spark.createDataFrame([("k2",), ("paper kites",), ("nothing",)], "request string")
    got = {r["request"]: r["item_id"] for r in search.resolve_title(asked, titles).collect()}
    assert got == {"k2": "k2", "paper kites": "k4", "nothing": None}
    typed = spark.createDataFrame([("the",), ("papr kite",), ("q",)], "query string")
    found = search.autocomplete(typed, titles).filter("rank = 1").collect()
    assert {r["query"]: r["title"] for r in found} == {"the": "The Glass Harbour", "papr kite": "Paper Kites"}


def test_actors(titles, spark):
    items = titles.withColumnRenamed("actors", "cast")
    asked = spark.createDataFrame([(" ODA grey ",), ("Nobody",)], "actor string")
    got = {r["actor_name"]: (r["total_movies"], r["average_rating"], r["all_movie_ids"]) for r in content.actor_profile(items, asked).collect()}
    assert got == {" ODA grey ": (1, 6.1, ["k5"]), "Nobody": (0, 0.0, [])}
    assert content.item_cast(items).filter("item_id = 'k3'").first()["cast"] == ["Lee Adair", "Noa Finch"]


def test_blends(spark):
    kind = "user_id string, item_id string, score double"
    cf = spark.createDataFrame([("u", "p", 8.0), ("u", "q", 2.0)], kind)
    cb = spark.createDataFrame([("u", "p", 0.5), ("u", "q", 1.0), ("u", "r", 0.25)], kind)
    scores = lambda df: {r["item_id"]: pytest.approx(r["score"]) for r in df.collect()}
    assert scores(blend.hybrid_weighted(cf, cb, 10, 0.6, 0.4)) == {"p": 5.0, "q": 1.6, "r": 0.1}
    assert scores(blend.feature_combination(cf, cb)) == {"p": 5.1, "q": 1.8, "r": 0.125}
    ratings = spark.createDataFrame([("u", "a", 3.0), ("u", "b", 9.0), ("u", "c", 0.0)], "user_id string, item_id string, rating double")
    assert scores(blend.hybrid_switching(ratings, cf, cb, min_user_ratings=2)) == {"p": 8.0, "q": 2.0}
    assert set(scores(blend.hybrid_switching(ratings, cf, cb, min_user_ratings=3))) == {"p", "q", "r"}
    assert [r["item_id"] for r in blend.hybrid_cascade(cf, cb, 3, 4.5).orderBy("rank").collect()] == ["p", "q", "r"]


def test_credits(spark):
    names = [{"name": n} for n in ("a", None, "c", "d", "e", "f")]
    import json
    bodies = [
        {"id": 1, "genres": [{"name": "X"}, {"name": "Y"}], "release_date": "1999-01-01", "overview": "o",
         "credits": {"crew": [{"job": "Writer", "name": "w"}, {"job": "Director", "name": "d1"}, {"job": "Director", "name": "d2"}], "cast": names}},
        {"id": 2, "genres": [], "release_date": "", "overview": "", "credits": {"crew": [], "cast": []}},
    ]
    frame = spark.createDataFrame([(json.dumps(b),) for b in bodies], "payload string")
    one, two = ingest.extract_credits(frame).orderBy("id").collect()
    assert (one["genre"], one["director"], one["cast"], one["year"]) == ("X, Y", "d1", "a, c, d, e", "1999")
    assert (two["genre"], two["director"], two["cast"]) == (None, None, None)
    assert ingest.extract_credits(frame, missing="Unknown").filter("id = 2").first()["cast"] == "Unknown"
    genre = spark.createDataFrame([([28, 99999, 18, 35],)], "ids array<int>").select(ingest.map_genre_ids(F.col("ids"))).first()[0]
    assert genre == "Action, Unknown, Drama"


def test_csv_sources(spark, tmp_path):
    path = str(tmp_path / "ratings.csv")
    with open(path, "w") as out:
        out.write('userId,movieId,rating\nu1,"m,1",5\nu2,m2,bad\n')
    assert [tuple(r) for r in files.load_ratings(spark, path).orderBy("user_id").collect()] == [("u1", "m,1", 5.0), ("u2", "m2", None)]
    with pytest.raises(ValueError, match="genre"):
        files.load_catalogue(spark, path, ["genre"])
    with pytest.raises(FileNotFoundError):
        files.load_catalogue(spark, str(tmp_path / "none.csv"))


def test_first_row_of_a_csv_wins_and_the_last_result(spark, tmp_path):
    path = tmp_path / "items"
    path.mkdir()
    (path / "b.csv").write_text("id,title,year\nx,second file,2001\nz,only,2002\n")
    (path / "a.csv").write_text("id,title,year\nx,first,1990\ny,one,1991\nx,again,1992\n")
    tidy = clean.clean_catalogue(files.load_catalogue(spark, str(path)))
    assert {r["item_id"]: r["title"] for r in tidy.collect()} == {"x": "first", "y": "one", "z": "only"}
    results = spark.createDataFrame([("x", True, "early", 1), ("x", False, None, 2), ("x", True, "late", 3), ("y", True, "g", 1), ("y", False, "h", 2)],
                                    "item_id string, ok boolean, title string, pos int")
    told = ingest.apply_enrichment(tidy.select("item_id", "title"), results, columns=["title"])
    assert {r["item_id"]: r["title"] for r in told.collect()} == {"x": "late", "y": "one", "z": "only"}


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[2,1,512]")
    monkeypatch.setattr(session, "_shared", lambda spark: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_folder(spark)


def test_synthetic_tables_repeat(spark):
    items = files.synth_catalogue(files.sample_rows(spark, 50)).withColumnRenamed("imdb_id", "item_id")
    users = spark.range(20).select(F.concat(F.lit("u"), "id").alias("user_id"))
    ratings = files.synth_ratings(users, items, 5, 20)
    assert sorted(ratings.collect()) == sorted(files.synth_ratings(users.repartition(3), items, 5, 20).collect())
    per_user = [r["count"] for r in ratings.groupBy("user_id").count().collect()]
    assert len(per_user) == 20 and min(per_user) >= 5 and max(per_user) <= 20
    assert ratings.groupBy("user_id", "item_id").count().filter("count > 1").count() == 0


def test_requests_for_items_and_users(spark):
    recs = lambda base: spark.createDataFrame([(u, base + k, 1.0 / k, k) for u in (1, 2) for k in (1, 2, 3)], "user_id long, item_id long, score double, rank int")
    similar = spark.createDataFrame([(7, 70, 0.9, 1), (7, 71, 0.8, 2), (7, 72, 0.7, 3)], "item_id long, neighbour_id long, score double, rank int")
    rows = [(1, 1, None, "cf", 2), (2, 1, None, "mf", 1), (3, 2, 7, "cf", 2), (4, None, 7, None, 1), (5, 1, None, "other", 5), (6, None, None, "cf", 5), (7, 9, None, "cf", 5), (8, 1, 8, "cf", 5), (9, 1, None, "cf", 1)]
    asked = spark.createDataFrame(rows, "request_id long, user_id long, item_id long, method string, n int")
    got = {(r["request_id"], r["answered_by"], r["item_id"], r["rank"]) for r in blend.answer(asked, {"cf": recs(10), "mf": recs(20)}, similar).collect()}
    assert got == {(1, "cf", 11, 1), (1, "cf", 12, 2), (2, "mf", 21, 1), (3, "item", 70, 1), (3, "item", 71, 2), (4, "item", 70, 1), (9, "cf", 11, 1)}


def test_explained_pairs_meet_after_their_features(spark):
    """The lists of a user are joined last, so no shuffle carries their product with all names."""
    from kindred.operators import explain
    items = spark.createDataFrame([(i, "A, B", "D", "X, Y", 1990 + i) for i in range(4)], "item_id bigint, genre string, director string, actors string, year int")
    recs = spark.createDataFrame([(1, 0), (1, 1)], "user_id bigint, item_id bigint")
    liked = spark.createDataFrame([(1, 2), (1, 3)], "user_id bigint, item_id bigint")
    found = explain.feature_importance(recs, liked, items)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert "user_id" in joins[1] and "liked_id" not in joins[1]
    assert sorted((r.user_id, r.item_id, r.genre, r.year) for r in found.collect()) == [(1, 0, 1.0, 1.0), (1, 1, 1.0, 1.0)]
