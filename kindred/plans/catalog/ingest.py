"""Sources, sinks and ingest."""

from pyspark.sql import functions as F

from kindred.operators import ingest
from kindred.operators.clean import dedupe_first
from kindred.plans.catalog.registry import CASTS, CATALOGUE, RATINGS, query, with_
from kindred.session import scratch_folder
from kindred.sources import files, store
from kindred.sources import warehouse as wh
from kindred.streaming import streams


@query("load_catalogue", with_(CATALOGUE, "SELECT item_id, title, genre, director, year, round(rating, 6) AS rating, votes FROM catalogue"))
def _(spark, folder):
    path = scratch_folder(spark) + "/catalogue"
    files.csv_sink(wh.catalogue(spark, folder), path)
    types = {"item_id": "bigint", "year": "int", "rating": "double", "votes": "bigint"}
    loaded = files.load_catalogue(spark, path, ["item_id", "title", "genre"], types=types)
    return loaded.select("item_id", "title", "genre", "director", "year", F.round("rating", 6).alias("rating"), "votes")


@query("load_ratings", with_(RATINGS, "SELECT user_id, item_id, round(rating, 6) AS rating FROM ratings"))
def _(spark, folder):
    path = scratch_folder(spark) + "/ratings"
    files.csv_sink(wh.ratings(spark, folder).withColumnsRenamed({"user_id": "userId", "item_id": "movieId"}), path)
    return files.load_ratings(spark, path).select(
        F.col("user_id").cast("bigint").alias("user_id"), F.col("item_id").cast("bigint").alias("item_id"),
        F.round("rating", 6).alias("rating"),
    )


@query("dataset_summary", with_(RATINGS, """SELECT (SELECT count(*) FROM part) AS items, count(*) AS ratings,
  count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS rated_items,
  round(count(*) / count(DISTINCT user_id), 6) AS ratings_per_user FROM ratings"""))
def _(spark, folder):
    summary = files.dataset_summary(wh.catalogue(spark, folder), wh.ratings(spark, folder))
    return summary.withColumn("ratings_per_user", F.round("ratings_per_user", 6))


def _drawn(salt: str, low: int, high: int, *keys: str) -> str:
    text = " || '|' || ".join([*keys, f"'{salt}42'"])
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {high - low + 1} + {low})"


def _word(salt: str) -> str:
    return f"[{', '.join(repr(w) for w in files.MADE_UP)}][{_drawn(salt, 1, len(files.MADE_UP), 'n')}]"


@query("synth_catalogue", f"""WITH rows AS (SELECT p_partkey + 1 AS n FROM part),
genres AS (SELECT n, {_word('g1')} AS g1, {_word('g2')} AS g2 FROM rows)
SELECT 'made' || lpad(CAST(n AS VARCHAR), 9, '0') AS imdb_id, {_word('t1')} || ' ' || {_word('t2')} || ' ' || n AS title, CAST({_drawn('year', 1970, 2023, 'n')} AS INTEGER) AS year,
  CASE WHEN g1 = g2 THEN g1 ELSE g1 || ', ' || g2 END AS genre, {_drawn('rating', 50, 95, 'n')} / 10 AS imdb_rating, CAST({_drawn('meta', 30, 100, 'n')} AS INTEGER) AS metascore,
  {_drawn('runtime', 80, 180, 'n')} || ' min' AS runtime, {_word('d1')} || ' ' || {_drawn('d2', 1, 9, 'n')} AS director,
  {_word('a1')} || ' ' || {_drawn('a2', 10, 19, 'n')} || ', ' || {_word('a3')} || ' ' || {_drawn('a4', 20, 29, 'n')} AS actors,
  {_word('p1')} || ' and ' || {_word('p2')} || ' meet ' || {_word('p3')} AS plot, ['xx', 'yy'][{_drawn('language', 1, 2, 'n')}] AS language,
  'Land ' || {_drawn('country', 1, 5, 'n')} AS country, {_drawn('votes', 1000, 100000, 'n')} AS imdb_votes FROM genres""")
def _(spark, folder):
    return files.synth_catalogue(wh.table(spark, folder, "part").select((F.col("p_partkey") + 1).alias("n")))


@query("synth_ratings", f"""WITH ids AS (SELECT item_id, row_number() OVER (ORDER BY {_drawn('item', 0, 2**32 - 1, 'item_id')}, item_id) - 1 AS place FROM (SELECT DISTINCT p_partkey AS item_id FROM part)),
slots AS (SELECT user_id, {_drawn('count', 5, 29, 'user_id')} AS wanted, slot, CAST('0x' || substr(md5(user_id || '|' || slot || '|slot42'), 1, 8) AS BIGINT) % (SELECT count(*) FROM ids) AS place
  FROM (SELECT DISTINCT c_custkey AS user_id FROM customer), range(0, 117) AS t(slot)),
drawn AS (SELECT user_id, wanted, place, min(slot) AS slot FROM slots GROUP BY 1, 2, 3),
kept AS (SELECT * FROM drawn QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY slot) <= wanted)
SELECT user_id, item_id, CAST({_drawn('rating', 1, 10, 'user_id', 'item_id')} AS DOUBLE) AS rating FROM kept JOIN ids USING (place)""")
def _(spark, folder):
    return files.synth_ratings(wh.profiles(spark, folder), wh.catalogue(spark, folder))


@query("union_catalogues", with_(CATALOGUE, """SELECT item_id, title, director, plot, NULL::VARCHAR AS language, 0 AS origin FROM catalogue
UNION ALL SELECT doc_id, NULL, source, text, lang, 1 FROM documents WHERE doc_id NOT IN (SELECT item_id FROM catalogue)"""))
def _(spark, folder):
    both = ingest.union_catalogues([wh.catalogue(spark, folder), wh.text_catalogue(spark, folder)])
    return both.select("item_id", "title", "director", "plot", "language", "origin")


def _order_lines(spark, folder):
    lines = wh.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"
    )
    return lines.join(wh.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")


def payloads(spark, folder):
    """One credits payload per order: its lines are the people."""
    place = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
    name = F.when(F.col("l_linestatus") == "O", F.col("s_name"))
    job = F.when(F.col("l_returnflag") == "A", "Director").otherwise("Writer")
    people = _order_lines(spark, folder).groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(*place, job.alias("job"), F.col("s_name").alias("member"), name.alias("name")))).alias("p")
    )
    orders = wh.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.array(F.struct(F.col("o_orderstatus").alias("name")), F.struct(F.col("o_orderpriority").alias("name"))).alias("genres"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"), F.lit("").alias("overview"),
    )
    crew = F.transform("p", lambda x: F.struct(x["job"].alias("job"), x["member"].alias("name")))
    cast = F.transform("p", lambda x: F.struct(x["name"].alias("name")))
    body = F.struct("id", "genres", "release_date", "overview", F.struct(crew.alias("crew"), cast.alias("cast")).alias("credits"))
    return orders.join(people, "id").select(F.to_json(body).alias("payload"))


@query("extract_credits", """WITH lines AS (SELECT l_orderkey AS id, s_name, l_returnflag, l_linestatus, row_number() OVER
  (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS place
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT id, any_value(o_orderstatus || ', ' || o_orderpriority) AS genre, arg_min(s_name, place) FILTER (WHERE l_returnflag = 'A') AS director,
  string_agg(s_name, ', ' ORDER BY place) FILTER (WHERE place <= 5 AND l_linestatus = 'O') AS "cast",
  any_value(strftime(o_orderdate, '%Y')) AS year FROM lines JOIN orders ON id = o_orderkey GROUP BY id""")
def _(spark, folder):
    return ingest.extract_credits(payloads(spark, folder)).drop("overview")


def _genre_case() -> str:
    return " ".join(f"WHEN {k} THEN '{v}'" for k, v in ingest.GENRE_NAMES.items())


@query("map_genre_ids", f"""WITH lines AS (SELECT l_orderkey AS id, p_size, row_number() OVER
  (PARTITION BY l_orderkey ORDER BY l_linenumber, p_size) AS place FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT id, string_agg(CASE p_size {_genre_case()} ELSE 'Unknown' END, ', ' ORDER BY place) AS genre FROM lines WHERE place <= 3 GROUP BY 1""")
def _(spark, folder):
    lines = wh.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    sized = lines.join(wh.table(spark, folder, "part").select("p_partkey", "p_size"), "p_partkey")
    ids = sized.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_size"))).alias("v"))
    return ids.select("id", ingest.map_genre_ids(F.col("v.p_size")).alias("genre"))


@query("quality_filter", with_(CATALOGUE, """SELECT item_id, title, votes, round(rating, 6) AS rating FROM catalogue
  WHERE votes >= 5 AND rating >= 3 ORDER BY popularity DESC, item_id LIMIT 100 OFFSET 100"""))
def _(spark, folder):
    page = ingest.quality_filter(wh.catalogue(spark, folder), page=2, page_size=100)
    return page.select("item_id", "title", "votes", F.round("rating", 6).alias("rating"))


@query("quality_tiers", with_(CATALOGUE, """SELECT 'strict' AS tier, count(*) AS items FROM catalogue WHERE votes >= 5 AND rating >= 3
UNION ALL SELECT 'loose', count(*) FROM catalogue WHERE votes >= 1 AND rating >= 3
UNION ALL SELECT 'any', count(*) FROM catalogue WHERE votes >= 1 AND rating >= 0"""))
def _(spark, folder):
    return ingest.quality_tiers(wh.catalogue(spark, folder))


# Earlier enrichment results of an item: its casts and its most recent sale, known where it was ever returned.
ENRICHED = CASTS + """,
enriched AS (SELECT l_partkey AS item_id, bool_or(l_returnflag = 'R' AND l_discount > 0.08) AS ok, 'G' || min(l_linestatus) AS genre,
  min(l_returnflag) AS director, any_value(names) AS "cast", strftime(max(l_shipdate), '%Y') AS year
  FROM lineitem LEFT JOIN casts ON l_partkey = item_id GROUP BY 1)"""


def enriched(spark, folder):
    facts = wh.table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(
        F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08)).alias("ok"),
        F.concat(F.lit("G"), F.min("l_linestatus")).alias("genre"), F.min("l_returnflag").alias("director"),
        F.date_format(F.max("l_shipdate"), "yyyy").alias("year"),
    )
    return facts.join(wh.casts(spark, folder), "item_id", "left").withColumn("pos", F.col("item_id"))


def _base(spark, folder):
    return wh.catalogue(spark, folder).select("item_id", "title", "pos")


@query("overlay_existing", with_(ENRICHED, """SELECT p_partkey AS item_id, p_name AS title, genre, director, year, "cast"
  FROM part LEFT JOIN (SELECT * FROM enriched WHERE ok) ON p_partkey = item_id"""))
def _(spark, folder):
    return ingest.overlay_existing(_base(spark, folder), enriched(spark, folder).filter("ok")).drop("pos")


@query("needs_enrichment", with_(ENRICHED, """SELECT p_partkey AS item_id, p_name AS title FROM part LEFT JOIN
  (SELECT * FROM enriched WHERE ok) ON p_partkey = item_id WHERE genre IS NULL OR "cast" IS NULL"""))
def _(spark, folder):
    overlaid = ingest.overlay_existing(_base(spark, folder), enriched(spark, folder).filter("ok"))
    return ingest.needs_enrichment(overlaid).select("item_id", "title")


@query("apply_enrichment", with_(CATALOGUE, ENRICHED, """SELECT c.item_id, CASE WHEN e.ok THEN e.genre ELSE c.genre END AS genre,
  CASE WHEN e.ok THEN e.director ELSE c.director END AS director, CASE WHEN e.ok THEN e.year ELSE CAST(c.year AS VARCHAR) END AS year,
  CASE WHEN e.ok THEN e."cast" END AS "cast" FROM catalogue c LEFT JOIN enriched e USING (item_id)"""))
def _(spark, folder):
    items = wh.catalogue(spark, folder).withColumn("year", F.col("year").cast("string")).withColumn("cast", F.lit(None).cast("string"))
    results = enriched(spark, folder)
    retried = results.filter("item_id % 3 = 0").withColumns({"pos": F.col("pos") - 1e9, "ok": ~F.col("ok"), "genre": F.lit("earlier try")})
    return ingest.apply_enrichment(items, retried.unionByName(results)).select("item_id", "genre", "director", "year", "cast")


@query("append_dedupe", """SELECT p_partkey AS item_id, p_name AS title FROM part
UNION ALL SELECT doc_id, any_value(source) FROM documents WHERE doc_id NOT IN (SELECT p_partkey FROM part) GROUP BY 1
UNION ALL SELECT l_orderkey, 'order' FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT p_partkey FROM part)
  AND l_orderkey NOT IN (SELECT doc_id FROM documents)""")
def _(spark, folder):
    stored = _base(spark, folder).select("item_id", "title")
    docs = wh.text_catalogue(spark, folder).select("item_id", F.col("director").alias("title"), "pos")
    lines = wh.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.lit("order").alias("title"), F.col("l_linenumber").cast("bigint").alias("pos"))
    return ingest.append_dedupe(ingest.append_dedupe(stored, docs).drop("pos"), lines).select("item_id", "title")


@query("enrichment_report", with_(ENRICHED, """rows AS (SELECT ok, (row_number() OVER (ORDER BY item_id) - 1) // 100 + 1 AS batch FROM enriched),
batches AS (SELECT batch, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed FROM rows GROUP BY 1)""", """
SELECT batch, ok, failed, CAST(sum(ok) OVER (ORDER BY batch) AS BIGINT) AS total_ok,
  CAST((SELECT count(*) FROM enriched) - sum(ok + failed) OVER (ORDER BY batch) AS BIGINT) AS remaining FROM batches"""))
def _(spark, folder):
    return ingest.enrichment_report(enriched(spark, folder))


def _landed(spark, folder, name):
    schema = wh.table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


@query("resumable_ingest", "SELECT p_partkey AS item_id, p_name AS title FROM part")
def _(spark, folder):
    out = scratch_folder(spark)
    pages = _landed(spark, folder, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    for _ in range(2):  # the second run finds its offsets and adds nothing
        streams.run(pages, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/table")


@query("catalogue_delta_stream", "SELECT DISTINCT l_partkey AS item_id FROM lineitem")
def _(spark, folder):
    out = scratch_folder(spark)
    pages = _landed(spark, folder, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_orderkey").alias("pos"))
    streams.catalogue_delta_stream(pages, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/table").select("item_id")


@query("trace_append", """SELECT CAST(conv_id AS VARCHAR) AS trace_id, CASE role WHEN 'user' THEN 'request' WHEN 'assistant' THEN 'prediction'
  ELSE 'external_api' END AS type, text AS data, turn * 1.5 AS latency_ms FROM conversations""")
def _(spark, folder):
    path = scratch_folder(spark) + "/traces"
    entries = wh.traces(spark, folder).select(
        F.col("trace_id").cast("string").alias("trace_id"), "type", "data", (F.col("pos") * 0.0015).alias("seconds")
    )
    files.trace_append(entries, path)
    return files.read_traces(spark, path).select("trace_id", "type", "data", "latency_ms")


@query("csv_sink", with_(RATINGS, CATALOGUE, """SELECT user_id, r.item_id, round(r.rating, 6) AS rating, title || '; "' || director || '", ' || plot AS note
  FROM ratings r JOIN catalogue c ON r.item_id = c.item_id"""))
def _(spark, folder):
    """Every row as it comes back, with commas and quotes in its text."""
    path = scratch_folder(spark) + "/out"
    note = F.concat("title", F.lit('; "'), "director", F.lit('", '), "plot").alias("note")
    items = wh.catalogue(spark, folder).select("item_id", note)
    files.csv_sink(wh.ratings(spark, folder).join(items, "item_id").select("user_id", "item_id", "rating", "note"), path)
    back = files.read_csv(spark, path, ["user_id", "item_id", "rating"], {"user_id": "long", "item_id": "long", "rating": "double"})
    return back.withColumn("rating", F.round("rating", 6))


@query("feature_store_io", with_(CATALOGUE, "SELECT item_id, title, votes FROM catalogue"))
def _(spark, folder):
    """A second version is the one that is served; its rows come back from buckets of their key."""
    state = store.Store(spark, scratch_folder(spark))
    items = wh.catalogue(spark, folder).select("item_id", "title", "votes")
    state.save({"catalogue": (items.withColumn("votes", F.lit(-1).cast(items.schema["votes"].dataType)), "item_id")})
    state.save({"catalogue": (items, "item_id")})
    return state.load()["catalogue"]
