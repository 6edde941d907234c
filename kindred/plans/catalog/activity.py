"""Activity, profiles, watchlists, traces and their streaming forms."""

from pyspark.sql import functions as F

from kindred.operators import activity as act
from kindred.operators import incremental
from kindred.plans.catalog.registry import ACTIVITY, CATALOGUE, GENRES, ORACLES, RATINGS, best, query, user_based, with_
from kindred.session import scratch_folder
from kindred.sources import files
from kindred.sources import warehouse as wh
from kindred.streaming import funnel, streams

PREFERENCES = """tastes AS (SELECT user_id, name, count(*) AS n FROM ratings JOIN genres USING (item_id) GROUP BY 1, 2),
preferences AS (SELECT user_id, name FROM tastes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, name) <= 3)"""
MODEL = (RATINGS, CATALOGUE, GENRES, PREFERENCES)


def preferences(spark, folder):
    return act.preferences_from_ratings(wh.ratings(spark, folder), wh.catalogue(spark, folder))


def micros(df, *columns):
    return df.withColumns({c: F.unix_micros(c) for c in columns})


FEATURES = """counts AS (SELECT user_id, count(*) FILTER (WHERE action = 'view') AS view_count, count(*) FILTER (WHERE action = 'add_watchlist') AS save_count,
  count(*) FILTER (WHERE action = 'search') AS search_count, epoch_us(max(ts)) AS last_active_at FROM activity WHERE user_id IS NOT NULL GROUP BY 1),
favourites AS (SELECT user_id, string_agg(name, ',' ORDER BY name) AS favorite_genres, count(*) AS times FROM preferences GROUP BY 1)"""


def _features(df):
    return micros(df, "last_active_at").withColumn("favorite_genres", F.array_join("favorite_genres", ","))


@query("user_features", with_(ACTIVITY, *MODEL, FEATURES, """SELECT user_id, view_count, save_count, search_count, last_active_at, favorite_genres
  FROM counts LEFT JOIN favourites USING (user_id)"""))
def _(spark, folder):
    return _features(act.user_features(wh.activity(spark, folder), preferences(spark, folder)))


@query("user_features_fanout", with_(ACTIVITY, *MODEL, FEATURES, """SELECT user_id, view_count * coalesce(times, 1) AS view_count, save_count * coalesce(times, 1) AS save_count,
  search_count * coalesce(times, 1) AS search_count, last_active_at, favorite_genres FROM counts LEFT JOIN favourites USING (user_id)"""))
def _(spark, folder):
    return _features(act.user_features(wh.activity(spark, folder), preferences(spark, folder), fanout=True))


@query("refresh_user_features", with_(ACTIVITY, *MODEL, FEATURES, """SELECT user_id, view_count, save_count, search_count, last_active_at, favorite_genres
  FROM counts LEFT JOIN favourites USING (user_id)"""))
def _(spark, folder):
    path = scratch_folder(spark) + "/user_features"
    act.refresh_user_features(wh.activity(spark, folder), preferences(spark, folder), path)
    return _features(spark.read.parquet(path))


@query("user_features_deltas", ORACLES["refresh_user_features"])
def _(spark, folder):
    """The view after three deltas: events that are later taken back, the rest of the events, and what was wrong taken back."""
    events = wh.activity(spark, folder).select("event_id", "user_id", "action", "ts")
    wrong = events.filter("event_id % 5 = 0").withColumns({"event_id": -1 - F.col("event_id"), "ts": F.col("ts") + F.expr("INTERVAL 400 DAYS")})
    wrong = wrong.unionByName(events.filter("event_id % 7 = 0").withColumns({"event_id": -1 - F.col("event_id"), "action": F.lit("view")}))
    odd = F.col("event_id") % 2 == 1
    view = incremental.user_view(spark, scratch_folder(spark), most=2)
    incremental.apply_delta(view, 0, events.filter(odd).unionByName(wrong))
    for _ in range(2):  # a delta that is repeated changes nothing
        incremental.apply_delta(view, 1, events.filter(~odd | odd.isNull()))
    incremental.apply_delta(view, 2, events.limit(0), wrong, events)
    return _features(incremental.read_user_view(view, preferences(spark, folder)))


STATE = """states AS (SELECT user_id, item_id, arg_max(action, (ts, event_id)) FILTER (WHERE action IN ('add_watchlist', 'remove_watchlist')) AS state,
  max(ts) FILTER (WHERE action IN ('add_watchlist', 'remove_watchlist')) AS added_at, max(ts) FILTER (WHERE action = 'view') AS viewed_at
  FROM activity GROUP BY 1, 2),
watchlist AS (SELECT user_id, item_id, added_at, coalesce(viewed_at >= added_at, false) AS is_watched FROM states WHERE state = 'add_watchlist')"""


@query("watchlist_state", with_(ACTIVITY, STATE, "SELECT user_id, item_id, epoch_us(added_at) AS added_at, is_watched FROM watchlist"))
def _(spark, folder):
    return micros(act.watchlist_state(wh.activity(spark, folder)), "added_at")


@query("recent_watchlist", with_(ACTIVITY, STATE, """SELECT user_id, item_id, epoch_us(added_at) AS added_at,
  round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(added_at)) / 3600000000, 6) AS hours_since_added FROM watchlist
  WHERE added_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS"""))
def _(spark, folder):
    recent = act.recent_watchlist(act.watchlist_state(wh.activity(spark, folder)), "2024-01-31 00:00:00")
    return micros(recent, "added_at").withColumn("hours_since_added", F.round("hours_since_added", 6))


@query("watchlist_count", with_(ACTIVITY, STATE, "SELECT user_id, count(*) AS items FROM watchlist GROUP BY 1"))
def _(spark, folder):
    return act.watchlist_count(act.watchlist_state(wh.activity(spark, folder)))


@query("username_availability", """WITH wanted AS (SELECT lower(replace(s_name, '#', '_')) AS username FROM supplier UNION ALL SELECT upper(replace(c_name, '#', '_')) FROM customer
  UNION ALL SELECT p_brand FROM part UNION ALL SELECT substring(p_type, 1, 2) FROM part)
SELECT username, length(username) BETWEEN 3 AND 30 AND lower(username) NOT IN (SELECT lower(replace(c_name, '#', '_')) FROM customer) AS available FROM wanted""")
def _(spark, folder):
    part = wh.table(spark, folder, "part")
    wanted = wh.table(spark, folder, "supplier").select(F.lower(F.regexp_replace("s_name", "#", "_")).alias("username")).unionByName(
        wh.profiles(spark, folder).select(F.upper("username").alias("username"))
    ).unionByName(part.select(F.col("p_brand").alias("username"))).unionByName(part.select(F.substring("p_type", 1, 2).alias("username")))
    return act.username_availability(wanted, wh.profiles(spark, folder))


@query("constraint_report", with_(ACTIVITY, """names AS (SELECT CASE c_custkey % 9 WHEN 0 THEN 'x' WHEN 1 THEN c_name ELSE 'user_' || (c_custkey // 2) END AS name,
  repeat('b', CASE WHEN c_custkey % 4 = 0 THEN 501 ELSE 500 END) AS bio FROM customer)""", """
notes AS (SELECT source AS user_id, CASE WHEN doc_id % 10 = 0 THEN 'n' ELSE '' END || n_chars AS item_id, text FROM documents)""", """
acts AS (SELECT CASE WHEN event_id % 6 = 0 THEN '' ELSE action END AS action, CASE WHEN event_id % 8 = 0 THEN 'i-' || item_id ELSE CAST(item_id AS VARCHAR) END AS item_id FROM activity)""", """
SELECT 'username_length' AS rule, count(*) FILTER (WHERE length(name) NOT BETWEEN 3 AND 30) AS violations FROM names
UNION ALL SELECT 'username_format', count(*) FILTER (WHERE NOT regexp_full_match(name, '[a-zA-Z0-9_]+')) FROM names
UNION ALL SELECT 'bio_length', count(*) FILTER (WHERE length(bio) > 500) FROM names
UNION ALL SELECT 'item_id_format', count(*) FILTER (WHERE NOT regexp_full_match(item_id, '[0-9]+')) FROM notes
UNION ALL SELECT 'notes_length', count(*) FILTER (WHERE length(text) > 1000) FROM notes
UNION ALL SELECT 'action_not_empty', count(*) FILTER (WHERE action = '') FROM acts
UNION ALL SELECT 'activity_item_id_format', count(*) FILTER (WHERE NOT regexp_full_match(item_id, '[0-9]+')) FROM acts
UNION ALL SELECT 'username_unique', count(*) FROM (SELECT lower(name) FROM names GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'watchlist_unique', count(*) FROM (SELECT user_id FROM notes GROUP BY user_id, item_id HAVING count(*) > 1)"""))
def _(spark, folder):
    """Rows that break every rule."""
    key, event = F.col("c_custkey"), F.col("event_id")
    names = wh.table(spark, folder, "customer").select(
        F.when(key % 9 == 0, "x").when(key % 9 == 1, F.col("c_name")).otherwise(F.concat(F.lit("user_"), F.floor(key / 2).cast("string"))).alias("username"),
        F.repeat(F.lit("b"), F.when(key % 4 == 0, 501).otherwise(500)).alias("bio"),
    )
    notes = wh.table(spark, folder, "documents").select(
        F.col("source").alias("user_id"), F.concat(F.when(F.col("doc_id") % 10 == 0, "n").otherwise(""), F.col("n_chars").cast("string")).alias("item_id"), F.col("text").alias("notes"),
    )
    item = F.col("item_id").cast("string")
    acts = wh.activity(spark, folder).select(
        F.when(event % 6 == 0, "").otherwise(F.col("action")).alias("action"), F.when(event % 8 == 0, F.concat(F.lit("i-"), item)).otherwise(item).alias("item_id"),
    )
    return act.constraint_report(names, notes, acts)


@query("profile_defaults", """SELECT c_custkey AS user_id, CASE WHEN c_acctbal > 0 THEN c_name ELSE 'user_' || substring(CAST(c_custkey AS VARCHAR), 1, 8) END AS username,
  coalesce(CASE WHEN c_acctbal < 5000 THEN c_mktsegment END, c_name) AS display_name, 'en,hi' AS preferred_languages, false AS onboarding_completed FROM customer""")
def _(spark, folder):
    users = wh.table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), F.to_json(F.struct(
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("username"), F.when(F.col("c_acctbal") < 5000, F.col("c_mktsegment")).alias("full_name"),
        F.col("c_name").alias("name"))).alias("metadata"))
    return act.profile_defaults(users).select(
        "user_id", "username", "display_name", F.array_join("preferred_languages", ",").alias("preferred_languages"), "onboarding_completed"
    )


@query("profile_lookup", """SELECT user_id, '{"user_id":' || user_id || ',"username":"' || lower(replace(c_name, '#', '_')) || '"}' AS profile
  FROM (SELECT DISTINCT user_id FROM events) JOIN customer ON user_id = c_custkey""")
def _(spark, folder):
    seen = wh.activity(spark, folder).select("user_id").distinct()
    return act.profile_lookup(seen, wh.profiles(spark, folder).select("user_id", "username"))


@query("integrity_orphans", with_(*MODEL, """SELECT 'activity_without_user' AS finding, user_id FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'documents_without_user', doc_id FROM documents WHERE doc_id NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'orders_without_user', l_partkey FROM (SELECT DISTINCT l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'onboarded_without_preferences', c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT user_id FROM events)"""))
def _(spark, folder):
    users = wh.profiles(spark, folder)
    refs = {
        "activity": wh.activity(spark, folder), "documents": wh.table(spark, folder, "documents").select(F.col("doc_id").alias("user_id")),
        "orders": wh.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("user_id")),
    }
    return act.integrity_orphans(users, refs, users, wh.activity(spark, folder).select("user_id"))


@query("personalized_sections", with_(*MODEL, """topics AS (SELECT name AS topic, item_id, row_number() OVER (PARTITION BY name ORDER BY popularity DESC, item_id) AS rank
  FROM genres JOIN catalogue USING (item_id)),
langs AS (SELECT p_type AS topic, p_partkey AS item_id, row_number() OVER (PARTITION BY p_type ORDER BY coalesce(n_sold, 0) DESC, p_partkey) AS rank FROM part LEFT JOIN sold ON p_partkey = l_partkey)""", """
SELECT user_id, 'Recommended' AS section, topic, item_id, CAST(rank AS INTEGER) AS rank FROM preferences JOIN topics ON name = topic WHERE rank <= 10
UNION ALL SELECT user_id, 'Popular in', topic, item_id, CAST(rank AS INTEGER) FROM (SELECT DISTINCT user_id FROM preferences), langs WHERE topic IN ('ECONOMY', 'STANDARD') AND rank <= 10"""))
def _(spark, folder):
    items = wh.catalogue(spark, folder).withColumn("language", F.col("plot"))
    wishes = preferences(spark, folder).withColumn("preferred_languages", F.array(F.lit("ECONOMY"), F.lit("STANDARD")))
    return act.personalized_sections(wishes, items)


@query("preference_filter", with_(*MODEL, """SELECT user_id, item_id FROM ratings r JOIN catalogue c USING (item_id) WHERE plot IN ('ECONOMY', 'PROMO')
  AND NOT EXISTS (FROM preferences p JOIN genres g USING (name) WHERE p.user_id = r.user_id AND g.item_id = r.item_id) AND votes < 40"""))
def _(spark, folder):
    items = wh.catalogue(spark, folder).withColumn("language", F.col("plot")).withColumn("adult", F.col("votes") >= 40)
    wishes = preferences(spark, folder).select(
        "user_id", F.col("favorite_genres").alias("exclude_genres"), F.array(F.lit("ECONOMY"), F.lit("PROMO")).alias("preferred_languages"), F.lit(False).alias("show_adult")
    )
    return act.preference_filter(wh.ratings(spark, folder).select("user_id", "item_id"), wishes, items)


SESSIONS = """marked AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM activity),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM marked)"""


@query("session_funnel", with_(ACTIVITY, SESSIONS, """steps AS (SELECT user_id, min(ts) AS session_start, count(*) AS events, min(ts) FILTER (WHERE action = 'search') AS a,
  min(ts) FILTER (WHERE action = 'view') AS b, min(ts) FILTER (WHERE action = 'add_watchlist') AS c FROM numbered GROUP BY user_id, no)""", """
SELECT user_id, epoch_us(session_start) AS session_start, events, epoch_us(a) AS first_search, epoch_us(b) AS first_view, epoch_us(c) AS first_add_watchlist,
  CASE WHEN a IS NULL THEN 0 WHEN b IS NULL OR b < a THEN 1 WHEN c IS NULL OR c < b THEN 2 ELSE 3 END AS depth FROM steps"""))
def _(spark, folder):
    found = act.session_funnel(wh.activity(spark, folder), "6 hours").drop("session_end")
    return micros(found, "session_start", "first_search", "first_view", "first_add_watchlist")


def flushed(spark, folder):
    """The activity as a stream of files, with one event far in the future that closes all windows before it."""
    path = scratch_folder(spark) + "/landed"
    events = wh.activity(spark, folder)
    last = events.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast(events.schema["event_id"].dataType).alias("event_id"), F.lit(-1).cast(events.schema["user_id"].dataType).alias("user_id"),
        F.lit("view").alias("action"), (F.col("ts") + F.expr("interval 100 days")).alias("ts"),
    )
    events.unionByName(last, allowMissingColumns=True).write.parquet(path)
    return streams.read_folder(spark, path, spark.read.parquet(path).schema)


def appended(spark, stream):
    """What an append sink has got once the stream has read all its files."""
    out = scratch_folder(spark)
    streams.run(stream, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/table")


SESSION_ROWS = with_(ACTIVITY, SESSIONS, """SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL 6 HOURS) AS session_end, count(*) AS events
  FROM numbered GROUP BY user_id, no""")


@query("session_stream", SESSION_ROWS.replace("FROM numbered", "FROM numbered WHERE user_id IS NOT NULL"))
def _(spark, folder):
    return micros(appended(spark, streams.session_stream(flushed(spark, folder), "6 hours")), "session_start", "session_end")


@query("session_funnel_stream", ORACLES["session_funnel"])
def _(spark, folder):
    """The same rows as `session_funnel`, from an append sink: the state closes every session but that of the flushing event."""
    found = appended(spark, funnel.funnel_stream(flushed(spark, folder), "6 hours")).drop("session_end")
    return micros(found, "session_start", "first_search", "first_view", "first_add_watchlist")


@query("sessions", with_(ACTIVITY, SESSIONS, """SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL 6 HOURS) AS session_end, count(*) AS events
  FROM numbered GROUP BY user_id, no"""))
def _(spark, folder):
    return micros(act.sessions(wh.activity(spark, folder), "6 hours"), "session_start", "session_end")


TRACE_ROWS = "SELECT conv_id AS trace_id, turn AS pos, role, text AS data FROM conversations"
TRACE_SQL = f"""SELECT trace_id, arg_max(data, pos) FILTER (WHERE role = 'user') AS request, arg_max(data, pos) FILTER (WHERE role = 'assistant') AS prediction,
  count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) AS external_calls FROM ({TRACE_ROWS}) GROUP BY 1"""


@query("trace_audit", TRACE_SQL)
def _(spark, folder):
    return act.trace_audit(wh.traces(spark, folder))


@query("trace_external_calls", """SELECT user_id AS trace_id, event_id AS pos, event_type AS api, round(value * 1000, 2) AS latency_ms
FROM events WHERE event_type NOT IN ('signup', 'purchase')""")
def _(spark, folder):
    """All external calls of every trace in long form, from a log of events: sign-ups are requests, purchases predictions."""
    kind = F.when(F.col("event_type") == "signup", "request").when(F.col("event_type") == "purchase", "prediction").otherwise("external_api")
    log = wh.table(spark, folder, "events").select(
        F.col("user_id").alias("trace_id"), F.col("event_id").alias("pos"), kind.alias("type"), F.col("event_type").alias("api"), F.round(F.col("value") * 1000, 2).alias("latency_ms")
    )
    return act.external_calls(log).drop("type")


@query("trace_stream", TRACE_SQL)
def _(spark, folder):
    out = scratch_folder(spark)
    schema = wh.table(spark, folder, "conversations").schema
    landed = spark.readStream.schema(schema).option("pathGlobFilter", "conversations.parquet").parquet(folder)
    streams.trace_stream(wh.traces_of(landed), f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return streams.read_trace_records(spark, f"{out}/table")


@query("training_log_report", """SELECT event_type AS api, CASE WHEN value > 10 THEN 'slow' ELSE 'ok' END AS status, count(*) AS calls,
  round(avg(round(value * 1000, 2)), 4) AS mean_ms, round(max(round(value * 1000, 2)), 4) AS max_ms,
  round(quantile_cont(round(value * 1000, 2), 0.5), 4) AS p50_ms, round(quantile_cont(round(value * 1000, 2), 0.95), 4) AS p95_ms FROM events GROUP BY 1, 2""")
def _(spark, folder):
    path = scratch_folder(spark) + "/log"
    calls = wh.table(spark, folder, "events").select(
        F.lit("external_api").alias("type"), F.col("event_type").alias("api"), F.when(F.col("value") > 10, "slow").otherwise("ok").alias("status"),
        F.col("value").alias("seconds"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )
    files.trace_append(calls, path)
    report = act.api_report(files.read_traces(spark, path))
    return report.withColumns({c: F.round(c, 4) for c in ("mean_ms", "max_ms", "p50_ms", "p95_ms")})


@query("training_runs", """SELECT 'run_' || o_orderkey AS run_id, 'rmse' AS metric, o_totalprice AS value FROM orders""")
def _(spark, folder):
    path = scratch_folder(spark) + "/log"
    runs = wh.table(spark, folder, "orders").select(
        F.concat(F.lit("run_"), "o_orderkey").alias("run_id"), F.lit("training").alias("type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"),
        F.to_json(F.struct(F.col("o_totalprice").alias("rmse"))).alias("metrics"),
    )
    files.trace_append(runs, path)
    return act.training_report(files.read_traces(spark, path)).select("run_id", "metric", "value")


def landed_activity(spark, folder):
    schema = wh.table(spark, folder, "events").schema
    return wh.activity_of(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder))


def untidy_arrivals(spark, folder):
    """The activity in four files, a batch each: late ones after newer ones, every third event again, and events without an action."""
    path = scratch_folder(spark) + "/landed"
    events = wh.activity(spark, folder).drop("value")
    noon = F.expr("hour(ts) >= 12")
    wrong = events.filter("event_id % 7 = 0").withColumns({"event_id": -1 - F.col("event_id"), "action": F.lit(None).cast("string")})
    for part in (events.filter(noon), events.filter(~noon | noon.isNull()), events.filter("event_id % 3 = 0"), wrong):
        part.coalesce(1).write.mode("append").parquet(path)
    return streams.read_folder(spark, path, spark.read.parquet(path).schema, files=1)


@query("interaction_ingest", with_(ACTIVITY, "SELECT event_id, user_id, action, item_id, epoch_us(ts) AS ts FROM activity WHERE user_id IS NOT NULL"))
def _(spark, folder):
    out = scratch_folder(spark)
    streams.ingest_with_quarantine(untidy_arrivals(spark, folder), f"{out}/good", f"{out}/bad", f"{out}/checkpoint").awaitTermination()
    return micros(spark.read.parquet(f"{out}/good"), "ts").drop("value", "batch", "bucket", "day")


@query("interaction_quarantine", with_(ACTIVITY, "SELECT -1 - event_id AS event_id, user_id, item_id FROM activity WHERE event_id % 7 = 0"))
def _(spark, folder):
    out = scratch_folder(spark)
    streams.ingest_with_quarantine(untidy_arrivals(spark, folder), f"{out}/good", f"{out}/bad", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/bad").select("event_id", "user_id", "item_id")


COUNTED = """count(*) FILTER (WHERE action = 'view') AS view_count, count(*) FILTER (WHERE action = 'add_watchlist') AS save_count,
  count(*) FILTER (WHERE action = 'search') AS search_count"""


HOURLY = with_(ACTIVITY, f"""SELECT epoch_us(date_trunc('hour', ts)) AS window_start, epoch_us(date_trunc('hour', ts) + INTERVAL 1 HOUR) AS window_end, {COUNTED}
  FROM activity GROUP BY date_trunc('hour', ts)""")
SLIDING = with_(ACTIVITY, """slots AS (SELECT *, time_bucket(INTERVAL 30 MINUTES, ts) - x * INTERVAL 30 MINUTES AS s FROM activity, (VALUES (0), (1)) AS t(x))""", f"""
SELECT epoch_us(s) AS window_start, epoch_us(s + INTERVAL 1 HOUR) AS window_end, {COUNTED} FROM slots GROUP BY s""")


@query("activity_counts_windowed", HOURLY)
def _(spark, folder):
    return micros(appended(spark, streams.activity_counts_windowed(flushed(spark, folder))), "window_start", "window_end")


@query("activity_counts_sliding", SLIDING)
def _(spark, folder):
    return micros(appended(spark, streams.activity_counts_windowed(flushed(spark, folder), "1 hour", "30 minutes")), "window_start", "window_end")


@query("activity_counts", HOURLY)
def _(spark, folder):
    return micros(act.activity_counts(wh.activity(spark, folder)), "window_start", "window_end")


@query("trending_windowed", with_(ACTIVITY, """slots AS (SELECT item_id, time_bucket(INTERVAL 6 HOURS, ts) - x * INTERVAL 6 HOURS AS s FROM activity, (VALUES (0), (1), (2), (3)) AS t(x)),
counts AS (SELECT s, item_id, count(*) AS n FROM slots GROUP BY 1, 2)""", """
SELECT epoch_us(s) AS window_start, epoch_us(s + INTERVAL 24 HOURS) AS window_end, item_id, n,
  CAST(row_number() OVER (PARTITION BY s ORDER BY n DESC, item_id) AS INTEGER) AS rank FROM counts QUALIFY rank <= 10"""))
def _(spark, folder):
    out = scratch_folder(spark)
    streams.trending_windowed(landed_activity(spark, folder), f"{out}/counts", f"{out}/checkpoint").awaitTermination()
    return micros(streams.read_trending(spark, f"{out}/counts").drop("batch"), "window_start", "window_end")
