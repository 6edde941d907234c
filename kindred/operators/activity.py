"""User activity, watchlists, profiles, preferences and traces."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.percentiles import group_percentiles
from kindred.functions.ranking import rank_by
from kindred.functions.text import known_names

# Languages of a new user, name rules, text limits.
DEFAULT_LANGUAGES = ["en", "hi"]
USERNAME_PATTERN = "^[a-zA-Z0-9_]+$"
USERNAME_MIN, USERNAME_MAX, BIO_MAX, NOTES_MAX = 3, 30, 500, 1000
RATINGS_PER_TASK = 100_000  # below what a core has on small tables too, so a task stays as it is when tables grow


def preferences_from_ratings(ratings: DataFrame, items: DataFrame, n: int = 3) -> DataFrame:
    """(user_id, favorite_genres): each user's n most rated genres, ties by name.

    A user's genres are counted, ranked and listed where their ratings are sent, once, in as many parts as keep a task small.
    """
    names = items.select("item_id", known_names(F.col("genre")).alias("names"))
    parts = max(ratings.sparkSession.sparkContext.defaultParallelism, -(-ratings.count() // RATINGS_PER_TASK))
    sent = ratings.select("item_id", "user_id").join(names, "item_id").select("user_id", "names").repartition(parts, "user_id")
    counts = sent.select("user_id", F.explode("names").alias("name")).groupBy("user_id", "name").agg(F.count(F.lit(1)).alias("n"))
    best = rank_by(counts, n, ["user_id"], [F.col("n").desc(), F.col("name")])
    return best.groupBy("user_id").agg(F.array_sort(F.collect_list("name")).alias("favorite_genres"))


def action_counts() -> list[Column]:
    return [
        F.count_if(F.col("action") == "view").alias("view_count"),
        F.count_if(F.col("action") == "add_watchlist").alias("save_count"),
        F.count_if(F.col("action") == "search").alias("search_count"),
        F.max("ts").alias("last_active_at"),
    ]


def user_features(activity: DataFrame, preferences: DataFrame, fanout: bool = False) -> DataFrame:
    """Per user: favourite genres, action counts, last activity.

    ``fanout`` repeats every action once per favourite genre, as joining before counting does.
    """
    return with_favourites(activity.filter("user_id is not null").groupBy("user_id").agg(*action_counts()), preferences, fanout)


def with_favourites(counts: DataFrame, preferences: DataFrame, fanout: bool = False) -> DataFrame:
    """Per user counts with the favourite genres."""
    favourites = preferences.select("user_id", F.array_sort(F.array_distinct("favorite_genres")).alias("favorite_genres"),
                                    F.size("favorite_genres").alias("times"))
    joined = counts.join(favourites, "user_id", "left")
    if fanout:
        times = F.greatest(F.coalesce("times", F.lit(1)), F.lit(1))
        joined = joined.withColumns({c: F.col(c) * times for c in ("view_count", "save_count", "search_count")})
    return joined.drop("times")


def refresh_user_features(activity: DataFrame, preferences: DataFrame, path: str) -> None:
    """Rebuild the stored view."""
    user_features(activity, preferences).write.mode("overwrite").parquet(path)


def recent_watchlist(watchlist: DataFrame, as_of: str | Column, days: int = 7) -> DataFrame:
    """Rows added in the last days before ``as_of`` with the hours since, newest first."""
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    hours = (F.unix_micros(now) - F.unix_micros("added_at")) / 3_600_000_000
    return watchlist.filter((F.col("added_at") >= now - F.expr(f"INTERVAL {days} DAYS"))).select(
        "user_id", "item_id", "added_at", hours.alias("hours_since_added")
    ).orderBy(F.col("added_at").desc(), "user_id", "item_id")


def watchlist_count(watchlist: DataFrame) -> DataFrame:
    return watchlist.groupBy("user_id").agg(F.count(F.lit(1)).alias("items"))


def watchlist_state(activity: DataFrame) -> DataFrame:
    """(user_id, item_id, added_at, is_watched): pairs whose last watchlist action is an add.

    An item counts as watched when it was viewed at or after it was added.
    """
    listed = F.col("action").isin("add_watchlist", "remove_watchlist")
    at = F.struct("ts", "event_id")
    last = activity.filter("user_id is not null and item_id is not null").groupBy("user_id", "item_id").agg(
        F.max_by("action", F.when(listed, at)).alias("state"), F.max(F.when(listed, F.col("ts"))).alias("added_at"),
        F.max(F.when(F.col("action") == "view", F.col("ts"))).alias("viewed_at"),
    )
    return last.filter("state = 'add_watchlist'").select(
        "user_id", "item_id", "added_at", F.coalesce(F.col("viewed_at") >= F.col("added_at"), F.lit(False)).alias("is_watched")
    )


def username_availability(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """(username, available): false for NULL, a bad length or a name taken in any case."""
    taken = profiles.select(F.lower("username").alias("key")).distinct().withColumn("taken", F.lit(True))
    length_ok = F.length("username").between(USERNAME_MIN, USERNAME_MAX)
    return candidates.select("username", F.lower("username").alias("key")).join(taken, "key", "left").select(
        "username", F.coalesce(length_ok & F.col("taken").isNull(), F.lit(False)).alias("available")
    )


def rule_violations(rules: dict[str, Column]) -> list[Column]:
    """Counts of rows that break a rule; NULL passes, as in a SQL check."""
    return [F.count_if(~F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()]


def constraint_report(profiles: DataFrame, watchlist: DataFrame, activity: DataFrame) -> DataFrame:
    """(rule, violations) over the three tables."""
    item_id = F.col("item_id").cast("string").rlike(r"^\d+$")
    checks = [
        (profiles, {
            "username_length": F.length("username").between(USERNAME_MIN, USERNAME_MAX),
            "username_format": F.col("username").rlike(USERNAME_PATTERN),
            "bio_length": F.length("bio") <= BIO_MAX,
        }),
        (watchlist, {"item_id_format": item_id, "notes_length": F.length("notes") <= NOTES_MAX}),
        (activity, {"action_not_empty": F.length("action") > 0, "activity_item_id_format": item_id}),
    ]
    report = None
    for table, rules in checks:
        part = table.agg(*rule_violations(rules)).unpivot([], list(rules), "rule", "violations")
        report = part if report is None else report.unionByName(part)
    for name, table, keys in (
        ("username_unique", profiles.withColumn("key", F.lower("username")), ["key"]),
        ("watchlist_unique", watchlist, ["user_id", "item_id"]),
    ):
        twice = table.groupBy(*keys).count().filter("count > 1").agg(F.count(F.lit(1)).alias("violations"))
        report = report.unionByName(twice.select(F.lit(name).alias("rule"), "violations"))
    return report


def profile_defaults(users: DataFrame) -> DataFrame:
    """Profile and preference defaults of new users (user_id, metadata as JSON)."""
    def meta(name: str) -> Column:
        return F.get_json_object("metadata", f"$.{name}")

    fallback = F.concat(F.lit("user_"), F.substring(F.col("user_id").cast("string"), 1, 8))
    return users.select(
        "user_id", F.coalesce(meta("username"), fallback).alias("username"),
        F.coalesce(meta("full_name"), meta("name")).alias("display_name"), meta("avatar_url").alias("avatar_url"),
        F.lit(False).alias("onboarding_completed"),
        F.array(*[F.lit(x) for x in DEFAULT_LANGUAGES]).alias("preferred_languages"),
        F.array().cast("array<string>").alias("favorite_genres"), F.array().cast("array<string>").alias("exclude_genres"),
        F.lit(False).alias("show_adult"),
    )


def profile_lookup(targets: DataFrame, profiles: DataFrame) -> DataFrame:
    """(user_id, profile): the profile as JSON."""
    return targets.select("user_id").join(
        profiles.select("user_id", F.to_json(F.struct(*profiles.columns)).alias("profile")), "user_id"
    )


def integrity_orphans(users: DataFrame, references: dict[str, DataFrame], profiles: DataFrame, preferences: DataFrame) -> DataFrame:
    """(finding, user_id): references to unknown users, and onboarded profiles without preferences."""
    known = users.select("user_id").distinct()
    findings = None
    for name, table in references.items():
        lost = table.filter("user_id is not null").select("user_id").distinct().join(known, "user_id", "left_anti")
        part = lost.select(F.lit(f"{name}_without_user").alias("finding"), "user_id")
        findings = part if findings is None else findings.unionByName(part)
    bare = profiles.filter("onboarding_completed").join(preferences.select("user_id"), "user_id", "left_anti")
    return findings.unionByName(bare.select(F.lit("onboarded_without_preferences").alias("finding"), "user_id"))


def personalized_sections(preferences: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The most popular items per preferred language and favourite genre of each user.

    (user_id, section, topic, item_id, rank). The lists depend on the topic only, so they are ranked once
    per topic and then handed to the users who want it.
    """
    order = [F.col("popularity").desc(), F.col("item_id")]
    by_genre = items.select(F.explode(known_names(F.col("genre"))).alias("topic"), "item_id", "popularity")
    sections = [("Recommended", "favorite_genres", by_genre)]
    if "language" in items.columns and "preferred_languages" in preferences.columns:
        sections.append(("Popular in", "preferred_languages", items.select(F.col("language").alias("topic"), "item_id", "popularity")))
    union = None
    for section, wish, topics in sections:
        best = rank_by(topics.filter("topic is not null"), n, ["topic"], order)
        wishes = preferences.select("user_id", F.explode(F.array_distinct(wish)).alias("topic"))
        part = wishes.join(best, "topic").select("user_id", F.lit(section).alias("section"), "topic", "item_id", "rank")
        union = part if union is None else union.unionByName(part)
    return union


def preference_filter(candidates: DataFrame, preferences: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates (user_id, item_id, ...) that the user's exclusions, languages and adult flag allow."""
    fields = [known_names(F.col("genre")).alias("names")]
    fields.append(F.col("language") if "language" in items.columns else F.lit(None).cast("string").alias("language"))
    fields.append(F.coalesce("adult", F.lit(False)).alias("adult") if "adult" in items.columns else F.lit(False).alias("adult"))
    wishes = preferences.select("user_id", *[F.col(c) for c in ("exclude_genres", "preferred_languages", "show_adult")
                                             if c in preferences.columns])
    joined = candidates.join(items.select("item_id", *fields), "item_id").join(wishes, "user_id", "left")
    if "exclude_genres" in wishes.columns:
        joined = joined.filter(~F.coalesce(F.arrays_overlap("names", "exclude_genres"), F.lit(False)))
    if "preferred_languages" in wishes.columns:
        free = F.col("language").isNull() | (F.coalesce(F.size("preferred_languages"), F.lit(0)) <= 0)
        joined = joined.filter(free | F.array_contains("preferred_languages", F.col("language")))
    if "show_adult" in wishes.columns:
        joined = joined.filter(F.coalesce("show_adult", F.lit(False)) | ~F.col("adult"))
    return joined.select(*candidates.columns)


# The steps of the funnel in order.
FUNNEL = ("search", "view", "add_watchlist")


def session_table(activity: DataFrame, gap: str = "30 minutes", extra: Sequence[Column] = (), merge: Sequence[Column] = ()) -> DataFrame:
    """(user_id, session_start, session_end, events, ...) from gaps between a user's events, in three steps.

    Events of a user in one cell of half a gap belong together without a look at any other, so they are summed up to one piece
    before they are sent. Pieces join over a day and the results over the user's time line. What meets in a task
    grows with the time that a user was active, never with the number of events. ``extra`` aggregates a piece and ``merge``
    combines those columns over pieces.
    """
    length = F.expr(f"INTERVAL {gap}")
    micros = F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {gap}) - unix_micros(timestamp_seconds(0))")
    cell = F.floor(F.unix_micros("ts") / F.greatest(F.lit(1), F.floor(micros / 2)))
    known = activity.filter("user_id is not null and ts is not null")
    cells = known.groupBy("user_id", cell.alias("cell")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"), *extra
    ).drop("cell").withColumn("day", F.to_date("first_ts"))

    def joined(df: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("first_ts")
        fresh = F.coalesce(F.col("first_ts") > F.lag("last_ts").over(order) + length, F.lit(True)).cast("int")
        return df.withColumn("fresh", fresh).withColumn("piece", F.sum("fresh").over(order)).groupBy(*keys, "piece").agg(
            F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("events").alias("events"), *merge
        ).drop("piece")

    found = joined(joined(cells, ["user_id", "day"]), ["user_id"])
    return found.withColumn("last_ts", F.col("last_ts") + length).withColumnsRenamed({"first_ts": "session_start", "last_ts": "session_end"})


def sessions(activity: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, session_start, session_end, events); the end is the last event plus the gap."""
    return session_table(activity, gap)


def session_funnel(activity: DataFrame, gap: str = "30 minutes", steps: Sequence[str] = FUNNEL) -> DataFrame:
    """Per session the first time of each step and how many steps were taken in order.

    Uses ``session_id`` where the log has one, else sessions from gaps.
    """
    firsts = [F.min(F.when(F.col("action") == s, F.col("ts"))).alias(f"first_{s}") for s in steps]
    if "session_id" in activity.columns:
        grouped = activity.filter("user_id is not null").groupBy("user_id", "session_id").agg(
            F.count(F.lit(1)).alias("events"), *firsts
        )
    else:
        grouped = session_table(activity, gap, firsts, [F.min(f"first_{s}").alias(f"first_{s}") for s in steps])
    return funnel_depth(grouped, steps)


def funnel_depth(sessions_: DataFrame, steps: Sequence[str] = FUNNEL) -> DataFrame:
    """Adds how many of the steps were taken in order, from their first times."""
    depth, reached = F.lit(0), F.lit(True)
    for at, step in enumerate(steps):
        here = F.col(f"first_{step}").isNotNull()
        if at:
            here = here & (F.col(f"first_{step}") >= F.col(f"first_{steps[at - 1]}"))
        reached = reached & here
        depth = depth + F.coalesce(reached, F.lit(False)).cast("int")
    return sessions_.withColumn("depth", depth)


def trace_audit(traces: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """One record per trace: the latest request, the latest prediction and the number of external calls.

    With ``targets`` (trace_id) an unknown trace gives an empty record.
    """
    def latest(kind: str) -> Column:
        return F.max_by("data", F.when(F.col("type") == kind, F.col("pos")))

    records = traces.groupBy("trace_id").agg(
        latest("request").alias("request"), latest("prediction").alias("prediction"),
        F.count_if(F.col("type") == "external_api").alias("external_calls"),
    )
    if targets is None:
        return records
    return targets.select("trace_id").distinct().join(records, "trace_id", "left").na.fill(0, ["external_calls"])


def external_calls(traces: DataFrame) -> DataFrame:
    """All external calls in long form, keyed by trace: a busy trace never becomes one row."""
    return traces.filter("type = 'external_api'")


def api_report(entries: DataFrame) -> DataFrame:
    """(api, status, calls, mean_ms, max_ms, p50_ms, p95_ms) over the external_api entries.

    The percentiles are exact and interpolated (functions/percentiles.py).
    """
    calls = entries.filter("type = 'external_api'").select(F.struct("api", "status").alias("group"), F.col("latency_ms").alias("value"))
    means = calls.groupBy("group").agg(F.count(F.lit(1)).alias("calls"), F.avg("value").alias("mean_ms"), F.max("value").alias("max_ms"))
    shares = group_percentiles(calls, [0.5, 0.95]).groupBy("group").agg(
        F.max(F.when(F.col("share") == 0.5, F.col("value"))).alias("p50_ms"), F.max(F.when(F.col("share") == 0.95, F.col("value"))).alias("p95_ms")
    )
    return means.join(shares, "group", "left").select("group.api", "group.status", "calls", "mean_ms", "max_ms", "p50_ms", "p95_ms")


def training_report(entries: DataFrame) -> DataFrame:
    """(run_id, timestamp, metric, value) in long form from the training entries."""
    metrics = F.from_json("metrics", "map<string,string>")
    return entries.filter("type = 'training'").select("run_id", "timestamp", F.explode(metrics).alias("metric", "text")).select(
        "run_id", "timestamp", "metric", F.col("text").try_cast("double").alias("value")
    )


def activity_counts(activity: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, window_end, view_count, save_count, search_count) over event time; batch or stream."""
    counts = action_counts()[:3]
    return activity.filter("user_id is not null").groupBy(F.window("ts", width, slide or width).alias("w")).agg(*counts).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "view_count", "save_count", "search_count"
    )


def item_counts(activity: DataFrame, width: str, slide: str) -> DataFrame:
    return activity.filter("item_id is not null").groupBy(F.window("ts", width, slide).alias("w"), "item_id").agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "item_id", "n")


def trending(activity: DataFrame, width: str = "1 day", slide: str = "6 hours", n: int = 10) -> DataFrame:
    """The n most used items of every sliding window."""
    return rank_by(item_counts(activity, width, slide), n, ["window_start"], [F.col("n").desc(), F.col("item_id")])


def clean_events(activity: DataFrame) -> DataFrame:
    """Interaction events with a user, an action and a time, once per event id (batch form).

    Rows of one event are copies, so any of them may stay and copies collapse before the shuffle.
    """
    return activity.filter("user_id is not null and action is not null and ts is not null").dropDuplicates(["event_id"])
