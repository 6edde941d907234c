"""Strings within an edit ratio of asked ones, found through an index of their q-grams."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.ranking import rank_by
from kindred.session import materialize

# Grams of one to so many characters are indexed; longer ones tell more, but close strings may share none of them.
LONGEST = 3
# Slack for ratios that are not exact in binary.
SLACK = 1e-9


def edit_ratio(query: Column, title: Column) -> Column:
    """1 - edit distance / longer length."""
    return 1 - F.levenshtein(query, title) / F.greatest(F.length(query), F.length(title))


def _grams(text: Column, width: Column) -> Column:
    """All substrings of that width, by position; none of a shorter text."""
    places = F.when(F.length(text) >= width, F.sequence(F.lit(1), F.length(text) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(text, i, width))


def gram_index(keys: DataFrame) -> DataFrame:
    """(key, size, gram, at): every gram of every key with its place."""
    widths = keys.select("key", F.length("key").alias("size"), F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("width"))
    return widths.select("key", "size", F.posexplode(_grams(F.col("key"), F.col("width"))).alias("at", "gram"))


def bounds(asked: DataFrame, sizes: DataFrame, cutoff: float) -> DataFrame:
    """(query, size, titles, edits, width, need): how a key of that size can reach the cutoff.

    At most `edits` edits are allowed. Each takes at most `width` of the longer string's grams, so `need` of them are in both, moved
    by at most `edits` places. The widest gram with a bound above 0 is taken; single characters always have one.
    """
    length = F.length("query")
    reach = F.sequence(F.ceil(length * cutoff - SLACK).cast("int"), F.floor(length / cutoff + SLACK).cast("int"))
    longer, edits = F.greatest(length, F.col("size")), F.floor(F.greatest(length, F.col("size")) * (1 - cutoff) + SLACK).cast("int")
    rows = asked.select("query", F.explode(reach).alias("size")).join(sizes, "size").withColumn("edits", edits)
    width = F.lit(1)
    for w in range(2, LONGEST + 1):
        width = F.when(longer - w + 1 - F.col("edits") * w > 0, F.lit(w)).otherwise(width)
    rows = rows.withColumn("width", width).withColumn("need", longer - F.col("width") + 1 - F.col("edits") * F.col("width"))
    return rows.filter(length - F.col("width") + 1 >= F.col("need"))


def candidates(asked: DataFrame, keys: DataFrame, index: DataFrame, cutoff: float) -> DataFrame:
    """(query, key, width, need): the pairs that may reach the cutoff, each once.

    Of a query's grams as many of the rarest are looked up as must contain one that is kept. Where these have more places than
    there are keys of that size, the keys are read instead, which is less.
    """
    sizes = keys.groupBy(F.length("key").alias("size")).agg(F.count(F.lit(1)).alias("titles"))
    known = index.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("places"))
    rows = bounds(asked, sizes, cutoff)
    own = rows.select("*", F.posexplode(_grams(F.col("query"), F.col("width"))).alias("place", "gram")).join(known, ["size", "gram"], "left")
    pair = Window.partitionBy("query", "size")
    ranked = own.withColumn("rank", F.row_number().over(pair.orderBy(F.coalesce("places", F.lit(0)), "place")))
    probes = ranked.filter(F.col("rank") <= F.length("query") - F.col("width") + 2 - F.col("need"))
    probes = probes.withColumn("cost", F.sum(F.coalesce("places", F.lit(0))).over(pair))
    met = probes.filter("cost < titles").join(index, ["size", "gram"]).filter(F.abs(F.col("at") - F.col("place")) <= F.col("edits"))
    read = probes.filter("cost >= titles and rank = 1").join(keys.withColumn("size", F.length("key")), "size")
    names = ["query", "key", "width", "need"]
    return met.select(*names).distinct().unionByName(read.select(*names))


def counted(pairs: DataFrame) -> DataFrame:
    """Pairs that share enough distinct grams. A distinct gram is lost only if all of its places are."""
    grams = {name: _grams(F.col(name), F.col("width")) for name in ("query", "key")}
    repeats = [F.size(g) - F.size(F.array_distinct(g)) for g in grams.values()]
    return pairs.filter(F.size(F.array_intersect(*grams.values())) >= F.col("need") - F.least(*repeats))


def similar(asked: DataFrame, keys: DataFrame, index: DataFrame, cutoff: float) -> DataFrame:
    """(query, key, score): every key whose edit ratio to the query reaches the cutoff."""
    near = counted(candidates(asked, keys, index, cutoff))
    return near.select("query", "key", edit_ratio(F.col("query"), F.col("key")).alias("score")).filter(F.col("score") >= cutoff)


def best_similar(asked: DataFrame, titles: DataFrame, without: DataFrame, n: int, cutoff: float, first_cutoff: float = 0.75) -> DataFrame:
    """(query, title, score, rank): the n most similar of the titles (title, key), but for those in `without` (query, title).

    A high cutoff is tried first, where grams tell most; only queries that find fewer than n there are asked again.
    """
    keys = materialize(titles.select("key").distinct())
    index = materialize(gram_index(keys))
    order = [F.round("score", 9).desc(), F.col("title").asc()]

    def listed(queries: DataFrame, level: float) -> DataFrame:
        found = similar(queries, keys, index, level).join(titles, "key").join(without.select("query", "title"), ["query", "title"], "left_anti")
        return rank_by(found.select("query", "title", "score"), n, ["query"], order)

    if first_cutoff <= cutoff:
        return listed(asked, cutoff)
    near = materialize(listed(asked, first_cutoff - SLACK))
    full = near.filter(F.col("rank") == n).select("query")
    rest = materialize(asked.join(full, "query", "left_anti"))
    return near.join(full, "query", "left_semi").unionByName(listed(rest, cutoff))
