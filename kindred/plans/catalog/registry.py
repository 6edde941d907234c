"""Names, callables and reference SQL of the registered queries."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.functions.text import ENGLISH_STOP_WORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def with_(*parts: str) -> str:
    """A WITH query of named parts; the last part is the final SELECT."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


RATINGS = """ratings AS (SELECT o_custkey AS user_id, l_partkey AS item_id, avg(l_quantity) / 5 AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""

CATALOGUE = """sold AS (SELECT l_partkey, count(*) AS n_sold FROM lineitem GROUP BY 1),
catalogue AS (SELECT p_partkey AS item_id, p_name AS title, replace(p_name, ' ', ', ') AS genre, p_brand AS director,
  p_size + 1970 AS year, (p_retailprice - 900) / 10 AS rating, coalesce(n_sold, 0) AS votes,
  coalesce(n_sold, 0)::DOUBLE AS popularity, p_type AS plot, p_partkey AS pos
  FROM part LEFT JOIN sold ON p_partkey = l_partkey)"""

CASTS = """casts AS (SELECT item_id, string_agg(s_name, ', ' ORDER BY s_name) AS names FROM (
  SELECT DISTINCT l_partkey AS item_id, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1)"""

GENRES = """genres AS (SELECT DISTINCT item_id, trim(g) AS name FROM (
  SELECT item_id, unnest(string_split(genre, ',')) AS g FROM catalogue) WHERE trim(g) NOT IN ('', 'Unknown', 'N/A'))"""

ACTIVITY = """activity AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'search'
  WHEN 'purchase' THEN 'add_watchlist' WHEN 'signup' THEN 'onboarding_complete' WHEN 'error' THEN 'remove_watchlist' END AS action,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, ts FROM events)"""

LIKED = "liked AS (SELECT user_id, item_id FROM ratings WHERE rating >= 7)"

# Text of the catalogue items as the features module joins it.
ITEM_TEXT = """texts AS (SELECT c.item_id, concat_ws(' ', plot, genre, director, coalesce(names, '')) AS body
  FROM catalogue c LEFT JOIN casts USING (item_id))"""
DOC_TEXT = "texts AS (SELECT doc_id AS item_id, text AS body FROM documents)"

_STOP = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)
TFIDF = rf"""words AS (SELECT item_id, unnest(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM texts),
tf AS (SELECT item_id, term, count(*) AS tf FROM words WHERE term NOT IN ({_STOP}) GROUP BY 1, 2),
vocabulary AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 1000),
raw AS (SELECT item_id, term, tf * (ln((1 + (SELECT count(*) FROM texts)) / (1 + df)) + 1) AS x FROM tf JOIN vocabulary USING (term)),
weights AS (SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS w FROM raw)"""


def best(source: str, n: int, partition: str, columns: str, tie: str = "item_id", first: str = "", digits: bool = True) -> str:
    """SELECT of the n best rows per partition by the shared ranking rule."""
    return (
        f"SELECT {columns}, {'round(score, 6) AS score' if digits else 'score'}, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {partition} ORDER BY {first}round(score, 9) DESC, {tie}) AS rank FROM {source}) WHERE rank <= {n}"
    )


USER_SIMS = """norms AS (SELECT user_id, sqrt(sum(rating * rating)) AS n FROM ratings GROUP BY 1),
dots AS (SELECT a.user_id AS t, b.user_id AS s, sum(a.rating * b.rating) AS dot
  FROM ratings a JOIN ratings b ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY 1, 2),
sims AS (SELECT t, s, dot / (x.n * y.n) AS sim FROM dots JOIN norms x ON t = x.user_id JOIN norms y ON s = y.user_id)"""

ITEM_SIMS = """norms AS (SELECT item_id, sqrt(sum(rating * rating)) AS n FROM ratings GROUP BY 1),
dots AS (SELECT a.item_id AS t, b.item_id AS s, sum(a.rating * b.rating) AS dot
  FROM ratings a JOIN ratings b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2),
sims AS (SELECT t, s, dot / (x.n * y.n) AS sim FROM dots JOIN norms x ON t = x.item_id JOIN norms y ON s = y.item_id)"""


def user_based(n: int, digits: bool = True) -> str:
    """Parts up to cf: the n best unrated items of every user by user-based prediction."""
    return USER_SIMS + f""",
near AS (SELECT t AS user_id, r.item_id, sim, r.rating FROM sims JOIN ratings r ON s = r.user_id
  QUALIFY row_number() OVER (PARTITION BY t, r.item_id ORDER BY round(sim, 9) DESC, s) <= 10),
predicted AS (SELECT user_id, item_id, sum(sim * rating) / sum(sim) AS score FROM near
  ANTI JOIN ratings USING (user_id, item_id) GROUP BY 1, 2),
cf AS ({best('predicted', n, 'user_id', 'user_id, item_id', digits=digits)})"""


def item_based(n: int) -> str:
    return ITEM_SIMS + f""",
near AS (SELECT r.user_id, t AS item_id, sim, r.rating FROM sims JOIN ratings r ON s = r.item_id
  QUALIFY row_number() OVER (PARTITION BY r.user_id, t ORDER BY round(sim, 9) DESC, s) <= 10),
predicted AS (SELECT user_id, item_id, sum(sim * rating) / sum(sim) AS score FROM near
  ANTI JOIN ratings USING (user_id, item_id) GROUP BY 1, 2),
cf AS ({best('predicted', n, 'user_id', 'user_id, item_id')})"""


def for_liked(n: int, digits: bool = True) -> str:
    """Parts up to cb: the n best items of every user by mean content similarity to the liked ones."""
    return LIKED + f""",
known AS (SELECT user_id, count(*) AS n_known FROM liked GROUP BY 1),
profile AS (SELECT user_id, term, sum(w) / any_value(n_known) AS w FROM liked JOIN weights USING (item_id) JOIN known USING (user_id) GROUP BY 1, 2),
fit AS (SELECT p.user_id, x.item_id, sum(p.w * x.w) AS score FROM profile p JOIN weights x USING (term) GROUP BY 1, 2),
fresh AS (SELECT * FROM fit ANTI JOIN liked USING (user_id, item_id)),
cb AS ({best('fresh', n, 'user_id', 'user_id, item_id', digits=digits)})"""
