"""Similar strings through q-grams, against all pairs."""

import random

import pytest

from kindred.operators import grams, search


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def ratio(a: str, b: str) -> float:
    return 1 - distance(a, b) / max(len(a), len(b))


def edited(rng, text: str, times: int) -> str:
    for _ in range(times):
        at = rng.randrange(len(text) + 1)
        text = text[:at] + rng.choice(["", rng.choice("abcdxyz")]) + text[at + rng.choice([0, 1]) :]
    return text or "a"


@pytest.fixture(scope="module")
def words():
    """Most titles share a length; some are near the queries, some repeat one character."""
    rng = random.Random(4)
    asked = ["".join(rng.choice("abcd") for _ in range(size)) for size in (2, 3, 5, 8, 13, 16)] + ["aaaaaaaa", "abababab"]
    titles = {"".join(rng.choice("abcdxyz") for _ in range(12)) for _ in range(300)} | {"a" * k for k in range(1, 12)}
    for q in asked:
        titles |= {edited(rng, q, k % 7) for k in range(30)}
    return asked, sorted(titles)


@pytest.mark.parametrize("cutoff", [0.34, 0.4, 0.6, 0.75, 0.8])
def test_all_similar_strings_are_found(spark, words, cutoff):
    asked, titles = words
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    keys = spark.createDataFrame([(t,) for t in titles], "key string")
    got = {(r["query"], r["key"]) for r in grams.similar(queries, keys, grams.gram_index(keys), cutoff).collect()}
    assert got == {(q, t) for q in asked for t in titles if ratio(q, t) >= cutoff}


def test_few_pairs_are_compared_where_titles_share_a_length(spark):
    rng = random.Random(5)
    titles = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)) for _ in range(2000)]
    queries = spark.createDataFrame([(edited(rng, t, 2),) for t in titles[:20]], "query string")
    keys = spark.createDataFrame([(t,) for t in titles], "key string")
    pairs = grams.candidates(queries, keys, grams.gram_index(keys), 0.75)
    assert pairs.count() < 20 * 2000 / 10
    assert grams.counted(pairs).count() < 200
    found = grams.similar(queries, keys, grams.gram_index(keys), 0.75).select("key").distinct().collect()
    assert {r["key"] for r in found} >= set(titles[:20])


def test_completions_equal_brute_force(spark, words):
    asked, titles = words
    items = spark.createDataFrame([(i, t.upper(), 2000, i) for i, t in enumerate(titles)], "item_id long, title string, year int, pos long")
    queries = spark.createDataFrame([(q,) for q in [*asked, "a", None, " "]], "query string")
    want = set()
    for q in asked:
        starts = [t for t in titles if t.startswith(q)]
        rest = sorted((t for t in titles if t not in starts and ratio(q, t) >= 0.4), key=lambda t: (-round(ratio(q, t), 9), t))
        want |= {(q, t.upper(), k + 1) for k, t in enumerate([*sorted(starts)[:10], *rest][:10])}
    got = {(r["query"], r["title"], r["rank"]) for r in search.autocomplete(queries, items).collect()}
    assert got == want


def test_no_titles_and_no_queries(spark):
    items = spark.createDataFrame([], "item_id long, title string, year int, pos long")
    queries = spark.createDataFrame([("abc",)], "query string")
    assert search.autocomplete(queries, items).count() == 0
    some = spark.createDataFrame([(1, "abc", 2000, 1), (2, None, 2000, 2), (3, "", 2000, 3)], "item_id long, title string, year int, pos long")
    assert search.autocomplete(queries.limit(0), some).count() == 0
    assert search.autocomplete(queries, some).count() == 1
