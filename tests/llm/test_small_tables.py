"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import decontaminate, exact_dedup, html_extract, jaccard_tiles, language_id, memory, packing, sharding, substring_dedup, suffix_dedup, url_reputation

LONG = " ".join(f"w{i % 97}x{i % 53}" for i in range(40_000))
TEXTS = [
    (1, "the cat sat on the mat and looked at the moon for a very long while"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, LONG),
    (7, "the cat sat on the mat and looked at the moon for a very long while "), (None, "a text without an id that nobody else has here"), (None, None),
    (8, "one"), (9, "one"), (9, "one"), (10, "ÄÖ été ñandú  ß\x0bvertical"), (11, "12 34 -- !!"), (12, "a b\u00a0c"),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _block int, key string, length long, `text_sha256` string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if t and i != 10 else None, None, None, 1, "x", 2, "y") for i, t in TEXTS]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "Cat SAT on the mat, and looked at the moon for"), (2, None), (3, "one"), (4, "")], "item_id long, text string")


OPERATORS = {
    "op1": lambda d, b: substring_dedup.digest(d), "op3": decontaminate.digest, "op4": lambda d, b: jaccard_tiles.digest(d), "op5": lambda d, b: packing.pack(d),
    "op6": lambda d, b: suffix_dedup.digest(d), "op7": lambda d, b: language_id.identify(d), "op8": lambda d, b: sharding.assign(d), "op9": lambda d, b: exact_dedup.deduplicate(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_is_answered(docs, nothing, bench, name):
    got = OPERATORS[name](docs, bench).collect()
    if name != "op5":
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in TEXTS)
    assert OPERATORS[name](nothing, bench).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_and_take_empty_tables(spark, docs, nothing, bench, tmp_path, name, stage):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert stage(spark, nothing, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_a_stage_gives_back_memory_whoever_calls_it(spark, docs, bench, tmp_path, monkeypatch, name, stage):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    calls = []
    monkeypatch.setattr(memory, "give_back", calls.append)
    stage(spark, docs.limit(3), str(tmp_path)).count()
    assert len(calls) >= (4 if name == "jaccard_join" else 1)  # there also before each search for components


def test_stage_decisions(spark, docs, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = lambda stage: sorted(str(r.doc_id) for r in stage(spark, docs, str(tmp_path)).collect())
    assert ids(corpus_pipeline.distinct_texts) == sorted(map(str, [4, 5, 7, None, 8, 10, 11, 12]))
    assert ids(corpus_pipeline.distinct_shingles) == sorted(map(str, [1, 2, 3, 4, 5, None, None, 8, 10, 11, 12]))
    assert ids(corpus_pipeline.without_benchmark) == sorted(map(str, [2, 3, 4, 5, 6, None, None, 10, 11, 12]))
    assert set(ids(corpus_pipeline.known_language)) <= set(map(str, [1, 5, 6, 7, None, 8, 9, 10, 12]))


def test_exact_groups(docs):
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(docs).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    # The longest of the empty texts stays.
    assert got[4, empty] == (4, 4, True) and got[3, empty] == (4, 4, False) and got[None, empty] == (4, 4, False)
    one = hashlib.sha256(b"one").hexdigest()
    assert got[8, one] == (8, 3, True) and got[9, one] == (8, 3, False)
    assert {v for (i, _), v in got.items() if i in (1, 7)} == {(7, 2, False), (7, 2, True)}


def test_spilling_changes_nothing(docs):
    def rows(limit):
        return sorted(map(str, exact_dedup.deduplicate(docs.unionByName(docs), limit).collect()))

    assert rows(1) == rows(64 << 20)


def test_components_with_ties(docs):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_tiles.digest(docs).collect()]
    assert got.count((9, 1, 8)) == 2 and (8, 1, 8) in got and (2, 0, 2) in got and (None, 0, None) in got
    assert {c for i, _, c in got if i in (1, 7)} == {1} and {c for i, _, c in got if i in (5, 6)} == {5}


def test_packing_covers_every_id(docs):
    encoder = packing.Encoder(packing.tokenizer_path())
    got = packing.pack(docs).collect()
    assert sum(r.length for r in got) == sum(len(ids) // 4 + 1 for ids in encoder.encode([t or "" for _, t in TEXTS]))
    filled: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 1024 and sorted(filled) == list(range(len(filled)))
    empty = [r for r in got if r.doc_id == 2]
    assert [(r.start, r.length, r.doc_tokens, r.ids_crc32) for r in empty] == [(0, 1, 1, zlib.crc32(b"\0\0\0\0"))]


def test_language_of_texts_without_letters(docs):
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert {got[i].lang_pred for i in (2, 3, 4, 11)} == {"und"} and got[1].lang_pred == "en" and 0 <= got[1].score <= 1


def test_urls_of_all_kinds(spark):
    urls = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://A.COM"), (5, "x://WWW.Example.com/en/a?b#c"), (6, "x://example.com/en/"), (7, "x://a.net/es/"),
            (8, "x://a.net#/es/"), (9, "x://notexample.com/en/"), (9, "x://notexample.com/en/"), (None, "x://a://b/c"), (10, "x://net/fr/é?q")]
    pages = spark.createDataFrame([(i, u, "z", "w") for i, u in urls], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([(1, 1), (9, None), (None, 1), (77, 1)], "page_id long, bad int")
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_reputation.filter_urls(pages, labels).collect())
    want = [("1", "", "", None), ("2", "", "", None), ("3", "", "", None), ("4", "a.com", "", None), ("5", "www.example.com", "/en/a", "www.example.com/en/"), ("6", "example.com", "/en/", "example.com/en/"),
            ("7", "a.net", "/es/", "net/es/"), ("8", "a.net", "", None), ("9", "notexample.com", "/en/", "com/"), ("9", "notexample.com", "/en/", "com/"), ("None", "a:", "//b/c", None), ("10", "net", "/fr/é", "net/fr/")]
    assert [g[:4] for g in got] == sorted(want, key=str)
    assert {g[4] for g in got if g[3]} == {"allow", "block"}
    assert url_reputation.filter_urls(pages.limit(0), labels).count() == 0 and url_reputation.filter_urls(pages, labels.limit(0)).count() == 12


@pytest.mark.parametrize("unseen", ["es", "fr"])
def test_texts_in_an_unseen_language_are_rejected(spark, folder, unseen):
    """The model calibrates on few rows here; it judges all texts, of which it has seen those of the other languages."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language_id.fit(docs.where(F.col("lang") != unseen))
    got = docs.select("doc_id", "lang").join(language_id.predict(docs, model), "doc_id").collect()
    new, known = [r.rejected for r in got if r.lang == unseen], [r.rejected for r in got if r.lang != unseen]
    assert sum(new) >= 0.95 * len(new) and sum(known) <= 0.02 * len(known)


def test_ranked_slices_choose_the_same_rows(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a', 'b') AS lang", "'word' AS text")
    for limit in (5, 1500):
        got = {(r.lang, r.key) for r in language_id.sample(docs, limit).collect()}
        order = docs.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect()
        assert got == {(r.lang, str(r.doc_id)) for lang in "ab" for r in [r for r in order if r.lang == lang][:limit]}


def plain_reputations(outcomes, hosts, z=url_reputation.Z):
    """Posterior bound of every host, level by level; names here have one-label suffixes and no ports."""
    cut = {h: (h.split(".")[-1], ".".join(h.split(".")[-2:]), h) for h in {h for h, _ in outcomes} | set(hosts)}
    means = {(): (sum(b for _, b in outcomes) + 0.5) / (len(outcomes) + 1)}
    shut = {(): 1.0}
    for level in (1, 2, 3):
        counts = {key[:level]: [0, 0] for key in cut.values()}
        for h, b in outcomes:
            counts[cut[h][:level]][0] += 1
            counts[cut[h][:level]][1] += b
        over = sum((b / n - means[k[:-1]]) ** 2 - means[k[:-1]] * (1 - means[k[:-1]]) / n for k, (n, b) in counts.items() if n > 1)
        span = sum(means[k[:-1]] * (1 - means[k[:-1]]) * (n - 1) / n for k, (n, b) in counts.items() if n > 1)
        s = 1 / max(min(over / span if span else 0.5, 0.5), 1 / 1001) - 1
        shut = {k: 1.0 if n else shut[k[:-1]] * s / (s + 1) for k, (n, _) in counts.items()}
        own = {k: s if n else shut[k] / (1 - shut[k]) for k, (n, _) in counts.items()}
        posterior = {k: (own[k] * means[k[:-1]] + b, own[k] * (1 - means[k[:-1]]) + n - b) for k, (n, b) in counts.items()}
        means = {k: a / (a + b) for k, (a, b) in posterior.items()}
    return {k[-1]: max(0.0, a / (a + b) - z * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5) for k, (a, b) in posterior.items()}


def test_hosts_without_labels_get_their_nearest_ancestor_s_posterior(spark):
    outcomes = [(f"s{k}.bad.org", 1) for k in range(8) for _ in range(10)] + [(f"s{k}.good.org", 0) for k in range(30) for _ in range(10)]
    bare = ["new.bad.org", "other.new.bad.org", "new.good.org", "new.unseen.org", "www.unseen.info"]
    urls = [(i, f"http://{h}/p") for i, h in enumerate([h for h, _ in outcomes] + bare)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(outcomes)], "page_id long, bad int")
    got = {r.host: (r.verdict, r.source) for r in url_reputation.filter_urls(pages, labels).collect()}
    bound = plain_reputations(outcomes, bare)
    assert got == {h: ("block", "host") if b > url_reputation.THRESHOLD else ("allow", "default") for h, b in bound.items()}
    assert {h for h in bare if got[h][0] == "block"} == {"new.bad.org", "other.new.bad.org"}
    rows = url_reputation.reputations(spark.createDataFrame(outcomes, "host string, bad int"), hosts=spark.createDataFrame([(h,) for h in bare], "host string"))
    assert {r.host: pytest.approx(r.bound) for r in rows.collect()} == bound


def test_one_bad_page_condemns_no_unknown_host(spark):
    pages = spark.createDataFrame([(1, "x://a.bad.org/"), (2, "x://b.bad.org/"), (3, "x://else.info/")], "page_id long, url string")
    got = url_reputation.filter_urls(pages, spark.createDataFrame([(1, 1)], "page_id long, bad int"))
    assert {r.verdict for r in got.collect() if r.host == "else.info"} == {"allow"}


def test_pages_of_all_kinds(spark):
    good = "<html><nav><a href=/x>Home</a></nav><div class=ad>Buy</div><article><h1>Title &amp; more</h1><p>First&nbsp;line<br>goes on.<p>Second &lt;b&gt;</article><footer>&copy; me</footer>"
    rows = [(1, "u", good), (2, None, None), (3, "", ""), (None, "u", "plain"), (4, "u", "<!-- only --><script>x</script>"), (5, "u", "<<p>>" * 50), (1, "u", good)]
    pages = spark.createDataFrame([(i, u, h, 3) for i, u, h in rows], "page_id long, url string, html string, n_chars int")
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages).collect()]
    assert len(got) == 7 and all(n == len(t) for _, t, n in got)
    assert {t for i, t, _ in got if i == 1} == {"Title & more\n\nFirst line goes on.\n\nSecond <b>"}
    assert {t for i, t, _ in got if i in (2, 3, 4)} == {""}
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_filter_fires_at_the_production_threshold(spark):
    """Bad, thin and unlabelled hosts: few bad pages among good neighbours are no proof, many are."""
    hosts = {"casino.spam.info": (12, 12), "pills.spam.info": (10, 9), "fresh.spam.info": (0, 0), "thin.shop.info": (1, 1), "a.shop.info": (20, 0), "b.shop.info": (20, 1),
             "fresh.shop.info": (0, 0), "mixed.news.info": (20, 2), "daily.news.info": (30, 0), "fresh.else.info": (0, 0), "bad.example.com": (10, 10), "ok.example.net": (10, 0)}
    rows = [(h, k < bad) for h, (n, bad) in hosts.items() for k in range(max(n, 1))]
    pages = spark.createDataFrame([(i, f"https://{h}/x/{i}") for i, (h, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(b)) for i, (h, b) in enumerate(rows) if hosts[h][0]], "page_id long, bad int")
    got = {r.host: (r.verdict, r.source) for r in url_reputation.filter_urls(pages, labels).collect()}
    assert {h for h, v in got.items() if v == ("block", "host")} == {"casino.spam.info", "pills.spam.info", "fresh.spam.info"}
    assert got["bad.example.com"] == ("allow", "rule") and got["thin.shop.info"] == got["fresh.shop.info"] == got["fresh.else.info"] == ("allow", "default")


PLAIN = "<p>The first paragraph says, at some length, what this article is about.</p>"
REST = "<p>The second paragraph goes on, and nothing of it may be lost.</p><p>A third one closes the article, as they do.</p>"
INSERTS = [
    '<svg class="icon"/>', '<svg class="icon"><title>Icon</title><path d="M0 0"/></svg>', "<svg><title/><use href='#a'/></svg>", "<svg viewBox='0 0 1 1'><path d='M0'>",
    "<svg><title>Open</svg>", "<button>", "<button>Share", "<button><p>Share</button>", "<noscript>", "<noscript><img src=a></noscript>", "<template>", "<select><option>One<option>Two",
    "<option>One", "<datalist id=a><option value=x><option value=y></datalist>", "<datalist id=a><option>", "<math/>", "<math>", "<script>var a = '<p>';</script>", "<style>p {}</style>", "<iframe src=a></iframe>",
]


@pytest.fixture(scope="module")
def page_model(spark, folder):
    return html_extract.train(spark.read.parquet(f"{folder}/pages.parquet"))


def extracted(spark, model, pages):
    rows = [(i, "u", f"<html><nav><a href=/x>Home</a></nav><article><h1>Title</h1>{page}</article><footer>me</footer></html>") for i, page in enumerate(pages)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model)
    return [r.text for r in got.orderBy("page_id").collect()]


def test_nothing_behind_a_small_element_is_lost(spark, page_model):
    want = ["The first paragraph says, at some length, what this article is about.", "The second paragraph goes on, and nothing of it may be lost.", "A third one closes the article, as they do."]
    for insert, text in zip(INSERTS, extracted(spark, page_model, [PLAIN + i + REST for i in INSERTS]), strict=True):
        assert "Title" in text and [w for w in want if w not in text] == [] and "Home" not in text and "var a" not in text, (insert, text)


def test_formulas_stay_and_controls_go(spark, page_model):
    formula = "<p>It follows, with care, that <math><mi>x</mi><mo>=</mo><mn>42</mn></math> holds.</p>"
    controls = "<button>Press</button><select><optgroup label=a><option>Red<option>Green</optgroup></select><template><p>Later</p></template><svg><text>Axis</text></svg>"
    got = extracted(spark, page_model, [PLAIN + formula + REST, PLAIN + controls + REST])
    assert "It follows, with care, that x=42 holds." in got[0]
    assert not [w for w in ("Press", "Red", "Green", "Later", "Axis") if w in got[1]] and "closes the article" in got[1], got[1]


def test_shards_are_numbered_without_gaps(docs):
    got = sharding.assign(docs).collect()
    slots: dict = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 2} == {(1, 0)}
    assert {r.size for r in docs.transform(sharding.assign).where(F.col("doc_id") == 10).collect()} == {len(TEXTS[12][1].encode()) + 1}


def test_pages_in_layouts_of_their_own(folder, spark):
    from probes import PAGES

    assert not {page for page, _ in html_extract.made_pages()} & {page for page, _ in PAGES.values()}
    rows = [(i, name, page) for i, (name, (page, _)) in enumerate(PAGES.items())]
    model = html_extract.train(spark.read.parquet(f"{folder}/pages.parquet"))
    got = {r.url: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert got == {name: text for name, (_, text) in PAGES.items()}


@pytest.mark.parametrize("part", ['<p a="', "<p data-a='x ", "<!", "<p a", "<svg><title>", "<p a=it's ", "</b", "<p a=\"x'"])
def test_a_megabyte_of_slips_is_read_in_one_pass(part):
    import time

    for end in ("", ">", ">\"'"):
        page = "<p>before</p>" + part * (1_000_000 // len(part)) + end
        start = time.time()
        tree = html_extract.parse(page)
        assert time.time() - start < 5 and "before" in "".join(t for _, t in tree.texts)


def test_training_rows_are_bounded_though_ids_repeat(spark):
    docs = spark.range(20_000).selectExpr("cast(1 as long) doc_id", "concat('text number ', id % 50) text", "'en' lang")
    assert len(language_id.sample(docs, 5).collect()) == 5
    pages = spark.range(3000).selectExpr("cast(1 as long) page_id", "'u' url", "concat('<article><p>', id, '</p></article>') html")
    seen = []
    original, html_extract.boost = html_extract.boost, lambda x, y: seen.append(len(y)) or original(x, y)
    try:
        html_extract.train(pages, 7)
        html_extract.train(pages, 9)
    finally:
        html_extract.boost = original
    assert seen[1] - seen[0] == 2 * 2 * 2  # two more pages of two nodes, each seen twice
