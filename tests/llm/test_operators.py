"""Operators against plain versions on the small driver tables and on planted cases."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import decontaminate, html_extract, jaccard_tiles, packing, sharding, substring_dedup, suffix_array, suffix_dedup
from kindred.llm.components import components
from kindred.llm.queries import QUERIES


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def planted(spark):
    """Near copies, chains of near copies, shared passages and repeated phrases."""
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "klmnprst" for b in ("a", "eo", "i", "uka", "esti")]
    word = lambda: rng.choice(vocabulary)
    passage = [word() for _ in range(70)]
    texts: dict[int, str] = {}
    for group in range(12):
        words = [word() for _ in range(rng.choice([20, 60, 150]))]
        for _ in range(rng.choice([1, 3, 12])):
            words = list(words)
            for _ in range(rng.choice([0, 1, 2])):
                words[rng.randrange(len(words))] = word()
            extra = passage if rng.random() < 0.3 else []
            texts[len(texts) * 3 + 1] = " ".join(words + extra) + rng.choice(["", "\n", "  "])
    texts[1000] = "ab " * 400
    texts[1001] = "ab " * 399
    return texts


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("source", ["texts", "planted"])
def test_window_dedup(spark, request, source):
    texts = request.getfixturevalue(source)
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.digest(frame(spark, texts)).collect()}
    assert got == substring_dedup.brute_force(texts)


@pytest.mark.parametrize("source,hot", [("texts", 20_000), ("planted", 20_000), ("planted", 1)])
def test_byte_dedup(spark, request, source, hot):
    texts = request.getfixturevalue(source)
    out = suffix_dedup.remove_earlier(frame(spark, texts), hot_segments=hot)
    got = {r.doc_id: tuple(r)[1:] for r in out.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()}
    assert got == suffix_dedup.brute_force(texts)


def test_byte_dedup_across_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 500)
    rng = random.Random(3)
    base = "".join(rng.choice("abcdef ") for _ in range(3000))
    texts = {1: base + base[400:900], 2: base[1000:2200], 3: "x" * 1500}
    rows = [{"doc_id": i, "text": t.encode()} for i, t in texts.items()]
    got = np.concatenate([suffix_dedup.segments(p, 100, 24)[4] - suffix_dedup.segments(p, 100, 24)[3] for _, _, p in suffix_dedup._pieces([r["text"] for r in rows], 100)])
    assert got.sum() == sum(len(t) - 99 for t in texts.values())


@pytest.mark.parametrize("limit", [0, 1024])
def test_suffix_array_and_common_prefixes(monkeypatch, limit):
    monkeypatch.setattr(suffix_array, "SMALL_ALPHABET", limit)
    rng = np.random.default_rng(1)
    for k in range(150):
        text = np.tile(rng.integers(1, 4, rng.integers(1, 4)), rng.integers(1, 15)) if k % 3 == 0 else rng.integers(1, rng.integers(2, 7), rng.integers(0, 60))
        text = np.append(text, 0)
        order = suffix_array.suffix_array(text)
        suffixes = [text[i:].tolist() for i in order]
        assert suffixes == sorted(suffixes)
        shared = [0] + [next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(suffixes, suffixes[1:], strict=False)]
        assert suffix_array.common_prefixes(text, order).tolist() == shared


@pytest.mark.parametrize("width,percent,tile,cell", [(3, 90, 4096, 512), (5, 80, 4096, 512), (3, 90, 2, 2), (2, 60, 3, 2)])
def test_jaccard_join(spark, planted, monkeypatch, width, percent, tile, cell):
    whole = jaccard_tiles.links
    monkeypatch.setattr(jaccard_tiles, "links", lambda d, w, p: whole(d, w, p, tile, cell))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_tiles.near_duplicates(frame(spark, planted), width, percent).collect()}
    assert got == jaccard_tiles.brute_force(planted, width, percent)


def test_jaccard_query(spark, folder, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_jaccard_join"](spark, folder).collect()}
    assert got == jaccard_tiles.brute_force(texts)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_benchmark_search(spark, folder, texts, monkeypatch, block_bytes):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()] + [(901, "of THE"), (902, None), (903, "the")]
    whole = decontaminate.benchmark_blocks
    monkeypatch.setattr(decontaminate, "benchmark_blocks", lambda b: whole(b, block_bytes))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in decontaminate.find_hits(frame(spark, texts), bench).collect()}
    assert got == decontaminate.brute_force(texts, items)


def test_packing_ids_and_padding(spark, folder, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}
    rows = QUERIES["op5_packing"](spark, folder).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in rows) == sorted((i, a, min(1024, len(x) - a)) for i, x in ids.items() for a in range(0, len(x), 1024))
    assert all(zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in rows)
    filled: dict = {}
    for r in rows:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 1024 and sum(1024 - n for n in filled.values()) < 0.03 * sum(filled.values())


def test_cut_texts_have_the_tokenizer_s_ids():
    encoder = packing.Encoder(packing.tokenizer_path())
    rng = random.Random(2)
    texts = ["a <|endoftext|>  b\n\n c's", "", " ", "x  y\n z's 12!!", " lead", "trail ", "\n x", "a\n\n b", "it's we'll \u00a0x \u2003y", "é \u0301 ²3 ½"]
    texts += ["".join(rng.choice(["a", "Bc", " ", " ", "\n", "'s", "1", "²", "é", "!", "\t", "\u00a0", "\u0301", "\x1c", "<|endoftext|>"]) for _ in range(30)) for _ in range(400)]
    assert encoder.encode(texts) == [encoder.whole(t) for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_plan_uses_every_piece_once(seed):
    counts = np.zeros(1025, np.int64)
    rng = np.random.default_rng(seed)
    np.add.at(counts, rng.integers(1, 1025, 3000), 1)
    used = np.zeros_like(counts)
    for pattern, repeat in packing.plan(counts):
        assert sum(pattern) <= 1024
        np.add.at(used, list(pattern), repeat)
    assert (used == counts).all()


def test_language_on_held_out_rows(spark, folder):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op7_language_id"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) and sum(r.rejected for r in rows) <= 0.02 * len(rows)


def _draw(key: int, name: str, weight: float) -> float:
    seed = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), 42)
    bits = xxhash.xxh64_intdigest(name.encode(), seed) >> 11
    return -np.log((bits + 0.5) / 2**53) / weight


def test_shards_follow_the_draws(spark, folder, texts):
    def place(key, tree):
        region = min(tree, key=lambda r: (_draw(key, r, sum(sum(x.values()) for x in tree[r].values())) if len(tree) > 1 else 0, r))
        racks = tree[region]
        rack = min(racks, key=lambda r: (_draw(key, r, sum(racks[r].values())) if len(racks) > 1 else 0, r))
        return min(racks[rack], key=lambda s: (_draw(key, f"shard{s}", racks[rack][s]) if len(racks[rack]) > 1 else 0, s))

    tree = sharding.balanced_tree(8)
    grown = sharding.grown_tree(tree)
    for r in QUERIES["op8_sharding"](spark, folder).collect():
        assert (r.shard, r.grown_shard) == (place(r.doc_id, tree), place(r.doc_id, grown))


def test_changed_weights_move_rows_in_their_subtree_only(spark):
    tree = sharding.balanced_tree(8)
    heavier = {**tree, "region0": {**tree["region0"], "rack0": {0: 1.5, 1: 0.5}}}
    rows = spark.range(3000).select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), heavier).alias("b")).collect()
    assert {(r.a, r.b) for r in rows if r.a != r.b} == {(1, 0)}


def test_pages_against_their_template(spark, folder):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in QUERIES["op10_html_extract"](spark, folder).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_decoding_has_no_contradictions():
    page = html_extract.parse("<div><div class=menu><p>x</p><p>y</p></div><div><p>long text</p></div></div>")
    score = np.array([0.5, 1, -5, 1, 1, 3, 2.0])
    assert html_extract.decode(page, score).tolist()[2:] == [False, False, False, True, True]


def test_pipeline_against_plain_stages(spark, folder, texts):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r.doc_id: r.text for r in corpus_pipeline.known_language(spark, docs, folder).collect()}
    assert len(kept) >= 0.98 * len(texts)
    groups: dict = {}
    for i, t in kept.items():
        groups.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).digest(), []).append((-len(t), i))
    kept = {min(g)[1]: texts[min(g)[1]] for g in groups.values()}
    kept = {i: kept[i] for i, (_, c) in jaccard_tiles.brute_force(kept, 5, 80).items() if c == i}
    kept = {i: kept[i] for i, (_, hit, _) in decontaminate.brute_force(kept, bench).items() if not hit}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == set(kept)
    assert all(name in QUERIES or name == "pipeline" for name in ("op1_substring_dedup", "op2_url_filter", "pipeline"))
