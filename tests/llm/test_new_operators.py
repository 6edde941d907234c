"""Piece encoding, prefix trie and periodic runs against the library and plain versions."""

import hashlib
import random
import zlib

import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2, sentencepiece_pb2

from kindred.llm import periodic_runs, piece_encoding, prefix_trie
from kindred.llm.queries import QUERIES

TEXTS = {
    1: None, 2: "", 3: " \t\n ", 4: "one word", 5: "la " * 500, 6: "a b c " * 40 + "x y z", 7: "x y " * 3, 8: "café 日本語 \U0001d4b3 ▁ ① <s> <0x0A>\0",
    9: "long " * 30_000, 10: "unbroken" * 5000, 11: "p q r s p q r s p q r s p q r s t " * 9, 12: " two  spaces ", 13: "tab\tand\nline\n\n",
}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def frame(spark, texts):
    return spark.createDataFrame([(i, t, i) for i, t in texts], "doc_id long, text string, n_words long")


@pytest.fixture(scope="module")
def model():
    with open(piece_encoding.model_path(), "rb") as file:
        return file.read()


def random_texts(n):
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "ﬁ", "①", "▁", "日本", "\0", "<s>", "0", "12", "…", "　", "ﾊﾟ", "x" * 70, " " * 40, "é", "​", "\U0001d4b3"]
    return ["", "a", " ", "\n", "▁", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(n))]


def check_pieces(data: bytes, texts: list[str]):
    pieces = piece_encoding.Pieces(data)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    for text, (ids, starts, ends) in zip(texts, pieces.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), text[:100]
        parsed = sentencepiece_pb2.SentencePieceText()
        parsed.ParseFromString(library.encode(text, out_type="serialized_proto"))
        assert list(zip(starts.tolist(), ends.tolist(), strict=True))[1:-1] == [(p.begin, p.end) for p in parsed.pieces], text[:100]


def test_pieces_and_spans_are_the_library_s(model):
    check_pieces(model, random_texts(800) + [t or "" for t in TEXTS.values()])


@pytest.mark.parametrize("squeeze", [False, True])
def test_longest_prefix_through_a_compiled_map(model, squeeze):
    own = sentencepiece_model_pb2.ModelProto()
    own.ParseFromString(model)
    rules = sentencepiece_model_pb2.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    own.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    own.normalizer_spec.remove_extra_whitespaces = squeeze
    check_pieces(own.SerializeToString(), random_texts(400))


def test_small_unit_cache_and_rows_of_pieces_change_nothing(model, monkeypatch):
    monkeypatch.setattr(piece_encoding, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(piece_encoding, "LONGEST_ROW", 4)
    monkeypatch.setattr(piece_encoding, "LONGEST_CACHED", 4)
    monkeypatch.setattr(piece_encoding, "CELLS_AT_ONCE", 8)
    check_pieces(model, random_texts(200))


def test_op11_on_whole_documents_and_odd_rows(spark, folder, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(frame(spark, TEXTS.items()).select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = piece_encoding.digest(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        want = len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(library.decode(ids).encode())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_spans_give_back_the_text(spark):
    docs = frame(spark, [*TEXTS.items(), (None, "no id"), (4, "one word")])
    rows = piece_encoding.encode(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        data = ("no id" if r.doc_id is None else TEXTS[r.doc_id] or "").encode()
        assert b"".join(data[a:b] for a, b in zip(r.starts, r.ends, strict=True)) == data
        assert r.decoded.encode() == data.replace("▁".encode(), b" ")
    assert piece_encoding.digest(docs.where("false")).collect() == []


def test_op13_against_brute_force(spark, folder):
    rng, texts = random.Random(7), {}
    for i in range(400):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 6))]
            parts += unit * rng.randrange(1, 8) + unit[: rng.randrange(len(unit) + 1)]
        texts[1000 + i] = " ".join(parts)
    texts |= {k: v for k, v in TEXTS.items() if k != 9}
    texts |= {10**6 + r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r.text and len(r.text) < 20_000}
    rows = periodic_runs.digest(frame(spark, texts.items())).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r) == periodic_runs.brute_force(r.doc_id, texts[r.doc_id]), r.doc_id
    assert sum(r.n_runs for r in rows) > 500


def test_runs_of_long_repeated_and_odd_texts(spark):
    tail = [0]
    for _ in range(12):
        tail += [1 - v for v in tail]
    texts = [(3, "a " * 300_000), (5, " ".join(f"w{k % 5000}" for k in range(60_000))), (7, " ".join("ab"[v] for v in tail)), (None, "z " * 9), (None, "z " * 9), (8, None)]
    assert zlib.crc32(b"3") % 10 and zlib.crc32(b"5") % 10 and zlib.crc32(b"7") % 10
    rows = periodic_runs.find(frame(spark, texts), periodic_runs.rewritten).collect()
    runs = {r.doc_id: [tuple(x) for x in r.runs] for r in rows}
    assert runs == {3: [(0, 300_000, 1)], 5: [(0, 60_000, 5000)], 7: [], None: [(0, 9, 1)], 8: []}
    assert [r.collapsed for r in rows if r.doc_id is None] == [b"z", b"z"]
    assert periodic_runs.digest(frame(spark, texts).where("false")).collect() == []


def test_segments_whose_hashes_collide_are_scanned_plainly(monkeypatch):
    monkeypatch.setattr(periodic_runs.Scan, "same", lambda self, i, lag, length: length >= 0)
    import numpy as np

    words = np.array([1, 2, 3] * 5 + [4, 1, 4, 2, 5], np.int64)
    assert periodic_runs.Scan(words).runs() == [(0, 15, 3)]


def plain_trie(rows):
    """The nodes of the rebuilt conversations, from every prefix of each."""
    own: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))

    def order(x):
        return *x[:3], xxhash.xxh64_intdigest(x[3].encode(), xxhash.xxh64_intdigest(x[2].encode(), 42)) >> 1

    own = {c: [x[2:] for x in sorted(turns, key=order)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members: dict = {}
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members.setdefault(tuple(whole[c][:d]), []).append(c)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        children = [k for k in out if len(k) == len(node) + 1 and k[:-1] == node]
        convs = members[node]
        saved = (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
        leaves = sum(out[k][5] for k in children) if children else 1
        ends = ",".join(str(c) for c in convs if len(whole[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out[node] = (convs[0], len(node), parent, len(convs), len(children), leaves, saved + sum(out[k][6] for k in children), sha(ends.encode()))
    return sorted(out.values())


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def planted_conversations():
    rng, rows = random.Random(11), []
    for c in range(150):
        opening = rng.choice([["hello"], ["hello", "yes"], [f"start {rng.randrange(4)}"], []])
        turns = opening + [f"{rng.choice('pqrs')}" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 12))]
        rows += [(c * 3 + c % 4, t, "user" if t % 2 == 0 else "assistant", x) for t, x in enumerate(turns)]
    copies = [(900 + k * 5, t, "user", f"copy {t}") for k in range(30) for t in range(23)]
    deep = [(2000 + k, t, "user", f"deep {t if t < 70 else (t, k % 3)}") for k in range(4) for t in range(90)]
    odd = [(3000, None, None, None), (3000, 1, "user", "é"), (3000, 1, "user", "é"), (None, 1, "user", "lost"), (3001, None, "user", "x"), (3002, 5, None, "y")]
    return rows + copies + deep + odd


@pytest.mark.parametrize("band,shard_bytes,slice_rows", [(32, 1 << 24, 200_000), (2, 4000, 100), (5, 20_000, 7)])
def test_op12_against_every_prefix(spark, band, shard_bytes, slice_rows):
    rows = planted_conversations()
    got = prefix_trie.nodes(conversations(spark, rows).withColumn("depth", F.lit("clash")), band, shard_bytes, slice_rows).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_trie(rows), key=str)


def test_trie_of_few_rows(spark):
    assert prefix_trie.nodes(conversations(spark, [])).collect() == []
    assert prefix_trie.nodes(conversations(spark, [(None, 1, "user", "x")])).collect() == []
    one = prefix_trie.nodes(conversations(spark, [(0, None, None, None)])).collect()
    assert sorted(map(tuple, one), key=str) == sorted(plain_trie([(0, None, None, None)]), key=str)
    long = [(5, t, "user", f"t{t}") for t in range(400)]
    assert sorted(map(tuple, prefix_trie.nodes(conversations(spark, long), 8, 10_000, 50).collect()), key=str) == sorted(plain_trie(long), key=str)


def test_op12_on_the_driver_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_prefix_trie"](spark, folder).collect()), key=str) == sorted(plain_trie(rows), key=str)
