"""Substring deduplication: Rabin-Karp hashes of all word windows, counted over the corpus; repeated windows are cut out."""

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.blocks import found, gathered, in_blocks, repeated
from kindred.llm.hashing import chunks, hash_words, rolling, runs, split_words

WIDTH = 35


def windows(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows that lie inside one text, and the word each starts at. first: the texts' first words."""
    hashes = rolling(words, width)
    lengths = np.diff(first)
    left = np.repeat(first[1:], lengths)[: len(hashes)] - np.arange(len(hashes))
    inside = left >= width
    return hashes[inside], np.flatnonzero(inside)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the n words that a window starting at one of `starts` covers."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + width, n), minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


def remove_repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Cuts out every word that lies in a window of `width` words which also starts anywhere else.

    Returns doc_id, n_words, n_removed, kept_text and spans (the maximal removal intervals as word positions from, to).
    Windows are judged on the input. Two windows count as equal when their 64-bit hashes are: for n windows in all,
    about n * n / 2**65 pairs may be equal by chance (less than 0.001 for 10**8 windows).

    A null or empty text has no words: 0, 0 and an empty kept text. A null doc_id is kept; repeated rows are rows of their
    own, and repeat each other. An empty table gives an empty table. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    blocks, n = in_blocks(rows)
    kind = dict(rows.dtypes)["doc_id"]

    def keys_of(table: pa.Table) -> np.ndarray:
        out = []
        for _, data in chunks(table.column("text").to_pylist()):
            buffer, starts, ends, first = split_words(data)
            out.append(windows(hash_words(buffer, starts, ends), first, width)[0])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def cut(left, right):
        keys, _ = gathered(right)
        words_n, removed_n, kept, spans = [], [], [], []
        for _, data in chunks(left.column("text").to_pylist()):
            buffer, starts, ends, first = split_words(data)
            hashes, where = windows(hash_words(buffer, starts, ends), first, width)
            gone = covered(where[found(hashes, keys) >= 0], width, len(starts))
            for text, a, b in zip(data, first[:-1], first[1:], strict=True):
                mask, words = gone[a:b], text.split()
                begin, end = runs(mask)
                words_n.append(len(words))
                removed_n.append(int(mask.sum()))
                kept.append(b" ".join(compress(words, ~mask) if len(begin) else words))
                spans.append([{"from": int(x), "to": int(y)} for x, y in zip(begin, end, strict=True)])
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(words_n, pa.int64()), "n_removed": pa.array(removed_n, pa.int64()),
                         "kept_text": pa.array(kept, pa.binary()), "spans": pa.array(spans, span)})

    answers = repeated(blocks, n, keys_of)
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_text binary, spans array<struct<from: long, to: long>>"
    return blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(cut, schema).withColumn("kept_text", F.col("kept_text").cast("string"))


def digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    out = remove_repeated_windows(docs, width)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: dict, width: int = WIDTH) -> dict:
    """What digest() returns, by a dictionary of all windows; for tests."""
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    counts: dict = {}
    for w in words.values():
        for j in range(len(w) - width + 1):
            counts[tuple(w[j : j + width])] = counts.get(tuple(w[j : j + width]), 0) + 1
    out = {}
    for i, w in words.items():
        gone = {k for j in range(len(w) - width + 1) if counts[tuple(w[j : j + width])] > 1 for k in range(j, j + width)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out
