"""Benchmark decontamination: an FM-index per shard of training text, searched backwards for all benchmark phrases.

A shard holds the words of a few megabytes of documents that also occur in the benchmark; any other word ends a run, and runs
shorter than the shortest phrase cannot match. The index is a wavelet matrix over the Burrows-Wheeler transform of that
sequence. All phrases are searched together, from their last word to their first; occurrences are located through sampled
suffix positions and merged into spans.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.hashing import chunks, hash_words, runs, split_words

WIDTH = 10
SHARD_BYTES = 8 << 20
BENCHMARK_BYTES = 8 << 20
SAMPLE = 8

SEPARATOR = np.zeros(256, bool)
for _from, _to in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    SEPARATOR[_from : _to + 1] = True


@dataclass
class Phrases:
    """Distinct phrases of one length as rows of word numbers, and the items each belongs to."""

    words: np.ndarray
    items: list[list[int]]


@dataclass
class Benchmark:
    names: list[str]
    vocabulary: np.ndarray  # sorted word hashes
    groups: list[Phrases]

    @property
    def shortest(self) -> int:
        return min((g.words.shape[1] for g in self.groups), default=0)


def prepare(items: list[tuple], width: int = WIDTH) -> Benchmark:
    """items: (item_id, text). Windows of `width` words; a shorter item is one window, one without words has none."""
    data = [(text or b"").lower() for _, text in items]
    buffer, starts, ends, first = split_words(data, SEPARATOR)
    hashes = hash_words(buffer, starts, ends)
    vocabulary, words = np.unique(hashes, return_inverse=True)
    found: dict[tuple, set[int]] = {}
    for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        for j in range(a, max(a + 1, b - width + 1)) if b > a else ():
            found.setdefault(tuple(words[j : min(j + width, b)].tolist()), set()).add(k)
    groups = []
    for n in sorted({len(w) for w in found}):
        mine = sorted(w for w in found if len(w) == n)
        groups.append(Phrases(np.array(mine, np.int64), [sorted(found[w]) for w in mine]))
    return Benchmark([str(i) for i, _ in items], vocabulary, groups)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol must be the unique smallest."""
    _, rank = np.unique(text, return_inverse=True)
    n, step = len(text), 1
    order = np.argsort(rank, kind="stable")
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        rank = new
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    def __init__(self, text: np.ndarray) -> None:
        """text: symbols from 1 on; a unique 0 is added at its end."""
        text = np.append(text, 0)
        array = suffix_array(text)
        self.bwt = text[array - 1]
        symbols = int(text.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.levels, values = [], self.bwt
        self.bits = max(1, int(symbols - 1).bit_length())
        for shift in range(self.bits - 1, -1, -1):
            bit = (values >> shift) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            self.levels.append((shift, ones, len(bit) - int(ones[-1])))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        self.origin = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))
        self.sampled = array % SAMPLE == 0
        self.place = np.cumsum(self.sampled) - 1
        self.positions = array[self.sampled]

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, ones, zeros in self.levels:
            r = ones[at]
            at = np.where((symbol >> shift) & 1, zeros + r, at - r)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol occurs in the transform before `at`."""
        return self._descend(symbol, at) - self.origin[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the phrases (rows of symbols; 0 for a symbol the text lacks)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt))
        high[(phrases == 0).any(1)] = 0
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            symbol = phrases[live, k]
            low[live] = self.before[symbol] + self.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: steps back through the text to the next sampled row."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            hit = self.sampled[rows[left]]
            done = left[hit]
            out[done] = self.positions[self.place[rows[done]]] + steps
            left = left[~hit]
            symbol = self.bwt[rows[left]]
            rows[left] = self.before[symbol] + self.rank(symbol, rows[left])
            steps += 1
        return out


def search_shard(texts: list, benchmark: Benchmark) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """(first word of each text and the end, mask of hit words, items with a hit for each text)."""
    numbers, firsts, total = [], [np.zeros(1, np.int64)], 0
    for _, data in chunks(texts):
        buffer, starts, ends, first = split_words([x.lower() for x in data], SEPARATOR)
        hashes = hash_words(buffer, starts, ends)
        at = np.minimum(np.searchsorted(benchmark.vocabulary, hashes), max(0, len(benchmark.vocabulary) - 1))
        known = benchmark.vocabulary[at] == hashes if len(benchmark.vocabulary) else np.zeros(len(hashes), bool)
        numbers.append(np.where(known, at, -1))
        firsts.append(first[1:] + total)
        total += len(starts)
    word, first = np.concatenate(numbers) if numbers else np.zeros(0, np.int64), np.concatenate(firsts)
    hit, items = np.zeros(len(word), bool), [[] for _ in texts]
    if not benchmark.groups:
        return first, hit, items
    # A virtual unknown word between texts keeps runs inside one text.
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    spread = np.full(len(word) + len(texts) + 1, -1)
    spread[np.arange(len(word)) + owner] = word
    starts, ends = runs(spread >= 0)
    long = ends - starts >= benchmark.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return first, hit, items
    sizes = ends - starts + 1
    origin = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    used, text = np.unique(spread[origin], return_inverse=True)  # -1, the end of a run, comes first
    text = text + 1
    symbol = np.zeros(len(benchmark.vocabulary), np.int64)
    symbol[used[used >= 0]] = np.flatnonzero(used >= 0) + 1
    index = FMIndex(text)
    pairs = []
    for group in benchmark.groups:
        low, high = index.search(symbol[group.words])
        matched = np.flatnonzero(low < high)
        counts = high[matched] - low[matched]
        rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[matched], counts)
        places = origin[index.locate(rows)]
        text_of = np.searchsorted(first + np.arange(len(first)), places, "right") - 1
        begin = places - text_of
        change = np.bincount(begin, minlength=len(word) + 1) - np.bincount(begin + group.words.shape[1], minlength=len(word) + 1)
        hit |= np.cumsum(change[: len(word)]) > 0
        pairs.extend({(int(t), i) for t, p in zip(text_of, np.repeat(matched, counts), strict=True) for i in group.items[p]})
    for t, i in sorted(set(pairs)):
        items[t].append(i)
    return first, hit, items


def _shards(batch: pa.RecordBatch, at: int):
    """Slices of a batch of about SHARD_BYTES of text."""
    column = batch.column(at)
    sizes = np.cumsum([0 if x is None else len(x) for x in column.to_pylist()])
    start = 0
    while start < batch.num_rows:
        limit = (sizes[start - 1] if start else 0) + SHARD_BYTES
        end = max(start + 1, int(np.searchsorted(sizes, limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BENCHMARK_BYTES):
    """The prepared benchmark in blocks of about `block_bytes` of text, one at a time on the driver. Null ids are named `null`."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    for b in range(n):
        mine = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield prepare([tuple(r) for r in mine.collect()])


def find_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of items with an occurring window) and spans (merged word positions from, to).

    A-Z are lower-cased, words are runs of digits, a-z and non-ASCII bytes, windows have ten words or are a whole shorter
    item. A null or empty text has no words; so has a null item, which then occurs nowhere. Items with one id count once.
    Repeated rows and null doc_ids are judged row by row; an empty table gives an empty table, an empty benchmark no hits.
    Other columns are ignored. Text is not shuffled; the benchmark is searched in blocks of bounded size.
    """
    kind = dict(docs.dtypes)["doc_id"]
    state = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.lit(None).cast("binary").alias("mask"), F.array().cast("array<string>").alias("items"))
    for block in benchmark_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def step(batches, shared=shared):
            for batch in batches:
                for part in _shards(batch, 1):
                    first, hit, items = search_shard(part.column(1).to_pylist(), shared.value)
                    masks, names = [], []
                    for k, (old, had) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                        mask = hit[first[k] : first[k + 1]]
                        masks.append((mask if old is None else mask | np.frombuffer(old, bool)).tobytes())
                        names.append(sorted({*had, *(shared.value.names[i] for i in items[k])}))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(masks, pa.binary()), pa.array(names, pa.list_(pa.string()))],
                                                     names=["doc_id", "text", "mask", "items"])

        state = state.mapInArrow(step, f"doc_id {kind}, text binary, mask binary, items array<string>")

    def finish(batches):
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for batch in batches:
            masks = [np.frombuffer(x, bool) for x in batch.column(1).to_pylist()]
            spans = [[{"from": int(a), "to": int(b)} for a, b in zip(*runs(m), strict=True)] for m in masks]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(m) for m in masks], pa.int64()), pa.array([int(m.sum()) for m in masks], pa.int64()),
                                              batch.column(2), pa.array(spans, span)], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    schema = f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<from: long, to: long>>"
    return state.select("doc_id", "mask", "items").mapInArrow(finish, schema)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = find_hits(docs, benchmark)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without any hit word, with all their columns."""
    at = docs.columns.index("text")
    for block in benchmark_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches, shared=shared):
            for batch in batches:
                for part in _shards(batch, at):
                    texts = [None if x is None else x.encode() for x in part.column(at).to_pylist()]
                    first, hit, _ = search_shard(texts, shared.value)
                    total = np.concatenate([[0], np.cumsum(hit)])[first]
                    yield part.filter(pa.array(np.diff(total) == 0))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def brute_force(docs: dict, items: list[tuple], width: int = WIDTH) -> dict:
    """doc_id -> (n_words, n_hit, sorted item ids), by a dictionary of all benchmark windows; for tests."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {i: chr(i + 32) for i in range(65, 91)}
    cut = lambda t: word.findall((t or "").translate(lower))
    windows: dict = {}
    for i, text in items:
        w = cut(text)
        for j in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[j : j + width]), set()).add(str(i))
    sizes, out = {len(w) for w in windows}, {}
    for i, text in docs.items():
        w, hit, found = cut(text), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[j : j + n]))) is not None:
                    hit.update(range(j, j + n))
                    found |= got
        out[i] = (len(w), len(hit), sorted(found))
    return out
