"""Periodic runs of words, by recursive frequency splitting and lag scans of what survives.

A run is at least four periods long, so each of its words occurs at least four times in it. A word that occurs less often in its
segment is in no run there and splits the segment; the parts are counted anew until nothing splits. Most text is gone by then.
A surviving segment is scanned lag by lag: a run of period q holds two neighbouring equal blocks that start at multiples of q,
so only n / q places are compared for lag q, n log n for all lags, by prefix hashes; hits are widened to whole runs by binary
search over the same hashes and then compared word by word.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.hashing import INVERSE, chunks, hash_words, mix, powers, split_words

REPEATS, SHORTEST = 4, 6
LAG_BASE = 0xD6E8FEB86659FD93
LAG_INVERSE = pow(LAG_BASE, -1, 2**64)
PLACES_AT_ONCE = 1 << 18
_ODD = np.uint64(INVERSE)


def surviving(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments of all texts that no rare word splits any more.

    words are the numbers of the words of several texts, first the place where each text starts, with a last entry for the end.
    """
    starts, ends = first[:-1], first[1:]
    done_starts, done_ends = [], []
    while True:
        long = ends - starts >= SHORTEST
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        sizes = ends - starts
        owner = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        # One number for a word in a segment: equal numbers are equal pairs.
        order = np.lexsort((words[at], owner))
        pair_words, pair_owner = words[at][order], owner[order]
        fresh = np.concatenate([[True], (pair_words[1:] != pair_words[:-1]) | (pair_owner[1:] != pair_owner[:-1])])
        group = np.cumsum(fresh) - 1
        rare = np.empty(len(at), bool)
        rare[order] = np.bincount(group)[group] < REPEATS
        split = np.bincount(owner, rare, len(starts)) > 0
        done_starts.append(starts[~split])
        done_ends.append(ends[~split])
        # What is left between rare words, segment by segment.
        keep = ~rare & split[owner]
        edge = np.concatenate([[True], owner[1:] != owner[:-1]])
        begins = keep & (edge | ~np.concatenate([[False], keep[:-1]]))
        stops = keep & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([keep[1:], [False]]))
        starts, ends = at[begins], at[stops] + 1
    if not done_starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(done_starts), np.concatenate(done_ends)


class Scan:
    """Prefix hashes of a segment; blocks are compared without looking at their words."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, n = words, len(words)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(words.astype(np.uint64) * _ODD + _ODD) * powers(LAG_BASE, n), out=self.total[1:])
        self.back = powers(LAG_INVERSE, n + 1)

    def same(self, i: np.ndarray, lag: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the blocks of that length at i and i + lag look equal."""
        left = self.total[i + length] - self.total[i]
        j = i + lag
        return left * self.back[i] == (self.total[j + length] - self.total[j]) * self.back[j]

    def _widest(self, fits, most: np.ndarray) -> np.ndarray:
        """For each place the largest number up to `most` that fits; smaller ones then fit too."""
        low, high = np.zeros(len(most), np.int64), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            good = fits(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def hits(self):
        """(start, lag) of equal neighbouring blocks at multiples of the lag, the first of each row of such blocks."""
        n, lag = len(self.words), 1
        while REPEATS * lag <= n:
            # As many lags at once as give a bounded number of places.
            last = lag
            places = n // lag - 1
            while REPEATS * (last + 1) <= n and places + n // (last + 1) - 1 <= PLACES_AT_ONCE:
                last += 1
                places += n // last - 1
            lags = np.arange(lag, last + 1)
            counts = n // lags - 1
            q = np.repeat(lags, counts)
            i = (np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)) * q
            equal = self.words[i] == self.words[i + q]
            equal[equal] = self.same(i[equal], q[equal], q[equal])
            head = equal.copy()
            head[1:] &= ~(equal[:-1] & (q[1:] == q[:-1]))
            yield i[head], q[head]
            lag = last + 1

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, end, smallest period) of every run."""
        n, found = len(self.words), {}
        for i, q in self.hits():
            if not len(i):
                continue
            right = self._widest(lambda m, i=i, q=q: self.same(i, q, m), n - i - q)
            left = self._widest(lambda m, i=i, q=q: self.same(i - m, q, m), i)
            start, end = i - left, i + right + q
            long = end - start >= np.maximum(SHORTEST, REPEATS * q)
            for s, e, p in zip(start[long].tolist(), end[long].tolist(), q[long].tolist(), strict=True):
                # A multiple of a run's period gives the same stretch, later.
                found.setdefault((s, e), p)
        out = []
        for (s, e), p in found.items():
            if not np.array_equal(self.words[s : e - p], self.words[s + p : e]):
                return self.plain_runs()
            out.append((s, e, p))
        return sorted(out, key=lambda r: (r[0], r[2]))

    def plain_runs(self) -> list[tuple[int, int, int]]:
        """The same by comparing all words at every lag, for segments whose hashes collide."""
        found = {}
        for q in range(1, len(self.words) // REPEATS + 1):
            equal = np.concatenate([[False], self.words[q:] == self.words[:-q], [False]]).astype(np.int8)
            edges = np.diff(equal)
            for s, e in zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) + q).tolist(), strict=True):
                if e - s >= max(SHORTEST, REPEATS * q):
                    found.setdefault((s, e), q)
        return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def runs_of_texts(words: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """text number -> its runs (start, length, period), by start and then period; texts without runs are left out."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    starts, ends = surviving(words, first)
    order = np.argsort(starts)
    texts = np.searchsorted(first, starts[order], "right") - 1
    for a, b, text in zip(starts[order].tolist(), ends[order].tolist(), texts.tolist(), strict=True):
        here = Scan(words[a:b]).runs()
        if here:
            base = a - int(first[text])
            out.setdefault(text, []).extend((s + base, e - s, p) for s, e, p in here)
    return out


def highest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length / period, compared exactly; of equal ones the first start, then the least period."""
    best = runs[0]
    for run in runs[1:]:
        more = run[1] * best[2] - best[1] * run[2]
        if more > 0 or (more == 0 and (run[0], run[2]) < (best[0], best[2])):
            best = run
    return best


def rewritten(doc_id, n: int) -> np.ndarray | None:
    """For ids whose CRC-32 ends in 0, the original word that each of n words becomes; the end of the text turns periodic."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def find(docs: DataFrame, rewrite=None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), best and the text without its repeated words, for every row.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, numbered from 0; rewrite(doc_id, n) may give other words in their place.
    best is the run with the greatest exponent, null without runs. collapsed is the kept words joined by one space: a word goes
    if a run holds it after its first period. Null, empty and white texts have no words and no runs; repeated rows and null ids
    are rows like others; an empty table stays empty and other columns are ignored. Words count as the same when their 64-bit
    hashes do. One map over the rows: nothing is shuffled, and a task holds about a megabyte of text at a time or one text.
    """
    kind = dict(docs.dtypes)["doc_id"]
    run = "struct<start:long,length:long,period:long>"
    ddl = f"doc_id {kind}, n_words long, runs array<{run}>, best {run}, collapsed binary"
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def named(r):
        return {"start": r[0], "length": r[1], "period": r[2]}

    def scan(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for base, data in chunks(batch.column(1).to_pylist()):
                buffer, starts, ends, first = split_words(data)
                words = np.unique(hash_words(buffer, starts, ends), return_inverse=True)[1].astype(np.int64)
                source = {}
                for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if rewrite is not None and (at := rewrite(ids[base + k], b - a)) is not None:
                        source[k] = at
                        words[a:b] = words[a:b][at]
                found = runs_of_texts(words, first)
                out = []
                for k, (text, a, b) in enumerate(zip(data, first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    runs, at = found.get(k, []), source.get(k)
                    parts = text.split()
                    if at is not None:
                        parts = [parts[j] for j in at.tolist()]
                    if runs:
                        edges = np.zeros(b - a + 1, np.int64)
                        for s, length, p in runs:
                            edges[s + p] += 1
                            edges[s + length] -= 1
                        kept = np.cumsum(edges[:-1]) == 0
                        parts = [parts[j] for j in np.flatnonzero(kept).tolist()]
                    out.append((ids[base + k], b - a, [named(r) for r in runs], named(highest(runs)) if runs else None, b" ".join(parts)))
                columns = list(zip(*out, strict=True))
                kinds = [batch.schema.field(0).type, pa.int64(), pa.list_(struct), struct, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_words", "runs", "best", "collapsed"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(scan, ddl)


def digest(docs: DataFrame) -> DataFrame:
    """The runs of every document, after every tenth id's words turned periodic, as numbers and digests."""
    found = find(docs, rewritten)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def brute_force(doc_id, text: str | None) -> tuple:
    """One document's row by checking every start and period; for tests."""
    import re
    from fractions import Fraction

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = rewritten(doc_id, len(words))
    if at is not None:
        words = [words[j] for j in at]
    n, runs, seen = len(words), [], set()
    for q in range(1, n // REPEATS + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(SHORTEST, REPEATS * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                runs.append((i, j + q - i, q))
            i = j + 1
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    milli = 1000 * best[1] // best[2] if runs else None
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapsed)]
    return (doc_id, len(runs), *best, milli, *sha)
