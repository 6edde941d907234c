"""Packing of token sequences: non-negative least squares over length combinations, then a greedy rest.

Every document is tokenised once, where it lies, and cut into full windows and one remainder. Only the histogram of piece
lengths (at most `window` numbers) reaches the driver, where combinations of up to three lengths that fill a window get repeat
counts; pieces then find their sequence from their number within their length.
"""

import os
import re
import zlib
from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kindred.llm.blocks import found
from kindred.llm.hashing import hash_words, runs
from kindred.llm.numbering import numbered
from kindred.session import materialize

WINDOW = 1024
TOKENIZER = "byte_bpe_50k.json"
# Fixed value: the tokenizer's one special token.
SPECIAL = "<|endoftext|>"
UNCUT = re.compile(r" (?:\s|\Z)")
CACHE_ENTRIES = 1_000_000
TEXT_SLICE = 1 << 20
LINES = 500
# Bytes of ASCII signs that are no white space, and letters and digits of these.
SIGN, ALNUM = np.zeros(256, bool), np.zeros(256, bool)
SIGN[0x21:0x7F] = True
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
# Keys of what follows a word without a space; words without one before them have keys of their own.
SIGNS = {",": 1, ".": 2, "\n": 3}
BARE = 0x5851F42D4C957F2D


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Little-endian 32-bit ids of whole texts from the ids of their units, each of which the tokenizer sees once.

    The tokenizer never joins a space and a following sign with what is before them, so a text can be cut before each such
    space. A line end between two signs is a token of its own, and so is a comma or full stop at the end of a word, after a
    letter or digit. Texts where a space comes before white space or the end, or with the special token's own signs, are not
    cut. Units are the same when their 64-bit hashes are; those seen lately are kept as arrays, some 40 bytes for each.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        fixed = {key: self.whole(sign) for sign, key in SIGNS.items()}
        self.line_end = np.frombuffer(fixed[SIGNS["\n"]], "<u4")[0]
        self.fixed = np.array(sorted(fixed), np.uint64), [fixed[k] for k in sorted(fixed)]
        self._forget()

    def _forget(self) -> None:
        self.keys, self.begin, self.size = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))
        self.table = np.zeros(0, "<u4")
        self._remember(*self.fixed)

    def _remember(self, keys: np.ndarray, ids: list[bytes]) -> None:
        size = np.array([len(x) for x in ids], np.int64) // 4
        begin = len(self.table) + np.cumsum(size) - size
        self.table = np.concatenate([self.table, np.frombuffer(b"".join(ids), "<u4")])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size = (np.insert(old, at, new) for old, new in ((self.keys, keys), (self.begin, begin), (self.size, size)))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        cut = []
        for k, text in enumerate(texts):
            if SPECIAL in text or UNCUT.search(text):
                out[k] = self.whole(text)
            else:
                cut.append(k)
        if not cut:
            return out
        data = [texts[k].encode() for k in cut]
        whole = b" ".join(data) + b" "
        buffer = np.frombuffer(whole, np.uint8)
        place = np.cumsum([0] + [len(x) + 1 for x in data])
        line = np.flatnonzero(buffer == 0x0A)
        line = line[(line > 0) & SIGN[buffer[line - 1]] & SIGN[buffer[line + 1]]]
        apart = buffer == 0x20
        apart[line] = True
        starts, ends = runs(~apart)
        # No space is before the first word of a text and after a line end.
        bare = (starts == 0) | (buffer[starts - 1] != 0x20)
        bare[np.isin(starts, place[:-1])] = True
        last = buffer[ends - 1]
        tail = (ends - starts > 1) & ((last == 0x2C) | (last == 0x2E)) & ALNUM[buffer[ends - 2]]
        signs = ends[tail] - 1
        ends = ends - tail
        keys = hash_words(buffer, starts, ends)
        keys[bare] ^= np.uint64(BARE)
        points = np.where(buffer[signs] == 0x2C, np.uint64(SIGNS[","]), np.uint64(SIGNS["."]))
        all_starts = np.concatenate([starts, signs, line])
        order = np.argsort(all_starts, kind="stable")
        all_keys = np.concatenate([keys, points, np.full(len(line), SIGNS["\n"], np.uint64)])[order]
        different, chosen, unit = np.unique(all_keys, return_index=True, return_inverse=True)
        new = found(different, self.keys) < 0
        if new.any():
            k = order[chosen[new]]  # signs are always known, so these are words
            words = [(whole[a:b].decode(), c) for a, b, c in zip(starts[k].tolist(), ends[k].tolist(), bare[k].tolist(), strict=True)]
            self._remember(different[new], self._learn(words))
        at = found(different, self.keys)
        sizes, begin = self.size[at], self.begin[at]
        each = sizes[unit]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = self.table[np.repeat(begin[unit] - upto[:-1], each) + np.arange(upto[-1])].tobytes()
        edges = 4 * upto[np.searchsorted(all_starts[order], place)]
        for k, a, b in zip(cut, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            out[k] = ids[a:b]
        if len(self.keys) > CACHE_ENTRIES:
            kept = [self.table[a : a + n].tobytes() for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
            known = np.isin(different, self.fixed[0])
            self._forget()
            self._remember(different[~known], [x for x, k in zip(kept, known.tolist(), strict=True) if not k])
        return out

    def _learn(self, words: list[tuple[str, bool]]) -> list[bytes]:
        """Ids of new words; printable ones go as lines of some short texts, much faster than one by one."""
        out: list[bytes] = [b""] * len(words)
        lines, rest = [], []
        for k, (word, _) in enumerate(words):
            (lines if word.isprintable() else rest).append(k)
        texts = [word if bare else f" {word}" for word, bare in words]
        for start in range(0, len(lines), LINES):
            group = lines[start : start + LINES]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join([texts[k] for k in group]) + "\n"], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.line_end)
            if len(ends) != len(group):
                rest += group
                continue
            data, at = ids.tobytes(), 0
            for k, end in zip(group, (4 * ends).tolist(), strict=True):
                out[k] = data[at:end]
                at = end + 4
        for k, coded in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = array("I", coded.ids).tobytes()
        return out


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


def _some(texts: list):
    """Slices of about a megabyte of text."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "") + 1
        if size > TEXT_SLICE:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def cut(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full windows from the start, then the remainder."""
    kind = dict(docs.dtypes)["doc_id"]
    ddl = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def pieces(batches):
        encoder = encoder_of(path)
        for batch in batches:
            out, names, texts = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last in _some(texts):
                for id_, ids in zip(names[first:last], encoder.encode([t or "" for t in texts[first:last]]), strict=True):
                    ids += b"\0\0\0\0"
                    n = len(ids) // 4
                    for a, b in pairwise([*range(0, n, window), n]):
                        out.append((id_, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out) if out else [()] * 5, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(pieces, ddl)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All multisets of one to three of the lengths that fill the window, as rows padded with 0."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    out = [[window, 0, 0]] if have[window] else []
    for a in lengths[lengths <= window // 2]:
        if have[window - a]:
            out.append([a, window - a, 0])
        b = np.arange(a, (window - a) // 2 + 1)
        c = window - a - b
        good = have[b] & have[c] if len(b) else np.zeros(0, bool)
        out.extend(np.column_stack([np.full(good.sum(), a), b[good], c[good]]).tolist())
    return np.array(out, np.int64).reshape(-1, 3)


def solve(combos: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|, A the length counts of the combinations, by multiplicative updates."""
    n = len(counts)
    aimed = counts.astype(float)
    aimed[0] = 0
    use = combos > 0
    grow = np.where(use, aimed[combos], 0).sum(1)
    x = np.where(grow > 0, grow / max(1, len(combos)), 0.0)
    for _ in range(rounds):
        made = np.bincount(combos.ravel(), np.repeat(x, 3), n)
        made[0] = 0
        x = x * grow / np.maximum(np.where(use, made[combos], 0).sum(1), 1e-12)
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how often it is made); uses every counted piece exactly once.

    The least-squares repeats are rounded down by what is left, largest first; the rest is packed best fit, longest first.
    There are at most as many patterns as combinations of the window plus one for each length.
    """
    left = counts.astype(np.int64).copy()
    combos = combinations(np.flatnonzero(left), window)
    out = []
    if len(combos):
        x = solve(combos, left)
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 0.5:
                break
            pattern = combos[k][combos[k] > 0]
            kinds, needs = np.unique(pattern, return_counts=True)
            repeat = int(min(round(x[k]), (left[kinds] // needs).min()))
            if repeat:
                left[kinds] -= repeat * needs
                out.append((tuple(pattern.tolist()), repeat))
    while left.any():
        pattern, room, now = [], window, left.copy()
        while room and (fits := np.flatnonzero(now[: room + 1])).size:
            pattern.append(int(fits[-1]))
            now[fits[-1]] -= 1
            room -= pattern[-1]
        kinds, needs = np.unique(pattern, return_counts=True)
        repeat = int((left[kinds] // needs).min())
        left[kinds] -= repeat * needs
        out.append((tuple(pattern), repeat))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first number, sequence, offset), sorted: pieces of a length from that number on go to that sequence on."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, repeat in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + repeat
            offset += length
        sequence += repeat
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Packs all documents into sequences of at most `window` tokens.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset. A document's ids are the
    tokenizer's and a final 0; null and empty texts are the single id 0. Rows are packed one by one, repeated rows and null
    doc_ids too; an empty table gives an empty table. Other columns are ignored. Sequence ids run from 0 without gaps.
    """
    pieces = materialize(cut(docs, path or tokenizer_path(), window))
    counts = np.zeros(window + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    table = places(plan(counts, window))
    kind = dict(pieces.dtypes)["doc_id"]
    ddl = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    big = 1 << 44
    keys = table[:, 0] * big + table[:, 1]

    def place(batches):
        for batch in batches:
            length, number = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "_number"))
            row = table[np.searchsorted(keys, length * big + number, "right") - 1] if len(length) else np.zeros((0, 4), np.int64)
            columns = [batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 2] + number - row[:, 1]), pa.array(row[:, 3])], schema=schema)

    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    return numbered(pieces, "length", order, "_number").mapInArrow(place, ddl)
