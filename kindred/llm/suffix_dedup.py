"""Removal of byte strings that occur earlier, by suffix arrays of shards.

Every window of `width` bytes belongs to the smallest of its hashed byte grams; consecutive windows of one gram are a segment,
and equal windows have equal grams. Grams that occur once are dropped, the segments of the others go to the shard of their
gram. A shard folds equal segments, builds one suffix array of the others by induced sorting, and finds equal windows as
neighbours whose permuted common prefix is long enough: all but the earliest are removed.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.blocks import found, gathered, in_blocks, repeated
from kindred.llm.hashing import BASE, BYTE_VALUES, INVERSE, mix, powers, rolling, runs
from kindred.llm.suffix_array import common_prefixes, suffix_array

WIDTH, GRAM = 100, 24
PIECE_BYTES = 1 << 18
# A gram with more segments in the corpus than this sends its windows one by one, spread over the shards by their own hash.
HOT_SEGMENTS = 20_000
PLACE_BITS = np.uint64(24)


def _ordered(table: pa.Table) -> tuple[list, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, texts, and the arrays that order them in the corpus: null id last, id, hash of the text."""
    ids, texts = table.column("doc_id").to_pylist(), [x or b"" for x in table.column("text").to_pylist()]
    missing = np.array([i is None for i in ids], bool)
    number = np.array([0 if i is None else i for i in ids], np.int64)
    digest = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
    order = np.lexsort((digest, number, missing))
    return [ids[k] for k in order], [texts[k] for k in order], missing[order], number[order], digest[order]


def _pieces(texts: list[bytes], width: int):
    """(documents, offsets, parts): parts of about PIECE_BYTES together; a longer text is cut with width - 1 bytes of overlap."""
    docs, offsets, parts, size = [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - width + 1), PIECE_BYTES):
            part = text[at : at + PIECE_BYTES + width - 1]
            if len(part) >= width:
                docs.append(k)
                offsets.append(at)
                parts.append(part)
                size += len(part)
            if size >= PIECE_BYTES:
                yield docs, offsets, parts
                docs, offsets, parts, size = [], [], [], 0
    if parts:
        yield docs, offsets, parts


def _span_hash(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((total[b] - total[a]) * powers(INVERSE, len(total))[a])


def _prefix_sums(buffer: np.ndarray) -> np.ndarray:
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[buffer] * powers(BASE, len(buffer)), out=total[1:])
    return total


def segments(parts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(buffer, part starts, gram hash, first window, window after the last, gram's place) of every segment of the parts."""
    buffer = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    at = np.cumsum([0] + [len(p) + 1 for p in parts])
    grams = rolling(BYTE_VALUES[buffer], gram)
    n = len(buffer) - width + 1
    least = grams >> PLACE_BITS << PLACE_BITS | np.arange(len(grams), dtype=np.uint64)
    span, wide = 1, width - gram + 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    least = least[:n]
    inside = np.arange(n) + width <= np.repeat(at[1:] - 1, np.diff(at))[:n]
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])]))
    after = np.append(first[1:], n)
    good = inside[first]
    first, after = first[good], after[good]
    place = (least[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
    return buffer, at, grams[place], first, after, place


def _zip(*arrays: np.ndarray) -> list[bytes]:
    press = zstandard.ZstdCompressor(level=1)
    return [press.compress(np.ascontiguousarray(a).tobytes()) for a in arrays]


def _unzip(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


SENT = [("_shard", pa.int64()), ("_block", pa.int32()), *((n, pa.binary()) for n in ("key", "missing", "number", "digest", "doc", "start", "gram", "length", "content"))]
SENT_DDL = "_shard long, _block int, key binary, missing binary, number binary, digest binary, doc binary, start binary, gram binary, length binary, content binary"
SPANS = [("_block", pa.int32()), ("doc", pa.binary()), ("first", pa.binary()), ("after", pa.binary())]
SPANS_DDL = "_block int, doc binary, first binary, after binary"


def _window_runs(doc: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (document, first, after) of consecutive windows."""
    order = np.lexsort((window, doc))
    doc, window = doc[order], window[order]
    begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (window[1:] != window[:-1] + 1)])) if len(doc) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(doc))[: len(begin)] - 1
    return doc[begin], window[begin], window[end] + 1


def repeats_in_shard(contents: list[bytes], key: np.ndarray, gram_at: np.ndarray, order: np.ndarray, start: np.ndarray, width: int, gram: int):
    """(content, window) pairs that are removed: the window's bytes also occur at an earlier place of the given contents.

    Contents are distinct; order is the corpus order of the documents they lie in and start their place there.
    """
    none = np.zeros(0, np.int64)
    if len(contents) < 2:
        return none, none
    sizes = np.array([len(c) for c in contents])
    buffer = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    at = np.cumsum(np.concatenate([[0], sizes + 1]))[:-1]
    # A shared window has at least half of its other bytes on one side of the gram.
    side = -(-(width - gram) // 2)
    total = _prefix_sums(buffer)
    left, right = gram_at >= side, gram_at + gram + side <= sizes
    shared = np.zeros(len(contents), bool)
    for has, a, b in ((left, at + gram_at - side, at + gram_at + gram), (right, at + gram_at, at + gram_at + gram + side)):
        rows = np.flatnonzero(has)
        _, inverse, counts = np.unique(_span_hash(total, a[rows], b[rows]), return_inverse=True, return_counts=True)
        shared[rows[counts[inverse] > 1]] = True
    rows = np.flatnonzero(shared)
    if len(rows) < 2:
        return none, none
    chosen = b"\0".join(contents[k] for k in rows) + b"\0"
    sizes, at = sizes[rows], np.cumsum(np.concatenate([[0], sizes[rows] + 1]))
    text = np.frombuffer(chosen, np.uint8).astype(np.int64) + 2
    text[at[1:] - 1] = 1
    text = np.append(text, 0)
    sorted_ = suffix_array(text)
    equal = common_prefixes(text, sorted_) >= width
    owner = np.searchsorted(at, sorted_, "right") - 1
    owner[owner >= len(rows)] = 0
    offset = sorted_ - at[owner]
    whole = offset + width <= sizes[owner]
    whole[0] = False
    group = np.cumsum(~(equal & whole))
    keep = np.flatnonzero(whole)
    owner, offset, group = owner[keep], offset[keep], group[keep]
    place = np.lexsort((start[rows[owner]] + offset, order[rows[owner]], group))
    later = np.concatenate([[False], group[place][1:] == group[place][:-1]])
    gone = place[later]
    return rows[owner[gone]], offset[gone]


def remove_earlier(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """Removes every byte covered by a string of `width` bytes that also starts earlier: in a smaller doc_id, or before.

    Returns doc_id, n_bytes, n_removed, kept (binary) and spans (the maximal removed runs as byte positions from, to). Strings
    are judged on the input and never cross documents. doc_id is an integer; a null one comes after all others, rows with one
    doc_id are ordered by a hash of their text, and of fully equal rows one comes first. A null or empty text has no bytes. An
    empty table gives an empty table; other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    blocks, n = in_blocks(rows)

    def keys_of(table):
        _, texts, *_ = _ordered(table)
        return np.concatenate([np.zeros(0, np.uint64), *(segments(parts, width, gram)[2] for _, _, parts in _pieces(texts, width))])

    def send(left, right):
        if not left.num_rows:
            return pa.table([pa.array([], t) for _, t in SENT], names=[c for c, _ in SENT])
        block = left.column("_block")[0].as_py()
        _, texts, missing, number, digest = _ordered(left)
        keys, counts = gathered(right)
        seen: set[bytes] = set()
        columns: list[list] = [[] for _ in range(6)]  # shard, key, doc, start, place of the gram, content
        gone_doc, gone_first, gone_after = [], [], []
        for owners, offsets, parts in _pieces(texts, width):
            buffer, at, key, first, after, place = segments(parts, width, gram)
            hit = found(key, keys)
            mine = np.flatnonzero(hit >= 0)
            if not len(mine):
                continue
            part = np.searchsorted(at, first[mine], "right") - 1
            data = buffer.tobytes()
            for k, p, hot in zip(mine.tolist(), part.tolist(), (counts[hit[mine]] > hot_segments).tolist(), strict=True):
                doc, shift = owners[p], offsets[p] - int(at[p])
                windows = range(int(first[k]), int(after[k])) if hot else (int(first[k]),)
                for a in windows:
                    b = a + width if hot else int(after[k]) + width - 1
                    content = data[a:b]
                    if content in seen:
                        gone_doc.append(doc)
                        gone_first.append(a + shift)
                        gone_after.append(b - width + 1 + shift)
                        continue
                    seen.add(content)
                    spread = xxhash.xxh64_intdigest(content) if hot else int(key[k])
                    for column, value in zip(columns, (spread % n, spread, doc, a + shift, int(place[k]) - a, content), strict=True):
                        column.append(value)
        out = [{"_shard": n + block, "_block": block, "doc": z[0], "start": z[1], "length": z[2]}
               for z in [_zip(np.array(gone_doc, np.int64), np.array(gone_first, np.int64), np.array(gone_after, np.int64))]] if gone_doc else []
        shard, key, doc, start, place = (np.array(c, np.uint64 if i == 1 else np.int64) for i, c in enumerate(columns[:5]))
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0])) if len(order) else []
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            pick = order[a:b]
            contents = [columns[5][k] for k in pick]
            d = doc[pick]
            packed = _zip(key[pick], missing[d], number[d], digest[d], d, start[pick], place[pick], np.array([len(c) for c in contents], np.int64), np.frombuffer(b"".join(contents), np.uint8))
            out.append({"_shard": int(shard[pick[0]]), "_block": block} | dict(zip([c for c, _ in SENT[2:]], packed, strict=True)))
        return pa.table([pa.array([r.get(c) for r in out], t) for c, t in SENT], names=[c for c, _ in SENT])

    def judge(key, table):
        if key[0].as_py() >= n:
            return pa.table([table.column(c) for c in ("_block", "doc", "start", "length")], names=[c for c, _ in SPANS])
        column = lambda name, dtype: [_unzip(x, dtype) for x in table.column(name).to_pylist()]
        doc = column("doc", np.int64)
        block = np.repeat(np.array(table.column("_block").to_pylist()), [len(d) for d in doc])
        doc, spread, missing = np.concatenate(doc), np.concatenate(column("key", np.uint64)), np.concatenate(column("missing", bool))
        number, digest = np.concatenate(column("number", np.int64)), np.concatenate(column("digest", np.uint64))
        start, place, length = (np.concatenate(column(c, np.int64)) for c in ("start", "gram", "length"))
        data = b"".join(_unzip(x, np.uint8).tobytes() for x in table.column("content").to_pylist())
        ends = np.cumsum(length)
        contents = [data[a:b] for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)]
        order = np.lexsort((start, doc, block, digest, number, missing))
        first: dict[bytes, int] = {}
        kept, folded = [], []
        for k in order.tolist():
            (kept if first.setdefault(contents[k], k) == k else folded).append(k)
        kept, folded = np.array(kept, np.int64), np.array(folded, np.int64)
        group, alone = np.unique(spread[kept], return_inverse=True, return_counts=True)[1:]
        several = kept[alone[group] > 1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # Rows of one document come in the order of their starts, so the place in `order` and the offset decide who is earlier.
        doc_key = np.lexsort((doc, block, digest, number, missing))
        change = np.concatenate([[0], np.cumsum((block[doc_key][1:] != block[doc_key][:-1]) | (doc[doc_key][1:] != doc[doc_key][:-1]))])
        doc_rank = np.empty(len(doc_key), np.int64)
        doc_rank[doc_key] = change
        owner, offset = repeats_in_shard([contents[k] for k in several], spread[several], place[several], doc_rank[several], start[several], width, gram)
        count = length[folded] - width + 1
        windows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[folded], count)
        gone = np.concatenate([np.repeat(folded, count), several[owner]]).astype(np.int64)
        at = np.concatenate([windows, start[several[owner]] + offset]).astype(np.int64)
        out = {c: [] for c, _ in SPANS}
        for b in np.unique(block[gone]).tolist():
            mine = block[gone] == b
            packed = _zip(*_window_runs(doc[gone[mine]], at[mine]))
            for name, value in zip(out, (b, *packed), strict=True):
                out[name].append(value)
        return pa.table([pa.array(out[c], t) for c, t in SPANS], names=[c for c, _ in SPANS])

    def cut(left, right):
        ids, texts, *_ = _ordered(left)
        spans = [np.concatenate([np.zeros(0, np.int64), *(_unzip(x, np.int64) for x in right.column(c).to_pylist())]) for c in ("doc", "first", "after")]
        order = np.argsort(spans[0], kind="stable")
        doc, first, after = (s[order] for s in spans)
        edges = np.searchsorted(doc, np.arange(len(ids) + 1))
        out = {"n": [], "gone": [], "kept": [], "spans": []}
        for k, text in enumerate(texts):
            a, b = edges[k], edges[k + 1]
            if a == b:
                begin = end = np.zeros(0, np.int64)
            else:
                change = np.bincount(first[a:b], minlength=len(text) + 1) - np.bincount(after[a:b] + width - 1, minlength=len(text) + 1)
                begin, end = runs(np.cumsum(change[:-1]) > 0)
            edge = [0, *np.stack([begin, end], 1).ravel().tolist(), len(text)]
            out["n"].append(len(text))
            out["gone"].append(int((end - begin).sum()))
            out["kept"].append(b"".join(text[x:y] for x, y in zip(edge[::2], edge[1::2], strict=True)))
            out["spans"].append([{"from": int(x), "to": int(y)} for x, y in zip(begin, end, strict=True)])
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        return pa.table([pa.array(ids, left.column("doc_id").type), pa.array(out["n"], pa.int64()), pa.array(out["gone"], pa.int64()), pa.array(out["kept"], pa.binary()), pa.array(out["spans"], span)],
                        names=["doc_id", "n_bytes", "n_removed", "kept", "spans"])

    answers = repeated(blocks, n, keys_of)
    by_block = blocks.groupBy("_block")
    sent = by_block.cogroup(answers.groupBy("_block")).applyInArrow(send, SENT_DDL)
    judged = sent.groupBy("_shard").applyInArrow(judge, SPANS_DDL)
    schema = f"doc_id {kind}, n_bytes long, n_removed long, kept binary, spans array<struct<from: long, to: long>>"
    return by_block.cogroup(judged.groupBy("_block")).applyInArrow(cut, schema)


def digest(docs: DataFrame) -> DataFrame:
    out = remove_earlier(docs)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict, width: int = WIDTH) -> dict:
    """What digest() returns, by a set of all strings seen so far; for tests."""
    seen, out = set(), {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for a in range(len(data) - width + 1):
            if (part := hash(data[a : a + width])) in seen:
                gone[a : a + width] = True
            seen.add(part)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])
        out[i] = (len(data), int(gone.sum()), len(runs(gone[:-1])[0]), hashlib.sha256(kept).hexdigest())
    return out
