"""Exact Jaccard join of word shingle sets: size-banded tiles, hashed bitmap signatures, then sorted-array intersection.

Equal sets are one class from the start. A class offers the shingles of its prefix: of n shingles in order of document
frequency, as many of the rarest as must contain one that any linked set shares. A tile holds the classes of one size band and
the band below that share such a shingle. In a tile the bits that one signature has and the other lacks bound the overlap from
above; pairs that pass are intersected exactly.
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import memory
from kindred.llm.blocks import BLOCK_BYTES, found, gathered, in_blocks, repeated
from kindred.llm.components import components
from kindred.llm.hashing import chunks, hash_words, rolling, split_words
from kindred.session import materialize

WIDTH, PERCENT = 3, 90
MOST_BITS = 16
TILE_ROWS = 4096
CELL_ROWS = 512
# Bits of a counted shingle beyond those that number the bytes of the table.
COUNT_BITS = 18
# Bytes of texts whose shingle arrays are held at once, and signatures that are compared at once.
SETS_BYTES = 8 << 20
ROWS_AT_ONCE = 256
KEYS_SEEN = 100_000


def shingle_sets(texts: list, width: int):
    """For every text the sorted distinct 64-bit shingle hashes; fewer words than `width` are one shingle, none are none.

    A-Z are lower-cased. Two different shingles of one text collide with a chance of 2**-64.
    """
    for _, data in chunks(texts):
        buffer, starts, ends, first = split_words([x.lower() for x in data])
        words = hash_words(buffer, starts, ends)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield np.unique(rolling(words[a:b], min(width, b - a))) if b > a else np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def linked(a: int, b: int, common: int, percent: int) -> bool:
    """100 * intersection >= percent * union."""
    return (100 + percent) * common >= percent * (a + b)


def _linked_sets(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    return linked(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True)), percent)


def band_limits(percent: int, top: int = 1 << 40) -> np.ndarray:
    """Lower limits of the size bands: linked sets are in the same band or in neighbouring ones."""
    out = [1]
    while out[-1] < top:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


def signature(shingles: np.ndarray) -> bytes:
    """A bitmap with two to four bits for each shingle, as far as MOST_BITS go."""
    bits = np.zeros(1 << min(MOST_BITS, max(8, (2 * len(shingles) - 1).bit_length())), np.uint8)
    bits[(shingles & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _folded(bits: bytes, width: int) -> np.ndarray:
    """The bitmap that fewer bits would have given."""
    out = np.frombuffer(bits, np.uint8)
    while len(out) > width:
        out = out[: len(out) // 2] | out[len(out) // 2 :]
    return out


class Tile:
    """Sizes and signatures of a tile's classes."""

    def __init__(self, n: np.ndarray, bits: list[bytes], percent: int) -> None:
        width = min(map(len, bits))
        self.n, self.percent = n, percent
        self.bits = np.stack([_folded(b, width) for b in bits]).view(np.uint64)

    def passing(self, k: int, others: np.ndarray) -> np.ndarray:
        """Which of the other rows can be linked with row k, by size and by the bound on the overlap.

        A bit that one signature has and the other lacks stands for a shingle at least that is not shared.
        """
        if len(others) > ROWS_AT_ONCE:
            return np.concatenate([self.passing(k, others[a : a + ROWS_AT_ONCE]) for a in range(0, len(others), ROWS_AT_ONCE)])
        n, m = self.n[k], self.n[others]
        only_n = np.bitwise_count(self.bits[k] & ~self.bits[others]).sum(1, dtype=np.int64)
        only_m = np.bitwise_count(self.bits[others] & ~self.bits[k]).sum(1, dtype=np.int64)
        most = np.minimum(n - only_n, m - only_m)
        return (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)) & linked(n, m, most, self.percent)

    def forest(self) -> list[tuple[int, int]]:
        """Pairs that connect everything which passing pairs connect."""
        out, free = [], np.arange(len(self.n))
        while len(free) > 1:
            queue, free = [int(free[0])], free[1:]
            while queue and len(free):
                k = queue.pop()
                mask = self.passing(k, free)
                if mask.any():
                    got = free[mask].tolist()
                    out.extend((k, g) for g in got)
                    queue.extend(got)
                    free = free[~mask]
        return out


def _tiles(batches, column: str, percent: int):
    """(table, tile) for each run of equal values in batches sorted by the column; runs of one row are left out."""
    held = None
    for batch in _and_end(batches):
        table = held if batch is None else pa.Table.from_batches([batch])
        if batch is not None and held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        if table is None or not table.num_rows:
            continue
        edges = np.flatnonzero(np.concatenate([[True], np.diff(table.column(column).to_numpy()) != 0, [True]]))
        held = table.slice(edges[-2])
        for start, end in zip(edges[: None if batch is None else -2], edges[1 : None if batch is None else -1], strict=False):
            if end - start > 1:
                part = table.slice(start, end - start)
                yield part, Tile(part.column("n").to_numpy(), part.column("bits").to_pylist(), percent)


def _and_end(batches):
    yield from batches
    yield None


def _pairs(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.binary()), pa.array([max(p) for p in pairs], pa.binary())], names=["a", "b"])


def classes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, key (16 bytes of the set's digest, null for an empty set) and the text's MD5 of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def sign(batches):
        for batch in batches:
            signed = [(len(s), set_key(s)) for s in shingle_sets(batch.column(1).to_pylist(), width)]
            columns = [batch.column(0), pa.array([n for n, _ in signed], pa.int64()), pa.array([k for _, k in signed], pa.binary()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "key", "text_md5"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.md5("text").alias("text_md5"))
    return rows.mapInArrow(sign, f"doc_id {kind}, n_shingles long, key binary, text_md5 string")


def _distinct_texts(docs: DataFrame, width: int) -> DataFrame:
    """(key, compressed text) with one text of each class. A task sends few copies of a class, an aggregate leaves one."""

    def first(batches):
        seen: set = set()
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            if len(seen) > KEYS_SEEN:
                seen.clear()
            keep, texts = [], batch.column(0).to_pylist()
            for text, shingles in zip(texts, shingle_sets(texts, width), strict=True):
                if len(shingles) and (key := set_key(shingles)) not in seen:
                    seen.add(key)
                    keep.append((key, press.compress(text)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keep], pa.binary()), pa.array([t for _, t in keep], pa.binary())], names=["key", "text"])

    sent = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(first, "key binary, text binary")
    return materialize(sent.groupBy("key").agg(F.first("text").alias("text")))


def candidates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """key, n, band, bits, compressed text and the prefix tokens that other classes have too, of each class that has such tokens.

    Shingles are counted by some leading bits of their hashes: any order of the shingles will do for the prefix if it is the same
    everywhere, and shorter keys take less space. There are enough bits that few shingles seem frequent by chance, at any size
    of the table.
    """
    blocks, n_blocks = in_blocks(_distinct_texts(docs, width), block_bytes=BLOCK_BYTES // 3, by=["key"])  # compressed to about a third
    limits = band_limits(percent)
    dropped = np.uint64(max(0, 64 - COUNT_BITS - (n_blocks * BLOCK_BYTES).bit_length()))

    def sets_of(table):
        first: dict = {}
        for key, text in zip(table.column("key").to_pylist(), table.column("text").to_pylist(), strict=True):
            first.setdefault(key, text)
        return first, _sets(first.values(), width)

    def keys_of(table):
        return np.concatenate([np.zeros(0, np.uint64), *(s >> dropped << dropped for s in sets_of(table)[1])])

    def prefix(left, right):
        shared, df = gathered(right)
        out = []
        first, sets = sets_of(left)
        for (key, text), shingles in zip(first.items(), sets, strict=True):
            n = len(shingles)
            at = found(shingles >> dropped << dropped, shared)
            count = np.where(at >= 0, df[at] if len(df) else 1, 1)
            length = n - -(-percent * n // 100) + 1
            chosen = np.lexsort((shingles, count))[:length]
            chosen = chosen[count[chosen] > 1]
            if len(chosen):
                band = int(np.searchsorted(limits, n, "right"))
                out.append((key, n, band, shingles[chosen].view(np.int64).tolist(), signature(shingles), text))
        columns = list(zip(*out)) if out else [()] * 6
        kinds = [pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["key", "n", "band", "tokens", "bits", "text"])

    answers = repeated(blocks, n_blocks, keys_of)
    schema = "key binary, n long, band int, tokens array<long>, bits binary, text binary"
    return blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(prefix, schema)


def _sets(texts, width: int):
    """Shingle sets of compressed texts."""
    unpress = zstandard.ZstdDecompressor().decompress
    return shingle_sets([unpress(text) for text in texts], width)


def _some(weights: list[int]):
    """Slices of neighbouring places that weigh about SETS_BYTES together."""
    start, total = 0, 0
    for k, weight in enumerate(weights):
        if total and total + weight > SETS_BYTES:
            yield start, k
            start, total = k, 0
        total += weight
    if start < len(weights):
        yield start, len(weights)


class SetsOf:
    """Shingle sets of compressed texts, made when asked for; those asked for last are held, of about SETS_BYTES of text."""

    def __init__(self, texts: list[bytes], width: int) -> None:
        self.texts, self.width = texts, width
        self.held: dict[int, np.ndarray] = {}
        self.bytes = 0

    def __getitem__(self, k: int) -> np.ndarray:
        if k in self.held:
            self.held[k] = self.held.pop(k)
            return self.held[k]
        (own,) = _sets([self.texts[k]], self.width)
        self.held[k] = own
        self.bytes += own.nbytes
        while self.bytes > SETS_BYTES and len(self.held) > 2:
            self.bytes -= self.held.pop(next(iter(self.held))).nbytes
        return own


def _verified(pairs: DataFrame, classes_: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sorted shingle arrays are linked. The arrays are made again from the texts, which are smaller."""

    def check(batches):
        for batch in batches:
            sizes = [sum(map(zstandard.frame_content_size, texts)) for texts in zip(*(batch.column(i).to_pylist() for i in (2, 3)), strict=True)]
            for start, end in _some(sizes):
                rows = list(zip(*(batch.slice(start, end - start).column(i).to_pylist() for i in range(4)), strict=True))
                texts = {k: t for a, b, x, y in rows for k, t in ((a, x), (b, y))}
                sets = dict(zip(texts, _sets(texts.values(), width), strict=True))
                yield _pairs([(a, b) for a, b, _, _ in rows if _linked_sets(sets[a], sets[b], percent)])

    left = classes_.select(F.col("key").alias("a"), F.col("text").alias("x"))
    right = classes_.select(F.col("key").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary")


def _components(edges: DataFrame) -> DataFrame:
    """Components of materialised edges. Their many rounds need no Python worker, so these first give back what they hold."""
    memory.give_back(edges.sparkSession)
    return components(edges)


def links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, tile_rows: int = TILE_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Verified links (a, b) between set keys that connect exactly what all links connect.

    First every tile, in parts of about `tile_rows`, offers a forest of its passing pairs. Of these each class's smallest partner
    is verified, then one pair for every two components that pairs still join. Tiles that then hold several components are
    compared in full, in cells of two parts of about `cell_rows` rows: passing pairs across components are intersected in the
    cell until their components meet.
    """
    found_ = materialize(candidates(docs, width, percent))
    bits = found_.select("key", "n", "bits")
    rows = found_.select("key", "band", F.explode("tokens").alias("token"))
    rows = rows.select("key", F.explode(F.array(F.xxhash64("token", "band"), F.xxhash64("token", F.col("band") + 1))).alias("tile"))
    # Near copies share many shingles that nobody else has: of tiles with the same classes one is enough.
    members = rows.groupBy("tile").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
    tiles = members.where("rows > 1").groupBy("rows", "x", "y").agg(F.min("tile").alias("tile")).select("tile", "rows")
    rows = materialize(rows.join(tiles, "tile"))

    def offer(batches):
        out = []
        for table, tile in _tiles(batches, "part", percent):
            keys = table.column("key").to_pylist()
            out.extend((keys[i], keys[j]) for i, j in tile.forest())
            if len(out) > 5000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    part = F.xxhash64("tile", F.pmod(F.xxhash64("key"), F.ceil(F.col("rows") / tile_rows))).alias("part")
    parts = rows.select("key", part).join(bits, "key").repartition("part").sortWithinPartitions("part", "key")
    pairs = materialize(parts.mapInArrow(offer, "a binary, b binary").distinct())

    nearest = materialize(_verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), found_, width, percent))
    roots = _components(nearest)
    ends = pairs
    for end in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    apart = ends.where("root_a <> root_b").groupBy(F.least("root_a", "root_b"), F.greatest("root_a", "root_b")).agg(F.min(F.struct("a", "b")).alias("p"))
    first = materialize(nearest.unionByName(_verified(apart.select("p.a", "p.b"), found_, width, percent)))

    roots = _components(first)
    placed = rows.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    several = placed.groupBy("tile").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("tile")
    sides = F.ceil(F.col("rows") / cell_rows)
    split = placed.join(several, "tile").select("tile", "key", "root", F.pmod(F.xxhash64("key"), sides).alias("side"), sides.alias("sides"))
    cells = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
    cells = cells.select("key", "root", F.xxhash64("tile", F.least("side", "other"), F.greatest("side", "other")).alias("cell"))
    full = cells.join(bits, "key")

    def crossing(batches):
        """Rows of a cell with a passing partner in another component."""
        for table, tile in _tiles(batches, "cell", percent):
            root = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1]
            need = np.zeros(len(root), bool)
            for k in range(len(root) - 1):
                others = np.arange(k + 1, len(root))
                others = others[root[others] != root[k]]
                if len(others):
                    got = others[tile.passing(k, others)]
                    need[got] = True
                    need[k] |= len(got) > 0
            if need.any():
                yield from table.select(["key", "root", "cell"]).filter(pa.array(need)).to_batches()

    wanted = materialize(full.repartition("cell").sortWithinPartitions("cell").mapInArrow(crossing, "key binary, root binary, cell long"))

    def compare(batches):
        for table, tile in _tiles(batches, "cell", percent):
            keys, roots_ = table.column("key").to_pylist(), table.column("root").to_pylist()
            sets = SetsOf(table.column("text").to_pylist(), width)
            parent, out = {r: r for r in roots_}, []

            def top(r, parent=parent):
                while parent[r] != r:
                    parent[r] = parent[parent[r]]
                    r = parent[r]
                return r

            for k in range(len(keys) - 1):
                others = np.arange(k + 1, len(keys))
                for j in others[tile.passing(k, others)].tolist():
                    if (p := top(roots_[k])) != (q := top(roots_[j])) and _linked_sets(sets[k], sets[j], percent):
                        out.append((keys[k], keys[j]))
                        parent[p] = q
            yield _pairs(out)

    arrays = wanted.join(found_.select("key", "n", "bits", "text"), "key").select("key", "root", "cell", "n", "bits", "text")
    second = arrays.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a binary, b binary")
    return materialize(first.unionByName(second).distinct())


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, root (the component's key, null for an empty set) and text_md5 of every row.

    Two rows link when 100 * |intersection| >= percent * |union| of their distinct word shingles; component_id is the smallest
    doc_id reachable by links. Null and empty texts and those of white space have no shingle and link with nothing: their
    component is their own doc_id. Equal texts and repeated rows always link. A null doc_id belongs to a component but never
    names one with other ids. An empty table gives an empty table; other columns are ignored.
    """
    rows = materialize(classes(docs, width))
    roots = _components(links(docs, width, percent)).withColumnRenamed("node", "key")
    placed = rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("_least"))
    named = placed.join(names, "root", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"), "root", "text_md5")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def survivors(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest doc_id; rows without a shingle all stay.

    Rows without an id stay, and so do rows that share the kept id within their component.
    """
    gone = near_duplicates(docs, width, percent).where("root IS NOT NULL AND component_id <> doc_id").select("doc_id", "text_md5").distinct()
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_md5").alias("_gone_md5"))
    return docs.join(gone, (docs["doc_id"] == gone["_gone_id"]) & (F.md5(docs["text"]) == gone["_gone_md5"]), "left_anti")


def brute_force(texts: dict, width: int = WIDTH, percent: int = PERCENT) -> dict:
    """doc_id -> (n_shingles, component_id) from all pairs; for tests."""
    import re

    lower = {i: chr(i + 32) for i in range(65, 91)}
    sets = {}
    for i, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in texts if sets[i])
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((top(i), top(j)))
                parent[q] = p
    return {i: (len(sets[i]), top(i)) for i in texts}
