"""Which keys occur more than once in a table, answered for each block of its rows.

Rows are dealt into blocks of a few megabytes. A block's distinct keys are sorted, cut by range into buckets and sent as
compressed arrays; a bucket counts what it gets from all blocks and answers each block with its repeated keys. A key comes
at most once from a block, so however frequent it is, a bucket gets at most one entry for each block.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20


def in_blocks(rows: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES, by: list[str] | None = None) -> tuple[DataFrame, int]:
    """The rows with `_block`, dealt by it, and the number of blocks. Rows equal in `by` (all columns) share a block."""
    size = rows.agg(F.sum(F.octet_length(text) + F.lit(16))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    block = F.pmod(F.xxhash64(*(by or rows.columns)), F.lit(n)).cast("int")
    return rows.withColumn("_block", block).repartition(n, "_block"), n


def pack(values: np.ndarray, delta: bool = True) -> bytes:
    """Sorted 64-bit values as differences, byte planes apart, compressed."""
    if delta and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype=np.uint64, delta: bool = True) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    values = np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).ravel()
    return np.cumsum(values, dtype=dtype) if delta else values


def _bucket_edges(n: int) -> np.ndarray:
    return np.array([(i << 64) // n for i in range(1, n)], np.uint64)


def repeated(blocks: DataFrame, n: int, keys_of) -> DataFrame:
    """(_block, keys binary, counts binary): the keys of each block that occur more than once in the whole table.

    keys_of(table) gives a block's keys as uint64, with repetitions. Counts are over the whole table.
    """

    def send(key, table):
        keys, counts = np.unique(keys_of(table), return_counts=True)
        edges = np.searchsorted(keys, _bucket_edges(n))
        spans = [(i, a, b) for i, (a, b) in enumerate(zip([0, *edges], [*edges, len(keys)], strict=True)) if b > a]
        counts = counts.astype(np.uint32)
        return pa.table({
            "_bucket": pa.array([i for i, _, _ in spans], pa.int32()), "_block": pa.array([key[0].as_py()] * len(spans), pa.int32()),
            "keys": pa.array([pack(keys[a:b]) for _, a, b in spans], pa.binary()),
            "counts": pa.array([pack(counts[a:b], False) for _, a, b in spans], pa.binary()),
        })

    def count(key, table):
        blocks_here = table.column("_block").to_pylist()
        parts = [unpack(x) for x in table.column("keys").to_pylist()]
        lengths = np.array([len(x) for x in parts])
        keys = np.concatenate(parts)
        of_key = np.concatenate([unpack(x, np.uint32, False) for x in table.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]) != 0)
        totals = np.add.reduceat(of_key[order], first)
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(totals, np.diff(np.append(first, len(keys))))
        keep = total > 1
        out, at = {"_block": [], "keys": [], "counts": []}, 0
        for block, length in zip(blocks_here, lengths, strict=True):
            mine = slice(at, at + length)
            at += length
            if (chosen := keep[mine]).any():
                out["_block"].append(block)
                out["keys"].append(pack(keys[mine][chosen]))
                out["counts"].append(pack(np.minimum(total[mine][chosen], 2**32 - 1).astype(np.uint32), False))
        return pa.table({"_block": pa.array(out["_block"], pa.int32()), "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    sent = blocks.groupBy("_block").applyInArrow(send, "_bucket int, _block int, keys binary, counts binary")
    return sent.groupBy("_bucket").applyInArrow(count, "_block int, keys binary, counts binary")


def gathered(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's repeated keys, sorted, and their counts."""
    parts = sorted(((unpack(k), c) for k, c in zip(answers.column("keys").to_pylist(), answers.column("counts").to_pylist(), strict=True)), key=lambda p: int(p[0][0]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    return np.concatenate([k for k, _ in parts]), np.concatenate([unpack(c, np.uint32, False) for _, c in parts])


def found(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each key its place in the sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)
