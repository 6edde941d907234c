"""Exact deduplication by a Grace hash: records are dealt by hash, and dealt again into spill files until a bucket fits a table.

The first partitioning is a Spark shuffle. Inside a task records that do not fit the memory bound go to anonymous spill
files by further hash bits, recursively; a bucket that fits is folded into an open-addressing table that compares complete
contents. Copies are folded before the shuffle and again before spilling, so a group of copies of any size stays one record.
"""

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kindred.llm.hashing import WHITE

WHITE_BYTES = bytes(np.flatnonzero(WHITE).tolist())
TABLE_BYTES = 64 << 20
PARTITION_BYTES = 64 << 20
FAN_OUT_BITS = 4
RECORD = "hash long, sha string, content binary, points long, id {kind}, n long"


class Table:
    """Open addressing with linear probing; a slot is a match only if hash and complete content agree."""

    def __init__(self) -> None:
        self.slots = [-1] * 64
        self.entries: list[list] = []
        self.size = 0

    def fold(self, hash_: int, sha: str, content: bytes, points: int, id_, n: int) -> None:
        at = self._find(hash_, content)
        if self.slots[at] < 0:
            self.slots[at] = len(self.entries)
            self.entries.append([hash_, sha, content, points, id_, n])
            self.size += len(content) + 200
            if 2 * len(self.entries) > len(self.slots):
                self._grow()
            return
        entry = self.entries[self.slots[at]]
        entry[5] += n
        if better(points, id_, entry[3], entry[4]):
            entry[3], entry[4] = points, id_

    def _find(self, hash_: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = hash_ & mask
        while (k := self.slots[at]) >= 0:
            entry = self.entries[k]
            if entry[0] == hash_ and entry[2] == content:
                return at
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        for k, entry in enumerate(self.entries):
            mask = len(self.slots) - 1
            at = entry[0] & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def better(points: int, id_, than_points: int, than_id) -> bool:
    """More code points win, then the smaller id; a null id comes after all others."""
    if points != than_points:
        return points > than_points
    return id_ is not None and (than_id is None or id_ < than_id)


def grace(records: Iterable[tuple], limit: int, level: int = 0) -> Iterator[list]:
    """Folded records with distinct contents, holding at most about `limit` bytes of them at a time."""
    table, files, count = Table(), None, [0] * (1 << FAN_OUT_BITS)
    shift = 59 - FAN_OUT_BITS * level
    for record in records:
        table.fold(*record)
        if table.size > limit and shift >= 0 and len(table.entries) > 1:
            files = files or [tempfile.TemporaryFile() for _ in count]
            for entry in table.entries:
                part = (entry[0] >> shift) & (len(count) - 1)
                count[part] += 1
                _write(files[part], entry)
            table = Table()
    if files is None:
        yield from table.entries
        return
    for entry in table.entries:
        part = (entry[0] >> shift) & (len(count) - 1)
        count[part] += 1
        _write(files[part], entry)
    for file, n in zip(files, count, strict=True):
        with file:
            file.seek(0)
            yield from grace(_read(file, n), limit, level + 1)


def _write(file, entry: list) -> None:
    pickle.dump(entry, file, pickle.HIGHEST_PROTOCOL)


def _read(file, n: int) -> Iterator[tuple]:
    for _ in range(n):
        yield tuple(pickle.load(file))  # noqa: S301  the task's own spill file


def _batches(entries: Iterator[list], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for entry in entries:
        held.append(entry)
        size += len(entry[2]) + 100
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def normalised(text: bytes | None) -> bytes:
    return b"" if text is None else text.translate(None, WHITE_BYTES)


def _sha():
    """The digest of the normalised text as a column."""
    return F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "").cast("binary"), 256)


def classes(docs: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct normalised text: sha, keep_id, points, group_size."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("points"))
    record = RECORD.format(kind=kind)
    schema = to_arrow_schema(StructType.fromDDL(record))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def records(batches):
        for batch in batches:
            for id_, text, points in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                content = normalised(text)
                yield xxhash.xxh64_intdigest(content) >> 1, hashlib.sha256(content).hexdigest(), content, points, id_, 1

    def fold_before(batches):
        def entries():
            table = Table()
            for record in records(batches):
                table.fold(*record)
                if table.size > limit:
                    yield from table.entries
                    table = Table()
            yield from table.entries
        yield from _batches(entries(), schema)

    def fold_after(batches):
        def all_records():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)
        yield from _batches(grace(all_records(), limit), schema)

    partitions = max(1, -(-int(size) // PARTITION_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, -(-int(size) // (1 << 20))))
    dealt = rows.mapInArrow(fold_before, record).repartition(partitions, "hash")
    return dealt.mapInArrow(fold_after, record).select("sha", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))


def deduplicate(docs: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """For every row: keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical after deleting spaces, tabs and line ends. Of a group the row with the most code
    points in its original text stays, then the smallest doc_id. A null text counts as empty and is equal to texts of white
    space only. Of repeated rows with one doc_id each is returned; the one id is kept. A null doc_id stays only if all ids of
    its group with that length are null. An empty table gives an empty table; other columns are ignored.
    """
    rows = docs.select("doc_id", _sha().alias("text_sha256"))
    found = classes(docs, limit).withColumnRenamed("sha", "text_sha256")
    return rows.join(found, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def survivors(docs: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, with all their columns; of repeated rows with the kept id one stays."""
    keys = docs.withColumn("_sha", _sha())
    found = classes(docs, limit).select(F.col("sha").alias("_sha"), F.col("keep_id").alias("_keep"))
    stay = keys.join(found, (keys["_sha"] == found["_sha"]) & keys["doc_id"].eqNullSafe(found["_keep"]), "left_semi")
    return stay.dropDuplicates(["doc_id", "_sha"]).drop("_sha")
