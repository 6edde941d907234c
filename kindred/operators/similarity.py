"""Sparse vector products, spread over tasks by rows.

Exact scores of every target against every candidate are a matrix product. Grouping the cells by a
shared dimension would emit one row per co-occurring pair, and a dimension that a third of all rows
share would gather in one task. Here rows are dealt out instead. For the n best, a task holds its share
of the targets and reads all candidates pack by pack; for all pairs, it holds two blocks of rows. A
crowded dimension is spread evenly over the tasks and no pair is shuffled before it is complete.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.ranking import OUTPUT_DIGITS, top_n

TARGET_BLOCK = 512
SENT_BLOCKS = 32  # blocks of targets of a task, beyond what the cores ask for; there are never more tasks than cores
CANDIDATE_BLOCK = 32768
PAIR_ROWS, PAIR_CELLS = 65536, 4_000_000  # rows and cells of a block whose pairs are all formed
PAIR_STRIP = 8_000_000  # products that such a task holds at once
ROWS_OUT = 500_000
PACK_CELLS = 250_000  # cells of the rows that are sent as one pack
LIST_ROWS = 500_000  # rows that are listed for their tasks at once
LONG_VECTOR = 2_000_000
MAX_PARTITIONS = 50_000
ABOVE_ZERO = 5e-324  # the smallest positive number: only zero and negative scores are below it
BARRED = -np.inf  # marks a pair that may not come back
STRIP = 2048
EPSILON = float(np.finfo(float).eps)
_EXPAND = 4_000_000
DENSE_DIMS = 2048  # up to so many dimensions of a task's targets are multiplied as dense rows
DENSE_CELLS = 8_000_000  # dense rows of targets that are kept from strip to strip
FORMED = 16  # what a pair of the inverted index costs, in pairs of a block
EXACT_PAIRS, PAIRS_AT_ONCE = 1_000_000, 4096
WAITING = 200_000  # candidates that are merged into the lists at once


@dataclass(frozen=True)
class Extent:
    """Measured size of a set of vectors."""

    rows: int
    longest: int
    cells: int = 0
    lowest: float | None = None


def extent(cells: DataFrame, key: str = "id") -> Extent:
    """Number of vectors, length of the longest, number of cells and lowest weight, measured with one small aggregation."""
    row = (
        cells.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("low"))
        .agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("longest"), F.coalesce(F.sum("n"), F.lit(0)).alias("cells"), F.min("low").alias("lowest"))
        .first()
    )
    return Extent(row["rows"], row["longest"], row["cells"], row["lowest"])


def blocks(rows: int, block: int, at_least: int = 1) -> int:
    """Number of blocks: small enough for a task's memory, many enough to use the cores."""
    return max(1, -(-rows // block), min(at_least, rows // 64))


def cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def block_of(column: str, count: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")


def every_block(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))


def by_task(rows: DataFrame, tasks: int):
    """Group by the ``task`` number with one task per partition, so no task waits for two cells of the grid; rows come by ``side``."""
    dealt = rows.repartitionById(min(tasks, MAX_PARTITIONS), "task")
    return (dealt.sortWithinPartitions("task", "side") if "side" in rows.columns else dealt).groupBy("task")


def normed_cells(cells: DataFrame) -> DataFrame:
    """(id, dim, w, norm) with every vector's norm; zero vectors vanish."""
    norms = cells.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return cells.filter("w <> 0").join(norms.filter("norm > 0"), "id").select("id", "dim", "w", "norm")


def settled(total: Column, size: Column, terms: Column) -> Column:
    """A sum of that many terms, 0 where rounding alone may have made it; ``size`` is the sum of the terms' absolute values."""
    return F.when(F.abs(total) <= terms * F.lit(EPSILON) * size, 0.0).otherwise(total)


def pack(cells: DataFrame, scale: bool = False) -> DataFrame:
    """One row per vector: (id, dims, ws), on demand with its norm, by which products are divided. Long vectors are split off before.

    Weights stay as they are: products of whole numbers then cancel exactly, which those of scaled weights do not.
    """
    rows = cells.groupBy("id").agg(
        F.collect_list(F.struct("dim", "w")).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    )
    if not scale:
        return rows.select("id", F.col("v.dim").alias("dims"), F.col("v.w").alias("ws"))
    return rows.filter("norm > 0").select("id", F.col("v.dim").alias("dims"), F.col("v.w").alias("ws"), "norm")


def packs(rows: DataFrame) -> DataFrame:
    """The rows of (id, dims, ws, norm) as compressed Arrow streams in a column ``pack``: what every task reads takes a third of the bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.asarray(batch.column("dims").value_lengths().fill_null(0), dtype=np.int64))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + PACK_CELLS, side="right")))
                yield pa.RecordBatch.from_pydict({"pack": pa.array([_compressed(batch.slice(at, stop - at))], pa.binary())})
                at = stop

    return rows.select("id", *vector(rows)).mapInArrow(run, "pack binary")


def listed(rows: DataFrame) -> DataFrame:
    """(task, list): the rows of each task without its number, sorted, as compressed Arrow streams."""
    names = [c for c in rows.columns if c != "task"]

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("task", *names)])
        tasks, first = np.unique(table.column("task").to_numpy(), return_index=True)
        ends = [*first[1:], table.num_rows]
        table = table.select(names)
        return pa.RecordBatch.from_pydict({
            "task": pa.array(tasks, pa.int32()),
            "list": pa.array([_compressed(table.slice(a, b - a)) for a, b in zip(first, ends)], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= LIST_ROWS:
                yield told(held)
                held, size = [], 0
        if held:
            yield told(held)

    return rows.select(F.col("task").cast("int").alias("task"), *names).mapInArrow(run, "task int, list binary")


def _compressed(rows: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write(rows)
    return sink.getvalue().to_pybytes()


def unpacked(pack: bytes) -> pa.Table:
    return pa.ipc.open_stream(pack).read_all()


def unpack(table: pa.Table, lists: str, values: str | None = None):
    """Row number, flat keys and flat values of list columns."""
    column = table.column(lists).combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    keys = column.flatten().to_numpy(zero_copy_only=False)
    if values is None:
        return rows, keys, None
    return rows, keys, table.column(values).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def block_product(na, left, nb, right) -> np.ndarray:
    """Dense na x nb products of two blocks of sparse rows given as (row, dim, weight).

    Dimensions that fill much of both blocks go through a dense product, the others through an
    expansion of their matching cells in slices of bounded size.
    """
    out = np.zeros((na, nb))
    (ra, da, wa), (rb, db, wb) = left, right
    if not len(da) or not len(db):
        return out
    codes, names = pd.factorize(np.concatenate([da, db]))
    ca, cb = codes[: len(da)], codes[len(da):]
    in_a, in_b = np.bincount(ca, minlength=len(names)), np.bincount(cb, minlength=len(names))
    crowded = in_a * in_b > na * nb / 32
    for some in np.array_split(np.flatnonzero(crowded), max(1, -(-int(crowded.sum()) // 1024))):
        if not len(some):
            continue
        place = np.full(len(names), -1)
        place[some] = np.arange(len(some))
        dense_a, dense_b = np.zeros((na, len(some))), np.zeros((nb, len(some)))
        keep_a, keep_b = place[ca] >= 0, place[cb] >= 0
        dense_a[ra[keep_a], place[ca[keep_a]]] = wa[keep_a]
        dense_b[rb[keep_b], place[cb[keep_b]]] = wb[keep_b]
        out += dense_a @ dense_b.T
    rest_a = ~crowded[ca] & (in_b[ca] > 0)
    ra, ca, wa = ra[rest_a], ca[rest_a], wa[rest_a]
    if len(ca):
        order = np.argsort(cb, kind="stable")
        rb, wb = rb[order], wb[order]
        start = np.concatenate([[0], np.cumsum(in_b)])
        reach = in_b[ca]
        edges = np.concatenate([[0], np.cumsum(reach)])
        flat, at = out.reshape(-1), 0
        while at < len(ca):
            stop = max(at + 1, int(np.searchsorted(edges, edges[at] + _EXPAND, side="right")) - 1)
            many = reach[at:stop]
            owner = np.repeat(np.arange(at, stop), many)
            offset = np.arange(len(owner)) - np.repeat(edges[at:stop] - edges[at], many)
            match = start[ca[owner]] + offset
            np.add.at(flat, ra[owner] * nb + rb[match], wa[owner] * wb[match])
            at = stop
    return out


def block_scores(na, left, left_norms, nb, right, right_norms) -> np.ndarray:
    """Products of two blocks, divided by the vectors' norms where there are some.

    A sum that is within the rounding error of its own terms counts as 0. Only where weights differ in sign can terms cancel.
    """
    out = block_product(na, left, nb, right)
    if (left[2] < 0).any() or (right[2] < 0).any():
        size = block_product(na, (left[0], left[1], np.abs(left[2])), nb, (right[0], right[1], np.abs(right[2])))
        terms = min(np.bincount(side[0]).max(initial=0) for side in (left, right))
        out[np.abs(out) <= terms * EPSILON * size] = 0.0
    if left_norms is not None:
        out /= left_norms[:, None]
        out /= right_norms[None, :]
    return out


def norms_of(table: pa.Table) -> np.ndarray | None:
    return table.column("norm").to_numpy() if "norm" in table.column_names else None


def order_keys(scores: np.ndarray) -> np.ndarray:
    """Scores as the ranking compares them: rounded to 9 digits, in units of the last. Any finite score and -inf are fine."""
    return np.rint(scores * 1e9)


def best_mask(scores: np.ndarray, n: int) -> np.ndarray:
    """Which n columns of each row are best by rounded score, ties to the lower column."""
    width = scores.shape[-1]
    if width <= n:
        return np.ones(scores.shape, bool)
    keys = order_keys(scores)
    last = np.partition(keys, width - n, axis=-1)[..., width - n, None]
    mask = keys >= last
    tied = np.flatnonzero(mask.sum(-1) > n)
    if len(tied):
        above = keys[tied] > last[tied]
        equal = keys[tied] == last[tied]
        room = n - above.sum(-1, keepdims=True)
        mask[tied] = above | (equal & (np.cumsum(equal, -1) <= room))
    return mask


def best_columns(scores: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n best columns of each row, ties to the lower column, in ascending order."""
    width = scores.shape[-1]
    if width <= n:
        return np.broadcast_to(np.arange(width), scores.shape)
    return np.nonzero(best_mask(scores, n))[-1].reshape(len(scores), n)


def sides(table: pa.Table) -> tuple[pa.Table, pa.Table, pa.Table]:
    """Targets, candidates sorted by id (a lower position is a lower id) and masked pairs of a task."""
    side = table.column("side").combine_chunks().to_numpy(zero_copy_only=False)
    targets, candidates, masked = (table.filter(pa.array(side == s)) for s in (0, 1, 2))
    return targets, candidates.sort_by("cid"), masked


def scores_table(target_ids, item_ids, scores, like: pa.Table) -> pa.Table:
    return pa.table({
        "target_id": pa.array(target_ids, type=like.schema.field("tid").type),
        "item_id": pa.array(item_ids, type=like.schema.field("cid").type),
        "score": pa.array(scores, type=pa.float64()),
    })


def encode(left, right):
    """The same sparse rows with dimensions as small integers that both sides share."""
    codes = pd.factorize(np.concatenate([left[1], right[1]]))[0].astype(np.int32)
    cut = len(left[1])
    return (left[0], codes[:cut], left[2]), (right[0], codes[cut:], right[2])


class _Best:
    """The n best candidates found so far for every target of a task, by rounded score, ties to the lower id."""

    def __init__(self, targets: int, n: int):
        self.n, self.waiting, self.size = n, [], 0
        self.keys, self.scores = np.full((targets, n), BARRED), np.zeros((targets, n))
        self.ids = None
        self.bars = np.full(targets, BARRED)  # the rounded score that a further candidate has to reach

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        keys = order_keys(scores)
        some = keys >= self.bars[rows]
        if some.any():
            self.waiting.append((rows[some], ids[some], scores[some], keys[some]))
            self.size += len(self.waiting[-1][0])
            if self.size > max(WAITING, self.scores.size // 2):
                self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        rows, ids, scores, keys = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.size = [], 0
        if self.ids is None:
            self.ids = np.zeros(self.scores.shape, dtype=ids.dtype)
        elif self.ids.dtype != ids.dtype:
            self.ids = self.ids.astype(np.result_type(self.ids, ids))
        known = np.unique(rows)
        at, place = np.nonzero(self.keys[known] > BARRED)
        at = known[at]
        rows, ids = np.concatenate([rows, at]), np.concatenate([ids, self.ids[at, place]])
        scores, keys = np.concatenate([scores, self.scores[at, place]]), np.concatenate([keys, self.keys[at, place]])
        order = np.lexsort((_ordered(ids), -keys, rows))
        place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order], side="left")
        order, place = order[place < self.n], place[place < self.n]
        rows = rows[order]
        self.keys[rows, place], self.scores[rows, place], self.ids[rows, place] = keys[order], scores[order], ids[order]
        self.bars[known] = self.keys[known, self.n - 1]


def _stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every stretch, one after the other."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _ordered(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids."""
    return ids if ids.dtype.kind in "iuf" else pd.factorize(ids, sort=True)[0]


def _filled(cells: tuple, rows: int, codes: int) -> np.ndarray:
    """Sparse rows (row, code, weight) as a dense matrix."""
    return np.bincount(cells[0] * codes + cells[1], cells[2], minlength=rows * codes).reshape(rows, codes)


class _Targets:
    """The targets of a task, to which candidates are shown pack by pack.

    Where targets have few dimensions, products of single precision leave out what stays below the bar of its target by more than
    their error; only the others are multiplied exactly. Many dimensions that few rows share go through an inverted index of the
    targets, so only pairs that share one are formed. Anything else is multiplied block by block.
    """

    def __init__(self, table: pa.Table, barred: tuple | None, n: int, floor: float | None, clip: tuple | None, skip_self: bool):
        self.ids, self.norms = table.column("tid").to_numpy(), norms_of(table)
        rows, dims, weights = unpack(table, "dims", "ws")
        codes, names = pd.factorize(dims)
        self.cells, self.index = (rows, codes, weights), pd.Index(names)
        self.edges = np.searchsorted(rows, np.arange(len(self.ids) + 1))
        self.signed = bool((weights < 0).any())
        self.floor, self.clip, self.out = floor, clip, None
        if skip_self or barred is not None:
            mine = [(np.arange(len(self.ids)), self.ids)] if skip_self else []
            self._barred(*map(list, zip(*mine, *([barred] if barred is not None else []))))
        self.n, self.best = n, _Best(len(self.ids), n)
        self.lengths = np.sqrt(np.bincount(rows, weights * weights, minlength=len(self.ids)))
        self.lengths[self.lengths == 0] = 1.0
        self.smallest = _smallest(rows, weights, self.lengths)
        self.by_code = None
        self.kept = {} if len(self.ids) * len(names) <= DENSE_CELLS else None

    def show(self, pack: pa.Table) -> None:
        ids, norms = pack.column("id").to_numpy(), norms_of(pack)
        rows, dims, weights = unpack(pack, "dims", "ws")
        codes = self.index.get_indexer(dims)
        lengths = np.sqrt(np.bincount(rows, weights * weights, minlength=len(ids)))
        known = codes >= 0
        cells = rows[known], codes[known], weights[known]
        places = None if self.out is None else self.out[2].get_indexer(ids)
        signed = self.signed or bool((weights < 0).any())
        # Products of the smallest weights do not vanish in single precision, so one that is 0 there is 0.
        self.plain = not signed and self.floor is not None and self.floor > 0 and self.smallest * _smallest(rows, weights, lengths) > 1e-36
        for start in range(0, len(ids), STRIP):
            ends = np.searchsorted(cells[0], [start, start + STRIP])
            part = slice(*ends)
            strip = cells[0][part] - start, cells[1][part], cells[2][part]
            some = slice(start, start + STRIP)
            found = None if places is None else self._met(places[some])
            own = (ids[some], strip, None if norms is None else norms[some], lengths[some], signed, found)
            if self._sparse(*own[:2]):
                self._by_index(*own)
            else:
                self._by_blocks(*own)

    def _sparse(self, ids: np.ndarray, strip: tuple) -> bool:
        if len(self.index) <= DENSE_DIMS or self.floor is None or self.floor <= 0:
            return False
        if self.by_code is None:
            order = np.argsort(self.cells[1], kind="stable")
            self.by_code = self.cells[0][order], self.cells[2][order], np.concatenate([[0], np.cumsum(np.bincount(self.cells[1], minlength=len(self.index)))])
        edges = self.by_code[2]
        return int((edges[strip[1] + 1] - edges[strip[1]]).sum()) * FORMED < len(ids) * len(self.ids)

    def _by_index(self, ids, strip, norms, _, signed, found) -> None:
        """Products of the pairs that share a dimension, for as many candidates at once as meet so many cells."""
        rows, codes, weights = strip
        edges = self.by_code[2]
        many = edges[codes + 1] - edges[codes]
        upto = np.concatenate([[0], np.cumsum(many)])
        bounds = np.searchsorted(rows, np.arange(len(ids) + 1))
        first = 0
        while first < len(ids):
            last = max(first + 1, int(np.searchsorted(upto[bounds], upto[bounds[first]] + _EXPAND, side="right")) - 1)
            part = slice(bounds[first], bounds[last])
            at = _stretches(edges[codes[part]], many[part])
            keys = self.by_code[0][at] * len(ids) + np.repeat(rows[part], many[part])
            terms = self.by_code[1][at] * np.repeat(weights[part], many[part])
            order = np.argsort(keys, kind="stable")
            keys, terms = keys[order], terms[order]
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
            if len(start):
                dots = np.add.reduceat(terms, start)
                if signed:
                    count = np.diff(np.append(start, len(keys)))
                    dots[np.abs(dots) <= count * EPSILON * np.add.reduceat(np.abs(terms), start)] = 0.0
                t, c = np.divmod(keys[start], len(ids))
                keep = dots != 0
                self._offer(t[keep], c[keep], dots[keep], ids, norms, found)
            first = last

    def _barred(self, rows: list[np.ndarray], names: list[np.ndarray]) -> None:
        """Takes the pairs (row of a target, id of a candidate) that may not come back, in the order of the ids."""
        codes, known = pd.factorize(np.concatenate(names), use_na_sentinel=False)
        order = np.argsort(codes, kind="stable")
        self.out = np.concatenate(rows)[order], np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(known)))]), pd.Index(known)

    def _met(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs of some candidates, in the order of the targets; ``places`` are the candidates' among the ids."""
        columns = np.flatnonzero(places >= 0)
        first, last = self.out[1][places[columns]], self.out[1][places[columns] + 1]
        rows, columns = self.out[0][_stretches(first, last - first)], np.repeat(columns, last - first)
        order = np.argsort(rows, kind="stable")
        return rows[order], columns[order]

    @staticmethod
    def _out_of(ends: tuple, found: tuple) -> tuple[np.ndarray, np.ndarray]:
        part = slice(*np.searchsorted(found[0], ends))
        return found[0][part], found[1][part]

    def _offer(self, t, c, dots, ids, norms, found, cleared: bool = False) -> None:
        scores = dots if self.norms is None else dots / self.norms[t] / norms[c]
        if self.clip:
            scores = np.clip(scores, *self.clip)
        keep = scores > BARRED if self.floor is None else scores >= self.floor
        keep &= order_keys(scores) >= self.best.bars[t]
        t, c, scores = t[keep], c[keep], scores[keep]
        if not cleared and len(t) and found is not None:
            rows, columns = self._out_of((t.min(), t.max() + 1), found)
            keep = ~np.isin(t * len(ids) + c, rows * len(ids) + columns)
            t, c, scores = t[keep], c[keep], scores[keep]
        if len(t) > 4 * self.n * TARGET_BLOCK:
            order = np.lexsort((_ordered(ids)[c], -order_keys(scores), t))
            order = order[np.arange(len(order)) - np.searchsorted(t[order], t[order], side="left") < self.n]
            t, c, scores = t[order], c[order], scores[order]
        self.best.add(t, ids[c], scores)

    def _dense(self, ends: tuple, codes: int) -> tuple[np.ndarray, np.ndarray]:
        if self.kept is not None and ends in self.kept:
            return self.kept[ends]
        part = slice(self.edges[ends[0]], self.edges[ends[1]])
        whole = _filled((self.cells[0][part] - ends[0], self.cells[1][part], self.cells[2][part]), ends[1] - ends[0], codes)
        made = whole, (whole / self.lengths[ends[0]: ends[1], None]).astype(np.float32)
        if self.kept is not None:
            self.kept[ends] = made
        return made

    def _by_blocks(self, ids, strip, norms, lengths, signed, found) -> None:
        codes = len(self.index)
        dense = 0 < codes <= DENSE_DIMS
        if dense:
            whole = _filled(strip, len(ids), codes)
            longest = float(lengths.max(initial=0.0)) or 1.0
            scale = longest if norms is None else np.where(lengths > 0, lengths, 1.0)[:, None]
            rough = np.ascontiguousarray((whole / scale).astype(np.float32).T)
            slack = 2.0 * (codes + 8) * 2.0 ** -24
        for first in range(0, len(self.ids), TARGET_BLOCK):
            ends = first, min(first + TARGET_BLOCK, len(self.ids))
            here = slice(*ends)
            if dense:
                mine, ready = self._dense(ends, codes)
                scores = ready @ rough
                unit = self.lengths[here] * longest if norms is None else self.lengths[here] / self.norms[here]
            else:
                part = slice(self.edges[first], self.edges[ends[1]])
                left = self.cells[0][part] - first, self.cells[1][part], self.cells[2][part]
                scores = block_scores(ends[1] - first, left, None if self.norms is None else self.norms[here], len(ids), strip, norms)
                unit, slack = 1.0, 0.0
            if found is not None:
                out = self._out_of(ends, found)
                scores[out[0] - first, out[1]] = BARRED
            least = self._least(self.best.bars[here])
            with np.errstate(invalid="ignore"):
                bars = np.maximum(least / unit - slack - np.abs(least / unit) * 1e-6, -np.finfo(np.float32).max)
            if dense and self.plain:
                bars = np.maximum(bars, np.finfo(np.float32).tiny)
            mask = scores >= bars[:, None].astype(scores.dtype)
            if np.count_nonzero(mask) > 4 * self.n * TARGET_BLOCK and len(ids) > self.n:
                last = np.partition(scores, len(ids) - self.n, axis=1)[:, len(ids) - self.n].astype(np.float64)
                seen = last * unit - slack * unit  # n candidates of this strip score that at least
                least = np.maximum(least, self._least(order_keys(np.clip(seen, *self.clip) if self.clip else seen) - 1))
                with np.errstate(invalid="ignore"):
                    bars = np.maximum(least / unit - slack - np.abs(least / unit) * 1e-6, -np.finfo(np.float32).max)
                if dense and self.plain:
                    bars = np.maximum(bars, np.finfo(np.float32).tiny)
                mask = scores >= bars[:, None].astype(scores.dtype)
            t, c = np.divmod(np.flatnonzero(mask), len(ids))
            for at in range(0, len(t), EXACT_PAIRS):
                rows, columns = t[at: at + EXACT_PAIRS], c[at: at + EXACT_PAIRS]
                if dense:
                    self._offer(rows + first, columns, _products(mine, rows, whole, columns, signed), ids, norms, found, True)
                else:
                    values = scores[rows, columns]
                    self._offer(rows + first, columns, values * (1.0 if norms is None else self.norms[rows + first] * norms[columns]), ids, norms, found, True)

    def _least(self, bars: np.ndarray) -> np.ndarray:
        """The lowest score that the floor and a rounded bar admit; -inf where any is."""
        least = (bars - 0.5) * 1e-9 - np.abs(bars) * 1e-21
        if self.clip:
            least = np.where(least <= self.clip[0], BARRED, least)
        return least if self.floor is None or self.clip and self.floor <= self.clip[0] else np.maximum(least, self.floor)


def _smallest(rows: np.ndarray, weights: np.ndarray, lengths: np.ndarray) -> float:
    """The smallest weight of a row against the longest row, or against its own row where that is less."""
    sizes = np.abs(weights[weights != 0])
    return float(sizes.min() / max(lengths.max(), 1e-300)) if len(sizes) else 1.0


def _products(left: np.ndarray, rows: np.ndarray, right: np.ndarray, columns: np.ndarray, signed: bool) -> np.ndarray:
    """Exact products of pairs of dense rows; one within the rounding error of its own terms counts as 0."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), PAIRS_AT_ONCE):
        a, b = left[rows[at: at + PAIRS_AT_ONCE]], right[columns[at: at + PAIRS_AT_ONCE]]
        dots = np.einsum("ij,ij->i", a, b)
        if signed:
            terms = np.minimum(np.count_nonzero(a, axis=1), np.count_nonzero(b, axis=1))
            dots[np.abs(dots) <= terms * EPSILON * np.einsum("ij,ij->i", np.abs(a), np.abs(b))] = 0.0
        out[at: at + PAIRS_AT_ONCE] = dots
    return out


def _best_of_block(n: int, floor: float | None, clip: tuple | None, skip_self: bool) -> Callable:
    """Best candidates of each target of a task: targets (side 0) and masked pairs (side 2) come first, then packs of candidates,
    of which one at a time is held. Candidates may also come as rows (side 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, masked, rows, targets, kinds = [], [], [], None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            del batch
            side = table.column("side").combine_chunks().to_numpy(zero_copy_only=False)
            for kind, into in ((0, held), (1, rows), (2, masked)):
                if (side == kind).any():
                    if targets is not None:
                        raise RuntimeError("targets came after candidates")
                    into.append(table.filter(pa.array(side == kind)))
            packs = table.column("pack").filter(pa.array(side == 3)) if "pack" in table.column_names else []
            del table
            for pack in packs:
                if targets is None:
                    targets = ready(held, masked)
                if targets is None:
                    continue
                shown = unpacked(pack.as_py())
                kinds = kinds or shown.schema.field("id").type
                targets.show(shown)
                del pack, shown
            del packs
        if rows and (targets := targets or ready(held, masked)) is not None:
            kinds = kinds or rows[0].schema.field("cid").type
            while rows:
                given = rows.pop()
                shown = given.select(["cid", *[c for c in ("dims", "ws", "norm") if c in given.column_names]]).rename_columns({"cid": "id"})
                for at in range(0, given.num_rows, STRIP):
                    targets.show(shown.slice(at, STRIP).combine_chunks())
                del given, shown
        if targets is not None:
            yield from told(targets, kinds)

    def ready(held: list[pa.Table], masked: list[pa.Table]) -> _Targets | None:
        if not held:
            return None
        table = pa.concat_tables(held)
        held.clear()
        barred = None
        if masked:
            rows, ids, _ = unpack(pa.concat_tables(masked), "masked")
            names = pa.concat_tables(masked).column("tid").to_numpy()[rows]
            masked.clear()
            mine = table.column("tid").to_numpy()
            order = np.argsort(mine, kind="stable")
            first, last = (np.searchsorted(mine[order], names, side=s) for s in ("left", "right"))
            owner, ids = order[_stretches(first, last - first)], np.repeat(ids, last - first)
            order = np.argsort(owner, kind="stable")
            barred = owner[order], ids[order]
        made = _Targets(table, barred, n, floor, clip, skip_self)
        made.kind = table.schema.field("tid").type
        return made

    def told(targets: _Targets, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        best = targets.best
        best.merge()
        if best.ids is None:
            return
        step = max(1, ROWS_OUT // best.n)
        for first in range(0, len(targets.ids), step):
            rows, places = np.nonzero(best.keys[first: first + step] > BARRED)
            rows += first
            yield pa.RecordBatch.from_arrays([
                pa.array(targets.ids[rows], type=targets.kind), pa.array(best.ids[rows, places], type=kind),
                pa.array(best.scores[rows, places], type=pa.float64()),
            ], ["target_id", "item_id", "score"])

    return run


def block_topn(
    targets: DataFrame,
    candidates: DataFrame,
    n: int,
    target_rows: int,
    candidate_rows: int,
    exclude: DataFrame | None = None,
    skip_self: bool = False,
    floor: float | None = ABOVE_ZERO,
    clip: tuple | None = None,
    digits: int | None = OUTPUT_DIGITS,
) -> DataFrame:
    """The n best candidates of each target by dot product: (target_id, item_id, score, rank).

    ``targets`` and ``candidates`` are packed vectors (id, dims, ws), both with a norm or both without. Scores below ``floor`` do not count; None keeps
    all. ``exclude`` holds pairs (id, dim) of target and candidate that may not come back.

    A task holds its share of the targets and reads all candidates once, in compressed packs; there are as many tasks as cores. So
    targets are sent once, candidates once a core, and a target's list is complete in its task.
    """
    across = min(blocks(target_rows, SENT_BLOCKS * TARGET_BLOCK, cores(targets)), cores(targets))
    rows = targets.select(
        block_of("id", across).alias("task"), F.lit(0).alias("side"), F.col("id").alias("tid"), *vector(targets),
    )
    if exclude is not None:
        masked = exclude.groupBy(block_of("id", across).alias("task"), F.col("id").alias("tid")).agg(F.collect_set("dim").alias("masked"))
        rows = rows.unionByName(masked.withColumn("side", F.lit(2)), allowMissingColumns=True)
    sent = packs(candidates).select(every_block(across).alias("task"), F.lit(3).alias("side"), "pack")
    best = by_task(rows.unionByName(sent, allowMissingColumns=True), across).applyInArrow(
        _best_of_block(n, floor, clip, skip_self), pair_schema(targets, "id", candidates, "id")
    )
    return top_n(best, n, ["target_id"], digits=digits)


def vector(packed: DataFrame) -> list[str]:
    return [c for c in ("dims", "ws", "norm") if c in packed.columns]


def pair_schema(targets: DataFrame, target: str, items: DataFrame, item: str) -> str:
    kinds = targets.schema[target].dataType.simpleString(), items.schema[item].dataType.simpleString()
    return f"target_id {kinds[0]}, item_id {kinds[1]}, score double"


def _pairs_of_block(strip: int) -> Callable:
    """All pairs of two blocks of rows that are not 0, found and told in strips of the first block with so many products."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        targets, candidates, _ = sides(table)
        target_ids, candidate_ids = targets.column("tid").to_numpy(), candidates.column("cid").to_numpy()
        inside = bool(table.num_rows) and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        kinds = table.schema.empty_table()
        del table
        if not len(target_ids) or not len(candidate_ids):
            return
        left, right = encode(unpack(targets, "dims", "ws"), unpack(candidates, "dims", "ws"))
        codes = max(left[1].max(initial=-1), right[1].max(initial=-1)) + 1
        target_norms, norms = norms_of(targets), norms_of(candidates)
        del targets, candidates
        height = max(1, strip // len(candidate_ids))
        for start in range(0, len(target_ids), height):
            ids_here = target_ids[start: start + height]
            part = slice(*np.searchsorted(left[0], [start, start + len(ids_here)]))
            mine = left[0][part] - start, left[1][part], left[2][part]
            met = np.zeros(codes, bool)
            met[mine[1]] = True
            partners = met[right[1]]
            scores = block_scores(
                len(ids_here), mine, None if target_norms is None else target_norms[start: start + height],
                len(candidate_ids), tuple(x[partners] for x in right), norms,
            )
            rows, columns = np.nonzero(scores)
            ids, others = ids_here[rows], candidate_ids[columns]
            keep = ids < others if inside else np.ones(len(ids), bool)
            ids, others, values = ids[keep], others[keep], scores[rows[keep], columns[keep]]
            swap = ids > others
            found = scores_table(np.where(swap, others, ids), np.where(swap, ids, others), values, kinds)
            yield from found.to_batches(max_chunksize=ROWS_OUT)

    return run


def pair_blocks(size: Extent, at_least: int) -> int:
    """Blocks of rows whose pairs of blocks are tasks: as few as a task's memory allows, as every row is sent once for each."""
    by_cells = -(-(size.cells or size.rows * size.longest) // PAIR_CELLS)
    by_rows = -(-size.rows // PAIR_ROWS)
    return max(1, by_cells, by_rows, min(at_least, size.rows // 64))


def split_long(
    cells: DataFrame, size: Extent, longest: int, normalized: bool
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Packed vectors and, where some are too long for one row, all cells with their norms and those of the long ones."""
    if size.longest <= longest:
        return pack(cells, scale=not normalized), None, None
    normed = cells.withColumn("norm", F.lit(1.0)) if normalized else normed_cells(cells)
    names = cells.groupBy("id").count().filter(F.col("count") > longest).select("id")
    return pack(cells.join(names, "id", "left_anti"), scale=not normalized), normed, normed.join(names, "id", "left_semi")


def both_ways(unit: DataFrame, long: DataFrame) -> DataFrame:
    """(target_id, item_id, score) of all pairs with a long vector on either side."""
    found = long_products(unit, long)
    turned = found.join(long.select("id").distinct(), "id", "left_anti")
    return found.select(F.col("id").alias("target_id"), F.col("other").alias("item_id"), "score").unionByName(
        turned.select(F.col("other").alias("target_id"), F.col("id").alias("item_id"), "score")
    )


def long_products(cells: DataFrame, long: DataFrame) -> DataFrame:
    """Products of every vector with the few long ones, as a join on the dimension and a sum.

    At most (all cells / longest) vectors are long, so a cell meets a bounded number of partners and
    the sums combine before the shuffle.
    """
    other = long.select("dim", F.col("id").alias("other"), F.col("w").alias("other_w"), F.col("norm").alias("other_norm"))
    product = F.col("w") * F.col("other_w")
    sums = cells.join(other, "dim").filter("id <> other").groupBy("id", "other").agg(
        F.sum(product).alias("total"), F.sum(F.abs(product)).alias("size"), F.count(F.lit(1)).alias("terms"),
        F.first("norm").alias("norm"), F.first("other_norm").alias("other_norm"),
    )
    score = settled(F.col("total"), F.col("size"), F.col("terms")) / F.col("norm") / F.col("other_norm")
    return sums.select("id", "other", score.alias("score"))


def cosine_pairs(
    cells: DataFrame, longest: int = LONG_VECTOR, normalized: bool = False, size: Extent | None = None
) -> DataFrame:
    """Cosine of all unordered pairs that share a dimension: (a, b, sim) with a < b.

    The result is the operator's whole similarity matrix without its zeros. Use the top-n forms, which
    never build it, wherever neighbours are what is wanted.
    """
    size = size or extent(cells)
    packed, unit, long = split_long(cells, size, longest, normalized)
    count = pair_blocks(size, cores(cells))
    mine = block_of("id", count)
    left = packed.select(mine.alias("i"), F.explode(F.sequence(mine, F.lit(count - 1))).alias("j"),
                         F.lit(0).alias("side"), F.col("id").alias("tid"), *vector(packed))
    right = packed.select(F.explode(F.sequence(F.lit(0), mine)).alias("i"), mine.alias("j"),
                          F.lit(1).alias("side"), F.col("id").alias("cid"), *vector(packed))
    rows = left.unionByName(right, allowMissingColumns=True)
    rows = rows.withColumn("task", (F.col("j") * (F.col("j") + 1) / 2).cast("int") + F.col("i"))
    pairs = by_task(rows, count * (count + 1) // 2).applyInArrow(
        _pairs_of_block(PAIR_STRIP), pair_schema(cells, "id", cells, "id")
    )
    if long is not None:
        once = long_products(unit, long).join(
            long.select(F.col("id").alias("id")).distinct().withColumn("both", F.lit(True)), "id", "left"
        ).filter("(both is null or id < other) and score <> 0")
        pairs = pairs.unionByName(once.select(
            F.least("id", "other").alias("target_id"), F.greatest("id", "other").alias("item_id"), "score"
        ))
    return pairs.select(F.col("target_id").alias("a"), F.col("item_id").alias("b"), F.col("score").alias("sim"))


def dense_topn(targets: DataFrame, rows: DataFrame, n: int, floor: float | None = ABOVE_ZERO) -> DataFrame:
    """The n rows nearest to every target by cosine, for vectors already packed as (id, dims, ws); no cell is shuffled.

    Vectors of length 0 have no neighbours. With ``floor=None`` similarities of either sign count.
    """
    def normed(packed: DataFrame) -> DataFrame:
        length = F.sqrt(F.aggregate("ws", F.lit(0.0), lambda total, w: total + w * w))
        return packed.withColumn("norm", length).filter("norm > 0").select("id", "dims", "ws", "norm")

    return block_topn(normed(targets), normed(rows), n, targets.count(), rows.count(), skip_self=True, floor=floor)


def cosine_topn(
    cells: DataFrame,
    n: int,
    targets: DataFrame | None = None,
    floor: float | None = ABOVE_ZERO,
    longest: int = LONG_VECTOR,
    normalized: bool = False,
    size: Extent | None = None,
    digits: int | None = OUTPUT_DIGITS,
) -> DataFrame:
    """The n nearest neighbours by cosine of all vectors, or of the ids in ``targets``.

    Returns (target_id, item_id, score, rank); a vector is never its own neighbour.
    """
    size = size or extent(cells)
    packed, unit, long = split_long(cells, size, longest, normalized)
    wanted, wanted_rows = packed, size.rows
    if targets is not None:
        ids = targets.select("id").distinct()
        wanted, wanted_rows = packed.join(ids, "id", "left_semi"), ids.count()
    best = block_topn(wanted, packed, n, wanted_rows, size.rows, skip_self=True, floor=floor, digits=None)
    if long is None:
        return best if digits is None else best.withColumn("score", F.round("score", digits))
    more = both_ways(unit, long)
    if targets is not None:
        more = more.join(targets.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi")
    if floor is not None:
        more = more.filter(F.col("score") >= floor)
    return top_n(best.drop("rank").unionByName(more), n, ["target_id"], digits=digits)
