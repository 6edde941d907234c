"""Collaborative filtering: ratings tables, neighbours, neighbour predictions and recommendations."""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kindred.functions.ranking import OUTPUT_DIGITS, top_n
from kindred.operators import similarity as sim
from kindred.operators import sparse_join
from kindred.session import stored

HOT_COLUMN = 8192
LONG_PARTS = 64
TARGET_ROWS = 8192  # targets of a task, which reads the table once
ASKED_ROWS = 4_000_000  # cells asked for of a task
BLOCK_CELLS = 40_000_000  # cells of the columns that a task predicts
FEW_VALUES = 65_536  # distinct weights that are held as numbers of two bytes
NAMES_AT_ONCE = 4_000_000
_BUFFER, _ROWS_OUT = 500_000, 200_000


def user_item(ratings: DataFrame) -> DataFrame:
    """Long form of the user-item matrix: duplicate (user, item) ratings averaged."""
    return ratings.groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating"))


def mean_center(ratings: DataFrame) -> DataFrame:
    """Rating minus the user's mean over their rated (non-zero) items."""
    means = ratings.filter("rating <> 0").groupBy("user_id").agg(F.avg("rating").alias("mean"))
    return ratings.join(means, "user_id", "left").withColumn(
        "rating", F.coalesce(F.col("rating") - F.col("mean"), F.lit(0.0))
    ).drop("mean")


def hash_bucket(columns: list[str], buckets: int, seed: int = 42) -> Column:
    """Bucket of a row that depends on its key only, so it survives any repartitioning."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(buckets)).cast("int")


def id_bucket(user: str, item: str, buckets: int, seed: int = 42) -> Column:
    """Bucket of integer ids by plain arithmetic that any SQL engine repeats."""
    return F.pmod(F.col(user) * 7919 + F.col(item) * 104729 + F.lit(seed), F.lit(buckets)).cast("int")


def train_test_split(ratings: DataFrame, test_size: float = 0.2, bucket: Column | None = None) -> DataFrame:
    """Mark every rating with is_test; ``bucket`` is a column 0..99, by default a hash of the pair."""
    bucket = hash_bucket(["user_id", "item_id"], 100) if bucket is None else bucket
    return ratings.withColumn("is_test", bucket >= F.lit(round(100 * (1 - test_size))))


def user_cells(ratings: DataFrame) -> DataFrame:
    return ratings.select(F.col("user_id").alias("id"), F.col("item_id").alias("dim"), F.col("rating").alias("w")).filter("w <> 0")


def item_cells(ratings: DataFrame) -> DataFrame:
    return ratings.select(F.col("item_id").alias("id"), F.col("user_id").alias("dim"), F.col("rating").alias("w")).filter("w <> 0")


def user_cosine(ratings: DataFrame) -> DataFrame:
    return sim.cosine_pairs(user_cells(ratings))


def item_cosine(ratings: DataFrame) -> DataFrame:
    return sim.cosine_pairs(item_cells(ratings))


def similar_users(ratings: DataFrame, n: int = 5, targets: DataFrame | None = None) -> DataFrame:
    """(user_id, neighbour_id, score, rank); ``targets`` (user_id) limits who is asked for."""
    ids = None if targets is None else targets.select(F.col("user_id").alias("id"))
    return sparse_join.cosine_topn(user_cells(ratings), n, ids).withColumnsRenamed(
        {"target_id": "user_id", "item_id": "neighbour_id"}
    )


def similar_items(ratings: DataFrame, n: int = 5, targets: DataFrame | None = None) -> DataFrame:
    """(item_id, neighbour_id, score, rank); ``targets`` (item_id) limits what is asked for."""
    ids = None if targets is None else targets.select(F.col("item_id").alias("id"))
    found = sparse_join.cosine_topn(item_cells(ratings), n, ids)
    return found.withColumnRenamed("item_id", "neighbour_id").withColumnRenamed("target_id", "item_id")


def _places(group: np.ndarray, near: np.ndarray, ids: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Place of every neighbour in its group by similarity, ties to the lower id.

    Rows that share nothing are similar by 0: ``zeros`` of a group take places before the negative ones.
    """
    order = np.lexsort((ids, -sim.order_keys(near), -np.sign(near), group))
    places = np.empty(len(group), dtype=np.int64)
    places[order] = np.arange(1, len(order) + 1) - np.searchsorted(group[order], group[order], side="left")
    return places + np.where(near < 0, zeros[group], 0)


def _neighbour_scores(group, count: int, near, values, ids: Callable, zeros, k: int, skip_top: bool) -> np.ndarray:
    """sum(sim * value) / sum(|sim|) over the k most similar rows of every group, 0 where there are none.

    ``ids`` gives the order of the rows at some places by their ids. ``zeros`` counts a group's rows that share nothing with the
    target. Only groups with more positive rows than places, or with negative ones, are ranked.
    """
    keep = k + 1 if skip_top else k
    negative = near < 0
    signed = bool(negative.any())
    crowded = np.bincount(group[~negative] if signed else group, minlength=count) > keep
    if signed:
        crowded |= np.bincount(group[negative], minlength=count) > 0
    if skip_top:
        crowded[:] = True
    if crowded.any():
        some = np.flatnonzero(crowded[group])
        places = _places(group[some], near[some], ids(some), zeros)
        out = some[(places > keep) | (places == 1)] if skip_top else some[places > keep]
        near = near.copy()
        near[out] = 0.0
    size = np.abs(near)
    total, weight = np.bincount(group, near * values, minlength=count), np.bincount(group, size, minlength=count)
    if signed or (values < 0).any():  # terms that cancel leave rounding errors
        terms = np.minimum(np.bincount(group, minlength=count), keep)
        total[np.abs(total) <= terms * sim.EPSILON * np.bincount(group, size * np.abs(values), minlength=count)] = 0.0
    return np.where(weight > 0, total / np.where(weight > 0, weight, 1.0), 0.0)


def _similarities(targets: pa.Table, candidates: pa.Table, table: pa.Table):
    """Candidates x targets products of a task; those with a long vector come ready-made in rows of side 3."""
    target_ids, candidate_ids = targets.column("tid").to_numpy(), candidates.column("cid").to_numpy()
    scores = sim.block_scores(
        len(candidate_ids), sim.unpack(candidates, "dims", "ws"), sim.norms_of(candidates),
        len(target_ids), sim.unpack(targets, "dims", "ws"), sim.norms_of(targets),
    )
    if "sim" in table.column_names:
        given = table.filter(pa.compute.equal(table.column("side"), 3))
        rows = pd.Index(target_ids).get_indexer(given.column("tid").to_numpy())
        at = pd.Index(candidate_ids).get_indexer(given.column("cid").to_numpy())
        hit = (rows >= 0) & (at >= 0)
        scores[at[hit], rows[hit]] = given.column("sim").to_numpy()[hit]
    at = pd.Index(candidate_ids).get_indexer(target_ids)
    scores[at[at >= 0], np.flatnonzero(at >= 0)] = sim.BARRED
    return target_ids, candidate_ids, scores


def _stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every stretch, one after the other."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _edges(codes: np.ndarray, count: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=count))])


def _grouped(keys: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of every key, numbered by the group's last place, and these places; ``place`` is scratch with room for every key."""
    numbers = np.arange(len(keys), dtype=place.dtype)
    place[keys] = numbers
    group = place[keys]
    return group, np.flatnonzero(group == numbers)


class _Names:
    """Distinct values, gathered part by part; more than ``most`` of them are not told."""

    def __init__(self, most: int | None = None):
        self.most, self.held, self.size, self.off = most, [], 0, False

    def add(self, values: np.ndarray) -> None:
        if self.off:
            return
        self.held.append(np.sort(pd.unique(values)))
        self.size += len(self.held[-1])
        if self.size > NAMES_AT_ONCE:
            self.fold()

    def fold(self) -> None:
        if len(self.held) > 1:
            self.held = [np.sort(pd.unique(np.concatenate(self.held)))]
        self.size = 0
        if self.most is not None and self.held and len(self.held[0]) > self.most:
            self.off, self.held = True, []

    def told(self) -> np.ndarray | None:
        self.fold()
        return None if self.off else self.held[0]


class _Block:
    """The sparse rows of one task: targets, candidates by row and by column, wishes and given similarities.

    Columns are numbered in the order of their names, candidates as they arrive; a long row arrives in parts, which all bear its id.
    Rows are read part by part, twice: first names are counted, then cells put in their places, so no other form of the whole table is
    held. A weight is held as the number of its value where there are few values. Rows are kept by row only where predictions look
    there: for cells that are asked for, the columns are enough.
    """

    def __init__(self, kinds: tuple, targets: list | None, parts: Callable[[], Iterator[tuple]] | None, wishes: list | None, given: list | None):
        """``parts`` gives the rows each time it is called; ``targets`` are rows of their own, or ids alone where they are among them."""
        self.kinds, self.targets, self.wishes, self.given = kinds, targets, wishes, given
        self.empty = targets is None or parts is None
        if not self.empty:
            self._count(parts)
            self._fill(parts)
            self._look_up()

    @classmethod
    def of_rows(cls, batches: Iterator[pa.RecordBatch]) -> "_Block":
        held = {0: [], 1: [], 2: [], 3: []}
        own, kinds = 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            side = table.column("side").combine_chunks().to_numpy(zero_copy_only=False)
            kinds = kinds or (table.schema.field("tid").type, table.schema.field("dims").type.value_type)
            own = table.column("c")[0].as_py() if table.num_rows else own
            for s in np.unique(side):
                held[s].append(cls._taken(table.filter(pa.array(side == s)), int(s), own))
        rows = held[1]
        return cls(kinds, cls._joined(held[0]), (lambda: iter(rows)) if rows else None, cls._joined(held[2]), cls._joined(held[3]))

    @classmethod
    def of_packs(cls, lists: list[pa.Table], packs: list[bytes], kinds: tuple) -> "_Block":
        """``lists`` names the targets (id), the columns predicted here (dim; by default all) or the cells asked for (id, dim)."""
        held = {}
        for table in lists:
            held.setdefault(",".join(table.column_names), []).append(table)
        plain = lambda names, column: np.concatenate([t.column(column).to_numpy() for t in held[names]])
        wishes = [plain("id,dim", "id"), plain("id,dim", "dim")] if "id,dim" in held else None
        targets = plain("id", "id") if "id" in held else None if wishes is None else pd.unique(wishes[0])
        own = pd.Index(plain("dim", "dim")) if "dim" in held else None

        def parts() -> Iterator[tuple]:
            for pack in packs:
                yield cls._of_pack(sim.unpacked(pack), own)

        return cls(kinds, None if targets is None else [targets], parts if packs else None, wishes, None)

    @staticmethod
    def _taken(part: pa.Table, side: int, own: int) -> tuple:
        plain = lambda name: part.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        if side == 3:
            return plain("tid"), plain("cid"), plain("sim")
        lengths = np.asarray(part.column("dims").combine_chunks().value_lengths().fill_null(0), dtype=np.int64)
        flat = lambda name: part.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        if side == 2:
            return np.repeat(plain("tid"), lengths), flat("dims")
        if side == 0:
            return plain("tid"), lengths, flat("dims"), flat("ws"), plain("norm")
        return plain("cid"), lengths, flat("dims"), flat("ws"), plain("norm"), plain("whole"), flat("spot") == own

    @staticmethod
    def _of_pack(rows: pa.Table, own: pd.Index | None) -> tuple:
        owner, dims, weights = sim.unpack(rows, "dims", "ws")
        lengths = np.bincount(owner, minlength=rows.num_rows)
        here = np.ones(len(dims), dtype=bool) if own is None else own.get_indexer(dims) >= 0
        return rows.column("id").to_numpy(), lengths, dims, weights, rows.column("norm").to_numpy(), np.ones(len(lengths), dtype=bool), here

    @staticmethod
    def _joined(parts: list[tuple]) -> list[np.ndarray] | None:
        return [np.concatenate(x) for x in zip(*parts)] if parts else None

    def _count(self, parts: Callable[[], Iterator[tuple]]) -> None:
        """Names of columns, cells of each, distinct weights, and what is known of every row."""
        rows, names, values, known = [], _Names(), _Names(FEW_VALUES), 0
        for ids, lengths, dims, weights, norms, whole, here in parts():
            names.add(dims)
            values.add(weights)
            rows.append((ids, lengths, norms, whole, np.bincount(np.repeat(np.arange(len(ids)), lengths)[here], minlength=len(ids))))
            known += len(dims)
        self.ids, self.lengths, self.norms, self.whole, self.own_lengths = self._joined(rows)
        self.names, self.values, self.cells = names.told(), values.told(), known
        self.name_index = pd.Index(self.names)
        self.whole_only = bool(self.whole.all())
        self.rank = np.empty(len(self.ids), dtype=np.int32)
        self.sorted_rows = np.argsort(self.ids, kind="stable")
        self.rank[self.sorted_rows] = np.arange(len(self.ids))

    def _coded(self, weights: np.ndarray) -> np.ndarray:
        return weights if self.values is None else np.searchsorted(self.values, weights).astype(np.uint16)

    def weights(self, held: np.ndarray, at) -> np.ndarray:
        return held[at] if self.values is None else self.values[held[at]]

    def _fill(self, parts: Callable[[], Iterator[tuple]]) -> None:
        """Puts the cells in their places: all of them by column, those predicted here by row, and the targets' own."""
        count, kind = len(self.names), np.float64 if self.values is None else np.uint16
        filled = np.zeros(count, dtype=np.int64)
        for _, _, dims, *_ in parts():
            filled += np.bincount(self._numbered(dims), minlength=count)
        self.columns = np.concatenate([[0], np.cumsum(filled)])
        del filled
        self.by_column = np.empty(self.cells, dtype=np.int32), np.empty(self.cells, dtype=kind)
        by_row = self.wishes is None or not self.whole_only
        self.starts = np.concatenate([[0], np.cumsum(self.own_lengths)])
        held = int(self.starts[-1]) if by_row else 0
        self.codes, self.ws = np.empty(held, dtype=np.int32), np.empty(held, dtype=kind)
        self.predicted = np.zeros(count, dtype=bool)
        self.signed = False
        wanted = None if len(self.targets) > 1 else pd.Index(self.targets[0]).get_indexer(self.ids) >= 0
        found, next_place, at, row = [], self.columns[:-1].copy(), 0, 0
        for ids, lengths, dims, weights, _, _, here in parts():
            codes, held = self._numbered(dims).astype(np.int32), self._coded(weights)
            rows = np.repeat(np.arange(row, row + len(ids), dtype=np.int32), lengths)
            self.signed |= bool((weights < 0).any())
            order = np.argsort(codes, kind="stable")
            ordered = codes[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, dtype=np.int64)
            many = np.diff(np.append(first, len(ordered)))
            places = _stretches(next_place[ordered[first]], many)
            self.by_column[0][places], self.by_column[1][places] = rows[order], held[order]
            next_place[ordered[first]] += many
            self.predicted[codes[here]] = True
            if by_row:
                some = codes[here]
                self.codes[at: at + len(some)], self.ws[at: at + len(some)] = some, held[here]
                at += len(some)
            if wanted is not None:
                mine = wanted[row: row + len(ids)]
                cells = np.repeat(mine, lengths)
                found.append((ids[mine], lengths[mine], codes[cells], weights[cells]))
            row += len(ids)
        if wanted is not None:  # ids alone
            self.targets = [*self._joined(found), self.norms[wanted]]
        else:
            self.signed |= bool((self.targets[3] < 0).any())
            self.targets[2] = self._numbered(self.targets[2])

    def _look_up(self) -> None:
        target_ids, lengths, codes, weights, norms = self.targets
        ends = np.cumsum(lengths)
        self.target_spans = ends - lengths, ends
        self.targets = target_ids, codes, weights, norms
        self.place_row, self.place_column = np.empty(len(self.ids), dtype=np.int32), np.empty(len(self.names), dtype=np.int32)
        self.sorted_ids = None if self.given is None and self.whole_only else (self.ids[self.sorted_rows], self.sorted_rows)
        del self.sorted_rows
        self.wished = self._by_target(self.wishes)
        self.given_rows = self._by_target(self.given)
        if self.wishes is not None:
            self.wish_names = self.wishes[1]
            self.wishes[1] = self._numbered(self.wishes[1])

    def _numbered(self, dims: np.ndarray) -> np.ndarray:
        return self.name_index.get_indexer(dims)

    @staticmethod
    def _by_target(table: list | None) -> dict:
        """Rows of each target; the table is put into the order of its targets."""
        if table is None:
            return {}
        order = np.argsort(table[0], kind="stable")
        table[:] = [x[order] for x in table]
        names, first = np.unique(table[0], return_index=True)
        last = np.append(first[1:], len(order))
        return {n: slice(a, b) for n, a, b in zip(names.tolist(), first, last)}

    def near(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates similar to a target, their similarities, and the numbers of the target's own columns."""
        ids, dims, weights, norms = self.targets
        part = slice(self.target_spans[0][t], self.target_spans[1][t])
        own, w = dims[part], weights[part]
        known = own >= 0
        own, w = own[known], w[known]
        lengths = self.columns[own + 1] - self.columns[own]
        at = _stretches(self.columns[own], lengths)
        rows, terms = self.by_column[0][at], self.weights(self.by_column[1], at) * np.repeat(w, lengths)
        group, last = _grouped(rows, self.place_row)
        dots = np.bincount(group, terms, minlength=len(rows))[last]
        if self.signed:
            size = np.bincount(group, np.abs(terms), minlength=len(rows))[last]
            dots[np.abs(dots) <= np.bincount(group, minlength=len(rows))[last] * sim.EPSILON * size] = 0.0
        rows = rows[last]
        keep = (dots != 0) & self.whole[rows] & (self.ids[rows] != ids[t])
        rows = rows[keep]
        scores = dots[keep] / self.norms[rows] / norms[t]
        if (found := self.given_rows.get(ids[t])) is not None:  # those with a long vector come ready-made
            others, places = self.given[1][found], self.sorted_ids
            first, end = (np.searchsorted(places[0], others, side=s) for s in ("left", "right"))
            more = places[1][_stretches(first, end - first)]
            rows = np.concatenate([rows, more])
            scores = np.concatenate([scores, np.repeat(self.given[2][found], end - first)])
            rows, scores = rows[scores != 0], scores[scores != 0]
        return rows, scores, own if self.whole_only else np.concatenate([own, self._parts_of(ids[t])])

    def _parts_of(self, name) -> np.ndarray:
        """Numbers of the columns that the parts of a long row fill."""
        first, end = (np.searchsorted(self.sorted_ids[0], name, side=s) for s in ("left", "right"))
        rows = self.sorted_ids[1][first:end]
        rows = rows[~self.whole[rows]]
        return self.codes[_stretches(self.starts[rows], self.starts[rows + 1] - self.starts[rows])]

    def asked(self, t: int) -> np.ndarray:
        """Numbers of the columns asked for a target."""
        part = self.wished.get(self.targets[0][t])
        found = np.empty(0, dtype=np.int64) if part is None else self.wishes[1][part]
        return found[found >= 0]

    def unknown(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The cells asked for of which a row or a column has no cell."""
        if self.wishes is None or self.empty:
            return self.wishes
        known = (pd.Index(self.targets[0]).get_indexer(self.wishes[0]) >= 0) & (self.wishes[1] >= 0)
        return self.wishes[0][~known], self.wish_names[~known]


def _blocks_of(batches: Iterator[pa.RecordBatch], kinds: tuple) -> Iterator[_Block]:
    """The blocks of a partition: each task comes as its lists and all packs, one after the other."""
    number, lists, packs, batch, own, pack = None, [], [], None, None, None
    for batch in batches:
        for task, own, pack in zip(*batch.columns):
            if number is not None and task.as_py() != number:
                yield _of_sent(lists, packs, kinds)
            number = task.as_py()
            if pack.is_valid:
                packs.append(pack.as_py())
            else:
                lists.extend(sim.unpacked(x) for x in own.as_py())
    del batch, own, pack
    if number is not None:
        yield _of_sent(lists, packs, kinds)


def _of_sent(lists: list[pa.Table], packs: list[bytes], kinds: tuple) -> _Block:
    """The block of what was sent, which is let go."""
    block = _Block.of_packs(lists, packs, kinds)
    lists.clear()
    packs.clear()
    return block


def _predict_block(k: int, skip_top: bool, unrated: bool, best: int | None, per_target: bool, kinds: tuple | None = None):
    """Predictions of a task, one target after the other, by the rows that share a column with it only.

    With ``kinds``, the types of ids and columns, tasks come as packs, and every cell asked for is told, 0 where nothing is known.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if kinds is None:
            yield from of_block(_Block.of_rows(batches))
            return
        for block in _blocks_of(batches, kinds):
            if (rest := block.unknown()) is not None:
                yield from _rows_out(kinds, *rest, np.zeros(len(rest[0])))
            yield from of_block(block)

    def of_block(block: _Block) -> Iterator[pa.RecordBatch]:
        if block.empty:
            return
        out, size, limit = [], 0, _BUFFER
        bar = None if best is None or per_target else np.full(len(block.names), -np.inf)
        own_rows = np.zeros(len(block.names), dtype=bool)
        dense = np.zeros(len(block.ids))
        for t, name in enumerate(block.targets[0]):
            rows, near, own = block.near(t)
            if unrated:
                columns, scores = _unrated(block, rows, near, own, own_rows)
                if bar is not None:
                    some = sim.order_keys(scores) >= bar[columns]
                    columns, scores = columns[some], scores[some]
                elif best is not None:
                    columns, scores = _first_of(columns, scores, best)
            else:
                columns, scores = _wished(block, t, rows, near, own, own_rows, dense)
            out.append((np.full(len(columns), t), columns, scores))
            size += len(columns)
            if size > limit and bar is None:
                yield from _told(block, *_joined(out))
                out, size = [], 0
            elif size > limit:
                out = [_best_of_columns(*_joined(out), best, bar, block.targets[0])]
                size = len(out[0][0])
                limit = max(_BUFFER, 2 * size)
        if out:
            found = _joined(out)
            yield from _told(block, *(found if bar is None else _best_of_columns(*found, best, bar, block.targets[0])))

    def _unrated(block, rows, near, own, own_rows):
        lengths = block.starts[rows + 1] - block.starts[rows]
        at = _stretches(block.starts[rows], lengths)
        columns, near = block.codes[at], np.repeat(near, lengths)
        group, last = _grouped(columns, block.place_column)
        shown = columns[last]
        number = np.empty(len(columns), dtype=np.int64)
        number[last] = np.arange(len(last))
        group = number[group]
        own_rows[own] = True
        met = np.bincount(group, minlength=len(last))
        zeros = block.columns[shown + 1] - block.columns[shown] - own_rows[shown] - met
        places = lambda some: block.rank[np.repeat(rows, lengths)[some]]
        scores = _neighbour_scores(group, len(last), near, block.weights(block.ws, at), places, zeros, k, skip_top)
        keep = (scores > 0) & ~own_rows[shown]
        own_rows[own] = False
        return shown[keep], scores[keep]

    def _wished(block, t, rows, near, own, own_rows, dense):
        wanted = block.asked(t)
        wanted = wanted[block.predicted[wanted]]
        lengths = block.columns[wanted + 1] - block.columns[wanted]
        at = _stretches(block.columns[wanted], lengths)
        raters, group = block.by_column[0][at], np.repeat(np.arange(len(wanted)), lengths)
        dense[rows] = near
        found = dense[raters]
        dense[rows] = 0.0
        some = found != 0
        own_rows[own] = True
        zeros = lengths - own_rows[wanted] - np.bincount(group[some], minlength=len(wanted))
        own_rows[own] = False
        return wanted, _neighbour_scores(
            group[some], len(wanted), found[some], block.weights(block.by_column[1], at[some]), lambda x: block.rank[raters[some][x]], zeros, k, skip_top
        )

    return run


def _joined(found: list[tuple]) -> tuple:
    return tuple(np.concatenate(x) for x in zip(*found))


def _first_of(columns: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n best columns by rounded score, ties to the lower column."""
    if len(columns) > n:
        keys = sim.order_keys(scores)
        last = np.partition(keys, len(keys) - n)[len(keys) - n]
        some = np.flatnonzero(keys >= last)
        some = some[np.lexsort((columns[some], -keys[some]))[:n]]
        columns, scores = columns[some], scores[some]
    return columns, scores


def _best_of_columns(targets, columns, scores, n: int, bar: np.ndarray, ids) -> tuple:
    """The n best targets of every column, ties to the lower id; ``bar`` becomes the rounded score that a further one has to reach."""
    rank = np.empty(len(ids), dtype=np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    keys = sim.order_keys(scores)
    order = np.lexsort((rank[targets], -keys, columns))
    place = np.arange(len(order)) - np.searchsorted(columns[order], columns[order], side="left")
    last = order[place == n - 1]
    bar[columns[last]] = keys[last]
    kept = order[place < n]
    return targets[kept], columns[kept], scores[kept]


def _told(block: _Block, targets, columns, scores) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(targets), _ROWS_OUT):
        part = slice(at, at + _ROWS_OUT)
        yield from _rows_out(block.kinds, block.targets[0][targets[part]], block.names[columns[part]], scores[part])


def _rows_out(kinds: tuple, ids: np.ndarray, dims: np.ndarray, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(ids), _ROWS_OUT):
        part = slice(at, at + _ROWS_OUT)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[part], type=kind) for x, kind in ((ids, kinds[0]), (dims, kinds[1]), (scores, pa.float64()))],
            ["target_id", "item_id", "score"],
        )


def _hot_block(keep: int):
    """Best partial neighbours of every target for the hot columns, from one slice of candidates."""
    def run(table: pa.Table) -> pa.Table:
        targets, candidates, _ = sim.sides(table)
        found = [[], [], [], [], []]
        if targets.num_rows and candidates.num_rows:
            target_ids, candidate_ids, scores = _similarities(targets, candidates, table)
            owner, columns, values = sim.unpack(candidates, "columns", "values")
            codes, names = pd.factorize(columns, sort=True)
            order = np.lexsort((owner, codes))
            codes, owner, values = codes[order], owner[order], values[order]
            edges = np.searchsorted(codes, np.arange(len(names) + 1))
            for c in range(len(names)):
                part = slice(edges[c], edges[c + 1])
                near = scores[owner[part]].T
                picked = sim.best_columns(near, keep)
                rows = np.repeat(np.arange(len(target_ids)), picked.shape[1])
                cols = picked.reshape(-1)
                some = near[rows, cols] > sim.BARRED
                rows, cols = rows[some], cols[some]
                news = (target_ids[rows], np.repeat(names[c: c + 1], len(rows)), candidate_ids[owner[part]][cols], near[rows, cols], values[part][cols])
                for into, more in zip(found, news):
                    into.append(more)
        kinds = [table.schema.field("tid").type, table.schema.field("columns").type.value_type, table.schema.field("cid").type,
                 pa.float64(), pa.float64()]
        names = ["target_id", "item_id", "neighbour", "sim", "value"]
        return pa.table({n: pa.array(np.concatenate(f) if f else [], type=k) for n, f, k in zip(names, found, kinds)})

    return run


def _marked_rows(cells, packed, long_ids, spots: DataFrame | None, c: Column, across: int) -> DataFrame:
    """Rows for every block of targets. Each cell bears the block of columns in which it is predicted from, -1 where ``spots`` has none."""
    known = cells.filter("dim is not null")
    if spots is None:
        known = known.withColumn("spot", c)
    else:
        known = known.join(spots, "dim", "left").withColumn("spot", F.coalesce("spot", F.lit(-1)))
    entry = F.collect_list(F.struct("dim", "w", "spot")).alias("v")
    sent = known if long_ids is None else known.join(long_ids, "id", "left_anti")
    vectors = sent.groupBy("id").agg(entry).join(packed.select("id", "norm"), "id").withColumn("whole", F.lit(True))
    if long_ids is not None:  # cells of long rows come in parts, and serve the predictions only
        parts = known.filter("spot >= 0").join(long_ids, "id", "left_semi").groupBy("id", F.pmod(F.xxhash64("dim"), F.lit(LONG_PARTS))).agg(entry)
        vectors = vectors.unionByName(parts.select("id", "v", F.lit(1.0).alias("norm"), F.lit(False).alias("whole")))
    met = F.filter(F.array_distinct("v.spot"), lambda x: x >= 0)
    return vectors.withColumn("c", F.explode(met)).select(
        sim.every_block(across).alias("i"), "c", F.lit(1).alias("side"), F.col("id").alias("cid"),
        F.col("v.dim").alias("dims"), F.col("v.w").alias("ws"), F.col("v.spot").alias("spot"), "norm", "whole",
    )


def _from_packs(packed: DataFrame, lists: DataFrame, tasks: int, predict, schema: str) -> DataFrame:
    """Every task with its lists (task, list) and all rows, which are stored once in compressed packs: each task reads those files.

    Rows are joined as a product without a shuffle, so what is written does not grow with the number of tasks.
    """
    packs = stored(sim.packs(packed))
    none = packed.sparkSession.range(1).select(F.lit(None).cast("binary").alias("pack"))  # comes with the lists
    sent = sim.by_task(lists, tasks).agg(F.collect_list("list").alias("lists"))
    rows = sent.crossJoin(packs.unionByName(none).coalesce(1).hint("shuffle_replicate_nl"))
    return rows.select("task", F.when(F.col("pack").isNull(), F.col("lists")).alias("lists"), "pack").mapInArrow(predict, schema)


def neighbour_predictions(
    cells: DataFrame,
    k: int = 10,
    neighbours: str = "identity",
    asked: DataFrame | None = None,
    best: int | None = None,
    per_target: bool = True,
    targets: DataFrame | None = None,
    hot_column: int = HOT_COLUMN,
    longest: int = sim.LONG_VECTOR,
    columns: DataFrame | None = None,
) -> DataFrame:
    """Predict cells of a sparse matrix from the k most similar rows that fill the column.

    ``cells`` is (id, dim, w). A prediction for row t and column c is sum(sim * w) / sum(|sim|) over the k
    rows most similar to t that have c. With ``asked`` (id, dim) exactly those cells are predicted (0 where
    nothing is known); without it every empty cell with a positive prediction is. ``best`` keeps that many
    per row (``per_target``) or per column. ``neighbours='skip_top'`` leaves out the most similar row.

    ``targets`` (id) and ``columns`` (dim) limit what is predicted; ``asked`` limits both by itself. Only rows that fill one of
    the columns take part as neighbours, and only those cells of theirs are sent.

    A task holds a large block of targets and the rows that fill a block of columns, as an inverted index; it works through
    the rows that share a column with each target only. Where all columns have up to ``BLOCK_CELLS`` cells, rows are packed once and
    every task gets them; there are as many tasks as cores, as a task's memory does not grow with its targets. For the best of each
    column such tasks share out targets and columns, so that a column has lists from few tasks. Else rows are sent once for every block of targets. Columns that more than ``hot_column`` rows fill are worked on by
    slices of those rows instead; the slices' partial neighbour lists are merged afterwards. The
    similarities of rows with more than ``longest`` cells are summed by a join first and handed to the tasks.
    """
    skip_top = neighbours == "skip_top"
    size = sim.extent(cells)
    kinds = [[x.schema[c].dataType for c in ("id", "dim")] for x in (cells, cells if asked is None else asked)]
    plain = kinds[0] == kinds[1] and (asked is None or targets is None)
    if asked is not None:
        targets = asked.select("id") if targets is None else targets
        columns = asked.select("dim") if columns is None else columns
    filled = cells.filter("dim is not null").groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    if columns is not None:  # counts are joined, not cells
        filled = filled.join(columns.select("dim").distinct(), "dim", "left_semi")
    shape = filled.agg(
        F.count(F.lit(1)).alias("columns"), F.coalesce(F.max("n"), F.lit(0)).alias("most"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    ).first()
    packed, unit, long = sim.split_long(cells, size, longest, normalized=False)
    long_ids = None if long is None else long.select("id").distinct()
    if long_ids is not None:  # long rows take part without their vector
        none = [F.array().cast(packed.schema[x].dataType).alias(x) for x in ("dims", "ws")]
        packed = packed.unionByName(long_ids.select("id", *none, F.lit(1.0).alias("norm")))
    wanted, wanted_rows, asked_rows = packed, size.rows, 0
    if targets is not None:
        ids = targets.select("id").distinct()
        wanted = packed.join(ids, "id", "left_semi")
        wanted_rows, asked_rows = targets.agg(F.count_distinct("id"), F.count("id")).first()
    across = sim.blocks(wanted_rows, TARGET_ROWS, sim.cores(cells))
    down = sim.blocks(shape["total"], BLOCK_CELLS)
    is_hot = shape["most"] > hot_column
    hot = filled.filter(F.col("n") > hot_column).select("dim") if is_hot else None
    schema = sim.pair_schema(cells, "id", cells, "dim")

    if plain and down == 1 and not is_hot and long is None and shape["total"] == size.cells:
        arrow = tuple(to_arrow_type(x) for x in kinds[0])
        across = min(across, sim.cores(cells))  # a task takes its targets one by one, so more of them need no more tasks
        predict = _predict_block(k, skip_top, asked is None, best, per_target, arrow)
        if asked is not None:
            across = max(across, -(-asked_rows // ASKED_ROWS))
            lists = sim.listed(asked.filter("id is not null and dim is not null").select(sim.block_of("id", across).alias("task"), "id", "dim"))
            found = _from_packs(packed.filter("id is not null"), lists, across, predict, schema)
            return found.unionByName(asked.filter("id is null or dim is null").select(
                F.col("id").alias("target_id"), F.col("dim").alias("item_id"), F.lit(0.0).alias("score")
            ))
        if best is not None and not per_target:
            down = min(math.isqrt(across - 1) + 1, shape["columns"]) if across > 1 else 1
            across = -(-across // down)
        ids = (cells if targets is None else targets).select("id").filter("id is not null").distinct()
        i, c = sim.block_of("id", across), sim.block_of("dim", down)
        lists = sim.listed(ids.select("id", sim.every_block(down).alias("c")).select((i * down + F.col("c")).alias("task"), "id"))
        if down > 1:
            own = filled.select("dim", sim.every_block(across).alias("i"))
            lists = lists.unionByName(sim.listed(own.select((F.col("i") * down + c).alias("task"), "dim")))
        if best is None or per_target:  # its plan has no product of tables; packs are sent to every task
            own = lists.select("task", F.array("list").alias("lists"))
            packs = sim.packs(packed.filter("id is not null")).select(sim.every_block(across).alias("task"), "pack")
            return sim.by_task(own.unionByName(packs, allowMissingColumns=True), across).applyInArrow(predict, schema)
        return _from_packs(packed.filter("id is not null"), lists, across * down, predict, schema)

    i, c = sim.block_of("id", across), sim.block_of("dim", down)
    spots = filled.filter(F.col("n") <= hot_column).select("dim", c.alias("spot")) if is_hot or columns is not None else None
    right = _marked_rows(cells, packed, long_ids, spots, c, across)
    left = wanted.filter("id is not null").select(i.alias("i"), sim.every_block(down).alias("c"), F.lit(0).alias("side"),
                                                  F.col("id").alias("tid"), "dims", "ws", "norm")
    rows = left.unionByName(right, allowMissingColumns=True)
    if asked is not None:
        wishes = asked.filter("id is not null and dim is not null").groupBy(i.alias("i"), c.alias("c"), F.col("id").alias("tid")).agg(
            F.collect_set("dim").alias("dims")
        )
        rows = rows.unionByName(wishes.withColumn("side", F.lit(2)), allowMissingColumns=True)
    edges = None if long is None else sim.both_ways(unit, long).select(
        sim.block_of("target_id", across).alias("i"), F.lit(3).alias("side"),
        F.col("target_id").alias("tid"), F.col("item_id").alias("cid"), F.col("score").alias("sim"),
    )
    if edges is not None:
        rows = rows.unionByName(edges.withColumn("c", sim.every_block(down)), allowMissingColumns=True)
    rows = rows.withColumn("task", F.col("i") * down + F.col("c"))
    found = sim.by_task(rows, across * down).applyInArrow(
        _predict_block(k, skip_top, asked is None, best, per_target), schema
    )
    if is_hot:
        hot_across = sim.blocks(wanted_rows, sim.TARGET_BLOCK, sim.cores(cells))
        hot_edges = None if edges is None else edges.withColumn("i", sim.block_of("tid", hot_across))
        found = found.unionByName(_hot_predictions(cells, packed, wanted, hot_edges, hot, hot_across, size.rows, k, skip_top, asked))
    if asked is None:
        return found
    return asked.select(F.col("id").alias("target_id"), F.col("dim").alias("item_id")).join(
        found, ["target_id", "item_id"], "left"
    ).withColumn("score", F.coalesce("score", F.lit(0.0)))


def _hot_predictions(cells, packed, wanted, edges, hot, across, rows, k, skip_top, asked) -> DataFrame:
    """Predictions for hot columns on a grid of target blocks x slices of candidates, merged over the slices.

    Every candidate is sent once per target block with all the hot columns it fills.
    """
    keep = k + 1 if skip_top else k
    down = sim.blocks(rows, sim.CANDIDATE_BLOCK)
    filled = cells.join(hot, "dim", "left_semi").groupBy("id").agg(F.collect_list(F.struct("dim", "w")).alias("v"))
    right = packed.join(filled, "id").select(
        sim.every_block(across).alias("i"), sim.block_of("id", down).alias("j"), F.lit(1).alias("side"),
        F.col("id").alias("cid"), "dims", "ws", "norm", F.col("v.dim").alias("columns"), F.col("v.w").alias("values"),
    )
    left = wanted.select(sim.block_of("id", across).alias("i"), sim.every_block(down).alias("j"), F.lit(0).alias("side"),
                         F.col("id").alias("tid"), "dims", "ws", "norm")
    id_type, dim_type = (cells.schema[x].dataType.simpleString() for x in ("id", "dim"))
    tasks = left.unionByName(right, allowMissingColumns=True)
    if edges is not None:
        tasks = tasks.unionByName(edges.withColumn("j", sim.block_of("cid", down)), allowMissingColumns=True)
    tasks = tasks.withColumn("task", F.col("i") * down + F.col("j"))
    partial = sim.by_task(tasks, across * down).applyInArrow(
        _hot_block(keep), f"target_id {id_type}, item_id {dim_type}, neighbour {id_type}, sim double, value double"
    )
    pair = Window.partitionBy("target_id", "item_id").orderBy(F.round("sim", 9).desc(), F.col("neighbour"))
    ranked = partial.withColumn("place", F.row_number().over(pair)).filter(F.col("place") <= keep)
    if skip_top:
        ranked = ranked.filter("place > 1")
    term = F.col("sim") * F.col("value")
    total = sim.settled(F.sum(term), F.sum(F.abs(term)), F.count(F.lit(1)))
    found = ranked.groupBy("target_id", "item_id").agg(F.coalesce(F.try_divide(total, F.sum(F.abs("sim"))), F.lit(0.0)).alias("score"))
    rated = cells.select(F.col("id").alias("target_id"), F.col("dim").alias("item_id"))
    if asked is None:
        return found.join(rated, ["target_id", "item_id"], "left_anti").filter("score > 0")
    return found.join(
        asked.select(F.col("id").alias("target_id"), F.col("dim").alias("item_id")), ["target_id", "item_id"], "left_semi"
    )


def predict_user_based(ratings: DataFrame, pairs: DataFrame, k: int = 10, neighbours: str = "identity", **options) -> DataFrame:
    """Predicted rating of each (user_id, item_id) in ``pairs``; 0 where nothing is known."""
    asked = pairs.select(F.col("user_id").alias("id"), F.col("item_id").alias("dim"))
    found = neighbour_predictions(user_cells(ratings), k, neighbours, asked, **options)
    return found.select(F.col("target_id").alias("user_id"), "item_id", "score")


def predict_item_based(ratings: DataFrame, pairs: DataFrame, k: int = 10, neighbours: str = "identity", **options) -> DataFrame:
    asked = pairs.select(F.col("item_id").alias("id"), F.col("user_id").alias("dim"))
    found = neighbour_predictions(item_cells(ratings), k, neighbours, asked, **options)
    return found.select(F.col("item_id").alias("user_id"), F.col("target_id").alias("item_id"), "score")


def recommend_user_based(
    ratings: DataFrame, n: int = 10, k: int = 10, neighbours: str = "identity", targets: DataFrame | None = None,
    digits: int | None = OUTPUT_DIGITS, **options
) -> DataFrame:
    """Top-n unrated items of every user (or of ``targets``) by user-based prediction: (user_id, item_id, score, rank)."""
    ids = None if targets is None else targets.select(F.col("user_id").alias("id"))
    found = neighbour_predictions(user_cells(ratings), k, neighbours, best=n, targets=ids, **options)
    return top_n(found.withColumnRenamed("target_id", "user_id"), n, ["user_id"], digits=digits)


def recommend_item_based(
    ratings: DataFrame, n: int = 10, k: int = 10, neighbours: str = "identity", targets: DataFrame | None = None,
    digits: int | None = OUTPUT_DIGITS, **options
) -> DataFrame:
    """Top-n unrated items of every user (or of ``targets``) by item-based prediction."""
    cells = item_cells(ratings)
    asked_for = None if targets is None else targets.select(F.col("user_id").alias("dim"))
    found = neighbour_predictions(cells, k, neighbours, best=n, per_target=False, columns=asked_for, **options)
    found = found.select(F.col("item_id").alias("user_id"), F.col("target_id").alias("item_id"), "score")
    if targets is not None:
        found = found.join(targets.select("user_id").distinct(), "user_id", "left_semi")
    return top_n(found, n, ["user_id"], digits=digits)


def user_liked(ratings: DataFrame, min_rating: float = 7.0) -> DataFrame:
    return ratings.filter(F.col("rating") >= min_rating)
