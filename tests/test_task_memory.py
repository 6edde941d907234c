"""What a task of neighbour predictions and top-n lists is sent and holds, whatever the size of the table."""

import numpy as np
import pyarrow as pa
import pytest

from kindred.operators import collab
from kindred.operators import similarity as sim


def ratings_of(spark, users, items, each, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(u, int(i), float(rng.integers(1, 11))) for u in range(users) for i in rng.choice(items, each, replace=False)]
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double")


def test_rows_are_sent_to_as_many_tasks_as_cores(spark, monkeypatch):
    """More targets need no more tasks, so what is sent grows with the table alone; the lists stay the same."""
    ratings = ratings_of(spark, 90, 40, 6)
    told = lambda df: sorted(map(tuple, df.collect()))
    whole = [told(f(ratings, n=4, k=3)) for f in (collab.recommend_user_based, collab.recommend_item_based)]
    asked_for = []
    by_task = sim.by_task
    monkeypatch.setattr(sim, "by_task", lambda rows, tasks: asked_for.append(tasks) or by_task(rows, tasks))
    monkeypatch.setattr(collab, "TARGET_ROWS", 2)
    cut = [told(f(ratings, n=4, k=3)) for f in (collab.recommend_user_based, collab.recommend_item_based)]
    collab.predict_user_based(ratings, ratings, k=3)
    assert cut == whole and max(asked_for) <= sim.cores(ratings)


@pytest.mark.parametrize("few", [collab.FEW_VALUES, 3])
def test_a_task_holds_few_bytes_for_a_cell(monkeypatch, few):
    """Six bytes by column where weights are few, twelve else; nothing by row if cells are asked for."""
    monkeypatch.setattr(collab, "FEW_VALUES", few)
    monkeypatch.setattr(collab, "NAMES_AT_ONCE", 50)
    rng = np.random.default_rng(1)
    rows, each = 500, 20
    dims, ws = rng.integers(0, 90, rows * each), rng.integers(1, 9, rows * each) / 2
    edges = np.arange(0, rows * each + 1, each, dtype=np.int32)
    table = pa.table({"id": np.arange(rows), "dims": pa.ListArray.from_arrays(edges, dims), "ws": pa.ListArray.from_arrays(edges, ws), "norm": np.ones(rows)})
    packs = [sim._compressed(table.slice(at, 100)) for at in range(0, rows, 100)]
    asked = [pa.table({"id": np.arange(rows), "dim": np.arange(rows) % 90})]
    block = collab._Block.of_packs(asked, packs, (pa.int64(), pa.int64()))
    cell = sum(x.nbytes for x in block.by_column) / (rows * each)
    assert cell == (6 if few > 8 else 12) and not len(block.codes)
    got = sorted(zip(np.repeat(np.arange(90), np.diff(block.columns)), block.by_column[0].tolist(), block.weights(block.by_column[1], slice(None))))
    assert got == sorted(zip(dims, np.repeat(np.arange(rows), each), ws))


def test_targets_of_a_list_are_sent_once_and_candidates_once_a_core(spark, monkeypatch):
    monkeypatch.setattr(sim, "CANDIDATE_BLOCK", 5)
    monkeypatch.setattr(sim, "TARGET_BLOCK", 2)
    monkeypatch.setattr(sim, "SENT_BLOCKS", 1)
    sent = []
    by_task = sim.by_task
    monkeypatch.setattr(sim, "by_task", lambda rows, tasks: sent.append((rows, tasks)) or by_task(rows, tasks))
    cells = collab.user_cells(ratings_of(spark, 70, 30, 5))
    found = sim.cosine_topn(cells, 3)
    rows, tasks = sent[0]
    assert tasks <= sim.cores(cells)
    assert rows.filter("side = 0").count() == 70 and rows.filter("side = 3").count() <= tasks * cells.rdd.getNumPartitions()
    assert found.count() == 210


def packed_rows(ids, matrix, norms=True):
    dims = [np.flatnonzero(row).tolist() for row in matrix]
    table = {"id": pa.array(ids), "dims": pa.array(dims, pa.list_(pa.int64())), "ws": pa.array([row[d].tolist() for row, d in zip(matrix, dims)], pa.list_(pa.float64()))}
    return pa.table(table | ({"norm": np.sqrt((matrix ** 2).sum(1))} if norms else {}))


def sent_rows(table, candidates, masked, names):
    """Targets, masked pairs and packs as a task gets them."""
    cells, fill = pa.list_(pa.int64()), pa.list_(pa.float64())
    def batch(side, count, tid=None, dims=None, ws=None, norm=None, masked=None, pack=None):
        held = {"side": pa.array([side] * count, pa.int32()), "tid": (tid, names), "dims": (dims, cells), "ws": (ws, fill)}
        held |= {"norm": (norm, pa.float64())} if "norm" in table.column_names else {}
        held |= {"masked": (masked, pa.list_(names)), "pack": (pack, pa.binary())}
        return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.nulls(count, v[1]) if v[0] is None else pa.array(v[0], v[1]) for k, v in held.items()})

    plain = {c: table.column(c).to_pylist() for c in table.column_names if c != "id"}
    yield batch(0, table.num_rows, table.column("id").to_pylist(), plain["dims"], plain["ws"], plain.get("norm"))
    if masked:
        yield batch(2, len(masked), [t for t, _ in masked], masked=[others for _, others in masked])
    packs = [sim._compressed(candidates.slice(at, 13)) for at in range(0, candidates.num_rows, 13)]
    yield batch(3, len(packs), pack=packs)


@pytest.mark.parametrize("dense, formed", [(2048, 16), (0, 10**9), (0, 0)])
@pytest.mark.parametrize("signed, floor, clip, norms", [(False, 5e-324, None, True), (True, 5e-324, None, True), (True, None, None, False), (True, None, (0.0, 3.0), False)])
def test_every_way_to_multiply_gives_the_best_of_all_pairs(monkeypatch, dense, formed, signed, floor, clip, norms):
    for name, value in (("DENSE_DIMS", dense), ("FORMED", formed), ("TARGET_BLOCK", 7), ("STRIP", 5), ("WAITING", 20), ("DENSE_CELLS", 100)):
        monkeypatch.setattr(sim, name, value)
    rng = np.random.default_rng(7)
    def rows(count):
        return rng.integers(-2 if signed else 1, 3, (count, 12)) * (rng.random((count, 12)) < 0.3).astype(float)

    left, right = rows(30), rows(60)
    left[:, 0], right[:, 0] = 1.0, 1.0  # no row is empty
    left[:20] = right[:20]
    names, others = np.arange(30), rng.permutation(60)  # equal ids are one thing, told or not
    masked = [(int(t), [int(x) for x in rng.choice(60, 4, replace=False)]) for t in range(0, 30, 3)]
    lists = sim._best_of_block(4, floor, clip, True)(sent_rows(packed_rows(names, left, norms), packed_rows(others, right, norms), masked, pa.int64()))
    got = {}
    for table in lists:
        for t, c, s in zip(*(table.column(x).to_pylist() for x in ("target_id", "item_id", "score"))):
            got.setdefault(t, []).append((c, s))
    scores = left @ right.T
    if norms:
        scores = scores / np.outer(np.sqrt((left ** 2).sum(1)), np.sqrt((right ** 2).sum(1)))
    scores = np.clip(scores, *clip) if clip else scores
    out = dict(masked)
    for t in range(30):
        want = sorted((-round(s, 9), int(c)) for c, s in zip(others, scores[t]) if c != t and c not in out.get(t, []) and (floor is None or s > 1e-12))[:4]
        assert sorted((-round(s, 9), c) for c, s in got.get(t, [])) == [(pytest.approx(s, abs=2e-9), c) for s, c in want]
