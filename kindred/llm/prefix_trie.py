"""Prefix trie of conversations from sorted matrices of turn ids.

Every turn becomes a 63-bit hash of role and text. Conversations are sorted by their turns and cut by ranges into shards; a shard
is a padded matrix with a row for each conversation, put in order by a lexsort. Where a row differs from the one before, in a
column or in one further left, a node of that depth starts, and a reduceat over these starts aggregates the whole depth.
All aggregates are sums (or minima) over rows once the rows next to a shard are known: a node is counted where it starts, a leaf
where it ends. So nodes that lie in several shards are put together by adding their parts.

Depths are worked on in bands, the first BAND turns and then twice as many each time, the deepest band first. A deeper band
takes only conversations that share their first node there with others; what one conversation alone goes through is a chain
whose nodes are written down directly, however long it is.
"""

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import materialize

GROUP, HEAD_TURNS = 5, 8
BAND = 32
ROWS_PER_SLICE = 200_000
SHARD_BYTES = 16 << 20
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def numbered_turns(conversations: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """conv_id, pos from 1, turn_id and bytes of every turn, in order of turn (null first), then role and the turn's hash.

    Rows are dealt by ranges of that order, so one long conversation lies in many slices; a slice numbers what it holds, and
    only the one conversation that goes on from the slices before gets their count added.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"),
        F.shiftrightunsigned(F.xxhash64(role, text), 1).alias("turn_id"), F.octet_length(text).cast("long").alias("bytes"),
    )
    # Equal rows are interchangeable; the last key lets a slice end among them.
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("turn_id"), F.monotonically_increasing_id()]
    slices = max(1, -(-conversations.count() // rows_per_slice))

    def number(batches):
        here, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            first = np.concatenate([[True], conv[1:] != conv[:-1]])
            begin = np.maximum.accumulate(np.where(first, np.arange(len(conv)), 0))
            pos = np.arange(len(conv)) - begin + 1
            if conv[0] == last:
                pos[begin == 0] += seen
            last, seen = conv[-1], int(pos[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(conv), here, np.int32)), pa.array(pos), batch.column(1), batch.column(2)],
                names=["conv_id", "_slice", "pos", "turn_id", "bytes"],
            )

    dealt = rows.repartitionByRange(slices, *order).sortWithinPartitions(*order).select("conv_id", "turn_id", "bytes")
    local = materialize(dealt.mapInArrow(number, "conv_id long, _slice int, pos long, turn_id long, bytes long"))
    held = local.groupBy("conv_id", "_slice").agg(F.max("pos").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.withColumn("_before", F.sum("_n").over(before)).where("_before > 0").drop("_n")
    return local.join(offsets, ["conv_id", "_slice"], "left").select("conv_id", (F.col("pos") + F.coalesce("_before", F.lit(0))).alias("pos"), "turn_id", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, turn_id, bytes) and lengths (conv_id, length) of the rebuilt conversations.

    Of conversation c the first h turns, h = crc32(c) % 9, are those of c - c % 5, as far as it has them. At most GROUP
    conversations take turns from one, and HEAD_TURNS turns at most.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    heads = turns.where(F.col("pos") <= HEAD_TURNS).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "turn_id", "bytes"))).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    own = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    given = own.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    given = given.withColumn("head", F.when(F.col("head").isNull() | (F.col("h") == 0), F.lit(None)).otherwise(F.slice("head", 1, F.greatest("h", F.lit(1)))))
    given = materialize(given.select("conv_id", "n", "h", "head", F.when(F.col("head").isNull(), 0).otherwise(F.size("head")).alias("taken")))
    first = given.select("conv_id", F.inline("head")).select("conv_id", F.col("pos").alias("depth"), "turn_id", "bytes")
    rest = turns.join(given.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "turn_id", "bytes")
    lengths = given.select("conv_id", (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("taken")).cast("long").alias("length"))
    return first.unionByName(rest), lengths


def _matrix(lists: pa.Array, width: int, fill: int) -> np.ndarray:
    """Lists as rows of equal width."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.full((len(sizes), width), fill, np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _column(table: pa.Table, name: str):
    return table.column(name).combine_chunks() if table.num_rows else pa.array([], table.schema.field(name).type)


class Shard:
    """Sorted conversations of one range and the rows before and after it."""

    def __init__(self, table: pa.Table, guard: dict) -> None:
        ids, sizes = _column(table, "ids"), _column(table, "sizes")
        lengths = np.diff(ids.offsets.to_numpy())
        guards = [guard[side] for side in ("before", "after")]
        self.width = max([int(lengths.max(initial=0)), *(len(g["ids"]) for g in guards if g)])
        m, z = _matrix(ids, self.width, -1), _matrix(sizes, self.width, 0)
        start, more, conv = (_column(table, c).to_numpy(zero_copy_only=False) for c in ("start", "more", "conv_id"))
        order = np.lexsort((conv, more, *m.T[::-1], start))
        self.ids, self.sizes, self.lengths = m[order], z[order], lengths[order]
        self.start, self.more, self.conv = start[order], more[order], conv[order]
        self.start_conv, self.saved, self.leaves, self.kids = (_column(table, c).to_numpy()[order] for c in ("start_conv", "saved", "leaves", "kids"))
        self.n = len(order)
        # changed[r, d]: row r differs from the row before in its first d turns; the last row stands for what comes after.
        around = [np.array([*g["ids"], *[-1] * (self.width - len(g["ids"]))], np.int64)[None] if g else None for g in guards]
        lines = np.vstack([around[0] if guards[0] else self.ids[:1], self.ids, around[1] if guards[1] else self.ids[-1:]])
        starts = np.concatenate([[guards[0]["start"] if guards[0] else 0], self.start, [guards[1]["start"] if guards[1] else 0]])
        differs = np.column_stack([starts[1:] != starts[:-1], lines[1:] != lines[:-1]])
        differs[0, 0] |= not guards[0]
        differs[-1, 0] |= not guards[1]
        self.changed = np.logical_or.accumulate(differs, axis=1)
        rows = np.arange(self.n)
        ends_here = ~self.more & self.changed[rows + 1, self.lengths]
        self.leaf = np.where(ends_here, 1, np.where(self.more, self.leaves, 0))
        repeated = np.where(self.changed[:-1, 1:], 0, self.sizes)
        self.later = np.zeros((self.n, self.width + 1), np.int64)
        self.later[:, : self.width] = np.cumsum(repeated[:, ::-1], axis=1)[:, ::-1]
        self.later += self.saved[:, None]

    def key(self, row: int, depth: int) -> bytes:
        return hashlib.blake2b(np.concatenate([self.start[row : row + 1], self.ids[row, :depth]]).astype("<i8").tobytes(), digest_size=16).digest()

    def levels(self, first: int):
        """Columns of the nodes of each depth from `first` on; nodes that go on in other shards carry their key."""
        group = open_ = keys = convs = None
        for d in range(first, self.width + 1):
            rows = np.flatnonzero(self.lengths >= d)
            if not len(rows):
                break
            begins = self.changed[rows, d].copy()
            begins[0] = True
            at = np.flatnonzero(begins)
            heads = rows[at]
            lasts = rows[np.append(at[1:], len(rows)) - 1]
            here = self.lengths[rows] == d
            child = np.where(here, np.where(self.more[rows], self.kids[rows], 0), self.changed[rows, min(d + 1, self.width)])
            ended = here & ~self.more[rows]
            least = np.minimum.reduceat(self.conv[rows], at)
            outside = (heads == 0) & ~self.changed[0, d] | (lasts == self.n - 1) & ~self.changed[self.n, d]
            own_keys = [self.key(r, d) if o else None for r, o in zip(heads.tolist(), outside.tolist(), strict=True)]
            if d <= 1 or group is None:
                parents, parent_keys = self.start_conv[heads], [None] * len(heads)
            else:
                above = group[heads]
                parents, parent_keys = convs[above], [keys[k] if open_[k] else None for k in above.tolist()]
            ends = [b""] * len(heads)
            for k in np.flatnonzero(np.add.reduceat(ended, at)).tolist():
                chosen = rows[at[k] : at[k + 1] if k + 1 < len(at) else len(rows)]
                chosen = chosen[(self.lengths[chosen] == d) & ~self.more[chosen]]
                ends[k] = ",".join(map(str, self.conv[chosen].tolist())).encode()
            yield {
                "key": own_keys, "conv_id": least, "depth": np.full(len(heads), d), "parent_conv_id": parents, "parent_key": parent_keys,
                "n_convs": np.diff(np.append(at, len(rows))), "n_children": np.add.reduceat(child.astype(np.int64), at),
                "n_leaves": np.add.reduceat(self.leaf[rows], at), "saved_tokens": np.add.reduceat(self.later[rows, max(d - 1, 0)], at),
                "ends": [e if o else None for e, o in zip(ends, outside.tolist(), strict=True)],
                "ends_sha256": [None if o else hashlib.sha256(e).hexdigest() if e else EMPTY_SHA for e, o in zip(ends, outside.tolist(), strict=True)],
            }
            group = np.full(self.n, -1)
            group[rows] = np.cumsum(begins) - 1
            open_, keys, convs = outside, own_keys, least


PART = pa.schema([
    ("kind", pa.int32()), ("shard", pa.int32()), ("key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    ("parent_key", pa.binary()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends", pa.binary()), ("ends_sha256", pa.string()),
])
PART_DDL = (
    "kind int, shard int, key binary, conv_id long, depth long, parent_conv_id long, parent_key binary, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends binary, ends_sha256 string"
)
WHOLE, SPLIT, CARRY = 0, 1, 2


def _ends_digest(parts: DataFrame) -> DataFrame:
    """key and ends_sha256 of nodes in several shards; the ids of a node stream through one hash in order of the shards."""

    def joined(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for k, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, state.hexdigest()))
                    key, state, empty = k, hashlib.sha256(), True
                if ends:
                    state.update(ends if empty else b"," + ends)
                    empty = False
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    rows = parts.select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    return rows.select("key", "ends").mapInArrow(joined, "key binary, ends_sha256 string")


def _band(rows: DataFrame, first_depth: int, first_level: int, shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of one band, and what its conversations carry up: (conv_id, saved, leaves, kids)."""
    row_count, longest = rows.agg(F.count("*"), F.max(F.size("ids"))).first()
    shards = max(1, -(-row_count * (16 * (longest or 0) + 64) // shard_bytes))
    order = ["start", "ids", "more", "conv_id"]
    dealt = materialize(rows.repartitionByRange(shards, *order).withColumn("shard", F.spark_partition_id()))
    edge = F.struct("start", "ids", "more", "conv_id")
    edges = dealt.groupBy("shard").agg(F.min(edge).alias("first"), F.max(edge).alias("last"))
    # One row for a shard.
    along = Window.orderBy("shard")
    guards = edges.select("shard", F.lag("last").over(along).alias("before"), F.lead("first").over(along).alias("after"))

    def nodes(key, table, guard):
        shard = Shard(table, guard.select(["before", "after"]).to_pylist()[0])
        parts = []
        for columns in shard.levels(first_level):
            n = len(columns["key"])
            split = np.array([k is not None for k in columns["key"]])
            columns["depth"] = columns["depth"] + first_depth
            values = {"kind": np.where(split, SPLIT, WHOLE), "shard": np.full(n, key[0].as_py()), **columns}
            parts.append(pa.table([pa.array(values[f.name], f.type) for f in PART], schema=PART))
        if first_level:
            none = [None] * shard.n
            values = {f.name: none for f in PART} | {
                "kind": np.full(shard.n, CARRY), "shard": np.full(shard.n, key[0].as_py()), "conv_id": shard.conv,
                "n_children": shard.changed[:-1, 1].astype(np.int64), "n_leaves": shard.leaf, "saved_tokens": shard.later[:, 0],
            }
            parts.append(pa.table([pa.array(values[f.name], f.type) for f in PART], schema=PART))
        return pa.concat_tables(parts).combine_chunks() if parts else PART.empty_table()

    parts = materialize(dealt.groupBy("shard").cogroup(guards.groupBy("shard")).applyInArrow(nodes, PART_DDL))
    split = parts.where(F.col("kind") == SPLIT)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    joined = split.groupBy("key").agg(F.min("conv_id").alias("conv_id"), *[F.first(c).alias(c) for c in ("depth", "parent_conv_id", "parent_key")], *sums)
    joined = materialize(joined.join(_ends_digest(split), "key"))
    all_nodes = parts.where(F.col("kind") == WHOLE).unionByName(joined, allowMissingColumns=True)
    known = all_nodes.where("parent_key IS NULL").select(*NODE)
    parents = joined.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    others = all_nodes.where("parent_key IS NOT NULL").join(parents, "parent_key").withColumn("parent_conv_id", F.col("_parent")).select(*NODE)
    carry = parts.where(F.col("kind") == CARRY).select("conv_id", F.col("saved_tokens").alias("saved"), F.col("n_leaves").alias("leaves"), F.col("n_children").alias("kids"))
    return known.unionByName(others), carry


def _with_arrays(turns: DataFrame) -> DataFrame:
    cells = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "turn_id", "bytes"))).alias("_cells"))
    return cells.select("conv_id", F.col("_cells.turn_id").alias("ids"), F.col("_cells.bytes").alias("sizes"))


def trie(turns: DataFrame, lengths: DataFrame, band: int = BAND, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for every node of the trie of the given conversations: NODE's columns.

    turns: conv_id, depth (1, 2, ...), turn_id, bytes; lengths: conv_id and length of each conversation, 0 included.
    """
    def band_of(depth):
        return F.length(F.bin((F.floor((depth - 1) / band) + 1).cast("long"))) - 1

    turns = materialize(turns.withColumn("band", band_of(F.col("depth"))))
    pieces = turns.groupBy("conv_id", "band").agg(*[F.bit_xor(F.xxhash64("turn_id", "depth", F.lit(k))).alias(f"x{k}") for k in (0, 1)])
    # A conversation that ends where a band ends is a member of that last node, but does not go on.
    stop = lengths.where("length > 0").select("conv_id", band_of(F.col("length")).alias("last"), band_of(F.col("length") + 1).alias("band"))
    pieces = pieces.withColumn("goes_on", F.lit(True)).unionByName(
        stop.where("band > last").select("conv_id", "band", *[F.lit(0).cast("long").alias(f"x{k}") for k in (0, 1)], F.lit(False).alias("goes_on"))
    )
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("conv_id", "band", "goes_on", *[F.bit_xor(f"x{k}").over(before).alias(f"x{k}") for k in (0, 1)]).where("band > 0")
    groups = starts.groupBy("band", "x0", "x1").agg(F.count_if("goes_on").alias("members"), F.min("conv_id").alias("start_conv"))
    deep = materialize(starts.where("goes_on").join(groups, ["band", "x0", "x1"]))
    shared = deep.where("members > 1").select("conv_id", "band", F.col("x0").alias("start"), "start_conv")
    done, carry = [], None
    for k in sorted((r.band for r in shared.select("band").distinct().collect()), reverse=True):
        first = band * (2**k - 1)
        members = shared.where(F.col("band") == k).drop("band").join(lengths, "conv_id")
        arrays = _with_arrays(turns.where(F.col("band") == k).join(members.select("conv_id"), "conv_id", "left_semi"))
        nodes, carry = _band(_carried(members.join(arrays, "conv_id"), carry, band * (2 ** (k + 1) - 1)), first, 1, shard_bytes)
        done.append(nodes)
    least = lengths.agg(F.min("conv_id")).first()[0]
    members = lengths.withColumn("start", F.lit(0).cast("long")).withColumn("start_conv", F.lit(least).cast("long"))
    nothing = F.array().cast("array<long>")
    arrays = members.join(_with_arrays(turns.where("band = 0")), "conv_id", "left")
    arrays = arrays.withColumn("ids", F.coalesce("ids", nothing)).withColumn("sizes", F.coalesce("sizes", nothing))
    nodes, _ = _band(_carried(arrays, carry, band), 0, 0, shard_bytes)
    done.append(nodes.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id"))))
    alone = deep.where("members = 1").select("conv_id", "band", "start_conv")
    chain = turns.join(alone, ["conv_id", "band"]).join(lengths, "conv_id")
    last, head = F.col("depth") == F.col("length"), band_of(F.col("depth") - 1) < F.col("band")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    done.append(chain.select(
        "conv_id", "depth", F.when(head, F.col("start_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"),
        none.alias("saved_tokens"), F.sha2(F.when(last, F.col("conv_id").cast("string")).otherwise("").cast("binary"), 256).alias("ends_sha256"),
    ))
    return list(accumulate(done, DataFrame.unionByName))[-1]


def _carried(rows: DataFrame, carry: DataFrame | None, end: int) -> DataFrame:
    """Rows with what their deeper turns add: conversations that go on alone are one leaf and one child."""
    more = F.col("length") > end
    if carry is not None:
        rows = rows.join(carry, "conv_id", "left")
    def value(name, alone):
        given = F.col(name) if carry is not None else F.lit(None)
        return F.when(more, F.coalesce(given, F.lit(alone))).otherwise(0).cast("long").alias(name)

    return rows.select("conv_id", "start", "start_conv", "ids", "sizes", more.alias("more"), value("saved", 0), value("leaves", 1), value("kids", 1))


def nodes(conversations: DataFrame, band: int = BAND, shard_bytes: int = SHARD_BYTES, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The trie of the rebuilt conversations, one row for each node.

    Turns go by number, null first, equal numbers by role and then by a hash of role and text; a null role or text is empty.
    Rows without a conv_id belong to no conversation and are left out; repeated rows are turns of their own. c % 5 has the sign
    of c. An empty table has no node, any other has a root. Other columns are ignored. Turns are the same when their 63-bit
    hashes are: the chance of a wrong pair among n is n * n / 2**64.
    """
    turns = materialize(numbered_turns(conversations, rows_per_slice))
    rows, lengths = rebuilt(turns)
    return trie(rows, lengths, band, shard_bytes)


ORACLE = r"""WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (SELECT c.conv_id, o.pos AS seat, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 5 AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 100 + o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
placed AS (SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS bytes,
  string_agg(sha256(octet_length(encode(role)) || ':' || role || text), '/') OVER w AS prefix FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY seat)),
path AS (SELECT conv_id, depth, bytes, sha256(prefix) AS node FROM placed UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs),
ends AS (SELECT conv_id, max(depth) AS length FROM path GROUP BY 1),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
  coalesce(sha256(string_agg(CASE WHEN depth = length THEN conv_id::VARCHAR END, ',' ORDER BY conv_id)), sha256('')) AS ends_sha256
  FROM path JOIN ends USING (conv_id) GROUP BY 1, 2),
ranked AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN path p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
children AS (SELECT parent AS node, count(*) AS n_children FROM ranked WHERE parent IS NOT NULL GROUP BY 1),
full_ AS (SELECT r.*, coalesce(c.n_children, 0) AS n_children FROM ranked r LEFT JOIN children c USING (node)),
subtree AS (SELECT p.node, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved_tokens
  FROM full_ f JOIN path p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY 1)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_ f JOIN subtree s USING (node) LEFT JOIN nodes q ON q.node = f.parent"""
