"""Sharding by a hierarchical weighted hash tree: every row descends region, rack and shard by weighted hash draws.

At a node each child draws `-ln(u) / weight`, where u in (0, 1) comes from a hash of the row's key and the child's name; the
smallest draw wins. A child wins in proportion to its weight, and a row's path below a node depends on that subtree alone:
when weights change, rows move only into or out of the children whose weight changed.
"""

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.numbering import numbered

Tree = dict[str, dict[str, dict[int, float]]]


def balanced_tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2) -> Tree:
    """Shards 0..n-1 of weight 1, filled rack by rack and region by region."""
    tree: Tree = {}
    for shard in range(shards):
        rack = shard // shards_per_rack
        tree.setdefault(f"region{rack // racks_per_region}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
    return tree


def grown_tree(tree: Tree) -> Tree:
    """The tree with one more shard, in a region of its own: no weight of an old subtree changes, so rows move only into it."""
    new = max(s for racks in tree.values() for shards in racks.values() for s in shards) + 1
    return {**tree, f"region+{new}": {f"rack+{new}": {new: 1.0}}}


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**53))) / F.lit(float(weight))


def _winner(key: Column, children: dict[str, tuple[float, Column]]) -> Column:
    """The column of the child with the smallest draw; equal draws go to the smaller name."""
    if len(children) == 1:
        return next(iter(children.values()))[1]
    drawn = {name: _draw(key, name, weight) for name, (weight, _) in children.items()}
    least = F.least(*drawn.values())
    out = None
    for name in sorted(children, reverse=True):
        below = children[name][1]
        out = below if out is None else F.when(drawn[name] == least, below).otherwise(out)
    return out


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key."""
    regions = {}
    for region, racks in tree.items():
        inner = {}
        for rack, shards in racks.items():
            leaves = {f"shard{s}": (w, F.lit(s)) for s, w in shards.items()}
            inner[rack] = (sum(shards.values()), _winner(key, leaves))
        regions[region] = (sum(w for w, _ in inner.values()), _winner(key, inner))
    return _winner(key, regions).cast("int")


def assign(docs: DataFrame, tree: Tree | None = None, shards: int = 8) -> DataFrame:
    """Puts rows into shards by their doc_id, and numbers the rows of every shard without gaps from 0.

    Returns doc_id, size (UTF-8 bytes of the text and 1; a null text has none), text_crc32 (of the bytes; 0 for null), law
    (`key`), shard, slot and grown_shard (the shard when one more is added). Rows of one doc_id, repeated rows too, share a
    shard and get slots of their own; a null doc_id is a key like others, an empty table gives an empty table. Equal texts
    with different ids are placed apart. Other columns are ignored. Only built-in functions are used.
    """
    tree = tree or balanced_tree(shards)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    # A null key hashes to the bare seed, as do all nulls.
    key = F.col("doc_id")
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
        place(key, tree).alias("shard"), place(key, grown_tree(tree)).alias("grown_shard"),
    )
    out = numbered(rows, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def moved(before: dict, after: dict) -> dict:
    """How many keys went from one shard to another; for tests and reports on small tables."""
    out: dict = defaultdict(int)
    for key, shard in before.items():
        if after[key] != shard:
            out[shard, after[key]] += 1
    return dict(out)
