"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

Every node has a weight; a key draws an exponential number at each child of the node
it stands on, ``-ln(u) / weight`` with ``u`` hashed from key and child, and descends to
the smallest.  A child therefore gets its weight's share, and a changed weight moves
keys only into or out of the subtrees whose weights changed.  All columns are built-in
functions; the tree has a few nodes and is part of the expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, numbered, sums_before, unit_hash

REGION_RACKS = 3
RACK_SHARDS = 4
#: Rows of the order that are sorted in one piece.
PIECE_ROWS = 1_000_000


@dataclass(frozen=True)
class Node:
    """A named subtree; a leaf carries its shard number."""

    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int | None = None


def parent(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def tree(n_shards: int, added: int = 0, racks: int = REGION_RACKS, shards: int = RACK_SHARDS,
         weights: dict[int, float] | None = None) -> Node:
    """A tree of ``n_shards`` leaves, ``shards`` to a rack and ``racks`` to a region, and ``added`` shards after them.

    Each added shard opens a region of its own, so the only subtree whose weight
    changes is the new one, and keys move into the new shard alone.
    """
    if n_shards < 1 or racks < 1 or shards < 1:
        raise ValueError("a tree needs at least one shard")
    leaf = [Node(f"s{i}", (weights or {}).get(i, 1.0), (), i) for i in range(n_shards + added)]
    rack = [parent(f"k{i}", leaf[a:min(a + shards, n_shards)]) for i, a in enumerate(range(0, n_shards, shards))]
    region = [parent(f"r{i}", rack[a:a + racks]) for i, a in enumerate(range(0, len(rack), racks))]
    region += [parent(f"a{x.shard}", [parent(f"b{x.shard}", [x])]) for x in leaf[n_shards:]]
    return parent("root", region)


def levels(root: Node) -> tuple[list[Node], list[list[int]], int]:
    """The nodes in breadth-first order, the open children of each, and the depth of the tree."""
    nodes, kids, depth, line = [root], [], 0, [root]
    while any(n.children for n in line):
        line = [c for n in line for c in n.children]
        nodes += line
        depth += 1
    place = {id(n): i for i, n in enumerate(nodes)}
    kids = [[place[id(c)] for c in n.children if c.weight > 0] for n in nodes]
    return nodes, kids, depth


def assign(docs: DataFrame, key: str, root: Node, name: str = "shard", seed: str = "shard") -> DataFrame:
    """Add the shard of each row by its key; a null key counts as the text ``null``.

    One step per level of the tree: the draws of the children of the node a row stands
    on are compared, ties fall to the earlier child.  A leaf stays where it is.
    """
    nodes, kids, depth = levels(root)
    if len(nodes) > 100_000:
        raise ValueError("the tree is part of every row's expression; split one this large by regions first")
    # Three literal arrays over the nodes; an expression per node would make the plan grow with the tree.
    names = F.expr("array(" + ", ".join(f"'{n.name}'" for n in nodes) + ")")
    weights = F.expr("array(" + ", ".join(f"{float(n.weight)!r}D" for n in nodes) + ")")
    below = F.expr("array(" + ", ".join("array(" + ", ".join(map(str, kids[i] or [i])) + ")" for i in range(len(nodes))) + ")")
    ident, spot = fresh(docs, "__key"), fresh(docs, "__node")
    out = docs.withColumn(ident, F.coalesce(F.col(key).cast("string"), F.lit("null"))).withColumn(spot, F.lit(0))
    for _ in range(depth):
        draws = F.transform(F.get(below, F.col(spot)), lambda i: F.struct(
            (-F.log(unit_hash(seed, F.get(names, i), F.col(ident))) / F.get(weights, i)).alias("draw"), i.alias("node")))
        out = out.withColumn(spot, F.array_min(draws)["node"])
    shards = F.expr("array(" + ", ".join("cast(null as int)" if n.shard is None else str(n.shard) for n in nodes) + ")")
    return out.withColumn(name, F.get(shards, F.col(spot))).drop(ident, spot)


def slots(rows: DataFrame, group: str, key: str, name: str = "slot", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the order of a hash of ``key``, then of all columns.

    Equal rows are counted before anything is sorted, the order is cut into pieces of about
    ``piece_rows`` by range, and a piece starts after those before, so neither a large
    group nor a repeated key meets in a task, and the numbers do not depend on the pieces.
    """
    spot, copies, before, copy = (fresh(rows, n) for n in ("__spot", "__copies", "__start", "__copy"))
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(copies))
    counted = counted.withColumn(spot, unit_hash("slot", F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    order = [spot, key, *[c for c in rows.columns if c not in (key, group)]]
    placed = numbered(sums_before(counted, group, order, copies, before, piece_rows), copies, copy)
    return placed.withColumn(name, (F.col(before) + F.col(copy)).cast("bigint")).select(*rows.columns, name)


def shard_documents(docs: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 8, ``text_crc32`` the
    unsigned checksum of those bytes (null: as the empty text).  The law is ``key``: the
    id and the tree alone decide, so equal texts may part and repeated rows stay together;
    a null id is placed as the text ``null``.  ``slot`` counts each shard's rows from 0, and
    ``grown_shard`` is the place after one more shard has joined in a region of its own.
    An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
                       F.crc32(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("text_crc32"), F.lit("key").alias("law"))
    placed = assign(assign(rows, "doc_id", tree(n_shards)), "doc_id", tree(n_shards, added=1), "grown_shard")
    return slots(placed, "shard", "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
