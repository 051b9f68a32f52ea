"""Shards of near-equal bytes by k-d tree partitioning.

The root holds all documents and all shards. A node with more than one shard splits along its widest
metadata dimension (range in the node over range in the table) at the weighted median: the value below
which its documents hold the left child's share of the bytes. Nodes with one shard are leaves and hold the
target bytes. Dimensions are numbers: the id, the text's bytes, and the first seven bytes of source and
language. Documents with the split value itself are told apart by a digest of their id, so ties (a source
with a third of all rows) split as finely as anything else.

All nodes of a level search at once. A round is one aggregate: bytes by node and by one of ``BINS`` equal
cells of the node's current bracket; the bracket shrinks to the cell that holds the median until it is one
value, then the same runs over the digests. The driver sees at most shards x BINS sums a round and keeps
the tree, shards - 1 splits, which turns into one nested CASE. No row moves until the slots are numbered,
in two levels, per shard and digest range.

Defined results: a null text has no bytes (size 16, checksum 0); a null id, source or language counts as
the lowest value; rows that repeat an id cannot be told apart by its digest and stay together; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_digest, pinned, table

BINS = 4096
DIMENSIONS = ("by_id", "by_bytes", "by_source", "by_lang")


def _head(name: str) -> Column:
    """The first seven bytes as a number in the same order."""
    raw = F.rpad(F.hex(F.substring(F.col(f"`{name}`").cast("binary"), 1, 7)), 14, "0")
    return F.coalesce(F.conv(raw, 16, 10).cast("long"), F.lit(0))


def metadata(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return docs.select(
        "doc_id", (size + 16).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("by_id"), size.alias("by_bytes"),
        _head("source").alias("by_source"), _head("lang").alias("by_lang"),
        F.coalesce(F.conv(F.substring(id_digest(F.col("doc_id")), 1, 15), 16, 10).cast("long"), F.lit(0)).alias("tie"),
        F.coalesce(F.substring(id_digest(F.col("doc_id")), 1, 3), F.lit("")).alias("part"))


@dataclass
class Node:
    shards: int
    first: int
    dimension: str | None = None
    value: int = 0
    tie: int = 0
    left: Node | None = None
    right: Node | None = None
    # of the search for the split
    goal: float = 0.0
    low: int = 0
    high: int = 0
    below: float = 0.0
    held: int = 0
    alone: bool = False

    def label(self, leaf=lambda node: str(node.first)) -> str:
        """SQL: ``leaf`` of the leaf, or of the node so far, that a document belongs to; one nested CASE."""
        if self.left is None:
            return leaf(self)
        at, value = self.dimension, f"{self.value}L"
        return (f"CASE WHEN {at} < {value} OR ({at} = {value} AND tie < {self.tie}L) "
                f"THEN {self.left.label(leaf)} ELSE {self.right.label(leaf)} END")


def _shrink(rows: DataFrame, root: Node, nodes: dict[int, Node], ties: bool) -> None:
    """Shrink the bracket [low, high] of every node to the one value that holds its weighted median.

    Searched is the node's dimension or, with ``ties``, the digest of the documents that have the split
    value. ``held`` is left at the bytes of the value found, ``below`` at the bytes under it.
    """
    open_nodes = {k: n for k, n in nodes.items() if n.low < n.high}

    def key(n: Node) -> str:
        if n.first not in open_nodes:
            return "CAST(NULL AS BIGINT)"
        wide = (n.high - n.low) // BINS + 1
        at = "tie" if ties else n.dimension
        also = f" AND {n.dimension} = {n.value}L" if ties else ""
        return (f"CASE WHEN {at} BETWEEN {n.low}L AND {n.high}L{also} "
                f"THEN {n.first * 2 * BINS}L + ({at} - {n.low}L) DIV {wide}L END")

    while open_nodes:
        sums = (rows.select(F.expr(root.label(key)).alias("key"), "size").where("key is not null")
                .groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect())
        by_node: dict[int, list[tuple[int, int, int]]] = {}
        for r in sums:
            by_node.setdefault(r["key"] // (2 * BINS), []).append((r["key"] % (2 * BINS), r["bytes"], r["n"]))
        for k, n in open_nodes.items():
            wide = (n.high - n.low) // BINS + 1
            cells = sorted(by_node.get(k, []))
            for cell, held, count in cells:
                if n.below + held > n.goal or cell == cells[-1][0]:
                    n.low, n.high, n.held = n.low + cell * wide, min(n.high, n.low + (cell + 1) * wide - 1), held
                    n.alone = ties and count == 1  # any value of the cell tells it from the others
                    break
                n.below += held
        open_nodes = {k: n for k, n in open_nodes.items() if n.low < n.high and not n.alone}


def kd_tree(rows: DataFrame, shards: int) -> Node:
    """The tree over the metadata table ``rows``; driver-side state is the tree alone."""
    bounds = [f(d) for d in DIMENSIONS for f in (F.min, F.max)]
    span = rows.agg(*bounds).first()
    widths = {d: max(1, (span[2 * i + 1] or 0) - (span[2 * i] or 0)) for i, d in enumerate(DIMENSIONS)}
    root = Node(shards, 0)
    level = [root] if shards > 1 and span[0] is not None else []
    while level:
        found = (rows.select(F.expr(root.label()).alias("node"), "size", *DIMENSIONS).groupBy("node")
                 .agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS
                                                      for n, f in (("lo", F.min), ("hi", F.max))]).collect())
        seen = {r["node"]: r for r in found}
        nodes = {n.first: n for n in level if n.first in seen}
        for k, n in nodes.items():
            r = seen[k]
            n.dimension = max(DIMENSIONS, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / widths[d])
            n.low, n.high = r[f"lo_{n.dimension}"], r[f"hi_{n.dimension}"]
            n.goal, n.below = r["bytes"] * (n.shards // 2) / n.shards, 0.0
        _shrink(rows, root, nodes, ties=False)
        for n in nodes.values():
            n.value, n.low, n.high = n.low, 0, 16 ** 15 - 1
        _shrink(rows, root, nodes, ties=True)
        for n in nodes.values():
            # The document at the median goes where it leaves the smaller error.
            n.tie = n.high + 1 if n.below + n.held - n.goal < n.goal - n.below else n.low
            n.left, n.right = Node(n.shards // 2, n.first), Node(n.shards - n.shards // 2, n.first + n.shards // 2)
        level = [c for n in nodes.values() for c in (n.left, n.right) if c.shards > 1]
    return root


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in every shard."""
    parts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("shard", "part").orderBy("tie", "doc_id", "text_crc32", "size")
    return (rows.join(parts, ["shard", "part"])
            .withColumn("slot", (F.col("base") + F.row_number().over(inside) - 1).cast("long")))


def kd_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    rows = pinned(metadata(docs))
    placed = rows.withColumn("shard", F.expr(kd_tree(rows, shards).label()).cast("int"))
    return numbered(placed).select("doc_id", "size", "text_crc32", "shard", "slot")


def op6_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    return kd_shards(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
