"""Near-duplicate vectors by collision counting over one-dimensional projections.

Unit vectors with cosine ``c`` are ``sqrt(2 - 2c)`` apart, and along a random direction in ``d`` dimensions
their difference is normal with that length over ``sqrt(d)``. All settings follow from this law at the
threshold and from the number of vectors:

* a *table* is several projections whose positions are cut into segments; vectors are sorted by table and
  by the cell of all its segments. As many projections as leave a random vector few companions, as many
  tables as bring a pair at the threshold together at least once with probability ``RECALL``;
* in a cell, a vector's window in each of ``COUNTED`` further projections is centred on it and
  ``HALF_WIDTH`` standard deviations wide to either side; the members are sorted by the first, on which partners over
  ``REACH`` deviations apart (6 in 100,000 at the threshold) are left out, and their collisions counted over all. The count a pair must reach is the quantile of its law at the threshold that
  loses one in a thousand;
* pairs that reach it are verified by their cosine in double precision.

A pair that meets in several tables is counted in the first of them, which both members' keys tell, so no
list of pairs is ever shuffled: a cell returns the number of links per vector and a spanning forest. Equal
vectors are one node with a count. A cell of more than ``BLOCK`` vectors is dealt into blocks, and each pair of blocks
is a task group of its own, so memory is bounded and no pair is left out.

Defined results: vectors that are null, zero or hold null or non-finite numbers, vectors of another length
than most, and rows with a null id have no links and are their own component; repeated rows link with each
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pinned, table
from .components import components
from .runs import groups

RECALL, COUNTED, HALF_WIDTH, REACH, BLOCK = 0.97, 64, 2.0, 4.0, 2048
SEGMENT = 0.8  # of a projection's half range of three standard deviations, in the units of 1 / sqrt(d)


@dataclass(frozen=True)
class Plan:
    dimension: int
    threshold: float
    per_table: int
    tables: int
    segment: float
    window: float
    least: int

    def directions(self, salt: int, count: int) -> np.ndarray:
        rng = np.random.default_rng([salt, self.dimension])
        found = rng.normal(size=(self.dimension, count))
        return found / np.linalg.norm(found, axis=0)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Key of every vector in every table."""
        rng = np.random.default_rng([3, self.dimension])
        shift = rng.uniform(0, self.segment, self.per_table * self.tables)
        mix = rng.integers(1, 1 << 62, self.per_table) * 2 + 1
        at = np.floor((unit @ self.directions(1, len(shift)) + shift) / self.segment).astype(np.int64)
        with np.errstate(over="ignore"):
            mixed = (at.reshape(len(unit), self.tables, self.per_table) * mix).sum(2)
            return (mixed ^ (mixed >> 31)) * np.int64(0x1E3779B97F4A7C15)


def calibrated(dimension: int, count: int, threshold: float) -> Plan:
    """The settings for ``count`` vectors of this dimension."""
    spread = math.sqrt(2 - 2 * threshold) / math.sqrt(dimension)  # of the difference, at the threshold
    segment = 3 * SEGMENT / math.sqrt(dimension)
    together = 1 - spread * math.sqrt(2 / math.pi) / segment  # one segment holds both
    far = math.sqrt(2 / dimension)
    stray = 1 - far * math.sqrt(2 / math.pi) / segment if far < segment else 0.5
    stray = min(max(stray, 0.3), 0.7)
    per_table = max(4, round(math.log(max(2.0, count / 64)) / -math.log(stray)))
    tables = max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - together ** per_table)))
    hit = math.erf(HALF_WIDTH / math.sqrt(2))
    law = [math.comb(COUNTED, k) * hit ** k * (1 - hit) ** (COUNTED - k) for k in range(COUNTED + 1)]
    least = max(k for k in range(COUNTED + 1) if sum(law[:k]) <= 0.001)
    return Plan(dimension, threshold, per_table, tables, segment, HALF_WIDTH * spread, least)


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _dealt(nodes: DataFrame, plan: Plan, narrow: bool) -> DataFrame:
    """(tbl, cell) or (tbl, cell, gid, size, vector, keys) for every vector and table."""
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(2), plan.dimension))
            keys = plan.cells(unit)
            raw = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (unit, keys)]
            for t in range(plan.tables):
                first = [pa.array(np.full(len(keys), t, np.int64)), pa.array(np.ascontiguousarray(keys[:, t]))]
                rest = [] if narrow else [batch.column(0), batch.column(1), *raw]
                yield pa.RecordBatch.from_arrays(first + rest, names=["tbl", "cell", "gid", "size", "vector", "keys"][:len(first + rest)])

    schema = "tbl long, cell long" + ("" if narrow else ", gid long, size long, vector binary, keys binary")
    return nodes.select("gid", "size", "vector").mapInArrow(one, schema)


def _pairs(unit_a: np.ndarray, unit_b: np.ndarray, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs whose windows collide often enough and whose cosine reaches the threshold."""
    lines = plan.directions(2, COUNTED)
    a, b = unit_a @ lines, unit_b @ lines
    order_a, order_b = np.argsort(a[:, 0], kind="stable"), np.argsort(b[:, 0], kind="stable")
    a, b = a[order_a], b[order_b]
    step, reach = 256, plan.window * REACH / HALF_WIDTH
    for at in range(0, len(a), step):
        rows = a[at:at + step]
        low = np.searchsorted(b[:, 0], rows[0, 0] - reach, "left")
        high = np.searchsorted(b[:, 0], rows[-1, 0] + reach, "right")
        others = b[low:high]
        if not len(others):
            continue
        head = 16  # after so many projections, pairs that cannot reach the count any more are given up
        count = np.zeros((len(rows), len(others)), np.int16)
        for p in range(head):
            count += np.abs(rows[:, p, None] - others[None, :, p]) <= plan.window
        i, j = np.nonzero(count + (COUNTED - head) >= plan.least)
        for part in range(0, len(i), 1 << 16):
            x, y = i[part:part + (1 << 16)], j[part:part + (1 << 16)]
            total = count[x, y] + (np.abs(rows[x, head:] - others[y, head:]) <= plan.window).sum(1)
            x, y = order_a[x[total >= plan.least] + at], order_b[y[total >= plan.least] + low]
            close = np.einsum("ij,ij->i", unit_a[x], unit_b[y]) >= plan.threshold
            yield x[close], y[close]


def _links(blocks: DataFrame, plan: Plan) -> DataFrame:
    """(u, v, n): a vector and the links one cell found for it; rows with n = 0 are links of the forest."""
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 4):
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in group.columns]
            tbl, _, low, high = (columns[k][0].as_py() for k in range(4))
            block, gid, size = (columns[k].to_numpy(zero_copy_only=False) for k in (4, 5, 6))
            order = np.argsort(gid, kind="stable")
            unit = np.frombuffer(b"".join(columns[7].to_pylist()), np.float64).reshape(-1, plan.dimension)[order]
            keys = np.frombuffer(b"".join(columns[8].to_pylist()), np.int64).reshape(-1, plan.tables)[order]
            block, gid, size = block[order], gid[order], size[order]
            left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
            counted = np.zeros(len(gid), np.int64)
            forest: dict[int, int] = {}

            def root(k: int) -> int:
                while k in forest:
                    k = forest[k]
                return k

            edges = []
            for x, y in _pairs(unit[left], unit[right], plan):
                x, y = left[x], right[y]
                keep = (x < y) if low == high else np.ones(len(x), bool)
                x, y = x[keep], y[keep]
                own = (keys[x] == keys[y]).argmax(1) == tbl if len(x) else np.zeros(0, bool)
                x, y = x[own], y[own]
                np.add.at(counted, x, size[y])
                np.add.at(counted, y, size[x])
                for p, q in zip(x.tolist(), y.tolist()):
                    rp, rq = root(p), root(q)
                    if rp != rq:
                        forest[max(rp, rq)] = min(rp, rq)
                        edges.append((gid[p], gid[q], 0))
            edges += [(g, g, n) for g, n in zip(gid, counted) if n]
            if edges:
                u, v, n = (np.array(c, np.int64) for c in zip(*edges))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n)], names=["u", "v", "n"])

    return blocks.mapInArrow(one, "u long, v long, n long")


def vector_links(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 threshold: float = 0.9) -> DataFrame:
    """One row per row of ``rows``: id, n_links, component_id, kept."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    given = rows.select(F.col(f"`{id_col}`").alias("id"), vector.alias("vector"))
    sound = (F.col("id").isNotNull() & F.col("vector").isNotNull()
             & F.expr("forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
             & F.expr("exists(vector, x -> x <> 0)"))
    lengths = given.where(sound).groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.orderBy(F.desc("n"), "d").first()
    if top is None:
        return given.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                            F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    plan = calibrated(top["d"], top["n"], threshold)
    marked = given.withColumn("vector", F.when(sound & (F.size("vector") == plan.dimension), F.col("vector")))
    nodes = pinned(marked.where("vector is not null").groupBy("vector")
                   .agg(F.min("id").cast("long").alias("gid"), F.count(F.lit(1)).alias("size")))
    crowds = (_dealt(nodes, plan, narrow=True).groupBy("tbl", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
              .select("tbl", "cell", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    dealt = (_dealt(nodes, plan, narrow=False).join(crowds, ["tbl", "cell"])
             .withColumn("block", F.pmod(F.xxhash64("gid"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("tbl", "cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                     "block", "gid", "size", "vector", "keys"))
    keys = ["tbl", "cell", "low", "high"]
    found = pinned(_links(dealt.repartition(*keys).sortWithinPartitions(*keys), plan).groupBy("u", "v").agg(F.sum("n").alias("n")))
    counts = found.where("n > 0").select(F.col("u").alias("gid"), F.col("n").alias("links"))
    roots = components(found.where("n = 0").select("u", "v")).withColumnRenamed("node", "gid")
    named = (nodes.join(counts, "gid", "left").join(roots, "gid", "left")
             .select(F.col("vector").alias("own"), F.coalesce("root", "gid").alias("root"),
                     (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links")))
    component = F.coalesce("root", "id")
    return marked.join(named, F.col("vector") == F.col("own"), "left").select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op7_vector_links(spark: SparkSession, folder: str) -> DataFrame:
    return vector_links(table(spark, folder, "embeddings"))
