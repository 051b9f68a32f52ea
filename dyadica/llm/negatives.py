"""Hard negatives by exact integer scores from a residue-number-system GEMM.

Components are quantised to integers, so a score is an exact integer. A product of two blocks is computed once
for every one of a few small primes: both blocks modulo the prime, as float32, centred on zero, so that all
partial sums stay below 2^24 where float32 is exact (long vectors go in slices, reduced in between). The
Chinese remainder theorem, in mixed radix, gives the signed score back. The number of primes follows from the
largest squared length L in the table: no score exceeds L, so the primes' product exceeds 2 L.

Anchors meet rows in cells: both are dealt to blocks by a hash of their row key, every row is sent to each
block of anchors, every anchor to each block of rows, and a task works on one cell at a time. A block holds
``BLOCK`` rows about, whatever their ids, labels or copies, so no cell is hot and what a task holds is bounded.
First each cell gives an anchor's best rows of its label, a window cuts them to the positives. Then each cell gives, for
every positive, its best rows of other labels inside the positive's score window, and a window cuts again.
No cell returns more than the wanted number for each anchor (and positive), so all else stays in the task.

Defined results: a row with a null label, a null vector or a null or non-finite component takes no part; a
null id is no anchor and comes last among ties; rows are told apart by a key of their own, so a row that
repeats an anchor's id is another row, and repeated rows repeat in the result; a vector is compared with those
of its length only, an empty one scores 0; an anchor without positives, or a positive without rows in its
window, gives nothing; an empty table gives an empty table; other columns are ignored. Components whose scores
could exceed 2^55 are refused with an error, as the comparisons in hundredths would leave 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pinned, table

BLOCK, LEAST, SLICE, TILE = 65_536, 1024, 1024, 1 << 21
LARGEST = 1 << 55


def primes_for(width: int, bound: int) -> list[int]:
    """Primes whose centred residues multiply exactly in float32 over ``width`` terms, with a product over 2 x bound."""
    top = int(2 * (((1 << 24) - (1 << 12)) / max(1, min(width, SLICE))) ** 0.5)
    found, product = [], 1
    for p in range(min(top, 4093), 2, -1):
        if found and product > 2 * bound:
            break
        if all(p % q for q in range(2, int(p ** 0.5) + 1)):
            found.append(p)
            product *= p
    return found


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues between -p/2 and p/2, in the type of ``x``."""
    return x - p * np.rint(x / p)


class Residues:
    """A block of integer vectors modulo every prime, as float32 matrices."""

    def __init__(self, block: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = [_centred(block.astype(np.float64), p).astype(np.float32) for p in primes]

    def take(self, at) -> "Residues":
        out = object.__new__(Residues)
        out.primes, out.parts = self.primes, [m[at] for m in self.parts]
        return out

    def scores(self, other: "Residues") -> np.ndarray:
        """All inner products as exact int64: a GEMM for each prime, then mixed-radix reconstruction."""
        total, radix = None, 1
        for p, a, b in zip(self.primes, self.parts, other.parts):
            r = np.zeros((len(a), len(b)), np.float32)
            for low in range(0, a.shape[1], SLICE):
                r += _centred(a[:, low:low + SLICE] @ b[:, low:low + SLICE].T, np.float32(p))
            r = _centred(r, np.float32(p)).astype(np.int64)
            if total is None:
                total = r
            else:
                digit = (r - total) % p * pow(radix, -1, p) % p
                total += np.int64(radix) * np.where(digit > p // 2, digit - p, digit)
            radix *= p
        return total


def _first(group: np.ndarray, score: np.ndarray, order: np.ndarray, count: int) -> np.ndarray:
    """Positions of the first ``count`` entries of each group by falling score, then rising order."""
    at = np.lexsort((order, -score, group))
    marks = group[at]
    start = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]]) if len(at) else at
    rank = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
    return at[rank < count]


def _cut(s: np.ndarray, wanted: np.ndarray, count: int) -> np.ndarray:
    """``wanted`` without the entries that ``count`` better ones of their row of ``s`` beat."""
    if s.shape[1] > 8 * count:
        low = np.iinfo(np.int64).min
        kth = np.partition(np.where(wanted, s, low), s.shape[1] - count, axis=1)[:, s.shape[1] - count]
        better, ties = wanted & (s > kth[:, None]), wanted & (s == kth[:, None])
        return better | (ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= count))
    return wanted


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _joined(parts: list[tuple], width: int) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * width


def _positives(rows: pa.Table, anchors: pa.Table, primes: list[int], count: int) -> Iterator[tuple]:
    """Of the rows of an anchor's label, its best: positions in both tables, and the score."""
    labels, anchor_labels = rows["label"].to_numpy(), anchors["label"].to_numpy()
    keys, anchor_keys = rows["row"].to_numpy(), anchors["row"].to_numpy()
    left, right = Residues(_matrix(anchors["q"]), primes), Residues(_matrix(rows["q"]), primes)
    for label in np.unique(anchor_labels):
        mine, same = np.flatnonzero(anchor_labels == label), np.flatnonzero(labels == label)
        own = right.take(same)
        step = max(1, TILE // max(1, len(same)))
        for low in range(0, len(mine), step):
            at = mine[low:low + step]
            s = left.take(at).scores(own)
            i, j = np.nonzero(_cut(s, keys[same][None, :] != anchor_keys[at][:, None], count))
            best = _first(i, s[i, j], j, count)
            yield at[i[best]], same[j[best]], s[i[best], j[best]]


def _negatives(rows: pa.Table, anchors: pa.Table, primes: list[int], count: int, share: tuple[int, int]) -> Iterator[tuple]:
    """For every positive of an anchor, its best rows of another label inside the window: positions, slot, score."""
    labels, anchor_labels = rows["label"].to_numpy(), anchors["label"].to_numpy()
    given = anchors["positives"].to_pylist()
    slots = max(map(len, given))
    none = np.iinfo(np.int64).min // 128  # below any score, also times a share
    edge = np.full((len(given), slots), none, np.int64)
    for n, found in enumerate(given):
        edge[n, :len(found)] = found
    left, right = Residues(_matrix(anchors["q"]), primes), Residues(_matrix(rows["q"]), primes)
    step = max(1, TILE // len(labels))
    for low in range(0, len(given), step):
        s = left.take(slice(low, low + step)).scores(right)
        top = edge[low:low + step]
        known = np.where(top > none, top, -none).min(1)
        inside = (s <= top.max(1)[:, None]) & (s * share[1] >= (known * share[0])[:, None])
        i, j = np.nonzero(inside & (labels[None, :] != anchor_labels[low:low + step, None]))
        score = s[i, j]
        for slot in range(slots):
            own = top[i, slot]
            fit = np.flatnonzero((own > none) & (own * share[0] <= score * share[1]) & (score <= own))
            best = fit[_first(i[fit], score[fit], j[fit], count)]
            yield low + i[best], j[best], np.full(len(best), slot), score[best]


def _cells(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int], extra: list[str]):
    """Rows and anchors grouped by vector length, block of anchors and block of rows."""
    n_rows, n_anchors = sizes
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    down = max(1, -(-n_anchors // BLOCK))
    across = max(1, -(-n_rows // BLOCK), min(-(-4 * spread // down), -(-n_rows // LEAST)))
    block = F.pmod(F.xxhash64("row"), F.lit(across)).cast("int")
    band = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(down)).cast("int")
    names = ["row", "id", "label", "q", "width"]
    left = rows.select(*names, block.alias("across"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("down"))
    anchors = anchors.select([F.col(c).alias(c) for c in [*names, *extra]])  # columns of their own, apart from those of rows
    right = anchors.select(*names, *extra, band.alias("down"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("across"))
    by = ["width", "down", "across"]
    return left.groupBy(*by).cogroup(right.groupBy(*by))


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
              scale: int = 256) -> DataFrame:
    """row, id, label, q (integers), width and squared length of the rows that take part."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda v: v.cast("double"))
    part = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), x.alias("x"))
    part = part.where(F.col("label").isNotNull() & F.col("x").isNotNull()).where(
        F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))))
    part = part.withColumn("x", F.transform("x", lambda v: F.floor(v * scale).cast("double")))
    length = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    return pinned(part.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.size("x").alias("width"),
                              length.alias("length"), F.expr("transform(x, v -> try_cast(v as int))").alias("q")))


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5,
                   share: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` and ``anchors`` are as ``quantised`` gives them. A negative scores at least ``share`` of the
    positive and at most as much as it.
    """
    size = rows.agg(F.count(F.lit(1)), F.max("width"), F.max("length")).first()
    sizes = (size[0], anchors.count())
    if (size[2] or 0) > LARGEST:
        raise ValueError(f"scores may reach {size[2]:.3g}; at most {LARGEST} are exact in 64 bits with their shares")
    primes = primes_for(size[1] or 0, int(size[2] or 0))
    kind = dict(rows.dtypes)["id"]

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("id", "ascending")])  # null ids last
        found = _positives(left, right, primes, positives) if left.num_rows and right.num_rows else ()
        at, to, score = _joined(list(found), 3)
        return pa.table({"anchor": right["row"].take(at), "positive_id": left["id"].take(to),
                         "positive_row": left["row"].take(to), "score": pa.array(score, pa.int64())})

    cells = _cells(rows, anchors, sizes, [])
    by_score = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"), "positive_row")
    best = (cells.applyInArrow(near, f"anchor long, positive_id {kind}, positive_row long, score long")
            .withColumn("slot", F.row_number().over(by_score)).where(F.col("slot") <= positives))
    best = pinned(best.select("anchor", F.col("slot").cast("int").alias("slot"), "positive_id", F.col("score").alias("positive_score")))
    edges = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("p"))
    edges = edges.select(F.col("anchor").alias("row"), F.col("p.positive_score").alias("positives"))
    asked = anchors.join(edges, "row")

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("id", "ascending")])
        found = _negatives(left, right, primes, negatives, share) if left.num_rows and right.num_rows else ()
        at, to, slot, score = _joined(list(found), 4)
        return pa.table({"anchor": right["row"].take(at), "slot": pa.array(slot + 1, pa.int32()), "negative_id": left["id"].take(to),
                         "negative_row": left["row"].take(to), "score": pa.array(score, pa.int64())})

    cells = _cells(rows, asked, sizes, ["positives"])
    by_score = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("negative_id"), "negative_row")
    hardest = (cells.applyInArrow(hard, f"anchor long, slot int, negative_id {kind}, negative_row long, score long")
               .withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= negatives))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return (hardest.join(best, ["anchor", "slot"]).join(ids, "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
                    F.col("score").alias("negative_score")))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(vectors.withColumn("label", shifted))
    return hard_negatives(rows, rows.where(F.col("id") % 100 == 0))


OP13_SQL = """
with x as (
    select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
      list_transform(embedding, lambda v: floor(256 * v::double)) as q
    from embeddings
    where label is not null and embedding is not null
      and len(list_filter(embedding, lambda v: v is not null and isfinite(v))) = len(embedding)),
  s as materialized (
    select a.r as a, a.vec_id as anchor_id, b.r as b, b.vec_id as other_id, a.label = b.label as same,
      cast(coalesce(list_inner_product(a.q, b.q), 0) as bigint) as score
    from x a join x b on a.r <> b.r and len(a.q) = len(b.q) where a.vec_id % 100 = 0),
  p as (
    select * from (select *, row_number() over (partition by a order by score desc, other_id nulls last) as nth from s where same)
    where nth <= 5),
  n as (
    select p.anchor_id, p.other_id as positive_id, s.other_id as negative_id, p.score as positive_score, s.score as negative_score,
      row_number() over (partition by p.a, p.b order by s.score desc, s.other_id nulls last) as nth
    from p join s on p.a = s.a and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select anchor_id, positive_id, cast(nth as integer) as rank, negative_id, positive_score, negative_score from n where nth <= 5"""
