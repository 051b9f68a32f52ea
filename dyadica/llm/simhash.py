"""SimHash near-duplicates by pivot distance tables.

A fingerprint has a bit set where over half of the XXH64 values of the text's word shingles have it. Equal
fingerprints are one node. For each fingerprint the Hamming distances to ``1 + 8 * MASKS`` reference
fingerprints (pivots) are tabulated: zero, and for each of the eight byte blocks several masks inside it. The
distance to a mask less that to zero depends on the block's bits alone, so a block's *signature*, those
differences, is the same in two fingerprints that agree in the block.

Candidates. Four groups of two blocks: fingerprints at most two bits apart agree in two groups, so they
meet in one of six cells keyed by two groups' signatures. A cell with more than ``CELL`` fingerprints is dealt
again by the same rule one level down (four blocks are left, two of them agree), which leaves 16 free bits,
65,536 fingerprints at most where signatures tell blocks apart. No pair within the distance is lost, no cell is cut short.
Within a cell a pair is discarded as soon as one coordinate of the two table rows differs by more than the
distance (the triangle inequality); survivors are verified on the fingerprints. A cell emits a spanning
forest of its links, not its pairs, and components of these are the groups.

The cells suit distances of at most two; a larger one raises an error. Defined results: null and empty texts
have fingerprint zero and link like any other; rows may repeat; a null id never names a group unless the
group has no other id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, pinned, table, written
from .components import components

MASKS, CELL = 7, 4096
_GROUPS = [(0, 1), (2, 3), (4, 5), (6, 7)]


def _pivots() -> np.ndarray:
    rng = np.random.default_rng(11)
    masks = [0]
    for block in range(8):
        chosen: set[int] = set()
        while len(chosen) < MASKS:
            chosen.add(int(rng.integers(1, 256)))
        masks += [m << (8 * block) for m in sorted(chosen)]
    return np.array(masks, dtype=np.uint64)


PIVOTS = _pivots()
_MIX = np.random.default_rng(12).integers(1, 1 << 62, size=len(PIVOTS) + 1, dtype=np.int64) * 2 + 1


def fingerprint(text: str | None, shingle: int = 3) -> int:
    import xxhash
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    starts = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    hashed = np.fromiter((xxhash.xxh64_intdigest(joined[a:b - 1], 42) for a, b in zip(starts, starts[shingle:])),
                         dtype="<u8", count=len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashed), 65_536):
        part = hashed[at:at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (counts * 2 > len(hashed)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, row_col: str | None = None) -> DataFrame:
    """(id, fp, row) with the fingerprint as a signed long; ``row`` is null without ``row_col``."""
    row = F.col(f"`{row_col}`") if row_col else F.lit(None).cast("long")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), row.alias("row"))
    kind = dict(rows.dtypes)["id"]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], names=["id", "fp", "row"])

    return rows.mapInArrow(one, f"id {kind}, fp long, row long")


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances of unsigned fingerprints to all pivots, one row each."""
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _keys(distances: np.ndarray, blocks: tuple[int, ...], salt: int) -> np.ndarray:
    """A number for the signatures of ``blocks``; a collision only adds candidates."""
    own = [1 + b * MASKS + j for b in blocks for j in range(MASKS)]
    signature = (distances[:, own] - distances[:, :1]).astype(np.int64)
    with np.errstate(over="ignore"):
        mixed = (signature * _MIX[own]).sum(1) + np.int64(salt) * _MIX[-1]
        mixed = (mixed ^ (mixed >> 29)) * _MIX[-1]
    return mixed ^ (mixed >> 32)


_PAIRS = list(itertools.combinations(range(4), 2))


def _dealt(nodes: DataFrame) -> DataFrame:
    """(cell, pair, fp): every fingerprint in its six cells."""
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            distances = pivot_table(fp.view(np.uint64))
            for p, (a, b) in enumerate(_PAIRS):
                cells = _keys(distances, _GROUPS[a] + _GROUPS[b], p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells), pa.array(np.full(len(fp), p, np.int32)), pa.array(fp)], names=["cell", "pair", "fp"])

    return nodes.select("fp").mapInArrow(one, "cell long, pair int, fp long")


def _dealt_again(crowded: DataFrame) -> DataFrame:
    """(cell, pair, fp): the fingerprints of crowded cells by two of the four blocks they may differ in."""
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, pair, fp = (batch.column(i).to_numpy() for i in range(3))
            distances = pivot_table(fp.view(np.uint64))
            for p, shared in enumerate(_PAIRS):
                at = pair == p
                if not at.any():
                    continue
                free = [b for g in range(4) if g not in shared for b in _GROUPS[g]]
                for q, (a, b) in enumerate(_PAIRS):
                    with np.errstate(over="ignore"):
                        cells = cell[at] * 31 + _keys(distances[at], (free[a], free[b]), 100 + q)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells), pa.array(np.full(len(cells), 6, np.int32)), pa.array(fp[at])],
                        names=["cell", "pair", "fp"])

    return crowded.select("cell", "pair", "fp").mapInArrow(one, "cell long, pair int, fp long")


def _forest(fp: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Links that span every group of one cell."""
    unsigned = fp.view(np.uint64)
    table_ = pivot_table(unsigned)
    parent = np.arange(len(fp))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = range(0, len(PIVOTS), 7)  # a pivot or two of each block tells most pairs apart
    step = max(1, (1 << 22) // len(fp))
    for at in range(0, len(fp), step):
        rows = table_[at:at + step]
        near = np.ones((len(rows), len(fp)), dtype=bool)
        for p in first:
            near &= np.abs(rows[:, p, None] - table_[None, :, p]) <= most
        i, j = np.nonzero(near)
        keep = i + at < j
        i, j = i[keep] + at, j[keep]
        for low in range(0, len(i), 1 << 18):
            a, b = i[low:low + (1 << 18)], j[low:low + (1 << 18)]
            ok = np.abs(table_[a] - table_[b]).max(1) <= most
            a, b = a[ok], b[ok]
            ok = np.bitwise_count(unsigned[a] ^ unsigned[b]) <= most
            for x, y in zip(a[ok].tolist(), b[ok].tolist()):
                rx, ry = root(x), root(y)
                if rx != ry:
                    parent[max(rx, ry)] = min(rx, ry)
                    yield int(fp[x]), int(fp[y])


def _links(dealt: DataFrame, most: int) -> DataFrame:
    """(u, v) from cells of a bounded size."""
    cells = dealt.groupBy("cell").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [e for row in batch.column(0) for e in _forest(row.values.to_numpy(), most)]
            edges = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["u", "v"])

    return cells.select("fps").mapInArrow(one, "u long, v long")


def _members(docs: DataFrame, id_col: str, text_col: str, shingle: int, distance: int, row_col: str | None = None) -> DataFrame:
    """One row per document: id, row, fp, root (its group, a fingerprint), component_id."""
    if distance > 2:
        raise ValueError("cells of two groups hold pairs of at most two differing bits")
    rows = pinned(fingerprints(docs, id_col, text_col, shingle, row_col))
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    dealt = pinned(_dealt(nodes))
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = pinned(dealt.join(sizes, "cell"))
    edges = _links(shared.where(F.col("n") <= CELL), distance).unionByName(
        _links(_dealt_again(shared.where(F.col("n") > CELL)), distance))
    roots = components(edges)
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   distance: int = 2) -> DataFrame:
    """One row per document: id, fp (signed long), component_id."""
    return _members(docs, id_col, text_col, shingle, distance).select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         distance: int = 2) -> DataFrame:
    """One row of ``docs`` for each group, one that names it; the other members go.

    Rows are told apart by a key that is written with them, so ids may repeat or be null.
    """
    key = free_name(docs, "simhash_row")
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "simhash-rows")
    stay = (_members(rows, id_col, text_col, shingle, distance, key).where(F.col("id").eqNullSafe(F.col("component_id")))
            .groupBy("root").agg(F.min("row").alias("row")).select(F.col("row").alias("stay")))
    return rows.join(stay, rows[key] == stay["stay"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
