"""Hard negatives against plain loops over exact integers, and the residue arithmetic against int64."""

import math

import numpy as np
import pytest
from check_oracle import compare, connect
from pyspark.sql import functions as F

from dyadica.llm import negatives

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, row string, q string, score string"


@pytest.mark.parametrize("width, size", [(1, 3), (7, 256), (64, 256), (64, 8000), (1500, 256), (3000, 4), (5, 100_000_000)])
def test_scores_are_exact(width, size):
    rng = np.random.default_rng(width)
    a, b = rng.integers(-size, size + 1, (40, width)), rng.integers(-size, size + 1, (30, width))
    a[0], b[0] = size, -size
    a[1], b[1] = 0, size
    bound = int(max((a.astype(object) ** 2).sum(1).max(), (b.astype(object) ** 2).sum(1).max()))
    primes = negatives.primes_for(width, bound)
    assert math.prod(primes) > 2 * bound
    got = negatives.Residues(a, primes).scores(negatives.Residues(b, primes))
    assert got.dtype == np.int64 and (got == a.astype(object) @ b.astype(object).T).all()


def plain(rows, positives=5, hardest=5):
    part = []
    for n, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i is not None and i % 7 == 0 else label
        part.append((n, i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    last = lambda i: (i is None, i)
    out = []
    for n, i, label, q in part:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(q, p)), j, m == label) for k, j, m, p in part if k != n and len(p) == len(q)]
        best = sorted((s for s in scored if s[2]), key=lambda s: (-s[0], last(s[1])))[:positives]
        for top, j, _ in best:
            fits = [s for s in scored if not s[2] and 80 * top <= 100 * s[0] <= 100 * top]
            for rank, s in enumerate(sorted(fits, key=lambda s: (-s[0], last(s[1])))[:hardest], 1):
                out.append((i, j, rank, s[1], top, s[0]))
    return sorted(out, key=str)


def got(spark, rows):
    table = spark.createDataFrame([(i, v, m, "r", "q", "s") for i, v, m in rows], SCHEMA).repartition(3)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    ready = negatives.quantised(table.withColumn("label", moved))
    df = negatives.hard_negatives(ready, ready.where(F.col("id") % 100 == 0))
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for i in range(400):
        v = rng.normal(size=6)
        out.append((i, [float(x) for x in v / np.linalg.norm(v)], int(rng.integers(0, 3))))
    copy = out[5][1]
    out += [(1000 + k, copy, k % 3) for k in range(40)]                         # ties without end
    out += [(100, out[100][1], out[100][2]), (200, out[7][1], 1)]               # ids that repeat
    out += [(None, out[0][1], 0), (None, out[200][1], 2)]
    out += [(2000, None, 1), (2100, out[3][1], None), (2200, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2300, [float("nan")] * 6, 1),
            (2400, [float("inf")] * 6, 1), (2500, [], 1), (2501, [], 2), (2502, [], 1), (2600, [0.5] * 3, 1), (2601, [0.4] * 3, 1),
            (2602, [0.45, 0.5, 0.4], 2), (2700, [0.0] * 6, 1), (-300, out[9][1], 0)]
    return out


def test_hard_negatives(spark, rows, monkeypatch):
    want = plain(rows)
    assert len(want) > 20 and got(spark, rows) == want
    monkeypatch.setattr(negatives, "LEAST", 16)  # many cells, small tiles, slices of vectors
    monkeypatch.setattr(negatives, "BLOCK", 3)
    monkeypatch.setattr(negatives, "TILE", 64)
    monkeypatch.setattr(negatives, "SLICE", 4)
    assert got(spark, rows) == want


def test_empty_and_large(spark):
    assert got(spark, []) == []
    assert got(spark, [(100, [1.0], 1)]) == []
    with pytest.raises(ValueError, match="exact"):
        got(spark, [(100, [1e30], 1), (101, [1e30], 1)])


def test_query_equals_sql(spark):
    assert compare(negatives.op13_hard_negatives(spark, FOLDER), connect(FOLDER), negatives.OP13_SQL) is None
