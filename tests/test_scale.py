"""The narrowing, cutting and ordering helpers against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadica.operators import sampling, selection, summaries
from dyadica.operators.ordered import with_row_position, with_running_total


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(5)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3000)]
    rows += [("b", 1.5) for _ in range(2000)]                          # a hot value
    rows += [("b", rng.uniform(0, 3)) for _ in range(2000)]
    rows += [("c", None), ("c", float("nan")), ("c", 4.0), (None, 7.0)]
    return rows, spark.createDataFrame(rows, "g string, x double").repartition(5).persist()


def test_quantiles(values):
    rows, df = values
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    found = selection.exact_quantiles(df, {"x": probs}, by="g")
    assert set(found) == {"a", "b", "c"}
    for g in "ab":
        want = np.quantile([x for k, x in rows if k == g], probs)
        assert found[g]["x"] == pytest.approx(list(want), abs=1e-12)
    assert found["c"]["x"] == [4.0] * len(probs)


@pytest.mark.parametrize("inside", [1, 100_000])
def test_quantiles_of_two_columns(values, inside):
    rows, df = values
    both = df.withColumn("y", F.col("x") * 2)
    found = selection.exact_quantiles(both, {"x": [0.5], "y": [0.5, 0.3]}, inside=inside)[None]
    xs = [x for _, x in rows if x is not None and x == x]
    assert found["x"][0] == pytest.approx(np.median(xs), abs=1e-12)
    assert found["y"] == pytest.approx([2 * np.median(xs), 2 * np.quantile(xs, 0.3)], abs=1e-12)


@pytest.mark.parametrize("values", [
    [1.0], [2.0, 1.0], [5.0, 1.0, 3.0], [0.0, -0.0, 1.0], [7.0] * 50, [float(i // 7) for i in range(40)],
    [float("inf"), -float("inf"), 0.0, 1.0, 2.0], [1e300, -1e300, 5e-324, 0.0], [float(i * i) for i in range(1023)]])
def test_quantiles_of_few_values(spark, values):
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None), ("n", None)], "g string, x double").repartition(3)
    probs = [0.0, 0.01, 1 / 3, 0.5, 0.99, 1.0]
    ordered = sorted(values)
    want = []
    for p in probs:
        r = p * (len(values) - 1)
        low, high = ordered[math.floor(r)], ordered[math.ceil(r)]
        want.append(low if low == high else (math.ceil(r) - r) * low + (r - math.floor(r)) * high)
    assert selection.exact_quantiles(df, {"x": probs})[None]["x"] == pytest.approx(want, rel=1e-12)
    grouped = selection.exact_quantiles(df, {"x": probs}, by="g")
    assert grouped["g"]["x"] == pytest.approx(want, rel=1e-12) and grouped["n"]["x"] == [None] * len(probs)


def test_quantiles_narrow_until_the_driver_can_take_them(spark):
    """A spread-out column whose brackets hold more than is allowed, beside hot values."""
    df = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(7)).alias("x")).persist()
    xs = sorted(r[0] for r in df.collect())
    probs = [i / 10 for i in range(11)]
    calls = []
    real = selection._narrowed
    selection._narrowed = lambda *a: calls.append(1) or real(*a)
    try:
        found = selection.exact_quantiles(df, {"x": probs}, inside=1)[None]["x"]
    finally:
        selection._narrowed = real
    assert calls and found == pytest.approx(list(np.quantile(xs, probs)), abs=1e-12)


def test_a_wrong_bracket_is_searched_again(spark, monkeypatch):
    df = spark.range(5000).selectExpr("double(id) as x")
    monkeypatch.setattr(selection, "_around", lambda grid, p: (grid[0], grid[1]))
    assert selection.exact_quantiles(df, {"x": [0.5]})[None]["x"] == [2499.5]


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert selection.exact_medians(df, ["x"]) == {"x": None}


@pytest.mark.parametrize("leaf, width", [(2000, 3), (3, 1), (1, 2)])
def test_rank_cuts(spark, leaf, width):
    ids = [("p", i * 7) for i in range(700)] + [("q", -i) for i in range(90)] + [(None, 1)]
    df = spark.createDataFrame(ids, "g string, id long")
    key = selection.hash_order("id", 3)
    cuts = selection.rank_cuts(df, "g", key, lambda n: [0, 1, n // 3, n - 1, n], leaf=leaf, width=width)
    for g in "pq":
        keys = sorted(r[0] for r in df.where(F.col("g") == g).select(key).collect())
        n = len(keys)
        assert cuts[g] == ["", keys[0], keys[n // 3 - 1], keys[n - 2], keys[n - 1]]


def test_sortable_id(spark):
    ids = [-(1 << 63), -5, -1, 0, 1, 300, (1 << 63) - 1]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    keyed = {r["id"]: r["k"] for r in df.select("id", selection.sortable_id(F.col("id")).alias("k")).collect()}
    assert sorted(ids, key=keyed.get) == ids and {len(k) for k in keyed.values()} == {16}


def test_split_matches_ranking(spark, trials):
    rows = trials.select("trial_id", "choice").collect()
    order = {}
    for r in rows:
        order.setdefault(r["choice"], []).append(
            (hashlib.md5(f"{r['trial_id']}:42".encode()).hexdigest(), r["trial_id"]))
    want = {t for members in order.values()
            for _, t in sorted(members)[:int(0.2 * len(members) + 0.5)]}
    split = sampling.stratified_split(trials.select("trial_id", "choice"), "choice", seed=42)
    assert {r[0] for r in sampling.split_members(split, "test").select("trial_id").collect()} == want
    again = sampling.stratified_split(trials.select("trial_id", "choice").repartition(7), "choice", seed=42)
    assert {r[0] for r in sampling.split_members(again, "test").select("trial_id").collect()} == want


@pytest.mark.parametrize("bucket", [100, 1_000_000])
def test_row_position(spark, bucket):
    ids = list(range(0, 5000, 3))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(6)
    placed = {r["id"]: r["position"] for r in with_row_position(df, ["id"], bucket=bucket).collect()}
    assert placed == {i: n for n, i in enumerate(sorted(ids))}


@pytest.mark.parametrize("bucket", [100, 1_000_000])
def test_running_total(spark, bucket):
    rng = random.Random(2)
    rows = [(rng.random(), rng.randint(0, 9)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "s double, v long").repartition(6)
    got = {r["s"]: r["before"] for r in with_running_total(df, "s", "v", "before", bucket).collect()}
    total, want = 0, {}
    for s, v in sorted(rows):
        want[s] = total
        total += v
    assert got == want


def test_auc(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(800)] + [(1, None), (None, 0.5)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos = [s for y, s in rows if y == 1 and s is not None]
    neg = [s for y, s in rows if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert summaries.roc_auc(df, "y", "s").first()[0] == pytest.approx(want, abs=1e-12)


def test_paired_gap_without_subject(spark, trials):
    from dyadica.operators import enrich
    cons = enrich.enrich(trials.where(F.col("source") == "cons")).drop("subject")
    inferred = sampling.infer_subject(cons, 10)
    want = summaries.paired_ttest_gap(inferred).first()
    assert summaries.paired_ttest_gap(cons, trials_per_subject=10).first() == want and want["n_subjects"] >= 3


def test_point_biserial_fills_infinities(spark):
    rows = [(i % 2, float(i)) for i in range(9)] + [(1, float("inf")), (0, None), (None, 3.0)]
    df = spark.createDataFrame(rows, "y int, x double")
    found = summaries.point_biserial(df, "y", ["x"]).first()
    median = float(np.median([x for _, x in rows if x is not None and np.isfinite(x)]))
    pairs = [(y, x if x is not None and np.isfinite(x) else median) for y, x in rows if y is not None]
    assert found["n"] == len(pairs)
    assert found["r"] == pytest.approx(np.corrcoef(*zip(*pairs))[0, 1], abs=1e-12)


def test_fold_intervals_of_many_folds(spark):
    from dyadica.functions.tails import t_quantile, wide_t_quantile
    for df in (31, 40, 100, 5000):
        assert wide_t_quantile(0.975, df) == pytest.approx(t_quantile(0.975, df), rel=1e-7)
    sizes = {"one": 1, "two": 2, "five": 5, "edge": 32, "more": 33, "many": 400}
    rng = random.Random(8)
    rows = [(m, rng.random()) for m, n in sizes.items() for _ in range(n)] + [("none", None)]
    got = {r["model"]: r for r in summaries.fold_ci(spark.createDataFrame(rows, "model string, score double")).collect()}
    for m, n in sizes.items():
        mine = [s for k, s in rows if k == m]
        want = t_quantile(0.975, n - 1) * np.std(mine, ddof=1) / math.sqrt(n) if n > 1 else 0.0
        assert got[m]["n"] == n and got[m]["margin"] == pytest.approx(want, rel=1e-7)
    assert got["none"]["n"] == 0 and got["none"]["mean"] is None


@pytest.mark.parametrize("gap", [None, float("inf"), float("nan")])
def test_correlations_need_a_second_pass_only_for_gaps(spark, monkeypatch, gap):
    rng = random.Random(6)
    rows = [(rng.random(), rng.random(), i % 2) for i in range(400)]
    fills = []
    real = summaries.impute_median
    monkeypatch.setattr(summaries, "impute_median", lambda *a: fills.append(1) or real(*a))

    def found(rows):
        df = spark.createDataFrame(rows, "a double, b double, y int")
        r = {(x["feature_a"], x["feature_b"]): x["r"] for x in summaries.correlation_matrix(df, ["a", "b"]).collect()}
        return r["a", "b"], summaries.point_biserial(df, "y", ["a"]).first()["r"]

    a, b, y = map(np.array, zip(*rows))
    assert found(rows) == pytest.approx((np.corrcoef(a, b)[0, 1], np.corrcoef(a, y)[0, 1]), abs=1e-12) and not fills
    a[7] = np.median(np.delete(a, 7))
    assert found([*rows[:7], (gap, *rows[7][1:]), *rows[8:]]) == pytest.approx((np.corrcoef(a, b)[0, 1], np.corrcoef(a, y)[0, 1]), abs=1e-12)
    assert len(fills) == 2


def test_stored_members_join_without_an_exchange(spark, trials):
    from dyadica.sources import save_bucketed
    split = sampling.stratified_split(trials.select("trial_id", "choice"), "choice")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = save_bucketed(trials.select("trial_id", "subject", "choice"), "bucketed_trials", buckets=4)
        members = save_bucketed(sampling.split_members(split, "test"), "bucketed_members", buckets=4)
        for keep in (True, False):
            rows = sampling.members_of(stored, members, keep=keep)
            assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
            want = sampling.split_members(split, "test" if keep else "train").select("trial_id").collect()
            assert sorted(r["trial_id"] for r in rows.collect()) == sorted(r["trial_id"] for r in want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("drop table if exists bucketed_trials")
        spark.sql("drop table if exists bucketed_members")
