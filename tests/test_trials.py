"""Hand-checked rows for the rules that are easy to get wrong."""

import math

import pytest
from pyspark.sql import functions as F

from dyadica.functions import sequence as fx
from dyadica.functions import t_quantile, t_two_sided
from dyadica.operators import binning, cleaning, enrich, sampling, scalars, summaries
from dyadica.sources import layouts

ITEMS = [*fx.LEFT, *fx.RIGHT]


def make(spark, left, right, choice=0):
    return spark.createDataFrame([(*left, *right, choice)],
                                 ", ".join(f"{c} double" for c in ITEMS) + ", choice int")


def features(spark, left, right, choice=0):
    return enrich.enrich(make(spark, left, right, choice)).first().asDict()


def test_one_larger_item(spark):
    row = features(spark, [1.0] * 8, [2.0] + [1.0] * 7)
    assert row["EV_diff"] == -0.125 and row["normative_choice"] == 0 and row["is_correct"] == 1
    assert row["complexity_sd"] == pytest.approx(0.25) and row["complexity"] == pytest.approx(0.125)
    assert row["pair_winner_balance"] == -1
    assert (row["pair_diff_max"], row["pair_diff_min"]) == (0.0, -1.0)
    assert row["pair_diff_std"] == pytest.approx(0.330719, abs=1e-6)
    assert row["pair_diff_entropy"] == pytest.approx(0.376770, abs=1e-6)


@pytest.mark.parametrize("choice, preprocessing, merged", [(1, 0, 1), (0, 1, 1)])
def test_tie(spark, choice, preprocessing, merged):
    same = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    row = features(spark, same, same, choice)
    assert row["is_correct"] == preprocessing
    assert row["pair_diff_entropy"] == 0.0 and row["pair_diff_std"] == 0.0
    assert enrich.with_stats(make(spark, same, same, choice)).first()["correct"] == merged


def test_distinct_differences(spark):
    left = [float(i) for i in range(1, 9)]
    row = features(spark, left, [0.0] * 8)
    assert row["pair_diff_entropy"] == pytest.approx(math.log(8))
    assert row["pair_diff_std"] == pytest.approx(2.291288, abs=1e-6)
    assert enrich.with_stats(make(spark, left, [0.0] * 8)).first()["var_left"] == pytest.approx(6.0)


def test_missing_item(spark):
    left = [None, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    row = features(spark, left, [1.0] * 8)
    assert row["EV_left"] == 5.0
    assert row["pair_diff_std"] is None and row["pair_diff_max"] is None and row["pair_diff_min"] is None
    assert row["pair_winner_balance"] == 7
    assert enrich.with_stats(make(spark, left, [1.0] * 8)).first()["mean_left"] is None
    block = enrich.to_stats(make(spark, left, [1.0] * 8), "data_lab")
    assert enrich.stack_stats([block, block]).count() == 0


def test_leaky_fold(spark):
    df = make(spark, [1.0] + [0.0] * 6 + [-0.5], [0.0] * 8)
    row = df.select(fx.leaky_accumulate(0.5).alias("a"), fx.leaky_choice(0.5).alias("c"),
                    fx.leaky_choice(1.0).alias("c1")).first()
    assert row["a"] == -0.4921875 and row["c"] == 0 and row["c1"] == 1
    assert make(spark, [2.0] * 8, [2.0] * 8).select(fx.leaky_choice(0.9)).first()[0] == 0


def test_sigmoid_holds_the_exponent(spark):
    row = spark.range(1).select(fx.sigmoid(F.lit(1e9), 1.0, 0.0).alias("a"),
                                fx.sigmoid(F.lit(-1e9), 1.0, 0.0).alias("b")).first()
    assert row["a"] == 1.0 and 0.0 < row["b"] < 1e-200


def test_repeated_edges_are_dropped(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 1.0, 1.0, 1.0, 2.0, 3.0)], "x double")
    assert binning.quantile_edges(df, "x", 4) == [1.0, 1.75, 3.0]
    counts = {r["bin"]: r["count"] for r in binning.quantile_bin(df, "x", 4).groupBy("bin").count().collect()}
    assert counts == {1: 4, 2: 2}


def test_constant_column_has_no_bin(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert binning.quantile_bin(df, "x", 4).where("bin is null").count() == 5


def test_median_split(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "complexity double")
    labels = {r[0]: r[1] for r in binning.split_easy_hard(df).collect()}
    assert labels == {1.0: "easy", 2.0: "easy", 3.0: "hard", None: None}


def test_constant_confidence(spark):
    df = spark.createDataFrame([(3,)] * 4, "confidence int")
    assert {r["confidence_norm"] for r in scalars.confidence_norm(df).collect()} == {0.5}


def test_inferred_subject(spark):
    df = spark.range(0, 450).select((F.col("id") * 3).alias("trial_id"))
    sizes = {r["subject"]: r["count"] for r in sampling.infer_subject(df, 200).groupBy("subject").count().collect()}
    assert sizes == {0: 200, 1: 200, 2: 50}
    default = sampling.infer_subject(df)                       # 450 // 33 = 13 trials each
    assert default.groupBy("subject").count().agg(F.max("count")).first()[0] == 13


def test_fold_interval(spark):
    scores = [0.7652243590, 0.7652243590, 0.7585470085, 0.7540064103, 0.7681623932]
    df = spark.createDataFrame([("m", s) for s in scores] + [("one", 0.5)], "model string, score double")
    rows = {r["model"]: r for r in summaries.fold_ci(df).collect()}
    assert rows["m"]["mean"] == pytest.approx(0.762233, abs=1e-6)
    assert rows["m"]["margin"] == pytest.approx(0.007195, abs=1e-6)
    assert rows["one"]["margin"] == 0.0


def test_tails():
    assert t_quantile(0.975, 4) == pytest.approx(2.7764451052)
    assert t_two_sided(2.0, 10) == pytest.approx(0.0733880348)
    assert t_two_sided(-2.0, 10) == t_two_sided(2.0, 10)


def test_too_few_subjects(spark):
    rows = [(s, float(i), 1, i % 3 + 1) for s in (1, 2) for i in range(10)]
    df = spark.createDataFrame(rows, "subject long, complexity double, is_correct int, confidence int")
    out = summaries.paired_ttest_gap(df).first()
    assert out["n_subjects"] == 2 and out["t_statistic"] is None and out["significant"] is None


def test_small_cluster_is_not_read(spark):
    rows = [(0, 5.0, 1.0, 0.5, 1)] * 12 + [(1, 5.0, 1.0, 0.5, 1)] * 9
    df = spark.createDataFrame(rows, "cluster int, EV_diff double, complexity double, residual double, is_correct int")
    out = {r["cluster"]: r for r in summaries.interpret_clusters(df).collect()}
    assert out[0]["interpretation"] == summaries.BIAS_LEFT
    assert out[1]["interpretation"] == summaries.BIAS_TOO_SMALL and out[1]["mean_EV_diff"] is None


def test_small_segments_are_left_out(spark):
    rows = [(float(i), float(i), 1) for i in range(38)]
    df = spark.createDataFrame(rows, "complexity double, EV_diff double, choice int")
    assert binning.choice_by_evidence(df).count() == 0         # 19 rows on either side


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.7)], "y int, s double")
    assert summaries.roc_auc(df, "y", "s").first()[0] is None


def test_layout_resolution():
    framing = [f"sequences_ {i}" for i in (10, 2, 1, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 15, 16)]
    left, right = layouts.resolve_sequences(framing, "framing")
    assert left == [f"sequences_ {i}" for i in range(1, 9)] and right[1] == "sequences_ 10"
    sides = [f"sequenceLeft_{i}" for i in range(1, 9)] + [f"sequenceRight_{i}" for i in range(1, 9)]
    assert layouts.resolve_sequences(sides, "lab")[0][0] == "sequenceLeft_1"
    with pytest.raises(ValueError):
        layouts.resolve_sequences(sides[:-1], "cons")
    with pytest.raises(ValueError):
        layouts.resolve_sequences([f"sequences_ {i}" for i in range(1, 19)], "framing")
    letters = [f"sequenceB{i}" for i in range(1, 9)] + [f"sequenceA{i}" for i in range(1, 9)]
    assert layouts.resolve_sequences(letters, "lab")[0] == letters[8:]
    with pytest.raises(ValueError):
        layouts.resolve_sequences([*sides, "sequenceLeft_ 1"], "cons")


def test_numbers_written_as_decimals(spark, tmp_path):
    names = [f"sequenceLeft_{i}" for i in range(1, 9)] + [f"sequenceRight_{i}" for i in range(1, 9)]
    (tmp_path / "a.csv").write_text(",".join([*names, "responseLeft"]) + "\n" + ",".join(["2.0"] * 15 + ["n/a", "1.0"]) + "\n")
    row = layouts.canonical_trials(layouts.read_trials(spark, str(tmp_path), "cons"), "cons").first()
    assert (row["L1"], row["R8"], row["choice"]) == (2.0, None, 1)


def test_response_resolution(spark):
    df = spark.createDataFrame([(1,)], "responseLeft int")
    assert df.select(layouts.resolve_response(df.columns, "lab")).first()[0] == 1
    with pytest.raises(ValueError):
        layouts.resolve_response(["other"], "cons")


def test_read_csv(spark, tmp_path):
    header = ",".join([f"sequences_ {i}" for i in range(1, 17)] + ["responseLeft", "note"])
    body = [",".join([str(i)] * 16 + ["1", "ok"]) for i in range(5)]
    body.append(",".join(["junk"] + ["NaN"] + ["3"] * 14 + ["0", ""]))
    (tmp_path / "t.csv").write_text("\n".join([header, *body]) + "\n")
    raw = layouts.read_trials(spark, str(tmp_path), "framing")
    assert dict(raw.dtypes)["sequences_ 1"] == "double" and dict(raw.dtypes)["responseLeft"] == "int"
    assert cleaning.clean(raw).count() == 5                    # text and NaN both read as missing
    trials = layouts.canonical_trials(raw, "framing")
    assert trials.where("L1 is null and L2 is null and choice = 0").count() == 1
    numbered = layouts.add_trial_id(layouts.read_trials(spark, str(tmp_path), "framing"))
    ids = {r["trial_id"]: r["sequences_ 3"] for r in numbered.collect()}
    assert [ids[i] for i in range(5)] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_features_work_on_a_stream(spark, trials, tmp_path):
    trials.limit(50).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(trials.schema).parquet(str(tmp_path / "in"))
    query = (enrich.enrich(stream).writeStream.format("memory").queryName("enriched_stream")
             .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start())
    query.awaitTermination(120)
    assert spark.table("enriched_stream").where("complexity is not null").count() == 50
