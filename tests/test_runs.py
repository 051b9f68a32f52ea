"""Whole runs from raw files to written reports."""

import pytest
from pyspark.sql import functions as F

from dyadica import plans
from dyadica.operators import binning, enrich, models, summaries
from dyadica.plans import runs
from dyadica.sources import UNIFIED_COLUMNS
from dyadica.sources.events import raw_layout

SMALL = {"logistic": {"C": [1.0]}, "forest": {"numTrees": [3, 6], "maxDepth": [2, 4], "minInstancesPerNode": [1]},
         "boosting": {"maxIter": [1, 3], "maxDepth": [2], "stepSize": [0.1]}, "sequence_net": {"units": [4], "epochs": [2, 4]}}


@pytest.fixture(scope="module")
def folder(trials, tmp_path_factory):
    """The three raw files, with missing values, an empty column and blanks in a header."""
    path = tmp_path_factory.mktemp("raw")
    for layout, name in runs.FILES.items():
        raw = raw_layout(trials, layout).orderBy("trial_id").drop("trial_id").limit(400).toPandas()
        raw["note"] = None
        raw.loc[3, raw.columns[2]] = None
        if layout == "cons":
            raw.loc[[5, 9], "confidence"] = None
            raw.loc[7, "flip"] = None
        raw.rename(columns={raw.columns[0]: f" {raw.columns[0]} "} if layout == "lab" else {}).to_csv(path / name, index=False)
    return f"file://{path}"


@pytest.fixture(scope="module")
def lab_rows(trials):
    return min(400, trials.where("source = 'lab'").count()) - 1  # one has no item


def metric(df):
    return {(r["dataset"], r["model"], r["metric"]): r["value"] for r in df.collect()}


def test_sources_are_read_in_file_order(spark, folder, trials):
    found = plans.read_sources(spark, folder)
    for rank, layout in enumerate(runs.FILES):
        rows = found.where(F.col("source") == layout).orderBy("trial_id").select("trial_id", "L1", "R8", "choice").collect()
        want = trials.where(F.col("source") == layout).orderBy("trial_id").select("L1", "R8", "choice").limit(400).collect()
        assert [r["trial_id"] for r in rows] == [3 * i + rank for i in range(len(want))]
        assert [tuple(r)[1:] for r in rows[4:]] == [tuple(r) for r in want[4:]]
    plan = found.where("source = 'lab'")._jdf.queryExecution().executedPlan().toString()
    assert "dataConsA" not in plan and "Framing" not in plan


def test_merge_run(spark, folder, lab_rows, tmp_path):
    out = f"file://{tmp_path}"
    report = metric(plans.merge_run(spark, folder, out))
    stats = spark.read.parquet(f"{out}/unified_stats")
    sizes = {r["source"]: r["n"] for r in summaries.summary_by_source(stats).collect()}
    assert sizes["data_lab"] == lab_rows and sizes["data_cons"] == 396  # one item, two confidences, one flip
    assert report["all", "by_source/data_lab", "n"] == lab_rows
    found = {r["feature"]: r["r"] for r in summaries.point_biserial(stats).collect()}
    assert all(report["all", f"point_biserial/{f}", "r"] == pytest.approx(r) for f, r in found.items())
    assert report["all", "logistic_standardized", "converged"] == 1


def test_evidence_run_and_its_second_start(spark, folder, lab_rows, tmp_path, monkeypatch):
    out = f"file://{tmp_path}"
    summary = plans.evidence_run(spark, folder, out, SMALL, folds=2)
    values = metric(summary)
    assert {k[0] for k in values} == {"lab", "cons", "framing", "combined"}
    assert {k[1] for k in values} == {"logistic", "forest", "boosting", "sequence_net", "split", "rows"}
    assert values["combined", "rows", "total"] == sum(values["combined", "split", f"n_{s}"] for s in ("train", "test")) 
    assert values["combined", "rows", "lab"] == lab_rows and values["combined", "rows", "cons"] == 396
    assert metric(spark.read.json(f"{out}/summary")) == values
    assert spark.read.parquet(f"{out}/preprocessed/unified").columns == UNIFIED_COLUMNS
    clusters = spark.read.parquet(f"{out}/lab/clusters")
    assert clusters.count() == lab_rows and clusters.where("residual is null or cluster is null or economic_loss < 0").count() == 0
    assert spark.read.parquet(f"{out}/lab/map").count() == lab_rows and spark.read.json(f"{out}/lab/importances").count() == 15
    bins = {r["bin"]: r["accuracy"] for r in spark.read.json(f"{out}/lab/accuracy_by_complexity").collect()}
    lab = enrich.enrich(plans.reports.source_rows(plans.read_sources(spark, folder), "lab"))
    assert bins == pytest.approx({r["bin"]: r["accuracy"] for r in binning.accuracy_by_complexity(lab).collect()})
    assert spark.read.option("header", True).csv(f"{out}/cons/correlations").count() == 49
    for name in (*runs.FILES, "combined"):
        sizes = {r["split"]: r["count"] for r in spark.read.parquet(f"{out}/{name}/split").groupBy("split").count().collect()}
        assert sizes == {s: values[name, "split", f"n_{s}"] for s in ("train", "test")}
    fits = []
    real = models.shared_scores
    monkeypatch.setattr(models, "shared_scores", lambda *a: fits.append(a[0]) or real(*a))
    again = metric(plans.evidence_run(spark, folder, out, SMALL, folds=2))
    assert again == values and not fits


def test_advanced_run(spark, folder, lab_rows, tmp_path):
    report = metric(plans.advanced_run(spark, folder, f"file://{tmp_path}", SMALL["forest"], folds=2))
    cons = enrich.enrich(plans.read_sources(spark, folder).where("source = 'cons' and confidence is not null"))
    assert cons.count() == 398  # a missing item or flip does not drop a trial here
    gap = summaries.confidence_gap(cons).first()
    assert report["cons", "calibration", "metacognitive_bias"] == pytest.approx(gap["metacognitive_bias"])
    assert sum(v for k, v in report.items() if k[2] == "n" and k[1].startswith("calibration/")) == 398
    assert sum(v for k, v in report.items() if k[2] == "n" and k[1].startswith("cluster/")) == lab_rows
    assert ("lab", "leaky", "leak") in report and ("lab", "gee/Intercept", "coef") in report
