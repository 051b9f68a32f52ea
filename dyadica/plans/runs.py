"""Whole runs: raw trial files in, written tables and reports out.

A run reads the three raw files of a folder, numbers their rows, cleans and enriches every source, writes the
preprocessed tables and takes all that follows from what it wrote, so raw files are scanned and features made once.
Reports are JSON lines of metrics, tables parquet. Scores of searched models go to a ledger below the output folder,
so a run that was cut off and is started again fits only what is missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binning, enrich, models, sampling, summaries
from ..operators.ledger import Ledger
from ..sources import layouts, sinks
from .reports import METRICS, advanced_report, dataset_table, merge_report, run_bundle, source_rows, stacked_trials

# The raw files by layout, and a raw column that has another name here.
FILES = {"lab": "data_lab.csv", "cons": "dataConsA.csv", "framing": "dataHighFramingA.csv"}
_RENAMED = {"isDifferentMeanSameVariance": "is_diff_mean"}


def read_sources(spark: SparkSession, folder: str, files: dict[str, str] | None = None) -> DataFrame:
    """The raw files as canonical trials, stacked and tagged with ``source``, not cleaned yet.

    Rows are numbered in file order, and numbers of different sources differ. A column that a source doesn't have is
    null in its rows, so cleaning a source drops it again. A filter on ``source`` reads only that source's file.
    """
    parts = []
    for rank, (layout, name) in enumerate((files or FILES).items()):
        raw = layouts.add_trial_id(layouts.strip_columns(layouts.read_trials(spark, f"{folder}/{name}", layout)))
        rows = layouts.canonical_trials(raw, layout).withColumnsRenamed(_RENAMED)
        parts.append(rows.withColumns({"trial_id": F.col("trial_id") * len(FILES) + rank, "source": F.lit(layout)}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _kept(df: DataFrame, path: str, write=sinks.write_trials) -> DataFrame:
    """``df`` written by a sink, and the table it wrote."""
    write(df, path)
    return df.sparkSession.read.parquet(path)


def evidence_run(spark: SparkSession, folder: str, out: str, grids: dict | None = None, folds: int = sampling.FOLDS,
                 workers: int = 8) -> DataFrame:
    """Preprocessed trials, searched models and their reports for every source and for the stack of all.

    Writes ``preprocessed/<dataset>``, ``<dataset>/metrics``, ``<dataset>/split``, ``<dataset>/correlations``, for lab also residuals with
    clusters and economic loss per trial, binned tables, importances and the two-dimensional map, and ``summary``, which is returned.
    """
    trials = _kept(read_sources(spark, folder), f"{out}/trials")
    ledger = Ledger(spark, f"{out}/scores")
    parts = []
    for dataset in FILES:
        rows = _kept(enrich.enrich(source_rows(trials, dataset)), f"{out}/preprocessed/{dataset}")
        table, cols = enrich.features(rows, dataset, ["trial_id", "choice", "normative_choice"])
        metrics, fitted = run_bundle(table, cols, dataset, grids, folds, workers=workers, ledger=ledger.of(dataset))
        parts.append(_reported(metrics, table, f"{out}/{dataset}", folds))
        if dataset == "lab":
            _lab_tables(rows, cols, fitted["forest"], out)
    stack = _kept(enrich.unified_trials(stacked_trials(trials)), f"{out}/preprocessed/combined")
    sinks.write_unified(stack, f"{out}/preprocessed/unified")
    uni = stack.withColumnRenamed("human_choice", "choice")
    table, cols = enrich.features_unified(uni, ["trial_id", "choice", "normative_choice"])
    metrics, _ = run_bundle(table, cols, "combined", grids, folds, workers=workers, ledger=ledger.of("combined"))
    sizes = summaries.rows_by_source(uni).select(
        F.lit("combined").alias("dataset"), F.lit("rows").alias("model"), F.col("dataset_source").alias("metric"),
        F.col("n").cast("double").alias("value"), F.lit(None).cast("string").alias("label"))
    parts.append(_reported(metrics.unionByName(sizes), table, f"{out}/combined", folds))
    summary = reduce(DataFrame.unionByName, parts)
    sinks.write_report(summary, f"{out}/summary")
    return summary


def _reported(metrics: DataFrame, table: DataFrame, path: str, folds: int) -> DataFrame:
    split = sampling.train_folds(sampling.stratified_split(table, "choice"), "choice", folds)  # as the bundle cuts it
    sinks.write_trials(split.select("trial_id", "split", "fold"), f"{path}/split")
    sinks.write_report(metrics, f"{path}/metrics")
    sinks.write_corr(summaries.correlation_matrix(table), f"{path}/correlations")
    return metrics.sparkSession.read.schema(METRICS).json(f"{path}/metrics")


def _lab_tables(rows: DataFrame, cols: list[str], forest: models.Fitted, out: str) -> None:
    """What lab's forest leaves unexplained, its clusters, and the tables behind the four panels."""
    scored = models.residual(forest, rows).withColumn("economic_loss", enrich.economic_loss(rows))
    kept = ["trial_id", "normative_choice", "economic_loss", "EV_diff", "complexity", "is_correct", "residual", "cluster"]
    clustered = models.cluster_residuals(scored, cols, train=scored)
    found = _kept(clustered.select(*dict.fromkeys([*kept, *cols])), f"{out}/lab/clusters")
    sinks.write_report(binning.accuracy_by_complexity(found), f"{out}/lab/accuracy_by_complexity")
    sinks.write_report(binning.loss_by_complexity(found, F.col("economic_loss")), f"{out}/lab/loss_by_complexity")
    sinks.write_report(models.top_importances(models.feature_importance(forest, rows.sparkSession)), f"{out}/lab/importances")
    sinks.write_trials(models.project_2d(found, cols), f"{out}/lab/map")


def merge_run(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """The statistics table of all sources, written, and the report on it."""
    stats = enrich.unified_stats(stacked_trials(read_sources(spark, folder)))
    sinks.write_stats(stats, f"{out}/unified_stats")
    report = merge_report(_kept(stats, f"{out}/stats_by_trial"))
    sinks.write_report(report, f"{out}/merge_analysis")
    return spark.read.schema(METRICS).json(f"{out}/merge_analysis")


def advanced_run(spark: SparkSession, folder: str, out: str, grid: dict | None = None, folds: int = sampling.FOLDS) -> DataFrame:
    """Fits, clusters and calibration, from the raw files again: calibration cleans cons in its own way."""
    trials = _kept(read_sources(spark, folder), f"{out}/trials_as_read")
    report = advanced_report(trials, grid, folds, Ledger(spark, f"{out}/scores", "advanced"))
    sinks.write_report(report, f"{out}/advanced_analysis")
    return spark.read.schema(METRICS).json(f"{out}/advanced_analysis")
