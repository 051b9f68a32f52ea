"""Writers for enriched trials, the two stacked tables and the small result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.sequence import LEFT, PAIR_FEATURES, RIGHT

# Fixed column orders of the two stacked tables.
UNIFIED_COLUMNS = ["subject", *LEFT, *RIGHT, "human_choice", "normative_choice", "EV_left",
                   "EV_right", "EV_diff", "complexity", "is_correct", "dataset_source",
                   *PAIR_FEATURES]
STAT_COLUMNS = ["mean_left", "mean_right", "var_left", "var_right", "diff_mean", "mean_var",
                "diff_var", "response_left", "correct", "source"]


def _write(df: DataFrame, path: str, fmt: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_trials(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = None) -> None:
    """Enriched trials, optionally one folder per value of ``by`` for partition pruning."""
    _write(df, path, fmt, by)


def write_unified(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = None) -> None:
    _write(df.select(*UNIFIED_COLUMNS), path, fmt, by)


def write_stats(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = None) -> None:
    _write(df.select(*STAT_COLUMNS), path, fmt, by)


def write_report(metrics: DataFrame, path: str) -> None:
    """A tidy metrics table as JSON lines; its rows are metrics, never trials."""
    _write(metrics, path, "json")


def write_corr(corr: DataFrame, path: str) -> None:
    """Correlations in long form, one (feature_a, feature_b, r) row per pair."""
    _write(corr.select("feature_a", "feature_b", "r"), path, "csv")


def save_bucketed(df: DataFrame, table: str, by: str = "trial_id", buckets: int = 64) -> DataFrame:
    """``df`` as a catalogue table in buckets of ``by``, sorted inside, and that table.

    Tables of one bucket number are joined on ``by`` without an exchange: trials, splits and scores that are
    stored like this meet bucket by bucket.
    """
    df.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(by).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)
