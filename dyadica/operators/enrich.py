"""Trial features, the stacked tables and the model column lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as fx
from ..functions.sequence import LEFT, PAIR_FEATURES, RIGHT
from ..sources.layouts import SOURCE_TAGS
from ..sources.sinks import STAT_COLUMNS, UNIFIED_COLUMNS
from .cleaning import drop_null_rows, impute_median


def with_ev(trials: DataFrame) -> DataFrame:
    return trials.withColumns(fx.ev())


def enrich(trials: DataFrame, choice: str = "choice", digits: int | None = 6) -> DataFrame:
    """Add expected values, labels, complexity and the pair features; all narrow.

    What several features share (item differences, means) is a column of an earlier
    step, so it is computed once per row and the generated code stays small enough to
    be compiled natively.
    """
    diffs = [f"_d{i}" for i in range(1, len(LEFT) + 1)]
    shared = with_ev(trials).withColumns({"_mean": fx.items_mean(),
                                          **dict(zip(diffs, fx.pair_differences()))})
    shared = shared.withColumns({
        "normative_choice": fx.normative_choice(F.col("EV_left"), F.col("EV_right")),
        "_dmean": fx.side_mean(diffs)})
    return shared.withColumns({
        "is_correct": fx.is_correct(F.col(choice), F.col("normative_choice")),
        **fx.complexity(mean="_mean", digits=digits),
        **fx.pair_diff_spread(diffs, "_dmean"),
        "pair_winner_balance": fx.pair_winner_balance(diffs),
        "pair_diff_entropy": fx.pair_diff_entropy(diffs),
    }).drop("_mean", "_dmean", *diffs)


def with_stats(trials: DataFrame, choice: str = "choice") -> DataFrame:
    """Add the sequence statistics, again step by step; missing items make them null."""
    out = trials.withColumns({"mean_left": fx.side_mean(LEFT), "mean_right": fx.side_mean(RIGHT)})
    out = out.withColumns({"var_left": fx.side_variance(LEFT, "mean_left"),
                           "var_right": fx.side_variance(RIGHT, "mean_right")})
    return out.withColumns(fx.stat_contrasts(
        *map(F.col, ["mean_left", "mean_right", "var_left", "var_right", choice])))


def economic_loss(df: DataFrame, choice: str = "choice", fallback: str = "responseLeft") -> Column:
    """Expected value given up by the choice, never negative."""
    chosen = F.col(choice if choice in df.columns else fallback)
    return (F.greatest("EV_left", "EV_right")
            - F.when(chosen == 1, F.col("EV_left")).otherwise(F.col("EV_right")))


def to_unified(enriched: DataFrame, tag: str, choice: str = "choice") -> DataFrame:
    """One source's block of the stacked trials; ``subject`` is null where it is unknown."""
    subject = (F.col("subject").try_cast("long") if "subject" in enriched.columns
               else F.lit(None).cast("long"))
    block = enriched.withColumns({
        "subject": subject,
        "human_choice": F.col(choice).cast("int"),
        "normative_choice": F.col("normative_choice").cast("int"),
        "is_correct": F.col("is_correct").cast("int"),
        "dataset_source": F.lit(tag),
    })
    key = ["trial_id"] if "trial_id" in enriched.columns else []
    return block.select(*key, *UNIFIED_COLUMNS)


def to_stats(trials: DataFrame, tag: str, choice: str = "choice") -> DataFrame:
    """One source's block of the statistics table."""
    key = ["trial_id"] if "trial_id" in trials.columns else []
    return with_stats(trials, choice).withColumn("source", F.lit(tag)).select(*key, *STAT_COLUMNS)


# A derived column is null exactly when an item or the choice is. The null filters below
# name only those inputs: the same rows go, and the predicate reaches the scan as a few
# IS NOT NULL checks instead of a second copy of every feature expression.
_UNIFIED_INPUTS = [*LEFT, *RIGHT, "human_choice", "dataset_source"]
_STAT_INPUTS = ["mean_left", "mean_right", "response_left"]


def stack_trials(blocks: list[DataFrame]) -> DataFrame:
    """Union of the trial blocks by name, rows with a missing value (subject aside) removed."""
    return drop_null_rows(reduce(DataFrame.unionByName, blocks), _UNIFIED_INPUTS)


def stack_stats(blocks: list[DataFrame]) -> DataFrame:
    """Union of the statistics blocks by name, rows with a missing value removed."""
    return drop_null_rows(reduce(DataFrame.unionByName, blocks), _STAT_INPUTS)


def unified_trials(trials: DataFrame) -> DataFrame:
    """The stacked trials straight from canonical ones that carry ``source``: a single scan.

    The cons source has no subject in its own layout, so its subject is null here too.
    """
    complete = drop_null_rows(trials, [*LEFT, *RIGHT, "choice", "source"])
    known = complete.withColumn("subject", F.when(F.col("source") != "cons", F.col("subject")))
    rows = enrich(known).withColumns({
        "human_choice": F.col("choice").cast("int"), "dataset_source": F.col("source")})
    return rows.select("trial_id", *UNIFIED_COLUMNS)


def unified_stats(trials: DataFrame) -> DataFrame:
    """The statistics table straight from canonical trials: a single scan."""
    tag = reduce(lambda c, kv: c.when(F.col("source") == kv[0], kv[1]), SOURCE_TAGS.items(), F)
    complete = with_stats(drop_null_rows(trials, [*LEFT, *RIGHT, "choice"]))
    return complete.withColumn("source", tag).select("trial_id", *STAT_COLUMNS)


def feature_columns(layout: str, columns: list[str]) -> list[str]:
    """Model columns of a layout, in their fixed order."""
    base = [*LEFT, *RIGHT, "EV_diff", "complexity"]
    if layout == "lab":
        return [*base, "is_diff_mean", *PAIR_FEATURES]
    if layout == "cons" and "flip" in columns:
        return [*base, *PAIR_FEATURES, "flip"]
    return [*base, *PAIR_FEATURES]


def features(enriched: DataFrame, layout: str, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Median-filled feature columns next to the ``keep`` columns."""
    cols = feature_columns(layout, enriched.columns)
    table = enriched.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return impute_median(table, cols), cols


def one_hot_source(df: DataFrame, col: str = "dataset_source", prefix: str = "src_", most: int = 200) -> DataFrame:
    """A 0/1 column per level found, alphabetical, none dropped.

    The levels come from the partial aggregate of a ``distinct``; there are as many
    as stacked sources. A column with more than ``most`` levels raises an error.
    """
    found = df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} levels")
    levels = sorted(r[0] for r in found)
    return df.withColumns({f"{prefix}{v}": F.when(F.col(col) == v, 1.0).otherwise(0.0) for v in levels})


def features_unified(uni: DataFrame, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Features of the stacked trials: the shared columns plus one 0/1 column per source."""
    base = feature_columns("unified", uni.columns)
    table = uni.select(*keep, "dataset_source", *[F.col(c).cast("double").alias(c) for c in base])
    hot = one_hot_source(impute_median(table, base))
    added = [c for c in hot.columns if c.startswith("src_")]
    rest = [c for c in hot.columns if c != "dataset_source" or c in keep]
    return hot.select(*rest), base + added
