"""Grouped reports, correlations, paired tests, cluster profiles and classification scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import PAIR_FEATURES, calibration_gap
from ..functions.tails import t_quantile, t_two_sided, wide_t_quantile
from .binning import exact_median, split_easy_hard
from .cleaning import gap_counts, gaps_in, impute_median
from .ordered import with_running_total
from .sampling import infer_subject
from .scalars import confidence_norm

STAT_FEATURES = ["mean_left", "mean_right", "var_left", "var_right", "diff_mean", "mean_var", "diff_var"]
CORRELATION_COLUMNS = [*PAIR_FEATURES, "EV_diff", "complexity"]
_EXACT_FOLDS = 32

# The five interpretations of a cluster and the small-cluster note.
BIAS_LEFT = "Left overestimation / Anchoring to left option"
BIAS_RIGHT = "Right overestimation / Anchoring to right option"
BIAS_CONSERVATISM = "Conservatism — ignoring strong evidence at high complexity"
BIAS_UNDERVALUED = "Evidence undervaluation / Counter-intuitive choice"
BIAS_MIXED = "Mixed pattern / Moderate deviation from EV-optimal"
BIAS_TOO_SMALL = "Insufficient data"


def summary_by_source(stats: DataFrame) -> DataFrame:
    return stats.groupBy("source").agg(
        F.count("response_left").alias("n"),
        F.avg("response_left").alias("p_choose_left"),
        F.avg("correct").alias("accuracy"),
        F.avg("diff_mean").alias("mean_diff_mean"),
        F.avg("mean_var").alias("mean_mean_var"))


def rows_by_source(uni: DataFrame, col: str = "dataset_source", total: str = "total") -> DataFrame:
    """Row count per source, largest first, with the overall count summed from the few counts."""
    counted = uni.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    overall = counted.agg(F.sum("n").alias("n")).select(F.lit(total).alias(col), F.coalesce("n", F.lit(0)).alias("n"))
    return counted.unionByName(overall).orderBy(F.desc("n"), col)


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson correlations of median-filled columns, long form.

    The aggregate counts what is missing as well, so a table without gaps is done after one pass.
    """
    cols = [c for c in (cols or CORRELATION_COLUMNS) if c in df.columns]
    if len(cols) < 2:
        raise ValueError("a correlation needs at least two columns")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    measures = [F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]
    plain = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    seen = plain.agg(*measures, *gap_counts(cols)).first()
    if gaps_in(seen, cols):
        seen = impute_median(plain, cols, seen).agg(*measures).first()
    row = df.sparkSession.createDataFrame([tuple(seen[f"{a}|{b}"] for a, b in pairs)], T.StructType(
        [T.StructField(f"{a}|{b}", T.DoubleType()) for a, b in pairs]))
    cells = [F.struct(F.lit(x).alias("feature_a"), F.lit(y).alias("feature_b"),
                      F.col(f"`{a}|{b}`").alias("r"))
             for a, b in pairs for x, y in ({(a, b), (b, a)})]
    return row.select(F.inline(F.array(*cells)))


def point_biserial(stats: DataFrame, y: str = "response_left",
                   cols: list[str] | None = None) -> DataFrame:
    """r, t and two-sided p of each statistic against the binary response.

    Infinities and gaps of a statistic become its median first; rows without a response do not count.
    """
    cols = cols or STAT_FEATURES
    plain = stats.select(F.col(y).cast("double").alias(y), *[F.col(c).cast("double").alias(c) for c in cols])
    measures = [e for c in cols for e in (F.count(F.when(F.col(c).isNotNull(), F.col(y))).alias(f"n:{c}"), F.corr(y, c).alias(c))]
    row = plain.agg(*measures, *gap_counts(cols)).first()  # one pass, unless something is missing
    if gaps_in(row, cols):
        row = impute_median(plain, cols, row).agg(*measures).first()
    out = []
    for c in cols:
        r, n, t, p = row[c], row[f"n:{c}"], None, None
        if r is not None and n > 2:
            t = r * math.sqrt((n - 2) / (1 - r * r)) if abs(r) < 1 else math.copysign(math.inf, r)
            p = t_two_sided(t, n - 2)
        out.append((c, n, r, t, p))
    return stats.sparkSession.createDataFrame(
        out, "feature string, n long, r double, t double, p_value double")


def calibration_correlations(enriched: DataFrame) -> DataFrame:
    scored = confidence_norm(enriched.where(F.col("confidence").isNotNull()))
    return scored.agg(F.corr("complexity", "is_correct").alias("corr_complexity_accuracy"),
                      F.corr("complexity", "confidence_norm").alias("corr_complexity_confidence"),
                      F.corr("confidence_norm", "is_correct").alias("corr_confidence_accuracy"))


def with_gap(enriched: DataFrame) -> DataFrame:
    """Rows with a confidence, their gap to accuracy and their easy/hard segment."""
    scored = confidence_norm(split_easy_hard(enriched.where(F.col("confidence").isNotNull())))
    return scored.withColumn("gap", calibration_gap(F.col("confidence_norm"), F.col("is_correct")))


def confidence_gap(enriched: DataFrame) -> DataFrame:
    """Mean gap at low and high complexity and their difference, in one pass."""
    easy = F.col("segment") == "easy"
    low = F.avg(F.when(easy, F.col("gap")))
    high = F.avg(F.when(~easy, F.col("gap")))
    return with_gap(enriched).agg(low.alias("gap_low"), high.alias("gap_high"),
                                  (high - low).alias("metacognitive_bias"))


def subject_gap(enriched: DataFrame, subject: str = "subject") -> DataFrame:
    """Mean gap of each subject in easy and in hard trials."""
    segment, gap = F.col("segment"), F.col("gap")
    return (with_gap(enriched).groupBy(subject)
            .agg(F.avg(F.when(segment == "easy", gap)).alias("gap_easy"),
                 F.avg(F.when(segment == "hard", gap)).alias("gap_hard")))


def paired_subjects(easy: DataFrame, hard: DataFrame, subject: str = "subject") -> DataFrame:
    """Subjects with a value on both sides (inner join of two per-subject tables)."""
    return easy.join(hard, subject, "inner")


def paired_ttest_gap(enriched: DataFrame, subject: str = "subject", min_subjects: int = 3,
                     trials_per_subject: int = 200) -> DataFrame:
    """Paired t-test of the hard against the easy gap; null under ``min_subjects`` pairs.

    Both sides of a subject come from one grouped pass, so pairing is a null filter. A layout without
    subjects gets them from the row order, ``trials_per_subject`` rows each.
    """
    if subject not in enriched.columns:
        enriched = infer_subject(enriched, trials_per_subject, name=subject)
    pairs = subject_gap(enriched, subject).where(
        F.col(subject).isNotNull() & F.col("gap_easy").isNotNull() & F.col("gap_hard").isNotNull())
    diff = F.col("gap_hard") - F.col("gap_easy")
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg("gap_easy").alias("easy"),
                    F.avg("gap_hard").alias("hard"), F.avg(diff).alias("mean"),
                    F.stddev_samp(diff).alias("sd")).first()
    out = (None, None, row["n"], None, None, None, None)
    if row["n"] >= min_subjects:
        t, p = None, None
        if row["sd"]:
            t = row["mean"] / (row["sd"] / math.sqrt(row["n"]))
            p = t_two_sided(t, row["n"] - 1)
        out = (t, p, row["n"], row["easy"], row["hard"], row["hard"] - row["easy"],
               None if p is None else p < 0.05)
    return enriched.sparkSession.createDataFrame(
        [out], "t_statistic double, p_value double, n_subjects long, mean_gap_easy double, "
               "mean_gap_hard double, mean_difference double, significant boolean")


def fold_ci(scores: DataFrame, by: str = "model", score: str = "score", alpha: float = 0.95) -> DataFrame:
    """Mean and t-interval of fold scores, one row per model (a single fold has margin 0).

    The quantile depends on the number of folds alone: up to ``_EXACT_FOLDS`` it is a literal, beyond that its
    expansion, so nothing comes to the driver and the scores are computed once.
    """
    grouped = scores.groupBy(F.col(by).cast("string").alias(by)).agg(
        F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("_sd"))
    p, freedom = (1 + alpha) / 2, F.col("n") - 1
    known = F.array(*[F.lit(t_quantile(p, df)) for df in range(1, _EXACT_FOLDS)])
    quantile = F.when(F.col("n") <= _EXACT_FOLDS, F.get(known, freedom.cast("int") - 1)).otherwise(wide_t_quantile(p, freedom))
    factor = F.when(F.col("n") > 1, quantile / F.sqrt("n")).otherwise(0.0)
    return (grouped.withColumn("margin", F.coalesce(F.col("_sd"), F.lit(0.0)) * factor)
            .select(by, "n", "mean", "margin", (F.col("mean") - F.col("margin")).alias("low"),
                    (F.col("mean") + F.col("margin")).alias("high")))


def cluster_profile(df: DataFrame, cluster: str = "cluster", min_rows: int = 10) -> DataFrame:
    """Size, means and error rate per cluster; only the size where a cluster is too small."""
    enough = F.count(F.lit(1)) >= min_rows
    measures = {"mean_EV_diff": F.avg("EV_diff"), "mean_complexity": F.avg("complexity"),
                "mean_residual": F.avg("residual"), "error_rate": 1 - F.avg("is_correct"),
                "avg_abs_residual": F.avg(F.abs("residual"))}
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"),
                                   *[F.when(enough, m).alias(n) for n, m in measures.items()])


def bias_label(profile: DataFrame, median_complexity: float, min_rows: int = 10) -> DataFrame:
    """Read each cluster's profile as one of five bias types; the first rule that holds wins."""
    ev, residual, error = F.col("mean_EV_diff"), F.col("mean_residual"), F.col("error_rate")
    label = (F.when(F.col("n") < min_rows, BIAS_TOO_SMALL)
             .when((residual > 0.1) & (ev > 0), BIAS_LEFT)
             .when((residual < -0.1) & (ev < 0), BIAS_RIGHT)
             .when((error > 0.35) & (F.col("mean_complexity") > F.lit(median_complexity)),
                   BIAS_CONSERVATISM)
             .when((ev > 0) & (residual < -0.05), BIAS_UNDERVALUED)
             .otherwise(BIAS_MIXED))
    return profile.withColumn("interpretation", label)


def interpret_clusters(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return bias_label(cluster_profile(df, cluster), exact_median(df, "complexity"))


def guard_min_rows(df: DataFrame, by: list[str], min_rows: int, **aggregates: Column) -> DataFrame:
    """Grouped aggregates that are null for groups under ``min_rows`` rows."""
    enough = F.count(F.lit(1)) >= min_rows
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                               *[F.when(enough, c).alias(n) for n, c in aggregates.items()])


def accuracy_score(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null when only one class is present.

    Rows are first folded to one row per distinct score. What each score beats is a
    range-partitioned running total, so no task sees the whole list.
    """
    scored = F.col(score).isNotNull()
    folded = (df.groupBy(score)
              .agg(F.sum(F.when(scored & (F.col(label) == 1), 1).otherwise(0)).alias("pos"),
                   F.sum(F.when(scored & (F.col(label) == 0), 1).otherwise(0)).alias("neg"))
              .where(F.col("pos") + F.col("neg") > 0))
    ranked = with_running_total(folded, score, "neg", "neg_below")
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.agg(F.try_divide(wins, F.nullif(pairs, F.lit(0.0))).alias("auc"))
