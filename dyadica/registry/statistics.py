"""Grouped, binned and correlational reports (inventory D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as fx
from ..functions.tails import t_quantile
from ..operators import binning, cleaning, enrich, sampling, summaries
from ..operators.selection import exact_medians
from .base import bins_sql, cons, lab, q6, query, r6, rounded, sql, t_two_sided_sql
from .sources import corr_sql


@query("d1_summary_by_source", sql(f"""
select source, count(*) as n, {q6('avg(response_left)', 'p_choose_left')}, {q6('avg(correct)', 'accuracy')},
  {q6('avg(diff_mean)', 'mean_diff_mean')}, {q6('avg(mean_var)', 'mean_mean_var')}
from st group by source""", "st"))
def summary_by_source(trials):
    return rounded(summaries.summary_by_source(enrich.unified_stats(trials)),
                   "p_choose_left", "accuracy", "mean_diff_mean", "mean_mean_var")


@query("d2_rows_by_source", sql("""
select coalesce(source, 'total') as dataset_source, count(*) as n from trials group by rollup (source)"""))
def rows_by_source(trials):
    return summaries.rows_by_source(enrich.unified_trials(trials))


@query("d3_quantile_bin", sql(f"""
with {bins_sql('lab', 'complexity', 10)},
  numbered as (select row_number() over (order by e) as i, e from edges)
select b.trial_id, b.bin, {q6('l.e', 'lo')}, {q6('h.e', 'hi')}
from binned b join numbered l on l.i = b.bin join numbered h on h.i = b.bin + 1""", "lab"))
def quantile_bin(trials):
    return rounded(binning.quantile_bin(lab(trials), "complexity", 10, bounds=True)
                   .select("trial_id", "bin", "lo", "hi"), "lo", "hi")


@query("d3_quantile_bin_by_source", sql(f"""
with {bins_sql('enr', 'pair_winner_balance', 8, 'source')}
select trial_id, source, bin from binned""", "enr"))
def quantile_bin_by_source(trials):
    """Few distinct values, so several edges coincide and are dropped."""
    return (binning.quantile_bin(enrich.enrich(trials), "pair_winner_balance", 8, by="source")
            .select("trial_id", "source", "bin"))


@query("d4_accuracy_by_complexity", sql(f"""
with {bins_sql('lab', 'complexity', 10)}
select bin, count(*) as n, {q6('avg(is_correct)', 'accuracy')}, {q6('avg(complexity)', 'complexity_mean')}
from binned group by bin""", "lab"))
def accuracy_by_complexity(trials):
    return rounded(binning.accuracy_by_complexity(lab(trials)), "accuracy", "complexity_mean")


@query("d5_loss_by_complexity", sql(f"""
with {bins_sql('lab', 'complexity', 10)}
select bin, count(*) as n, {q6('avg(loss)', 'loss_mean')}, {q6('avg(complexity)', 'complexity_mean')}
from binned group by bin""", "lab"))
def loss_by_complexity(trials):
    rows = lab(trials)
    return rounded(binning.loss_by_complexity(rows, enrich.economic_loss(rows)),
                   "loss_mean", "complexity_mean")


@query("d6_choice_by_evidence", sql(f"""
with {bins_sql('seg', 'EV_diff', 10, 'segment')}
select segment, bin, count(*) as n, {q6('avg(choice)', 'choice_mean')}, {q6('avg(EV_diff)', 'EV_diff_mean')}
from binned where segment in (select segment from seg group by segment having count(*) >= 20)
group by segment, bin""", "seg"))
def choice_by_evidence(trials):
    return rounded(binning.choice_by_evidence(lab(trials)), "choice_mean", "EV_diff_mean")


@query("d7_calibration_by_complexity", sql(f"""
with {bins_sql('gap', 'complexity', 5)}
select bin, count(*) as n, {q6('avg(is_correct)', 'accuracy')},
  {q6('avg(confidence_norm)', 'confidence')}, {q6('avg(complexity)', 'complexity_mean')}
from binned group by bin""", "gap"))
def calibration_by_complexity(trials):
    return rounded(binning.calibration_by_complexity(cons(trials)),
                   "accuracy", "confidence", "complexity_mean")


@query("d8_correlation_matrix", sql(corr_sql(), "enr"))
def correlation_matrix(trials):
    return rounded(summaries.correlation_matrix(enrich.enrich(trials)), "r")


_BISERIAL = " union all ".join(
    f"select '{c}' as feature, count(*) as n, corr(response_left, {c}) as r from st"
    for c in summaries.STAT_FEATURES)


@query("d9_point_biserial", sql(f"""
with b as materialized (select *, r * sqrt((n - 2) / (1 - r * r)) as t from ({_BISERIAL}))
select feature, n, {q6('r', 'r')}, {q6('t', 't')},
  {q6(t_two_sided_sql('b.t', '(b.n - 2)'), 'p_value')} from b""", "st"))
def point_biserial(trials):
    return rounded(summaries.point_biserial(enrich.unified_stats(trials)), "r", "t", "p_value")


@query("d10_calibration_correlations", sql(f"""
select {q6('corr(complexity, is_correct)', 'corr_complexity_accuracy')},
  {q6('corr(complexity, confidence_norm)', 'corr_complexity_confidence')},
  {q6('corr(confidence_norm, is_correct)', 'corr_confidence_accuracy')} from gap""", "gap"))
def calibration_correlations(trials):
    out = summaries.calibration_correlations(cons(trials))
    return rounded(out, *out.columns)


@query("d11_confidence_gap", sql(f"""
with g as (select avg(gap) filter (where segment = 'easy') as lo,
  avg(gap) filter (where segment = 'hard') as hi from gap)
select {q6('lo', 'gap_low')}, {q6('hi', 'gap_high')}, {q6('hi - lo', 'metacognitive_bias')} from g""", "gap"))
def confidence_gap(trials):
    out = summaries.confidence_gap(cons(trials))
    return rounded(out, *out.columns)


@query("d12_subject_gap", sql(f"""
select subject, {q6("avg(gap) filter (where segment = 'easy')", 'gap_easy')},
  {q6("avg(gap) filter (where segment = 'hard')", 'gap_hard')} from gap group by subject""", "gap"))
def subject_gap(trials):
    return rounded(summaries.subject_gap(cons(trials)), "gap_easy", "gap_hard")


@query("d13_paired_ttest_gap", sql(f"""
with s as (select subject, avg(gap) filter (where segment = 'easy') as e,
    avg(gap) filter (where segment = 'hard') as h from gap group by subject),
  m as (select count(*) as n, avg(e) as e, avg(h) as h, avg(h - e) / (stddev_samp(h - e) / sqrt(count(*))) as t
    from s where e is not null and h is not null),
  p as materialized (select *, {t_two_sided_sql('m.t', '(m.n - 1)')} as p from m)
select {q6('t', 't_statistic')}, {q6('p', 'p_value')}, n as n_subjects, {q6('e', 'mean_gap_easy')},
  {q6('h', 'mean_gap_hard')}, {q6('h - e', 'mean_difference')}, p < 0.05 as significant from p""", "gap"))
def paired_ttest_gap(trials):
    return rounded(summaries.paired_ttest_gap(cons(trials)), "t_statistic", "p_value", "mean_gap_easy",
                   "mean_gap_hard", "mean_difference")


_GAPPY_SQL = sql(f"""
with s as (select subject, avg(gap) filter (where segment = 'easy') as e,
    avg(gap) filter (where segment = 'hard') as h from gap where subject is not null group by subject),
  m as (select count(*) as n, avg(e) as e, avg(h) as h, avg(h - e) / (stddev_samp(h - e) / sqrt(count(*))) as t
    from s where e is not null and h is not null),
  p as materialized (select *, {t_two_sided_sql('m.t', '(m.n - 1)')} as p from m)
select {q6('t', 't_statistic')}, {q6('p', 'p_value')}, n as n_subjects, {q6('e', 'mean_gap_easy')},
  {q6('h', 'mean_gap_hard')}, {q6('h - e', 'mean_difference')}, p < 0.05 as significant from p""", "gap").replace(
    "trials as (", "whole as (", 1).replace("enr as materialized (", """trials as (
  select * replace (case when trial_id % 97 = 0 then null else L3 end as L3, case when trial_id % 7 = 0 then null else subject end as subject,
    case when trial_id % 89 = 0 then null else confidence end as confidence) from whole),
enr as materialized (""", 1).replace("where source = 'cons'", "where source = 'cons' and confidence is not null", 1)


@query("d13_paired_ttest_gap_gappy", _GAPPY_SQL)
def paired_ttest_gap_gappy(trials):
    """Only rows without a confidence are dropped: those with a missing item or subject stay in the quantities they have."""
    trial = F.col("trial_id")
    rows = trials.where(F.col("source") == "cons").withColumns({
        "L3": F.when(trial % 97 != 0, F.col("L3")), "subject": F.when(trial % 7 != 0, F.col("subject")),
        "confidence": F.when(trial % 89 != 0, F.col("confidence")), "empty": F.lit(None).cast("double")})
    found = summaries.paired_ttest_gap(enrich.enrich(cleaning.clean_confidence(rows)))
    return rounded(found, "t_statistic", "p_value", "mean_gap_easy", "mean_gap_hard", "mean_difference")


@query("d14_fold_ci", sql(f"""
with f as (select source as model, ntile(5) over (partition by choice
      order by md5(trial_id || ':10'), trial_id) as fold, is_correct from enr),
  s as (select model, fold, avg(is_correct) as score from f group by model, fold),
  m as (select model, count(*) as n, avg(score) as mean,
    {t_quantile(0.975, 4)!r}::double * stddev_samp(score) / sqrt(count(*)) as margin from s group by model)
select model, n, {q6('mean', 'mean')}, {q6('margin', 'margin')}, {q6('mean - margin', 'low')},
  {q6('mean + margin', 'high')} from m""", "enr"))
def fold_ci(trials):
    """Fold scores of the rule "choose the larger expected value", per source."""
    folded = sampling.stratified_folds(enrich.enrich(trials), "choice")
    scores = (folded.groupBy(F.col("source").alias("model"), "fold")
              .agg(F.avg("is_correct").alias("score")))
    return rounded(summaries.fold_ci(scores), "mean", "margin", "low", "high")


# Cluster labels and a residual that both engines can compute.
_CLUSTERS_SQL = """clusters as materialized (
  select *, cast(case when EV_diff > 3 then 0 when EV_diff < -3 then 1
      when complexity > 9 then 2 else 3 end as int) as cluster,
    1 / (1 + exp(-0.1 * EV_diff)) - normative_choice as residual from lab)"""
_PROFILE_SQL = f"""select cluster, count(*) as n, {q6('avg(EV_diff)', 'mean_EV_diff')},
  {q6('avg(complexity)', 'mean_complexity')}, {q6('avg(residual)', 'mean_residual')},
  {q6('1 - avg(is_correct)', 'error_rate')}, {q6('avg(abs(residual))', 'avg_abs_residual')}
  from clusters group by cluster"""
_PROFILE = ["mean_EV_diff", "mean_complexity", "mean_residual", "error_rate", "avg_abs_residual"]


def _clusters(trials):
    ev, hard = F.col("EV_diff"), F.col("complexity")
    label = F.when(ev > 3, 0).when(ev < -3, 1).when(hard > 9, 2).otherwise(3)
    return lab(trials).withColumns({
        "cluster": label, "residual": fx.sigmoid(ev, 0.1, 0.0) - F.col("normative_choice")})


@query("d15_cluster_profile", sql(f"with {_CLUSTERS_SQL} {_PROFILE_SQL}", "lab"))
def cluster_profile(trials):
    return rounded(summaries.cluster_profile(_clusters(trials)), *_PROFILE)


@query("d16_bias_label", sql(f"""
with {_CLUSTERS_SQL}, profile as ({_PROFILE_SQL})
select *, case when n < 10 then '{summaries.BIAS_TOO_SMALL}'
  when mean_residual > 0.1 and mean_EV_diff > 0 then '{summaries.BIAS_LEFT}'
  when mean_residual < -0.1 and mean_EV_diff < 0 then '{summaries.BIAS_RIGHT}'
  when error_rate > 0.35 and mean_complexity > (select median(complexity) from lab)
    then '{summaries.BIAS_CONSERVATISM}'
  when mean_EV_diff > 0 and mean_residual < -0.05 then '{summaries.BIAS_UNDERVALUED}'
  else '{summaries.BIAS_MIXED}' end as interpretation from profile""", "lab"))
def bias_label(trials):
    return rounded(summaries.interpret_clusters(_clusters(trials)), *_PROFILE)


@query("d17_exact_median", sql(" union all ".join(
    f"select '{c}' as feature, {q6(f'median({c})', 'median')} from enr"
    for c in ("EV_diff", "complexity", "pair_diff_std", "pair_diff_entropy")), "enr"))
def exact_median(trials):
    cols = ["EV_diff", "complexity", "pair_diff_std", "pair_diff_entropy"]
    found = exact_medians(enrich.enrich(trials), cols)
    out = trials.sparkSession.createDataFrame(list(found.items()), "feature string, median double")
    return rounded(out, "median")


@query("d18_accuracy_score", sql(f"""
select {q6('avg(case when choice = (case when EV_diff > 0 then 1 else 0 end) then 1.0 else 0.0 end)',
           'accuracy')} from enr""", "enr"))
def accuracy_score(trials):
    scored = enrich.with_ev(trials).withColumn("prediction", F.when(F.col("EV_diff") > 0, 1).otherwise(0))
    return rounded(summaries.accuracy_score(scored, "choice", "prediction"), "accuracy")


_AUC_SQL = f"""
with s as materialized (select choice, round(1 / (1 + exp(-0.1 * EV_diff)) + complexity / 1000, 6) as score from enr),
  r as (select choice, rank() over (order by score)
      + (count(*) over (partition by score) - 1) / 2.0 as avg_rank from s),
  c as (select sum(choice) as pos, count(*) - sum(choice) as neg,
      sum(avg_rank) filter (where choice = 1) as ranks from r)
select {q6('(ranks - pos * (pos + 1) / 2.0) / (pos * neg)', 'auc')} from c"""


@query("d18_roc_auc", sql(_AUC_SQL, "enr"))
def roc_auc(trials):
    score = r6(fx.sigmoid(F.col("EV_diff"), 0.1, 0.0) + F.col("complexity") / 1000)
    rows = enrich.enrich(trials).select("choice", score.alias("score"))
    return rounded(summaries.roc_auc(rows, "choice", "score"), "auc")

