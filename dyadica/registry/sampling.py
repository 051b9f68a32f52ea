"""Splits, folds, samples and ordering (inventory W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fits, sampling
from ..operators.enrich import unified_stats
from .base import lab, query, rounded, sql
from .features import fold_sql, split_sql


@query("w1_stratified_split", sql(f"with {split_sql(10)} select trial_id, choice, split from split"))
def stratified_split(trials):
    return sampling.stratified_split(trials.select("trial_id", "choice"), "choice")


@query("w2_stratified_folds", sql("""
select trial_id, choice, cast(ntile(5) over (partition by choice
  order by md5(trial_id || ':10'), trial_id) - 1 as int) as fold from trials"""))
def stratified_folds(trials):
    return sampling.stratified_folds(trials.select("trial_id", "choice"), "choice")


@query("w3_ordered_folds", sql("""
select trial_id, source, response_left, cast(ntile(5) over (partition by response_left
  order by case source when 'data_lab' then 0 when 'data_cons' then 1 else 2 end, trial_id) - 1 as int)
  as fold from st""", "st"))
def ordered_folds(trials):
    rows = unified_stats(trials).select("trial_id", "source", "response_left")
    return sampling.ordered_folds(rows, "response_left", "source",
                                  ["data_lab", "data_cons", "data_framing"])


@query("w4_infer_subject", sql("""
select trial_id, (row_number() over (order by trial_id) - 1) // 200 as subject
from trials where source = 'cons'"""))
def infer_subject(trials):
    rows = trials.where(F.col("source") == "cons").select("trial_id")
    return sampling.infer_subject(rows, per=200)


@query("w5_sample_n", sql("""
select trial_id, subject, choice from trials order by md5(trial_id || ':42'), trial_id limit 2000"""))
def sample_n(trials):
    return sampling.sample_n(trials.select("trial_id", "subject", "choice"), 2000)


def leak_grid_sql(leaks: list[float]) -> str:
    return " union all ".join(
        f"select {i} as grid_id, {leak!r}::double as leak, avg(case when choice = "
        f"(case when {fold_sql(leak)} > 0 then 1 else 0 end) then 1.0::double else 0.0::double end) "
        "as accuracy from trials where source = 'lab'" for i, leak in enumerate(leaks))


@query("w7_best_params", sql(
    f"select grid_id, leak, round(accuracy, 6) + 0.0 as accuracy from ({leak_grid_sql(fits.LEAK_GRID)}) "
    "order by accuracy desc, grid_id limit 1"))
def best_params(trials):
    scores = fits.leaky_scores(trials.where(F.col("source") == "lab"))
    return rounded(fits.best_params(scores, "accuracy"), "accuracy")
