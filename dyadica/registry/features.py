"""Per-trial features, stacking and joins (inventory C and J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as fx
from ..operators import enrich, sampling, scalars, summaries
from ..plans import clustered_lab
from ..sources import events, layouts
from ..sources.sinks import STAT_COLUMNS, UNIFIED_COLUMNS
from .base import cons, lab, ledger, q6, query, r6, rounded, sql
from .sources import _ROUNDED_PAIRS, _STAT_VALUES, _STATS_SQL, _UNIFIED_SQL


@query("c1_ev", sql("select trial_id, EV_left, EV_right, EV_diff from enr", "enr"))
def ev(trials):
    return enrich.with_ev(trials).select("trial_id", "EV_left", "EV_right", "EV_diff")


@query("c2_normative_choice", sql("select trial_id, normative_choice from enr", "enr"))
def normative_choice(trials):
    return enrich.enrich(trials).select("trial_id", "normative_choice")


@query("c3_is_correct", sql("select trial_id, is_correct from enr", "enr"))
def is_correct(trials):
    return enrich.enrich(trials).select("trial_id", "is_correct")


@query("c4_tie_correct", sql("select trial_id, correct from st", "st"))
def tie_correct(trials):
    return enrich.unified_stats(trials).select("trial_id", "correct")


@query("c5_complexity", sql(
    f"select trial_id, {q6('complexity_diff', 'complexity_diff')}, "
    f"{q6('complexity_sd', 'complexity_sd')}, complexity + 0.0 as complexity from enr", "enr"))
def complexity(trials):
    rows = enrich.enrich(trials).select("trial_id", "complexity_diff", "complexity_sd", "complexity")
    return rounded(rows, "complexity_diff", "complexity_sd", "complexity")


@query("c6_pair_diff_spread", sql(
    f"select trial_id, {q6('pair_diff_std', 'pair_diff_std')}, pair_diff_max, pair_diff_min from enr",
    "enr"))
def pair_diff_spread(trials):
    return rounded(enrich.enrich(trials).select(
        "trial_id", "pair_diff_std", "pair_diff_max", "pair_diff_min"), "pair_diff_std")


@query("c7_pair_winner_balance", sql("select trial_id, pair_winner_balance from enr", "enr"))
def pair_winner_balance(trials):
    return enrich.enrich(trials).select("trial_id", "pair_winner_balance")


@query("c8_pair_diff_entropy", sql(
    f"select trial_id, {q6('pair_diff_entropy', 'pair_diff_entropy')} from enr", "enr"))
def pair_diff_entropy(trials):
    return rounded(enrich.enrich(trials).select("trial_id", "pair_diff_entropy"), "pair_diff_entropy")


@query("c9_seq_stats", sql(f"select trial_id, {_STATS_SQL} from st", "st"))
def seq_stats(trials):
    return rounded(enrich.unified_stats(trials), *_STAT_VALUES)


def fold_sql(leak: float) -> str:
    diffs = [f"({l} - {r})" for l, r in zip(fx.LEFT, fx.RIGHT)]
    out = diffs[0]
    for d in diffs[1:]:
        out = f"({leak!r}::double * {out} + {d})"
    return out


@query("c10_leaky_accumulate", sql(
    f"select trial_id, {q6(fold_sql(0.95), 'acc_95')}, {q6(fold_sql(0.5), 'acc_50')} from trials"))
def leaky_accumulate(trials):
    return trials.select("trial_id", r6(fx.leaky_accumulate(0.95), "acc_95"),
                         r6(fx.leaky_accumulate(0.5), "acc_50"))


@query("c11_leaky_choice", sql(
    f"select trial_id, case when {fold_sql(0.95)} > 0 then 1 else 0 end as leaky_choice from trials"))
def leaky_choice(trials):
    return trials.select("trial_id", fx.leaky_choice(0.95).alias("leaky_choice"))


@query("c12_sequence_steps", sql("""
select trial_id, cast(i as int) as step, ls[i + 1] as left_value, rs[i + 1] as right_value
from enr, range(8) g(i)""", "enr"))
def sequence_steps(trials):
    steps = trials.select("trial_id", F.posexplode(fx.sequence_steps()).alias("step", "s"))
    return steps.select("trial_id", "step", F.col("s.left").alias("left_value"),
                        F.col("s.right").alias("right_value"))


@query("c13_sigmoid", sql(f"""
select trial_id, {q6('1 / (1 + exp(-greatest(-500, least(500, 0.1 * (EV_diff - 0.5)))))', 'p')},
  {q6('1 / (1 + exp(-greatest(-500, least(500, 1000 * EV_diff))))', 'p_steep')} from enr""", "enr"))
def sigmoid(trials):
    rows = enrich.with_ev(trials)
    return rows.select("trial_id", r6(fx.sigmoid(F.col("EV_diff"), 0.1, 0.5), "p"),
                       r6(fx.sigmoid(F.col("EV_diff"), 1000.0, 0.0), "p_steep"))


@query("c14_confidence_norm", sql(
    f"select trial_id, {q6('confidence_norm', 'confidence_norm')} from gap", "gap"))
def confidence_norm(trials):
    rows = trials.where(F.col("source") == "cons").select("trial_id", "confidence")
    return rounded(scalars.confidence_norm(rows).drop("confidence"), "confidence_norm")


@query("c15_calibration_gap", sql(f"select trial_id, {q6('gap', 'gap')} from gap", "gap"))
def calibration_gap(trials):
    scored = scalars.confidence_norm(cons(trials))
    return scored.select("trial_id", r6(fx.calibration_gap(F.col("confidence_norm"), F.col("is_correct")),
                                        "gap"))


@query("c16_interaction_terms", sql("""
select trial_id, abs(EV_diff) as Evidence_Strength,
  abs(EV_diff) * complexity as EvStr_x_Complexity, cast(subject as varchar) as Subject from lab""",
                                    "lab"))
def interaction_terms(trials):
    terms = fx.interaction_terms(F.col("EV_diff"), F.col("complexity"), F.col("subject"))
    return lab(trials).select("trial_id", *[c.alias(n) for n, c in terms.items()])


@query("c17_residual")
def residual(trials):
    return clustered_lab(lab(trials), ledger=ledger(trials, "advanced")).select("trial_id", "residual")


# --- stacking and joins --------------------------------------------------------


def _block(trials, name):
    return layouts.canonical_trials(events.raw_layout(trials, name), name)


@query("j1_stack_trials", sql(_UNIFIED_SQL.format(key="trial_id, "), "enr"))
def stack_trials(trials):
    blocks = [enrich.to_unified(enrich.enrich(_block(trials, n)), n) for n in layouts.LAYOUTS]
    return rounded(enrich.stack_trials(blocks).select("trial_id", *UNIFIED_COLUMNS), *_ROUNDED_PAIRS)


@query("j2_stack_stats", sql(f"select trial_id, {_STATS_SQL} from st", "st"))
def stack_stats(trials):
    blocks = [enrich.to_stats(_block(trials, n), tag) for n, tag in layouts.SOURCE_TAGS.items()]
    return rounded(enrich.stack_stats(blocks).select("trial_id", *STAT_COLUMNS), *_STAT_VALUES)


@query("j3_paired_subjects", sql(f"""
with e as (select subject, avg(gap) as g from gap where segment = 'easy' group by subject),
  h as (select subject, avg(gap) as g from gap where segment = 'hard' group by subject)
select e.subject, {q6('e.g', 'gap_easy')}, {q6('h.g', 'gap_hard')} from e join h on e.subject = h.subject""",
                                 "gap"))
def paired_subjects(trials):
    gaps = summaries.subject_gap(cons(trials))
    easy = gaps.where(F.col("gap_easy").isNotNull()).select("subject", r6("gap_easy", "gap_easy"))
    hard = gaps.where(F.col("gap_hard").isNotNull()).select("subject", r6("gap_hard", "gap_hard"))
    return summaries.paired_subjects(easy, hard)


@query("j4_broadcast_scalars", sql("""
select trial_id, (select min(EV_diff) from enr) as lo, (select max(EV_diff) from enr) as hi,
  (select count(*) from enr) as n from enr""", "enr"))
def broadcast_scalars(trials):
    rows = enrich.with_ev(trials)
    span = rows.agg(F.min("EV_diff").alias("lo"), F.max("EV_diff").alias("hi"),
                    F.count(F.lit(1)).alias("n"))
    return scalars.attach_scalars(rows.select("trial_id"), span)


def split_sql(seed: int) -> str:
    return f"""split as materialized (select trial_id, choice, case when rn <= floor(0.2::double * n + 0.5)
    then 'test' else 'train' end as split from (select trial_id, choice,
    row_number() over (partition by choice order by md5(trial_id || ':{seed}'), trial_id) as rn,
    count(*) over (partition by choice) as n from trials))"""


@query("j5_split_members", sql(f"""
with {split_sql(10)} select trial_id, choice, split from split where split = 'test'"""))
def split_members(trials):
    return sampling.split_members(
        sampling.stratified_split(trials.select("trial_id", "choice"), "choice"), "test")


@query("j5_members_of", sql(f"""
with {split_sql(10)} select t.trial_id, t.subject, t.choice from trials t
where t.trial_id not in (select trial_id from split where split = 'test')"""))
def members_of(trials):
    split = sampling.stratified_split(trials.select("trial_id", "choice"), "choice")
    return sampling.members_of(trials.select("trial_id", "subject", "choice"),
                               sampling.split_members(split, "test"), keep=False)
