"""Reading, writing and cleaning (inventory A and B)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import LEFT, RIGHT
from ..operators import cleaning, enrich, summaries
from ..operators.binning import split_easy_hard
from ..session import scratch_path
from ..sources import events, layouts, sinks
from .base import ITEM_NAMES, lab, q6, query, r6, rounded, sql

_ITEMS = [*LEFT, *RIGHT]
_LAYOUTS = list(layouts.LAYOUTS)
_PAIR_SQL = ", ".join([q6("pair_diff_std", "pair_diff_std"), "pair_diff_max", "pair_diff_min",
                       "pair_winner_balance", q6("pair_diff_entropy", "pair_diff_entropy")])
_PAIR_DOUBLE_SQL = _PAIR_SQL.replace(
    "pair_winner_balance", "cast(pair_winner_balance as double) as pair_winner_balance")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _per_layout(trials: DataFrame, make) -> DataFrame:
    return _union([make(events.raw_layout(trials, name), name) for name in _LAYOUTS])


@query("a1_read_trials", sql(f"select trial_id, source, {ITEM_NAMES}, choice from trials"))
def read_trials(trials):
    spark = trials.sparkSession
    parts = []
    for name in _LAYOUTS:
        path = scratch_path(spark, f"raw-{name}")
        sinks.write_trials(events.raw_layout(trials, name), path, "csv")
        raw = layouts.canonical_trials(layouts.read_trials(spark, path, name), name)
        parts.append(raw.select("trial_id", F.lit(name).alias("source"), *_ITEMS, "choice"))
    return _union(parts)


@query("a2_strip_columns", sql(
    'select trial_id, L1 as "sequences_ 1", R1 as "sequences_ 9", choice as "responseLeft" '
    "from trials where source = 'framing'"))
def strip_columns(trials):
    padded = events.raw_layout(trials, "framing").select(
        "trial_id", F.col("sequences_ 1").alias(" sequences_ 1 "),
        F.col("sequences_ 9").alias("sequences_ 9  "), F.col("responseLeft").alias(" responseLeft"))
    return layouts.strip_columns(padded)


@query("a3_resolve_sequences", sql(f"select trial_id, source, {ITEM_NAMES} from trials"))
def resolve_sequences(trials):
    def pick(raw, name):
        left, right = layouts.resolve_sequences(raw.columns, name)
        return raw.select("trial_id", F.lit(name).alias("source"),
                          *[F.col(f"`{c}`").alias(a) for c, a in zip(left + right, _ITEMS)])
    return _per_layout(trials, pick)


@query("a4_resolve_response", sql("select trial_id, source, choice from trials"))
def resolve_response(trials):
    return _per_layout(trials, lambda raw, name: raw.select(
        "trial_id", F.lit(name).alias("source"),
        layouts.resolve_response(raw.columns, name).alias("choice")))


@query("a5_write_trials", sql(
    f"select trial_id, source, EV_diff, is_correct, complexity, {_PAIR_SQL} from enr", "enr"))
def write_trials(trials):
    path = scratch_path(trials.sparkSession, "enriched")
    sinks.write_trials(enrich.enrich(trials), path, by="source")
    back = trials.sparkSession.read.parquet(path)
    return back.select("trial_id", "source", "EV_diff", "is_correct", r6("complexity", "complexity"),
                       r6("pair_diff_std", "pair_diff_std"), "pair_diff_max", "pair_diff_min",
                       "pair_winner_balance", r6("pair_diff_entropy", "pair_diff_entropy"))


_UNIFIED_SQL = f"""select {{key}}case when source = 'cons' then null else subject end as subject,
  {ITEM_NAMES}, choice as human_choice, normative_choice, EV_left, EV_right, EV_diff, complexity,
  is_correct, source as dataset_source, {_PAIR_SQL} from enr"""
_ROUNDED_PAIRS = ("complexity", "pair_diff_std", "pair_diff_entropy")


@query("a6_write_unified", sql(_UNIFIED_SQL.format(key=""), "enr"))
def write_unified(trials):
    path = scratch_path(trials.sparkSession, "unified")
    sinks.write_unified(enrich.unified_trials(trials), path)
    return rounded(trials.sparkSession.read.parquet(path), *_ROUNDED_PAIRS)


_STATS = sinks.STAT_COLUMNS
_STAT_VALUES = [c for c in _STATS if c not in ("response_left", "correct", "source")]
_STATS_SQL = (", ".join(q6(c, c) for c in _STAT_VALUES) + ", response_left, correct, source")


@query("a7_write_stats", sql(f"select {_STATS_SQL} from st", "st"))
def write_stats(trials):
    path = scratch_path(trials.sparkSession, "stats")
    sinks.write_stats(enrich.unified_stats(trials), path)
    return rounded(trials.sparkSession.read.parquet(path), *_STAT_VALUES)


@query("a8_write_report", sql("""
with s as (select source, cast(count(*) as double) as n, avg(response_left) as p_choose_left,
  avg(correct) as accuracy, avg(diff_mean) as mean_diff_mean, avg(mean_var) as mean_mean_var
  from st group by source)
select source, metric, round(value, 6) + 0.0 as value from (
  select source, 'n' as metric, n as value from s
  union all select source, 'p_choose_left', p_choose_left from s
  union all select source, 'accuracy', accuracy from s
  union all select source, 'mean_diff_mean', mean_diff_mean from s
  union all select source, 'mean_mean_var', mean_mean_var from s)""", "st"))
def write_report(trials):
    summary = summaries.summary_by_source(enrich.unified_stats(trials))
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
             for c in summary.columns if c != "source"]
    path = scratch_path(trials.sparkSession, "report")
    sinks.write_report(summary.select("source", F.inline(F.array(*cells))), path)
    back = trials.sparkSession.read.schema("source string, metric string, value double").json(path)
    return rounded(back, "value")


def corr_sql() -> str:
    cols = summaries.CORRELATION_COLUMNS
    return " union all ".join(
        f"select '{a}' as feature_a, '{b}' as feature_b, {q6(f'corr({a}, {b})', 'r')} from enr"
        for a in cols for b in cols)


@query("a9_write_corr", sql(corr_sql(), "enr"))
def write_corr(trials):
    path = scratch_path(trials.sparkSession, "corr")
    sinks.write_corr(summaries.correlation_matrix(enrich.enrich(trials)), path)
    back = (trials.sparkSession.read.schema("feature_a string, feature_b string, r double")
            .option("header", True).csv(path))
    return rounded(back, "r")


# --- cleaning ----------------------------------------------------------------

_DIRTY = "trial_id, subject, source, L1, L2_text, L3, R1, choice, confidence, leftCorrect"


def _dirty(trials):
    # the text of a double differs between engines, so the text column holds a whole number
    return events.dirty_trials(trials)


@query("b1_drop_all_null_columns", sql(f"select {_DIRTY} from dirty", "dirty"))
def drop_all_null_columns(trials):
    return cleaning.drop_all_null_columns(_dirty(trials))


@query("b2_drop_null_rows", sql(
    f"select {_DIRTY} from dirty where subject is not null and L1 is not null "
    "and confidence is not null", "dirty"))
def drop_null_rows(trials):
    return cleaning.clean(_dirty(trials))


@query("b3_drop_null_rows_subset", sql(
    f"select {_DIRTY}, empty_col from dirty where confidence is not null", "dirty"))
def drop_null_rows_subset(trials):
    return cleaning.drop_null_rows(_dirty(trials), ["confidence"])


@query("b3_drop_null_rows_except_subject", sql(
    f"select {_DIRTY} from dirty where L1 is not null and confidence is not null", "dirty"))
def drop_null_rows_except_subject(trials):
    return cleaning.drop_null_rows_except(cleaning.drop_all_null_columns(_dirty(trials)), "subject")


@query("b4_to_numeric", sql("select trial_id, try_cast(L2_text as double) as L2 from dirty", "dirty"))
def to_numeric(trials):
    return cleaning.to_numeric(_dirty(trials), {"L2_text": "L2"}).select("trial_id", "L2")


@query("b5_drop_leaky_label", sql(
    "select trial_id, subject, source, L1, L2_text, L3, R1, choice, confidence, empty_col from dirty",
    "dirty"))
def drop_leaky_label(trials):
    return cleaning.drop_leaky_label(_dirty(trials))


@query("b6_impute_median", sql("""
with x as (select trial_id, L1, try_cast(L2_text as double) as L2,
    case when trial_id % 103 = 0 then null else L3 end as L3, cast(confidence as double) as confidence
  from dirty)
select trial_id, coalesce(L1, (select median(L1) from x)) as L1, coalesce(L2, (select median(L2) from x)) as L2,
  coalesce(L3, (select median(L3) from x)) as L3,
  coalesce(confidence, (select median(confidence) from x)) as confidence from x""", "dirty"))
def impute_median(trials):
    dirty = cleaning.to_numeric(_dirty(trials), {"L2_text": "L2"})
    infinite = F.when(F.col("trial_id") % 206 == 0, float("inf")).when(
        F.col("trial_id") % 103 == 0, float("-inf")).otherwise(F.col("L3"))
    table = dirty.select("trial_id", "L1", "L2", infinite.alias("L3"), "confidence")
    return cleaning.impute_median(table, ["L1", "L2", "L3", "confidence"])


def _features_sql(source: str, extra: str = "") -> str:
    where = f"where source = '{source}'" if source else ""
    return sql(f"select trial_id, {ITEM_NAMES}, EV_diff, complexity, {_PAIR_DOUBLE_SQL}{extra} "
               f"from enr {where}", "enr")


def _features(trials, layout):
    rows = enrich.enrich(trials.where(F.col("source") == layout))
    return rounded(enrich.features(rows, layout, ["trial_id"])[0], *_ROUNDED_PAIRS)


@query("b7_features_lab", _features_sql("lab", ", cast(is_diff_mean as double) as is_diff_mean"))
def features_lab(trials):
    return _features(trials, "lab")


@query("b7_features_cons", _features_sql("cons", ", cast(flip as double) as flip"))
def features_cons(trials):
    return _features(trials, "cons")


@query("b7_features_framing", _features_sql("framing"))
def features_framing(trials):
    return _features(trials, "framing")


_HOT_SQL = ", ".join(f"case when source = '{s}' then 1.0::double else 0.0::double end as src_{s}"
                     for s in ("cons", "framing", "lab"))


@query("b7_features_unified", _features_sql("", ", " + _HOT_SQL))
def features_unified(trials):
    return rounded(enrich.features_unified(enrich.unified_trials(trials), ["trial_id"])[0], *_ROUNDED_PAIRS)


@query("b8_one_hot_source", sql(f"select trial_id, {_HOT_SQL} from trials"))
def one_hot_source(trials):
    return enrich.one_hot_source(trials.select("trial_id", "source"), "source").drop("source")


@query("b9_to_unified", sql("""
select trial_id, case when trial_id % 13 = 0 then null else subject end as subject,
  L1, R8, choice as human_choice, normative_choice, EV_left, EV_right, EV_diff, complexity, is_correct,
  source as dataset_source, pair_winner_balance from lab""", "lab"))
def to_unified(trials):
    text = F.when(F.col("trial_id") % 13 == 0, "unknown").otherwise(F.col("subject").cast("string"))
    block = enrich.to_unified(lab(trials).withColumn("subject", text), "lab")
    return block.select("trial_id", "subject", "L1", "R8", "human_choice", "normative_choice", "EV_left",
                        "EV_right", "EV_diff", r6("complexity", "complexity"), "is_correct",
                        "dataset_source", "pair_winner_balance")


@query("b10_finite_filter", sql("""
with x as (select trial_id, choice, case when trial_id % 50 = 0 then 'infinity'::double
    when trial_id % 53 = 0 then 'nan'::double when trial_id % 59 = 0 then null else EV_diff end as x from enr)
select trial_id, x, choice from x where isfinite(x)""", "enr"))
def finite_filter(trials):
    trial = F.col("trial_id")
    x = (F.when(trial % 50 == 0, float("inf")).when(trial % 53 == 0, float("nan"))
         .when(trial % 59 == 0, None).otherwise(F.col("EV_diff")))
    return cleaning.finite_filter(enrich.with_ev(trials).select("trial_id", x.alias("x"), "choice"),
                                  "x", "choice")


@query("b11_split_easy_hard", sql("select trial_id, complexity, segment from seg", "seg"))
def easy_hard(trials):
    return split_easy_hard(lab(trials)).select("trial_id", r6("complexity", "complexity"), "segment")


@query("b12_economic_loss", sql("select trial_id, loss as economic_loss from enr", "enr"))
def economic_loss(trials):
    rows = enrich.with_ev(trials)
    return rows.select("trial_id", enrich.economic_loss(rows).alias("economic_loss"))


@query("b13_minimum_size_guards", sql(f"""
select subject, segment, count(*) as n,
  case when count(*) >= 20 then {q6('avg(choice)', '').removesuffix(' as ')} end as choice_mean
from seg group by subject, segment""", "seg"))
def minimum_size_guards(trials):
    rows = split_easy_hard(lab(trials))
    return summaries.guard_min_rows(rows, ["subject", "segment"], 20, choice_mean=r6(F.avg("choice")))


