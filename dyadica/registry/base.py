"""Registration of queries with their SQL counterparts, and the SQL building blocks."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import ITEMS, LEFT, RIGHT
from ..operators import enrich
from ..operators.ledger import Ledger
from ..session import shared_folder, tune
from ..sources.events import (
    EVENT_STEP_LEFT, EVENT_STEP_RIGHT, FIRST_MODULUS_LEFT, FIRST_MODULUS_RIGHT, USER_STEP_LEFT,
    USER_STEP_RIGHT, trials_from_tables,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(trials)`` under ``name``; it gets the canonical trials of a data folder."""
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(trials_from_tables(tune(spark), folder))
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def r6(col: Column | str, name: str | None = None) -> Column:
    """Six decimals, no negative zero."""
    col = F.col(col) if isinstance(col, str) else col
    rounded = F.round(col, 6) + F.lit(0.0)
    return rounded.alias(name) if name else rounded


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(c, c) if c in names else F.col(f"`{c}`") for c in df.columns])


def lab(trials: DataFrame) -> DataFrame:
    return enrich.enrich(trials.where(F.col("source") == "lab"))


def cons(trials: DataFrame) -> DataFrame:
    return enrich.enrich(trials.where(F.col("source") == "cons"))


def ledger(trials: DataFrame, run: str) -> Ledger:
    """Model scores of this application: queries that search the same rows for the same model share them."""
    spark = trials.sparkSession
    return Ledger(spark, f"{shared_folder(spark).rstrip('/')}/scores-{spark.sparkContext.applicationId}", run)


# --- SQL side ---------------------------------------------------------------

def q6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 as {name}"


def _item_sql(event: int, user: int, modulus: int, name: str) -> str:
    return (f"cast(10 + (event_id*{event} + user_id*{user} + (event_id*event_id)%{modulus}) % 41 "
            f"as double) as {name}")


_ITEMS_SQL = ", ".join(
    [_item_sql(EVENT_STEP_LEFT[i], USER_STEP_LEFT[i], FIRST_MODULUS_LEFT + 2 * i, LEFT[i])
     for i in range(ITEMS)]
    + [_item_sql(EVENT_STEP_RIGHT[i], USER_STEP_RIGHT[i], FIRST_MODULUS_RIGHT + 2 * i, RIGHT[i])
       for i in range(ITEMS)])
LS, RS = ", ".join(LEFT), ", ".join(RIGHT)
ITEM_NAMES = f"{LS}, {RS}"
_DS = ", ".join(f"{l} - {r}" for l, r in zip(LEFT, RIGHT))
_BALANCE = " + ".join(f"cast(sign({l} - {r}) as integer)" for l, r in zip(LEFT, RIGHT))

CTES = {
    "trials": f"""trials as (
  select trial_id, subject, source, {ITEM_NAMES}, confidence, is_diff_mean, flip,
    case when {' + '.join(LEFT)} - ({' + '.join(RIGHT)}) + noise > 0 then 1 else 0 end as choice
  from (select event_id as trial_id, user_id as subject,
      case when event_type in ('view','click') then 'lab'
           when event_type in ('purchase','signup') then 'cons' else 'framing' end as source,
      {_ITEMS_SQL},
      (event_id*7919 + user_id*1047) % 161 - 80 as noise,
      cast(1 + (event_id*13 + user_id*5) % 6 as int) as confidence,
      cast(event_id % 2 as int) as is_diff_mean, cast(user_id % 2 as int) as flip
    from events))""",
    "enr": f"""enr as materialized (
  select *, case when EV_left > EV_right then 1 else 0 end as normative_choice,
    case when choice = (case when EV_left > EV_right then 1 else 0 end) then 1 else 0 end as is_correct,
    -abs(EV_left - EV_right) as complexity_diff,
    round(-abs(EV_left - EV_right) + complexity_sd, 6) as complexity,
    EV_left - EV_right as EV_diff,
    greatest(EV_left, EV_right) - case when choice = 1 then EV_left else EV_right end as loss
  from (select *, list_avg(ls) as EV_left, list_avg(rs) as EV_right,
      list_aggregate(list_concat(ls, rs), 'stddev_samp') as complexity_sd,
      list_aggregate(ds, 'stddev_pop') as pair_diff_std, list_max(ds) as pair_diff_max,
      list_min(ds) as pair_diff_min, {_BALANCE} as pair_winner_balance,
      list_aggregate(ds, 'entropy') * ln(2) as pair_diff_entropy
    from (select *, [{LS}] as ls, [{RS}] as rs, [{_DS}] as ds from trials)))""",
    "lab": "lab as materialized (select * from enr where source = 'lab')",
    "cons": "cons as materialized (select * from enr where source = 'cons')",
    "st": f"""st as materialized (
  select trial_id, mean_left, mean_right, var_left, var_right, mean_left - mean_right as diff_mean,
    (var_left + var_right) / 2 as mean_var, var_left - var_right as diff_var,
    choice as response_left,
    case when mean_left > mean_right then choice when mean_right > mean_left then 1 - choice
         else 1 end as correct, 'data_' || source as source
  from (select *, list_avg([{LS}]) as mean_left, list_avg([{RS}]) as mean_right,
      list_aggregate([{LS}], 'var_samp') as var_left,
      list_aggregate([{RS}], 'var_samp') as var_right from trials))""",
    "dirty": """dirty as (
  select trial_id, case when trial_id % 7 = 0 then null else subject end as subject, source,
    case when trial_id % 97 = 0 then null else L1 end as L1,
    case when trial_id % 101 = 0 then 'n/a' else cast(L2 as varchar) end as L2_text,
    L3, R1, choice, case when trial_id % 89 = 0 then null else confidence end as confidence,
    cast(null as double) as empty_col, 1 - choice as leftCorrect from trials)""",
    "seg": """seg as materialized (
  select *, case when complexity <= (select median(complexity) from lab) then 'easy' else 'hard' end
    as segment from lab)""",
    "gap": """gap as materialized (
  select *, confidence_norm - is_correct as gap,
    case when complexity <= (select median(complexity) from cons) then 'easy' else 'hard' end as segment
  from (select *, case when hi > lo then (confidence - lo) / (hi - lo) else 0.5 end as confidence_norm
    from (select *, cast((select min(confidence) from cons) as double) as lo,
            cast((select max(confidence) from cons) as double) as hi from cons)))""",
}
_NEEDS = {"trials": [], "enr": ["trials"], "lab": ["enr"], "cons": ["enr"], "st": ["trials"],
          "dirty": ["trials"], "seg": ["lab"], "gap": ["cons"]}


def sql(body: str, *ctes: str) -> str:
    """``body`` behind the named building blocks and whatever they need.

    A body that brings its own leading CTEs starts with ``with``.
    """
    order: list[str] = []

    def need(name):
        for n in _NEEDS[name]:
            need(n)
        if name not in order:
            order.append(name)

    for c in ctes or ("trials",):
        need(c)
    head = "with " + ",\n".join(CTES[c] for c in order)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"{head},\n{body[5:]}"
    return f"{head}\n{body}"


def bins_sql(table: str, col: str, q: int, by: str | None = None) -> str:
    """CTEs ``edges`` and ``binned``: quantile bins with repeated edges dropped."""
    probs = ", ".join(repr(i / q) for i in range(q + 1))
    keys = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    match = f"t.{by} = e.{by}" if by else "true"
    return f"""edges as materialized (select distinct {keys}e from (
    select {keys}unnest(quantile_cont({col}, [{probs}]::double[])) as e from {table} {group})),
  binned as materialized (select t.*, b.bin from {table} t join (
    select t.trial_id, cast(greatest(1, count(*) filter (where e.e < t.{col})) as int) as bin
    from {table} t join edges e on {match} group by t.trial_id) b on t.trial_id = b.trial_id)"""


def t_two_sided_sql(t: str, df: str, steps: int = 20000) -> str:
    """Two-sided p of Student's t by Simpson's rule over [0, |t|] (scalar inputs only)."""
    return f"""(select greatest(0.0, 1 - 2 * sum(
      (case when i in (0, {steps}) then 1 when i % 2 = 1 then 4 else 2 end)
      * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0) - 0.5 * ln({df} * pi())
            - ({df} + 1) / 2.0 * ln(1 + pow(least(abs({t}), 60.0) * i / {steps}.0, 2) / {df})))
      * least(abs({t}), 60.0) / {steps}.0 / 3) from range({steps} + 1) g(i))"""
