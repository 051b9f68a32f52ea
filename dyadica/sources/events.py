"""Trials derived from an ``events`` table: one event is one trial."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import ITEMS, LEFT, RIGHT

# Fixed values of the derivation, one entry per item position.
EVENT_STEP_LEFT = [7, 11, 13, 17, 19, 23, 29, 31]
USER_STEP_LEFT = [67, 61, 59, 53, 47, 43, 41, 37]
EVENT_STEP_RIGHT = [37, 41, 43, 47, 53, 59, 61, 67]
USER_STEP_RIGHT = [31, 29, 23, 19, 17, 13, 11, 7]
FIRST_MODULUS_LEFT, FIRST_MODULUS_RIGHT = 101, 117


def _item(event_step: int, user_step: int, modulus: int) -> str:
    # squaring the remainder instead of the id gives the same value and cannot overflow
    square = f"((event_id % {modulus}) * (event_id % {modulus})) % {modulus}"
    value = f"10 + (event_id * {event_step} + user_id * {user_step} + {square}) % 41"
    # ids are present here, so the 0 is never taken; it tells the planner items are not null,
    # which takes the null checks out of all the code generated over them
    return f"coalesce(double({value}), 0D)"


_LEFT_ITEMS = [f"{_item(EVENT_STEP_LEFT[i], USER_STEP_LEFT[i], FIRST_MODULUS_LEFT + 2 * i)} as {LEFT[i]}"
               for i in range(ITEMS)]
_RIGHT_ITEMS = [f"{_item(EVENT_STEP_RIGHT[i], USER_STEP_RIGHT[i], FIRST_MODULUS_RIGHT + 2 * i)} as {RIGHT[i]}"
                for i in range(ITEMS)]


def trials_from_events(events: DataFrame) -> DataFrame:
    """Narrow projection of three event columns into canonical trials.

    An event without id or user identifies no trial.
    """
    base = events.where("event_id is not null and user_id is not null").selectExpr(
        "event_id as trial_id", "user_id as subject",
        "case when event_type in ('view', 'click') then 'lab' "
        "when event_type in ('purchase', 'signup') then 'cons' else 'framing' end as source",
        *_LEFT_ITEMS, *_RIGHT_ITEMS,
        "int(1 + (event_id * 13 + user_id * 5) % 6) as confidence",
        "int(event_id % 2) as is_diff_mean", "int(user_id % 2) as flip",
        "(event_id * 7919 + user_id * 1047) % 161 - 80 as _noise")
    evidence = f"{' + '.join(LEFT)} - ({' + '.join(RIGHT)}) + _noise"
    return base.withColumn("choice", F.expr(f"if({evidence} > 0, 1, 0)")).drop("_noise")


def trials_from_tables(spark: SparkSession, folder: str) -> DataFrame:
    return trials_from_events(spark.read.parquet(f"{folder}/events.parquet"))


def raw_layout(trials: DataFrame, layout: str) -> DataFrame:
    """The trials of one source under that layout's own column names."""
    rows = trials.where(F.col("source") == layout)
    if layout == "lab":
        names = [f"sequenceA{i}" for i in range(1, ITEMS + 1)] + \
                [f"sequenceB{i}" for i in range(1, ITEMS + 1)]
        extra = [F.col("choice").alias("sequenceChoiceLeft"),
                 F.col("is_diff_mean").alias("isDifferentMeanSameVariance"), F.col("subject")]
    elif layout == "cons":
        names = [f"sequenceLeft_{i}" for i in range(1, ITEMS + 1)] + \
                [f"sequenceRight_{i}" for i in range(1, ITEMS + 1)]
        extra = [F.col("choice").alias("responseLeft"), F.col("confidence"), F.col("flip"),
                 (1 - F.col("choice")).alias("leftCorrect")]
    elif layout == "framing":
        names = [f"sequences_ {i}" for i in range(1, 2 * ITEMS + 1)]
        extra = [F.col("choice").alias("responseLeft"), F.col("subject")]
    else:
        raise ValueError(f"unknown layout {layout!r}")
    items = [F.col(c).alias(n) for c, n in zip(LEFT + RIGHT, names)]
    return rows.select("trial_id", *items, *extra)


def dirty_trials(trials: DataFrame) -> DataFrame:
    """A variant with missing values, text in a number column, an empty and a leaky column."""
    trial = F.col("trial_id")
    return trials.select(
        trial, F.when(trial % 7 != 0, F.col("subject")).alias("subject"), "source",
        F.when(trial % 97 != 0, F.col("L1")).alias("L1"),
        F.when(trial % 101 == 0, "n/a").otherwise(F.col("L2").cast("string")).alias("L2_text"),
        "L3", "R1", "choice",
        F.when(trial % 89 != 0, F.col("confidence")).alias("confidence"),
        F.lit(None).cast("double").alias("empty_col"),
        (1 - F.col("choice")).alias("leftCorrect"))
