"""Dropping, parsing and filling missing values."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .selection import exact_medians


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Remove columns without a single value: one pass counting non-nulls."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if counts[i] == 0])


def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Remove rows with a null in any column (or in any column of ``subset``).

    Written as IS NOT NULL terms (missing numbers are NULL after ingest, never NaN):
    these are pushed to the scan and leave the columns known as not null above it.
    """
    return df.where(reduce(and_, [F.col(f"`{c}`").isNotNull() for c in subset or df.columns]))


def drop_null_rows_except(df: DataFrame, exempt: str) -> DataFrame:
    """Remove rows with a null anywhere but in ``exempt``."""
    return drop_null_rows(df, [c for c in df.columns if c != exempt])


def to_numeric(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Parse ``{column: new_name}`` as numbers; text that is not a number becomes null."""
    return df.withColumns({new: F.col(f"`{c}`").try_cast("double") for c, new in cols.items()})


def drop_leaky_label(df: DataFrame) -> DataFrame:
    """Remove the column that repeats the normative label, whatever its case."""
    return df.drop(*[c for c in df.columns if c.lower() == "leftcorrect"])


def clean(df: DataFrame) -> DataFrame:
    """The usual order: empty columns go first, then rows with any null."""
    return drop_null_rows(drop_all_null_columns(df))


def clean_confidence(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    """The order of the calibration analyses: empty columns go, then only rows without a confidence."""
    return drop_null_rows(drop_all_null_columns(df), [confidence])


def bounded(c: str) -> Column:
    """The column as a number, null where it is infinite or no number."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)   # false for +-inf and for NaN


def gap_counts(cols: list[str]) -> list[Column]:
    """Aggregates that ``gaps_in`` reads: all rows, and the usable values of every column.

    They can ride on an aggregate that is run anyway. (Not on an ``observe``: Spark's fitted models can't be sent to tasks
    any more once a session has observed anything.)
    """
    return [F.count(F.lit(1)).alias("_all"), *[F.count(bounded(c)).alias(f"_have_{i}") for i, c in enumerate(cols)]]


def gaps_in(seen: Row, cols: list[str]) -> list[str]:
    """The columns with anything to fill."""
    return [c for i, c in enumerate(cols) if seen[f"_have_{i}"] < seen["_all"]]


def impute_median(df: DataFrame, cols: list[str], seen: Row | None = None) -> DataFrame:
    """Infinities become null, nulls become the column's exact median over the whole table.

    Only columns that have anything to fill get a median and a replacement expression. ``seen`` are the
    ``gap_counts`` of the table, where another pass has them already; else one counting pass finds them.
    """
    seen = seen or df.agg(*gap_counts(cols)).first()
    gaps = gaps_in(seen, cols)
    finite = df.withColumns({c: bounded(c) if c in gaps else F.col(c).cast("double") for c in cols})
    if not gaps:
        return finite
    medians = exact_medians(finite, gaps)
    return finite.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items()
                               if m is not None})


def finite_filter(df: DataFrame, x: str, y: str) -> DataFrame:
    """Keep rows where both columns are finite numbers."""
    limit = F.lit(float("inf"))
    return df.where((F.abs(F.col(x).cast("double")) < limit) & (F.abs(F.col(y).cast("double")) < limit))
