"""The three raw trial layouts: reading them and finding their columns by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import ITEMS, LEFT, RIGHT

# Layout name -> (tag in the statistics table, choice columns in order of preference).
LAYOUTS = {
    "lab": ("data_lab", ("sequenceChoiceLeft", "responseLeft")),
    "cons": ("data_cons", ("responseLeft",)),
    "framing": ("data_framing", ("responseLeft",)),
}
SOURCE_TAGS = {name: tag for name, (tag, _) in LAYOUTS.items()}

_INTEGERS = {"sequencechoiceleft", "responseleft", "leftcorrect", "flip", "confidence",
             "isdifferentmeansamevariance"}
_LONGS = {"subject", "trial_id"}


def strip_columns(df: DataFrame) -> DataFrame:
    """Trim blanks around the header names."""
    return df.toDF(*[c.strip() for c in df.columns])


# How the layouts spell their item columns, blanks left out. ``side`` tells left from right;
# a layout without it counts through both sides, left first.
_SPELLINGS = {
    "lab": (r"sequence(?P<side>Left|Right)_(?P<at>\d+)", r"sequence(?P<side>A|B)(?P<at>\d+)"),
    "cons": (r"sequence(?P<side>Left|Right)_(?P<at>\d+)",),
    "framing": (r"(?i:sequences?)_?(?P<at>\d+)",),
}


def _item_map(columns: list[str], spelling: str) -> dict[tuple[str, int], str]:
    """{(side, position): column} of the columns that the spelling fits."""
    found: dict[tuple[str, int], str] = {}
    for column in columns:
        match = re.fullmatch(spelling, "".join(column.split()))
        if not match:
            continue
        at, side = int(match["at"]), match.groupdict().get("side")
        if side is None:
            side, at = ("left", at) if at <= ITEMS else ("right", at - ITEMS)
        else:
            side = "left" if side in ("Left", "A") else "right"
        if (side, at) in found:
            raise ValueError(f"{column!r} and {found[side, at]!r} are both item {at} of the {side} side")
        found[side, at] = column
    return found


def resolve_sequences(columns: list[str], layout: str) -> tuple[list[str], list[str]]:
    """The eight left and eight right item columns of a layout, in position order.

    Exactly the positions 1 to 8 of both sides must be there; anything else is an error.
    """
    wanted = [(side, at) for side in ("left", "right") for at in range(1, ITEMS + 1)]
    maps = [_item_map(columns, spelling) for spelling in _SPELLINGS[layout]]
    for found in maps:
        if set(found) == set(wanted):
            names = [found[key] for key in wanted]
            return names[:ITEMS], names[ITEMS:]
    raise ValueError(f"{layout}: expected items 1 to {ITEMS} of both sides, found "
                     f"{[sorted(found) for found in maps if found]}")


def resolve_response(columns: list[str], layout: str) -> Column:
    """The human choice (1 = left) as an integer column."""
    for name in LAYOUTS[layout][1]:
        if name in columns:
            return F.col(f"`{name}`").cast("int")
    raise ValueError(f"{layout}: none of {LAYOUTS[layout][1]} present")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values are NULL everywhere downstream, never NaN."""
    floats = {f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[
        F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats
        else F.col(f"`{c}`") for c in df.columns])


def _column_type(name: str) -> T.DataType:
    key = name.strip().lower()
    if key in _LONGS:
        return T.LongType()
    if key in _INTEGERS:
        return T.IntegerType()
    return T.DoubleType() if "sequence" in key else T.StringType()


def read_trials(spark: SparkSession, path: str, layout: str, fmt: str = "csv") -> DataFrame:
    """One raw trial table. CSV gets an explicit schema made from its header names.

    Only the header line is looked at before the scan; there is no inference pass
    over the data, and a field that is not a number reads as NULL.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}")
    if fmt != "csv":
        return nan_to_null(spark.read.format(fmt).load(path))
    header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    # Whole numbers are read as doubles first: exports write them as 1.0 as soon as a value is missing.
    # Without enforceSchema a file whose header differs from the schema raises instead of being misread.
    kinds = {c: _column_type(c) for c in header}
    schema = T.StructType([T.StructField(c, T.DoubleType() if isinstance(k, (T.IntegerType, T.LongType)) else k)
                           for c, k in kinds.items()])
    raw = nan_to_null(spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path))
    return raw.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds.items()])


def add_trial_id(df: DataFrame) -> DataFrame:
    """Number the rows of file-backed trials in file order (path, then row).

    Rows are numbered inside a block of a file, as the scan splits it, and shifted by the rows of the blocks
    before, of which there is one line each.
    """
    located = df.select(
        "*", F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"))
    blocks = located.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_rows"))
    files = blocks.groupBy("_path").agg(F.sum("_rows").alias("_rows"))

    def earlier(window):
        return F.coalesce(F.sum("_rows").over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    files = files.select("_path", earlier(W.orderBy("_path")).alias("_files"))
    blocks = blocks.select("_path", "_block", earlier(W.partitionBy("_path").orderBy("_block")).alias("_before"))
    local = F.row_number().over(W.partitionBy("_path", "_block").orderBy("_row")) - 1
    return (located.withColumn("_local", local).join(blocks.join(files, "_path"), ["_path", "_block"])
            .withColumn("trial_id", F.col("_files") + F.col("_before") + F.col("_local"))
            .drop("_path", "_block", "_row", "_local", "_files", "_before"))


def canonical_trials(df: DataFrame, layout: str) -> DataFrame:
    """Rename a raw layout to ``L1..L8, R1..R8, choice``; other columns stay as they are."""
    left, right = resolve_sequences(df.columns, layout)
    items = dict(zip(left + right, LEFT + RIGHT))
    response = resolve_response(df.columns, layout)
    used = set(LAYOUTS[layout][1])
    rest = [F.col(f"`{c}`") for c in df.columns if c not in items and c not in used]
    return df.select(*rest, *[F.col(f"`{c}`").try_cast("double").alias(a) for c, a in items.items()],
                     response.alias("choice"))
