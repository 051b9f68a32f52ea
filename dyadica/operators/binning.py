"""Median splits and quantile bins, and the tables made from them."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scalars import confidence_norm
from .selection import exact_medians, exact_quantiles, quantile_table


def exact_median(df: DataFrame, col: str, approx: bool = False) -> float | None:
    """Interpolated median; ``approx`` takes the one-pass sketch instead."""
    if approx:
        return df.agg(F.percentile_approx(col, F.lit(0.5), F.lit(10_000))).first()[0]
    return exact_medians(df, [col])[col]


def split_easy_hard(df: DataFrame, col: str = "complexity", name: str = "segment") -> DataFrame:
    """Label rows ``easy`` (at or under the median) or ``hard``."""
    median = F.lit(exact_median(df, col)).cast("double")
    return df.withColumn(name, F.when(F.col(col) <= median, "easy").when(F.col(col) > median, "hard"))


def _bin_of(x: Column, edges: list[float]) -> Column:
    """Right-closed bin number as a sum of comparisons with literal edges (stays in codegen)."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    inner = [F.when(x > F.lit(e), 1).otherwise(0) for e in edges[1:-1]]
    return F.when(x.isNotNull(), reduce(add, inner, F.lit(1)))


def quantile_edges(df: DataFrame, col: str, q: int) -> list[float]:
    """Distinct quantile edges of a column."""
    found = exact_quantiles(df, {col: [i / q for i in range(q + 1)]})[None][col]
    return sorted({e for e in found if e is not None})


def quantile_bin(df: DataFrame, col: str, q: int, by: str | None = None,
                 bounds: bool = False) -> DataFrame:
    """Add ``bin`` (1-based; null when the column is constant), with ``lo``/``hi`` if asked.

    Repeated edges are dropped, so there may be fewer than ``q`` bins. Without ``by`` the edges are literals;
    with it they are a table joined by group, so the plan does not grow with the groups.
    """
    x = F.col(col)
    if by is None:
        edges = quantile_edges(df, col, q)
        out = df.withColumn("_edges", F.array(*map(F.lit, edges)).cast("array<double>")).withColumn("bin", _bin_of(x, edges))
    else:
        table = quantile_table(df, col, [i / q for i in range(q + 1)], by).select(
            F.col(by).alias("_by"), F.array_sort(F.array_distinct(F.filter("q", lambda e: e.isNotNull()))).alias("_edges"))
        inner = F.filter(F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0))), lambda e: e < x)
        out = df.join(table, F.col(by).eqNullSafe(F.col("_by")), "left").withColumn(
            "bin", F.when(x.isNotNull() & F.col(by).isNotNull() & (F.size("_edges") > 1), F.size(inner) + 1)).select(*df.columns, "_edges", "bin")
    if bounds:
        out = out.withColumns({"lo": F.get("_edges", F.col("bin") - 1), "hi": F.get("_edges", F.col("bin"))})
    return out.drop("_edges")


def _by_bin(df: DataFrame, col: str, q: int, **aggregates: Column) -> DataFrame:
    # counting the bin leaves 0 for rows without one; a filter on `bin` itself would be pushed
    # below the projection and repeat the whole expression behind it
    return (quantile_bin(df, col, q).groupBy("bin")
            .agg(F.count("bin").alias("n"), *[c.alias(n) for n, c in aggregates.items()])
            .where(F.col("n") > 0))


def accuracy_by_complexity(enriched: DataFrame, q: int = 10) -> DataFrame:
    return _by_bin(enriched, "complexity", q, accuracy=F.avg("is_correct"),
                   complexity_mean=F.avg("complexity"))


def loss_by_complexity(enriched: DataFrame, loss: Column, q: int = 10) -> DataFrame:
    return _by_bin(enriched, "complexity", q, loss_mean=F.avg(loss),
                   complexity_mean=F.avg("complexity"))


def choice_by_evidence(enriched: DataFrame, q: int = 10, min_rows: int = 20,
                       choice: str = "choice") -> DataFrame:
    """Mean choice per evidence bin in easy and hard trials; small segments are left out."""
    table = (quantile_bin(split_easy_hard(enriched), "EV_diff", q, by="segment")
             .groupBy("segment", "bin")
             .agg(F.count("bin").alias("n"), F.avg(choice).alias("choice_mean"),
                  F.avg("EV_diff").alias("EV_diff_mean"))
             .where(F.col("n") > 0))
    rows = F.sum("n").over(W.partitionBy("segment"))        # over at most q rows a segment
    return table.withColumn("_rows", rows).where(F.col("_rows") >= min_rows).drop("_rows")


def calibration_by_complexity(enriched: DataFrame, q: int = 5) -> DataFrame:
    """Accuracy and normalised confidence per complexity bin, over rows with a confidence."""
    scored = confidence_norm(enriched.where(F.col("confidence").isNotNull()))
    return _by_bin(scored, "complexity", q, accuracy=F.avg("is_correct"),
                   confidence=F.avg("confidence_norm"), complexity_mean=F.avg("complexity"))
