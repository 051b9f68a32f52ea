"""Z-scores with population deviations, fitted on one DataFrame and applied to others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Standardizer:
    mean: dict[str, float]
    sd: dict[str, float]

    def apply(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Replace (or, with a suffix, add) scaled columns; a constant column becomes 0."""
        return df.withColumns({
            c + suffix: (F.col(c) - F.lit(m)) / F.lit(self.sd[c]) if self.sd[c]
            else F.when(F.col(c).isNotNull(), 0.0)
            for c, m in self.mean.items()})


def standardize(train: DataFrame, cols: list[str]) -> Standardizer:
    """Fit on ``train`` with one aggregate over all columns."""
    row = train.agg(*[e for c in cols for e in (
        F.avg(c).alias(f"m:{c}"), F.stddev_pop(c).alias(f"s:{c}"))]).first()
    return Standardizer({c: row[f"m:{c}"] for c in cols}, {c: row[f"s:{c}"] for c in cols})
