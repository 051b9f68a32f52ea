"""Reproducible splits, folds, samples and inferred subjects.

Every label is a threshold on an ordering key, found by ``rank_cuts``; assigning it is
a comparison inside the scan, so no trial is shuffled or ranked for it.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import with_row_position
from .selection import hash_order, rank_cuts, sortable_id

SEED_MAIN, SEED_ADVANCED, SEED_CLUSTER = 10, 42, 42
TEST_SHARE, FOLDS = 0.2, 5


def stratified_split(df: DataFrame, y: str, test_share: float = TEST_SHARE, seed: int = SEED_MAIN,
                     id_col: str = "trial_id", name: str = "split") -> DataFrame:
    """Add ``split`` (test/train): the first share of each class in shuffled order is test."""
    key = hash_order(id_col, seed)
    cuts = rank_cuts(df, y, key, lambda n: [math.floor(test_share * n + 0.5)])
    label = F.lit("train")
    for g, (cut,) in cuts.items():
        label = F.when((F.col(y) == F.lit(g)) & (F.col("_key") <= F.lit(cut)), "test").otherwise(label)
    # the key is a column of its own step, so it is hashed once per row
    return (df.withColumn("_key", key)
            .withColumn(name, F.when(F.col(y).isNotNull(), label)).drop("_key"))


def _blocks(n: int, k: int) -> list[int]:
    """Row counts after which each of the first k-1 near-equal blocks ends."""
    size, extra = divmod(n, k)
    return [size * i + min(i, extra) for i in range(1, k)]


def _with_folds(df: DataFrame, y: str, key: Column, k: int, name: str,
                among: DataFrame | None = None) -> DataFrame:
    """Label each class's rows with the number of cuts their key lies beyond.

    The cuts are laid over ``among`` (by default all rows).
    """
    cuts = rank_cuts(df if among is None else among, y, key, lambda n: _blocks(n, k))
    per_class = [F.when(F.col(y) == F.lit(g), reduce(
        add, [F.when(F.col("_key") > F.lit(c), 1).otherwise(0) for c in found], F.lit(0)))
        for g, found in cuts.items()]
    fold = F.coalesce(*per_class) if per_class else F.lit(None).cast("int")
    return df.withColumn("_key", key).withColumn(name, fold).drop("_key")


def stratified_folds(df: DataFrame, y: str, k: int = FOLDS, seed: int = SEED_MAIN,
                     id_col: str = "trial_id", name: str = "fold") -> DataFrame:
    """Add a fold id 0..k-1: equal blocks of each class in shuffled order."""
    return _with_folds(df, y, hash_order(id_col, seed), k, name)


def train_folds(df: DataFrame, y: str, k: int = FOLDS, seed: int = SEED_MAIN, id_col: str = "trial_id",
                split: str = "split", name: str = "fold") -> DataFrame:
    """Stratified folds over the train rows of a split; every other row gets fold -1."""
    train = split_members(df, "train", split)
    folded = _with_folds(df, y, hash_order(id_col, seed), k, name, among=train)
    return folded.withColumn(name, F.when(F.col(split) == "train", F.col(name)).otherwise(-1))


def ordered_folds(df: DataFrame, y: str, source: str, sources: list[str], k: int = FOLDS,
                  id_col: str = "trial_id", name: str = "fold") -> DataFrame:
    """Add unshuffled folds: equal blocks of each class in stacked order (source, then row)."""
    rank = reduce(lambda c, iv: c.when(F.col(source) == iv[1], f"{iv[0]:x}"), enumerate(sources), F)
    key = F.concat(rank.otherwise("f"), sortable_id(F.col(id_col)))
    return _with_folds(df, y, key, k, name)


def infer_subject(df: DataFrame, per: int | None = None, id_col: str = "trial_id",
                  name: str = "subject", default_subjects: int = 33) -> DataFrame:
    """Subject = row position // trials per subject, rows in ``id_col`` order."""
    if per is None:
        per = max(1, df.count() // default_subjects)
    placed = with_row_position(df, [id_col], "_position")
    return placed.withColumn(name, F.expr(f"_position div {int(per)}")).drop("_position")


def sample_n(df: DataFrame, n: int, seed: int = SEED_CLUSTER, id_col: str = "trial_id") -> DataFrame:
    """A fixed-size sample without replacement: the first ``n`` rows in shuffled order.

    Sort plus limit plans as a per-partition top-n, not as a full sort.
    """
    return df.orderBy(hash_order(id_col, seed)).limit(n)


def split_members(df: DataFrame, split: str, col: str = "split") -> DataFrame:
    return df.where(F.col(col) == split)


def members_of(df: DataFrame, members: DataFrame, id_col: str = "trial_id", keep: bool = True) -> DataFrame:
    """Rows whose id is (or is not) in a stored membership table.

    Where both were stored with ``save_bucketed``, neither is shuffled.
    """
    return df.join(members.select(id_col), id_col, "left_semi" if keep else "left_anti")
