"""Exact duplicates by a tree-merge of sorted digest runs.

Every row falls into one of ``runs`` runs by a hash of its id, never of its text, so a text that fills a
third of the table is spread over all runs. A run holds each digest once with its smallest id and count.
In every round the runs ``fan_in * k .. fan_in * k + fan_in - 1`` merge into run ``k`` (with a fan-in of
two to the power of j, j binomial rounds at once) until one run is left. A run is never one task: Spark
slices it by digest. Then the answers for repeated texts walk the same tree back down to the rows.

The digest is SHA-256 of the normalised text. At every level rows merge only where the byte length and a
second, independent hash agree as well, so a smallest id is only kept for a verified group.

Defined results: a null text counts as empty; of null ids none is smallest unless the group has no other;
rows that repeat an id and its text share their group's answer (all of them are kept if the id is, though
``drop_exact_duplicates`` keeps one row of a group, by a row key); rows
that repeat an id with another text are judged by their text; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, free_name, pinned, table, written

_KEY = ["_digest", "_bytes", "_check"]


def normalised(text: Column) -> Column:
    """White-space runs become one space. A lone space is left alone, which the pattern skips."""
    pattern = f"[\\x09-\\x0D][{SPACE}]*|\\x20[{SPACE}]+"
    return F.regexp_replace(F.coalesce(text, F.lit("")), pattern, " ")


def _digests(docs: DataFrame, id_col: str, text_col: str, runs: int, row_col: str | None) -> DataFrame:
    row = F.col(f"`{row_col}`") if row_col else F.lit(None).cast("long")
    text = docs.select(F.col(f"`{id_col}`").alias("_id"), row.alias("_row"), normalised(F.col(f"`{text_col}`")).alias("_text"))
    return text.select(
        "_id", "_row", F.pmod(F.xxhash64("_id"), F.lit(runs)).alias("_run"),
        F.unhex(F.sha2("_text", 256)).alias("_digest"),
        F.octet_length("_text").alias("_bytes"), F.xxhash64("_text").alias("_check"))


def _members(docs: DataFrame, id_col: str, text_col: str, fan_in: int = 8, rounds: int = 2, row_col: str | None = None) -> DataFrame:
    """One row per input row: _id, _row, the digest columns, and _keep and _n, null for a text that is there once."""
    runs = fan_in ** rounds
    rows = pinned(_digests(docs, id_col, text_col, runs, row_col))
    level = rows.groupBy("_run", *_KEY).agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    levels = [pinned(level.sortWithinPartitions("_run", "_digest"))]
    for _ in range(rounds):
        level = (levels[-1].groupBy((F.col("_run") / fan_in).cast("long").alias("_run"), *_KEY)
                 .agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n")))
        levels.append(pinned(level.sortWithinPartitions("_run", "_digest")))
    answer = levels.pop().where("_n > 1")
    while levels:
        below = (levels.pop().select(F.col("_run").alias("_at"), *_KEY)
                 .withColumn("_run", (F.col("_at") / fan_in).cast("long")))
        answer = (below.join(answer, ["_run", *_KEY])
                  .select(F.col("_at").alias("_run"), *_KEY, "_keep", "_n"))
    return rows.join(answer, ["_run", *_KEY], "left")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 fan_in: int = 8, rounds: int = 2) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (see the module)."""
    found = _members(docs, id_col, text_col, fan_in, rounds)
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return found.select(
        F.col("_id").alias(id_col), keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each text, one with the smallest id, with its own columns only.

    Rows are told apart by a key that is written with them, so ids may repeat or be null.
    """
    key = free_name(docs, "exact_row")
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "exact-rows")
    stay = (_members(rows, id_col, text_col, row_col=key).where("_n is null or _id <=> _keep")
            .groupBy(*_KEY).agg(F.min("_row").alias("stay")))
    return rows.join(stay, rows[key] == stay["stay"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"))


OP1_SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
           from documents),
  g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256
from d join g using (text_sha256)"""
