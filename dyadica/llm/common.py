"""Reading tables, materialising steps and small expressions shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import release_shuffles, scratch_path, use_checkpoints  # noqa: F401

#: ASCII white space as the corpus contracts define it: space and the codes 9 to 13.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there.

    The files survive lost executors, the lineage ends there, and a second reader does not
    compute the rows again. Meant for narrow tables.
    """
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared folder; meant for wide rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def word_count(text: Column) -> Column:
    """Runs of anything but white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def id_digest(column: Column) -> Column:
    """A hex string that looks random but depends on the id alone; null for null."""
    return F.md5(column.cast("string"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
