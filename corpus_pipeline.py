"""Documents to packed training sequences: five stages, each on all that the one before kept.

Toxic documents go, of equal texts the smallest id stays, of each SimHash group one document stays, the
rest is mixed to the target weights of its sources, and the mix is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadica.llm.common import written
from dyadica.llm.exact import drop_exact_duplicates
from dyadica.llm.mixing import mixed_documents
from dyadica.llm.packing import pack
from dyadica.llm.simhash import drop_near_duplicates
from dyadica.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; labels of the folder teach the lexicon."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents; a document that is taken twice is two rows, one taken in part is cut."""
    mixed = mixed_documents(docs)
    if "n_chars" in mixed.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return mixed


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup),
          ("mixing", mixing), ("packing", packing)]
#: Packing depends on the order of rows in files, which SQL cannot express; the operators have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
