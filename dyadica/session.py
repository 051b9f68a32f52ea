"""Session settings and the shared folder used for checkpoints and written tables."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import SparkSession


# Runtime settings the jobs count on. HotSpot never compiles a method over 8000 bytes of
# bytecode, so a fused stage above that would run interpreted, 10 times slower; under this
# limit Spark then generates it as many small methods instead.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "dyadica", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for.

    On a cluster the submitter's configuration wins: master, memory and
    ``spark.checkpoint.dir`` are only set here when the caller asks for it.
    """
    builder = SparkSession.builder.appName(app)
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable without overriding the cluster's choice."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(os.path.join(shared_folder(spark), "checkpoints"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; no two calls get the same one."""
    return os.path.join(shared_folder(spark), "scratch", f"{name}-{uuid.uuid4().hex}")


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans nobody refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
