"""Intermediate tables that several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def stage_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a cluster must set it.

    Only a local session, whose executors are the driver's own process, gets a folder of
    its own where none is set.
    """
    setting = "spark.checkpoint.dir"
    root = spark.conf.get(setting, None) or spark.sparkContext.getConf().get(setting, None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {setting} to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(setting, root)
    return root.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back.

    For a result that feeds several branches: each branch then scans only its
    columns instead of computing everything again, and a lost executor costs a file
    read instead of the whole lineage.
    """
    path = f"{stage_root(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Append columns that the optimizer must not copy into their later uses.

    A generator of one row is a barrier for projection and predicate merging. Meant
    for long texts that are measured, hashed and compared afterwards.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))
