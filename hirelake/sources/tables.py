"""Readers of the project's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder; parquet pruning and pushdown stay with Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_small(df: DataFrame, max_bytes: int = 8 << 20) -> DataFrame:
    """``df`` with a broadcast hint when the optimizer's own size estimate proves it small.

    Beyond ``max_bytes`` the hint is left out, and the join falls back to a shuffle.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= max_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as cores, for much work on few or unsplittable files.

    A scan that already has enough partitions, as any large table has, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
