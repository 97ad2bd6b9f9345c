"""Tables of sampler draws, one partition per iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sink_draws(draws: DataFrame, path: str) -> None:
    """Write the iterations in ``draws``; running it again replaces those only.

    Rows are rebalanced by iteration when their size is known: a large iteration becomes
    several files of the advisory partition size, small ones one file each.
    """
    (draws.hint("rebalance", F.col("iter")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy("iter").parquet(path))


def scan_draws(spark: SparkSession, path: str, first: int | None = None,
               last: int | None = None) -> DataFrame:
    """Read draws back; the bounds prune iteration partitions."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col("iter") >= first)
    if last is not None:
        df = df.where(F.col("iter") <= last)
    return df


def filter_iteration(state: DataFrame, s: int) -> DataFrame:
    return state.where(F.col("iter") == s)


def union_all_iterations(*tables: DataFrame) -> DataFrame:
    """History with new iterations appended, each row once."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out
