"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmix.session import coarse_shuffles, discard, remove, scope, settled, stored, tune

BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """The run-time settings of this package."""
    tune(spark)
    coarse_shuffles(spark)
    # Texts may be long: a Python batch holds few rows, so its memory is bounded.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python batches of fewer rows, for jobs that run in this context and whose rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, under those settings."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has (names clash whatever their case)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


__all__ = ["BATCH_ROWS", "discard", "prepare", "remove", "rows_a_batch", "scope", "settled", "stored", "table", "text_or_empty", "unused_name"]
