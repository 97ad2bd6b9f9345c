"""Reading tables and small local inputs, handing results to the client."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class NoDataError(ValueError):
    """Raised when a report is asked for a selection that holds no rows."""


def hier_schema(n_drivers: int = 13) -> T.StructType:
    """Schema of the hierarchy fact file: keys, week, y1 and x1..xN by position."""
    return T.StructType(
        [
            T.StructField("index", T.LongType()),
            T.StructField("h1", T.StringType()),
            T.StructField("h2", T.StringType()),
            T.StructField("week", T.DateType()),
            T.StructField("y1", T.DoubleType()),
        ]
        + [T.StructField(f"x{i}", T.DoubleType()) for i in range(1, n_drivers + 1)]
    )


def scan_hier_csv(spark: SparkSession, path: str, n_drivers: int = 13,
                  header: bool = True) -> DataFrame:
    """Comma-separated hierarchy facts; fields split by the CSV reader, quotes dropped.

    ``enforceSchema`` stays on because the first header name of such files is empty,
    so names are taken by position.
    """
    return (
        spark.read.schema(hier_schema(n_drivers))
        .option("header", header)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def scan_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A catalog table by name, or a parquet table by path."""
    if "/" in name_or_path or name_or_path.endswith(".parquet"):
        return spark.read.parquet(name_or_path)
    return spark.table(name_or_path)


def load_local_rows(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """Ship planner-entered rows from the driver to Spark; facts never take this way."""
    return spark.createDataFrame(list(rows), schema)


def fetch_rows(df: DataFrame, n: int | None = None) -> DataFrame:
    """The first ``n`` rows, or everything for ``n=None``; the caller runs the action."""
    return df if n is None else df.limit(n)


def guard_nonempty(df: DataFrame, what: str = "data") -> DataFrame:
    """Return ``df`` unchanged, or say that the selection has no rows."""
    if df.isEmpty():
        raise NoDataError(f"No {what} available for the selected product and period")
    return df
