"""From row-level parts to period totals, shares and chart rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_code, period_label
from .scoring import PARTS, PRODUCT, SEASON_PARTS

PERIOD_COLUMN = {"all": [], "quarter": ["quarter"], "month": ["fiscal_month"]}
CHART_PARTS = ["base_sales", "decomp_seasonality", "decomp_promo", "decomp_redline"]


def period_keys(period: str) -> list[str]:
    if period not in PERIOD_COLUMN:
        raise ValueError(f"period must be one of {sorted(PERIOD_COLUMN)}")
    return [*PERIOD_COLUMN[period], "year"]


def _total(columns: list[str]) -> Column:
    return sum((F.col(c) for c in columns[1:]), F.col(columns[0]))


def decomp_sums(raw: DataFrame, period: str = "all") -> DataFrame:
    """Sums of all parts, with the weeks they are of and those without a prediction."""
    values = ["y_hat", "base_sales", *PARTS]
    return raw.groupBy(*PRODUCT, *period_keys(period)).agg(
        *[F.sum(v).alias(f"{v}_sum") for v in values], F.count(F.lit(1)).alias("weeks"),
        F.count_if(F.col("y_hat").isNull()).alias("weeks_without_model"))


def decomp_corrected(sums: DataFrame, period: str = "all") -> DataFrame:
    """Spread the unexplained rest over the parts in proportion; whole units.

    Parts that add up to 0 have no proportion and stay as they are.
    """
    part_sums = [f"{p}_sum" for p in PARTS]
    total = _total(part_sums)
    err = F.col("y_hat_sum") - (F.col("base_sales_sum") + total)
    corrected = [
        F.round(F.col(f"{p}_sum") + F.coalesce(F.try_divide(err * F.col(f"{p}_sum"), total),
                                               F.lit(0.0))).alias(p)
        for p in PARTS]
    return sums.select(*PRODUCT, F.round("base_sales_sum").alias("base_sales"),
                       *corrected, *period_keys(period))


def decomp_pct(corrected: DataFrame, period: str = "all") -> DataFrame:
    """Share of each part, two decimals, never below 0."""
    parts = ["base_sales", *PARTS]
    total = _total(parts)
    return corrected.select(
        *PRODUCT,
        *[F.round(F.greatest(F.try_divide(F.col(p), total), F.lit(0.0)), 2).alias(f"{p}_pct")
          for p in parts],
        *period_keys(period))


def seasonality_merge(df: DataFrame, suffix: str = "") -> DataFrame:
    """Fold the five seasonal parts into one column."""
    seasonal = [f"{p}{suffix}" for p in SEASON_PARTS]
    merged = _total(seasonal).alias(f"decomp_seasonality{suffix}")
    first = [*PRODUCT, f"base_sales{suffix}"]
    rest = [c for c in df.columns if c not in {*first, *seasonal}]
    return df.select(*first, merged, *rest)


def decomp_regroup(corrected: DataFrame) -> DataFrame:
    """Parts over the entire period, all years together."""
    return seasonality_merge(corrected).groupBy(*PRODUCT).agg(
        *[F.sum(c).alias(c) for c in CHART_PARTS])


def melt_parts(wide: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return wide.unpivot(ids, values, "variable", "value")


def filter_small_parts(long: DataFrame, floor: float = 2.0) -> DataFrame:
    return long.where(F.col("value") > floor)


def part_order(variable: Column) -> Column:
    """Stacking order of the parts, base sales first."""
    return F.array_position(F.array(*[F.lit(p) for p in CHART_PARTS]), variable)


def stack_position(long: DataFrame, by: list[str]) -> DataFrame:
    """Text position inside a stacked bar; a bar has at most four parts."""
    upto = (Window.partitionBy(*by).orderBy(part_order(F.col("variable")))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return long.withColumn("pos", F.sum("value").over(upto) - 0.5 * F.col("value"))


def share_within_label(long: DataFrame, by: list[str]) -> DataFrame:
    total = F.sum("value").over(Window.partitionBy(*by))
    return long.withColumn("pct", F.round(F.try_divide(F.col("value"), total) * 100, 2))


def with_period_label(df: DataFrame, period: str) -> DataFrame:
    """Bar label, and the number that puts labels into calendar order."""
    if period == "quarter":
        return df.withColumn("labels", period_label(F.col("year"), F.col("quarter"))).withColumn(
            "label_order", F.col("year") * 100 + F.substring("quarter", 2, 1).cast("int"))
    if period == "month":
        code = month_code(F.col("fiscal_month"))
        return df.withColumn("labels", period_label(F.col("year"), code)).withColumn(
            "label_order", F.col("year") * 100 + code.cast("int"))
    return df.withColumn("labels", period_label(F.col("dept"), F.col("type"))).withColumn(
        "label_order", F.lit(0))


def sort_period_labels(df: DataFrame) -> DataFrame:
    """Calendar order of the labels rather than alphabetical order."""
    return df.orderBy("label_order", *PRODUCT)
