"""Weekly unit and price series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.retail import MEASURES, PRODUCT, calendar_marks
from .relational import price_column


def unit_column(measure: str) -> str:
    side, part = measure.rsplit("_", 1)
    return f"{side}_units_{part}"


def measure_names() -> list[str]:
    return [f"{a}_{b}" for a, b in MEASURES]


def with_empty_weeks(facts: DataFrame) -> DataFrame:
    """Every week of a product from its first to its last, also those without sales.

    A week without a row gets one: no units, colours or stock, calendar marks of its own, the
    product's brand and gender, and ``*_smooth`` prices of the row before; all else is null.
    The rows follow from each row and the week of the next, without a join; a product has
    one row per calendar week, which bounds the window.
    """
    order = Window.partitionBy(*PRODUCT).orderBy("week")
    gap = F.date_sub("following", 7)
    following = facts.withColumn("following", F.lead("week").over(order))
    weeks = F.sequence("week", F.coalesce(gap, "week"), F.expr("interval 7 days"))
    rows = following.withColumn("weeks", weeks).drop("following", "week")
    rows = rows.select(*[c for c in rows.columns if c != "weeks"], F.posexplode("weeks").alias("step", "week"))
    marks, none = calendar_marks(), {unit_column(m) for m in measure_names()} | {"num_colors", "inventory_qty"}
    kept = {*PRODUCT, "week", "brand", "gender", *[f"{a}_price_{b}_smooth" for a, b in MEASURES]}

    def value(name: str) -> Column:
        if name in kept:
            return F.col(name)
        kind = facts.schema[name].dataType
        empty = F.expr(marks[name]) if name in marks else F.lit(0.0 if name in none else None)
        return F.when(F.col("step") == 0, F.col(name)).otherwise(empty.cast(kind)).alias(name)

    return rows.select(*[value(c) for c in facts.columns])


def carry_forward_price(facts: DataFrame) -> DataFrame:
    """Add the plain price columns: weeks without sales take the last valid price.

    Weeks in which a product has no row at all get one (``with_empty_weeks``).
    """
    before = (Window.partitionBy(*PRODUCT).orderBy("week")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = {
        f"{a}_price_{b}_smooth":
            F.last(F.nullif(F.col(f"{a}_price_{b}"), F.lit(0.0)), ignorenulls=True).over(before)
        for a, b in MEASURES}
    return with_empty_weeks(facts.withColumns(filled))


def _long(wide: DataFrame, ids: list[str], measures: list[str], values: list[str]) -> DataFrame:
    """One row per measure from columns named value__measure."""
    rows = ", ".join(
        f"struct('{m}' AS measure, " + ", ".join(f"{v}__{m} AS {v}" for v in values) + ")"
        for m in measures)
    return wide.select(*ids, F.expr(f"inline(array({rows}))"))


def weekly_units(facts: DataFrame, *measures: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Units by week, all asked-for measures in one aggregate."""
    sums = [F.sum(unit_column(m)).alias(f"units__{m}") for m in measures]
    return _long(facts.groupBy(*by, "week").agg(*sums), [*by, "week"], list(measures), ["units"])


def weekly_price(facts: DataFrame, *measures: str, smooth: bool = False,
                 by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the chosen price column by week."""
    means = [F.avg(price_column(m, smooth)).alias(f"price__{m}") for m in measures]
    return _long(facts.groupBy(*by, "week").agg(*means), [*by, "week"], list(measures), ["price"])


def weekly_units_and_price(facts: DataFrame, *measures: str, smooth: bool = False,
                           by: tuple[str, ...] = ()) -> DataFrame:
    both = [agg for m in measures for agg in (
        F.sum(unit_column(m)).alias(f"units__{m}"),
        F.avg(price_column(m, smooth)).alias(f"price__{m}"))]
    return _long(facts.groupBy(*by, "week").agg(*both), [*by, "week"], list(measures),
                 ["units", "price"])


def price_bounds(facts: DataFrame, *measures: str) -> DataFrame:
    """Lowest and highest plain price over all weeks."""
    ends = [agg for m in measures for agg in (
        F.min(price_column(m, False)).alias(f"min_price__{m}"),
        F.max(price_column(m, False)).alias(f"max_price__{m}"))]
    return _long(facts.agg(*ends), [], list(measures), ["min_price", "max_price"])


def weekly_units_by_flag(facts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Units by week for promotion crossed with redline."""
    columns = ["non_promo_units_regular", "non_promo_units_redline", "promo_units_regular",
               "promo_units_redline"]
    return facts.groupBy(*by, "week").agg(*[F.sum(c).alias(c) for c in columns])


def period_bounds(facts: DataFrame, *by: str) -> DataFrame:
    """First and last week present."""
    return facts.groupBy(*by).agg(F.min("week").alias("first_week"),
                                  F.max("week").alias("last_week"))
