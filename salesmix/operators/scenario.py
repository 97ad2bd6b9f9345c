"""Laying a planned scenario over last year's facts and comparing the two."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import (
    as_date,
    floor_week_sunday,
    old_week_bounds,
    week_a_year_back,
    week_correspondence,
)
from .scoring import DRIVERS_PLANNED, PRODUCT


def week_rank(facts: DataFrame) -> DataFrame:
    """Position of a week within its product, from 0; one row per calendar week."""
    order = Window.partitionBy(*PRODUCT).orderBy("week")
    return facts.withColumn("pos", F.row_number().over(order) - 1)


def scenario_weeks(products: DataFrame, start: str, end: str) -> DataFrame:
    """The week correspondence of a scenario for every product: pos, week, old_week."""
    weeks = week_correspondence(*(F.lit(as_date(d)) for d in (start, end)))
    return products.select(*PRODUCT).distinct().select(*PRODUCT, F.inline(weeks))


def last_year(facts: DataFrame, start: str, end: str) -> DataFrame:
    """The facts of the weeks that correspond to the scenario's."""
    return facts.where(F.col("week").between(*map(F.lit, old_week_bounds(start, end))))


def align_by_position(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Every scenario week with the row of its week a year back.

    A position is the number of weeks since the first, so a week that has no row last year
    leaves its own place empty and moves no other.  ``old_week`` is the matched row's week.
    """
    past = last_year(facts, start, end)
    grid = scenario_weeks(past, start, end).withColumnRenamed("old_week", "due")
    placed = past.withColumn("due", F.col("week")).withColumnRenamed("week", "old_week")
    return grid.join(placed, [*PRODUCT, "due"], "left").drop("due")


def set_levers(aligned: DataFrame, levers: DataFrame) -> DataFrame:
    """Overwrite planned drivers by week (and product, if the levers name one)."""
    keys = [k for k in (*PRODUCT, "week") if k in levers.columns]
    planned = levers.select(*keys, *[F.col(d).alias(f"{d}_lever") for d in DRIVERS_PLANNED])
    kept = [F.coalesce(F.col(f"{d}_lever"), F.col(d)).alias(d) if d in DRIVERS_PLANNED
            else F.col(d) for d in aligned.columns]
    return aligned.join(planned, keys, "left").select(*kept)


def shift_driver(levers: DataFrame, driver: str, amount: float) -> DataFrame:
    """Add an amount (negative to subtract) to one whole driver column."""
    return levers.withColumn(driver, F.col(driver) + F.lit(float(amount)))


def _pairs(new: DataFrame, old: DataFrame, *more: str) -> DataFrame:
    past = old.select(*PRODUCT, F.col("week").alias("due"), F.col("week").alias("old_week"),
                      F.col("y_hat").alias("old_y_hat"))
    coming = new.select(*PRODUCT, "week", "y_hat", *more, week_a_year_back(F.col("week")).alias("due"))
    return coming.join(past, [*PRODUCT, "due"]).drop("due")


def join_year_over_year(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pair each new week with its week a year back, by product."""
    return _pairs(new, old)


def scenario_comparison(new: DataFrame, old: DataFrame) -> DataFrame:
    """Totals and relative change per product, all over the same paired weeks.

    pred, past_actual and past_sim are predicted, actual and past predicted units;
    pred_plus_err shifts the prediction by what last year's missed; delta is the change of
    predicted units, four decimals.  ``weeks`` counts the pairs, ``unpaired`` the scenario
    weeks whose week a year back has no scored row, which are in no total.
    """
    change = F.try_divide(F.sum("y_hat") - F.sum("old_y_hat"), F.sum("old_y_hat"))
    pairs = _pairs(new, old, "y").groupBy(*PRODUCT).agg(
        F.round(F.sum("y_hat")).alias("pred"), F.round(F.sum("y")).alias("past_actual"),
        F.round(F.sum("old_y_hat")).alias("past_sim"), F.round(change, 4).alias("delta"),
        F.count(F.lit(1)).alias("weeks"))
    planned = new.groupBy(*PRODUCT).agg(F.count(F.lit(1)).alias("planned"))
    return (pairs.join(planned, PRODUCT).withColumns({
        "pred_plus_err": F.col("pred") + (F.col("past_actual") - F.col("past_sim")),
        "unpaired": F.col("planned") - F.col("weeks")}).drop("planned"))


def scenario_delta(new: DataFrame, old: DataFrame) -> DataFrame:
    """Relative change of predicted units over paired weeks, four decimals."""
    return scenario_comparison(new, old).select(*PRODUCT, "delta")


def scenario_totals(new: DataFrame, old: DataFrame) -> DataFrame:
    """Predicted, past predicted and past actual units over paired weeks, and the prediction
    shifted by what last year's prediction missed."""
    return scenario_comparison(new, old).select(*PRODUCT, "pred", "past_actual", "past_sim", "pred_plus_err")


def scenario_gaps(new: DataFrame, start: str, end: str) -> DataFrame:
    """Scenario weeks with a prediction and without one, per product."""
    weeks = F.datediff(*(floor_week_sunday(F.lit(d).cast("date")) for d in (end, start))) / 7 + 1
    filled = F.countDistinct("week")
    return new.groupBy(*PRODUCT).agg(
        filled.alias("weeks"), (weeks.cast("bigint") - filled).alias("empty_weeks"))
