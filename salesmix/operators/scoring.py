"""Demand scoring and the row-level split of a prediction into parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRODUCT = ["dept", "type"]
ROW_KEYS = ["dept", "type", "week", "quarter", "fiscal_month"]

# Driver names, and the order of a coefficient vector.
DRIVERS_PLANNED = ["num_colors", "price", "promo_pct", "redline_pct"]
DRIVERS_RAW = ["num_colors", "inventory_qty", "bts_ind", "holiday_thanksgiving",
               "holiday_easter", "holiday_xmas", "holiday_pre_xmas", "price", "promo_pct",
               "redline_pct"]
DRIVERS = ["num_colors_log", "inventory_qty_log", "bts_ind", "holiday_thanksgiving",
           "holiday_easter", "holiday_xmas", "holiday_pre_xmas", "price_log", "promo_pct",
           "redline_pct"]
COEF_ORDER = ["intercept", *DRIVERS]

LOGGED = {"num_colors": "num_colors_log", "inventory_qty": "inventory_qty_log",
          "price": "price_log"}
# Drivers folded into base sales, and the part each other driver makes.
BASE_DRIVERS = ["num_colors_log", "inventory_qty_log", "price_log"]
SEASON_PARTS = {"decomp_bts": "bts_ind", "decomp_thanksgiving": "holiday_thanksgiving",
                "decomp_easter": "holiday_easter", "decomp_xmas": "holiday_xmas",
                "decomp_pre_xmas": "holiday_pre_xmas"}
PARTS = {**SEASON_PARTS, "decomp_promo": "promo_pct", "decomp_redline": "redline_pct"}


def coef_of(name: str, coef: str = "coef") -> Column:
    return F.col(coef)[COEF_ORDER.index(name)]


def _log1p(name: str) -> Column:
    """ln(x + 1); a value of -1 or less stops the job instead of losing its row."""
    x = F.col(name)
    bad = F.raise_error(F.concat(F.lit(f"{name} too low for a logarithm: "), x.cast("string")))
    return F.when(x <= -1, bad.cast("double")).otherwise(F.log1p(x))


def log1p_transform(facts: DataFrame) -> DataFrame:
    """Model columns: ln(x + 1) of units, assortment, inventory and price."""
    drivers = [_log1p(c).alias(LOGGED[c]) if c in LOGGED else F.col(c) for c in DRIVERS_RAW]
    return facts.select(
        *ROW_KEYS, _log1p("blended_units_total").alias("blended_units_total_log"), *drivers)


def drop_null_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop a row when any of the columns (all by default) is null."""
    return df.dropna(how="any", subset=columns)


def expm1_inverse(value: Column) -> Column:
    return F.expm1(value)


def linear_score(coef: str = "coef") -> Column:
    """Intercept plus coefficient times driver, on the log scale."""
    terms = [coef_of(name, coef) * F.col(name) for name in DRIVERS]
    return sum(terms, coef_of("intercept", coef))


def join_model(facts: DataFrame, model: DataFrame, keep_all: bool = False) -> DataFrame:
    """Facts with the coefficients of their product's model.

    Products without one are left out, or with ``keep_all`` stay, with null coefficients and
    so without score, prediction and parts: what ``left_join_model_pred`` gives in one join.
    """
    return facts.join(model.select(*PRODUCT, "coef"), PRODUCT, "left" if keep_all else "inner")


def dot_score(facts_with_coef: DataFrame, rounded: bool = False) -> DataFrame:
    """Add actual units ``y``, the log-scale ``score`` and predicted units ``y_hat``.

    Scenario predictions are rounded to whole units, history is not.
    """
    y_hat = F.expm1("score")
    return (
        facts_with_coef
        .withColumn("score", linear_score())
        .withColumn("y", expm1_inverse(F.col("blended_units_total_log")))
        .withColumn("y_hat", F.round(y_hat) if rounded else y_hat)
    )


def residual(scored: DataFrame) -> DataFrame:
    return scored.withColumn("err", F.col("y") - F.col("y_hat"))


def left_join_model_pred(facts: DataFrame, model: DataFrame, pred: DataFrame) -> DataFrame:
    """All facts, with coefficients and predictions where there are any."""
    return (
        facts.join(model.select(*PRODUCT, "coef"), PRODUCT, "left")
        .join(pred.select(*PRODUCT, "week", "y", "y_hat"), [*PRODUCT, "week"], "left")
    )


def driver_contribution(name: str) -> Column:
    """Prediction less the prediction with this driver set to 0.

    The score is linear, so leaving a driver out is one subtraction rather than
    another dot product.
    """
    return F.col("y_hat") - F.expm1(F.col("score") - coef_of(name) * F.col(name))


def base_sales() -> Column:
    """exp of intercept, price, assortment and inventory terms; nothing subtracted."""
    terms = [coef_of(name) * F.col(name) for name in BASE_DRIVERS]
    return F.exp(sum(terms, coef_of("intercept")))


def raw_decomps(scored: DataFrame) -> DataFrame:
    """Base sales and one part per remaining driver, for every row."""
    return scored.select(
        *ROW_KEYS, F.year("week").alias("year"), "y_hat",
        base_sales().alias("base_sales"),
        *[driver_contribution(driver).alias(part) for part, driver in PARTS.items()],
    )


def raw_decomp_error(raw: DataFrame) -> DataFrame:
    """Sum of the parts and what base plus parts leave unexplained, per row."""
    total = sum((F.col(p) for p in list(PARTS)[1:]), F.col(list(PARTS)[0]))
    return raw.withColumn("decomp_sum", total).withColumn(
        "decomp_err", F.col("y_hat") - (F.col("base_sales") + F.col("decomp_sum")))
