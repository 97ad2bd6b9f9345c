"""The report and model tables, derived from order-line tables.

Facts are one row per (dept, type, week): dept is the part brand, type the market
segment of the customer, week the Sunday on or before shipping.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import MONTHS, floor_week_sunday, sunday_of
from ..operators.scoring import COEF_ORDER
from ..session import fine_shuffles
from .tables import scan_table

PRODUCT = ["dept", "type"]
# Unit and price measures: sales on promotion or not, marked down or not.
PROMO_SIDES = {"blended": (0, 1), "non_promo": (0,), "promo": (1,)}
REDLINE_SIDES = {"total": (0, 1), "regular": (0,), "redline": (1,)}
MEASURES = [(a, b) for a in PROMO_SIDES for b in REDLINE_SIDES]

# Stand-in demand model: effects in model-table order behind the intercept.
STAND_IN_EFFECTS = dict(
    num_colors_log=0.45, inventory_qty_log=0.30, bts_ind=0.12, holiday_thanksgiving=0.20,
    holiday_easter=0.08, holiday_xmas=0.25, holiday_pre_xmas=0.10, price_log=-0.15,
    promo_pct=0.35, redline_pct=0.22)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan_table(spark, f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, whose joins and groupings are shuffled in parts of bounded size."""
    fine_shuffles(spark, f"{sf_dir}/lineitem.parquet")
    return _table(spark, sf_dir, "lineitem")


def _orders_with_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = _table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment")
    return orders.join(customer, orders.o_custkey == customer.c_custkey)


def sales_lines(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """Order lines with product keys, week and the promotion and redline marks.

    ``start`` and ``end`` keep the weeks from the one to the other as a filter on the
    shipping date, which the scan can use; a filter on the week cannot reach it.
    """
    lines = _lines(spark, sf_dir)
    shipped = F.col("l_shipdate")
    if start is not None:
        lines = lines.where(shipped >= F.lit(sunday_of(start)))
    if end is not None:
        after = sunday_of(end) + dt.timedelta(days=7)
        lines = lines.where(shipped < F.lit(after))
    orders = _orders_with_segment(spark, sf_dir)
    part = _table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_size", "p_retailprice")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(part, lines.l_partkey == part.p_partkey)
        .select(
            F.col("p_brand").alias("dept"),
            F.col("c_mktsegment").alias("type"),
            floor_week_sunday(F.to_date("l_shipdate")).alias("week"),
            F.col("l_partkey").alias("part"),
            F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("amount"),
            (F.col("l_quantity") * F.col("p_retailprice")).alias("list_amount"),
            F.col("p_size").cast("double").alias("stock"),
            (F.col("l_discount") > 0.05).cast("int").alias("promo"),
            (F.col("l_returnflag") == "R").cast("int").alias("redline"),
        )
    )


def _cells(prefix: str, side: tuple[int, ...], part: tuple[int, ...]) -> str:
    """Sum of the promo x redline cells that make up a measure, as SQL text."""
    return "(" + " + ".join(f"{prefix}{i}{j}" for i in side for j in part) + ")"


def brand_of(dept):
    """Brand A holds the odd department numbers, brand B the even ones."""
    return F.when(_dept_no(dept) % 2 == 1, "A").otherwise("B")


def gender_of(dept):
    return F.when(_dept_no(dept) <= 12, "F").otherwise("M")


def _dept_no(dept):
    return F.substring_index(dept, "#", -1).cast("int")


def calendar_marks() -> dict[str, str]:
    """Columns that follow from the week alone, as SQL text."""
    names = ", ".join(f"'{m}'" for m in MONTHS)
    flags = {
        "bts_ind": "month(week) = 8",
        "holiday_thanksgiving": "month(week) = 11 AND day(week) BETWEEN 22 AND 28",
        "holiday_easter": "month(week) = 4 AND day(week) <= 21",
        "holiday_xmas": "month(week) = 12 AND day(week) BETWEEN 19 AND 25",
        "holiday_pre_xmas": "month(week) = 12 AND day(week) < 19",
    }
    return {"quarter": "concat('Q', quarter(week))",
            "fiscal_month": f"element_at(array({names}), month(week))",
            **{name: f"CAST({cond} AS DOUBLE)" for name, cond in flags.items()}}


def weekly_facts(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """The wide weekly fact table, one row per product and week with sales.

    A report on some weeks should name them here, so that only their lines are read.  Colours
    are different parts: lines are laid out by part and week, where each part of a product's
    week is summed in place, and only sums per product and week are wide when shuffled.
    """
    sums = {f"{name}{i}{j}": f"CASE WHEN promo = {i} AND redline = {j} THEN {source} ELSE 0D END"
            for name, source in (("q", "qty"), ("a", "amount"), ("l", "list_amount"))
            for i in (0, 1) for j in (0, 1)}
    sums |= {"inventory_qty": "stock", "promos": "promo", "redlines": "redline", "lines": "1"}
    keys = ["dept", "type", "week"]
    lines = sales_lines(spark, sf_dir, start, end).repartition("part", "week")
    by_part = lines.groupBy(*keys, "part").agg(
        *[F.expr(f"sum({sql}) AS {name}") for name, sql in sums.items()])
    base = by_part.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in sums], F.count("part").cast("double").alias("num_colors"))
    base = base.withColumns({"promo_pct": F.col("promos") / F.col("lines"),
                             "redline_pct": F.col("redlines") / F.col("lines")})
    measures = []
    for a, b in MEASURES:
        sides = (PROMO_SIDES[a], REDLINE_SIDES[b])
        qty = _cells("q", *sides)
        measures += [
            f"{qty} AS {a}_units_{b}",
            f"try_divide({_cells('a', *sides)}, {qty}) AS {a}_price_{b}",
            f"try_divide({_cells('l', *sides)}, {qty}) AS {a}_price_{b}_smooth_supsmu"]
    both = ((0, 1), (0, 1))
    marks = calendar_marks()
    dept = F.col("dept")
    whole = base.withColumns({"brand": brand_of(dept), "gender": gender_of(dept)})
    return whole.selectExpr(
        "dept", "type", "week", "brand", "gender",
        *[f"{marks[name]} AS {name}" for name in ("quarter", "fiscal_month")],
        *measures, "num_colors", "inventory_qty",
        f"try_divide({_cells('a', *both)}, {_cells('q', *both)}) AS price",
        *[f"{sql} AS {name}" for name, sql in marks.items() if name not in ("quarter", "fiscal_month")],
        "promo_pct", "redline_pct")


def demand_model(facts: DataFrame) -> DataFrame:
    """Stand-in model table (dept, type, coef): intercept grows with the dept number."""
    intercept = 3.0 + 0.01 * _dept_no(F.col("dept"))
    effects = [F.lit(STAND_IN_EFFECTS[name]) for name in COEF_ORDER[1:]]
    return facts.select(*PRODUCT).distinct().withColumn("coef", F.array(intercept, *effects))


def hier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchy facts at order-line grain: h2 is the region, h1 the segment."""
    lines = _lines(spark, sf_dir)
    region = _table(spark, sf_dir, "region")
    nation = _table(spark, sf_dir, "nation")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "r_name")
    orders = _orders_with_segment(spark, sf_dir)
    orders = orders.join(places, orders.c_nationkey == places.n_nationkey)
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("index"),
        F.col("c_mktsegment").alias("h1"),
        F.col("r_name").alias("h2"),
        floor_week_sunday(F.to_date("l_shipdate")).alias("week"),
        F.log1p("l_extendedprice").alias("y1"),
        F.col("l_quantity").alias("x1"),
        F.col("l_discount").alias("x2"),
        F.col("l_tax").alias("x3"),
    )


def event_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of values read as draws: one chain per event type and user bucket, one
    step per day, the value being the day's mean."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
    return (
        _table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("h2"),
                 (F.col("user_id") % 10).cast("string").alias("h1"),
                 day.alias("iter"))
        .agg(F.avg("value").alias("draw"))
    )
