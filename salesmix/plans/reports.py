"""The sales reports: weekly series, decompositions and what-if scenarios.

Every report works on all products in the facts it is given; select products with
``filter_eq_or_all`` first.  Results are lazy DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decomposition as dec
from ..operators import relational as rel
from ..operators import scenario as scn
from ..operators import scoring as sc
from ..operators import weekly as wk
from ..sources import tables as src

PRODUCT = sc.PRODUCT


def product_choices(facts: DataFrame, brand: str | None = None,
                    gender: str | None = None) -> DataFrame:
    """Departments and types on offer, for a brand and gender if these are given."""
    chosen = {k: v for k, v in (("brand", brand), ("gender", gender)) if v is not None}
    return rel.distinct_values(rel.filter_eq_or_all(facts, **chosen), *PRODUCT)


def select_facts(facts: DataFrame, dept: str = rel.ALL, type_: str = rel.ALL,
                 start=None, end=None, brand: str = rel.ALL, gender: str = rel.ALL) -> DataFrame:
    """Facts of the chosen products and weeks; says so when there are none.

    The test runs the filter once more, so ``facts`` should be a stored table.
    """
    chosen = rel.filter_eq_or_all(facts, dept=dept, type=type_, brand=brand, gender=gender)
    if start is not None:
        chosen = rel.filter_week_range(chosen, start, end)
    return src.guard_nonempty(chosen, "data")


def selected_reports(facts: DataFrame, model: DataFrame, period: str = "all", smooth: bool = False,
                     **selection) -> dict[str, object]:
    """Series, stacked units, table and decomposition of one selection (see ``select_facts``).

    ``facts`` should be stored and have the plain prices of all weeks, so that a price may be
    carried into the selection from before its first week.
    """
    chosen = select_facts(facts, **selection)
    return {"series": weekly_series(chosen, *wk.measure_names(), smooth=smooth), "stacked": stacked_units(chosen),
            "table": sales_table(chosen, smooth), "decomposition": historic_decomposition(chosen, model, period)}


def selected_whatif(facts: DataFrame, model: DataFrame, levers: DataFrame | None, start: str, end: str,
                    **selection) -> dict[str, DataFrame]:
    """``whatif_predict`` for the selected products; without levers, on last year's drivers."""
    chosen = select_facts(facts, **selection)
    planned = default_levers(chosen, start, end) if levers is None else levers
    return whatif_predict(chosen, model, planned, start, end)


def select_model(model: DataFrame, dept: str, type_: str) -> DataFrame:
    return src.guard_nonempty(rel.filter_product(model, dept, type_), "demand model")


def products_without_model(facts: DataFrame, model: DataFrame) -> DataFrame:
    """Products that reports on a model have no parts for."""
    return rel.distinct_values(facts, *PRODUCT).join(model, PRODUCT, "left_anti")


def weekly_series(facts: DataFrame, *measures: str, smooth: bool = False,
                  by: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Units and mean price by week, and the bounds of the price axis, per measure.

    One pass serves any number of measures.  The bounds always come from the plain
    price column.
    """
    series = wk.weekly_units_and_price(facts, *measures, smooth=smooth, by=by)
    return {"series": series.orderBy("week", *by, "measure"),
            "bounds": wk.price_bounds(facts, *measures)}


def stacked_units(facts: DataFrame) -> DataFrame:
    """Units by week for promotion crossed with redline, one row per bar piece."""
    wide = wk.weekly_units_by_flag(facts)
    return dec.melt_parts(wide, ["week"], [c for c in wide.columns if c != "week"])


def sales_table(facts: DataFrame, smooth: bool = False) -> DataFrame:
    """Units of all nine measures and prices of the six that are no totals."""
    names = {"dept": "department", "type": "store", "week": "week"}
    for m in wk.measure_names():
        names[wk.unit_column(m)] = f"{m}_units"
    for m in (m for m in wk.measure_names() if not m.endswith("_total")):
        names[rel.price_column(m, smooth)] = f"{m}_price"
    return rel.project_rename(facts, names)


def _decomposition(raw: DataFrame, period: str) -> dict[str, DataFrame]:
    sums = dec.decomp_sums(raw, period)
    corrected = dec.decomp_corrected(sums, period)
    pct = dec.decomp_pct(corrected, period)
    return {
        "raw": raw, "sums": sums, "corrected": corrected,
        "data": dec.seasonality_merge(corrected),
        "pct": dec.seasonality_merge(pct, "_pct"),
        "coverage": sums.select(*PRODUCT, *dec.period_keys(period), "weeks", "weeks_without_model"),
    }


def historic_decomposition(facts: DataFrame, model: DataFrame,
                           period: str = "all") -> dict[str, DataFrame]:
    """Split historic sales into base, seasonality, promotion and redline parts.

    Products without a model stay, with null parts; ``coverage`` counts their weeks.
    """
    rows = sc.drop_null_rows(sc.log1p_transform(facts))
    scored = sc.dot_score(sc.join_model(rows, model, keep_all=True))
    return _decomposition(sc.raw_decomps(scored), period)


def decomposition_chart_rows(corrected: DataFrame, period: str = "all") -> DataFrame:
    """Long rows for a stacked bar chart with text position and share."""
    if period == "all":
        wide = dec.decomp_regroup(corrected)
    else:
        wide = dec.seasonality_merge(corrected)
    labelled = dec.with_period_label(wide, period)
    ids = [*PRODUCT, "labels", "label_order"]
    long = dec.filter_small_parts(dec.melt_parts(labelled, ids, dec.CHART_PARTS))
    bar = [*PRODUCT, "labels"]
    return dec.sort_period_labels(dec.share_within_label(dec.stack_position(long, bar), bar))


def default_levers(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Last year's planned drivers laid on the scenario weeks, 0-based positions."""
    aligned = scn.align_by_position(facts, start, end)
    return aligned.select(*PRODUCT, "week", *sc.DRIVERS_PLANNED)


def whatif_predict(facts: DataFrame, model: DataFrame, levers: DataFrame, start: str,
                   end: str) -> dict[str, DataFrame]:
    """Score a scenario: last year's facts on new weeks with the planned drivers.

    Each week takes the facts of the week 52 weeks before it.  Returns the scored scenario rows and last year's own scored rows.
    """
    aligned = scn.align_by_position(facts, start, end)
    planned = scn.set_levers(aligned, levers)
    rows = planned.select(*sc.ROW_KEYS, "blended_units_total", *sc.DRIVERS_RAW)
    rows = sc.drop_null_rows(sc.log1p_transform(rel.distinct_rows(rows)))
    new = sc.dot_score(sc.join_model(rows, model), rounded=True)
    past = sc.drop_null_rows(sc.log1p_transform(scn.last_year(facts, start, end)))
    old = sc.dot_score(sc.join_model(past, model), rounded=True)
    return {"new": new, "old": old}


def whatif_rows(new: DataFrame) -> DataFrame:
    return new.select(*PRODUCT, "week", F.col("y_hat").alias("prediction"),
                      F.col("y").alias("last_year_sales"))


def whatif_summary(new: DataFrame, old: DataFrame) -> DataFrame:
    """Totals, relative change and its direction, per product."""
    out = scn.scenario_comparison(new, old).drop("weeks", "unpaired")
    return out.withColumn(
        "change", F.when(F.col("delta") < 0, "decrease").otherwise("increase"))


def whatif_decomposition(new: DataFrame, period: str = "all") -> dict[str, DataFrame]:
    """Decomposition of a scored scenario."""
    return _decomposition(sc.raw_decomps(new), period)
