"""Report behaviour on small hand-made facts, and the shape of the plans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesmix.functions import calendar as cal
from salesmix.functions.calendar import week_after_a_year
from salesmix.operators import decomposition as dec
from salesmix.operators import relational as rel
from salesmix.operators import scenario as scn
from salesmix.operators import scoring as sc
from salesmix.operators import weekly as wk
from salesmix.plans import reports as rep
from salesmix.sources import draws as store
from salesmix.sources import retail
from salesmix.sources import tables as src
from salesmix.session import work_dir


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def facts_rows(spark, weeks, prices=None):
    rows = [("D1", "T1", w, float(100 + 10 * i), (prices or [20.0] * len(weeks))[i])
            for i, w in enumerate(weeks)]
    df = spark.createDataFrame(rows, "dept string, type string, week date, "
                                     "blended_units_total double, price double")
    fixed = {c: F.lit(0.0) for c in sc.DRIVERS_RAW if c != "price"}
    return df.withColumns({"quarter": F.lit("Q1"), "fiscal_month": F.lit("JANUARY"), **fixed})


def model(spark, coef):
    return spark.createDataFrame([("D1", "T1", coef)], "dept string, type string, coef array<double>")


def sundays(first, n):
    return [first + dt.timedelta(days=7 * i) for i in range(n)]


def test_calendar(spark):
    row = spark.sql("SELECT DATE '2014-07-09' AS a, DATE '2014-08-01' AS b").select(
        cal.floor_week_sunday(F.col("a")).alias("sunday"),
        cal.week_sequence(F.col("a"), F.col("b")).alias("weeks"),
        F.struct(*cal.same_weeks_last_year(F.col("a"), F.col("b"))).alias("past"),
        cal.week_after_a_year(F.lit("2013-04-07").cast("date")).alias("later"),
        cal.month_code(F.lit("MAY")).alias("may"), cal.month_code(F.lit("x")).alias("none")).first()
    assert row.sunday == dt.date(2014, 7, 6)
    assert row.weeks == sundays(dt.date(2014, 7, 6), 4)
    assert tuple(row.past) == (dt.date(2013, 7, 7), dt.date(2013, 7, 28))
    assert row.later == dt.date(2014, 4, 6)
    assert (row.may, row.none) == ("05", None)


def test_scenario_with_unchanged_levers_repeats_last_year(spark):
    facts = facts_rows(spark, sundays(dt.date(2013, 1, 6), 8))
    coef = [2.0] + [0.0] * 7 + [0.5, 0.0, 0.0]
    start, end = "2014-01-06", "2014-02-20"
    levers = rep.default_levers(facts, start, end)
    both = rep.whatif_predict(facts, model(spark, coef), levers, start, end)
    new, old = both["new"].orderBy("week").collect(), both["old"].orderBy("week").collect()
    assert [r.week for r in new] == sundays(dt.date(2014, 1, 5), 7)
    assert [r.week for r in old] == sundays(dt.date(2013, 1, 6), 7)
    assert [r.y_hat for r in new] == [r.y_hat for r in old]
    row = rep.whatif_summary(**both).first()
    assert (row.delta, row.change) == (0.0, "increase")


def test_lower_price_lowers_units_with_a_positive_effect(spark):
    facts = facts_rows(spark, sundays(dt.date(2013, 1, 6), 8))
    coef = [2.0] + [0.0] * 7 + [0.5, 0.0, 0.0]
    start, end = "2014-01-06", "2014-02-20"
    levers = scn.shift_driver(rep.default_levers(facts, start, end), "price", -10)
    both = rep.whatif_predict(facts, model(spark, coef), levers, start, end)
    row = rep.whatif_summary(**both).first()
    assert row.change == "decrease" and row.delta == pytest.approx(11 / 33 - 13 / 33, abs=0.3)


def test_impossible_price_stops_the_scenario(spark):
    facts = facts_rows(spark, sundays(dt.date(2013, 1, 6), 4))
    start, end = "2014-01-06", "2014-01-20"
    levers = scn.shift_driver(rep.default_levers(facts, start, end), "price", -50)
    with pytest.raises(Exception, match="price too low"):
        rep.whatif_predict(facts, model(spark, [1.0] * 11), levers, start, end)["new"].collect()


def test_levers_replace_only_their_weeks(spark):
    facts = facts_rows(spark, sundays(dt.date(2013, 1, 6), 4))
    aligned = scn.align_by_position(facts, "2014-01-06", "2014-01-20")
    levers = src.load_local_rows(
        spark, [(dt.date(2014, 1, 12), 1.0, 7.0, 0.5, None)],
        "week date, num_colors double, price double, promo_pct double, redline_pct double")
    got = scn.set_levers(aligned, levers).orderBy("week").select("price", "promo_pct", "redline_pct")
    assert [tuple(r) for r in got.collect()] == [(20.0, 0, 0), (7.0, 0.5, 0), (20.0, 0, 0)]


def test_products_without_parts_get_share_zero(spark):
    facts = facts_rows(spark, sundays(dt.date(2013, 1, 6), 4))
    got = rep.historic_decomposition(facts, model(spark, [1.0] + [0.0] * 10), "all")
    row, parts = got["pct"].first(), got["corrected"].first()
    assert row.base_sales_pct == 1.0
    assert row.decomp_promo_pct == 0
    assert parts.decomp_promo == 0 and parts.decomp_redline == 0


def test_a_gap_moves_no_other_week(spark):
    weeks = sundays(dt.date(2013, 1, 6), 6)
    facts = facts_rows(spark, [w for k, w in enumerate(weeks) if k != 2])
    got = scn.align_by_position(facts, "2014-01-06", "2014-02-09").withColumn(
        "due", week_after_a_year(F.col("old_week"))).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(6))
    assert [r.old_week is None for r in got] == [False, False, True, False, False, False]
    assert all(r.week == r.due for r in got if r.old_week)
    gaps = scn.scenario_gaps(scn.align_by_position(facts, "2014-01-06", "2014-02-09")
                             .where("old_week IS NOT NULL"), "2014-01-06", "2014-02-09").first()
    assert (gaps.weeks, gaps.empty_weeks) == (5, 1)


def test_carry_forward(spark):
    weeks = sundays(dt.date(2013, 1, 6), 4)
    rows = [("D", "T", w, p) for w, p in zip(weeks, [None, 5.0, 0.0, 6.0])]
    df = spark.createDataFrame(rows, "dept string, type string, week date, p double")
    df = df.select("dept", "type", "week", *[F.col("p").alias(f"{a}_price_{b}")
                                             for a, b in retail.MEASURES])
    got = wk.carry_forward_price(df).orderBy("week").collect()
    assert [r.promo_price_total_smooth for r in got] == [None, 5.0, 5.0, 6.0]


def test_guard(spark):
    with pytest.raises(src.NoDataError, match="No model"):
        src.guard_nonempty(spark.range(0), "model")
    assert src.guard_nonempty(spark.range(1)).count() == 1
    with pytest.raises(ValueError, match="period"):
        dec.period_keys("decade")


def test_csv_with_quotes_and_an_empty_first_name(spark, tmp_path):
    (tmp_path / "d.csv").write_text(
        '"","tier","dept","week","y1","x1"\n"1","A4","2",2012-01-01,5.5,0.25\n'
        '"2","B1","4",2012-01-08,6.5,0.75\n')
    rows = src.scan_hier_csv(spark, str(tmp_path / "d.csv"), n_drivers=1).collect()
    assert [tuple(r) for r in rows] == [
        (1, "A4", "2", dt.date(2012, 1, 1), 5.5, 0.25),
        (2, "B1", "4", dt.date(2012, 1, 8), 6.5, 0.75)]


def test_rewriting_draws_replaces_only_their_iterations(spark):
    path = work_dir(spark, "t")
    df = spark.range(6).selectExpr("CAST(id % 3 AS INT) AS iter", "id AS v")
    store.sink_draws(df, path)
    store.sink_draws(df.where("iter = 1").withColumn("v", F.col("v") + 100), path)
    got = sorted(tuple(r) for r in store.scan_draws(spark, path).select("iter", "v").collect())
    assert got == [(0, 0), (0, 3), (1, 101), (1, 104), (2, 2), (2, 5)]
    assert "PartitionFilters: [isnotnull(iter" in plan(store.scan_draws(spark, path, first=1))


def test_fact_scan_reads_only_needed_columns(spark, sf_dir):
    text = plan(retail.sales_lines(spark, sf_dir))
    scan = next(line for line in text.splitlines() if "ReadSchema" in line and "l_orderkey" in line)
    for unused in ("l_tax", "l_suppkey", "l_linenumber", "l_linestatus"):
        assert unused not in scan


def test_week_range_reaches_the_scan_and_keeps_whole_weeks(spark, sf_dir):
    some = retail.weekly_facts(spark, sf_dir, "1998-03-04", "1998-12-30")
    assert "GreaterThanOrEqual(l_shipdate,1998-03-01" in plan(some)
    assert "LessThan(l_shipdate,1999" in plan(some)
    every = rel.filter_week_range(retail.weekly_facts(spark, sf_dir), "1998-03-04", "1998-12-30")
    columns = ["dept", "type", "week", "blended_units_total", "num_colors"]
    assert some.select(columns).exceptAll(every.select(columns)).count() == 0
    assert some.count() == every.count() > 0


@pytest.mark.parametrize("start, end", [("2000-02-29", "2000-06-01"), ("1999-01-03", "1999-12-26"),
                                        ("2014-07-09", "2014-08-01")])
def test_last_year_bounds_agree_with_the_columns(spark, start, end):
    cols = cal.same_weeks_last_year(F.lit(start).cast("date"), F.lit(end).cast("date"))
    assert tuple(spark.range(1).select(*cols).first()) == cal.last_year_bounds(start, end)


def test_product_filter_reaches_the_scan(spark, sf_dir):
    chosen = rel.filter_product(retail.weekly_facts(spark, sf_dir), "Brand#7", "BUILDING")
    text = plan(chosen)
    assert "EqualTo(p_brand,Brand#7)" in text and "EqualTo(c_mktsegment,BUILDING)" in text


def test_no_query_plans_a_cross_join(spark, sf_dir):
    from checks.queries import REGISTRY

    for name in ("historic_decomposition", "align_by_position", "median_of", "group_gram",
                 "cogroup_by_key", "whatif_summary", "geweke_cd"):
        text = plan(REGISTRY[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_geweke_shuffles_once(spark, sf_dir):
    from salesmix.operators import geweke

    draws = spark.createDataFrame([(1, "a", "b", "1", 0.5)],
                                  "iter int, h2 string, h1 string, driver string, draw double")
    physical = draws._jdf and geweke.geweke_cd(draws, 10)._jdf.queryExecution().executedPlan()
    assert physical.toString().count("Exchange") == 1


def test_weeks_without_sales_get_rows(spark):
    """Two gaps, one at a change of quarter; the last valid price goes on."""
    weeks = sundays(dt.date(2012, 12, 16), 7)
    sold = [(weeks[0], 3.0, 5.0), (weeks[2], 4.0, None), (weeks[5], 0.0, 0.0), (weeks[6], 1.0, 9.0)]
    df = spark.createDataFrame([("D", "T", "A", "F", w, u, p) for w, u, p in sold],
                               "dept string, type string, brand string, gender string, week date, u double, p double")
    df = df.unionByName(df.where("week = DATE '2012-12-16'").withColumn("type", F.lit("T2")))
    df = df.select("dept", "type", "brand", "gender", "week", F.lit("x").alias("quarter"), F.lit(9.0).alias("holiday_xmas"),
                   F.lit(2.0).alias("num_colors"), F.lit("?").alias("other"),
                   *[F.col("u").alias(wk.unit_column(m)) for m in wk.measure_names()],
                   *[F.col("p").alias(f"{a}_price_{b}") for a, b in retail.MEASURES])
    got = wk.carry_forward_price(df).where("type = 'T'").orderBy("week").collect()
    assert [r.week for r in got] == weeks
    assert [r.promo_price_total_smooth for r in got] == [5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 9.0]
    assert [r.blended_units_total for r in got] == [3.0, 0.0, 4.0, 0.0, 0.0, 0.0, 1.0]
    assert [r.promo_price_total for r in got] == [5.0, None, None, None, None, 0.0, 9.0]
    assert [r.quarter for r in got] == ["x", "Q4", "x", "Q1", "Q1", "x", "x"]
    assert [r.holiday_xmas for r in got] == [9.0, 1.0, 9.0, 0.0, 0.0, 9.0, 9.0]
    assert [(r.num_colors, r.other, r.brand) for r in got[:2]] == [(2.0, "?", "A"), (0.0, None, "A")]
    assert wk.carry_forward_price(df).where("type = 'T2'").count() == 1


def test_weekly_facts_shuffle_wide_rows_once(spark, sf_dir):
    """Lines are laid out narrow, by part and week; sums are shuffled per product and week only."""
    lines = plan(retail.weekly_facts(spark, sf_dir)).split("== Physical Plan ==")[1].splitlines()
    wide = [x for x in lines if "Exchange" in x and "BroadcastExchange" not in x]
    assert sum("dept" in x and "REPARTITION_BY_COL" not in x for x in wide) == 1, wide
