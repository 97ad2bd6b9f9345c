"""One week correspondence for alignment, pairing, totals and change."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesmix.functions import calendar as cal
from salesmix.operators import scenario as scn
from salesmix.plans import reports as rep
from tests.test_reports import facts_rows, model, sundays

COEF = [2.0] + [0.0] * 7 + [0.5, 0.0, 0.0]


@pytest.mark.parametrize("weekday", range(7))
@pytest.mark.parametrize("year", [2014, 2016, 2017])
def test_every_week_is_paired_whatever_day_the_scenario_starts(spark, weekday, year):
    facts = facts_rows(spark, sundays(dt.date(year - 2, 12, 2) - dt.timedelta(days=cal.as_date(f"{year - 2}-12-02").isoweekday() % 7), 80))
    start = dt.date(year, 1, 1) + dt.timedelta(days=weekday)
    end = start + dt.timedelta(days=7 * 9 + 3)
    weeks = (cal.sunday_of(end) - cal.sunday_of(start)).days // 7 + 1
    both = rep.whatif_predict(facts, model(spark, COEF), rep.default_levers(facts, start, end), start, end)
    aligned = scn.align_by_position(facts, start, end).collect()
    assert len(aligned) == weeks and all((r.week - r.old_week).days == 364 for r in aligned)
    pairs = scn.join_year_over_year(both["new"], both["old"]).collect()
    assert sorted((r.week, r.old_week) for r in pairs) == sorted((r.week, r.old_week) for r in aligned)
    row = scn.scenario_comparison(both["new"], both["old"]).first()
    assert (row.weeks, row.unpaired, row.delta) == (weeks, 0, 0.0)
    assert row.pred == row.past_sim == sum(r.y_hat for r in pairs)


def test_a_week_without_a_row_is_in_no_total(spark):
    weeks = sundays(dt.date(2013, 1, 6), 6)
    facts = facts_rows(spark, [w for k, w in enumerate(weeks) if k != 2])
    start, end = "2014-01-05", "2014-02-09"
    levers = rep.default_levers(facts, start, end)
    both = rep.whatif_predict(facts, model(spark, COEF), levers, start, end)
    row = scn.scenario_comparison(both["new"], both["old"]).first()
    assert (row.weeks, row.unpaired) == (5, 0)
    without = both["old"].where(F.col("week") != weeks[0].isoformat())
    short = scn.scenario_comparison(both["new"], without).first()
    assert (short.weeks, short.unpaired) == (4, 1)
    kept = [r for r in both["new"].collect() if r.week != dt.date(2014, 1, 5)]
    assert short.pred == round(sum(r.y_hat for r in kept)) and short.past_actual == round(sum(r.y for r in kept))


def test_correspondence_leads_there_and_back(spark):
    row = spark.sql("SELECT DATE '1999-01-03' AS a, DATE '2000-12-30' AS b").select(
        F.explode(cal.week_correspondence(F.col("a"), F.col("b"))).alias("w")).select(
        "w.*", cal.week_after_a_year(F.col("w.old_week")).alias("again"), cal.week_a_year_back(F.col("w.week")).alias("back")).collect()
    assert [r.pos for r in row] == list(range(104))
    assert all(r.again == r.week and r.back == r.old_week for r in row)
    assert (row[0].old_week, row[-1].old_week) == cal.old_week_bounds("1999-01-03", "2000-12-30")
