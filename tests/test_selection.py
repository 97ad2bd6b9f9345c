"""Choosing products and weeks for a report."""

import pytest

from salesmix.plans import reports as rep
from salesmix.sources import retail
from salesmix.sources.tables import NoDataError


def test_selection(spark, sf_dir):
    facts = retail.weekly_facts(spark, sf_dir)
    one = rep.select_facts(facts, "Brand#7", "BUILDING", "1996-03-06", "2000-10-18")
    assert 0 < one.count() < rep.select_facts(facts, "Brand#7").count()
    with pytest.raises(NoDataError, match="No data"):
        rep.select_facts(facts, "Brand#99")
    model = retail.demand_model(facts)
    assert rep.select_model(model, "Brand#7", "BUILDING").count() == 1
    with pytest.raises(NoDataError, match="No demand model"):
        rep.select_model(model, "Brand#99", "BUILDING")
    series = rep.weekly_series(one.withColumnRenamed("blended_price_total_smooth_supsmu",
                                                     "blended_price_total_smooth"),
                               "blended_total")
    assert series["series"].count() == one.count()
    assert series["bounds"].count() == 1
