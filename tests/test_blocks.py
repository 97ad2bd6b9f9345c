"""Geweke reports from stored block statistics, and decompositions of products without a model."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesmix.operators import geweke, moments
from salesmix.plans import convergence, gibbs
from salesmix.plans import reports as rep
from salesmix.session import work_dir
from tests.test_reports import facts_rows, model, sundays


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def same(got, want):
    key = lambda r: (str(r.h2), str(r.h1), r.driver)
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert [key(r) for r in got] == [key(r) for r in want] and got
    for g, w in zip(got, want, strict=True):
        for c in ("se_a", "avg_a", "se_c", "avg_c", "cd"):
            assert (g[c] is None) == (w[c] is None)
            assert g[c] is None or g[c] == pytest.approx(w[c], rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("raw, burn", [(200, 0), (200, 40), (173, 7), (60, 3), (25, 0), (31, 11)])
def test_blocks_give_the_report(spark, raw, burn):
    long = spark.range(1, raw + 1).selectExpr(
        "CAST(id AS INT) AS iter", "IF(id % 2 = 0, NULL, 'a') AS h2", "'b' AS h1", "CAST(id % 3 AS STRING) AS driver",
        "10 + sin(id * 7) AS draw")
    blocks = geweke.draw_blocks(long)
    same(geweke.geweke_from_blocks(blocks, long, raw, burn), geweke.geweke_cd(long, raw, burn))


def test_more_iterations_read_only_new_draws(spark):
    folder, drivers = work_dir(spark, "chain"), ["1", "x"]
    df = spark.range(300).selectExpr("'p' AS h2", "CAST(id % 3 AS STRING) AS h1", "rand(1) AS x", "rand(2) AS y")
    spec = gibbs.FitSpec(p=2, seed=3)
    gibbs.gibbs_init(moments.group_gram(df, "y", ["x"]), spec, folder)
    gibbs.gibbs_run(spark, folder, spec, 2, 20)
    convergence.update_draw_blocks(spark, folder, drivers, 1, 20, size=5)
    gibbs.gibbs_run(spark, folder, spec, 21, 50)
    convergence.update_draw_blocks(spark, folder, drivers, 21, 50, size=5)
    report = convergence.stored_geweke_report(spark, folder, drivers, 50, 0, size=5)
    long = geweke.explode_draws(spark.read.parquet(f"{folder}/level1"), drivers)
    same(report["detail"], geweke.geweke_cd(long, 50))
    assert set(spark.read.parquet(f"{folder}/draw_blocks").select("block").distinct().toPandas()["block"]) == set(range(10))


def test_report_without_cut_blocks_scans_no_draws(spark):
    folder = work_dir(spark, "draws")
    spark.range(1, 102).selectExpr("CAST(id AS INT) AS iter", "'a' AS h2", "'b' AS h1", "'1' AS driver",
                                   "cos(id) AS draw").write.parquet(f"{folder}/old-draws")
    long = spark.read.parquet(f"{folder}/old-draws")
    geweke.draw_blocks(long, 10).write.parquet(f"{folder}/blocks")
    # Of 101 iterations the head is 1..10 and the tail 61..101: one iteration is in no block.
    cd = geweke.geweke_from_blocks(spark.read.parquet(f"{folder}/blocks"), long, 101, 0, 10)
    assert "(iter" in plan(cd)
    same(cd, geweke.geweke_cd(long, 101))
    short = long.where("iter <= 100")
    # Of 100 the head is 1..9, so nine old draws are read and no more.
    cd = geweke.geweke_from_blocks(spark.read.parquet(f"{folder}/blocks"), short, 100, 0, 10)
    text = plan(cd)
    assert "LessThanOrEqual(iter,9)" in text and text.count("old-draws") == 1
    # Blocks of one iteration never cut.
    ones = geweke.geweke_from_blocks(geweke.draw_blocks(long, 1), long.withColumn("draw", F.raise_error(F.lit("read")).cast("double")), 100, 0, 1)
    same(ones, geweke.geweke_cd(short, 100))


def test_products_without_a_model_stay(spark):
    facts = facts_rows(spark, sundays(dt.date(2013, 1, 6), 4))
    both = facts.unionByName(facts.where("week < DATE '2013-01-20'").withColumn("dept", F.lit("D2")))
    got = rep.historic_decomposition(both, model(spark, [1.0] + [0.0] * 10), "all")
    rows = {r.dept: r for r in got["corrected"].collect()}
    assert rows.keys() == {"D1", "D2"}
    assert rows["D1"].base_sales is not None and rows["D2"].base_sales is None and rows["D2"].decomp_promo is None
    assert {r.dept: (r.weeks, r.weeks_without_model) for r in got["coverage"].collect()} == {"D1": (4, 0), "D2": (2, 2)}
    assert {r.dept for r in rep.decomposition_chart_rows(got["corrected"], "all").collect()} == {"D1"}
