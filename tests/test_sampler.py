"""The sampler as a whole: recovery, restart, convergence, and the long sum form."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from salesmix.operators import geweke, moments
from salesmix.operators import posterior as post
from salesmix.plans import convergence, gibbs
from salesmix.session import work_dir

XS = ["x1", "x2"]


@pytest.fixture(scope="module")
def facts(spark):
    """Two pools of 12 groups whose coefficients scatter around known means."""
    rng = np.random.default_rng(3)
    rows = []
    for h2, centre in (("A", [2.0, 1.0, -0.5]), ("B", [5.0, -2.0, 0.8])):
        for g in range(12):
            b = np.array(centre) + rng.normal(scale=0.1, size=3)
            x = rng.normal(size=(60, 2))
            y = b[0] + x @ b[1:] + rng.normal(scale=0.3, size=60)
            rows.append(pd.DataFrame({"h2": h2, "h1": f"g{g}", "week": 0, "y": y,
                                      "x1": x[:, 0], "x2": x[:, 1]}))
    data = pd.concat(rows)
    return spark.createDataFrame(data), data


@pytest.fixture(scope="module")
def fitted(spark, facts):
    spec = gibbs.FitSpec(p=3, seed=4)
    folder = work_dir(spark, "fit")
    gibbs.gibbs_init(moments.group_gram(facts[0], "y", XS), spec, folder)
    return spec, folder, gibbs.gibbs_run(spark, folder, spec, 2, 12)


def test_recovers_group_coefficients(facts, fitted):
    means = convergence.posterior_model(fitted[2], 3, burn_in=3).toPandas()
    for (h2, h1), g in facts[1].groupby(["h2", "h1"]):
        x = np.column_stack([np.ones(len(g)), g[XS]])
        ols = np.linalg.lstsq(x, g.y, rcond=None)[0]
        got = means[(means.dept == h2) & (means.type == h1)].coef.iloc[0]
        np.testing.assert_allclose(got, ols, atol=0.2)


def test_noise_precision_is_recovered(spark, fitted):
    h = gibbs.read_state(spark, fitted[1]).where("iter > 3").agg(F.avg("h")).first()[0]
    assert h == pytest.approx(1 / 0.3 ** 2, rel=0.15)


def test_all_iterations_once(fitted):
    counts = fitted[2].groupBy("iter").count().collect()
    assert sorted((r["iter"], r["count"]) for r in counts) == [(s, 24) for s in range(1, 13)]


def test_restart_gives_the_same_chain(spark, facts, fitted):
    spec, _, whole = fitted
    folder = work_dir(spark, "again")
    gibbs.gibbs_init(moments.group_gram(facts[0].repartition(5), "y", XS), spec, folder)
    gibbs.gibbs_run(spark, folder, spec, 2, 5)
    again = gibbs.gibbs_run(spark, folder, spec, 6, 12)
    order = ["iter", "h2", "h1"]
    a, b = (np.stack(df.orderBy(*order).toPandas()["draw"]) for df in (whole, again))
    np.testing.assert_allclose(a, b, rtol=1e-6, atol=1e-9)


def test_covariances_can_be_rebuilt(spark, fitted):
    spec, folder, draws = fitted
    rebuilt = gibbs.group_states(spark, folder, spec, 5, 6, covariance=True)
    assert rebuilt.where(F.size("v_i") != 9).count() == 0
    both = rebuilt.alias("a").join(draws.alias("b"), ["iter", "h2", "h1"])
    assert both.count() == 48
    assert both.where(F.col("a.draw") != F.col("b.draw")).count() == 0


def test_random_start_converges_too(spark, facts):
    spec = gibbs.FitSpec(p=3, seed=9, start="random")
    folder = work_dir(spark, "random")
    gibbs.gibbs_init(moments.group_gram(facts[0], "y", XS), spec, folder)
    draws = gibbs.gibbs_run(spark, folder, spec, 2, 6)
    means = convergence.posterior_model(draws.where("h2 = 'A'"), 3, burn_in=3)
    centre = means.agg(*[F.avg(F.col("coef")[i]) for i in range(3)]).first()
    np.testing.assert_allclose(centre, [2.0, 1.0, -0.5], atol=0.3)


def test_settings_are_checked():
    with pytest.raises(ValueError, match="degrees of freedom"):
        gibbs.FitSpec(p=4, df1=3)
    with pytest.raises(ValueError, match="one value per coefficient"):
        gibbs.FitSpec(p=2, prior_mean=[0.0])
    with pytest.raises(ValueError, match="start"):
        gibbs.FitSpec(p=2, start="zero")


def test_long_and_wide_moments_agree(spark, facts, monkeypatch):
    order = ["h2", "h1"]
    wide = moments.group_gram(facts[0], "y", XS).orderBy(*order).toPandas()
    monkeypatch.setattr(moments, "WIDE_SUMS", 0)
    long = moments.group_gram(facts[0], "y", XS).orderBy(*order).toPandas()
    assert (wide.n == long.n).all()
    for c in ("xtx", "xty"):
        np.testing.assert_allclose(np.stack(wide[c]), np.stack(long[c]), rtol=1e-10)


def test_fourteen_coefficients(spark):
    """The long form at 13 drivers, against numpy."""
    rng = np.random.default_rng(1)
    xs = [f"x{i}" for i in range(1, 14)]
    data = pd.DataFrame(rng.normal(size=(300, 14)), columns=["y", *xs])
    data["h2"], data["h1"] = np.where(np.arange(300) % 3 == 0, "a", "b"), "t"
    got = moments.group_gram(spark.createDataFrame(data), "y", xs).toPandas().set_index("h2")
    for h2, g in data.groupby("h2"):
        x = np.column_stack([np.ones(len(g)), g[xs]])
        np.testing.assert_allclose(got.xtx[h2], (x.T @ x).ravel(), rtol=1e-9)
        np.testing.assert_allclose(got.xty[h2], x.T @ g.y, rtol=1e-9)
        assert got.yty[h2] == pytest.approx(g.y @ g.y) and got.n[h2] == len(g)


def test_rows_with_a_null_are_left_out_of_all_moments(spark, facts, monkeypatch):
    df = facts[0].withColumn("x2", F.when(F.col("x1") > 0, F.col("x2")))
    kept = facts[1][facts[1].x1 > 0]
    for limit in (moments.WIDE_SUMS, 0):
        monkeypatch.setattr(moments, "WIDE_SUMS", limit)
        got = moments.group_gram(df, "y", XS)
        assert got.agg(F.sum("n")).first()[0] == len(kept)
        assert got.agg(F.sum("yty")).first()[0] == pytest.approx((kept.y ** 2).sum())


def test_geweke_on_independent_draws(spark):
    """About 5 % of stationary chains look non-stationary."""
    draws = spark.range(400).selectExpr("CAST(id AS STRING) AS h1", "'a' AS h2", "'1' AS driver") \
        .crossJoin(spark.range(1, 1001).selectExpr("CAST(id AS INT) AS iter"))
    u = "((CAST(conv(substring(md5(concat(h1, '/', iter)), 1, 8), 16, 10) AS DOUBLE) + 0.5) / 4294967296)"
    report = convergence.geweke_report(draws.withColumn("draw", F.expr(u)), 1000)
    share = report["share"].first()
    assert share.coefficients == 400
    assert share.share < 0.1


def test_geweke_burn_in(spark):
    long = spark.range(1, 201).selectExpr(
        "CAST(id AS INT) AS iter", "'a' AS h2", "'b' AS h1", "'1' AS driver",
        "CAST(id AS DOUBLE) AS draw")
    row = geweke.geweke_cd(long, 200, 100).first()
    head, tail = np.arange(101, 110), np.arange(161, 201)
    se_a, se_c = head.std() / np.sqrt(10), tail.std() / np.sqrt(40)
    assert row.cd == pytest.approx((head.mean() - tail.mean()) / (se_a + se_c))


def test_a_response_far_from_zero_keeps_its_residuals(spark):
    rng = np.random.default_rng(3)
    x, e = rng.normal(size=500), rng.normal(scale=0.3, size=500)
    base = 1e8
    df = spark.createDataFrame([("a", "b", base + 2 * float(u) + float(v), float(u)) for u, v in zip(x, e, strict=True)],
                               "h2 string, h1 string, y double, x double")
    stats = moments.group_gram(df, "y", ["x"], shift=base)
    draws = spark.createDataFrame([("a", "b", [0.0, 2.0])], "h2 string, h1 string, draw array<double>")
    y = np.array([base + 2 * float(u) + float(v) for u, v in zip(x, e, strict=True)]) - base
    assert abs(moments.group_ssr(stats, draws, 2).first().ssr / np.square(y - 2 * x).sum() - 1) < 1e-6


def test_no_residual_variance_names_the_group(spark):
    s2 = spark.createDataFrame([("north", 10, 0.0)], "h2 string, n bigint, s2 double")
    with pytest.raises(Exception, match="no residual variance in h2 north"):
        post.noise_precision_draw(s2, 1.0, 1).collect()


def test_null_groups_are_drawn(spark, facts):
    data = facts[0].withColumns({
        "h2": F.when(F.col("h2") != "B", F.col("h2")), "h1": F.when(F.col("h1") != "g3", F.col("h1"))})
    stats = moments.group_gram(data, "y", XS)
    spec, folder = gibbs.FitSpec(p=3, seed=4), work_dir(spark, "nulls")
    state = gibbs.gibbs_init(stats, spec, folder)
    assert {r.h2: r.n1 for r in state.collect()} == {"A": 12, None: 12}
    draws = gibbs.gibbs_run(spark, folder, spec, 2, 3)
    want = {(i, r.h2, r.h1) for r in stats.collect() for i in (1, 2, 3)}
    got = [(r.iter, r.h2, r.h1) for r in draws.collect()]
    assert len(got) == 72 and set(got) == want
    ssr = moments.group_ssr(stats, draws.where("iter = 3"), 3)
    assert ssr.count() == 24
