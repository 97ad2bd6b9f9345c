"""Centred moments: merging, digits far from 0, and the layout of the sampler's tables."""

import glob

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from salesmix.functions import linalg as la
from salesmix.operators import moments
from salesmix.plans import gibbs
from salesmix.session import work_dir
from salesmix.sources import draws as store

XS = ["x1", "x2"]


@pytest.fixture(scope="module")
def far(spark):
    """Responses about 1e8 with a spread of 0.3, in groups of 1 to 400 rows."""
    rng = np.random.default_rng(8)
    parts = []
    for k, n in enumerate([1, 2, 3, 40, 400]):
        x = rng.normal(size=(n, 2)) + [5.0, -1e3]
        parts.append(pd.DataFrame({"h2": "far", "h1": f"g{k}", "week": 0, "x1": x[:, 0], "x2": x[:, 1],
                                   "y": 1e8 + 2 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(scale=0.3, size=n)}))
    data = pd.concat(parts).sample(frac=1, random_state=1)
    return spark.createDataFrame(data).repartition(6), data


def upper(m):
    return m[np.triu_indices(len(m))]


@pytest.mark.parametrize("wide, held", [(40, 4096), (0, 4096), (0, 2), (0, 1)])
def test_residuals_far_from_zero(spark, far, monkeypatch, wide, held):
    monkeypatch.setattr(moments, "WIDE_SUMS", wide)
    monkeypatch.setattr(moments, "HELD_GROUPS", held)
    stats = moments.group_gram(far[0], "y", XS)
    b = [1e8, 2.0, -0.5]
    draws = stats.select("h2", "h1", F.array(*map(F.lit, b)).alias("draw"))
    got = {r.h1: (r.n, r.ssr) for r in moments.group_ssr(stats, draws, 3).collect()}
    rows = {r.h1: r for r in stats.collect()}
    assert len(rows) == len(got) == 5
    for h1, g in far[1].groupby("h1"):
        want = np.square((g.y - 1e8) - 2 * g.x1 + 0.5 * g.x2).sum()
        assert got[h1] == (len(g), pytest.approx(want, rel=1e-6, abs=1e-9))
        z = g[["x1", "x2", "y"]].to_numpy()
        dev = z - z.mean(axis=0)
        np.testing.assert_allclose(rows[h1].mean, z.mean(axis=0), rtol=1e-12)
        np.testing.assert_allclose(rows[h1].centred, upper(dev.T @ dev), rtol=1e-6, atol=1e-6)
        one = la.ssr_centred(np.array([len(g)]), np.array([rows[h1].mean]), np.array([rows[h1].centred]), np.array([b]))
        assert one[0] == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_sampler_keeps_residuals_without_a_shift(spark, far):
    """A prior about 0 would pull an intercept of 1e8; the residuals are those of the moments."""
    stats = moments.group_gram(far[0].where("h1 IN ('g3', 'g4')"), "y", XS)
    spec, folder = gibbs.FitSpec(p=3, seed=2, prior_mean=[1e8, 2.0, -0.5]), work_dir(spark, "far")
    gibbs.gibbs_init(stats, spec, folder)
    gibbs.gibbs_run(spark, folder, spec, 2, 4)
    s2 = [r.s2 for r in gibbs.read_state(spark, folder).where("iter > 1").collect()]
    assert all(0.05 < v < 0.2 for v in s2), s2


def test_merging_moments_in_any_order():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(50, 3)) * [1, 10, 0.1] + [0, 1e6, -3]
    parts = [z[:1], z[1:1], z[1:7], z[7:30], z[30:]]

    def of(rows):
        if not len(rows):
            return np.zeros(1), np.zeros((1, 3)), np.zeros((1, 6))
        return moments._reduced(np.zeros(len(rows), int), np.ones(len(rows)), rows, 0.0)

    want = of(z)
    for order in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [2, 0, 4, 1, 3]):
        got = of(parts[order[0]])
        for k in order[1:]:
            got = moments.merged_moments(*got, *of(parts[k]))
        for a, b in zip(got, want, strict=True):
            np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)


def test_moments_that_cannot_be_stop_the_job(spark):
    stats = spark.createDataFrame([("north", "a", 3, [0.0, 0.0], [1.0, 5.0, 1.0])],
                                  "h2 string, h1 string, n long, mean array<double>, centred array<double>")
    draws = spark.createDataFrame([("north", "a", [0.0, 1.0])], "h2 string, h1 string, draw array<double>")
    with pytest.raises(Exception, match="negative sum of squares in h2 north"):
        moments.group_ssr(stats, draws, 2).collect()
    with pytest.raises(ValueError, match="negative sum of squares"):
        la.ssr_centred(np.ones(1) * 3, np.zeros((1, 2)), np.array([[1.0, 5.0, 1.0]]), np.array([[0.0, 1.0]]))


def test_left_out_rows_are_counted(spark):
    df = spark.createDataFrame([("a", "b", 1.0, 2.0), ("a", "b", None, 2.0), ("a", None, 1.0, None), ("a", None, None, None)],
                               "h2 string, h1 string, y double, x double")
    got = {r.h1: r.left_out for r in moments.rows_left_out(df, "y", ["x"]).collect()}
    assert got == {"b": 1, None: 2}
    assert [(r.h1, r.n) for r in moments.group_gram(df, "y", ["x"]).collect()] == [("b", 1)]


def above_scan(text, mark):
    """Operators above the scan whose line holds ``mark``, nearest first."""
    lines = text.splitlines()
    at = next(k for k, line in enumerate(lines) if mark in line and "FileScan" in line)
    found, depth = [], len(lines[at]) - len(lines[at].lstrip(" :+-"))
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-"))
        if own < depth:
            depth = own
            found.append(line.strip(" :+-"))
    return found


def test_iterations_do_not_shuffle_the_moments(spark, far, monkeypatch):
    monkeypatch.setattr(gibbs, "CELL_GROUPS", 2)
    monkeypatch.setattr(gibbs, "BUCKET_GROUPS", 1)
    stats = moments.group_gram(far[0], "y", XS)
    spec, folder = gibbs.FitSpec(p=3, seed=2), work_dir(spark, "buckets")
    state = gibbs.gibbs_init(stats, spec, folder)
    settings = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in settings:
        spark.conf.set(name, "-1")
    try:
        with gibbs._moments(spark, folder) as stored:
            sums = gibbs._level1_sums(gibbs._with_state(stored, state, folder), spec, 2)
            above = above_scan(sums._jdf.queryExecution().executedPlan().toString(), "salesmix_moments")
            join = next(k for k, line in enumerate(above) if "SortMergeJoin" in line)
            assert not any("Exchange" in line for line in above[:join])
            assert sums.count() == 1
    finally:
        for name in settings:
            spark.conf.unset(name)
    cells = spark.read.parquet(f"{folder}/cells").collect()
    assert len(cells) == 3 and {r.groups for r in cells} == {5}
    assert spark.read.parquet(f"{folder}/stats").count() == 5
    assert not spark.catalog.tableExists(gibbs._table_name(folder))


@pytest.mark.parametrize("rows, least, most", [(2_000, 1, 2), (400_000, 4, 60)])
def test_files_of_an_iteration_follow_its_rows(spark, rows, least, most):
    """Any columns; a large iteration becomes several files, a small one a single file."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512KB")
    try:
        path = work_dir(spark, "files")
        df = spark.range(0, rows, 1, 8).selectExpr("CAST(1 AS INT) AS iter", "rand(1) AS v", "id")
        store.sink_draws(df.unionByName(spark.range(10).selectExpr("CAST(2 AS INT) AS iter", "0D AS v", "id")), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert least <= len(glob.glob(f"{path}/iter=1/*.parquet")) <= most
    assert len(glob.glob(f"{path}/iter=2/*.parquet")) == 1
    assert store.scan_draws(spark, path).count() == rows + 10
