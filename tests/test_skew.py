"""Results stay whole, and groups bounded, when one key or copy holds a third of the rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from salesmix.operators import moments, relational

N = 9000


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    hot = rng.random(N) < 0.34
    data = pd.DataFrame({
        "h2": np.where(hot, "hot", np.char.add("k", (np.arange(N) % 40).astype(str))),
        "h1": "t", "week": 0, "id": np.arange(N), "x1": rng.normal(size=N).round(2)})
    data["y"] = 1 + data.x1 + rng.normal(size=N).round(2)
    copies = pd.DataFrame({"h2": "hot", "h1": "t", "week": 0, "id": N, "x1": 0.25, "y": 2.0},
                          index=range(N // 2))
    return spark.createDataFrame(data), spark.createDataFrame(pd.concat([data, copies])), \
        pd.concat([data, copies])


def test_design_blocks_are_bounded_and_complete(skewed):
    blocks = moments.group_design_matrix(skewed[1], "y", ["x1"], chunk_rows=200).toPandas()
    assert blocks.y.map(len).max() < 320
    assert (blocks.h2 == "hot").sum() > 10
    total = {}
    for b in blocks.itertuples():
        x, y, w = np.stack(b.x_rows), np.array(b.y), np.array(b.copies)
        sums = np.concatenate([(x * w[:, None]).T @ x, [(x * w[:, None]).T @ y]])
        total[b.h2] = total.get(b.h2, 0) + sums
    for h2, g in skewed[2].groupby("h2"):
        x = np.column_stack([np.ones(len(g)), g.x1])
        np.testing.assert_allclose(total[h2], np.concatenate([x.T @ x, [x.T @ g.y]]))


def test_cogroup_chunks_are_bounded_and_complete(skewed):
    right = skewed[0].where("h2 <> 'k1'").select("h2", (F.col("id") + 100_000).alias("id"))
    left = skewed[0].where("h2 <> 'k2'")
    got = relational.cogroup_by_key(left, right, "h2", "id", chunk_rows=100).toPandas()
    assert got.left_values.map(len).max() < 180
    data = skewed[0].select("h2", "id").toPandas()
    for h2, g in data.groupby("h2"):
        rows = got[got.h2 == h2]
        ids = sorted(g.id)
        assert sorted(np.concatenate(rows.left_values.tolist())) == ([] if h2 == "k2" else ids)
        want = [] if h2 == "k1" else [i + 100_000 for i in ids]
        assert sorted(np.concatenate(rows.right_values.tolist())) == want


@pytest.mark.parametrize("error", [1e-4, 0.01])
def test_median(skewed, error):
    got = relational.median_of(skewed[1], ["h2"], "x1", error).toPandas().set_index("h2")["median"]
    want = skewed[2].groupby("h2").x1.median()
    assert got.sort_index().to_dict() == pytest.approx(want.sort_index().to_dict())


def test_median_of_few_and_missing_values(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1D), ('a', 4D), ('b', 7D), ('b', NULL), ('c', NULL)"
                   " AS t(k, v)")
    got = {r.k: r.median for r in relational.median_of(df, ["k"], "v").collect()}
    assert got == {"a": 2.5, "b": 7.0}


def test_median_bracket_is_enough_for_large_groups(spark):
    df = spark.range(60_001).selectExpr("'a' AS k", "CAST(id * 37 % 60001 AS DOUBLE) AS v")
    assert relational.median_of(df, ["k"], "v").first().median == 30_000.0


def test_hot_join_key_is_split_even_before_an_aggregate_on_it(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        left = spark.range(0, 300_000, 1, 8).selectExpr(
            "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "rand(1) AS v")
        right = spark.range(0, 300_000, 1, 8).selectExpr("id AS k", "id AS w")
        got = left.join(right, "k").groupBy("k").agg(F.count("v").alias("n"))
        rows = {r.k: r.n for r in got.where("n > 1").collect()}
        assert rows == {7: 100_001}
        whole = left.join(right, "k").groupBy("k").agg(F.sum("v").alias("s"))
        assert len(whole.collect()) == 200_000
        assert "skew=true" in whole._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_null_keys_and_repeated_values_are_kept(spark):
    left = spark.createDataFrame([(None, 1), (None, 1), (1, 7)] + [(1, 5)] * 5000, "k int, id bigint")
    right = spark.createDataFrame([(None, 2), (2, 3)], "k int, id bigint")
    got = relational.cogroup_by_key(left, right, "k", "id", chunk_rows=100).toPandas()
    assert max(map(len, got["left_values"])) <= 600
    sizes = got.assign(n=got["left_values"].map(len), m=got["right_values"].map(len)) \
        .groupby("k", dropna=False)[["n", "m"]].sum()
    assert sizes.loc[1].tolist() == [5001, 0] and sizes.loc[2].tolist() == [0, 1]
    assert sizes[sizes.index.isna()].values.tolist() == [[2, 1]]
    values = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    assert {r.k: r.median for r in relational.median_of(values, ["k"], "v").collect()} == {None: 2.0, "a": 5.0}


def test_median_of_one_key_with_all_rows(spark, monkeypatch):
    """Ranks are found through partitions and blocks; no window holds the key, nothing can miss."""
    monkeypatch.setattr(relational, "MEDIAN_BLOCK", 64)
    rng = np.random.default_rng(5)
    for n in (50_001, 50_000):
        values = np.round(rng.normal(size=n), 3)
        df = spark.createDataFrame(pd.DataFrame({"k": "all", "v": values})).repartition(7)
        median = relational.median_of(df, ["k"], "v")
        assert median.first().median == pytest.approx(np.median(values), abs=1e-12)
        text = median._jdf.queryExecution().toString()
        assert "raise_error" not in text and "percentile" not in text
    same = spark.range(9_000).selectExpr("'k' AS k", "CAST(id % 2 AS DOUBLE) AS v")
    assert relational.median_of(same, ["k"], "v").first().median == 0.5


@pytest.mark.parametrize("kind, values", [
    ("date", [dt.date(2020, 1, 3), dt.date(2019, 5, 5), dt.date(2020, 1, 3)]), ("string", ["b", "a", "b"]),
    ("double", [2.5, -1.0, 2.5]), ("struct<a:int,b:string>", [(2, "x"), (1, "y"), (2, "x")]), ("array<int>", [[2], [1, 5], [2]])])
def test_cogroup_of_any_type(spark, kind, values):
    left = spark.createDataFrame([("k", v) for v in values] + [("left", values[0])], f"k string, v {kind}")
    right = spark.createDataFrame([("k", values[1]), ("right", values[1])], f"k string, v {kind}")
    got = {r.k: (r.left_values, r.right_values) for r in relational.cogroup_by_key(left, right, "k", "v").collect()}
    plain = {k: tuple([tuple(x) if isinstance(x, tuple) else x for x in side] for side in v) for k, v in got.items()}
    assert plain == {"k": (sorted(values), [values[1]]), "left": ([values[0]], []), "right": ([], [values[1]])}


def test_cogroup_of_two_types(spark):
    left = spark.createDataFrame([(1, "x")], "k int, v string")
    right = spark.createDataFrame([(2, 7)], "k int, v int")
    got = relational.cogroup_by_key(left, right, "k", "v").orderBy("k").collect()
    assert [(r.left_values, r.right_values) for r in got] == [(["x"], []), ([], [7])]


ONE_SCAN = ["join_level2_tables", "join_groups_by_key", "join_count_lookup", "level2_s2", "group_ssr",
            "noise_precision_draw", "median_of", "group_design_matrix"]


@pytest.mark.parametrize("name", ONE_SCAN)
def test_order_lines_are_read_once(spark, sf_dir, name):
    """A result that needs the lines twice stores what it needs of them first."""
    from checks.queries import REGISTRY

    text = REGISTRY[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert text.count("lineitem.parquet") == 0 and "FileScan" in text
