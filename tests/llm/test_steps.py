"""Steps that must not be done, or kept, more often than needed."""

import os

from pyspark.sql import functions as F

from salesmix.llm import line_dedup, minhash_dedup
from salesmix.session import scope


def test_block_keys_are_made_once_for_all_variants(spark, monkeypatch):
    plans, stored = {}, line_dedup.stored

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(line_dedup, "stored", seen)
    line = "a line of text that is as long as two or three blocks"
    docs = spark.createDataFrame([(1, line), (2, line[:20] + line[21:]), (3, line + "s")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got == {1: line, 2: "", 3: ""}
    # One for the characters of a block in two of the three branches, none for the blocks.
    assert plans["ln-variants"].count("Generate ") == 2


def test_tables_of_near_copies_go_when_they_are_used(spark, docs, monkeypatch):
    left, stored = {}, minhash_dedup.stored

    def seen(df, name):
        left[name] = {os.path.basename(f).rpartition("-")[0] for f in folders if os.path.exists(f)}
        return stored(df, name)

    monkeypatch.setattr(minhash_dedup, "stored", seen)
    with scope() as folders:
        minhash_dedup.near_duplicates(docs)
    assert "mh-signed" not in left["mh-wanted"] and "mh-shared" not in left["mh-wanted"]
    assert not {"mh-signed", "mh-pairs", "mh-blocks", "mh-sets", "mh-reps", "mh-members"} & left["mh-told"]


def test_only_wanted_texts_are_shuffled_for_their_sets(spark, docs):
    signed = minhash_dedup.signatures(docs).filter("n_shingles > 0")
    nodes = signed.filter("doc_id < 100").groupBy(*minhash_dedup.SET).agg(F.min("doc_id").alias("rep")).withColumn(
        "node", F.monotonically_increasing_id())
    nodes = minhash_dedup.stored(nodes, "nodes")
    got = minhash_dedup._full_sets(docs, nodes)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.node for r in nodes.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    exact, bloom = (next(k for k, line in enumerate(plan) if f"Join {kind}" in line) for kind in ("LeftSemi", "LeftOuter"))
    text = next(k for k, line in enumerate(plan) if "text" in line and "LogicalRDD" in line or "text" in line and "LocalRelation" in line)
    assert exact < bloom < text  # the texts meet the filter before the join that shuffles them
