"""Connected components by contraction, as Spark jobs on written edge tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmix.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b); component is the smallest id.

    Each round every vertex points at the member of its neighbourhood with the least
    hash, and edges are drawn between what their ends point at, until none is left.
    Hashes change by the round, so the number of vertices falls by a constant factor
    whatever the shape of the graph.  Every round is written, so a lost executor costs
    at most one round; a vertex with very many edges is only ever aggregated or the
    skewed side of a join.  Null ends and loops are ignored.
    """
    def ordered(e: DataFrame) -> DataFrame:
        return (e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .distinct())

    ids = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    e = stored(ordered(ids), "cc-edges")
    chain: DataFrame | None = None
    step = 0
    while not e.isEmpty():
        def rank(c: str, step: int = step):
            return F.struct(F.xxhash64(F.lit(step), F.col(c)).alias("h"), F.col(c).alias("id"))

        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        to = stored(both.groupBy("u").agg(F.min(rank("v")).alias("m"))
                    .select("u", F.least(F.col("m"), rank("u"))["id"].alias("to")), "cc-to")
        if chain is None:
            chain = to.select(F.col("u").alias("id"), F.col("to").alias("root"))
        else:
            chain = stored(chain.join(to, chain["root"] == to["u"], "left")
                           .select("id", F.coalesce("to", "root").alias("root")), "cc-chain")
        left = to.select(F.col("u").alias("a"), F.col("to").alias("ta"))
        right = to.select(F.col("u").alias("b"), F.col("to").alias("tb"))
        e = stored(ordered(e.join(left, "a").join(right, "b")
                           .select(F.col("ta").alias("a"), F.col("tb").alias("b"))), "cc-edges")
        step += 1
    if chain is None:
        return ids.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    smallest = stored(chain.groupBy("root").agg(F.min("id").alias("component")), "cc-root")
    return stored(chain.join(smallest, "root").select("id", "component"), "cc")


def forest(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a link matrix connects, at most one for each row and column."""
    na, nb = linked.shape
    rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    m = linked[np.ix_(rows, cols)]
    la, lb, big = np.arange(len(rows)), np.full(len(cols), na + nb), na + nb + 1
    while len(rows):
        lb2 = np.minimum(lb, np.where(m, la[:, None], big).min(axis=0))
        la2 = np.minimum(la, np.where(m, lb2[None, :], big).min(axis=1))
        if (la2 == la).all() and (lb2 == lb).all():
            break
        la, lb = la2, lb2
    heads = ids_a[rows]
    return ([(int(heads[l]), int(x)) for l, x in zip(la, heads, strict=True)]
            + [(int(heads[l]), int(ids_b[c])) for l, c in zip(lb, cols, strict=True)])


def spanning(edges: np.ndarray) -> np.ndarray:
    """Edges from the least id of each component to its others, for ``edges`` as rows of two ids."""
    ids, ends = np.unique(edges, return_inverse=True)
    ends, label = ends.reshape(-1, 2), np.arange(len(ids))
    while True:
        a, b = label[ends[:, 0]], label[ends[:, 1]]
        if (a == b).all():
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    others = np.flatnonzero(label != np.arange(len(ids)))
    return np.c_[ids[label[others]], ids[others]]
