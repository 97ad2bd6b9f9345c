"""Near-duplicate documents by HyperMinHash, with exact confirmation.

A document's distinct five-word shingles are hashed and dealt over 256 buckets.  Of each
bucket's smallest hash a register keeps the number of leading zeros (6 bits) and the next
10 bits; an empty bucket takes the register of the first filled bucket in a fixed random
order of its own.  Bands of four registers are the join keys: at similarity 0.75 a pair
agrees in none of the 64 bands with probability 3e-11.  Sets of fewer than 32 shingles
have, besides, the keys of an exact prefix filter.

Documents with equal sets are one representative.  Within a key all members are first
compared with one centre, in ``ROUNDS`` rounds with another centre each, so a group of near
copies costs pairs in proportion to its size.  A pair is confirmed on full sets if the
collision-corrected estimate of its registers is within six standard errors of the bound
(always, for small sets).

That leaves members outside the component that most of their key belongs to.  By that
component they form families, and a family's outsiders are compared with all its members:
blocks of sets meet blocks of sets inside a task, which returns a spanning forest of the
links it finds and never the pairs.  So no link between components can stay unseen that
any key brings together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmix.llm.bloom import maybe_in
from salesmix.llm.common import discard, settled, stored
from salesmix.llm.components import components, forest
from salesmix.llm.shingles import mix, shingle_sets

BUCKETS, BAND, MANTISSA, ZEROS = 256, 4, 10, 63
SMALL = 32  # sets below this size are also found by a prefix filter
SURE = 64   # sets below this size are confirmed whatever the estimate
ROUNDS, BLOCK = 2, 128
SET = ["n_shingles", "set_a", "set_b"]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Compressed registers of each set, one row a set; a row of zeros for an empty set."""
    sizes = np.array([len(s) for s in sets])
    h = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    slot = np.repeat(np.arange(len(sets)), sizes) * BUCKETS + (h >> np.uint64(56)).astype(np.int64)
    head = np.flatnonzero(np.diff(slot, prepend=-1))  # sets are sorted: least hash of a bucket first
    rest = h[head] << np.uint64(8)
    # Leading zeros from the exponent of a float made of the upper bits only, so that
    # rounding cannot carry into the next power of two.
    upper = (rest >> np.uint64(11)).astype(np.float64)
    zeros = np.minimum(np.where(upper > 0, 53 - np.frexp(upper)[1], ZEROS), ZEROS).astype(np.uint64)
    shift = np.minimum(zeros + np.uint64(1), np.uint64(63))
    tail = (rest << shift) >> np.uint64(64 - MANTISSA)
    out = np.zeros((len(sets), BUCKETS), dtype=np.uint16)
    full = np.zeros((len(sets), BUCKETS), dtype=bool)
    out.ravel()[slot[head]] = ((zeros << np.uint64(MANTISSA)) | tail).astype(np.uint16)
    full.ravel()[slot[head]] = True
    row, column = np.nonzero(~full & (sizes > 0)[:, None])
    step = 0
    given, have = out.copy(), full
    while len(row):
        step += 1
        tried = mix(column.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step)) >> np.uint64(56)
        tried = tried.astype(np.int64)
        hit = have[row, tried]
        out[row[hit], column[hit]] = given[row[hit], tried[hit]]
        row, column = row[~hit], column[~hit]
    return out


def collision_rate(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Chance that registers of different minima are equal, for sets of these sizes."""
    k = np.arange(ZEROS + 1)

    def share(n):
        # A bucket's minimum has k leading zeros or more unless all its hashes have fewer.
        at_least = 1 - (1 - 2.0 ** -k) ** np.maximum(1.0, n / BUCKETS)[:, None]
        return at_least - np.c_[at_least[:, 1:], np.zeros(len(n))]

    return (share(n_a) * share(n_b)).sum(axis=1) / 2 ** MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from equal registers, less what collisions add."""
    c = collision_rate(n_a, n_b)
    return np.clip(((a == b).mean(axis=1) - c) / (1 - c), 0, 1)


def prefix_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Least hashes of a small set, of which any linked set has one among its own."""
    if not 0 < len(s) < SMALL:
        return np.zeros(0, np.int64)
    need = -(-percent * len(s) // 100)
    return mix(s[:len(s) - need + 1]).view(np.int64)


def signatures(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (fingerprint of the set), regs, small."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sets = shingle_sets(b.column("text").to_pylist())
                regs = registers(sets)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), *_prints(sets), pa.array([r.tobytes() for r in regs], pa.binary()),
                     pa.array([prefix_keys(s, percent) for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_a", "set_b", "regs", "small"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, regs binary, small array<long>")


def _keys(signed: DataFrame) -> DataFrame:
    """(key, doc_id): a row for each band and prefix key of each document."""
    width = 2 * BAND
    bands = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS // BAND - 1)),
                        lambda i: F.xxhash64(i, F.substring("regs", i * width + 1, F.lit(width))))
    return signed.select("doc_id", F.explode(F.array_distinct(F.concat(bands, "small"))).alias("key"))


def _promising(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate does not rule out a link."""
    def side(name: str) -> DataFrame:
        return signed.select(F.col("doc_id").alias(name), F.col("regs").alias(f"regs_{name}"),
                             F.col("n_shingles").alias(f"n_{name}"))

    bound = percent / 100
    least = bound - 6 * (bound * (1 - bound) / BUCKETS) ** 0.5

    def run(batches):
        for b in batches:
            if b.num_rows:
                n_a, n_b = (b.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
                regs = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS)
                        for c in ("regs_a", "regs_b")]
                keep = (estimate(*regs, n_a, n_b) >= least) | (np.minimum(n_a, n_b) < SURE)
                keep &= 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
                yield b.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _prints(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and fingerprint of each set: n_shingles, set_a, set_b."""
    a = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    b = np.array([mix(s + np.uint64(1)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    return [pa.array([len(s) for s in sets], pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]


def _full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, shingles): the full set of each node, from a document that has it."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                found = shingle_sets(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), *_prints(found), pa.array([s.tobytes() for s in found], pa.binary())],
                    ["rep", *SET, "shingles"])

    # The Bloom filter spares the texts that nobody asks for a shuffle.
    wanted = nodes.select(F.col("rep").alias("doc_id")).distinct()
    some = maybe_in(docs.select("doc_id", "text"), F.col("doc_id"), nodes, F.col("rep"), "maybe").filter("maybe").drop("maybe")
    some = some.join(wanted, "doc_id", "left_semi")
    rows = some.mapInArrow(run, "rep long, n_shingles long, set_a long, set_b long, shingles binary")
    return rows.join(nodes, [*SET, "rep"]).dropDuplicates([*SET, "rep"]).select(F.col("node").alias("doc_id"), "shingles")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                keep = []
                for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                    x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
            .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
            .mapInArrow(run, "a long, b long"))


def _placed(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members with the component that they are in."""
    return members.join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("component"))


def shared_counts(x: list[np.ndarray], m: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of another."""
    universe, code = np.unique(np.concatenate(x), return_inverse=True)
    owner = np.repeat(np.arange(len(x)), [len(s) for s in x])
    order = np.argsort(code, kind="stable")
    first = np.searchsorted(code[order], np.arange(len(universe) + 1))
    out = np.zeros((len(m), len(x)), dtype=np.int64)
    for k, s in enumerate(m):
        at = np.minimum(np.searchsorted(universe, s), len(universe) - 1)
        at = at[universe[at] == s]
        many = first[at + 1] - first[at]
        run = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out[k] = np.bincount(owner[order[np.repeat(first[at], many) + run]], minlength=len(x))
    return out.T


def _family_links(members: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a key that are in different components."""
    placed = stored(_placed(members, comps), "mh-placed")
    main = stored(placed.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("parts")).filter("parts > 1")
        .select("key", F.col("m.component").alias("family")), "mh-main")
    family = stored(placed.join(main, "key").groupBy("family", "doc_id").agg(
        F.max((F.col("component") != F.col("family")).cast("int")).alias("outside")), "mh-family")
    # Two members have been compared, each being the other's centre.
    sizes = stored(family.groupBy("family").agg(F.count("*").alias("n"), F.sum("outside").alias("x"))
                   .filter("n > 2"), "mh-sizes")
    rows = stored(family.join(sizes, "family").join(sets, "doc_id"), "mh-blocks")

    def blocks(which: DataFrame, size: str, most: int, name: str) -> DataFrame:
        number = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col(size) / most))
        return which.groupBy("family", number.alias(f"{name}_block")).agg(
            F.collect_list(F.struct("doc_id", "shingles")).alias(name))

    both = blocks(rows.filter("outside = 1"), "x", BLOCK // 2, "x").join(blocks(rows, "n", BLOCK, "m"), "family")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                (ids_x, x), (ids_m, m) = (
                    ([r["doc_id"] for r in side], [np.frombuffer(r["shingles"], np.uint64) for r in side])
                    for side in (b.column(c)[k].as_py() for c in ("x", "m")))
                both = shared_counts(x, m)
                n_x, n_m = np.array([len(s) for s in x]), np.array([len(s) for s in m])
                ids_x, ids_m = np.array(ids_x), np.array(ids_m)
                linked = 100 * both >= percent * (n_x[:, None] + n_m[None, :] - both)
                linked &= ids_x[:, None] != ids_m[None, :]
                tree = np.array(forest(linked, ids_x, ids_m), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(tree[:, 0]), pa.array(tree[:, 1])], ["a", "b"])

    spark = members.sparkSession
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row holds two blocks
    try:
        return stored(both.select("x", "m").mapInArrow(run, "a long, b long").filter("a <> b"), "mh-late")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Two documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of
    distinct five-word shingles; component_id is the least doc_id reachable by links.  A
    text without words, or null, has no shingles and no links.  doc_id identifies a row:
    rows with a null doc_id get a null component and are kept, and rows that repeat an id
    are that many documents with one id, each with the links of its own text.  Other
    columns are ignored.
    """
    return settled(docs.sparkSession, "mh", lambda: _near_duplicates(docs, percent))


def _near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    spark = docs.sparkSession
    signed = stored(signatures(docs, percent), "mh-signed")
    ids = stored(signed.select("doc_id", *SET), "mh-ids")
    filled = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # Each distinct set is a node; doc_id names nodes from here on, as two texts may have one id.
    sets = stored(filled.groupBy(*SET).agg(F.min("doc_id").alias("rep"))
                  .withColumn("node", F.monotonically_increasing_id()), "mh-groups")
    reps = stored(filled.withColumnRenamed("doc_id", "rep").join(sets, [*SET, "rep"]).dropDuplicates([*SET, "rep"])
                  .select(F.col("node").alias("doc_id"), "n_shingles", "regs", "small"), "mh-reps")
    discard(signed)  # registers are the bulk of it

    def shared_keys() -> DataFrame:
        shared = stored(_keys(reps).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "mh-shared")
        return _keys(reps).join(shared, "key").select("key", "doc_id")

    # Steps are settled, so that their tables and shuffle files go before the next.
    members = settled(spark, "mh-members", shared_keys)
    wanted = sets.join(members.select(F.col("doc_id").alias("node")).distinct(), "node")
    full = settled(spark, "mh-sets", lambda: _full_sets(docs, stored(wanted, "mh-wanted")))
    links, comps = [], None

    def round_links(step: int) -> DataFrame:
        placed = members.withColumn("component", F.col("doc_id")) if comps is None else stored(
            _placed(members, comps), "mh-placed")
        who = F.struct(F.xxhash64(F.lit(step), "doc_id").alias("h"), F.col("doc_id").alias("id"), "component")
        centres = stored(placed.groupBy("key").agg(F.min(who).alias("c"), F.min("component").alias("x"),
                                                   F.max("component").alias("y"))
                         .filter("x <> y").select("key", F.col("c.id").alias("a"), F.col("c.component").alias("main")),
                         "mh-centres")
        tested = stored(placed.join(centres, "key").filter("component <> main")
                        .select("a", F.col("doc_id").alias("b")).distinct(), "mh-pairs")
        likely = stored(_promising(tested, reps, percent), "mh-likely")
        return _confirmed(likely, full, percent)

    for step in range(ROUNDS):
        links.append(settled(spark, "mh-links", lambda at=step: round_links(at)))
        comps = components(reduce(DataFrame.unionByName, links))
    links.append(settled(spark, "mh-late", lambda: _family_links(members, comps, full, percent)))
    for done in (full, reps, members):
        discard(done)
    first = components(reduce(DataFrame.unionByName, links))
    placed = sets.join(first.withColumnRenamed("id", "node"), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    groups = stored(placed.join(least, "component").select(*SET, "component_id"), "mh-told")
    joined = ids.filter("n_shingles > 0 AND doc_id IS NOT NULL").join(groups, SET, "left").select("doc_id", "n_shingles", "component_id")
    alone = ids.filter("n_shingles = 0 OR doc_id IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
