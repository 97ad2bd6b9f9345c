"""Suffix array of many strings of symbols by the difference-cover algorithm, as Spark jobs.

Strings are rows (sid, path, j, s): symbol s > 0 at place j of string (sid, path).  Of
each string the places with j mod 3 in {1, 2} are sampled.  Their triples of symbols are
sorted and named; names of both classes form two shorter strings each, which are sorted
in the same way; then the other suffixes are ranked by (symbol, rank of the next) and
merged in by counting, for each class pair on the key that both have.

A rank is the number of suffixes that are less, so equal ranks are ties.  After
``levels`` rounds of naming (3**levels symbols) suffixes still equal stay tied.

Sorting is by distinct keys: equal rows are added up before they are shuffled, so a
symbol or suffix with very many copies is one row of the sort.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from salesmix.llm.common import discard, settled, stored

END = -1  # rank of the empty suffix


def cumulate(df: DataFrame, keys: list[str], counts: dict[str, object]) -> DataFrame:
    """For each distinct key: how much of each count belongs to lesser keys (before_...)."""
    names = list(counts)
    summed = df.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in counts.items()))
    ranged = summed.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def running(batches):
        part, done = TaskContext.get().partitionId(), dict.fromkeys(names, 0)
        for b in batches:
            if b.num_rows:
                extra = []
                for n in names:
                    own = b.column(n).to_numpy()
                    upto = own.cumsum() + done[n]
                    done[n] = int(upto[-1])
                    extra.append(pa.array(upto - own))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, *extra, pa.array([part] * b.num_rows, pa.int32())],
                    [*b.schema.names, *(f"before_{n}" for n in names), "part"])

    schema = (", ".join(f"{k} long" for k in [*keys, *names]) + ", "
              + ", ".join(f"before_{n} long" for n in names) + ", part int")
    local = stored(ranged.mapInArrow(running, schema), "sa-order")
    # One row a task of the sort.
    totals = local.groupBy("part").agg(*(F.sum(n).alias(n) for n in names)).orderBy("part").collect()
    starts, done = [], [0] * len(names)
    for row in totals:
        starts.append((row.part, *done))
        done = [d + row[n] for d, n in zip(done, names, strict=True)]
    offsets = df.sparkSession.createDataFrame(
        starts or [(0, *done)], "part int, " + ", ".join(f"start_{n} long" for n in names))
    return local.join(offsets, "part").select(
        *keys, *names, *((F.col(f"before_{n}") + F.col(f"start_{n}")).alias(f"before_{n}") for n in names))


def suffix_ranks(strings: DataFrame, levels: int = 3) -> DataFrame:
    """(sid, path, j, rank) for every row of ``strings`` (sid, path, j, s)."""
    place = ["sid", "path", "j"]
    along = Window.partitionBy("sid", "path").orderBy("j")
    triples = stored(strings.select(
        *place, F.col("s").alias("s0"), F.coalesce(F.lead("s", 1).over(along), F.lit(0)).alias("s1"),
        F.coalesce(F.lead("s", 2).over(along), F.lit(0)).alias("s2"), (F.col("j") % 3).alias("c")), "sa-triples")
    sampled = triples.filter("c > 0")
    key = ["s0", "s1", "s2"]
    names = cumulate(sampled, key, {"n": F.lit(1).cast("long")})
    named = stored(sampled.join(names.select(*key, "n", F.col("before_n").alias("name")), key)
                   .select(*place, "c", "n", "name"), "sa-named")
    if levels <= 1 or named.filter("n > 1").isEmpty():
        ranks = named.select(*place, F.col("name").alias("r"))
    else:
        shorter = named.select("sid", (F.col("path") * 3 + F.col("c")).alias("path"),
                               F.floor(F.col("j") / 3).alias("j"), (F.col("name") + 1).alias("s"))
        deeper = settled(strings.sparkSession, "sa-deeper", lambda: suffix_ranks(shorter, levels - 1))
        ranks = deeper.select("sid", F.floor(F.col("path") / 3).alias("path"),
                              (F.col("j") * 3 + F.col("path") % 3).alias("j"), F.col("rank").alias("r"))
    ranks = stored(ranks, "sa-ranks")
    discard(named)

    def ahead(step: int) -> DataFrame:
        return ranks.select("sid", "path", (F.col("j") - step).alias("j"), F.col("r").alias(f"r{step}"))

    known = stored(triples.join(ranks, place, "left").join(ahead(1), place, "left").join(ahead(2), place, "left").select(
        *place, "c", "s0", "s1", "r", F.coalesce("r1", F.lit(END)).alias("r1"),
        F.coalesce("r2", F.lit(END)).alias("r2")), "sa-known")

    def of(c: int):
        return (F.col("c") == c).cast("long")

    # A zero-class suffix and one of class 1 both have a sampled suffix next to the first
    # symbol; a zero-class suffix and one of class 2, after the second.
    by_one = cumulate(known.filter("c <> 2"), ["s0", "r1"], {"zero": of(0), "one": of(1)})
    by_two = cumulate(known.filter("c <> 1"), ["s0", "s1", "r2"], {"zero": of(0), "two": of(2)})
    one = by_one.select("s0", "r1", F.col("before_zero").alias("z1"), F.col("before_one").alias("o1"))
    two = by_two.select("s0", "s1", "r2", F.col("before_zero").alias("z2"), F.col("before_two").alias("t2"))
    merged = known.join(one, ["s0", "r1"], "left").join(two, ["s0", "s1", "r2"], "left")
    rank = (F.when(F.col("c") == 0, F.col("z1") + F.col("o1") + F.col("t2"))
            .when(F.col("c") == 1, F.col("r") + F.col("z1")).otherwise(F.col("r") + F.col("z2")))
    return merged.select(*place, rank.alias("rank"))
