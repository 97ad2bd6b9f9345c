"""Geweke convergence diagnostic: early draws of a chain against late draws.

For long chains the statistics of blocks of iterations (number, mean, squared deviations) are
kept in a table.  They merge, so a report on more iterations reads the blocks, and of
the draws only those few that its bounds cut off from a block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import driver_key

CHAIN = ["h2", "h1", "driver"]
SIGNIFICANT = 1.96
BLOCK_ITERATIONS = 10


def explode_draws(draws: DataFrame, drivers: list[str]) -> DataFrame:
    """One row per coefficient of each draw vector; ``drivers`` names the positions."""
    names = F.array(*[F.lit(d) for d in drivers])
    long = draws.select("iter", "h2", "h1", F.posexplode("draw").alias("k", "draw"))
    long = long.withColumn("driver", names[F.col("k")]).drop("k")
    return long.withColumn("driver_key", driver_key(F.col("h2"), F.col("h1"), F.col("driver")))


def _head(raw: int, burn: int) -> Column:
    step = F.col("iter") - burn
    return (step > 0) & (step < 0.1 * (raw - burn))


def _tail(raw: int, burn: int) -> Column:
    return F.col("iter") - burn > 0.6 * (raw - burn)


def filter_draw_head(long: DataFrame, raw_iters: int, burn_in: int = 0) -> DataFrame:
    """Draws in the first tenth after burn-in (strictly below the bound)."""
    return long.where(_head(raw_iters, burn_in))


def filter_draw_tail(long: DataFrame, raw_iters: int, burn_in: int = 0) -> DataFrame:
    """Draws in the last four tenths after burn-in (strictly above the bound)."""
    return long.where(_tail(raw_iters, burn_in))


def _stats(inside: Column | None, draws: float, part: str) -> list[Column]:
    value = F.col("draw") if inside is None else F.when(inside, F.col("draw"))
    return [(F.stddev_pop(value) / draws ** 0.5).alias(f"se_{part}"),
            F.avg(value).alias(f"avg_{part}")]


def _lengths(raw: int, burn: int) -> tuple[float, float]:
    kept = raw - burn
    return 0.1 * kept, kept - 0.6 * kept


def geweke_head(long: DataFrame, raw_iters: int, burn_in: int = 0) -> DataFrame:
    kept = filter_draw_head(long, raw_iters, burn_in)
    return kept.groupBy(*CHAIN).agg(*_stats(None, _lengths(raw_iters, burn_in)[0], "a"))


def geweke_tail(long: DataFrame, raw_iters: int, burn_in: int = 0) -> DataFrame:
    kept = filter_draw_tail(long, raw_iters, burn_in)
    return kept.groupBy(*CHAIN).agg(*_stats(None, _lengths(raw_iters, burn_in)[1], "c"))


def join_geweke_parts(long: DataFrame, raw_iters: int, burn_in: int = 0) -> DataFrame:
    """Head and tail statistics side by side, of chains that have both.

    Both parts come from one conditional aggregate, so there is no join and the long
    draws are shuffled once, as partial sums.
    """
    head, tail = _head(raw_iters, burn_in), _tail(raw_iters, burn_in)
    n_head, n_tail = _lengths(raw_iters, burn_in)
    return (
        long.where(head | tail).groupBy(*CHAIN)
        .agg(*_stats(head, n_head, "a"), *_stats(tail, n_tail, "c"))
        .where(F.col("avg_a").isNotNull() & F.col("avg_c").isNotNull())
    )


def geweke_cd(long: DataFrame, raw_iters: int, burn_in: int = 0) -> DataFrame:
    """The diagnostic per coefficient; null when neither part varies."""
    cd = F.try_divide(F.col("avg_a") - F.col("avg_c"), F.col("se_a") + F.col("se_c"))
    return join_geweke_parts(long, raw_iters, burn_in).withColumn("cd", cd)


def block_of(iteration: Column, size: int = BLOCK_ITERATIONS) -> Column:
    """Iterations 1 to ``size`` are block 0, and so on."""
    return F.floor((iteration - 1) / size).cast("int")


def draw_blocks(long: DataFrame, size: int = BLOCK_ITERATIONS) -> DataFrame:
    """Number, mean and squared deviations of each chain's draws, per block of iterations."""
    return long.groupBy(*CHAIN, block_of(F.col("iter"), size).alias("block")).agg(*_block_stats())


def _block_stats() -> list[Column]:
    n = F.count("draw")
    return [n.alias("n"), F.avg("draw").alias("mean"), (n * F.var_pop("draw")).alias("m2")]


def _merged(parts: Column) -> Column:
    """One struct n, mean, m2 from an array of them."""
    def step(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        d = b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"),
                        (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(F.array_sort(parts), zero, step)


def _cover(low: int, high: int, size: int) -> tuple[tuple[int, int], list[tuple[int, int]]]:
    """Blocks (first, last) wholly inside iterations low..high, and the runs of others in there."""
    first, last = -(-(low - 1) // size), high // size - 1
    if first > last:
        return (0, -1), [(low, high)] if low <= high else []
    ends = [(low, first * size), ((last + 1) * size + 1, high)]
    return (first, last), [(a, b) for a, b in ends if a <= b]


def geweke_from_blocks(blocks: DataFrame, long: DataFrame, raw_iters: int, burn_in: int = 0,
                       size: int = BLOCK_ITERATIONS) -> DataFrame:
    """``geweke_cd`` of iterations up to ``raw_iters`` from stored blocks.

    ``long`` is read only for iterations in no whole block of either part, at most
    ``4 * (size - 1)`` of them, and not at all if there are none.
    """
    kept = raw_iters - burn_in
    ranges = {"a": (burn_in + 1, math.ceil(burn_in + 0.1 * kept) - 1),
              "c": (math.floor(burn_in + 0.6 * kept) + 1, raw_iters)}
    parts = []
    for part, (low, high) in ranges.items():
        (first, last), ends = _cover(low, high, size)
        if first <= last:
            parts.append(blocks.where(F.col("block").between(first, last)).select(
                *CHAIN, F.lit(part).alias("part"), "n", "mean", "m2"))
        for a, b in ends:
            some = long.where(F.col("iter").between(a, b))
            parts.append(some.groupBy(*CHAIN).agg(*_block_stats()).select(
                *CHAIN, F.lit(part).alias("part"), "n", "mean", "m2"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    one = F.struct(F.col("n").cast("double").alias("n"), "mean", "m2")
    # A chain has one struct per block, that is one per ``size`` iterations.
    whole = rows.where("n > 0").groupBy(*CHAIN).agg(
        *[_merged(F.collect_list(F.when(F.col("part") == part, one))).alias(part) for part in ranges])
    lengths = dict(zip(ranges, _lengths(raw_iters, burn_in), strict=True))
    columns = []
    for part, draws in lengths.items():
        s = F.col(part)
        columns += [(F.sqrt(F.try_divide(s["m2"], s["n"])) / draws ** 0.5).alias(f"se_{part}"), s["mean"].alias(f"avg_{part}")]
    both = whole.where("a.n > 0 AND c.n > 0").select(*CHAIN, *columns)
    return both.withColumn("cd", F.try_divide(F.col("avg_a") - F.col("avg_c"), F.col("se_a") + F.col("se_c")))


def filter_significant(cd: DataFrame) -> DataFrame:
    return cd.where(F.abs("cd") > SIGNIFICANT)


def geweke_share(cd: DataFrame) -> DataFrame:
    """Share of coefficients whose diagnostic lies outside the 95 % interval."""
    hits, total = F.count_if(F.abs("cd") > SIGNIFICANT), F.count(F.lit(1))
    return cd.agg(hits.alias("significant"), total.alias("coefficients"),
                  F.try_divide(hits.cast("double"), total).alias("share"))
