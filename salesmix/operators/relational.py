"""Selections, keyed groupings and small relational helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

ALL = "- All -"


def project_rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Choose columns and give them report names."""
    return df.select(*[F.col(c).alias(name) for c, name in names.items()])


def price_column(measure: str, smooth: bool) -> str:
    """Name of the smoothed or the plain price column of a measure.

    ``measure`` reads like ``blended_total``; the plain column carries the last valid
    price forward over weeks without sales.
    """
    side, part = measure.rsplit("_", 1)
    return f"{side}_price_{part}" + ("_smooth_supsmu" if smooth else "_smooth")


def choose_price_column(measure: str, smooth: bool) -> Column:
    """The chosen price column, uniformly named."""
    return F.col(price_column(measure, smooth)).alias("price")


def filter_eq_or_all(df: DataFrame, **chosen: str) -> DataFrame:
    """Equality filters; the wildcard entry leaves its column unfiltered."""
    for name, value in chosen.items():
        if value != ALL:
            df = df.where(F.col(name) == value)
    return df


def filter_product(df: DataFrame, dept: str, type_: str) -> DataFrame:
    return df.where((F.col("dept") == dept) & (F.col("type") == type_))


def filter_week_range(df: DataFrame, start, end) -> DataFrame:
    """Weeks from the week of ``start`` to the week of ``end``, both included."""
    from ..functions.calendar import floor_week_sunday

    first, last = (floor_week_sunday(c if isinstance(c, Column) else F.lit(c).cast("date"))
                   for c in (start, end))
    return df.where(F.col("week").between(first, last))


def key_by(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a ``key`` column: one column as it is, several as a struct."""
    key = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
    return df.withColumn("key", key)


def join_with_nulls(left: DataFrame, right: DataFrame, keys: list[str],
                    how: str = "inner") -> DataFrame:
    """Join in which a null key equals a null key; the keys appear once."""
    other = right.withColumnsRenamed({k: f"{k}__right" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"{k}__right")) for k in keys]
    both = left.join(other, on, how)
    whole = [F.coalesce(k, f"{k}__right").alias(k) for k in keys]
    return both.select(*whole, *[c for c in both.columns
                                 if c not in keys and c not in {f"{k}__right" for k in keys}])


def bounded_chunks(df: DataFrame, keys: list[str], row: Column, chunk_rows: int) -> DataFrame:
    """Number each row's chunk inside its key so that chunks stay near ``chunk_rows``.

    ``row`` tells the rows of a key apart.  A key with a third of all rows becomes many
    chunks, so no later task holds a whole key.  A null key is a key like any other.
    """
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("chunks"))
    return (
        join_with_nulls(df, sizes, keys)
        .withColumn("chunk", F.pmod(F.xxhash64(row), F.col("chunks")))
        .drop("chunks")
        .repartition(*keys, "chunk")
    )


def cogroup_by_key(left: DataFrame, right: DataFrame, key: str, value: str,
                   chunk_rows: int = 4096) -> DataFrame:
    """Full outer grouping: the values of both sides per key, in bounded chunks.

    A key's lists are complete over its chunks; a side without rows in a chunk has an
    empty list there.  Values that repeat are counted first and dealt out in runs, so
    their number does not lengthen a list beyond about two chunks.
    """
    def lists(side: DataFrame, name: str) -> DataFrame:
        counted = side.groupBy(key, value).agg(F.count(F.lit(1)).alias("many"))
        runs = counted.select(key, value, "many", F.explode(F.sequence(
            F.lit(0), F.expr(f"(many - 1) div {chunk_rows}"))).alias("run"))
        runs = runs.withColumn("many", F.least(
            F.lit(chunk_rows), F.col("many") - F.col("run") * chunk_rows).cast("int"))
        sizes = side.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("chunks"))
        placed = join_with_nulls(runs, sizes, [key]).withColumn(
            "chunk", F.pmod(F.xxhash64(value, "run"), F.col("chunks")))
        return placed.groupBy(key, "chunk").agg(F.sort_array(F.flatten(
            F.collect_list(F.array_repeat(F.col(value), F.col("many"))))).alias(name))

    both = join_with_nulls(lists(left, "left_values"), lists(right, "right_values"),
                           [key, "chunk"], "full")
    kinds = {"left_values": left.schema[value].dataType, "right_values": right.schema[value].dataType}
    return both.select(key, "chunk", *[
        F.coalesce(F.col(c), F.array().cast(T.ArrayType(kind))).alias(c) for c, kind in kinds.items()])


def join_groups_by_key(left: DataFrame, right: DataFrame,
                       keys: tuple[str, ...] = ("h2", "h1")) -> DataFrame:
    """Two tables of groups side by side; groups that only one has are left out."""
    return join_with_nulls(left, right, list(keys))


def join_count_lookup(groups: DataFrame, counts: DataFrame, key: str = "h2") -> DataFrame:
    """Groups with their upper level's row count."""
    return join_with_nulls(groups, counts, [key])


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def sort_by_week(df: DataFrame, *more: str) -> DataFrame:
    return df.orderBy("week", *more)


def sort_by_key(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


def limit_rows(df: DataFrame, *order: str, n: int) -> DataFrame:
    """The first ``n`` rows in order."""
    return df.orderBy(*order).limit(n)


MEDIAN_BLOCK = 1024


def median_of(df: DataFrame, keys: list[str], value: str, error: float | None = None) -> DataFrame:
    """Exact median per key, by selecting the two middle ranks in sorted value counts.

    Each value of a key is counted and the counts are sorted over range partitions and
    written, so the input is read once.  Sums of counts per partition say which partition
    holds a rank, sums per block of rows in it which block, and only that block's values are
    ranked.  No task sees more of a key than a partition.  ``error`` has no effect any more.
    """
    v = F.col(value)
    counted = df.where(v.isNotNull()).groupBy(*keys, v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    placed = counted.repartitionByRange(*keys, "v").sortWithinPartitions(*keys, "v")
    rows = stored(placed.withColumn("at", F.monotonically_increasing_id()), "median-counts")
    # Rows of a partition are numbered from a multiple of 2^33.
    rows = rows.withColumns({"part": F.floor(F.col("at") / (1 << 33)), "block": F.floor(F.col("at") / MEDIAN_BLOCK)})
    n = F.sum("n").over(Window.partitionBy(*keys))
    sums = rows.groupBy(*keys, "part").agg(F.sum("c").alias("n")).withColumn("all", n)
    ranks = F.array(F.expr("(all + 1) div 2"), F.expr("all div 2 + 1"))
    parts = _holding(sums.select(*keys, "part", "n", F.posexplode(ranks).alias("which", "rank")), keys, "part")
    inside = join_with_nulls(rows, parts, [*keys, "part"])
    sums = inside.groupBy(*keys, "which", "rank", "block").agg(F.sum("c").alias("n"))
    blocks = _holding(sums, keys, "block")
    inside = join_with_nulls(rows, blocks, [*keys, "block"])
    found = _holding(inside.select(*keys, "which", "rank", "v", F.col("c").alias("n")), keys, "v")
    return found.groupBy(*keys).agg((F.sum(F.col("v").cast("double")) / 2).alias("median"))


def _holding(sums: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Of each key and ``which``, the place where the rank is reached, with the rank left there."""
    upto = (Window.partitionBy(*keys, "which").orderBy(place)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = sums.withColumn("upto", F.sum("n").over(upto))
    rest = F.col("rank") - (F.col("upto") - F.col("n"))
    return running.where((rest > 0) & (F.col("rank") <= F.col("upto"))).select(*keys, "which", rest.alias("rank"), place)
