"""Per-group moments: all the model needs from the facts, in one pass.

Moments are kept centred: number of rows, means, and sums of products of the deviations from
them.  Two such sets merge into that of all their rows without a difference of large
numbers, so residuals keep their digits however far from 0 a response lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import add_diag, upper_triangle
from ..functions.linalg import ROUNDING, list_array, stack
from ..session import stored
from .relational import bounded_chunks, join_with_nulls

GROUP = ["h2", "h1"]
# Up to this many sums an aggregate is planned and compiled quickly; longer vectors
# are summed element by element as rows.
WIDE_SUMS = 40
# Groups whose moments a task holds before it passes them on.
HELD_GROUPS = 4096


def rows_per_level2(d: DataFrame) -> DataFrame:
    return d.groupBy("h2").agg(F.count(F.lit(1)).alias("n"))


def child_count(d: DataFrame) -> DataFrame:
    """Number of different h1 per h2."""
    return d.groupBy("h2").agg(F.count_distinct("h1").alias("n1"))


def group_design_matrix(d: DataFrame, y: str, xs: list[str], keys: list[str] | None = None,
                        chunk_rows: int = 4096) -> DataFrame:
    """Design rows [1, x...] and responses per group, in blocks of bounded size.

    Equal rows are stored once with their number in ``copies``, so neither a large
    group nor a large set of copies ends up in one block.
    """
    keys = keys or GROUP
    columns = ["week", y, *xs]
    unique = stored(d.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("copies")), "design-rows")
    row_text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    chunked = bounded_chunks(unique, keys, row_text, chunk_rows)
    row = F.struct("week", F.col(y).alias("y"), *[F.col(x) for x in xs], "copies")
    blocks = chunked.groupBy(*keys, F.col("chunk").alias("block")).agg(
        F.sort_array(F.collect_list(row)).alias("rows"))
    one = F.lit(1.0)
    return blocks.select(
        *keys, "block",
        F.transform("rows", lambda r: F.array(one, *[r[x] for x in xs])).alias("x_rows"),
        F.transform("rows", lambda r: r["y"]).alias("y"),
        F.transform("rows", lambda r: r["copies"]).alias("copies"))


def _triangle(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def vector_sum(df: DataFrame, keys: list[str], vector: str, size: int) -> DataFrame:
    """Elementwise sum of an array column per key, as array column ``total``.

    Partial sums are made before each shuffle, whatever the number of rows per key.
    """
    if size <= WIDE_SUMS:
        sums = ", ".join(f"sum({vector}[{i}])" for i in range(size))
        return df.groupBy(*keys).agg(F.expr(f"array({sums})").alias("total"))
    return (
        df.select(*keys, F.posexplode(vector).alias("i", "v"))
        .groupBy(*keys, "i").agg(F.sum("v").alias("v"))
        .groupBy(*keys).agg(F.expr(
            "transform(sort_array(collect_list(struct(i, v))), r -> r.v)").alias("total"))
    )


def unpack_triangle(total: str, size: int, rows: range, cols: range):
    """Elements of a symmetric matrix, stored as its upper triangle, as an array."""
    at = {ij: k for k, ij in enumerate(_triangle(size))}
    cells = [f"{total}[{at[min(i, j), max(i, j)]}]" for i in rows for j in cols]
    return F.expr(f"array({', '.join(cells)})")


def group_gram(d: DataFrame, y: str, xs: list[str], keys: list[str] | None = None,
               many_groups: bool = False, shift: float = 0.0) -> DataFrame:
    """n, X'X (row-major), X'y and y'y per group; X starts with a column of ones.

    Beside them the moments they come from: ``mean`` of each x and y, and ``centred``, the
    upper triangle of the sums of products of deviations, y last.  With few drivers this is
    one native aggregate.  With more, tasks reduce their rows batch by batch and pass on one
    set of moments per group, and these are merged.  ``many_groups`` first lays the rows out
    by group, which pays if a task would meet nearly as many groups as rows.  ``shift`` is
    taken from y first.  Rows with a null driver or response are left out and not counted in
    n; ``rows_left_out`` counts them.
    """
    keys = keys or GROUP
    if shift:
        d = d.withColumn(y, F.col(y) - F.lit(float(shift)))
    names = [*xs, y]
    d = d.dropna(subset=names).select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    if 4 * len(_triangle(len(names))) <= WIDE_SUMS:
        moments = _native_moments(d, names, keys)
    else:
        moments = merge_moments(_partial_moments(by_group(d, keys, y) if many_groups else d, names, keys),
                                len(names), keys)
    return moments.select(*keys, "n", *_raw_moments(len(names)), "mean", "centred")


def rows_left_out(d: DataFrame, y: str, xs: list[str], keys: list[str] | None = None) -> DataFrame:
    """Number of rows per group that ``group_gram`` leaves out for a null."""
    some_null = F.greatest(*[F.col(c).isNull() for c in (y, *xs)])
    return d.groupBy(*(keys or GROUP)).agg(F.count_if(some_null).alias("left_out"))


def _raw_moments(q: int) -> list:
    """X'X, X'y and y'y from n, mean and centred of q - 1 drivers and the response."""
    at = {ij: k for k, ij in enumerate(_triangle(q))}

    def cell(i: int, j: int) -> str:  # 0 is the column of ones
        if not i or not j:
            return f"n * mean[{i + j - 1}]" if i or j else "CAST(n AS DOUBLE)"
        i, j = min(i, j) - 1, max(i, j) - 1
        return f"centred[{at[i, j]}] + n * mean[{i}] * mean[{j}]"

    xtx = ", ".join(cell(i, j) for i in range(q) for j in range(q))
    xty = ", ".join(cell(i, q) for i in range(q))
    return [F.expr(f"array({xtx})").alias("xtx"), F.expr(f"array({xty})").alias("xty"),
            F.expr(cell(q, q)).alias("yty")]


def _native_moments(d: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """One aggregate; the engine's covariances are merged as centred moments."""
    z = [f"`{c}`" for c in names]
    products = [f"count(1) * " + (f"var_pop({z[i]})" if i == j else f"covar_pop({z[i]}, {z[j]})")
                for i, j in _triangle(len(z))]
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"array({', '.join(f'avg({c})' for c in z)})").alias("mean"),
        F.expr(f"array({', '.join(products)})").alias("centred"))


def by_group(d: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Rows laid out by key in even partitions; ``spread`` splits a key over several."""
    return d.repartitionByRange(*keys, spread).sortWithinPartitions(*keys)


def merged_moments(n, mean, centred, m, other_mean, other_centred):
    """Moments of the rows of both sides, a stack each: no difference of large sums."""
    upper = np.triu_indices(mean.shape[1])
    total = n + m
    step = other_mean - mean
    share = np.divide(m, total, out=np.zeros(len(total)), where=total > 0)
    spread = (n * share)[:, None] * step[:, upper[0]] * step[:, upper[1]]
    return total, mean + share[:, None] * step, centred + other_centred + spread


def _reduced(codes: np.ndarray, n: np.ndarray, mean: np.ndarray, centred: np.ndarray | float):
    """Moments of each code's rows, codes 0, 1, ... all present; a row may itself be moments."""
    upper = np.triu_indices(mean.shape[1])
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    count = np.add.reduceat(n[order], starts)
    means = np.add.reduceat((n[:, None] * mean)[order], starts) / count[:, None]
    dev = mean - means[codes]
    products = n[:, None] * dev[:, upper[0]] * dev[:, upper[1]] + centred
    return count, means, np.add.reduceat(products[order], starts)


def _group_codes(columns: list[pa.Array]) -> tuple[list[tuple], np.ndarray]:
    """The different keys of a batch, in order of first appearance by code, and each row's code."""
    codes = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        encoded = c.dictionary_encode(null_encoding="encode")
        codes = codes * len(encoded.dictionary) + encoded.indices.to_numpy()
        _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
    return list(zip(*[c.take(pa.array(first)).to_pylist() for c in columns], strict=True)), codes


class _Held:
    """Moments of some groups, which more rows are merged into."""

    def __init__(self, q: int):
        self.q = q
        self.clear()

    def clear(self) -> None:
        self.slots: dict[tuple, int] = {}
        self.n, self.mean, self.centred = np.zeros(0), np.zeros((0, self.q)), np.zeros((0, self.q * (self.q + 1) // 2))

    def add(self, keys: list[tuple], n, mean, centred) -> None:
        at = np.array([self.slots.setdefault(k, len(self.slots)) for k in keys])
        more = len(self.slots) - len(self.n)
        if more:
            self.n, self.mean, self.centred = (np.concatenate([a, np.zeros((more, *a.shape[1:]))])
                                               for a in (self.n, self.mean, self.centred))
        self.n[at], self.mean[at], self.centred[at] = merged_moments(
            self.n[at], self.mean[at], self.centred[at], n, mean, centred)

    def batch(self, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
        columns = zip(*self.slots, strict=True) if self.slots else [[] for _ in types]
        arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
        arrays += [pa.array(self.n.astype(np.int64)), list_array(self.mean), list_array(self.centred)]
        return pa.RecordBatch.from_arrays(arrays, names=[*names, "n", "mean", "centred"])


def _moments_schema(d: DataFrame, keys: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    return ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n long, mean array<double>, centred array<double>"


def _partial_moments(d: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Moments per key and task, or part of a task that meets more than ``HELD_GROUPS`` keys."""
    width = len(keys)

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types = _Held(len(names)), []
        for batch in batches:
            if batch.num_rows:
                types = [batch.column(i).type for i in range(width)]
                found, codes = _group_codes([batch.column(i) for i in range(width)])
                z = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False)
                                     for i in range(width, width + len(names))])
                held.add(found, *_reduced(codes, np.ones(len(z)), z, 0.0))
                if len(held.slots) > HELD_GROUPS:
                    yield held.batch(types, keys)
                    held.clear()
        if held.slots:
            yield held.batch(types, keys)

    return d.select(*keys, *names).mapInArrow(partials, _moments_schema(d, keys))


def merge_moments(partial: DataFrame, q: int, keys: list[str] | None = None) -> DataFrame:
    """One row per key from rows of ``n``, ``mean`` and ``centred`` of parts of its rows.

    Rows of a key pass by in order, so a task holds one batch however many there are.
    """
    keys = keys or GROUP
    width = len(keys)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types = _Held(q), []
        for batch in batches:
            if batch.num_rows:
                types = [batch.column(i).type for i in range(width)]
                found, codes = _group_codes([batch.column(i) for i in range(width)])
                n, mean, centred = (batch.column(width + i) for i in range(3))
                held.add(found, *_reduced(codes, n.to_numpy().astype(float), stack(mean, q),
                                          stack(centred, q * (q + 1) // 2)))
                last = found[codes[-1]]
                kept = held.slots[last]
                rest = [held.n[kept:kept + 1].copy(), held.mean[kept:kept + 1].copy(), held.centred[kept:kept + 1].copy()]
                if len(held.slots) > 1:  # keys before the last are complete
                    out = _Held(q)
                    others = [k for k in held.slots if k != last]
                    at = [held.slots[k] for k in others]
                    out.add(others, held.n[at], held.mean[at], held.centred[at])
                    yield out.batch(types, keys)
                    held.clear()
                    held.add([last], *rest)
        if held.slots:
            yield held.batch(types, keys)

    rows = partial.select(*keys, "n", "mean", "centred").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(merge, _moments_schema(partial, keys))


def sum_vectors(df: DataFrame, vector: str, p: int, keys: tuple[str, ...] = ("h2",)) -> DataFrame:
    return vector_sum(df, list(keys), vector, p).withColumnRenamed("total", f"sum_{vector}")


def sum_outer_products(df: DataFrame, vector: str, mean: str, p: int,
                       keys: tuple[str, ...] = ("h2",)) -> DataFrame:
    """Sum of (b - m)(b - m)' plus p on the diagonal, per key."""
    diff = F.expr(f"zip_with({vector}, {mean}, (b, m) -> b - m)")
    rows = df.select(*keys, diff.alias("diff")).select(
        *keys, upper_triangle("diff", p).alias("tri"))
    sums = vector_sum(rows, list(keys), "tri", p * (p + 1) // 2)
    full = unpack_triangle("total", p, range(p), range(p))
    return sums.select(*keys, add_diag(full, F.lit(float(p)), p).alias("v_j"))


def group_ssr(stats: DataFrame, draws: DataFrame, p: int) -> DataFrame:
    """Squared residuals summed per group, from the centred moments alone.

    The spread of y - b'x about its mean, and that mean's distance from the intercept.  A sum
    below 0 by more than rounding explains means that moments are no moments: an error.
    """
    v = [f"(-draw[{i + 1}])" for i in range(p - 1)] + ["1D"]
    terms = [f"centred[{k}] * {v[i]} * {v[j]}" + (" * 2" if i < j else "")
             for k, (i, j) in enumerate(_triangle(p))]
    level = f"(mean[{p - 1}] - draw[0]" + "".join(f" - draw[{i + 1}] * mean[{i}]" for i in range(p - 1)) + ")"
    rows = join_with_nulls(stats, draws.select(*GROUP, "draw"), GROUP).select(
        *GROUP, "n", F.expr(" + ".join(terms)).alias("spread"),
        F.expr(" + ".join(f"abs({t})" for t in terms)).alias("size"),
        F.expr(f"n * {level} * {level}").alias("level"))
    wrong = F.col("spread") < -ROUNDING * F.col("size")
    message = F.concat(F.lit("negative sum of squares in h2 "), F.coalesce(F.col("h2").cast("string"), F.lit("null")))
    spread = F.when(wrong, F.raise_error(message).cast("double")).otherwise(F.greatest("spread", F.lit(0.0)))
    return rows.select(*GROUP, "n", (spread + F.col("level")).alias("ssr"))


def group_ssr_rows(d: DataFrame, draws: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """The same sum taken over the rows themselves."""
    fit = sum((F.col("draw")[i + 1] * F.col(x) for i, x in enumerate(xs)), F.col("draw")[0])
    return (
        join_with_nulls(d, draws.select(*GROUP, "draw"), GROUP).groupBy(*GROUP)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.col(y) - fit, 2)).alias("ssr"))
    )


def level2_s2(ssr: DataFrame, deflator: float = 1.0) -> DataFrame:
    """Noise variance per h2: squared residuals over the deflated row count."""
    return ssr.groupBy("h2").agg(
        F.sum("n").alias("n"), (F.sum("ssr") / (F.sum("n") / deflator)).alias("s2"))
