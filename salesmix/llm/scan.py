"""Row numbers and running sums over a whole sorted table, without a task that holds it.

Rows are sorted by a range partitioning and written; the place of a row is its place in its
task plus the rows of the tasks before, one number a task.  Running sums go by blocks of
``BLOCK`` rows: inside each block, then over the blocks' totals in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesmix.llm.common import stored

BLOCK = 1024
_TASK = 1 << 33  # rows a task can number


def numbered(df: DataFrame, order: list[str], name: str, store: str) -> DataFrame:
    """``df`` written in ``order`` with the place of each row, from 0, as long column ``name``.

    Rows equal in ``order`` get neighbouring places in any order; they are dealt over tasks, so
    equal rows may be of any number.  Nulls come first.
    """
    tie, at = f"{name}_tie", f"{name}_at"
    rows = df.withColumn(tie, F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).drop(tie)
    rows = stored(rows.withColumn(at, F.monotonically_increasing_id()), store)
    task = F.floor(F.col(at) / _TASK).cast("int")
    before, starts = 0, []
    # One row a task.
    for r in rows.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect():
        starts.append((r.task, before))
        before += r.n
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], f"{name}_task int, {name}_start long")
    return (rows.withColumn(f"{name}_task", task).join(F.broadcast(offsets), f"{name}_task")
            .withColumn(name, F.col(f"{name}_start") + F.col(at) % _TASK)
            .drop(f"{name}_task", f"{name}_start", at))


def running(df: DataFrame, place: str, n_rows: int, totals: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with running totals by ``place`` (0 to n_rows - 1, each once), the row's own included.

    ``totals`` maps a new column to (column, aggregate function); the functions are "sum" and
    "bit_xor", whose value over two runs of rows follows from that of each.
    """
    block = f"{place}_block"
    inside = Window.partitionBy(block).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn(block, F.floor(F.col(place) / BLOCK).cast("long"))
    if n_rows <= BLOCK:
        return rows.withColumns({k: F.expr(f"{f}({c})").over(inside) for k, (c, f) in totals.items()}).drop(block)
    blocks = -(-n_rows // BLOCK)
    sums = rows.groupBy(block).agg(*[F.expr(f"{f}({c})").alias(f"{k}_part") for k, (c, f) in totals.items()])
    upto = running(sums, block, blocks, {f"{k}_upto": (f"{k}_part", f) for k, (_, f) in totals.items()})
    before = {f"{k}_before": _minus(F.col(f"{k}_upto"), F.col(f"{k}_part"), f) for k, (_, f) in totals.items()}
    upto = upto.select(block, *[c.alias(k) for k, c in before.items()])
    rows = rows.withColumns({k: F.expr(f"{f}({c})").over(inside) for k, (c, f) in totals.items()})
    return rows.join(upto, block).withColumns(
        {k: _plus(F.col(k), F.col(f"{k}_before"), f) for k, (_, f) in totals.items()}).drop(block, *before)


def _plus(a: Column, b: Column, f: str) -> Column:
    return a + b if f == "sum" else a.bitwiseXOR(b)


def _minus(a: Column, b: Column, f: str) -> Column:
    return a - b if f == "sum" else a.bitwiseXOR(b)
