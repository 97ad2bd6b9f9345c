"""Ranks and prefix sums along a linked list whose items are rows.

Each round deals the items that are left over tasks of bounded size, by ranges of their id,
and each task joins the runs of successors that it holds: the first item of a run stays for
the next round with the sums of the run, the others keep their first item and their sums
since it.  That takes out nearly all if successors mostly have near ids.  A round that took
out less than half is followed by one that takes out the items whose random priority is
below both neighbours', a third of any list.  The rounds are then read back: the sums before
an item are those before the first item of its run plus its own inside the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmix.llm.common import stored

TASK_ITEMS = 1 << 18  # items that one task holds, some 40 bytes each and sum
NONE = -1


def _runs(ids: np.ndarray, following: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of items in ascending id: the first of each one's run, the last of each run at its first, sums before each."""
    n = len(ids)
    at = np.searchsorted(ids, following)
    at[at == n] = 0
    here = ids[at] == following
    before = np.full(n, NONE)
    before[at[here]] = np.flatnonzero(here)
    # Pointer jumping towards the first item: sums[k] is what the items from first[k] to before k add up to.
    first = np.where(before == NONE, np.arange(n), before)
    inside = np.where((before == NONE)[:, None], 0, sums[first])
    while True:
        further = first[first]
        if np.array_equal(further, first):
            break
        inside = inside + inside[first]
        first = further
    last = np.zeros(n, np.int64)
    ends = np.flatnonzero(~here)
    last[first[ends]] = ends
    return first, last, inside


def _contract(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        ids, following = (held[c].to_numpy() for c in ("id", "following"))
        order = np.argsort(ids)
        ids, following = ids[order], following[order]
        sums = np.column_stack([held[c].to_numpy()[order] for c in names])
        first, last, inside = _runs(ids, following, sums)
        is_first = first == np.arange(len(ids))
        whole = np.where(is_first[:, None], inside[last] + sums[last], 0)
        columns = [ids, ids[first], np.where(is_first, following[last], NONE)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (*columns, *whole.T, *inside.T)],
            ["id", "first", "following", *names, *[f"{c}_inside" for c in names]])

    return run


def _thin(items: DataFrame, names: list[str], turn: int) -> DataFrame:
    """One round in which an item joins its predecessor if its priority is below both neighbours'."""
    priority = F.xxhash64(F.col("id"), F.lit(turn))
    rows = items.withColumn("priority", priority)
    back = rows.select(F.col("following").alias("id"), F.col("id").alias("before"), F.col("priority").alias("p_before"))
    ahead = rows.select(F.col("id").alias("following"), F.col("priority").alias("p_after"))
    rows = rows.join(back, "id", "left").join(ahead, "following", "left")
    goes = F.coalesce((F.col("priority") < F.col("p_before")) & (F.col("priority") < F.coalesce("p_after", F.lit((1 << 63) - 1))), F.lit(False))
    rows = stored(rows.withColumn("goes", goes), "ranking-priorities")
    gone = rows.filter("goes").select(F.col("before").alias("id"), F.col("id").alias("taken"), F.col("following").alias("then"),
                                      *[F.col(c).alias(f"{c}_taken") for c in names])
    stay = rows.filter("NOT goes").join(gone, "id", "left")
    zero = [F.lit(0).cast("long").alias(f"{c}_inside") for c in names]
    firsts = stay.select("id", F.col("id").alias("first"), F.coalesce("then", "following").alias("following"),
                         *[(F.col(c) + F.coalesce(f"{c}_taken", F.lit(0))).alias(c) for c in names], *zero)
    taken = rows.filter("NOT goes").join(gone, "id").select(
        F.col("taken").alias("id"), F.col("id").alias("first"), F.lit(NONE).cast("long").alias("following"),
        *[F.lit(0).cast("long").alias(c) for c in names], *[F.col(c).alias(f"{c}_inside") for c in names])
    return firsts.unionByName(taken)


def prefix_sums(items: DataFrame, sums: list[str], task_items: int = TASK_ITEMS) -> DataFrame:
    """id and, for each column of ``sums``, what the items before it in the list add up to.

    ``items`` has id (long, different, not below 0), following (id of the next item, null or -1
    at the end of a list) and whole-number columns.  Several lists may share a table.  A
    table without rows gives none.
    """
    left = items.select("id", F.coalesce("following", F.lit(NONE)).cast("long").alias("following"),
                        *[F.col(c).cast("long").alias(c) for c in sums])
    shape = ", ".join(["id long, first long, following long", *[f"{c} long" for c in sums],
                       *[f"{c}_inside long" for c in sums]])
    left, rounds, thin = stored(left, "ranking-items"), [], False
    n, links = left.count(), left.filter(F.col("following") != NONE).count()
    while links:
        if thin:
            done = _thin(left, sums, len(rounds))
        else:
            tasks = -(-n // task_items)
            dealt = left.repartitionByRange(tasks, "id") if tasks > 1 else left.coalesce(1)
            done = dealt.mapInArrow(_contract(sums), shape)
        done = stored(done, "ranking-round")
        rounds.append(done)
        left = done.filter("id = first").select("id", "following", *sums)
        before, n = n, left.count()
        links = left.filter(F.col("following") != NONE).count()
        thin = not thin and 2 * n > before
    # Each item that is left is a whole list, of which it is the first.
    known = left.select("id", *[F.lit(0).cast("long").alias(c) for c in sums])
    for done in rounds[::-1]:
        begin = known.select(F.col("id").alias("first"), *[F.col(c).alias(f"{c}_begin") for c in sums])
        inner = done.select("id", "first", *[f"{c}_inside" for c in sums])
        known = inner.join(begin, "first").select(
            "id", *[(F.col(f"{c}_inside") + F.col(f"{c}_begin")).alias(c) for c in sums])
    return known
