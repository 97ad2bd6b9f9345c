"""Exact duplicates by two passes over a blocked Bloom filter, in DataFrame operations only.

Pass one sets, for each text, two bits inside one block of a bit table and keeps only the
bits that two or more rows have set.  Pass two looks every row up in that table.  A row
with a bit set by nobody else has no equal and passes straight through; only the others,
and of them only ids and digests, are shuffled to be grouped by their full SHA-256.

The bit table has 16 bits a row up to ``max_filter_bits``.  Beyond that more rows are
taken for possible copies, which costs a larger shuffle and never changes the result, so
the broadcast has a fixed bound: 2**27 bits are 16 MB of words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmix.llm.bloom import MAX_FILTER_BITS, bit_table, blocks_for, looked_up, with_bits
from salesmix.llm.common import stored, text_or_empty


def exact_duplicates(docs: DataFrame, max_filter_bits: int = MAX_FILTER_BITS,
                     keep: str = "max") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored.  A null text counts as
    empty.  Of equal texts the row with the largest (``keep="min"``: smallest) doc_id
    stays; rows that repeat a doc_id and text are all counted in group_size, and all of
    those with the kept doc_id are kept.  A null doc_id stays only where its text has no
    other.  An empty table gives an empty result.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep must be 'max' or 'min'")
    text = text_or_empty("text")
    rows = docs.select("doc_id", text.alias("text"))
    blocks = blocks_for(rows.count(), max_filter_bits)
    twice = bit_table(with_bits(rows.select("text"), F.col("text"), blocks), 2)
    marked = stored(looked_up(rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "text"), F.col("text"),
                              twice, blocks, "maybe").drop("text"), "exact")
    maybe = marked.filter("maybe").select("doc_id", "text_sha256")
    best = F.max("doc_id") if keep == "max" else F.min("doc_id")
    # Written, so that a text with very many copies is an ordinary skewed join that the
    # engine splits, and not part of the aggregate's own layout.
    groups = stored(maybe.groupBy("text_sha256").agg(
        best.alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"),
        "exact-groups")
    joined = maybe.join(groups, "text_sha256", "left")
    result = ["doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"),
              F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
              (F.col("group_size").isNull()
               | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
              "text_sha256"]
    single = marked.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    return single.unionByName(joined.select(*result))
