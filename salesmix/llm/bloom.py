"""Blocked Bloom filters as DataFrames: a block is a row of eight 64-bit words.

A key sets two different bits of one block.  Filters have 16 bits a key up to a bound, so
the table that is broadcast has a fixed largest size (2**27 bits are 16 MB of words);
beyond it more keys pass that are not members, never fewer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
BITS_PER_KEY = 16
MAX_FILTER_BITS = 1 << 27
_BLOCK, _BIT0, _BIT1, _WORD = "_bf_block", "_bf_bit0", "_bf_bit1", "_bf_w"


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))


def blocks_for(keys: int, max_bits: int = MAX_FILTER_BITS) -> int:
    """Number of blocks of a filter for so many keys."""
    bits = min(max_bits, 1 << (BITS_PER_KEY * max(1, keys) - 1).bit_length())
    return max(1, bits // (WORDS * 64))


def with_bits(df: DataFrame, key: Column, blocks: int) -> DataFrame:
    """Block and two different bits of a key's hash."""
    wide = WORDS * 64
    h = F.xxhash64(key)
    other = F.xxhash64(h)
    first = F.pmod(other, F.lit(wide))
    step = F.pmod(F.call_function("shiftright", other, F.lit(20)), F.lit(wide - 1)) + 1
    return df.withColumns({_BLOCK: F.pmod(h, F.lit(blocks)), _BIT0: first, _BIT1: F.pmod(first + step, F.lit(wide))})


def bit_table(hashed: DataFrame, least: int) -> DataFrame:
    """Blocks with the bits that at least ``least`` rows have set."""
    often = (hashed.select(_BLOCK, F.explode(F.array(_BIT0, _BIT1)).alias("bit"))
             .groupBy(_BLOCK, "bit").agg(F.count("*").alias("n")).filter(F.col("n") >= least))
    words = [F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, _mask(F.col("bit")))
                      .otherwise(F.lit(0).cast("long"))).alias(f"{_WORD}{w}") for w in range(WORDS)]
    return often.groupBy(_BLOCK).agg(*words)


def looked_up(df: DataFrame, key: Column, table: DataFrame, blocks: int, name: str) -> DataFrame:
    """``df`` with a column that is false for keys that are surely not in the filter."""
    def is_set(bit: str) -> Column:
        word = reduce(lambda rest, w: F.when(F.floor(F.col(bit) / 64) == w, F.col(f"{_WORD}{w}"))
                      .otherwise(rest), range(WORDS), F.lit(None).cast("long"))
        return F.coalesce(word.bitwiseAND(_mask(F.col(bit))), F.lit(0).cast("long")) != 0

    return (with_bits(df, key, blocks).join(F.broadcast(table), _BLOCK, "left")
            .select(*df.columns, (is_set(_BIT0) & is_set(_BIT1)).alias(name)))


def maybe_in(df: DataFrame, key: Column, members: DataFrame, member: Column, name: str) -> DataFrame:
    """``df`` with a column ``name``: whether its key may be among those of a written table."""
    blocks = blocks_for(members.count())
    return looked_up(df, key, bit_table(with_bits(members, member, blocks), 1), blocks, name)
