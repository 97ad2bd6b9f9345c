"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame operations only.

Two lines are the same when their edit distance is at most one.  Deletion variants are
hashed keys that are equal where two lines have a deletion in common:

1. Halves: a line without its left or without its right half.  Of two lines one edit apart
   one half is untouched, so a line that shares neither with another line is alone.
2. Blocks: a remaining line without one block of 16 characters, for each block.
3. Characters: a remaining block without one character, for each character.  Equal variants
   with the character gone from the same place are one substitution apart; a variant equal
   to a whole block is one insertion apart.

Steps one and two only leave out lines and blocks that cannot have a partner, so the third
step's join finds every pair.  Rows that a join would only throw away are kept from its
shuffle by Bloom filters of the smaller side.  In it each line meets the earliest member of a variant, not
every other, and that pair's edit distance is verified on the lines.  No step makes pairs
within a group; counts and minima are added up before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmix.llm.bloom import maybe_in
from salesmix.llm.common import settled, stored, unused_name

MIN_CHARS, BLOCK = 10, 16


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, n, lid, line): trimmed lines long enough to be compared, and their digests."""
    line = F.trim("raw")
    return (docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
            .select("doc_id", "n", line.alias("line")).filter(F.length("line") >= min_chars)
            .select("doc_id", "n", F.unhex(F.md5("line")).alias("lid"), "line"))


def _end(line: Column, chars: Column) -> Column:
    return F.substring(line, F.length(line) - chars + 1, chars)


def _half_keys(line: Column) -> Column:
    """For the shorter and the longer of two lines: what is left of each without a half."""
    keys = []
    for base in (F.length(line), F.length(line) - 1):
        half = F.floor(base / 2).cast("int")
        keys += [F.xxhash64(base, F.lit("head"), F.substring(line, F.lit(1), half)),
                 F.xxhash64(base, F.lit("tail"), _end(line, base - half))]
    return F.array(*keys)


def _block_keys(line: Column) -> Column:
    """(key, base, x): a line without each of its blocks, and the block x."""
    def of(base: Column) -> Column:
        last = (F.ceil(base / BLOCK) - 1).cast("int")

        def one(k: Column) -> Column:
            tail = F.greatest(base - (k + 1) * BLOCK, F.lit(0))
            head = F.substring(line, F.lit(1), k * BLOCK)
            x = F.substring(line, k * BLOCK + 1, F.length(line) - k * BLOCK - tail)
            return F.struct(F.xxhash64(base, k, head, _end(line, tail)).alias("key"), base.alias("base"), x.alias("x"))

        return F.transform(F.sequence(F.lit(0), last), one)

    return F.concat(of(F.length(line)), of(F.length(line) - 1))


def _shared(keyed: DataFrame, name: str) -> DataFrame:
    """Keys that at least two different lines have."""
    return stored(keyed.groupBy("key").agg(F.min("lid").alias("x"), F.max("lid").alias("y"))
                  .filter("x <> y").select("key"), name)


def near_lines(lines: DataFrame) -> DataFrame:
    """(lid): lines with an earlier line one edit away.  ``lines``: lid, line, first."""
    blocks = lines.select("lid", "first", F.length("line").alias("size"), F.explode(_block_keys(F.col("line"))).alias("b")) \
        .select("lid", "first", "size", "b.*")
    # Read three times below; making the keys is the dearest step, so they are kept.
    kept = stored(blocks.join(_shared(blocks.select("lid", "key"), "ln-blocks"), "key"), "ln-kept")

    def variants(tag: str, with_place: bool) -> Column:
        def one(i: Column) -> Column:
            rest = F.concat(F.substring("x", F.lit(1), i - 1), F.substring(F.col("x"), i + 1, F.lit(BLOCK + 2)))
            parts = [F.lit(tag), rest] + ([i, F.length("x")] if with_place else [])
            return F.xxhash64("key", *parts)
        return F.transform(F.sequence(F.lit(1), F.length("x")), one)

    def rows(role: str, keys: Column, which: Column) -> DataFrame:
        return kept.filter(which & (F.length("x") > 0)).select(
            "lid", "first", F.lit(role).alias("role"), F.explode(keys).alias("variant"))

    shorter, longer = F.col("base") == F.col("size"), F.col("base") < F.col("size")
    # An empty block of the shorter line has no variant but stands for itself.
    whole = kept.filter(shorter).select("lid", "first", F.lit("whole").alias("role"),
                                        F.xxhash64("key", F.lit("gap"), "x").alias("variant"))
    found = stored(rows("swap", variants("swap", True), shorter).unionByName(whole)
                   .unionByName(rows("less", variants("gap", False), longer)), "ln-variants")
    who = F.struct("first", "lid")
    groups = stored(found.groupBy("variant").agg(
        F.count("*").alias("many"), *(F.min(F.when(F.col("role") == r, who)).alias(r) for r in ("swap", "whole", "less")))
        .filter("many > 1"), "ln-groups")
    other = (F.when(F.col("role") == "swap", F.col("g.swap")).when(F.col("role") == "whole", F.col("g.less"))
             .otherwise(F.col("g.whole")))
    partners = (found.alias("f").join(groups.alias("g"), "variant").select("f.lid", "f.first", other.alias("o"))
                .filter("o IS NOT NULL AND o.first < first").select("lid", F.col("o.lid").alias("earlier")).distinct())
    text = lines.select("lid", "line")
    return (stored(partners, "ln-partners").join(text, "lid").withColumnRenamed("line", "a")
            .join(text.select(F.col("lid").alias("earlier"), F.col("line").alias("b")), "earlier")
            .filter(F.levenshtein("a", "b", 1).between(0, 1)).select("lid").distinct())


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, removed, n_near): numbers of the lines to remove, for documents that have any.

    A line is removed if a line within one edit of it comes earlier, in the order of
    (doc_id, line number); n_near counts those that have no earlier exact copy.
    """
    lines = stored(_lines(docs.select("doc_id", "text").filter("doc_id IS NOT NULL"), min_chars), "ln-lines")
    places = lines.select("doc_id", "n", "lid")
    firsts = stored(places.groupBy("lid").agg(
        F.min(F.struct("doc_id", "n")).alias("first"), F.count("*").alias("many")), "ln-firsts")
    halves = lines.select("lid", F.explode(F.array_distinct(_half_keys(F.col("line")))).alias("key"))
    shared = _shared(halves, "ln-halves")
    likely = stored(maybe_in(halves, F.col("key"), shared, F.col("key"), "may").filter("may")
                    .join(shared, "key").select("lid").distinct(), "ln-likely")
    origin = stored(maybe_in(firsts, F.col("lid"), likely, F.col("lid"), "may").filter("may").join(likely, "lid").select(
        F.col("first.doc_id").alias("doc_id"), F.col("first.n").alias("n"), "first"), "ln-origin")
    place = F.struct("doc_id", "n")
    texts = stored(maybe_in(lines, place, origin, place, "may").filter("may").join(origin, ["doc_id", "n"])
                   .dropDuplicates(["doc_id", "n"])
                   .select("lid", "line", "first"), "ln-texts")
    near = near_lines(texts).withColumn("near", F.lit(True))
    told = stored(firsts.join(near, "lid", "left").filter("many > 1 OR near"), "ln-told")
    again = (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.n") != F.col("n"))
    drops = stored(maybe_in(places, F.col("lid"), told, F.col("lid"), "may").filter("may").join(told, "lid").filter(again | F.col("near"))
                   .select("doc_id", "n", (~again).cast("long").alias("near")), "ln-drops")
    return drops.groupBy("doc_id").agg(F.collect_set("n").alias("removed"), F.sum("near").alias("n_near"))


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS,
                           counts: bool = False) -> DataFrame:
    """``docs`` with the later of lines within one edit of each other taken out.

    Lines end at a line feed and are compared without spaces around them; those of fewer
    than ``min_chars`` characters always stay.  All rows and columns are kept; a text may
    become empty, and a null text stays null.  Rows that repeat a doc_id are one place, so
    they do not take lines from each other; a null doc_id is left alone.  ``counts`` adds
    n_lines, n_removed and n_near.  Columns of ``docs`` with those names must not exist then.
    """
    mark, near = unused_name(docs, "removed"), unused_name(docs, "n_near")
    found = settled(docs.sparkSession, "ln-found", lambda: repeated_lines(docs, min_chars).select(
        "doc_id", F.col("removed").alias(mark), F.col("n_near").alias(near)))
    may = unused_name(docs, "may")
    split = maybe_in(docs, F.col("doc_id"), found, F.col("doc_id"), may)
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(mark), i))
    # Documents that lose no line are not shuffled.
    whole = split.filter(~F.col(may)).withColumns({c: F.lit(None).cast(found.schema[c].dataType) for c in (mark, near)})
    # ``found`` grows with the corpus, so the same join is used at every size.
    out = split.filter(may).join(found.hint("merge"), "doc_id", "left").unionByName(whole)
    text = F.when(F.col(mark).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
    more = [F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
            F.when(F.col(mark).isNull(), 0).otherwise(F.size(mark)).cast("long").alias("n_removed"),
            F.coalesce(near, F.lit(0)).cast("long").alias("n_near")] if counts else []
    return out.select(*(text if c == "text" else F.col(c) for c in docs.columns), *more)
