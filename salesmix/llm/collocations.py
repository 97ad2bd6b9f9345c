"""Phrases whose words go together, mined with sorted occurrence relations (SETM).

The relation of length k has a row for each occurrence of a phrase of k words that may be
frequent: piece, position, phrase.  It is written in blocks of documents of one language,
sorted by position and compressed; a piece of text ends where positions are not adjacent.
Phrases are counted in two passes, as most of them are rare.  First a sorted list of 32-bit
hashes with counts, of a few bytes a phrase, goes from each task to each part of the hashes;
what no part finds often enough is no frequent phrase.  The others make a Bloom filter of
bounded size that every task holds; what passes it, some rare phrases too, is counted exactly,
by a grouping of the phrases themselves, added up in a task before they leave it.  The relation is semi-joined by the same filter and
then merge-joined with itself at adjacent positions of a piece: two phrases that overlap in
all but their ends make one of k + 1 words.  What passes the filter wrongly is counted like
the rest and falls out there, because a phrase is no more frequent than its parts.  A relation
is removed when the next one is written.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesmix.llm.common import discard, rows_a_batch, settled, stored
from salesmix.llm.shingles import mix

LONGEST, LEAST, TOP = 5, 100, 2000
BLOCK_WORDS = 1 << 19  # words in a block, or a little more: a document is in one block
HELD_BLOCKS = 4  # words of all unfinished blocks of a task, in blocks
BITS_A_PHRASE, MOST_SLICES, SLICE_BITS = 16, 64, 1 << 21  # of the filter: 16 MB at most
HASH_BITS = 32  # of the first count; equal hashes of two phrases let both into the second
HELD, PART = 1 << 20, 1 << 20  # hashes that a task holds before they go, and of all tasks in a part
THINNED = 1 << 17  # phrases that a task holds before it adds them up
_BREAK = -1
# A-Z become a-z, tab parts words like space, the others part pieces.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 10)


class _Words(dict):
    """Numbers of words in order of first use; an empty word is -2, the end of a piece -1."""

    def __init__(self):
        super().__init__({b"": _BREAK - 1, b"\n": _BREAK})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 2
        return number


class _Block:
    """Word numbers of documents of one language."""

    def __init__(self):
        self.words, self.items, self.size = _Words(), [], 0

    def add(self, text: str) -> None:
        parts = text.encode().translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
        items = np.fromiter(map(self.words.__getitem__, parts), np.int32, len(parts))
        items = items[items >= _BREAK]
        self.size += int(np.count_nonzero(items >= 0))
        self.items += [items, np.array([_BREAK], np.int32)]


_FIRST = "block long, lang string, n long, items binary, phrases binary, counts array<long>"


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from -1 up, compressed: width and number of bytes, then the values plus 1, all first bytes before all second ones."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if int(values.max(initial=-1)) + 2 <= 1 << 8 * int(k[2]))
    raw = np.ascontiguousarray((values + 1).astype(kind).view(np.uint8).reshape(len(values), int(kind[2])).T).tobytes()
    return struct.pack("<BQ", int(kind[2]), len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    width, size = struct.unpack_from("<BQ", data)
    raw = np.frombuffer(pa.decompress(data[9:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, size // width).T).view(f"<u{width}").ravel().astype(np.int64) - 1


def _packed_text(phrases: list[str]) -> bytes:
    """Phrases, which hold no line ends, compressed: number of bytes, then a line each."""
    raw = "".join(p + "\n" for p in phrases).encode()
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked_text(data: bytes) -> list[str]:
    raw = pa.decompress(data[8:], decompressed_size=struct.unpack_from("<Q", data)[0], codec="zstd", asbytes=True)
    return raw.decode().split("\n")[:-1]


def _first_relation(block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, unfinished, held = TaskContext.get().partitionId() << 33, {}, 0

        def row(lang: str) -> pa.RecordBatch:
            nonlocal number, held
            block = unfinished.pop(lang)
            held -= block.size
            items = np.concatenate(block.items)
            counts = np.bincount(items[items >= 0], minlength=len(block.words) - 2)
            number += 1
            return pa.RecordBatch.from_pydict({
                "block": pa.array([number - 1], pa.int64()), "lang": pa.array([lang]), "n": pa.array([block.size], pa.int64()),
                "items": pa.array([_packed(items)], pa.binary()),
                "phrases": pa.array([_packed_text([w.decode() for w in list(block.words)[2:]])], pa.binary()),
                "counts": pa.ListArray.from_arrays([0, len(counts)], pa.array(counts.astype(np.int64)))})

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                block = unfinished.setdefault(lang, _Block())
                held -= block.size
                block.add(text)
                held += block.size
                if block.size >= block_words:
                    yield row(lang)
                elif held >= HELD_BLOCKS * block_words:
                    for each in list(unfinished):
                        yield row(each)
        for each in list(unfinished):
            yield row(each)

    return run


def _hashes(lang: str, phrases: list[str]) -> np.ndarray:
    """A hash of HASH_BITS of each phrase with its language."""
    own = pd.util.hash_array(np.array(phrases, dtype=object), categorize=False)
    of_lang = pd.util.hash_array(np.array([lang], dtype=object)) * np.uint64(0x9E3779B97F4A7C15)
    return pd.util.hash_array(own ^ of_lang) >> np.uint64(64 - HASH_BITS)


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, ascending, and the sum of each one's counts."""
    h = np.concatenate(hashes)
    order = np.argsort(h)
    h, n = h[order], np.concatenate(counts)[order]
    head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[head], np.add.reduceat(n, head)


def _dealt(parts: int):
    """Sorted hashes with their counts, a row for each part of the hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            h, n = _summed(hashes, counts)
            part = (h * np.uint64(parts)) >> np.uint64(HASH_BITS)
            head = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ranges = list(zip(head.tolist(), [*head[1:].tolist(), len(h)], strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(part[head].astype(np.int64)), pa.array(h[head].astype(np.int64)),
                 pa.array([_packed(np.diff(h[a:z].astype(np.int64))) for a, z in ranges], pa.binary()),
                 pa.array([_packed(n[a:z]) for a, z in ranges], pa.binary())], ["part", "first", "steps", "counts"])

        for batch in batches:
            for row in range(batch.num_rows):
                phrases = _unpacked_text(batch.column("phrases")[row].as_py())
                if phrases:
                    hashes.append(_hashes(batch.column("lang")[row].as_py(), phrases))
                    counts.append(batch.column("counts")[row].values.to_numpy())
                if sum(map(len, hashes)) >= HELD:
                    yield rows()
                    hashes, counts = [], []
        if hashes:
            yield rows()

    return run


def _possible(relation: DataFrame, least: int) -> DataFrame:
    """h: the hashes under which phrases of a relation occur often enough, those of all frequent ones among them."""
    found = relation.agg(F.sum(F.size("counts")).alias("n")).first().n or 0
    dealt = relation.select("lang", "phrases", "counts").mapInArrow(
        _dealt(max(1, -(-found // PART))), "part long, first long, steps binary, counts binary")

    def often(group: pa.Table) -> pa.Table:
        rows = group.select(["first", "steps", "counts"]).to_pylist()
        h, n = _summed([r["first"] + np.cumsum(np.r_[0, _unpacked(r["steps"])]) for r in rows],
                       [_unpacked(r["counts"]) for r in rows])
        return pa.table({"h": pa.array(h[n >= least], pa.int64())})

    return dealt.groupBy("part").applyInArrow(often, "h long")


def _places(h: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slice of the filter and two bits in it."""
    bits, h = np.uint64(SLICE_BITS), mix(h.astype(np.uint64))
    return (h >> np.uint64(48)) % np.uint64(slices), h % bits, (h >> np.uint64(21)) % bits


class Filter:
    """Hashes of phrases as bits, in slices that tasks make independently."""

    def __init__(self, possible: DataFrame):
        """``possible``: a written table of h."""
        n = possible.count()
        wanted = -(-n * BITS_A_PHRASE // SLICE_BITS)
        self.slices = slices = min(MOST_SLICES, 1 << max(0, wanted - 1).bit_length())

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    at = _places(b.column("h").to_numpy(), slices)
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in at], ["slice", "x", "y"])

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[int, np.ndarray] = {}
            for b in batches:
                which, x, y = (b.column(c).to_numpy() for c in ("slice", "x", "y"))
                for k in np.unique(which).tolist():
                    mine = made.setdefault(k, np.zeros(SLICE_BITS, bool))
                    mine[x[which == k]] = mine[y[which == k]] = True
            for k, mine in made.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(mine).tobytes()])], ["slice", "bits"])

        rows = (possible.mapInArrow(hashed, "slice int, x int, y int")
                .repartition(slices, "slice").mapInArrow(bits, "slice int, bits binary").collect())
        # At most MOST_SLICES rows of SLICE_BITS bits.
        self.bits = np.zeros((slices, SLICE_BITS // 8), np.uint8)
        for r in rows:
            self.bits[r.slice] = np.frombuffer(r.bits, np.uint8)

    def may_hold(self, lang: str, phrases: list[str]) -> np.ndarray:
        if not phrases:
            return np.zeros(0, bool)
        which, x, y = _places(_hashes(lang, phrases), self.slices)

        def is_set(bit: np.ndarray) -> np.ndarray:
            return (self.bits[which, bit >> np.uint64(3)] >> (7 - (bit & np.uint64(7))).astype(np.uint8)) & 1 == 1

        return is_set(x) & is_set(y)


_NEXT = "block long, lang string, positions binary, items binary, phrases binary, counts array<long>"


def _extend(shared: Broadcast):
    """The next relation of each block, from this one and the filter of its frequent phrases."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, lang, places, items, phrases = (
                    batch.column(c)[row].as_py() for c in ("block", "lang", "positions", "items", "phrases"))
                items, phrases = _unpacked(items), _unpacked_text(phrases)
                kept = np.r_[shared.value.may_hold(lang, phrases), False]  # the last is for ends of pieces
                at = np.flatnonzero(kept[items])
                mine = items[at]
                places = np.cumsum(_unpacked(places))[at] if places is not None else at
                # The merge join: a row and the one that begins a word later.
                meets = np.flatnonzero(np.diff(places) == 1)
                pairs, found, counts = np.unique(mine[meets] * len(phrases) + mine[meets + 1], return_inverse=True, return_counts=True)
                if len(pairs):
                    longer = [phrases[x] + " " + phrases[y].rpartition(" ")[2]
                              for x, y in zip((pairs // len(phrases)).tolist(), (pairs % len(phrases)).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int64()), pa.array([lang]), pa.array([_packed(np.diff(places[meets], prepend=0))], pa.binary()),
                         pa.array([_packed(found)], pa.binary()), pa.array([_packed_text(longer)], pa.binary()),
                         pa.ListArray.from_arrays([0, len(counts)], pa.array(counts.astype(np.int64)))],
                        ["block", "lang", "positions", "items", "phrases", "counts"])

    return run


def _thinned(shared: Broadcast):
    """The phrases that may be frequent, with their occurrences in the blocks of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, summed = [], 0, 0

        def merged() -> pa.Table:
            found = pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("a", "sum")])
            return found.select(["lang", "phrase", "a_sum"]).rename_columns(["lang", "phrase", "a"])

        for batch in batches:
            for row in range(batch.num_rows):
                lang, phrases = batch.column("lang")[row].as_py(), _unpacked_text(batch.column("phrases")[row].as_py())
                at = np.flatnonzero(shared.value.may_hold(lang, phrases))
                if len(at):
                    held.append(pa.table({"lang": pa.array([lang] * len(at)), "phrase": pa.array([phrases[k] for k in at.tolist()]),
                                          "a": batch.column("counts")[row].values.take(pa.array(at))}))
                    rows += len(at)
                if rows >= 2 * summed + THINNED:  # so that adding up costs no more than what came
                    held = [merged()]
                    rows = summed = held[0].num_rows
                    if rows >= HELD // 2:
                        yield from held[0].to_batches()
                        held, rows, summed = [], 0, 0
        if held:
            yield from merged().to_batches()

    return run


def _counted(relation: DataFrame, shared: Broadcast, least: int) -> DataFrame:
    """lang, phrase, a: the phrases of a relation that occur often enough."""
    each = relation.select("lang", "phrases", "counts").mapInArrow(_thinned(shared), "lang string, phrase string, a long")
    return each.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST,
                     block_words: int = BLOCK_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the frequent phrases of 1, 2, ... words, and lang, n with the words of each language.

    A table has lang, phrase, a (occurrences), left and right (the phrase without its last and
    its first word), begins (occurrences of its first word, first two, ...) and ends (of its
    last word, last two, ...), without itself.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").filter("text IS NOT NULL")
    relation = stored(docs.mapInArrow(_first_relation(block_words), _FIRST), "phrases-relation-1")
    sizes = stored(relation.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-sizes")
    none, found = F.array().cast("array<bigint>"), []
    for k in range(1, longest + 1):
        # Settled, so that the shuffle files of one length can go before the next is counted.
        with rows_a_batch(spark, 2):  # a row is a whole block
            possible = settled(spark, f"phrases-possible-{k}", lambda r=relation: _possible(r, least))
        shared = spark.sparkContext.broadcast(Filter(possible))
        discard(possible)
        with rows_a_batch(spark, 2):
            counted = settled(spark, f"phrases-frequent-{k}", lambda r=relation, s=shared: _counted(r, s, least))
        if k == 1:
            found.append(counted.select("lang", "phrase", "a", F.lit(None).cast("string").alias("left"),
                                        F.lit(None).cast("string").alias("right"), none.alias("begins"), none.alias("ends")))
        else:
            counted = counted.withColumns({"left": F.substring_index("phrase", " ", k - 1), "right": F.substring_index("phrase", " ", 1 - k)})
            shorter = found[-1].select("lang", "phrase", "a", "begins", "ends")
            left = shorter.select("lang", F.col("phrase").alias("left"), F.concat("begins", F.array("a")).alias("begins"))
            right = shorter.select("lang", F.col("phrase").alias("right"), F.concat("ends", F.array("a")).alias("ends"))
            found.append(stored(counted.join(left, ["lang", "left"]).join(right, ["lang", "right"]), f"phrases-{k}"))
        if k < longest:
            columns = ["block", "lang", F.col("positions") if k > 1 else F.lit(None).cast("binary").alias("positions"), "items", "phrases"]
            with rows_a_batch(spark, 2):
                longer = stored(relation.select(*columns).mapInArrow(_extend(shared), _NEXT), f"phrases-relation-{k + 1}")
            discard(relation)
            relation = longer
        shared.unpersist()
    return found, sizes


def _lowest_cut(k: int) -> Column:
    """score, cut, l, r of the cut with the lowest score, the first of them."""
    def cut(j: int) -> Column:
        begin, end = F.col("begins")[j - 1], F.col("ends")[k - j - 1]
        return F.struct(F.expr(f"(CAST(1000 * a AS DECIMAL(20)) * CAST(n AS DECIMAL(18))) div "
                               f"(CAST(begins[{j - 1}] AS DECIMAL(19)) * CAST(ends[{k - j - 1}] AS DECIMAL(19)))").alias("score"),
                        F.lit(j).alias("cut"), begin.alias("l"), end.alias("r"))

    return F.array_min(F.array(*[cut(j) for j in range(1, k)]))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to ``longest`` words of each language.

    ``docs`` has lang and text; lang null is ``und``, a null text is empty, other columns are
    ignored.  A-Z are lower-cased, pieces end at ``[.,;:!?\\x0A-\\x0D]``, words are
    ``[^\\x20\\x09]+``.  Phrases occur at least ``least`` times inside pieces of their language.
    score is floor(1000 a n / (l r)) for the cut into a beginning (l times) and an end (r times)
    that makes it lowest, n being all words of the language.  A phrase inside a longer
    frequent one with as many occurrences is left out.  Order is by score and a, falling, then by
    the phrase's bytes.  Repeated rows count each; a table without words gives no rows.
    """
    return settled(docs.sparkSession, "phrases-best", lambda: _best(docs, longest, least, top, block_words))


def _best(docs: DataFrame, longest: int, least: int, top: int, block_words: int) -> DataFrame:
    found, sizes = frequent_phrases(docs, longest, least, block_words)
    kept = []
    for k in range(2, longest + 1):
        phrases = found[k - 1].join(sizes, "lang").withColumn("best", _lowest_cut(k))
        if k < longest:
            # Counts do not rise with length, so the phrases one word longer decide.
            longer = [found[k].select("lang", F.col(part).alias("phrase"), "a") for part in ("left", "right")]
            phrases = phrases.join(longer[0].unionByName(longer[1]).distinct(), ["lang", "phrase", "a"], "left_anti")
        kept.append(phrases.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score"))
    rows = reduce(DataFrame.unionByName, kept)
    # First the best of parts of a language, then of the language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return rows.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
