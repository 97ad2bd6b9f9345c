"""Harmonic packing of token sequences: classes by reciprocal capacity, filled by count alone.

A document of more than capacity / (k + 1) and at most capacity / k tokens is in class k, and k
of a class fill a sequence, whichever they are: a document's sequence follows from its place in
its class, so classes and runs of places are packed independently by all workers.

Space that the k documents leave is filled up from a stream of other documents: those longer
than a sequence, and as many of the shortest as are needed, so that sequences number no
more than the tokens ask for.  Stream and gaps are both running sums of tokens; laid over each
other, they say which tokens fill which gap, so only documents of the stream are cut.  Where
the gaps end, the stream goes on in sequences of its own, the last of them split into
powers of two.  Every sequence is then full or of a power of two.

Ids are made by the tokenizers library.  Texts of plain Latin-1 letters are split as the
vocabulary does and each different word is encoded once a task; any other text goes through
the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesmix.llm.bpe import ship_vocabulary
from salesmix.llm.common import stored
from salesmix.llm.scan import numbered, running

CAPACITY, END_ID = 2048, 1
_CHARACTERS = 1 << 21  # of texts whose words are looked up together
KNOWN_WORDS = 1_000_000  # whose ids a task remembers, some 200 MB; a speed matter only
STRETCH = 1 << 16  # tokens of the stream that one task lays over the gaps at a time

# The split pattern of the vocabulary, for texts of Latin-1 letters.
_LETTER, _DIGIT, _SPACE = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
# Letters first: no alternative begins like another but the last two.
_WORD = re.compile(rf" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+"
                   rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\x85\xa0-\xff]*").fullmatch


class WordEncoder:
    """Ids of whole texts as bytes, by the tokenizers library's byte-level BPE."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        split, whole, size = [], [], 0
        for k, text in enumerate(texts):
            if _PLAIN(text) and not any(s in text for s in self.special):
                split.append((k, _WORD.findall(text)))
                size += len(text)
                if size > _CHARACTERS:
                    self._join(split, out)
                    split, size = [], 0
            else:
                whole.append(k)
        self._join(split, out)
        for k, ids in zip(whole, self._library([texts[k] for k in whole]), strict=True):
            out[k] = ids
        return out

    def _join(self, split: list[tuple[int, list[str]]], out: list[bytes | None]) -> None:
        """Ids of texts split into words; words not seen yet are encoded together."""
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        known = self.known
        fresh = list({w for _, words in split for w in set(words) if w not in known})
        known.update(zip(fresh, self._library(fresh), strict=True))
        for k, words in split:
            out[k] = b"".join(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def word_encoder(name: str) -> WordEncoder:
    return WordEncoder(SparkFiles.get(name))


_TOKENS = "row long, doc_id long, size long, ids binary"


def _tokenize(name: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = word_encoder(name), TaskContext.get().partitionId() << 33
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        for b in batches:
            ids = [i + end for i in encoder.encode([t or "" for t in b.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + len(ids)), pa.int64()), b.column("doc_id"),
                 pa.array([len(i) // len(end) for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["row", "doc_id", "size", "ids"])
            row += len(ids)

    return run


def plan_classes(counts: dict[int, int], tokens: int, capacity: int) -> dict[int, int]:
    """How many documents of each class are packed by count; the others go into the stream.

    ``counts`` has the documents of each class k >= 1.  Sequences may be as many as ``tokens``
    fill; beyond that, whole sequences of the shortest documents give way.
    """
    room, packed = tokens // capacity, {}
    for k in sorted(counts):
        packed[k] = min(counts[k], room * k)
        room -= -(-packed[k] // k)
    return packed


def pack_lengths(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """row, start, length, sequence_id, offset of every piece of every row.

    ``lengths`` has row (different numbers) and size.  A row without a size, or of size 0, has no
    piece.  Rows of one size are packed in the order of their numbers.
    """
    spark = lengths.sparkSession
    klass = F.when(F.col("size") > capacity, 0).otherwise(F.expr(f"{capacity} div size"))
    rows = lengths.filter("size > 0").select("row", "size", klass.cast("long").alias("k"))
    # The shortest come first, those longer than a sequence last.
    rows = numbered(rows.withColumn("falling", -F.col("k")), ["falling", "row"], "place", "packing-sorted").drop("falling")
    # At most one row for each class.
    found = {r.k: (r.n, r.tokens) for r in rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens")).collect()}
    tokens, n_rows = sum(t for _, t in found.values()), sum(n for n, _ in found.values())
    packed = plan_classes({k: n for k, (n, _) in found.items() if k}, tokens, capacity)
    plan, first, bins = [], 0, 0
    for k in sorted(found, reverse=True):
        plan.append((k, first, packed.get(k, 0), bins))
        first += found[k][0]
        bins += -(-packed.get(k, 0) // k) if k else 0
    plan = spark.createDataFrame(plan or [(0, 0, 0, 0)], "k long, first long, packed long, base long")
    rank = F.col("place") - F.col("first")
    rows = rows.join(F.broadcast(plan), "k").withColumn(
        "sequence_id", F.when(rank < F.col("packed"), F.col("base") + F.expr("(place - first) div k")))
    rows = stored(rows.select("row", "size", "place", "sequence_id"), "packing-rows")

    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = rows.filter("sequence_id IS NOT NULL").select(
        "row", F.lit(0).cast("long").alias("start"), F.col("size").alias("length"), "sequence_id",
        (F.sum("size").over(before) - F.col("size")).alias("offset"))

    # Gaps of the sequences, and the sequences of the stream alone.
    more, rest = divmod(tokens - bins * capacity, capacity)
    powers = [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if rest >> b & 1]
    last = [(bins + more + j, 0, p) for j, p in enumerate(powers)]
    shape = "sequence_id long, used long, gap long"
    gaps = rows.filter("sequence_id IS NOT NULL").groupBy("sequence_id").agg(F.sum("size").alias("used"))
    gaps = gaps.withColumn("gap", capacity - F.col("used")).unionByName(
        spark.range(bins, bins + more).select(F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("used"), F.lit(capacity).cast("long").alias("gap")))
    gaps = gaps.unionByName(spark.createDataFrame(last, shape))
    gaps = running(stored(gaps, "packing-gaps"), "sequence_id", bins + more + len(powers), {"upto": ("gap", "sum")}).filter("gap > 0")
    stream = rows.withColumn("adds", F.when(F.col("sequence_id").isNull(), F.col("size")).otherwise(0))
    stream = running(stream, "place", n_rows, {"upto": ("adds", "sum")}).filter("adds > 0")
    gaps = gaps.select((F.col("upto") - F.col("gap")).alias("low"), F.col("upto").alias("high"), F.struct("sequence_id", "used", (F.col("upto") - F.col("gap")).alias("low")).alias("seq"))
    stream = stream.select((F.col("upto") - F.col("adds")).alias("low"), F.col("upto").alias("high"), F.struct("row", (F.col("upto") - F.col("adds")).alias("low")).alias("doc"))
    return whole.unionByName(_laid_over(stream, gaps))


def _laid_over(stream: DataFrame, gaps: DataFrame) -> DataFrame:
    """Pieces where intervals of the stream meet gaps; both cover the same numbers without a hole.

    Intervals are cut at multiples of ``STRETCH``; inside a stretch the starts of both sides are
    sorted, and what the last start of either side began lasts until the next start.
    """
    def starts(side: DataFrame, name: str, other: str, kind: str) -> DataFrame:
        inside = side.select("high", "low", name, F.explode(F.sequence(
            F.expr(f"low div {STRETCH}"), F.expr(f"(high - 1) div {STRETCH}"))).alias("stretch"))
        return inside.select("stretch", F.greatest("low", F.col("stretch") * STRETCH).alias("at"), name,
                             F.least("high", (F.col("stretch") + 1) * STRETCH).alias("until"), F.lit(None).cast(kind).alias(other))

    both = starts(stream, "doc", "seq", "struct<sequence_id:bigint,used:bigint,low:bigint>").unionByName(
        starts(gaps, "seq", "doc", "struct<row:bigint,low:bigint>"))
    order = Window.partitionBy("stretch").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = both.select("stretch", "at", F.last("doc", True).over(upto).alias("doc"), F.last("seq", True).over(upto).alias("seq"),
                       F.coalesce(F.lead("at").over(order), "until").alias("next"))
    laid = laid.filter("next > at AND doc IS NOT NULL AND seq IS NOT NULL").select(
        "doc.row", (F.col("at") - F.col("doc.low")).alias("start"), (F.col("next") - F.col("at")).alias("length"),
        "seq.sequence_id", (F.col("seq.used") + F.col("at") - F.col("seq.low")).alias("offset"))
    # What a stretch's border cut is one piece.
    return laid.groupBy("row", "sequence_id").agg(
        F.min("start").alias("start"), F.sum("length").alias("length"), F.min("offset").alias("offset")
    ).select("row", "start", "length", "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian 32 bits) of every piece.

    A document's tokens are the library's ids of its whole text and ``end_id``; a null text
    is empty.  Rows that repeat a doc_id, or have none, are documents of their own.
    Other columns are ignored.  An empty table has no pieces.
    """
    name = ship_vocabulary(docs, vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenize(name, end_id), _TOKENS)
    tokens = stored(rows, "packing-tokens")
    pieces = pack_lengths(tokens.select("row", "size"), capacity)
    pieces = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = word_encoder(name).kind
        for b in batches:
            lists = b.column("pieces")
            many = lists.value_lengths().to_numpy()
            start, length, sequence, offset = (lists.flatten().field(c) for c in range(4))
            owner = np.repeat(np.arange(b.num_rows), many)
            ids, found, at = b.column("ids"), [], -1
            for k, a, z in zip(owner.tolist(), start.to_pylist(), length.to_pylist(), strict=True):
                if k != at:
                    at, whole = k, np.frombuffer(ids[k].as_py(), kind).astype("<u4")
                found.append(whole[a:a + z].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(owner)), start, length, b.column("size").take(pa.array(owner)), sequence, offset,
                 pa.array(found, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return tokens.join(pieces, "row").select("doc_id", "size", "ids", "pieces").mapInArrow(
        cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
