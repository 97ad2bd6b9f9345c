"""Best-fit packing of documents into fixed-size training sequences, under conflicts.

Documents are dealt over shards of bounded size by a hash of their row, and each shard is
packed on its own, longest first.  A bin carries its free space, a bitmap of sources (a
bit for each place that a source may still take) and a bitmap of duplicate clusters.  Bins
are ordered by free space; the search starts at the tightest bin that is large enough and
goes on to its successors until one has no conflict, else a bin is opened.

A bin never holds two documents of one cluster, nor more than ``max_per_source`` of one
source.  A document longer than a bin is cut into full bins and a rest that is packed like
any other.  Shards grow in number with the input, never in size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmix.llm.common import text_or_empty

CAPACITY, MAX_PER_SOURCE, SHARD_DOCS = 2048, 4, 2048


def word_count(text: Column) -> Column:
    """Words of a text: runs of characters other than space and 0x09 to 0x0D."""
    parts = F.split(text_or_empty(text), "[\\x20\\x09-\\x0D]+")
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def copy_cluster(text: Column) -> Column:
    """The same number for texts equal but for case, white space and punctuation."""
    return F.xxhash64(F.lower(F.regexp_replace(text_or_empty(text), "[\\s\\p{Punct}]+", " ")))


def best_fit(items: Iterable[tuple[int, object, object]], capacity: int,
             max_per_source: int) -> list[tuple[int, int]]:
    """(bin, place in it) for each (size, source, cluster), sizes falling and within capacity."""
    order: list[tuple[int, int]] = []  # (free, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    source_bit: dict[object, int] = {}
    cluster_bit: dict[object, int] = {}
    placed = []
    for size, source, cluster in items:
        shift = source_bit.setdefault(source, len(source_bit)) * max_per_source
        full = ((1 << max_per_source) - 1) << shift
        own = 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        k = bisect_left(order, (size, -1))
        while k < len(order):
            free, b = order[k]
            if not clusters[b] & own and sources[b] & full != full:
                del order[k]
                break
            k += 1
        else:
            free, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        # The lowest bit of the source's that is still clear.
        sources[b] |= ~sources[b] & full & -(~sources[b] & full)
        clusters[b] |= own
        placed.append((b, capacity - free))
        insort(order, (free - size, b))
    return placed


def _pack_shard(capacity: int, max_per_source: int):
    def run(pdf):
        import pandas as pd

        rows, items, whole = [], [], 0
        pdf = pdf.sort_values(["known", "doc_id", "size", "cluster"], kind="stable")
        for known, doc, size, source, cluster in zip(
                pdf["known"], pdf["doc_id"], pdf["size"], pdf["source"], pdf["cluster"], strict=True):
            doc = doc if known else None
            pieces = size // capacity
            for p in range(pieces):  # a piece that fills its bin
                rows.append((doc, p, p * capacity, capacity, whole, 0))
                whole += 1
            if size % capacity:
                items.append((size % capacity, source, cluster, doc, pieces, pieces * capacity))
            elif not size:
                rows.append((doc, 0, 0, 0, None, None))
        items.sort(key=lambda x: -x[0])
        placed = best_fit([x[:3] for x in items], capacity, max_per_source)
        for (size, _, _, doc, piece, first), (b, place) in zip(items, placed, strict=True):
            rows.append((doc, piece, first, size, whole + b, place))
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "first_token", "n_tokens", "bin", "place"])
        for c in out.columns:
            out[c] = pd.array(out[c].tolist(), dtype="Int64")
        out.insert(4, "shard", pdf["shard"].iloc[0])
        return out

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE,
         shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, shard, bin, place for every piece of every row.

    ``items`` has doc_id, size, source and cluster.  A row of size 0 (or null) gets one
    piece without a bin.  Null sources are one source, null clusters conflict with nothing.
    Rows that repeat an id are packed each; a null id stays null.  An empty table gives an
    empty result.
    """
    n = items.count()
    shards = max(1, -(-n // shard_docs))
    alone = F.struct(F.col("doc_id"), F.col("size"), F.col("source"))
    rows = items.select(
        F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("cluster", F.xxhash64(alone, F.lit("alone"))).alias("cluster"),
        # Rows are numbered, so that a null or repeated id does not make one large shard.
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"))
    return rows.groupBy("shard").applyInPandas(
        _pack_shard(capacity, max_per_source),
        "doc_id long, piece long, first_token long, n_tokens long, shard int, bin long, place long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE,
                   shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pack ``docs`` (doc_id, text, source) by their number of words; see ``pack``."""
    return pack(docs.select("doc_id", word_count(F.col("text")).alias("size"), F.col("source").cast("string").alias("source"),
                            copy_cluster(F.col("text")).alias("cluster")), capacity, max_per_source, shard_docs)
