"""Removal of long repeated byte strings, with a suffix array over content-chosen anchors.

Each window of ``length`` bytes has one anchor: the 96-byte string in it with the least
hash, leftmost of equals.  Equal windows have equal anchor strings at equal offsets, so
only windows whose anchor string occurs twice can repeat.  Those anchors, run by run of a
document, are strings of symbols whose suffixes are sorted (suffix_array).  The sorted
sequence is cut into intervals of bounded size, so that texts with the longest prefixes in
common are in one task.  There windows with equal hashes are compared byte by byte with the
first of them.  Windows of an anchor string that lies in several intervals, and that found
no equal in their own, are compared across intervals by two independent 64-bit hashes.

So the suffix order deals out the work and the bytes decide: a window may begin before its
anchor, where the order of what follows the anchor does not say who shares it.  After 27
symbols equal suffixes stay tied, which changes no result.

Documents with the same text are one string of the sort; if it has ``length`` bytes, all
of it repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from salesmix.llm.common import discard, settled, stored, text_or_empty, unused_name
from salesmix.llm.shingles import mix
from salesmix.llm.suffix_array import suffix_ranks

LENGTH, GRAM = 400, 96
SEGMENT = 1 << 16  # bytes hashed at once; what is held for them fits a core's cache
INTERVAL = 256     # anchors compared at once
_STEP, _OTHER_STEP = 0xD1342543DE82EF95, 0x9FB21C651E98DF25
_BYTE = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=8)
def _table(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    # Tables of a few sizes are kept, as most buffers are of about one size.
    return _table(base, 1 << max(12, (n - 1).bit_length()))[:n] if n else np.zeros(0, np.uint64)


def window_hashes(data: np.ndarray, size: int, step: int = _STEP) -> np.ndarray:
    """Hash of each ``size`` bytes of ``data``."""
    total = np.zeros(len(data) + 1, np.uint64)
    values = _BYTE.take(data)
    values *= _powers(step, len(data))
    np.cumsum(values, out=total[1:])
    n = len(data) - size + 1
    sums = total[size:] - total[:n]
    sums *= _powers(pow(step, -1, 1 << 64), n)
    return mix(sums)


def equal_windows(data: np.ndarray, start: np.ndarray, other: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from each ``start`` are those from ``other``.

    Where both go on byte by byte, one comparison of bytes serves the whole run.
    """
    if not len(start):
        return np.zeros(0, bool)
    head = np.flatnonzero((np.diff(start, prepend=-2) != 1) | (np.diff(other, prepend=-2) != 1))
    windows = np.diff(np.r_[head, len(start)])
    size = windows + length - 1
    ends = np.cumsum(size)
    step = np.arange(ends[-1]) - np.repeat(ends - size, size)
    mine, like = np.repeat(start[head], size), np.repeat(other[head], size)
    mine += step
    like += step
    wrong = np.zeros(len(step) + 1, np.int64)
    np.cumsum(data.take(mine) != data.take(like), out=wrong[1:])
    at = np.repeat(ends - size, windows) + np.arange(len(start)) - np.repeat(head, windows)
    return wrong[at + length] == wrong[at]


def firsts_of(keys: np.ndarray) -> np.ndarray:
    """For each key the place where its value comes first."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    head = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(order, head), np.diff(np.r_[head, len(keys)]))
    return out


def anchors_of(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Hash of each ``gram`` bytes of a buffer, and the place of the anchor of each window."""
    h = window_hashes(data, gram)
    width, span = length - gram + 1, 1
    # The place takes the last bits of a hash, so one minimum finds both, the leftmost of equals.
    # They are as many in every buffer, as equal windows of different buffers have one anchor.
    place = np.uint64((1 << max(len(data), SEGMENT + length).bit_length()) - 1)
    value = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    while span * 2 <= width:
        value = np.minimum(value[:-span], value[span:])
        span *= 2
    if span < width:
        shift = width - span
        value = np.minimum(value[:-shift], value[shift:])
    return h, (value & place).astype(np.int64)


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(text number, anchor place in it, hash, first and last window start) of all texts."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)
    found = []
    for s in range(0, max(0, len(buffer) - length + 1), SEGMENT):
        data = buffer[s:s + SEGMENT + length - 1]
        h, at = anchors_of(data, length, gram)
        starts = np.arange(len(at)) + s
        text = np.searchsorted(ends, starts, side="right")
        inside = np.flatnonzero(starts + length <= ends[text])
        if not len(inside):
            continue
        a, t, p = at[inside].astype(np.int64), text[inside], starts[inside]
        head = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(t, prepend=-1) != 0) | (np.diff(p, prepend=-2) != 1))
        tail = np.r_[head[1:], len(a)] - 1
        base = ends[t[head]] - sizes[t[head]]
        found.append((t[head], a[head] + s - base, h[a[head]], p[head] - base, p[tail] - base))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    gram = min(GRAM, max(1, length // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            texts = _bytes(b.column("text"))
            number, place, h, lo, hi = anchors(texts, length, gram)
            counted = np.arange(len(number)) - np.searchsorted(number, number)  # rank in its text
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(number)), b.column("content").take(pa.array(number)), pa.array(counted),
                 pa.array(place), pa.array(lo), pa.array(hi), pa.array(h.astype(np.uint64).view(np.int64))],
                ["doc_id", "content", "ord", "place", "lo", "hi", "anchor"])

    return docs.select("doc_id", "text", "content").mapInArrow(
        run, "doc_id long, content long, ord long, place long, lo long, hi long, anchor long")


def _ordered(found: DataFrame) -> DataFrame:
    """Repeated anchors with their rank in the suffix array and the interval that holds it."""
    same = found.groupBy("anchor").agg(F.min(F.struct("content", "place", "lo")).alias("x"),
                                       F.max(F.struct("content", "place", "lo")).alias("y"))
    again = stored(same.filter("x <> y").select("anchor"), "sd-again")
    kept = stored(found.join(again, "anchor").groupBy("anchor", "content", "ord", "place", "lo", "hi")
                  .agg(F.min("doc_id").alias("doc_id")), "sd-kept")
    discard(found)
    along = Window.partitionBy("doc_id", "content").orderBy("ord")
    runs = kept.withColumn("run", F.col("ord") - F.row_number().over(along))
    symbol = stored(kept.select("anchor").distinct().repartitionByRange("anchor").sortWithinPartitions("anchor")
                    .select("anchor", (F.monotonically_increasing_id() + 1).alias("s")), "sd-symbol")
    strings = stored(runs.join(symbol, "anchor").select(
        F.xxhash64("doc_id", "content", "run").alias("sid"), F.lit(0).cast("long").alias("path"),
        (F.row_number().over(Window.partitionBy("doc_id", "content", "run").orderBy("ord")) - 1).cast("long").alias("j"), "s",
        "doc_id", "content", "anchor", "place", "lo", "hi"), "sd-strings")
    discard(kept)
    ranks = settled(found.sparkSession, "sd-ranks", lambda: suffix_ranks(strings.select("sid", "path", "j", "s")))
    ranked = stored(strings.join(ranks, ["sid", "path", "j"]).drop("sid", "path", "j", "s"), "sd-ranked")
    ties = ranked.groupBy("rank").agg(F.count("*").alias("ties"))
    shares = F.ceil(F.col("ties") / INTERVAL)
    return ranked.join(stored(ties, "sd-ties"), "rank").select(
        "doc_id", "content", "anchor", "place", "lo", "hi",
        F.xxhash64(F.floor(F.col("rank") / INTERVAL),
                   F.when(shares > 1, F.struct("rank", F.pmod(F.xxhash64("doc_id", "content", "place"), shares).alias("share")))
                   ).alias("interval"))


def _compare(length: int):
    """Marks repeated window starts among the anchors of one interval."""
    def run(rows):
        pdf = rows
        data = [np.frombuffer(x, np.uint8) for x in pdf["context"]]
        sizes = np.array([len(d) for d in data])
        many = sizes - length + 1
        buffer = np.concatenate(data)
        h = window_hashes(buffer, length)
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(data)), many)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        lo, place = pdf["lo"].to_numpy(), pdf["place"].to_numpy()
        start = lo[owner] + within
        key = mix(h[begin[owner] + within] ^ mix(pdf["anchor"].to_numpy().view(np.uint64)[owner]
                                                 + (place[owner] - start).astype(np.uint64)))
        at, twice, left = begin[owner] + within, np.zeros(len(key), bool), np.arange(len(key))
        while len(left):
            like = left[firsts_of(key[left])]
            more = left != like
            mine, like = left[more], like[more]
            same = equal_windows(buffer, at[mine], at[like], length)
            twice[mine[same]] = twice[like[same]] = True
            left = mine[~same]  # the hash of other bytes: compared among themselves

        def other_key(which: np.ndarray) -> np.ndarray:
            wide = window_hashes(buffer, length, _OTHER_STEP)[at[which]]
            return mix(wide ^ mix(pdf["anchor"].to_numpy().view(np.uint64)[owner[which]] * np.uint64(_OTHER_STEP)))

        return owner, start, key, twice, other_key

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, content, spans): byte ranges covered by strings of ``length`` that occur elsewhere.

    ``docs`` has doc_id, text and content, a digest of the text: both together name a text, so
    ids may repeat.  Only one document of each distinct text is looked at; see ``_marked`` for copies.
    Spans are arrays of (first, end), unordered and overlapping.
    """
    found = stored(_anchor_rows(docs, length), "sd-anchors")
    ordered = settled(docs.sparkSession, "sd-intervals", lambda: _ordered(found))
    split = stored(ordered.groupBy("anchor").agg(F.min("interval").alias("x"), F.max("interval").alias("y"))
                   .select("anchor", (F.col("x") != F.col("y")).alias("split")), "sd-split")
    lists = stored(ordered.join(split, "anchor").groupBy("doc_id", "content").agg(F.collect_list(
        F.struct("anchor", "place", "lo", "hi", "interval", "split")).alias("list")), "sd-lists")

    def contexts(batches):
        for b in batches:
            out = {k: [] for k in ("doc_id", "content", "anchor", "place", "lo", "interval", "split", "context")}
            for doc, content, text, items in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist(),
                                                 _bytes(b.column("text")), b.column("list").to_pylist(), strict=True):
                for x in items:
                    out["doc_id"].append(doc)
                    out["content"].append(content)
                    out["context"].append(text[x["lo"]:x["hi"] + length])
                    for k in ("anchor", "place", "lo", "interval", "split"):
                        out[k].append(x[k])
            if out["doc_id"]:
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, content long, anchor long, place long, lo long, interval long, split boolean, context binary"
    rows = docs.select("doc_id", "content", "text").join(lists, ["doc_id", "content"])
    rows = rows.dropDuplicates(["doc_id", "content"]).mapInArrow(contexts, schema)
    check = _compare(length)

    def marks(pdf):
        import pandas as pd
        owner, start, key, twice, other_key = check(pdf)
        doc, split = pdf["doc_id"].to_numpy()[owner], pdf["split"].to_numpy()[owner]
        content = pdf["content"].to_numpy()[owner]
        # Runs of marked starts of one anchor.
        at = np.flatnonzero(twice)
        head = at[(np.diff(owner[at], prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1)]
        tail = at[np.r_[np.flatnonzero((np.diff(owner[at]) != 0) | (np.diff(at) != 1)), len(at) - 1]] if len(at) else at
        spans = pd.DataFrame({"doc_id": doc[head], "content": content[head], "first": start[head], "end": start[tail] + length,
                              "hash": np.zeros(len(head), np.int64), "other": np.zeros(len(head), np.int64), "kind": np.zeros(len(head), np.int32)})
        # Of anchors in several intervals: windows without an equal here, and, so that they
        # can be found from other intervals, one row for each hash that has one.
        lone = np.flatnonzero(split & ~twice)
        _, known = np.unique(key[split & twice], return_index=True)
        seen = np.flatnonzero(split & twice)[known]
        both = np.r_[lone, seen]
        more = pd.DataFrame({"doc_id": np.r_[doc[lone], np.zeros(len(seen), np.int64)],
                             "content": np.r_[content[lone], np.zeros(len(seen), np.int64)],
                             "first": np.r_[start[lone], np.zeros(len(seen), np.int64)],
                             "end": np.r_[start[lone] + length, np.zeros(len(seen), np.int64)],
                             "hash": key[both].view(np.int64), "other": other_key(both).view(np.int64),
                             "kind": np.r_[np.ones(len(lone), np.int32), np.full(len(seen), 2, np.int32)]})
        return pd.concat([spans, more])

    told = stored(rows.groupBy("interval").applyInPandas(
        marks, "doc_id long, content long, first long, end long, hash long, other long, kind int"), "sd-told")
    across = stored(told.filter("kind > 0").groupBy("hash", "other").agg(F.count("*").alias("n")).filter("n > 1")
                    .select("hash", "other"), "sd-across")
    late = told.filter("kind = 1").join(across, ["hash", "other"]).select("doc_id", "content", "first", "end")
    spans = told.filter("kind = 0").select("doc_id", "content", "first", "end").unionByName(late)
    return spans.groupBy("doc_id", "content").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def united(spans: list[dict], copied: bool, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal removed ranges of a text of ``size`` bytes."""
    if copied and size >= length:
        return [(0, size)]
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["first"], x["end"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _marked(docs: DataFrame, length: int) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: spans, and whether the text has copies."""
    names = unused_name(docs, "spans"), unused_name(docs, "copied")
    who, content = unused_name(docs, "who"), unused_name(docs, "content")
    named = docs.withColumns({who: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), content: F.xxhash64(text_or_empty("text"))})
    rows = named.select(F.col(who).alias("doc_id"), "text", F.col(content).alias("content"))
    spans = settled(docs.sparkSession, "sd-spans", lambda: repeated_spans(rows, length))
    light = rows.select("doc_id", "content", F.sha2(text_or_empty("text"), 256).alias("sha"))
    copies = stored(light.groupBy("sha").agg(F.count("*").alias("n")).filter("n > 1").select("sha"), "sd-copies")
    copied = light.join(copies, "sha").select("doc_id", "content", F.lit(True).alias("copied")).distinct()
    marks = stored(copied.join(spans, ["doc_id", "content"], "full_outer").select(
        F.col("doc_id").alias(who), F.col("content").alias(content), F.col("spans").alias(names[0]),
        F.col("copied").alias(names[1])), "sd-marks")
    return named.join(marks, [who, content], "left").drop(who, content), *names


def removed_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, spans for every row of ``docs``.

    Texts are read as UTF-8 (null: empty).  A byte is removed if a string of ``length``
    bytes that covers it starts anywhere else too, in another row or the same; spans are
    the maximal removed ranges.  Rows with equal texts count as different places; ids may be
    null or repeat.  ``kept_text`` has the whole characters of the bytes that stay.  Other
    columns are ignored; an empty table gives an empty result.
    """
    def run(batches):
        for b in batches:
            out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans")}
            for doc, text, spans, copied in zip(b.column("doc_id").to_pylist(), _bytes(b.column("text")),
                                                b.column("spans").to_pylist(), b.column("copied").to_pylist(), strict=True):
                cut = united(spans, bool(copied), len(text), length)
                kept = b"".join(text[a:z] for (_, a), (z, _) in zip([(0, 0), *cut], [*cut, (len(text), 0)], strict=True))
                for k, v in zip(out, (doc, len(text), sum(z - a for a, z in cut), len(cut), hashlib.sha256(kept).hexdigest(),
                                      kept.decode("utf-8", "ignore"), [{"first": a, "end": z} for a, z in cut]), strict=True):
                    out[k].append(v)
            if out["doc_id"]:
                yield pa.RecordBatch.from_pydict(out, pa.schema([
                    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                    ("kept_sha256", pa.string()), ("kept_text", pa.string()),
                    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))]))

    marked, _, _ = _marked(docs.select("doc_id", "text"), length)
    return marked.select("doc_id", "text", "spans", "copied").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, "
             "spans array<struct<first: long, end: long>>")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut out of its texts, all rows and columns kept.

    Characters of which a part is cut away go as a whole.
    """
    marked, spans_name, copied_name = _marked(docs, length)
    columns = docs.columns

    def cut_text(batches):
        for b in batches:
            texts = []
            for whole, text, spans, copied in zip(
                    b.column("text").to_pylist(), _bytes(b.column("text")), b.column(spans_name).to_pylist(),
                    b.column(copied_name).to_pylist(), strict=True):
                cut = united(spans, bool(copied), len(text), length)
                kept = b"".join(text[a:z] for (_, a), (z, _) in zip([(0, 0), *cut], [*cut, (len(text), 0)], strict=True))
                texts.append(kept.decode("utf-8", "ignore") if cut else whole)
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in columns], columns)

    return marked.select(*columns, spans_name, copied_name).mapInArrow(cut_text, docs.schema)
