"""Harmonic packing: every id in one place, sequences full, encoder equal to the library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from salesmix.llm import harmonic_packing as hp
from salesmix.llm import queries

VOCABULARY = public_tokenizers.path(queries.BYTE_VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    return hp.WordEncoder(VOCABULARY)


def library_ids(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'stlrvem dzÉéß½²ª\x85\xa0 \t\n\r\x0b\x1c\x7f.,!-_<|>09汉🙂́ "), max_size=40))
def test_words_as_the_library(library, encoder, text):
    assert np.frombuffer(encoder.encode([text])[0], encoder.kind).tolist() == library.encode(text, add_special_tokens=False).ids


def test_special_strings(library, encoder):
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext", "it's we'll 'S don''t  x"):
        assert np.frombuffer(encoder.encode([text])[0], encoder.kind).tolist() == library.encode(text, add_special_tokens=False).ids


def check_sequences(pieces, capacity):
    """Gapless, within capacity, and full or of a power of two; the number of sequences."""
    sequences = defaultdict(list)
    for start, length, sequence, offset in pieces:
        assert length > 0 and start >= 0
        sequences[sequence].append((offset, length))
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    return len(sequences)


@pytest.mark.parametrize("sizes, capacity", [
    ([5, 60, 3, 64, 65, 1, 1, 1, 33, 32, 31, 22, 21, 16, 17, 200, 130, 7], 64),
    ([40] * 100, 64), ([33] * 7, 64), ([1] * 1000, 64), ([64] * 3, 64), ([1000], 64), ([1], 64), ([63], 64), ([5000, 40, 40], 64),
    ([k % 90 + 1 for k in range(3000)], 64), ([70_000, 300, 200_000, 9], 100), ([65], 64)])
def test_lengths(spark, sizes, capacity):
    rows = list(enumerate(sizes))
    df = spark.createDataFrame([*rows, (10**6, 0), (10**6 + 1, None)], "row long, size long").repartition(3)
    got = hp.pack_lengths(df, capacity).collect()
    by = defaultdict(list)
    for r in got:
        by[r.row].append((r.start, r.length))
    assert sorted(by) == [i for i, _ in rows]
    for i, size in rows:
        at = 0
        for start, length in sorted(by[i]):
            assert start == at
            at += length
        assert at == size
    n = check_sequences([(r.start, r.length, r.sequence_id, r.offset) for r in got], capacity)
    assert n <= sum(sizes) // capacity + capacity.bit_length()


def test_classes_keep_documents_whole():
    """Of a class, k make a sequence; the shortest give way until sequences are no more than tokens fill."""
    assert hp.plan_classes({1: 10, 2: 7, 5: 20}, 64 * 30, 64) == {1: 10, 2: 7, 5: 20}
    assert hp.plan_classes({1: 10, 2: 7, 5: 20}, 64 * 12, 64) == {1: 10, 2: 4, 5: 0}
    assert hp.plan_classes({}, 0, 64) == {}


def test_no_rows(spark, no_docs):
    assert hp.pack_documents(no_docs, VOCABULARY).collect() == []


def test_documents(spark, docs, rows, library):
    """Nulls, empty and long texts, repeated and null ids, clashing columns."""
    more = docs.filter("doc_id < 40").unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    whole = docs.unionByName(more).withColumns({"row": F.lit("r"), "size": F.lit(-1), "start": F.lit(None).cast("int"), "K": F.lit(9)})
    got = hp.pack_documents(whole, VOCABULARY).collect()
    check_sequences([(r.start, r.length, r.sequence_id, r.offset) for r in got], 2048)
    want = defaultdict(int)
    for r in whole.select("doc_id", "text").collect():
        for k, i in enumerate(library_ids(library, r.text).tolist()):
            want[r.doc_id, k, i] += 1
    have = defaultdict(int)
    for r in got:
        for k, i in enumerate(np.frombuffer(r.ids, "<u4").tolist(), r.start):
            have[r.doc_id, k, i] += 1
    assert have == want


def test_registered(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op12_harmonic_packing(spark, sf_dir).collect()
    n = check_sequences([(r.start, r.length, r.sequence_id, r.offset) for r in got], 2048)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by.keys() == texts.keys()
    cut = 0
    for i, pieces in by.items():
        ids, at = library_ids(library, texts[i]), 0
        cut += len(pieces) > 1 and len(ids) <= 2048
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert n <= sum(r.length for r in got) // 2048 + 11
    assert cut <= 0.1 * len(texts)
