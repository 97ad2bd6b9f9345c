"""Rows that repeat an id or have none: each is a document of its own."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from salesmix.llm import harmonic_packing, minhash_dedup, packing, suffix_dedup
from salesmix.llm.common import prepare
from tests.llm import brute


@pytest.fixture(scope="module")
def prose(words):
    rng = random.Random(12)
    return [" ".join(rng.choice(words) for _ in range(300)) for _ in range(4)]


def table(spark, rows):
    prepare(spark)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_links_of_both_texts_of_an_id(spark, prose):
    a, b = prose[:2]
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, prose[2]), (None, a), (5, None), (5, ""), (1, a)]
    got = Counter((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(table(spark, rows)).collect())
    assert got == Counter({(1, True, 1, True): 3, (2, True, 1, False): 1, (3, True, 1, False): 1, (4, True, 4, True): 1,
                           (None, True, None, True): 1, (5, False, 5, True): 2})


def test_repeats_of_texts_with_one_id(spark, prose):
    a, b, c = prose[:3]
    rows = [(1, a + b), (1, "x"), (2, a + c), (None, c + a), (None, "short"), (1, c), (7, None)]
    got = Counter((r.doc_id, *[r[k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])
                  for r in suffix_dedup.removed_repeats(table(spark, rows)).collect())
    want = brute.repeats([((k, i), t) for k, (i, t) in enumerate(rows)], 400)
    assert got == Counter((i, *v) for (_, i), v in want.items())
    kept = {r.text for r in suffix_dedup.without_repeats(table(spark, rows)).collect()}
    assert "x" in kept and None in kept and "short" in kept


def test_many_rows_without_an_id_make_many_shards(spark):
    prepare(spark)
    rows = [(None if k < 1000 else 7, k % 50 + 1, "s", k) for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, size long, source string, cluster long").repartition(4)
    got = packing.pack(df, capacity=64, shard_docs=100).collect()
    sizes = Counter(r.shard for r in got)
    assert len(sizes) == 15 and max(sizes.values()) < 200
    assert sum(r.n_tokens for r in got) == sum(r[1] for r in rows)


def test_pieces_of_rows_without_an_id(spark):
    prepare(spark)
    df = spark.createDataFrame([(k, s) for k, s in enumerate([5, 5, 5, 100])], "row long, size long")
    assert sum(r.length for r in harmonic_packing.pack_lengths(df, 64).collect()) == 115


def test_windows_are_compared_on_bytes():
    """Runs that go on, runs that break off, and a byte that differs inside one."""
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 400).astype(np.uint8)
    data[200:260] = data[50:110]
    data[230] ^= 1
    start = np.r_[np.arange(50, 100), np.arange(10, 14), [300]]
    other = np.r_[np.arange(200, 250), np.arange(120, 124), [300]]
    for length in (1, 3, 10):
        want = [bytes(data[s:s + length]) == bytes(data[o:o + length]) for s, o in zip(start, other, strict=True)]
        assert suffix_dedup.equal_windows(data, start, other, length).tolist() == want
    assert suffix_dedup.equal_windows(data, start[:0], other[:0], 5).tolist() == []


def test_equal_hashes_of_other_bytes_remove_nothing(spark, prose, monkeypatch):
    """With a hash that is always the same, the bytes alone decide."""
    a, b, c = (bytes(t[:600], "utf-8") for t in prose[:3])
    rows = pd.DataFrame({"context": [a, b, a[100:550], c], "lo": [0, 0, 100, 0], "place": [50, 50, 150, 50],
                         "anchor": np.array([1, 1, 1, 1], np.int64)})
    monkeypatch.setattr(suffix_dedup, "window_hashes", lambda data, size, step=0: np.zeros(len(data) - size + 1, np.uint64))
    owner, start, _, twice, _ = suffix_dedup._compare(400)(rows)
    marked = {(int(o), int(s)) for o, s, t in zip(owner, start, twice, strict=True) if t}
    assert marked <= {(o, s) for o in (0, 2) for s in range(100, 151)}
