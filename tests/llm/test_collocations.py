"""Phrase mining against a plain version."""

import random
import re
from collections import Counter, defaultdict

import pytest

from salesmix.llm import collocations, queries
from salesmix.llm.common import prepare

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top=2000, longest=5):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {q[i:i + k] for q, b in found.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if b >= found[q[i:i + k]]}
        ranked = []
        for p, a in found.items():
            if p not in inside:
                score, _, left, right = min((1000 * a * sizes[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), (" ".join(p), a, left, right, sizes[lang], score)))
        out += [(lang, rank, *r[3]) for rank, r in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def mined(spark, rows, **settings):
    prepare(spark)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, word string, BLOCK int").repartition(3)
    return sorted(tuple(r) for r in collocations.collocations(df, **settings).collect())


@pytest.mark.parametrize("block_words", [50, 100_000])
def test_nulls_ties_and_odd_texts(spark, block_words):
    rng = random.Random(4)
    words = ["The", "the", "cat", "sat", "on", "a", "mat", "É", "é", "汉字", "x\xa0y", "it's", "\x1f"]
    ends = [" ", " ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", ";", "! "]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", None), (None, None), ("fr", ""), ("en", " .,; \n"), ("solo", "one two three four five six")]
    rows += [("en", "new york city hall " * 30)] * 4 + [("en", "a" * 5000 + " " + "b" * 5000)] * 6 + [("und", "the cat sat " * 3000)]
    assert mined(spark, rows, least=6, block_words=block_words) == plain(rows, 6)
    assert mined(spark, rows, least=6, top=5, block_words=block_words) == plain(rows, 6, top=5)


def test_phrases_inside_longer_ones_go(spark):
    rows = [("en", "alpha beta gamma delta epsilon zeta. beta gamma. alpha beta gamma")] * 3
    got = mined(spark, rows, least=3)
    assert got == plain(rows, 3)
    assert {r[2] for r in got} >= {"alpha beta gamma", "beta gamma"} and "alpha beta" not in {r[2] for r in got}


def test_scores_beyond_64_bits(spark):
    """1000 a n of these counts passes 2^63."""
    df = spark.createDataFrame([(10**9, 10**9, 10**12, [3 * 10**9], [2 * 10**9])], "a long, x long, n long, begins array<long>, ends array<long>")
    best = df.select(collocations._lowest_cut(2).alias("b")).collect()[0].b
    assert best.score == 1000 * 10**9 * 10**12 // (3 * 10**9 * 2 * 10**9) and (best.l, best.r) == (3 * 10**9, 2 * 10**9)


def test_no_words(spark):
    assert mined(spark, [("en", None), (None, " . ")], least=1) == []
    assert mined(spark, [], least=1) == []


def test_registered(spark, sf_dir):
    """The registered tables with a lower least count, as few phrases of the small ones occur 100 times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=15).collect()) == plain(rows, 15)
    assert sorted(tuple(r) for r in queries.op13_collocations(spark, sf_dir).collect()) == plain(rows, 100)


def test_rare_phrases_are_not_shuffled(spark, monkeypatch):
    """Before the exact count a phrase costs a few bytes, and only what may be frequent is counted."""
    rng = random.Random(8)
    rows = [("en", " ".join("w" + str(rng.randrange(200)) for _ in range(300)) + " new york city" * 2) for _ in range(60)]
    sizes, counted = [], collocations._counted

    def seen(relation, shared, least):
        found = sum(len(r.counts) for r in relation.collect())
        dealt = relation.select("lang", "phrases", "counts").mapInArrow(
            collocations._dealt(3), "part long, first long, steps binary, counts binary").collect()
        thin = relation.mapInArrow(collocations._thinned(shared), "lang string, phrase string, a long").count()
        sizes.append((found, sum(len(r.steps) + len(r.counts) for r in dealt), thin))
        return counted(relation, shared, least)

    monkeypatch.setattr(collocations, "_counted", seen)
    assert mined(spark, rows, least=50) == plain(rows, 50)
    found, bytes_, thin = sizes[1]
    assert found > 10_000 and bytes_ < 5 * found and thin < found / 100


def test_a_task_adds_up_its_blocks(spark, monkeypatch):
    """A phrase leaves a task once, in how many of its blocks it may be."""
    prepare(spark)
    monkeypatch.setattr(collocations, "THINNED", 20)
    docs = spark.createDataFrame([(lang, "the cat sat. on a mat " * 10) for lang in ("en", "de") * 20], "lang string, text string").coalesce(1)
    relation = docs.mapInArrow(collocations._first_relation(50), collocations._FIRST)
    assert relation.count() > 10
    shared = spark.sparkContext.broadcast(collocations.Filter(collocations._possible(relation, 1)))
    got = relation.mapInArrow(collocations._thinned(shared), "lang string, phrase string, a long").collect()
    assert sorted(map(tuple, got)) == sorted((lang, w, 200) for lang in ("en", "de") for w in "the cat sat on a mat".split())
