"""Operators on documents against plain versions."""

import hashlib
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from salesmix.llm import (
    bpe,
    exact_dedup,
    html_text,
    line_dedup,
    minhash_dedup,
    packing,
    queries,
    suffix_dedup,
    token_files,
    toxicity,
)
from salesmix.session import work_dir
from tests.llm import brute

VOCABULARY = public_tokenizers.path(queries.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(VOCABULARY)
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_exact_duplicates(docs, rows, no_docs):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for bits in (exact_dedup.MAX_FILTER_BITS, 512):  # a filter far too small changes nothing
        got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs, bits).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            same = groups[t or ""]
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))
            assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def test_exact_duplicates_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df).collect())
    assert got == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]


def test_near_copies(docs, rows, no_docs):
    want = brute.near_copies(rows)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert max(Counter(c for _, c in want.values()).values()) > 8
    assert minhash_dedup.near_duplicates(no_docs).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.75, 0.9):
        for n in (80, 2000):
            both = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
            rest = [rng.integers(0, 1 << 63, (n - len(both)) // 2, dtype=np.uint64) for _ in range(2)]
            a, b = (np.unique(np.r_[both, r]) for r in rest)
            regs = minhash_dedup.registers([a, b])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            found = minhash_dedup.estimate(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))[0]
            assert abs(found - true) < 0.16
    assert 1e-4 < minhash_dedup.collision_rate(np.array([1e4]), np.array([1e4]))[0] < 1e-3


def test_set_intersections_in_blocks():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (1, 5, 30, 50, 80)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:3]]
    assert minhash_dedup.shared_counts(sets[:3], sets).tolist() == want


@pytest.mark.parametrize("length", [400, 60])
def test_long_repeats(docs, rows, no_docs, length):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_dedup.removed_repeats(docs, length).collect()}
    assert got == brute.repeats(rows, length)
    assert suffix_dedup.removed_repeats(no_docs, length).count() == 0


def test_cut_texts_keep_rows_and_columns(docs, rows):
    got = suffix_dedup.without_repeats(docs)
    assert got.columns == docs.columns
    want = brute.repeats(rows, 400)
    for r in got.select("doc_id", "text", "spans").collect():
        assert r.spans == "1"
        if want[r.doc_id][1] == 0:
            assert hashlib.sha256((r.text or "").encode()).hexdigest() == want[r.doc_id][3]


def test_later_lines(spark, docs, rows, no_docs, words):
    lines = ["the house on the hill", "the mouse on the hill", "the house on the hills", "the hose on the hill",
             "tiny", "tinny", "  the house on the hill ", "a line of its own here", "he house on the hill",
             "the house on the hill!!", "x" * 90, "x" * 89, "x" * 40 + "y" + "x" * 49, " ".join(words[:60]),
             " ".join(words[:60]) + "s", " ".join(words[:30]) + "  " + " ".join(words[30:60])]
    more = [(5000 + k, "\n".join(lines[k % 5:] + lines[:k % 5] + [str(k) * 12])) for k in range(9)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    everything = rows + more
    want = brute.later_lines(everything, line_dedup.MIN_CHARS)
    got = line_dedup.without_repeated_lines(df, counts=True).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert sum(r.n_near for r in got) >= 5
    assert line_dedup.without_repeated_lines(docs).columns == docs.columns
    assert line_dedup.without_repeated_lines(no_docs).count() == 0


def test_bpe_as_the_library(docs, rows, library, no_docs):
    got = {r.doc_id: r for r in bpe.encoded(docs, VOCABULARY).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == " ".join(map(str, ids)) and got[i].n_tokens == len(ids)
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encoded(no_docs, VOCABULARY).count() == 0


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.Bpe(VOCABULARY))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aehinorst'’ -.0½éßÀİΣς\n\x00<|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_bpe_of_any_text(own, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode([text])[0] == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))


def test_token_files(spark, docs, rows, library, no_docs):
    folder = work_dir(spark, "tokens")
    token_files.write_token_files(docs, VOCABULARY, folder)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.document_checks(spark, folder).collect()}
    want, done = {}, 0
    for i, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (done, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        done += len(ids)
    assert got == want
    empty = work_dir(spark, "tokens")
    token_files.write_token_files(no_docs, VOCABULARY, empty)
    assert token_files.document_checks(spark, empty).count() == 0


def test_token_files_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(3, "a b"), (3, "c"), (None, "d e f"), (1, None)], "doc_id long, text string")
    folder = work_dir(spark, "tokens")
    token_files.write_token_files(df, VOCABULARY, folder)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in token_files.document_checks(spark, folder).collect())
    assert got == [(-1, 4), (1, 1), (3, 2), (3, 3)]


def test_packing(docs, rows, no_docs):
    capacity = 300
    got = packing.pack_documents(docs, capacity=capacity, max_per_source=2, shard_docs=30).collect()
    size = {i: len((t or "").replace("\x0b", " ").split(" ")) for i, t in rows}
    size = {i: len([w for w in (t or "").encode().split()]) for i, t in rows}
    pieces = defaultdict(int)
    bins = defaultdict(list)
    texts = dict(rows)
    for r in got:
        pieces[r.doc_id] += r.n_tokens
        if r.bin is not None:
            bins[r.shard, r.bin].append(r)
        else:
            assert r.n_tokens == 0
    assert pieces == size
    for inside in bins.values():
        inside.sort(key=lambda r: r.place)
        assert [r.place for r in inside] == list(np.cumsum([0] + [r.n_tokens for r in inside[:-1]]))
        assert sum(r.n_tokens for r in inside) <= capacity
        assert max(Counter(r.doc_id % 3 == 0 for r in inside).values()) <= 2
        assert len({(texts[r.doc_id] or "").lower() for r in inside}) == len(inside)
    assert packing.pack_documents(no_docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 2), st.integers(0, 6)), max_size=60))
def test_best_fit_takes_the_tightest_bin(items):
    items = sorted(items, key=lambda x: -x[0])
    assert packing.best_fit(items, 20, 2) == brute.first_compatible(items, 20, 2)


def test_toxicity_on_held_out_texts(spark, words, no_docs):
    rng = np.random.default_rng(8)
    insults = ["idiot", "moron", "scum", "worthless"]

    def text(bad):
        w = list(rng.choice(words, 60))
        for _ in range(2 * bad):
            w.insert(int(rng.integers(60)), str(rng.choice(insults)))
        return " ".join(w)

    rows = [(k, text(k % 4 == 0), int(k % 4 == 0)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.filter("doc_id < 300").select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    wrong = sum((got[k] >= 0.3) != bool(y) for k, _, y in rows if k >= 300)
    assert wrong <= 2
    odd = [(1, None), (2, ""), (3, "an i-d-i-o-t here"), (4, "an i d i o t here"), (5, "such an idi0t"), (6, None)]
    odd = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert odd[1] == odd[2] == odd[6] == min(odd.values()) and all(0 <= s <= 1 for s in odd.values())
    assert odd[4] >= 0.3 and odd[5] >= 0.3
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.without_toxic(df, model, 0.3).columns == df.columns


def test_toxicity_without_positives(spark):
    df = spark.createDataFrame([(1, "a b", 0), (2, None, None)], "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert all(r.score < 0.3 for r in toxicity.score(df, model).collect())


@pytest.mark.parametrize(("plain", "insults"), [
    ("мама мыла раму утром пока дождь стучал по крыше дома", ["дурак", "придурок"]),
    ("la casa de la colina tiene muchas ventanas y una puerta", ["ááč", "łžáá"]),
    ("το σπίτι στο λόφο έχει πολλά παράθυρα και μία πόρτα", ["βλάκας", "ηλίθιος"]),
    ("今天天气很好我们一起去公园散步然后回家吃饭", ["傻瓜", "蠢货"]),
])
def test_toxicity_of_all_scripts(plain, insults):
    rng = np.random.default_rng(4)
    gap = " " if " " in plain else ""
    words = plain.split() if gap else list(plain)

    def text(bad):
        w = list(rng.choice(words, 40))
        if bad:
            w.insert(int(rng.integers(40)), insults[int(rng.integers(2))])
        return gap.join(w)

    rows = [(text(k % 4 == 0), int(k % 4 == 0)) for k in range(400)]
    model = toxicity.fit_rows([t for t, _ in rows[:300]], [y for _, y in rows[:300]])
    got = toxicity.score_texts(model, [t for t, _ in rows[300:]], toxicity.Describer(model.kernel))
    assert ((got >= 0.3) == [y == 1 for _, y in rows[300:]]).all()


def test_toxicity_of_disguised_letters():
    kernel = toxicity.Kernel(["idiot", "дурак"])
    w, z, _ = kernel.values(["idi\u043et", "дур\u0061к", "idi\u4e2dt", "i-d-i-o-t"])
    assert list(zip(w.tolist(), z.tolist())) == [(0, 0), (1, 1), (2, 0), (3, 0)]


def test_toxicity_of_rare_insults_and_phrases(words):
    rng = np.random.default_rng(6)
    rare = ["zwqak", "bufkow", "yopvex", "gumpf", "dukjab", "wazzock", "knyvy", "pugwump", "fybbud", "muckzy"]
    phrases = ["eat cold soup", "green cow", "old tree stump", "wet sock"]
    harmless = " ".join(phrases).split()

    def text(insult=None):
        w = list(rng.choice(words, 30))
        for more in (str(rng.choice(harmless)), insult or ""):
            w.insert(int(rng.integers(30)), more)
        return " ".join(w)

    # Each in 0.5 % of 2,000 positive texts; the others hold a common insult.
    bad = [text(u) for u in rare + phrases for _ in range(10)]
    bad += [text("idiot") for _ in range(2000 - len(bad))]
    good = [text() for _ in range(4000)]
    model = toxicity.fit_rows(bad + good, [1] * len(bad) + [0] * len(good))
    describe = toxicity.Describer(model.kernel)
    for u in [*rare, *phrases, "idiot"]:
        assert (toxicity.score_texts(model, [text(u) for _ in range(10)], describe) >= 0.3).mean() >= 0.9, u
    assert (toxicity.score_texts(model, [text() for _ in range(300)], describe) >= 0.3).mean() <= 0.02
    few = toxicity.fit_rows(bad + good, [1] * len(bad) + [0] * len(good), landmarks=2)
    assert len(few.kernel.landmarks) == 2


def test_fit_holds_a_word_once(words):
    """The driver's memory follows the number of words by a list entry, not by a string each."""
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(words, 2000)) + (" idiot" if k % 4 == 0 else "") for k in range(200)]
    labels = [int(k % 4 == 0) for k in range(200)]
    tracemalloc.start()
    try:
        model = toxicity.fit_rows(texts, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert "idiot" in model.kernel.landmarks and peak < 45 * 2000 * 200


def test_phrases_end_with_their_sentence():
    describe = toxicity.Describer(toxicity.Kernel(["idiot", "green cow", "old tree stump", "8 9"]))
    found = []
    for t in ("a green - cow", "a green. cow", "green\ncow", "gr-een c0w", "an old, old tree stump", "8 9", "old stump"):
        words = toxicity.tokens(t)
        describe.learn(set(words))
        found.append([sorted(s) for s in describe.sentences(words) if s])
    assert found == [[[1]], [], [], [[1]], [[2]], [[3]], []]


@pytest.mark.parametrize(("html", "want"), [
    ("<html><head><title>t</title><meta charset=a><body><p>One<p>Two</html>", ["One", "Two"]),
    ("<head><title>t</title><style>p {}</style><article><p>One</article>", ["One"]),
    ("<head><title>t</title>Bare text<p>One", ["Bare text", "One"]),
    ("<head><noscript><img src=a></noscript><title>t</title></head><body><p>One", ["One"]),
    ("<head><noscript><link href=a><body><p>One", ["One"]),
    ("<head></head><body><p>One<head><p>Two", ["One", "Two"]),
    ("<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> then", ["If x=2 then"]),
    ("<div><noscript>Seen <p>One</noscript></div>", ["Seen", "One"]),
])
def test_pages_with_tags_left_out(html, want):
    assert [t for t in html_text.features(html_text.Page(html))[1] if t] == want
