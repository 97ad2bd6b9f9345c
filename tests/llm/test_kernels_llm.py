"""Small parts: range coder, suffix ranks, components, trees, pages, vectors."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from salesmix.llm import embedding_dedup, html_text, suffix_dedup
from salesmix.llm.boosting import fit_trees
from salesmix.llm.common import prepare
from salesmix.llm.components import components, spanning
from salesmix.llm.range_coder import decode_blocks, encode_blocks
from salesmix.llm.suffix_array import suffix_ranks
from tests.llm import brute


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 65535)), max_size=80), max_size=6))
def test_blocks_round_trip(blocks):
    got = decode_blocks(encode_blocks([np.array(b, dtype=np.int64) for b in blocks]))
    assert [g.tolist() for g in got] == blocks


def test_long_blocks_round_trip_and_shrink():
    rng = np.random.default_rng(2)
    ids = [np.minimum(rng.zipf(1.3, 4096), 60_000), np.zeros(4096, np.int64), np.arange(3000) % 5]
    coded = encode_blocks(ids)
    assert all((a == b).all() for a, b in zip(decode_blocks(coded), ids, strict=True))
    assert len(coded[1]) < 200 and len(coded[0]) < 2 * 4096


def test_damaged_blocks_are_noticed():
    block = bytearray(encode_blocks([np.arange(500)])[0])
    block[40] ^= 1
    with pytest.raises(ValueError):
        decode_blocks([bytes(block)])
    with pytest.raises(ValueError):
        decode_blocks([bytes(block[:-2])])
    with pytest.raises(ValueError):
        decode_blocks([b"nothing"])


def test_suffix_ranks(spark):
    prepare(spark)
    rng = np.random.default_rng(4)
    strings = [list(rng.integers(1, 3, n)) for n in (1, 2, 3, 17, 26)] + [[1, 2] * 8, [1, 2] * 8]
    rows = [(k, 0, j, int(s)) for k, x in enumerate(strings) for j, s in enumerate(x)]
    df = spark.createDataFrame(rows, "sid long, path long, j long, s long")
    suffix = {(k, j): x[j:] for k, x in enumerate(strings) for j in range(len(x))}
    got = {(r.sid, r.j): r.rank for r in suffix_ranks(df, levels=4).collect()}
    assert got == {at: sum(t < s for t in suffix.values()) for at, s in suffix.items()}
    assert suffix_ranks(df.filter("false")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    pairs += [(2000, 2000 + k) for k in range(40)] + [(7, 7)]
    g = brute.Groups({x for p in pairs for x in p})
    for p in pairs:
        g.join(*p)
    df = spark.createDataFrame([*pairs, (None, 4), (5, None)], "a long, b long")
    got = {r.id: r.component for r in components(df).collect()}
    assert got == {x: g.of(x) for p in pairs if p[0] != p[1] for x in p}
    assert components(df.filter("false")).count() == 0


def test_trees_learn_a_rule():
    rng = np.random.default_rng(7)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.3)).astype(float)
    model = fit_trees(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == (y[1500:] > 0.5)).mean() > 0.97


def test_vectors(spark):
    prepare(spark)
    rng = np.random.default_rng(10)
    heads = rng.normal(size=(12, 9))
    rows = [(k * 3, [float(x) for x in np.float32(heads[k % 12] + 0.12 * (k % 7) * rng.normal(size=9))]) for k in range(260)]
    rows += [(5001 + k, rows[4][1]) for k in range(30)] + [(6001, [2 * x for x in rows[4][1]])]
    odd = [None, [], [0.0] * 9, [float("nan")] * 9, [float("inf")] + [1.0] * 8, [None] + [1.0] * 8, [1.0, 0.0], [2.0, 0.0]]
    rows += [(7001 + k, v) for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rep", "2 AS copies", "3 AS key")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == brute.linked_vectors(rows, 0.9)
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert embedding_dedup.near_duplicates(df.filter("false")).count() == 0
    assert embedding_dedup.near_duplicates(df.filter("vec_id >= 7001 AND vec_id < 7007")).count() == 6


def vectors_with_groups():
    rng = np.random.default_rng(11)
    heads = rng.normal(size=(5, 40))
    rows = [(k * 3, [float(x) for x in np.float32(heads[k % 5] * (k % 2) + (0.1 if k % 2 else 1) * rng.normal(size=40))]) for k in range(300)]
    return rows + [(2001 + k, rows[k % 9][1]) for k in range(20)]


def test_vectors_of_many_chunks(spark, monkeypatch):
    prepare(spark)
    rows = vectors_with_groups()
    for name, value in (("BLOCK", 16), ("CHUNK", 4 * 16 * 40 * 8), ("FOLD", 0.5)):
        monkeypatch.setattr(embedding_dedup, name, value)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute.linked_vectors(rows, 0.9)


def test_vectors_are_not_shuffled_for_pairs(spark, monkeypatch):
    """What is compared comes from a scan; the pairs of blocks are no rows that hold them."""
    prepare(spark)
    kind, plans = type(spark.range(0)), []
    given = kind.mapInArrow

    def spy(self, *args, **more):
        if any(c.endswith("raw") for c in self.columns):
            plans.append(self._jdf.queryExecution().executedPlan().toString())
        return given(self, *args, **more)

    monkeypatch.setattr(kind, "mapInArrow", spy)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        embedding_dedup.near_duplicates(spark.createDataFrame(vectors_with_groups(), "vec_id long, embedding array<float>")).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans and not any("Exchange" in p or "Join" in p for p in plans)


def test_a_forest_in_place_of_links():
    rng = np.random.default_rng(12)
    links = rng.integers(0, 400, (300, 2)) * 7
    tree = spanning(links)
    g = brute.Groups(links.ravel().tolist())
    for a, b in links.tolist():
        g.join(a, b)
    want = {x: g.of(x) for x in set(links.ravel().tolist())}
    assert len(set(tree[:, 1].tolist())) == len(tree) == len(want) - len(set(want.values()))
    assert all(want[b] == a for a, b in tree.tolist())
    assert spanning(links[:0]).shape == (0, 2)


PAGE = ('<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li>'
        '<li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now</div><article><h1>Head %d</h1>'
        '<p>First &amp; long  paragraph, with words.<br>And more of them here.<p>Second <b>bold</b> one, also with words in it.'
        '</article><footer>&copy; somebody</footer></body></html>')


@pytest.fixture(scope="module")
def page_model():
    return html_text.fit_pages([PAGE % k for k in range(40)])


def test_pages(page_model):
    want = "Head 99\nFirst & long paragraph, with words. And more of them here.\nSecond bold one, also with words in it."
    renamed = (PAGE % 99).replace("<article>", '<div class="post content">').replace("</article>", "</div>")
    assert html_text.extract(page_model, [PAGE % 99, renamed, "", "<<<>", "no markup", "<p>" * 3000]) [:3] == [want, want, ""]


def test_no_contradiction():
    rng = np.random.default_rng(12)
    for _ in range(50):
        parent = [-1] + [int(rng.integers(0, k)) for k in range(1, 30)]
        score = np.log(rng.dirichlet([1, 1, 1], 30))
        keep = html_text.decode(parent, score)
        for k in range(1, 30):  # everything below a kept element is kept
            assert keep[k] or not keep[parent[k]]


def test_pages_table(spark, page_model):
    rows = [(1, "u", PAGE % 5), (1, "u", PAGE % 5), (2, None, None), (3, "v", ""), (None, "w", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS n_chars")
    got = html_text.main_text(df, page_model).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert html_text.main_text(df.filter("false"), page_model).count() == 0
    assert len(html_text.fit(df, 5).main.leaves) > 0
    html_text.fit(df.filter("false"))


def test_anchors_are_the_least_hash_leftmost_of_equals():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = 97  # equal hashes side by side
    h, at = suffix_dedup.anchors_of(data, 60, 20)
    place = np.uint64((1 << (suffix_dedup.SEGMENT + 60).bit_length()) - 1)
    part = suffix_dedup.anchors_of(data[500:2000], 60, 20)[1]  # a shorter buffer has the same anchors
    assert part.tolist() == (at[500:500 + len(part)] - 500).tolist()
    assert at.tolist() == [k + int(np.argmin(h[k:k + 41] & ~place)) for k in range(len(data) - 59)]
    keys = rng.integers(0, 50, 999).astype(np.uint64)
    first = {}
    assert suffix_dedup.firsts_of(keys).tolist() == [first.setdefault(v, k) for k, v in enumerate(keys.tolist())]
