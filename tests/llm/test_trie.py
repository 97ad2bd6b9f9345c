"""Prefix trie and list ranking against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from salesmix.llm import list_ranking, prefix_trie, queries
from salesmix.llm.common import prepare
from salesmix.llm.scan import BLOCK, numbered, running

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append(((t is not None, t or 0), r, hashlib.sha256(f"{len(r)}|{r}|{x}".encode()).hexdigest(), x))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in by.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below, out = {}, []
    for node in sorted(members, key=len, reverse=True):
        words = len([w for w in re.split("[\x20\x09-\x0d]+", node[-1][1]) if w]) if node else 0
        leaves = sum(below[k][0] for k in children[node]) or 1
        saved = (len(members[node]) - 1) * words + sum(below[k][1] for k in children[node])
        below[node] = leaves, saved
        ends = ",".join(str(c) for c in members[node] if len(rebuilt[c]) == len(node))
        out.append((members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]),
                    len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(spark, rows):
    prepare(spark)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    df = df.withColumns({"node": F.lit("x"), "depth": F.lit(1), "N_CONVS": F.lit(None).cast("string"), "pos": F.lit(2.0)})
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(df).select(*COLUMNS).collect()), key=lambda r: r[:2])


def test_nulls_ties_and_repeated_rows(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(45), 61, 63, 1000, 1003]:
        for t in range(rng.randint(1, 6)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c\td e", "", None, "ü 汉 x"])))
    rows += [(7, 1, "user", "same")] * 5 + [(None, 0, "user", "lost"), (8, None, None, None), (8, None, None, None)]
    rows += [(90, 3, "user", "tie 1"), (90, 3, "user", "tie 2"), (90, 3, "assistant", "tie 3")]
    assert found(spark, rows) == plain_trie(rows)


def test_a_conversation_longer_than_a_block_and_copies(spark):
    rows = [(40, t, "user", f"turn {t % 7}") for t in range(2 * BLOCK + 5)]
    rows += [(c, t, "user", f"turn {t % 7}") for c in range(100, 500) for t in range(2)]
    rows += [(41, t, "user", f"turn {t % 7}") for t in range(BLOCK)]
    assert found(spark, rows) == plain_trie(rows)


def test_one_conversation_and_none(spark):
    assert found(spark, [(5, 0, "user", "only words here")]) == plain_trie([(5, 0, "user", "only words here")])
    assert found(spark, [(23, 0, "user", "base is absent")]) == plain_trie([(23, 0, "user", "base is absent")])
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "user", "x")]) == []


def test_texts_of_nodes(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, None, None), (1, 2, "user", "bye"), (1, 3, "a", "end")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = prefix_trie.with_texts(prefix_trie.conversation_trie(df), df).orderBy("depth").collect()
    assert [(r.role, r.text) for r in got][0] == (None, None)
    assert {(r.role, r.text) for r in got[1:]} <= {("user", "hello"), ("", ""), ("user", "bye"), ("a", "end")}
    assert [r.tour_place for r in got] == list(range(len(got))) and got[0].n_nodes == len(got)


@pytest.mark.parametrize("order", ["near", "shuffled"])
def test_list_ranking(spark, order):
    """Several lists, ids near each other or not, tasks of few items."""
    rng = random.Random(1)
    ids = list(range(3000))
    if order == "shuffled":
        rng.shuffle(ids)
    lists, rows, want = [ids[:2500], ids[2500:2999], ids[2999:]], [], {}
    for items in lists:
        total = 0
        for i, nxt in zip(items, [*items[1:], None], strict=True):
            weight = rng.randint(0, 9)
            rows.append((i, nxt, weight, 1))
            want[i] = (total, items.index(i))
            total += weight
    df = spark.createDataFrame(rows, "id long, following long, w int, one int").repartition(3)
    got = list_ranking.prefix_sums(df, ["w", "one"], task_items=200).collect()
    assert {r.id: (r.w, r.one) for r in got} == want and len(got) == 3000
    assert list_ranking.prefix_sums(df.filter("false"), ["w"]).collect() == []


def test_numbers_and_running_sums(spark):
    n = BLOCK * BLOCK // 256 + 3  # more than one block of blocks would need with a smaller block
    df = spark.range(n).select((F.col("id") % 7).alias("key"), (F.col("id") % 5).alias("v"))
    placed = numbered(df.repartition(6), ["key"], "place", "test")
    got = running(placed, "place", n, {"upto": ("v", "sum"), "mix": ("v", "bit_xor")}).orderBy("place").collect()
    total = mix = 0
    assert [r.place for r in got] == list(range(n)) and [r.key for r in got] == sorted(r.key for r in got)
    for r in got:
        total, mix = total + r.v, mix ^ r.v
        assert (r.upto, r.mix) == (total, mix)


def test_registered(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_conversation_trie(spark, sf_dir).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[:2]) == plain_trie(rows)
