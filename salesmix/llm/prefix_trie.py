"""Prefix trie of conversations, with figures of every subtree by an Euler tour.

A node is a distinct sequence of first turns; conversations that begin with it are its
members.  Sequences are told apart by a sum (exclusive or) of digests of their turns with
their places, so that the prefixes of a conversation, however long, are running sums over
sorted rows.  Nodes are numbered by their smallest member and depth; a node's first child
and next sibling come from the nodes in order of parent and number.

The Euler tour of the tree enters and leaves every node once: entering leads to the first
child or else to leaving, leaving to the next sibling or else to leaving the parent.  The
tour is a linked list, ranked distributedly (list_ranking); with the arcs in their places,
what a subtree adds up to is the difference of the prefix sums at its two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesmix.llm.common import settled, stored, text_or_empty
from salesmix.llm.list_ranking import prefix_sums
from salesmix.llm.packing import word_count
from salesmix.llm.scan import numbered, running

FAMILY, MOST_SHARED = 20, 4  # conversations that share a beginning; the turns shared are below this
ID_RUN = 4096  # ids in one piece of a list that is hashed
LANES = ["a", "b", "c"]
_LANE_HEX = 15  # 60 bits


def _sha(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", *columns).cast("binary"), 256)


def _turn_digest() -> Column:
    role, text = text_or_empty("role"), text_or_empty("text")
    return _sha(F.length(role).cast("string"), role, text)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, turn_sha256, words, n: turns in order, each with its place (from 0).

    Order is by turn, null first; equal turn numbers go by role, then by the digest of role
    and text.  Null role or text is empty.  ``n`` numbers all turns, conversation by
    conversation.  Rows without a conv_id belong to no conversation and are left out.
    """
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_or_empty("role").alias("role"),
        _turn_digest().alias("turn_sha256"), word_count(F.col("text")).alias("words"))
    rows = stored(numbered(rows, ["conv_id", "turn", "role", "turn_sha256"], "n", "trie-sorted").drop("turn", "role"), "trie-turns")
    first = rows.groupBy("conv_id").agg(F.min("n").alias("first_n"))
    return rows.join(first, "conv_id").withColumn("pos", F.col("n") - F.col("first_n")).drop("first_n")


def with_shared_beginnings(turns: DataFrame, family: int = FAMILY, most_shared: int = MOST_SHARED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations that begin like the first of their family.

    Conversation c takes the first h turns of conversation c - pmod(c, family) (all if it has
    fewer, none if it is absent), then its own after its first h, h = crc32(decimal c) % most_shared.

    Returns (conversations, taken, own): conv_id; conv_id, pos, turn_sha256, words of the turns
    taken; the same and n for every turn of c itself, with a null pos where it was replaced.
    """
    c = F.col("conv_id")
    convs = turns.select("conv_id").distinct().select(
        "conv_id", (c - F.pmod(c, F.lit(family))).alias("base"),
        (F.crc32(c.cast("string").cast("binary")) % most_shared).cast("int").alias("h"))
    heads = turns.filter(F.col("pos") < most_shared - 1).select(
        F.col("conv_id").alias("base"), F.struct("pos", "turn_sha256", "words").alias("turn"))
    heads = heads.groupBy("base").agg(F.sort_array(F.collect_list("turn")).alias("turns"))  # below most_shared each
    convs = convs.join(heads, "base", "left").select("conv_id", "h", F.slice("turns", F.lit(1), F.col("h")).alias("turns"))
    convs = stored(convs.withColumn("k", F.coalesce(F.size("turns"), F.lit(0)).cast("long")), "trie-conversations")
    own = turns.join(convs.select("conv_id", "h", "k"), "conv_id")
    pos = F.when(F.col("pos") >= F.col("h"), F.col("pos") - F.col("h") + F.col("k"))
    return convs.select("conv_id"), convs.filter("k > 0").select("conv_id", F.inline("turns")), own.withColumn("pos", pos).drop("h", "k")


def prefixes(taken: DataFrame, own: DataFrame) -> DataFrame:
    """conv_id, depth, words, turn_sha256, prefix and parent (three lanes each) of each prefix but the empty one."""
    digest = _sha(F.col("pos").cast("string"), F.col("turn_sha256"))
    lane = [F.when(F.col("pos").isNull(), F.lit(0).cast("long"))  # a turn that was replaced changes no prefix
            .otherwise(F.conv(F.substring(digest, 1 + _LANE_HEX * k, _LANE_HEX), 16, 10).cast("long")).alias(x)
            for k, x in enumerate(LANES)]
    own = stored(own.select("conv_id", "pos", "words", "turn_sha256", "n", *lane), "trie-own")
    sums = stored(running(own, "n", own.count(), {f"{x}_upto": (x, "bit_xor") for x in LANES}), "trie-sums")
    # The prefixes made of taken turns, fewer than MOST_SHARED, and the running sums where c's own rows begin.
    upto = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = taken.select("conv_id", "pos", "words", "turn_sha256", *lane)
    begin = stored(begin.withColumns({f"{x}_prefix": F.expr(f"bit_xor({x})").over(upto) for x in LANES}), "trie-taken")
    shared = begin.groupBy("conv_id").agg(*[F.max_by(f"{x}_prefix", "pos").alias(f"{x}_shared") for x in LANES])
    first = sums.groupBy("conv_id").agg(F.min_by(F.struct(*[F.col(f"{x}_upto").bitwiseXOR(F.col(x)).alias(x) for x in LANES]), "n").alias("first"))
    start = first.join(shared, "conv_id", "left").select(
        "conv_id", *[F.col(f"first.{x}").bitwiseXOR(F.coalesce(f"{x}_shared", F.lit(0))).alias(f"{x}_start") for x in LANES])
    rest = sums.filter("pos IS NOT NULL").join(start, "conv_id").withColumns(
        {f"{x}_prefix": F.col(f"{x}_upto").bitwiseXOR(F.col(f"{x}_start")) for x in LANES})
    columns = ["conv_id", (F.col("pos") + 1).alias("depth"), "words", "turn_sha256", *[f"{x}_prefix" for x in LANES],
               *[F.col(f"{x}_prefix").bitwiseXOR(F.col(x)).alias(f"{x}_parent") for x in LANES]]
    return stored(rest.select(*columns).unionByName(begin.select(*columns)), "trie-prefixes")


def _nodes(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """node, conv_id, depth, n_convs, words, turn_sha256, prefix, parent: each distinct prefix; 0 is the root."""
    key = [f"{x}_prefix" for x in LANES]
    same = ["depth", "words", "turn_sha256", *[f"{x}_parent" for x in LANES]]
    found = paths.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                    *[F.min(c).alias(c) for c in same])
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.withColumns({"depth": F.lit(0).cast("long"), "words": F.lit(0).cast("long"), "turn_sha256": F.lit(None).cast("string"),
                             **{k: F.lit(0).cast("long") for k in key}, **{k: F.lit(None).cast("long") for k in same[3:]}})
    return stored(numbered(found.unionByName(root), ["conv_id", "depth"], "node", "trie-found"), "trie-nodes")


def _tree(nodes: DataFrame) -> DataFrame:
    """Each node with its parent, parent_conv_id, next sibling, first child and n_children."""
    above = nodes.select(*[F.col(f"{x}_prefix").alias(f"{x}_parent") for x in LANES], F.col("node").alias("parent"),
                         F.col("conv_id").alias("parent_conv_id"))
    child = nodes.filter("depth > 0").select("node", *[f"{x}_parent" for x in LANES]).join(above, [f"{x}_parent" for x in LANES])
    child = stored(numbered(child.select("node", "parent", "parent_conv_id"), ["parent", "node"], "s", "trie-children"), "trie-siblings")
    after = child.select((F.col("s") - 1).alias("s"), F.col("node").alias("after"), F.col("parent").alias("after_parent"))
    child = child.join(after, "s", "left").withColumn("sibling", F.when(F.col("after_parent") == F.col("parent"), F.col("after")))
    kids = child.groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("first_child"), F.count(F.lit(1)).alias("n_children"))
    return stored(nodes.drop(*[f"{x}_parent" for x in LANES])
                  .join(child.select("node", "parent", "parent_conv_id", "sibling"), "node", "left")
                  .join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-tree")


def _subtrees(tree: DataFrame) -> DataFrame:
    """node, tour_place, n_nodes, n_leaves, saved_tokens from the Euler tour."""
    node, zero = F.col("node"), F.lit(0).cast("long")
    enter = F.struct((node * 2).alias("id"), F.coalesce(F.col("first_child") * 2, node * 2 + 1).alias("following"), F.lit(1).cast("long").alias("place"),
                     (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    leave = F.struct((node * 2 + 1).alias("id"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("following"),
                     F.lit(1).cast("long").alias("place"), zero.alias("leaves"), zero.alias("saved"))
    arcs = tree.select(F.inline(F.array(enter, leave)))
    sums = prefix_sums(arcs, ["place", "leaves", "saved"])
    entering = F.col("id") % 2 == 0
    spent = lambda c: F.sum(F.when(entering, -F.col(c)).otherwise(F.col(c)))
    return sums.groupBy(F.floor(F.col("id") / 2).cast("long").alias("node")).agg(
        F.min("place").alias("tour_place"), ((spent("place") + 1) / 2).cast("long").alias("n_nodes"),
        spent("leaves").alias("n_leaves"), spent("saved").alias("saved_tokens"))


def _list_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: SHA-256 of the node's conv_ids, ascending and joined by commas.

    Tasks make strings of ``ID_RUN`` ids; the strings of a node then pass through one
    hash in order, a batch at a time, as the digest of a list allows no other way.
    """
    placed = numbered(ends, ["node", "conv_id"], "e", "trie-ends")
    runs = placed.groupBy("node", F.floor(F.col("e") / ID_RUN).alias("run")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            done = []
            for n, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if n != node:
                    if state:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())],
                                             ["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    return runs.repartition("node").sortWithinPartitions("node", "run").select("node", "ids").mapInArrow(
        digests, "node long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, family: int = FAMILY, most_shared: int = MOST_SHARED) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) with shared beginnings, a row a node.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256; then tour_place, n_nodes (in the subtree) and
    turn_sha256 of the node's last turn.  See ``ordered_turns`` for nulls, ties and repeated
    rows, each of which is a turn of its own.  Texts may be of any length, only digests and word
    counts are shuffled.  Other columns are ignored.  An empty table has no nodes.
    """
    return settled(conversations.sparkSession, "trie", lambda: _trie(conversations, family, most_shared))


def _trie(conversations: DataFrame, family: int, most_shared: int) -> DataFrame:
    convs, taken, own = with_shared_beginnings(ordered_turns(conversations), family, most_shared)
    paths = prefixes(taken, own)
    nodes = _nodes(convs, paths)
    tree = _tree(nodes)
    key = [f"{x}_prefix" for x in LANES]
    last = paths.groupBy("conv_id").agg(F.max_by(F.struct(*key), "depth").alias("last"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"last.{k}", F.lit(0)).alias(k) for k in key])
    ends = ends.join(nodes.select("node", *key), key).select("node", "conv_id")
    found = tree.join(_subtrees(tree), "node").join(_list_digests(ends), "node", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
                        "tour_place", "n_nodes", "turn_sha256")


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes with role and text of their last turn (null at the root)."""
    turns = conversations.select(_turn_digest().alias("turn_sha256"), text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    return nodes.join(turns.dropDuplicates(["turn_sha256"]), "turn_sha256", "left")
