"""Conversation prefix trie (11): ROLLUP over positional turn-id columns.

A turn is known by 128 bits of its role, text and place. A conversation lies in
blocks of ``width`` positional columns, one row per block; a block is keyed by
the node that its predecessor ends in (its anchor: the XOR of the bits of all
turns so far), so all blocks of all conversations go through one
``GROUP BY block, anchor, ROLLUP(t1 ... tn)`` and ``grouping_id`` tells a node's
depth. No round depends on the length of the longest conversation.

Sums over subtrees need no second walk from the leaves: a node is owned by its
smallest member, so a conversation owns the lower end of its own path, from
some depth on. What it owns (code points, whether its end is a leaf) is one row
per conversation, and a second ROLLUP adds it up over the members of every
node.

No group is gathered: turns are numbered, and anchors run on, over range slices
(``plans.prefix``); members of a node are counted before the shuffle; the
identifiers that end in a node are joined to pieces of bounded length where
they lie sorted, and only pieces meet, streamed through the hash. A node with
very many children is the hot side of a join that AQE splits.

Defined results: rows without conv_id take no part; null role or text is empty;
a null turn comes first; turns with one number are ordered by a hash of role
and text (repeated rows are turns of their own); identifiers of either sign
(the prefix comes from ``c - c % 100``, remainder with the sign of c); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import pin
from riskframe.plans.prefix import SLICE, rank_within, with_slices

WIDTH = 8
PIECE = 1 << 15  # characters of a piece of joined identifiers
KEY = ["key1", "key2", "depth"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(conv_id, pos, k1, k2, chars): every turn by its place from 1, as a hash of role and text."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.filter(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.xxhash64(role, text).alias("k1"), F.xxhash64(text, F.lit(7), role).alias("k2"), F.length(text).cast("bigint").alias("chars"))
    ranked = rank_within(turns, ["conv_id"], ["turn", "k1", "k2"], out="pos")
    return ranked.select(F.col("conv_id"), F.col("pos").cast("bigint"), "k1", "k2", "chars")


def with_shared_heads(turns: DataFrame, every: int = 100, modulus: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (their turns, one row per conversation).

    The first ``h = crc32(c) mod modulus`` turns of conversation ``c - c % every``,
    then c's own turns after its first h.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(modulus)).cast("bigint")
    base = F.col("conv_id") - F.col("conv_id") % F.lit(every)
    first = (turns.filter((F.col("conv_id") % F.lit(every) == 0) & (F.col("pos") < modulus)).groupBy(F.col("conv_id").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("pos", "k1", "k2", "chars"))).alias("head")))  # under ``modulus`` turns each
    convs = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), base.alias("base")).join(first, "base", "left")
    convs = pin(convs.select("conv_id", "h", F.filter(F.coalesce("head", F.array().cast(first.schema["head"].dataType)),
                                                     lambda t: t["pos"] <= F.col("h")).alias("head")), "trie-heads")
    heads = convs.select("conv_id", F.inline("head"))
    tails = (turns.join(convs.select("conv_id", "h", F.size("head").alias("cut")), "conv_id").filter("pos > h")
             .select("conv_id", (F.col("pos") - F.col("h") + F.col("cut")).alias("pos"), "k1", "k2", "chars"))
    return heads.unionByName(tails), convs.select("conv_id")


def _anchors(full: DataFrame) -> DataFrame:
    """(conv_id, block, a1, a2, before) of every block after a full one: running XOR and characters over range slices."""
    cells = {"a1": F.bit_xor, "a2": F.bit_xor, "before": F.sum}
    cut = with_slices(full.select("conv_id", "block", F.col("x1").alias("a1"), F.col("x2").alias("a2"), F.col("chars").alias("before")),
                      ["conv_id"], ["block"])
    slices = cut.groupBy("conv_id", SLICE).agg(*[f(c).alias(c) for c, f in cells.items()])
    earlier = Window.partitionBy("conv_id").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offset = slices.select("conv_id", SLICE, *[F.coalesce(f(c).over(earlier), F.lit(0)).alias(f"o_{c}") for c, f in cells.items()])
    here = Window.partitionBy("conv_id", SLICE).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("conv_id", SLICE, (F.col("block") + 1).alias("block"), *[f(c).over(here).alias(c) for c, f in cells.items()])
    both = local.join(offset, ["conv_id", SLICE])
    return both.select("conv_id", "block", *[F.col(c).bitwiseXOR(F.col(f"o_{c}")).alias(c) for c in ("a1", "a2")],
                       (F.col("before") + F.col("o_before")).alias("before"))


def blocks(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """One row per conversation and block: conv_id, block, anchor (a1, a2), before, t1..tn, x1, x2, length and total of the conversation.

    ``t`` holds the bits of a turn in its place and its characters; a conversation without turns has one empty block.
    """
    placed = turns.select("conv_id", F.expr(f"(pos - 1) div {width}").alias("block"), ((F.col("pos") - 1) % width).alias("slot"),
                          F.xxhash64("k1", "k2", "pos").alias("f1"), F.xxhash64("pos", "k2", "k1").alias("f2"), "chars")
    cells = pin(placed.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("slot", "f1", "f2", "chars"))).alias("cells"), F.bit_xor("f1").alias("x1"),
        F.bit_xor("f2").alias("x2"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n")), "trie-blocks")
    whole = cells.groupBy("conv_id").agg(F.sum("n").alias("length"), F.sum("chars").alias("total"))
    rows = cells.join(_anchors(cells.filter(F.col("n") == width)), ["conv_id", "block"], "left").join(whole, "conv_id")
    none = convs.join(whole, "conv_id", "left_anti")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    cell = lambda i: F.when(F.col("n") > i, F.struct(*[F.get("cells", i)[c].alias(c) for c in ("f1", "f2", "chars")]))
    rows = rows.unionByName(none, allowMissingColumns=True)
    return rows.select("conv_id", *[zero(c) for c in ("block", "a1", "a2", "before", "x1", "x2", "length", "total")],
                       *[cell(i).alias(f"t{i + 1}") for i in range(width)])


def _rollup(rows: DataFrame, width: int, measures: str) -> DataFrame:
    """All prefixes together: key1, key2, depth, own bits (f1, f2) and characters of the last turn, upto, and ``measures``."""
    ids = ", ".join(f"t{i + 1}" for i in range(width))
    per = rows.sparkSession.sql(
        f"SELECT block, a1, a2, {ids}, {width} - bit_count(grouping_id()) AS level, min(before) AS before, {measures} "
        f"FROM {{rows}} GROUP BY block, a1, a2, ROLLUP({ids})", rows=rows)
    turns = F.array(*[f"t{i + 1}" for i in range(width)])
    last = F.get(turns, F.col("level") - 1)
    # a prefix ends in a turn; the empty one is the root, and for later blocks the node before them
    per = per.filter(last.isNotNull() | ((F.col("level") == 0) & (F.col("block") == 0)))
    known = F.filter(turns, lambda t: t.isNotNull())
    fold = lambda start, f: F.aggregate(F.transform(known, lambda t: t[f]), start, lambda a, x: a.bitwiseXOR(x))
    names = [c for c in per.columns if c not in {"block", "a1", "a2", "level", "before", *ids.split(", ")}]
    return per.select(
        fold(F.col("a1"), "f1").alias("key1"), fold(F.col("a2"), "f2").alias("key2"),
        (F.col("block") * width + F.col("level")).alias("depth"), last["f1"].alias("f1"), last["f2"].alias("f2"),
        F.coalesce(last["chars"], F.lit(0)).alias("chars"),
        (F.col("before") + F.aggregate(known, F.lit(0).cast("bigint"), lambda a, t: a + t["chars"])).alias("upto"), *names)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) rows to pieces of comma-joined identifiers."""
    key, first, ids, size = None, 0, [], 0
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*KEY, "first", "ids"])
        out.clear()
        return batch

    for b in batches:
        for row in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
            if row[:3] != key or size > PIECE:
                if ids:
                    out.append((*key, first, ",".join(ids)))
                key, first, ids, size = row[:3], row[3], [], 0
            ids.append(str(row[3]))
            size += len(ids[-1]) + 1
        if len(out) > 512:
            yield flush()
    if ids:
        out.append((*key, first, ",".join(ids)))
    yield flush()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one digest per node, streamed."""
    key, sha = None, None
    for b in batches:
        out = []
        for row in zip(*[b.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
            if row[:3] != key:
                if sha:
                    out.append((*key, sha.hexdigest()))
                key, sha = row[:3], hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(row[3].encode())
        if out:
            yield _ends_batch(out)
    if sha:
        yield _ends_batch([(*key, sha.hexdigest())])


def _ends_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True)],
                                      names=[*KEY, "ends_sha256"])


def ends(rows: DataFrame, width: int) -> DataFrame:
    """(key1, key2, depth, ends_sha256) of every node in which conversations end."""
    last = F.col("block") == F.expr(f"greatest(length - 1, 0) div {width}")
    at = rows.filter(last).select(F.col("a1").bitwiseXOR(F.col("x1")).alias("key1"), F.col("a2").bitwiseXOR(F.col("x2")).alias("key2"),
                                  F.col("length").alias("depth"), F.col("conv_id").alias("first"))
    kinds = ", ".join(f"{c} bigint" for c in [*KEY, "first"])
    pieces = (at.repartitionByRange(*KEY, "first").sortWithinPartitions(*KEY, "first").mapInArrow(_pieces, f"{kinds}, ids string"))
    return (pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first")
            .mapInArrow(_hashes, ", ".join(f"{c} bigint" for c in KEY) + ", ends_sha256 string"))


def trie(turns: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, pos, k1, k2, chars); ``convs`` lists all conversations."""
    rows = pin(blocks(turns, convs, width), "trie-rows")
    nodes = pin(_rollup(rows, width, "min(conv_id) AS conv_id, max(length) AS longest"), "trie-nodes")
    owned = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.max("depth").alias("last"), F.sum("chars").alias("own"),
        F.min(F.col("upto") - F.col("chars")).alias("above"), F.max((F.col("longest") == F.col("depth")).cast("bigint")).alias("leaf"))
    owned = pin(owned, "trie-owned")
    # the top node of what a conversation owns hangs on another's node; below it parent and child have one owner
    tops = pin(nodes.join(owned.select("conv_id", F.col("top").alias("depth")), ["conv_id", "depth"]).filter("depth > 0").select(
        F.col("conv_id").alias("child"), F.col("key1").bitwiseXOR(F.col("f1")).alias("key1"),
        F.col("key2").bitwiseXOR(F.col("f2")).alias("key2"), (F.col("depth") - 1).alias("depth")), "trie-tops")
    hanging = tops.groupBy(*KEY).agg(F.count(F.lit(1)).alias("hanging"))
    parents = tops.join(nodes.select(*KEY, F.col("conv_id").alias("parent")), KEY).select(F.col("child").alias("conv_id"), "parent")
    owned = pin(owned.join(parents, "conv_id", "left"), "trie-owners")

    measured = rows.join(owned.select("conv_id", "own", "leaf"), "conv_id", "left")
    sums = _rollup(measured, width, "min(conv_id) AS conv_id, count(1) AS n_convs, sum(total) AS total, "
                                    "sum(coalesce(own, 0)) AS owned, sum(coalesce(leaf, 0)) AS n_leaves")
    out = (sums.join(owned.select("conv_id", "top", "last", "above", "parent"), "conv_id")
           .join(hanging, KEY, "left").join(ends(rows, width), KEY, "left"))
    over = F.col("upto") - F.col("chars")  # characters above the node's own turn, the same for all members
    every_turn = F.col("total") - F.col("n_convs") * over
    every_node = F.col("owned") + F.col("above") - over
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs", (F.coalesce("hanging", F.lit(0)) + (F.col("last") > F.col("depth")).cast("bigint")).alias("n_children"),
        F.col("n_leaves"), (every_turn - every_node).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, every: int = 100, modulus: int = 6, width: int = WIDTH) -> DataFrame:
    """The trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = pin(numbered_turns(conversations), "trie-turns")
    rebuilt, convs = with_shared_heads(turns, every, modulus)
    return trie(rebuilt, convs, width)
