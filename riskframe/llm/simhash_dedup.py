"""SimHash near-dedup (2): BK-trees over fingerprint shards.

A document's fingerprint has a bit set where over half of its shingle hashes
have it. Equal fingerprints become one node. Two fingerprints within ``radius``
bits agree wholly on at least one of ``radius + 1`` blocks of bits, so a shard
is (block, value) and every possible link lies in some shard; no pair outside
is looked at and none is missed.

Inside a shard a BK-tree holds the fingerprints: a child hangs on the edge
numbered by its Hamming distance to the parent, and a search follows only the
edges within ``radius`` of its own distance. A shard of more than
``tree_size`` fingerprints is cut into several trees, and each tree is sent to
every part of the same shard, so a hot block value is spread over many tasks.
Of the links found only a spanning forest per tree is passed on (a group of g
linked fingerprints gives at most g - 1 edges there), which loses no component.

Defined results: null or wordless texts have fingerprint zero and link like any
other; repeated rows share all values; a null id is never a component id unless
the component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import keep_rows, pin, row_keys
from riskframe.llm.components import connected_components

SHINGLE = 3
RADIUS = 3
SEED = 42
TREE_SIZE = 512
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, repeats included."""
    from xxhash import xxh64_intdigest
    # bytes.lower() changes A-Z only; bytes.split() cuts at 0x20 and 0x09-0x0D
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
        starts = [0, *[e + 1 for e in ends[:-shingle]]]
        hashes = [xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1:], strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), HASHES_AT_ONCE):
        part = np.array(hashes[i:i + HASHES_AT_ONCE], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in (0, 2, 3)], pa.array(fp.view(np.int64))],
                                             names=["doc_id", "__k1", "__k2", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, row keys, fp) of every row."""
    return (docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                        *row_keys(id_col, text_col))
            .mapInArrow(_fingerprints(shingle, seed), "doc_id bigint, __k1 bigint, __k2 bigint, fp bigint"))


class BKTree:
    """Fingerprints with children keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, fp: int) -> None:
        at = 0
        if self.items:
            while True:
                d = (fp ^ self.items[at]).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = len(self.items)
                    break
                at = nxt
        self.items.append(fp)
        self.children.append({})

    def within(self, fp: int, radius: int) -> list[int]:
        """Positions of the items at most ``radius`` away."""
        found, todo = [], [0] if self.items else []
        while todo:
            at = todo.pop()
            d = (fp ^ self.items[at]).bit_count()
            if d <= radius:
                found.append(at)
            lo, hi = d - radius, d + radius
            todo.extend(child for edge, child in self.children[at].items() if lo <= edge <= hi)
        return found


def spanning_links(tree_part: list[int], query_part: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Edges that join what links within ``tree_part`` (``query_part`` None), or across the two parts."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    edges, tree = [], BKTree()

    def link(fp: int) -> None:
        for at in tree.within(fp, radius):
            a, b = root(fp), root(tree.items[at])
            if a != b:
                up[max(a, b)] = min(a, b)
                edges.append((fp, tree.items[at]))

    for fp in tree_part:
        if query_part is None:
            link(fp)
        tree.add(fp)
    for fp in query_part or ():
        link(fp)
    return edges


def _search(radius: int):
    """Rows sorted by (shard, pair); side 0: self, 1: tree, 2: query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, queries = None, [], []

        def flush() -> list[tuple[int, int]]:
            if len(own) + len(queries) < 2:
                return []
            return spanning_links(own, queries if key[1] else None, radius)

        for b in batches:
            out: list[tuple[int, int]] = []
            shard, pair, side = (b.column(i).to_numpy() for i in range(3))
            fps = b.column(3).to_numpy().view(np.uint64)
            cut = np.flatnonzero((shard[1:] != shard[:-1]) | (pair[1:] != pair[:-1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                here = (int(shard[lo]), int(side[lo] > 0), int(pair[lo]))
                if here != key:
                    out += flush()
                    key, own, queries = here, [], []
                s, f = side[lo:hi], fps[lo:hi]
                own += f[s < 2].tolist()
                queries += f[s == 2].tolist()
            if out:
                yield _edges(out)
        if key is not None and (out := flush()):
            yield _edges(out)
    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a[:, i])) for i in (0, 1)], names=["u", "v"])


def shard_masks(n: int, radius: int, tree_size: int) -> list[int]:
    """Bit masks (signed) such that fingerprints within ``radius`` bits agree on all bits of one of them.

    The 64 bits are cut into radius + a blocks; a link leaves at least a of them untouched, so every choice
    of a blocks is a mask. More blocks mean more masks but finer shards: the plan with the fewest copies of
    a fingerprint, one for each tree of each of its shards, is taken for ``n`` fingerprints.
    """
    def copies(a: int) -> float:
        bits = 64 * a / (radius + a)
        return math.comb(radius + a, a) * max(1.0, n / 2.0 ** bits / tree_size)

    a = min(range(1, max(2, 65 - radius)), key=copies)
    cuts = [64 * i // (radius + a) for i in range(radius + a + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    masks = [sum(c) for c in combinations(blocks, a)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Spanning edges (u, v) between distinct fingerprints (column fp) at most ``radius`` bits apart."""
    masks = shard_masks(fps.count(), radius, tree_size)
    members = (fps.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("shard")))
    # shards too large for one tree; the others need no entry
    big = (members.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tree_size)
           .select("shard", F.ceil(F.col("n") / F.lit(tree_size)).cast("int").alias("trees")))
    parts = (members.join(big, "shard", "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
             .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1))))
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(lo == hi, 0).when(F.col("part") == lo, 1).otherwise(2)
    return (parts.select("shard", (lo * F.col("trees") + hi).cast("bigint").alias("pair"), side.alias("side"), "fp")
            .repartition("shard", "pair").sortWithinPartitions("shard", "pair")
            .mapInArrow(_search(radius), "u bigint, v bigint"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                  radius: int = RADIUS, seed: int = SEED, tree_size: int = TREE_SIZE) -> DataFrame:
    """One row per input row: doc_id, its row keys, fp, component_id (smallest id reachable), kept.

    ``kept`` marks one document of each component (a row with its smallest id).
    """
    rows = pin(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    # of each fingerprint the row that would stand for it: smallest id, nulls last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"),
                           F.col("__k1").alias("k1"), F.col("__k2").alias("k2")))
    nodes = pin(rows.groupBy("fp").agg(first.alias("first")), "nodes")
    roots = connected_components(link_fingerprints(nodes.select("fp"), radius, tree_size))
    placed = (nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    known = placed.join(least, "root").select("fp", "least")
    out = rows.join(known, "fp")
    return out.select("doc_id", "__k1", "__k2", "fp", F.col("least.id").alias("component_id"),
                      ((F.col("__k1") == F.col("least.k1")) & (F.col("__k2") == F.col("least.k2"))).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; of rows that repeat id and text one stays."""
    return keep_rows(docs, simhash_dedup(docs, id_col, text_col, **params).filter("kept"), id_col, text_col)
