"""Exact dedup (6): tree-merge of sorted digest runs.

Every row becomes a 256-bit digest of its normalised text; texts never move.
The rows are dealt over ``leaves`` leaf nodes. A leaf's run is its digests in
sorted order, one entry per distinct digest with the best identifier and the
number of copies. In each binomial round the nodes whose numbers agree above
the lowest ``fan_bits`` bits exchange their runs: Spark sorts the entries of
the merged node (a multiway merge of sorted spills), one streaming pass walks
them, checks the whole digest of neighbours and keeps the best identifier.
After ``log(leaves) / fan_bits`` rounds one node is left, cut into digest
ranges (shards), so that no task ever holds more than a shard of it.

A group of copies, however large, is one entry per leaf after the first pass.
On the way back the winners meet the leaf runs on the digest (at most
``leaves`` entries of a hot digest), and the rows on (leaf, digest), so a hot
group is split over all leaves.

Defined results: null text counts as the empty text; a null id never wins over
a known one; of rows that repeat the winning id and text one stays, the others
report ``kept = false``; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import keep_rows, pin, power_of_two_at_least, row_keys

HASHES = ["h0", "h1", "h2", "h3"]
ROWS_PER_LEAF = 50_000
MIN_LEAVES = 64


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = hashlib.sha256
    for b in batches:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        raw = b"".join(sha((t or b"").lower()).digest() for t in texts)  # bytes.lower() changes A-Z only
        cells = np.frombuffer(raw, dtype=">i8").reshape(-1, 4).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [*[b.column(i) for i in (0, 2, 3)], *[pa.array(np.ascontiguousarray(cells[:, i])) for i in range(4)]],
            names=["doc_id", "__k1", "__k2", *HASHES])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row keys, h0..h3): SHA-256 of every text with A-Z lower-cased, as four signed words."""
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       *row_keys(id_col, text_col)).mapInArrow(
        _digest, "doc_id bigint, __k1 bigint, __k2 bigint, " + ", ".join(f"{h} bigint" for h in HASHES))


def _merge_sorted():
    """Walk entries sorted by (node, digest, id): one entry per node and verified digest."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = (pa.concat_tables([carry, t]) if carry is not None else t).combine_chunks()
            keys = [t.column(c).to_numpy() for c in ("node", *HASHES)]
            new = np.ones(t.num_rows, dtype=bool)
            # neighbours are copies only if node and all 256 bits agree
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            first = np.flatnonzero(new)
            last = np.append(first[1:], t.num_rows) - 1
            n = np.add.reduceat(t.column("n").to_numpy(), first)
            # nulls sort first, so the last entry has the largest known id; for the
            # smallest the order of ids is reversed by the caller
            at = t.schema.get_field_index("n")
            best = t.take(pa.array(last)).set_column(at, t.schema.field(at), pa.array(n))
            if len(first) > 1:
                yield from best.slice(0, len(first) - 1).combine_chunks().to_batches()
            carry = best.slice(len(first) - 1)
        if carry is not None:
            yield from carry.combine_chunks().to_batches()
    return walk


def _merge(runs: DataFrame, shards: int, largest: bool) -> DataFrame:
    shard = F.pmod(F.shiftrightunsigned("h0", 40), F.lit(shards))
    best_last = ([F.asc_nulls_first("keep_id"), F.asc("keep_uid")] if largest
                 else [F.desc_nulls_first("keep_id"), F.desc("keep_uid")])
    cols = ["node", *HASHES, "keep_id", "keep_uid", "n"]
    return (runs.select(*cols).repartition("node", shard)
            .sortWithinPartitions("node", *HASHES, *best_last)
            .mapInArrow(_merge_sorted(), "node bigint, " + ", ".join(f"{h} bigint" for h in HASHES)
                        + ", keep_id bigint, keep_uid bigint, n bigint"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
                leaves: int | None = None, fan_bits: int = 3) -> DataFrame:
    """One row per input row: doc_id, its row keys, h0..h3, keep_id, group_size, kept."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    rows = pin(digests(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "digests")
    if leaves is None:
        leaves = max(MIN_LEAVES, rows.count() // ROWS_PER_LEAF)
    leaves = power_of_two_at_least(leaves)
    shards = leaves
    rows = rows.withColumn("leaf", F.pmod(F.xxhash64("uid"), F.lit(leaves)))

    largest = keep == "largest"
    entry = rows.select(F.col("leaf").alias("node"), *HASHES, F.col("doc_id").alias("keep_id"),
                        F.col("uid").alias("keep_uid"), F.lit(1).cast("bigint").alias("n"))
    leaf_runs = pin(_merge(entry, shards, largest), "leaf-runs")
    runs, bits = leaf_runs, leaves.bit_length() - 1
    while bits > 0:
        step = min(fan_bits, bits)
        runs = _merge(runs.withColumn("node", F.shiftright("node", step)), shards, largest)
        bits -= step
    winners = runs.select(*HASHES, "keep_id", "keep_uid", F.col("n").alias("group_size"))

    down = leaf_runs.select("node", *HASHES).join(winners, HASHES).withColumnRenamed("node", "leaf")
    out = rows.join(down, ["leaf", *HASHES], "left")
    return out.select("doc_id", "__k1", "__k2", *HASHES, "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"))


def sha256_hex() -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in HASHES]))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; of rows that repeat id and text one stays."""
    return keep_rows(docs, exact_dedup(docs, id_col, text_col, keep).filter("kept"), id_col, text_col)
