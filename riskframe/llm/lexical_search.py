"""Ranked lexical search (13): inverted lists with per-term geometric blocking, exact.

Documents are dealt into shards of bounded size, queries into blocks of bounded
size; a task holds one shard and one block, and the shards' best lists are
merged by query. In a shard a term's posting list is clustered by the
similarity of its documents (inner products of sign sketches of their vectors
with those of pivots of the list). A cluster is a block; its summary is the
coordinatewise maximum of its documents' vectors, so the query's product with
the summary is never below the score of a document in it. Lists are built when
a query first walks them.

A query walks its lists in falling order of what they can add. A list is
walked block by block in falling order of summary bound, and a block whose
bound is under the query's k-th score is skipped; the rest of its documents are
scored in full. Documents of no walked list hold only the remaining terms, so
the walk ends when those together stay under the k-th score. Bounds are whole
numbers like the scores, ties are walked, so the result is exact; sketches and
pivots change only how much is skipped.

Statistics (documents, terms, document frequencies) cover all documents. The
index keeps the terms that some query may hold: a bit table of fixed size over
the queries' terms drops most others at the scan.

Defined results: a null text has no term; rows are documents and queries of
their own, repeated or not; a null doc_id counts in the statistics and, at
equal scores, comes after all others; a query without a known term has no row;
empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import pin

SHARD_ROWS = 8192
SHARD_CELLS = 1 << 20
QUERY_ROWS = 1024
QUERY_TERMS = 1 << 17
BLOCK = 64
SKETCH = 16
DENSE_CELLS = 1 << 22  # of a table of maxima by block and term; sorted cells beyond
BITS = 1 << 20
NO_ID = (1 << 63) - 1
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RESULT = "qid bigint, item_id bigint, uid bigint, doc_id bigint, score bigint"


def term_counts(text: bytes | None) -> tuple[int, Counter]:
    """Terms are runs of digits, letters and anything beyond ASCII; only A-Z is lower-cased."""
    words = (text or b"").translate(TERM_BYTES).split()
    return len(words), Counter(words)


def _count(bits: bytes | None):
    """(id, text) rows to (id, n, terms, tfs); with ``bits``, terms whose bit is not set are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ns, offsets, terms, tfs = [], [0], [], []
                for t in part.column(1).cast(pa.binary()).to_pylist():
                    n, counts = term_counts(t)
                    if bits is not None:
                        counts = {w: c for w, c in counts.items() if bits[(h := zlib.crc32(w) & (BITS - 1)) >> 3] >> (h & 7) & 1}
                    ns.append(n)
                    terms.extend(counts)
                    tfs.extend(counts.values())
                    offsets.append(len(terms))
                at = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.binary())),
                     pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))], names=["id", "n", "terms", "tfs"])
    return run


def counted(rows: DataFrame, id_col: str, text_col: str, bits: bytes | None = None) -> DataFrame:
    """(id, n, terms, tfs, uid) of every row, written."""
    out = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        _count(bits), "id bigint, n bigint, terms array<binary>, tfs array<bigint>")
    return pin(out.withColumn("uid", F.monotonically_increasing_id()), "term-counts")


def term_bits(queries: DataFrame) -> bytes:
    """A bit for every hash of a query term: BITS bits at any number of queries."""
    terms = queries.select(F.explode("terms").alias("t")).select(F.crc32("t").bitwiseAND(F.lit(BITS - 1)).alias("h"))
    table = np.zeros(BITS // 8, dtype=np.uint8)
    per = terms.groupBy(F.expr("h div 8").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(h % 8 as int))")).alias("set"))
    for r in per.collect():  # one row a byte at most
        table[r["byte"]] = r["set"]
    return table.tobytes()


class Blocks(NamedTuple):
    """A clustered posting list; ``first`` and ``heads`` start the blocks and their summaries."""

    docs: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    most: np.ndarray
    heads: np.ndarray


class Shard:
    """Vectors of one shard by document and by term, and the blocked lists walked so far.

    ``heads`` starts each document's run of (terms, impacts); ``weights`` are the terms' weights.
    """

    def __init__(self, heads: np.ndarray, terms: np.ndarray, impacts: np.ndarray, weights: np.ndarray, block: int) -> None:
        self.heads, self.terms, self.impacts, self.block = heads, terms, impacts, block
        self.docs = len(heads) - 1
        doc_of = np.repeat(np.arange(self.docs), np.diff(heads))
        by_term = np.argsort(terms, kind="stable")
        self.posting_docs = doc_of[by_term]
        self.posting_heads = np.searchsorted(terms[by_term], np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), dtype=np.int64)
        np.maximum.at(self.most, terms, impacts)
        self.sketches = self._sketch(weights)
        self.lists: dict[int, Blocks] = {}

    def _sketch(self, weights: np.ndarray) -> np.ndarray:
        """Each document's vector in SKETCH random sign sums, at length one."""
        signs = np.random.default_rng(1).choice(np.float32([-1, 1]), size=(SKETCH, len(weights)))
        cells = (self.impacts * weights[self.terms]).astype(np.float32)
        out = np.stack([np.add.reduceat(cells * s[self.terms], self.heads[:-1]) for s in signs], axis=1)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def _cells(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the cells of ``docs``, and where each document's begin."""
        size = self.heads[docs + 1] - self.heads[docs]
        start = np.cumsum(size) - size
        return np.arange(size.sum()) + np.repeat(self.heads[docs] - start, size), start

    def blocks(self, term: int) -> Blocks:
        """The posting list of ``term``, clustered, with the coordinatewise maximum of each cluster."""
        known = self.lists.get(term)
        if known is None:
            docs = self.posting_docs[self.posting_heads[term]:self.posting_heads[term + 1]]
            n = -(-len(docs) // self.block)
            cluster = np.zeros(len(docs), dtype=np.int64)
            if n > 1:
                pivots = docs[np.linspace(0, len(docs) - 1, n).astype(np.int64)]
                cluster = (self.sketches[docs] @ self.sketches[pivots].T).argmax(axis=1)
            by = np.argsort(cluster, kind="stable")
            docs, cluster = docs[by], cluster[by]
            first = np.flatnonzero(np.diff(cluster, prepend=-1))
            at, start = self._cells(docs)
            block_of = np.repeat(np.arange(len(first)), np.diff(first, append=len(docs)))
            key = np.repeat(block_of, np.diff(start, append=len(at))) * len(self.most) + self.terms[at]
            if len(first) * len(self.most) <= DENSE_CELLS:
                table = np.full(len(first) * len(self.most), -1, dtype=np.int64)
                np.maximum.at(table, key, self.impacts[at])
                cells = np.flatnonzero(table >= 0)
                most = table[cells]
            else:
                order = np.argsort(key, kind="stable")
                new = np.flatnonzero(np.diff(key[order], prepend=-1))
                cells, most = key[order][new], np.maximum.reduceat(self.impacts[at][order], new)
            known = self.lists[term] = Blocks(docs, np.append(first, len(docs)), cells % len(self.most), most,
                                              np.searchsorted(cells, np.arange(len(first)) * len(self.most)))
        return known

    def scores(self, docs: np.ndarray, q: np.ndarray) -> np.ndarray:
        at, start = self._cells(docs)
        return np.add.reduceat(self.impacts[at] * q[self.terms[at]], start)

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and numbers of the k best documents above 0 (ties to the smaller number), and how many blocks were skipped."""
        terms = np.flatnonzero(q)
        bound = q[terms] * self.most[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rest = np.cumsum(bound[order][::-1])[::-1]  # what the lists from here on can add
        seen = np.zeros(self.docs, dtype=bool)
        best, at, floor, skipped = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 1, 0
        for term, most in zip(terms[order], rest, strict=True):
            if most < floor:
                break
            docs, first, s_terms, s_most, s_first = self.blocks(int(term))
            bounds = np.add.reduceat(s_most * q[s_terms], s_first)
            walk = np.argsort(-bounds, kind="stable")
            for lo in range(0, len(walk), 8):
                live = walk[lo:lo + 8]
                live = live[bounds[live] >= floor]
                skipped += min(8, len(walk) - lo) - len(live)
                if not len(live):
                    continue
                new = np.concatenate([docs[first[b]:first[b + 1]] for b in live])
                new = new[~seen[new]]
                if not len(new):
                    continue
                seen[new] = True
                score = self.scores(new, q)
                near = score >= floor
                best, at = np.concatenate([best, score[near]]), np.concatenate([at, new[near]])
                if len(best) >= k:
                    top = np.lexsort((at, -best))[:k]
                    best, at = best[top], at[top]
                    floor = max(1, int(best[-1]))
        top = np.lexsort((at, -best))
        return best[top], at[top], skipped


def _local(terms: pa.ListArray, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a list column's terms in ``known`` (-1 if none) and the starts of the lists."""
    flat = terms.flatten().dictionary_encode()
    numbers = np.array([known.get(t, -1) for t in flat.dictionary.to_pylist()] or [-1], dtype=np.int64)
    heads = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return numbers[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, dtype=np.int64), heads


def _search(k: int, block: int):
    def run(docs: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("qid", "item_id", "uid", "doc_id", "score")}
        if docs.num_rows and queries.num_rows:
            docs = docs.set_column(docs.schema.get_field_index("id"), "id", docs.column("id").fill_null(NO_ID))
            docs = docs.sort_by([("id", "ascending"), ("uid", "ascending")])
            known: dict[bytes, int] = {}
            q_terms = queries.column("terms").combine_chunks()
            for t in q_terms.flatten().to_pylist():
                known.setdefault(t, len(known))
            q_numbers, q_heads = _local(q_terms, known)
            q_repeats = queries.column("tfs").combine_chunks().flatten().to_numpy()
            q_weights = queries.column("weights").combine_chunks().flatten().to_numpy()
            weights = np.zeros(len(known), dtype=np.int64)
            weights[q_numbers] = q_weights
            numbers, heads = _local(docs.column("terms").combine_chunks(), known)
            tf = docs.column("tfs").combine_chunks().flatten().to_numpy()
            m = np.repeat(docs.column("m").to_numpy(), np.diff(heads))
            impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
            keep = numbers >= 0
            doc = np.repeat(np.arange(docs.num_rows), np.diff(heads))[keep]
            held = np.unique(doc)  # documents with a query term
            if len(held):
                shard = Shard(np.append(np.searchsorted(doc, held), len(doc)), numbers[keep], impacts[keep], weights, block)
                uids, ids = docs.column("uid").to_numpy()[held], docs.column("id").to_numpy()[held]
                items = queries.column("item_id").to_pylist()
                for i, qid in enumerate(queries.column("qid").to_pylist()):
                    q = np.zeros(len(known), dtype=np.int64)
                    mine = slice(q_heads[i], q_heads[i + 1])
                    q[q_numbers[mine]] = q_repeats[mine] * q_weights[mine]
                    score, at, _ = shard.search(q, k)
                    out["qid"] += [qid] * len(at)
                    out["item_id"] += [items[i]] * len(at)
                    out["uid"] += uids[at].tolist()
                    out["doc_id"] += [None if x == NO_ID else x for x in ids[at].tolist()]
                    out["score"] += score.tolist()
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})
    return run


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", shard_rows: int = SHARD_ROWS, shard_cells: int = SHARD_CELLS, query_rows: int = QUERY_ROWS,
           query_terms: int = QUERY_TERMS, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each row of ``queries``."""
    asked = counted(queries, item_col, item_text_col)
    index = counted(docs, id_col, text_col, term_bits(asked))
    total = index.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms"), F.count_if(F.size("terms") > 0).alias("rows"),
                      F.sum(F.size("terms")).alias("cells")).first()
    n_docs, n_terms = total["docs"], max(total["terms"] or 0, 1)

    found_in = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))).cast("bigint")
    words = asked.select("uid", "id", F.inline(F.arrays_zip("terms", "tfs"))).withColumnsRenamed({"terms": "term", "tfs": "tf"})
    weighted = (words.join(found_in, "term").groupBy("uid", "id").agg(F.collect_list(F.struct("term", "tf", weight.alias("w"))).alias("t"))
                .select(F.col("uid").alias("qid"), F.col("id").alias("item_id"), F.col("t.term").alias("terms"), F.col("t.tf").alias("tfs"),
                        F.col("t.w").alias("weights")))
    weighted = pin(weighted, "weighted-queries")
    size = weighted.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("terms")).alias("terms")).first()
    shards = max(1, -(-total["rows"] // shard_rows), -(-(total["cells"] or 0) // shard_cells))
    blocks = max(1, -(-size["rows"] // query_rows), -(-(size["terms"] or 0) // query_terms))
    m = F.lit(25).cast("bigint") + F.expr(f"({75 * n_docs}L * n) div {n_terms}L")
    of_shards = index.filter(F.size("terms") > 0).select(
        "id", "uid", "terms", "tfs", m.alias("m"), F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    of_blocks = weighted.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                                F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"))
    found = of_shards.groupBy("shard", "block").cogroup(of_blocks.groupBy("shard", "block")).applyInArrow(_search(k, block), RESULT)
    turn = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "uid")
    return found.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
