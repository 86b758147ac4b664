"""Exact top-k search (8): MaxScore over the dimensions of integer vectors.

A query term is a dimension with the sign of the query's component. Its impact
in a vector is shifted to be non-negative (distance from the shard's least
component for a positive query component, from the greatest for a negative
one), so a term's bound in a shard is |q| times the spread there. Terms are
ordered by bound; as many of the smallest as together stay under the query's
k-th best score so far are non-essential. The essential terms' postings are
traversed, vector block by vector block; the others are probed in falling order
of bound only for vectors that can still reach the k-th score, ties included.
With no score to beat yet, all terms are essential.

Vectors are dealt into shards and queries into blocks of bounded size; a task
holds one shard and one block, and the shards' best lists are merged by query.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows without vec_id; shorter vectors count zeros at the
end; repeated rows count each on its own, and only the query's own row is left
out; components of 2**62 and more after scaling are cut to that, and scores to the
range of a long; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import pin

SHARD_ROWS = 8192
QUERY_ROWS = 2048
BLOCK = 2048
PROBE = 8
LONG = (1 << 63) - 1
RESULT = "query_uid bigint, query_id bigint, vec_uid bigint, vec_id bigint, score bigint"


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * component) of every usable vector."""
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = float(1 << 62)
    cell = lambda x: F.floor(F.greatest(F.least(F.lit(scale) * x.cast("double"), F.lit(top)), F.lit(-top)))
    return (vectors.filter(v.isNotNull() & ~bad & F.col(f"`{id_col}`").isNotNull())
            .select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.transform(v, cell).alias("v")))


def _matrix(t: pa.Table, dims: int) -> np.ndarray:
    flat = t.column("v").combine_chunks().flatten().to_numpy()
    return flat.reshape(-1, dims) if dims else np.zeros((t.num_rows, 0), dtype=np.int64)


class Shard:
    """The postings of one shard: a column of shifted impacts for each (dimension, sign)."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, uids: np.ndarray, number: type) -> None:
        by = np.lexsort((uids, ids))
        v, self.ids, self.uids = v[by].astype(number), ids[by], uids[by]
        self.least, self.most = v.min(axis=0), v.max(axis=0)
        self.above = np.asfortranarray(v - self.least)  # impacts for positive query components
        self.below = np.asfortranarray(self.most - v)

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and positions of the k best rows but ``own``, ties to smaller id."""
        weight = abs(q)
        base = (q * np.where(q >= 0, self.least, self.most)).sum()
        bound = weight * (self.most - self.least)
        order = np.argsort(-bound, kind="stable")  # falling
        order = order[bound[order] > 0]
        plus, minus = order[q[order] > 0], order[q[order] < 0]
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what the terms from here on can add
        best, at = np.empty(0, dtype=weight.dtype), np.empty(0, dtype=np.int64)
        floor = None  # the k-th score so far
        for lo in range(0, len(self.ids), BLOCK):
            hi = min(lo + BLOCK, len(self.ids))
            # essential: the shortest head of the order whose tail alone cannot reach the floor
            head = len(order) if floor is None else int(np.argmax(rest < floor - base)) if rest[-1] < floor - base else len(order)
            if floor is not None and head == 0 and base < floor:
                break
            a, b = (plus, minus) if head == len(order) else ([t for t in order[:head] if q[t] > 0], [t for t in order[:head] if q[t] < 0])
            part = np.full(hi - lo, base, dtype=weight.dtype)
            for impacts, terms in ((self.above, a), (self.below, b)):
                if len(terms):
                    part = part + impacts[lo:hi, terms].dot(weight[terms])
            live = np.arange(lo, hi)
            if floor is not None:
                ok = part + rest[head] >= floor
                live, part = live[ok], part[ok]
            for s in range(head, len(order), PROBE):
                if not len(live):
                    break
                for t in order[s:s + PROBE]:
                    part = part + weight[t] * (self.above if q[t] > 0 else self.below)[live, t]
                ok = part + rest[min(s + PROBE, len(order))] >= floor
                live, part = live[ok], part[ok]
            mine = self.uids[live] != own
            best, at = np.concatenate([best, part[mine]]), np.concatenate([at, live[mine]])
            if len(best) > k:
                near = best >= np.sort(best)[-k] if best.dtype == object else best >= np.partition(best, len(best) - k)[len(best) - k]
                best, at = best[near], at[near]
                top = np.argsort(-best, kind="stable")[:k]  # positions are in id order
                best, at = best[top], at[top]
            if len(best) == k:
                floor = best.min()
        return best, at


def _search(dims: int, k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {c: [] for c in ("query_uid", "query_id", "vec_uid", "vec_id", "score")}
        if vectors.num_rows and queries.num_rows:
            v, q = _matrix(vectors, dims), _matrix(queries, dims)
            # whole numbers stay exact in doubles below 2**53, in longs below 2**63; beyond that Python's own
            reach = 4.0 * max(1, dims) * float(np.abs(v.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0))
            number = np.float64 if reach < 2.0 ** 53 else np.int64 if reach < 2.0 ** 63 else object
            shard = Shard(v, vectors.column("vec_id").to_numpy(), vectors.column("uid").to_numpy(), number)
            for row, uid, qid in zip(q.astype(number), queries.column("uid").to_numpy(), queries.column("vec_id").to_numpy(), strict=True):
                best, at = shard.search(row, uid, k)
                out["query_uid"].append(np.full(len(at), uid))
                out["query_id"].append(np.full(len(at), qid))
                out["vec_uid"].append(shard.uids[at])
                out["vec_id"].append(shard.ids[at])
                out["score"].append(np.clip(best, -LONG, LONG).astype(np.int64) if number is object else best.astype(np.int64))
        return pa.table({c: pa.array(np.concatenate(x) if x else np.empty(0, dtype=np.int64), pa.int64()) for c, x in out.items()})
    return run


def top_k(vectors: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 64, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest integer inner product with each query row.

    ``is_query`` is a SQL condition on vec_id.
    """
    rows = pin(quantise(vectors, id_col, vector_col, scale).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"),
                     F.count_if(F.expr(is_query)).alias("queries")).first()
    dims = total["dims"] or 0
    shards, blocks = max(1, -(-total["n"] // shard_rows)), max(1, -(-total["queries"] // query_rows))
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(dims) - F.size("v"))))
    part = F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(blocks)).cast("int")
    of_shards = rows.select("uid", "vec_id", "v", part.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    of_blocks = rows.filter(is_query).select("uid", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                                             block.alias("block"))
    found = of_shards.groupBy("shard", "block").cogroup(of_blocks.groupBy("shard", "block")).applyInArrow(_search(dims, k), RESULT)
    turn = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "vec_uid")
    return found.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
