"""Best-fit packing (9): bulk-synchronous best-fit over runs of equal documents and equal gaps.

1. Every document is tokenised, ended by ``end_id`` and, only if longer than
   ``capacity``, cut into pieces of ``capacity`` with a shorter first piece.
   The pieces (numbers only) are written once.
2. Pieces are range-sorted by length: each gets its rank within its length
   class by a two-level count, (length, bucket) totals first, then a row number
   inside a bucket, so a class that holds most rows is spread over all buckets.
3. Supersteps go through the lengths from the longest down. All documents of
   one length look for their successor, the smallest gap that takes them; the
   open sequences with equal gaps form one run. Several documents want the same
   run: rank ``k`` of the documents takes rank ``k`` of the run, the rest go on
   to the next successor, and what finds none opens new sequences. The gaps
   shrink and the next superstep starts. Each step moves whole runs, so the
   sequences are exactly those of best-fit in decreasing order.
4. Every piece finds the move that covers its (length, rank) by a sorted search
   and reads its sequence and offset from it.

What the supersteps see is one count per length and one entry per run of equal
gaps: at most ``capacity`` counts, whatever the number of documents.

Token ids are those of the named tokenizer file; see ``_encoder`` for how they
are made. Defined results: null text counts as empty (one piece holding only
``end_id``); repeated rows are packed each on its own; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import pin, power_of_two_at_least

CAPACITY = 1024
END_ID = 2
ROWS_PER_BUCKET = 50_000
MIN_BUCKETS = 64
# Fixed value: how the tokenizer file's pre-tokenizer (ByteLevel, use_regex) cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that a byte-level vocabulary file uses for bytes:
    printable Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text -> uint32 ids of the byte-level BPE file at ``path``, without special tokens added.

    The vocabulary and the added tokens are read from the tokenizer file; a
    merge's rank is its id there, so a rank-driven encoder gives the same ids
    several times faster (a test compares the two). An added token written out
    in a text becomes that token, as the file's own tokenizer does.
    """
    if path not in _ENCODERS:
        import re

        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _byte_of_char()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in added}
        enc = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

        def encode(text: str) -> np.ndarray:
            if marks is None or not marks.search(text):
                return enc.encode_to_numpy(text, disallowed_special=())
            parts = [np.array([added[p]], dtype=np.uint32) if p in added
                     else enc.encode_to_numpy(p, disallowed_special=()) for p in marks.split(text) if p]
            return np.concatenate(parts)
        _ENCODERS[path] = encode
    return _ENCODERS[path]


def _pieces(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for b in batches:
            ids_of, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(b.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                at, end = 0, n % capacity or capacity
                k = 0
                while at < n:
                    ids_of.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(ids[at:end].tobytes()))
                    at, end, k = end, end + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids_of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return cut


def plan_moves(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Supersteps over runs: moves (length, first rank, count, first sequence, offset).

    ``gaps`` holds, per gap, the runs [first sequence, count] of open sequences.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # gaps that have a run, ascending: the successor search
    moves, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap <= 0 or n <= 0:
            return
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(order, gap)
        gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect.bisect_left(order, length)
            if i == len(order):
                # no successor: all that is left opens sequences, as many to each as fit
                per = capacity // length
                whole, rest = divmod(left, per)
                for k in range(per):
                    n = whole + (k < rest)
                    if n:
                        # slot k of the new sequences; the last one may stay part empty
                        moves.append((length, rank, n, opened, k * length))
                        rank += n
                put(capacity - per * length, opened, whole)
                if rest:
                    put(capacity - rest * length, opened + whole, 1)
                opened += whole + bool(rest)
                left = 0
                break
            gap = order[i]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(i)
            take = min(n, left)
            moves.append((length, rank, take, first, capacity - gap))
            put(gap - length, first, take)
            put(gap, first + take, n - take)
            rank += take
            left -= take
    return moves


def _place(moves: np.ndarray, length_span: int):
    """Sorted search of every (length, rank) in the moves, batch by batch."""
    keys = moves[:, 0] * length_span + moves[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            length, rank = c["length"].to_numpy(), c["rank"].to_numpy()
            m = moves[np.searchsorted(keys, length * length_span + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*[c[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")],
                 pa.array(m[:, 3] + rank - m[:, 1]), pa.array(m[:, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return place


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                  end_id: int = END_ID, tokenizer: str | None = None, buckets: int | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    pieces = pin(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
                 .mapInArrow(_pieces(path, capacity, end_id),
                             "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
                 .withColumn("uid", F.monotonically_increasing_id()), "pieces")  # rows that repeat one piece spread over the buckets
    counts = {r["length"]: r["n"] for r in  # at most `capacity` rows
              pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if buckets is None:
        buckets = max(MIN_BUCKETS, sum(counts.values()) // ROWS_PER_BUCKET)
    buckets = power_of_two_at_least(buckets)
    span = max([1, *counts.values()]) + 1
    moves = np.array(sorted(plan_moves(counts, capacity)) or np.empty((0, 5)), dtype=np.int64).reshape(-1, 5)

    # rank within a length class: bucket totals, then the place inside the bucket
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    totals = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "uid")
    ranked = (keyed.withColumn("nth", F.row_number().over(inside)).join(offsets, ["length", "bucket"])
              .withColumn("rank", F.col("base") + F.col("nth") - 1))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _place(moves, span), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "sequence_id bigint, offset bigint")
