"""Sums of products over all rows, as one matrix per task added up by Spark.

A wide table has thousands of column pairs; as SQL sums they would be as many
expressions in one aggregate. Here a task turns its rows into matrices batch by
batch and emits one row of sums, and Spark adds the rows up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import q

BLOCK_ROWS = 4096


def matrix_sums(df: DataFrame, cols, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Σ over batches of ``fn(rows × cols)``, a fixed-length vector; rows with a null are left out."""
    cols = list(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float)
            v = fn(x)
            total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    src = _complete(df, cols)
    rows = src.mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # the sums themselves
    out = np.zeros(len(fn(np.zeros((0, len(cols))))))
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def _complete(df: DataFrame, cols) -> DataFrame:
    return df.select(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).dropna()


def row_blocks(df: DataFrame, cols) -> DataFrame:
    """The complete rows of ``cols`` as doubles, a block of rows (the bytes of its matrix) a row.

    For fits that pass over the same rows many times: a pass reads arrays instead of
    turning every value of every row into a column batch again."""
    cols = list(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float)
            for lo in range(0, len(x), BLOCK_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([x[lo:lo + BLOCK_ROWS].tobytes()], pa.binary())], names=["x"])

    return _complete(df, cols).mapInArrow(run, "x binary")


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for b in batches:
        for block in b.column(0):
            yield np.frombuffer(block.as_buffer(), dtype=float).reshape(-1, width)


def block_sums(blocks: DataFrame, width: int, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``matrix_sums`` over ``row_blocks`` of ``width`` columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _matrices(batches, width):
            v = fn(x)
            total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    rows = blocks.mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # the sums themselves
    out = np.zeros(len(fn(np.zeros((0, width)))))
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def block_ranges(blocks: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of every column of ``row_blocks`` (NaN without rows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full(width, np.inf), np.full(width, -np.inf)
        for x in _matrices(batches, width):
            lo, hi = np.minimum(lo, x.min(axis=0)), np.maximum(hi, x.max(axis=0))
        if (lo <= hi).all():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(lo), pa.array(hi)], names=["i", "lo", "hi"])

    out = np.full((2, width), np.nan)
    for r in blocks.mapInArrow(run, "i bigint, lo double, hi double").groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        out[:, r["i"]] = r["lo"], r["hi"]
    return out[0], out[1]


def gram(df: DataFrame, cols, centered: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, or the centred sums of products, of ``cols``; column sums; number of complete rows.

    Centring is a pass of its own (means first), as subtracting ``n·mean²`` from
    X'X cancels for large n.
    """
    d = len(list(cols))
    first = matrix_sums(df, cols, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]))
    n, s = int(first[0]), first[1:]
    shift = s / max(n, 1) if centered else np.zeros(d)
    g = matrix_sums(df, cols, lambda x: ((x - shift).T @ (x - shift)).ravel()).reshape(d, d)
    return g, s, n
