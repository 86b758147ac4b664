"""Rounds of a forest against shuffled shadow copies, in common passes.

The rows are binned once, numbered once and written as blocks. A round is a
keyed permutation of the row numbers, worked out where the rows lie: no round
ranks or joins rows. Its shadows are moved in two exchanges of bytes: rows go to
their places in the round's order, and from there a feature's values go on, as
runs, to the blocks that its shift leads to. All trees of several rounds then
grow together, level by level: a task sums the weights of its rows as one array
a tree, and the task that adds a tree's arrays up picks its cuts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import q
from riskframe.functions.rand import b60
from riskframe.operators import bagged
from riskframe.operators.boosting import binned_columns, collected_cuts
from riskframe.operators.flat_trees import complete_rows
from riskframe.session import delete_path, shuffle_partitions, written_table

BLOCK = 1 << 15  # rows of a block
ORDERED = 1 << 18  # rows of a round's order that one task holds
TOGETHER = 12  # rounds of one written table, at most
BASE = "part int, label binary, bins binary"
PIECE = "part int, round int, feature int, first bigint, data binary"
PIECES = [x.split()[0] for x in PIECE.split(", ")]
BAGS = np.searchsorted(bagged.POISSON, np.arange(1 << 16) / 65536.0, side="right").astype(np.uint8)


class Rows(NamedTuple):
    """The binned rows of a table: block ``i`` (column ``part`` = parts[i]) holds the rows numbered from starts[i]."""

    table: DataFrame
    path: str
    cuts: list[np.ndarray]
    parts: np.ndarray
    starts: np.ndarray  # one more than there are blocks: the last is the number of rows


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt * 0x9E3779B97F4A7C15 % 2 ** 64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def permuted(number: np.ndarray, n: int, r: int) -> np.ndarray:
    """Places of the rows ``number`` in the order of round ``r``: a permutation of 0 .. n - 1.

    Six Feistel steps permute the next power of four; a place beyond the rows is permuted again.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo = number.astype(np.uint64), np.arange(len(number))
    while len(todo):
        high, low = out[todo] >> shift, out[todo] & mask
        for i in range(6):
            high, low = low, high ^ (_mixed(low, 8 * r + i + 1) & mask)
        out[todo] = (high << shift) | low
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def bags(number: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is in the bag of a tree: Poisson draws of sixteen bits."""
    return BAGS[(_mixed(number.astype(np.uint64), 1_000_003 + tree) & np.uint64(0xFFFF)).astype(np.int64)]


def _runs(numbers: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of every run of equal numbers."""
    first = bagged._heads(numbers)
    return zip(first.tolist(), np.append(first[1:], len(numbers)).tolist(), strict=True)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()], PIECES)


def binned_rows(df: DataFrame, key: str, features, max_bins: int = 32, label: str = "label") -> Rows:
    """Bin and number the complete rows of ``df``; the order is that of a draw of the key, however the rows lie."""
    feats, spark = list(features), df.sparkSession
    own = df.select(b60("bor", q(key)).alias("_h"), q(label).cast("double").alias("_y"),
                    *[q(f).cast("double").alias(f"_x{i}") for i, f in enumerate(feats)]).persist()  # counted, cut and binned
    count, d = own.count(), len(feats)
    cuts = collected_cuts(own, [f"_x{i}" for i in range(d)], max_bins)
    parts = max(shuffle_partitions(spark), math.ceil(count / BLOCK))
    drawn = own.withColumn("part", F.shiftright(F.shiftright("_h", 36) * F.lit(parts), 24).cast("int"))
    values = ["_h", "_y", *[f"_x{i}" for i in range(d)]]
    laid = drawn.select("part", *values).repartition(min(parts, 4 * shuffle_partitions(spark)), "part").sortWithinPartitions("part", *values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        at = None

        def block() -> pa.RecordBatch:
            y, x = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            return _batch([(at, (y > 0).astype(np.uint8).tobytes(), binned_columns(cuts, x).tobytes())], [pa.int32(), pa.binary(), pa.binary()], ["part", "label", "bins"])

        for batch in batches:
            part, y = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            x, ok = complete_rows(batch, 3, d)
            for a, z in _runs(part):
                if part[a] != at and held:
                    yield block()
                    held.clear()
                at = int(part[a])
                mine = ok[a:z]
                held.append((y[a:z][mine], x[a:z][mine]))
        if held:
            yield block()

    table, path = written_table(laid.mapInArrow(run, BASE), "shadow-base")
    sizes = sorted((r["part"], r["n"]) for r in table.select("part", F.octet_length("label").alias("n")).collect())  # one row a block
    own.unpersist()
    return Rows(table, path, cuts, np.array([p for p, _ in sizes], dtype=np.int64), np.cumsum([0, *[n for _, n in sizes]]))


def _in_order(rows: Rows, live: list[int], rounds: list[int], width: int) -> DataFrame:
    """PIECE: every row's bytes on the way to its place in each round's order; ``part`` numbers the stretch of the order."""
    n, d = int(rows.starts[-1]), len(rows.cuts)
    start = dict(zip(rows.parts.tolist(), rows.starts.tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                cols = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=np.uint8).reshape(d, -1)[live]
                number = start[part] + np.arange(cols.shape[1])
                for j, r in enumerate(rounds):
                    to = permuted(number, n, r)
                    order = np.argsort(to, kind="stable")
                    to, mine = to[order], cols[:, order]
                    yield _pieces([(int(to[a] // width), j, -1, 0, (to[a:z] % width).astype(np.int32).tobytes() + mine[:, a:z].tobytes())
                                   for a, z in _runs(to // width)])
    return rows.table.mapInArrow(run, PIECE)


def _onward(rows: Rows, count: int, shifts: list[list[int]], width: int):
    """Stretches of the rounds' orders to PIECE: runs of each feature's values for the blocks that its shift leads to."""
    n, starts, parts = int(rows.starts[-1]), rows.starts, rows.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.empty((count, 0), dtype=np.uint8)

        def sent() -> pa.RecordBatch:
            stretch, j = at
            out = []
            for i, shift in enumerate(shifts[j]):
                done, size = 0, held.shape[1]
                while done < size:
                    to = (stretch * width + shift + done) % n
                    block = int(np.searchsorted(starts, to, side="right")) - 1
                    step = min(size - done, int(starts[block + 1]) - to)
                    out.append((int(parts[block]), j, i, to - int(starts[block]), held[i, done:done + step].tobytes()))
                    done += step
            return _pieces(out)

        for batch in batches:
            for i, here in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if here != at:
                    if at is not None:
                        yield sent()
                    at, held = here, np.empty((count, min(width, n - here[0] * width)), dtype=np.uint8)
                raw = batch.column(4)[i].as_buffer()
                m = len(raw) // (4 + count)
                held[:, np.frombuffer(raw, dtype=np.int32, count=m)] = np.frombuffer(raw, dtype=np.uint8, offset=4 * m).reshape(count, m)
        if at is not None:
            yield sent()
    return run


def shadow_table(rows: Rows, live: list[int], rounds: list[int], shifts: list[list[int]]) -> tuple[DataFrame, str]:
    """(part, label, bins, shadows) of every block, written: features ``live`` and their shadows in each of ``rounds``.

    A shadow of row t is the value of the row whose place in the round's order is t less the feature's shift.
    """
    spark, n, d, count = rows.table.sparkSession, int(rows.starts[-1]), len(rows.cuts), len(live)
    tasks = max(shuffle_partitions(spark), min(len(rows.parts), 4 * shuffle_partitions(spark)))
    width = min(ORDERED, max(1, -(-n // shuffle_partitions(spark))))
    ordered = _in_order(rows, live, rounds, width).repartition(tasks, "part", "round").sortWithinPartitions("part", "round")
    base = rows.table.select("part", F.lit(-1).alias("round"), F.lit(-1).alias("feature"), F.lit(0).cast("bigint").alias("first"),
                             F.concat("label", "bins").alias("data"))
    both = ordered.mapInArrow(_onward(rows, count, shifts, width), PIECE).unionByName(base).repartition(tasks, "part").sortWithinPartitions("part", "round")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, label, bins, shadows = None, b"", b"", np.empty((0, 0, 0), dtype=np.uint8)
        kinds, names = [pa.int32(), pa.binary(), pa.binary(), pa.binary()], ["part", "label", "bins", "shadows"]
        for batch in batches:
            part, j, feature, first = (batch.column(i).to_pylist() for i in range(4))
            for i, p in enumerate(part):
                raw = np.frombuffer(batch.column(4)[i].as_buffer(), dtype=np.uint8)
                if p != at:
                    if at is not None:
                        yield _batch([(at, label, bins, shadows.tobytes())], kinds, names)
                    m = len(raw) // (d + 1)
                    at, label, bins = p, raw[:m].tobytes(), raw[m:].reshape(d, m)[live].tobytes()
                    shadows = np.empty((len(rounds), count, m), dtype=np.uint8)
                else:
                    shadows[j[i], feature[i], first[i]:first[i] + len(raw)] = raw
        if at is not None:
            yield _batch([(at, label, bins, shadows.tobytes())], kinds, names)

    return written_table(both.mapInArrow(run, "part int, label binary, bins binary, shadows binary"), "shadows")


def _look(starts: dict[int, int], count: int, most: int):
    """One pass for ``bagged.grow``: the best cut of every open node (slot, n, pos, feature, bin, nl, pl, gain)."""
    def look(rows: DataFrame, t: bagged.Trees, nodes: np.ndarray, drawn: np.ndarray, d: int, bins: int, g: bagged.Growth) -> pd.DataFrame:
        k = drawn.shape[1]
        slot_of = np.full(len(t.tree), -1)
        slot_of[nodes] = np.arange(len(nodes))
        mine = t.tree[nodes]  # a tree's slots lie together
        spans = {int(mine[a]): (a, z) for a, z in _runs(mine)}
        which = [t.which[i] for i in range(len(t.which))]
        # a row at an end stays there; other rows go to a left child or to its neighbour, the right one
        inner, every = t.feature >= 0, np.arange(len(t.tree))
        feature, child, bound = np.where(inner, t.feature, 0), np.where(inner, t.left, every), np.where(inner, t.bin, 255).astype(np.uint8)
        steps, lane = int(t.depth.max()), drawn.T.copy()

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = {i: np.zeros((z - a) * k * bins) for i, (a, z) in spans.items()}
            for batch in batches:
                for r, part in enumerate(batch.column(0).to_pylist()):
                    label, real, shadows = (np.frombuffer(batch.column(c)[r].as_buffer(), dtype=np.uint8) for c in (1, 2, 3))
                    m = len(label)
                    real, shadows = real.reshape(count, m), shadows.reshape(-1, count, m)
                    number, packed = starts[part] + np.arange(m), 1.0 + label * bagged.PACK
                    cols = held = None
                    for i, (a, _) in spans.items():
                        j, tree = which[i]
                        if held != j:
                            cols, held = np.concatenate([real, shadows[j]]).ravel(), j
                        w = bags(number, tree)
                        use = np.flatnonzero(w)
                        at = np.full(len(use), i)
                        for _ in range(steps):
                            at = child.take(at) + (cols.take(feature.take(at) * m + use) > bound.take(at))
                        at = slot_of.take(at)
                        on = at >= 0
                        if not on.all():
                            use, at = use[on], at[on]
                        weight, first = packed.take(use) * w.take(use), (at - a) * (k * bins)
                        for x in range(k):
                            cells[i] += np.bincount(first + x * bins + cols.take(lane[x].take(at) * m + use), weights=weight, minlength=len(cells[i]))
            yield _batch([(i, c.tobytes()) for i, c in cells.items()], [pa.int32(), pa.binary()], ["tree", "data"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = {}
            for batch in batches:
                for r, i in enumerate(batch.column(0).to_pylist()):
                    both = np.frombuffer(batch.column(1)[r].as_buffer(), dtype=float)
                    pos = np.floor(both / bagged.PACK)
                    both = np.stack([both - pos * bagged.PACK, pos])
                    found[i] = both if i not in found else found[i] + both
            for i, both in found.items():
                yield best_cuts(*both.reshape(2, -1, k, bins), spans[i][0], drawn[spans[i][0]:spans[i][1]], g)

        told = rows.mapInArrow(sums, "tree int, data binary").repartition(min(len(spans), most), "tree").mapInArrow(
            cut, "slot int, n bigint, pos bigint, feature int, bin int, nl bigint, pl bigint, gain double")
        return told.toPandas()  # one row a node
    return look


def best_cuts(n: np.ndarray, pos: np.ndarray, first: int, drawn: np.ndarray, g: bagged.Growth) -> pa.RecordBatch:
    """The best cut of every slot from its weights (slots × features × bins): highest gain, then lowest feature and bin; null without one."""
    nl, pl = n.cumsum(axis=2), pos.cumsum(axis=2)
    n_all, p_all = nl[:, :1, -1:], pl[:, :1, -1:]
    least = max(1, g.min_leaf)
    able = (n > 0) & (nl >= least) & (n_all - nl >= least)
    worth = lambda a, b: bagged._impurity(np.maximum(a, 1), b, g.criterion)
    gain = np.where(able, np.round(worth(n_all, p_all) - worth(nl, pl) - worth(n_all - nl, p_all - pl), 9), -1.0)
    flat = gain.reshape(len(gain), -1)
    top = flat.argmax(axis=1)
    each = np.arange(len(gain))
    value, lane, at = flat[each, top], top // n.shape[2], top % n.shape[2]
    none = pa.array(value <= 1e-9)
    kept = lambda x, kind: pa.array(x, kind, mask=none.to_numpy(zero_copy_only=False))
    whole = lambda x: x.astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array((first + each).astype(np.int32)), pa.array(whole(n_all.ravel())), pa.array(whole(p_all.ravel())),
         kept(drawn[each, lane].astype(np.int32), pa.int32()), kept(at.astype(np.int32), pa.int32()),
         kept(whole(nl[each, lane, at]), pa.int64()), kept(whole(pl[each, lane, at]), pa.int64()), kept(value, pa.float64())],
        names=["slot", "n", "pos", "feature", "bin", "nl", "pl", "gain"])


def counted_splits(t: bagged.Trees) -> np.ndarray:
    """Which nodes are splits that some prediction depends on: as in Spark's forests, a split between ends of one class is an end itself."""
    split, says = t.feature >= 0, 2 * t.pos > t.n
    for level in range(int(t.depth.max()) - 1, -1, -1):
        at = np.flatnonzero(split & (t.depth == level))
        left, right = t.left[at], t.right[at]
        split[at[~split[left] & ~split[right] & (says[left] == says[right])]] = False
    return split


def round_importances(rows: Rows, live: list[int], rounds: list[int], shifts: list[list[int]], trees: int, depth: int) -> list[np.ndarray]:
    """For each of ``rounds`` the importances of the features ``live`` and then of their shadows, in a forest of its own."""
    spark, count = rows.table.sparkSession, len(live)
    d, bins = 2 * count, max(2, *[len(c) for c in rows.cuts])
    g = bagged.Growth(trees, depth, subset=math.ceil(math.sqrt(d)), max_bins=bins)
    starts = dict(zip(rows.parts.tolist(), rows.starts.tolist(), strict=False))
    out = []
    for lo in range(0, len(rounds), TOGETHER):
        some = rounds[lo:lo + TOGETHER]
        table, path = shadow_table(rows, live, some, shifts[lo:lo + TOGETHER])
        # a tree's number is its own in the whole race: it gives the bag and the features of its nodes
        which = [(j, r * trees + i) for j, r in enumerate(some) for i in range(trees)]
        t = bagged.grow(table, d, bins, which, g, look=_look(starts, count, shuffle_partitions(spark)))
        gains = np.zeros((len(which), d))
        split = counted_splits(t)
        np.add.at(gains, (t.tree[split], t.feature[split]), t.gain[split])
        out += [bagged._shares(gains[j * trees:(j + 1) * trees]) for j in range(len(some))]
        delete_path(spark, path)
    return out


def let_go(rows: Rows) -> None:
    delete_path(rows.table.sparkSession, rows.path)
