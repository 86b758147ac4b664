"""Forests with replayable bags, grown on Spark.

A row's weight in tree t is a Poisson draw of its key and t, so bags need no
copies, and the rows outside a tree's bag are known again when votes are
counted. All trees grow level by level in common passes over the binned rows: a
task sums weights and positive weights per (node, drawn feature, bin), Spark
adds them up, running sums over the bins give both sides of every cut, and one
row a node comes back. The trees (not the rows) lie on the driver.

A node's features are drawn by its path and its cut depends on nothing below
it, so a shallower tree, one with a larger least split and one with fewer trees
are parts of the same growth: a grid over depth, least split and number of
trees is one growth and one scoring pass (H3).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.columns import q
from riskframe.operators import evaluate as ev
from riskframe.operators.boosting import _cells, binned_columns, binned_table, collected_cuts, hashed
from riskframe.operators.flat_trees import Forest, complete_rows
from riskframe.session import delete_path, shuffle_partitions, written_table

SLOTS = 16384  # nodes that one pass looks at
LOCAL_SHARE, LOCAL_LEAST, LOCAL_MOST = 64, 1 << 16, 1 << 20  # nodes of at most this share of the rows, within bounds, are finished in a task
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


@dataclass(frozen=True)
class Growth:
    trees: int = 100
    max_depth: int = 0  # 0: until nodes are pure
    min_leaf: int = 1  # least weight of a child
    min_split: int = 2
    criterion: str = "gini"  # or entropy
    subset: int = 0  # features drawn a node; 0: square root of all
    max_bins: int = 64
    seed: int = 42


@dataclass
class Trees:
    """Nodes of all trees, in order of growth; tree i belongs to (model, number) ``which[i]``."""

    which: list[tuple[int, int]]
    tree: np.ndarray
    path: np.ndarray  # what a node's draws come from
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    n: np.ndarray
    pos: np.ndarray
    gain: np.ndarray


def bag_weights(row: np.ndarray, number: int, seed: int) -> np.ndarray:
    """How often each row is in the bag of tree ``number``."""
    return np.searchsorted(POISSON, hashed(row, seed, number), side="right")


def drawn_features(path: np.ndarray, d: int, k: int, seed: int) -> np.ndarray:
    """Nodes × k features, in order, drawn by the nodes' paths."""
    if k >= d:
        return np.tile(np.arange(d), (len(path), 1))
    scores = hashed(path.view(np.int64)[:, None], seed, np.arange(1_000_003, 1_000_003 + d))
    return np.sort(np.argpartition(scores, k, axis=1)[:, :k], axis=1)


def _child_path(path: np.ndarray, side: int) -> np.ndarray:
    return (hashed(path.view(np.int64), 7, side) * 2.0 ** 53).astype(np.uint64)


def _walk(cols: np.ndarray, root: int, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The node that every row ends in."""
    m = cols.shape[1]
    flat, out = np.ascontiguousarray(cols).ravel(), np.full(m, root)
    rows, at = np.arange(m), np.full(m, root)
    while len(rows):  # rows that are still on their way
        f = feature.take(at)
        on = np.flatnonzero(f >= 0)
        if len(on) < len(rows):
            out[rows] = at
            rows, at, f = rows.take(on), at.take(on), f.take(on)
        at = np.where(flat.take(f.astype(np.int64) * m + rows) <= cut.take(at), left.take(at), right.take(at)).astype(np.int64)
    return out


def _sums(rows: DataFrame, t: Trees, nodes: np.ndarray, drawn: np.ndarray, d: int, bins: int, seed: int) -> DataFrame:
    """(slot, feature, bin, pos, n): weights of the open ``nodes`` by their drawn features."""
    slots, k = drawn.shape
    slot_of = np.full(len(t.tree), -1, dtype=np.int32)
    slot_of[nodes] = np.arange(slots)
    open_trees = sorted(set(t.tree[nodes].tolist()))
    part = {i: t.which[i] for i in open_trees}
    shape = (t.feature.astype(np.int16), t.bin.astype(np.uint8), t.left.astype(np.int32), t.right.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, slots * k * bins), dtype=np.int64)
        for row, fold, label, cols, _ in _cells(batches, d):
            bags: dict[int, np.ndarray] = {}
            for i, (m, number) in part.items():
                if number not in bags:
                    bags[number] = bag_weights(row, number, seed)
                use = np.flatnonzero((bags[number] > 0) & (fold != m))
                mine = cols[:, use]
                slot = slot_of[_walk(mine, i, *shape)]
                hit = slot >= 0
                use, slot, mine = use[hit], slot[hit], mine[:, hit]
                w = bags[number][use].astype(float)
                each = np.arange(len(use))
                for j in range(k):
                    key = (slot.astype(np.int64) * k + j) * bins + mine[drawn[slot, j], each]
                    lo = int(key.min(initial=0))  # a tree's slots lie together
                    sums[0, lo:lo + int(key.max(initial=0)) - lo + 1] += np.bincount(key - lo, weights=w * label[use], minlength=1).astype(np.int64)
                    sums[1, lo:lo + int(key.max(initial=0)) - lo + 1] += np.bincount(key - lo, weights=w, minlength=1).astype(np.int64)
        some = np.flatnonzero(sums[1])
        slot, j = some // (k * bins), some // bins % k
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(drawn[slot, j].astype(np.int32)),
                                          pa.array((some % bins).astype(np.int32)), *[pa.array(s[some]) for s in sums]],
                                         names=["slot", "feature", "bin", "pos", "n"])

    cells = rows.mapInArrow(run, "slot int, feature int, bin int, pos bigint, n bigint")
    return cells.repartition("slot").groupBy("slot", "feature", "bin").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def impurity(n: str, pos: str, criterion: str) -> str:
    """SQL of n times the impurity of a node of n with pos positives."""
    if criterion == "gini":
        return f"CASE WHEN {n} > 0 THEN 2D * {pos} * ({n} - {pos}) / {n} ELSE 0D END"
    part = lambda c: f"CASE WHEN {c} > 0 THEN -{c} * ln({c} / {n}) ELSE 0D END"
    return f"{part(pos)} + {part(f'({n} - {pos})')}"


def best_cuts(sums: DataFrame, g: Growth) -> DataFrame:
    """slot, n, pos, and its best cut: feature, bin, nl, pl, gain (null without one)."""
    node, upto = "OVER (PARTITION BY slot, feature)", "OVER (PARTITION BY slot, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)"
    c = sums.selectExpr("slot", "feature", "bin", *[f"cast(sum({a}) {w} AS double) AS {b}" for a, w, b in (
        ("n", upto, "nl"), ("pos", upto, "pl"), ("n", node, "n"), ("pos", node, "pos"))])
    gain = " - ".join(f"({impurity(n, pos, g.criterion)})" for n, pos in (("n", "pos"), ("nl", "pl"), ("(n - nl)", "(pos - pl)")))
    c = c.selectExpr("*", f"CASE WHEN least(nl, n - nl) >= {max(1, g.min_leaf)} THEN round({gain}, 9) END AS gain")
    best = c.groupBy("slot").agg(F.expr("max(n) AS n"), F.expr("max(pos) AS pos"), F.expr(
        "max_by(struct(feature, bin, nl, pl, gain), CASE WHEN gain > 1e-9 THEN struct(gain, -feature, -bin) END) AS s"))
    return best.select("slot", "n", "pos", "s.*")


def roots(which: list[tuple[int, int]]) -> Trees:
    """Trees that no pass has looked at yet."""
    count = len(which)
    zero = lambda kind: np.zeros(count, dtype=kind)
    return Trees(which, np.arange(count), np.array([number for _, number in which], dtype=np.uint64), np.full(count, -1), zero(np.int64),
                 zero(np.int64), zero(np.int64), zero(np.int64), zero(np.int64), zero(np.int64), zero(float))


def grow(rows: DataFrame, d: int, bins: int, which: list[tuple[int, int]], g: Growth, local: int = 0, look=None) -> Trees:
    """Grow trees ``which`` = (model, number): a tree of model m learns from the rows outside fold m.

    Nodes of at most ``local`` rows below the roots are left as they are, for ``finish``.
    ``look`` stands for the pass that finds the best cuts, for rows that are laid out in another way.
    """
    def passed(rows: DataFrame, t: Trees, nodes: np.ndarray, drawn: np.ndarray, d: int, bins: int, g: Growth):
        return best_cuts(_sums(rows, t, nodes, drawn, d, bins, g.seed), g).toPandas()

    look = look or passed
    t, count = roots(which), len(which)
    k = g.subset or max(1, int(math.sqrt(d)))
    live = np.arange(count)
    while len(live):
        after = []
        for lo in range(0, len(live), SLOTS):
            nodes = live[lo:lo + SLOTS]
            got = look(rows, t, nodes, drawn_features(t.path[nodes], d, min(k, d), g.seed), d, bins, g)
            own = nodes[got["slot"].to_numpy()]
            t.n[own], t.pos[own] = got["n"].to_numpy(), got["pos"].to_numpy()
            got = got[got["gain"].notna()].sort_values("slot")
            split = nodes[got["slot"].to_numpy()]
            ok = t.n[split] >= g.min_split
            got, split = got[ok], split[ok]
            first = len(t.tree) + 2 * np.arange(len(split))
            t.feature[split], t.bin[split] = got["feature"].to_numpy(np.int64), got["bin"].to_numpy(np.int64)
            t.left[split], t.right[split], t.gain[split] = first, first + 1, got["gain"].to_numpy(float)
            nl, pl = got["nl"].to_numpy(np.int64), got["pl"].to_numpy(np.int64)
            pair = lambda a, b: np.stack([a, b], axis=1).ravel()
            new = {"tree": np.repeat(t.tree[split], 2), "path": pair(_child_path(t.path[split], 1), _child_path(t.path[split], 2)),
                   "depth": np.repeat(t.depth[split] + 1, 2), "n": pair(nl, t.n[split] - nl), "pos": pair(pl, t.pos[split] - pl)}
            size = 2 * len(split)
            for name in ("tree", "path", "feature", "bin", "left", "right", "depth", "n", "pos", "gain"):
                old = getattr(t, name)
                more = new.get(name, np.full(size, -1 if name == "feature" else 0))
                setattr(t, name, np.concatenate([old, np.asarray(more).astype(old.dtype)]))
            after.append(first.repeat(2) + np.tile([0, 1], len(split)))
        fresh = np.concatenate(after) if after else np.empty(0, dtype=np.int64)
        able = (t.n[fresh] >= max(g.min_split, 2 * max(1, g.min_leaf))) & (t.pos[fresh] > 0) & (t.pos[fresh] < t.n[fresh])
        if g.max_depth:
            able &= t.depth[fresh] < g.max_depth
        able &= t.n[fresh] > local
        live = fresh[able][np.argsort(t.tree[fresh[able]], kind="stable")]
    return t


def as_forest(t: Trees, cuts: list[np.ndarray] | None, model: int = 0) -> Forest:
    """The trees of one model as a forest on the features' own values, or on bins without ``cuts``."""
    mine = [i for i, (m, _) in enumerate(t.which) if m == model]
    order = np.flatnonzero(np.isin(t.tree, mine))
    order = order[np.argsort(t.tree[order], kind="stable")]
    place = np.full(len(t.tree), 0)
    place[order] = np.arange(len(order))
    f, c = t.feature[order], t.bin[order]
    threshold = c.astype(float) if cuts is None else np.array([cuts[x][y] if x >= 0 else 0.0 for x, y in zip(f, c, strict=True)])
    share = t.pos[order] / np.maximum(t.n[order], 1)
    return Forest(f, threshold, place[t.left[order]], place[t.right[order]], np.stack([1 - share, share], axis=1), t.n[order].astype(float),
                  np.searchsorted(t.tree[order], mine), np.ones(len(mine)), slope=0.0)


def _shares(gains: np.ndarray) -> np.ndarray:
    """Share of the fall of impurity (trees × features) that each feature's splits bring, each tree counting the same."""
    out = np.zeros(gains.shape[1])
    for per in gains:
        out += per / per.sum() if per.sum() else 0.0
    return out / out.sum() if out.sum() else out


def out_of_bag(rows: DataFrame, t: Trees, d: int, seed: int) -> DataFrame:
    """(score, n_pos, n_neg): mean share of the trees whose bag a row is not in; rows in all bags are left out."""
    shape = (t.feature, t.bin, t.left, t.right)
    share = t.pos / np.maximum(t.n, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, label, cols, _ in _cells(batches, d):
            votes, seen = np.zeros(len(row)), np.zeros(len(row), dtype=np.int64)
            for i, (_, number) in enumerate(t.which):
                out = np.flatnonzero(bag_weights(row, number, seed) == 0)
                votes[out] += share[_walk(cols[:, out], i, *shape)]
                seen[out] += 1
            some = seen > 0
            keys, inv = np.unique(votes[some] / seen[some], return_inverse=True)
            pos = np.bincount(inv, weights=label[some], minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(pos), pa.array(np.bincount(inv, minlength=len(keys)) - pos)],
                                             names=["score", "n_pos", "n_neg"])
    return rows.mapInArrow(run, "score double, n_pos bigint, n_neg bigint").groupBy("score").agg(
        F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))


# ---------------------------------------------------------------- small nodes are grown where their rows lie
PARTS = "tree int, node int, kind int, block bigint, data binary"
NAMES = ["tree", "node", "kind", "block", "data"]
SUBTREE, LEARN, VOTE, VOTES, HEAD = range(5)  # a node's subtree and the rows it learns from come before the rows that ask it
PART_BYTES = 16 << 20  # of rows sent to one task
ROW_CHUNK = 1 << 15  # rows of the nodes looked at together: small arrays, few calls
PACK = float(1 << 26)  # weights and positive weights of a cell are summed in one number
WHOLE_GAIN = 1e9  # gains are rounded to nine places


class Sub(NamedTuple):
    """A subtree from its own root 0; kinds and order are those of its written form."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    n: np.ndarray
    pos: np.ndarray
    gain: np.ndarray

    def written(self) -> bytes:
        return b"".join(np.ascontiguousarray(a, dtype=k).tobytes() for a, k in zip(self, SUB_KINDS, strict=True))

    def shape(self) -> tuple[np.ndarray, ...]:
        return self.feature, self.bin, self.left, self.right


SUB_KINDS = (np.int16, np.uint8, np.int32, np.int32, np.int64, np.int64, np.float64)
SUB_BYTES = sum(np.dtype(k).itemsize for k in SUB_KINDS)


def _read_sub(data: bytes) -> Sub:
    count, at, out = len(data) // SUB_BYTES, 0, []
    for k in SUB_KINDS:
        out.append(np.frombuffer(data, dtype=k, count=count, offset=at))
        at += count * np.dtype(k).itemsize
    return Sub(*out)


def _impurity(n: np.ndarray, pos: np.ndarray, criterion: str) -> np.ndarray:
    """As ``impurity``, of arrays; n is above 0."""
    if criterion == "gini":
        return 2.0 * pos * (n - pos) / n
    part = lambda c: np.where(c > 0, -c * np.log(np.where(c > 0, c, 1.0) / n), 0.0)
    return part(pos) + part(n - pos)


def _heads(sorted_numbers: np.ndarray) -> np.ndarray:
    """Where a run of equal numbers begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_numbers[1:] != sorted_numbers[:-1]])) if len(sorted_numbers) else np.empty(0, dtype=np.int64)


def finish(cols: np.ndarray, w: np.ndarray, label: np.ndarray, path: int, depth: int, bins: int, g: Growth) -> Sub:
    """Grow a node to its end from the rows (bins by feature, weight, label) in it: the subtree that ``grow`` finds level by level."""
    d, r = cols.shape
    k, least = min(g.subset or max(1, int(math.sqrt(d))), d), max(1, g.min_leaf)
    most = 2 * r + 1
    feature, cut, left, right = np.full(most, -1, dtype=np.int16), np.zeros(most, dtype=np.uint8), np.zeros(most, dtype=np.int32), np.zeros(most, dtype=np.int32)
    n, pos, gains, paths, depths = np.zeros(most), np.zeros(most), np.zeros(most), np.zeros(most, dtype=np.uint64), np.zeros(most, dtype=np.int32)
    n[0], pos[0], paths[0], depths[0] = w.sum(), w[label > 0].sum(), path, depth
    packed = w + (w * (label > 0)) * PACK
    count, flat = 1, np.ascontiguousarray(cols).ravel()
    todo = [(np.array([0]), np.arange(r), np.zeros(r, dtype=np.int64))] if r else []
    while todo:
        nodes, rows, slot = todo.pop()
        drawn = drawn_features(paths[nodes], d, k, g.seed)
        first, weight, size = slot * (k * bins), packed.take(rows), len(nodes) * k * bins
        cells = np.zeros(size)
        for j in range(k):  # a lane at a time: its values are one take from the columns laid end to end
            at = (drawn[:, j] * r).take(slot)
            at += rows
            key = flat.take(at).astype(np.int64)
            key += first
            if j:
                key += j * bins
            cells += np.bincount(key, weights=weight, minlength=size)
        cell = np.flatnonzero(cells)
        both = np.cumsum(cells[cell])
        part = cell // bins
        first = _heads(part)
        both -= np.repeat(both[first] - cells[cell[first]], np.diff(np.append(first, len(cell))))
        pl = np.floor(both / PACK)
        nl = both - pl * PACK
        own = part // k
        n_all, p_all = n[nodes], pos[nodes]
        some = np.flatnonzero((nl >= least) & (n_all[own] - nl >= least))
        nl, pl, own = nl[some], pl[some], own[some]
        n_own, p_own = n_all[own], p_all[own]
        gain = np.round(_impurity(n_all, p_all, g.criterion)[own] - _impurity(nl, pl, g.criterion) - _impurity(n_own - nl, p_own - pl, g.criterion), 9)
        if len(gain):  # the highest gain, then the first feature, then the first bin
            first = _heads(own)
            top = np.maximum.reduceat(gain, first)
            hit = np.flatnonzero((gain == np.repeat(top, np.diff(np.append(first, len(own))))) & (gain > 1e-9) & (n_own >= g.min_split))
            hit = hit[_heads(own[hit])]
        else:
            hit = np.empty(0, dtype=np.int64)
        if not len(hit):
            continue
        at, where = own[hit], cell[some[hit]]
        split, size = nodes[at], len(hit)
        feature[split], cut[split], gains[split] = drawn[at, where // bins % k], where % bins, gain[hit]
        left[split] = count + 2 * np.arange(size)
        right[split] = left[split] + 1
        fresh = np.arange(count, count + 2 * size)
        n[fresh[::2]], pos[fresh[::2]] = nl[hit], pl[hit]
        n[fresh[1::2]], pos[fresh[1::2]] = n[split] - nl[hit], pos[split] - pl[hit]
        paths[fresh[::2]], paths[fresh[1::2]] = _child_path(paths[split], 1), _child_path(paths[split], 2)
        depths[fresh] = np.repeat(depths[split] + 1, 2)
        count += 2 * size
        able = (n[fresh] >= max(g.min_split, 2 * least)) & (pos[fresh] > 0) & (pos[fresh] < n[fresh])
        if g.max_depth:
            able &= depths[fresh] < g.max_depth
        if not able.any():
            continue
        child_of = np.full(len(nodes), -1)
        child_of[at] = np.arange(size)
        mine = child_of[slot]
        rows, mine = rows[mine >= 0], mine[mine >= 0]
        child = 2 * mine + (flat.take((feature[split].astype(np.int64) * r).take(mine) + rows) > cut[split].take(mine))
        on = able[child]
        rows, child = rows[on], (np.cumsum(able) - 1)[child[on]]
        live = fresh[able]
        if len(rows) <= ROW_CHUNK:
            todo.append((live, rows, child))
            continue
        rows = rows[np.argsort(child.astype(np.uint16) if len(live) <= 1 << 16 else child, kind="stable")]
        each = np.bincount(child, minlength=len(live))
        ends = np.cumsum(each)
        lo = 0
        while lo < len(live):
            base = ends[lo] - each[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, base + ROW_CHUNK, side="right")))
            todo.append((live[lo:hi], rows[base:ends[hi - 1]], np.repeat(np.arange(hi - lo), each[lo:hi])))
            lo = hi
    return Sub(feature[:count], cut[:count], left[:count], right[:count], n[:count], pos[:count], gains[:count])


def open_nodes(t: Trees, g: Growth, local: int) -> np.ndarray:
    """The ends of ``t`` that ``grow`` left to the tasks: small ones that may be split."""
    ends = (t.feature < 0) & (t.n <= local) & (t.n >= max(g.min_split, 2 * max(1, g.min_leaf))) & (t.pos > 0) & (t.pos < t.n)
    if g.max_depth:
        ends &= t.depth < g.max_depth
    ends[:len(t.which)] |= (t.feature[:len(t.which)] < 0) & (t.n[:len(t.which)] == 0)  # roots that no pass has looked at
    return ends


def _sent(block: int, tree: int, kind: int, number: np.ndarray, node: np.ndarray, cols: np.ndarray, beside: list[np.ndarray]) -> Iterator[tuple]:
    """Rows of a block (their numbers in it, what lies beside them, their bins) by the open node they are in."""
    order = np.argsort(node, kind="stable")
    node, number, cols, beside = node[order], number[order].astype(np.int32), cols[:, order], [x[order] for x in beside]
    first = _heads(node)
    for a, z in zip(first.tolist(), np.append(first, len(node))[1:].tolist(), strict=True):
        yield tree, int(node[a]), kind, block, b"".join([number[a:z].tobytes(), *[x[a:z].tobytes() for x in beside], cols[:, a:z].tobytes()])


def _votes(block: int, tree: int, node: int, number: np.ndarray, share: np.ndarray) -> tuple:
    return tree, node, VOTES, block, number.astype(np.int32).tobytes() + share.tobytes()


def _set_votes(block: int, tree: int, node: int, number: np.ndarray, sets: np.ndarray, shares: np.ndarray) -> tuple:
    """Votes by stopping rule: which of the sets of ``shares`` (sets × rows) each rule votes by."""
    return tree, node, VOTES, block, sets.astype(np.uint8).tobytes() + number.astype(np.int32).tobytes() + np.ascontiguousarray(shares).tobytes()


class Stops(NamedTuple):
    """Stopping rules (greatest depth or 0, least split) that are read off one growth."""

    rules: list[tuple[int, int]]

    def of(self, feature: np.ndarray, left: np.ndarray, right: np.ndarray, n: np.ndarray, depth: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set that each rule belongs to, and by set and node where the rule would have ended a walk to the node.

        Rules that no node tells apart are one set. ``depth`` may hold the depths of ``heads`` only.
        """
        depth, levels, front = np.array(depth), [], heads
        while len(inner := front[feature[front] >= 0]):
            levels.append(inner)
            depth[left[inner]] = depth[right[inner]] = depth[inner] + 1
            front = np.concatenate([left[inner], right[inner]])
        inner = np.concatenate(levels) if levels else np.empty(0, dtype=np.int64)
        deepest, fewest = (int(depth[inner].max()), int(n[inner].min())) if len(inner) else (-1, 0)
        plain = [(d if 0 < d <= deepest else 0, s if s > fewest else 0) for d, s in self.rules]
        kinds = sorted(set(plain))
        ends = np.tile(np.arange(len(feature)), (len(kinds), 1))
        for own, (d, s) in zip(ends, kinds, strict=True):
            if (d, s) == (0, 0):
                continue
            for at in levels:
                stop = (own[at] != at) | (n[at] < s) | ((d > 0) & (depth[at] >= d))
                own[left[at]], own[right[at]] = np.where(stop, own[at], left[at]), np.where(stop, own[at], right[at])
        return np.array([kinds.index(x) for x in plain]), ends


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=NAMES)


def _routed(t: Trees, still: np.ndarray, model: int, tree: int, block: int, cols: np.ndarray, asks: np.ndarray, learns: np.ndarray | None = None,
            w: np.ndarray | None = None, label: np.ndarray | None = None, stopped: tuple | None = None) -> Iterator[tuple]:
    """A block's rows on their way through one tree: to the open nodes, or their votes where the tree ends above.

    ``stopped`` (set of every rule, ends by set and node, shares) asks for a vote a stopping rule.
    """
    at = _walk(cols, tree, t.feature, t.bin, t.left, t.right)
    if learns is not None:
        go = learns[still[at[learns]]]
        yield from _sent(block, tree, LEARN, go, at[go], cols[:, go], [w[go].astype(np.uint8), label[go].astype(np.uint8)])
    inside = still[at[asks]]
    go, done = asks[inside], asks[~inside]
    yield from _sent(block, tree, VOTE, go, at[go], cols[:, go], [])
    if len(done) and stopped:
        yield _set_votes(block, tree, -1 - block % 9973, done, stopped[0], stopped[2][stopped[1][:, at[done]]])
    elif len(done):
        yield _votes(block, tree, -1 - block % 9973, done, t.pos[at[done]] / np.maximum(t.n[at[done]], 1))


def _with_head(block: int, kept: pa.RecordBatch) -> tuple:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, kept.schema) as out:
        out.write_batch(kept)
    return -1, -1 - block % 9973, HEAD, block, sink.getvalue().to_pybytes()


def _numbered(batches: Iterator) -> Iterator[tuple[int, object]]:
    """Blocks with a number of their own in the whole table."""
    for i, b in enumerate(batches):
        yield (TaskContext.get().partitionId() << 32) + i, b


def _train_parts(t: Trees, still: np.ndarray, d: int, seed: int, stops: Stops | None = None):
    """Blocks of the binned table to PARTS: every tree learns from its bag and is asked by the rows outside it.

    With ``stops`` a tree of model m learns from its bag of the other folds and is asked by the rows of fold m.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = stops.of(t.feature, t.left, t.right, t.n, t.depth, np.arange(len(t.which))) if stops else None
        share = t.pos / np.maximum(t.n, 1)
        for block, (row, fold, label, cols, _) in _numbered(_cells(batches, d)):
            out = [_with_head(block, pa.RecordBatch.from_arrays([pa.array(label), pa.array(fold)], names=["label", "fold"]))]
            size = 0
            drawn: dict[int, np.ndarray] = {}  # models share their bags
            for i, (m, number) in enumerate(t.which):
                if number not in drawn:
                    drawn[number] = bag_weights(row, number, seed)
                w = drawn[number]
                asks, learns = (np.flatnonzero(fold == m), np.flatnonzero((w > 0) & (fold != m))) if stops else (np.flatnonzero(w == 0), np.flatnonzero(w > 0))
                for r in _routed(t, still, 0, i, block, cols, asks, learns, w, label, (*top, share) if stops else None):
                    out.append(r)
                    size += len(r[4])
                    if size > PART_BYTES:
                        yield _batch(out)
                        out, size = [], 0
            if out:
                yield _batch(out)
    return run


def _grown(t: Trees, d: int, bins: int, g: Growth, stops: Stops | None = None):
    """PARTS by node to PARTS: a node's subtree (grown from its rows if none comes with it) and the votes of the rows that ask it.

    With ``stops`` a row has a vote a stopping rule, and the subtrees are not passed on.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list = [None, None, [], None]  # node, subtree, rows to learn from, sets and shares by node of the stopping rules
        above = stops.of(t.feature, t.left, t.right, t.n, t.depth, np.arange(len(t.which))) if stops else None
        out: list[tuple] = []
        size = last = 0

        def put(*row) -> None:
            nonlocal size
            out.append(row)
            size += len(row[4])

        def subtree(tree: int) -> Sub:
            if own[1] is None:
                w, label = (np.concatenate([x[i] for x in own[2]]) if own[2] else np.empty(0, dtype=np.uint8) for i in (0, 1))
                cols = np.concatenate([x[2] for x in own[2]], axis=1) if own[2] else np.empty((d, 0), dtype=np.uint8)
                own[1], own[2] = finish(cols, w.astype(float), label, t.path[own[0]], t.depth[own[0]], bins, g), []
                if stops is None:
                    put(tree, own[0], SUBTREE, 0, own[1].written())
            return own[1]

        def ruled(s: Sub) -> tuple[np.ndarray, np.ndarray]:
            """The set of every rule and shares by set and node; a rule that ended above the subtree votes from there."""
            if own[3] is None:
                depth = np.zeros(len(s.n), dtype=np.int64)
                depth[0] = t.depth[own[0]]
                sets, ends = stops.of(s.feature, s.left, s.right, s.n, depth, np.array([0]))
                shares = (s.pos / np.maximum(s.n, 1))[ends]
                for rule, kind in enumerate(above[0]):
                    if (end := above[1][kind, own[0]]) != own[0]:
                        sets[rule] = len(shares)
                        shares = np.vstack([shares, np.full(len(s.n), t.pos[end] / max(t.n[end], 1))])
                own[3] = sets, shares
            return own[3]

        for b in batches:
            trees, nodes, kinds, blocks = (b.column(i).to_pylist() for i in range(4))
            for i, (tree, node, kind, block) in enumerate(zip(trees, nodes, kinds, blocks, strict=True)):
                if node != own[0]:
                    if own[0] is not None:
                        subtree(last)
                    own = [None if kind >= VOTES else node, None, [], None]
                    last = tree
                data = b.column(4)[i].as_py()
                if kind >= VOTES:
                    put(tree, node, kind, block, data)
                elif kind == SUBTREE:
                    own[1] = _read_sub(data)
                elif kind == LEARN:
                    count = len(data) // (6 + d)
                    raw = np.frombuffer(data, dtype=np.uint8, offset=4 * count)
                    own[2].append((raw[:count], raw[count:2 * count], raw[2 * count:].reshape(d, count)))
                else:
                    s = subtree(tree)
                    count = len(data) // (4 + d)
                    ends = _walk(np.frombuffer(data, dtype=np.uint8, offset=4 * count).reshape(d, count), 0, *s.shape())
                    number = np.frombuffer(data, dtype=np.int32, count=count)
                    if stops:
                        sets, shares = ruled(s)
                        put(*_set_votes(block, tree, node, number, sets, shares[:, ends]))
                    else:
                        put(*_votes(block, tree, node, number, s.pos[ends] / np.maximum(s.n[ends], 1)))
                if size > PART_BYTES:
                    yield _batch(out)
                    out.clear()
                    size = 0
        if own[0] is not None:
            subtree(last)
        if out:
            yield _batch(out)
    return run


def _summed(ended):
    """VOTES by block and tree after the block's HEAD to what ``ended`` makes of the kept columns, Σ share, Σ (1 - share) and votes of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, sums = None, np.empty((3, 0))
        for b in batches:
            kinds = b.column(2).to_pylist()
            for i, kind in enumerate(kinds):
                data = b.column(4)[i].as_py()
                if kind == HEAD:
                    if kept is not None:
                        yield ended(kept, *sums)
                    kept = pa.ipc.open_stream(data).read_next_batch()
                    sums = np.zeros((3, kept.num_rows))
                    continue
                count = len(data) // 12
                number, share = np.frombuffer(data, dtype=np.int32, count=count), np.frombuffer(data, dtype=float, offset=4 * count)
                sums[0, number] += share  # a tree has one vote a row
                sums[1, number] += 1 - share
                sums[2, number] += 1
        if kept is not None:
            yield ended(kept, *sums)
    return run


def _tasks(df: DataFrame, rows: int, width: int) -> int:
    """Tasks for ``rows`` of ``width`` bytes sent by node or block."""
    return max(shuffle_partitions(df.sparkSession), -(-rows * width // PART_BYTES))


def _by_node(parts: DataFrame, tasks: int) -> DataFrame:
    return parts.repartition(tasks, "node").sortWithinPartitions("node", "kind", "block")


def _by_block(parts: DataFrame, tasks: int) -> DataFrame:
    return parts.filter(F.col("kind") >= VOTES).repartition(tasks, "block").sortWithinPartitions("block", "tree", "node")


def _oob_counts(kept: pa.RecordBatch, share: np.ndarray, _: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    some = seen > 0
    keys, inv = np.unique(share[some] / seen[some], return_inverse=True)
    pos = np.bincount(inv, weights=kept.column(0).to_numpy()[some], minlength=len(keys)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(pos), pa.array(np.bincount(inv, minlength=len(keys)) - pos)], names=["score", "n_pos", "n_neg"])


def grown_parts(rows: DataFrame, count: int, t: Trees, d: int, bins: int, g: Growth, local: int) -> tuple[DataFrame, str]:
    """PARTS of the subtrees below ``t`` and of the out-of-bag votes of every block, written, and where they lie."""
    sent = rows.mapInArrow(_train_parts(t, open_nodes(t, g, local), d, g.seed), PARTS)
    return written_table(_by_node(sent, _tasks(rows, count * len(t.which), d + 6)).mapInArrow(_grown(t, d, bins, g), PARTS), "forest")


def part_gains(parts: DataFrame, t: Trees, d: int) -> np.ndarray:
    """Trees × features: the fall of impurity of all splits, in the nine places of a gain."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(t.which), d), dtype=np.int64)
        for b in batches:
            for tree, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = _read_sub(data)
                split = s.feature >= 0
                np.add.at(sums[tree], s.feature[split], np.rint(s.gain[split] * WHOLE_GAIN).astype(np.int64))
        tree, feature = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(feature, pa.int32()), pa.array(sums[tree, feature])],
                                         names=["tree", "feature", "gain"])

    out = np.zeros((len(t.which), d), dtype=np.int64)
    split = t.feature >= 0
    np.add.at(out, (t.tree[split], t.feature[split]), np.rint(t.gain[split] * WHOLE_GAIN).astype(np.int64))
    found = parts.filter(F.col("kind") == SUBTREE).select("tree", "data").mapInArrow(run, "tree int, feature int, gain bigint")
    for r in found.groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).collect():  # trees × features at most
        out[r["tree"], r["feature"]] += r["gain"]
    return out


class GrownForest:
    """A forest whose trees end in a written table of subtrees: the driver holds their upper parts only."""

    def __init__(self, top: Trees, cuts: list[np.ndarray], bins: int, parts: DataFrame, path: str, g: Growth, local: int) -> None:
        self.top, self.cuts, self.bins, self.parts, self.path, self.g, self.local = top, cuts, bins, parts, path, g, local
        self._collected: Forest | None = None

    def score_rows(self, df: DataFrame, features, keep) -> DataFrame:
        """Columns ``keep``, P(label = 1) as ``score`` and the prediction of every complete row: rows are sent to the subtrees they end in."""
        feats, keep = list(features), list(keep)
        t, cuts, d = self.top, self.cuts, len(self.cuts)
        still = open_nodes(t, self.g, self.local)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, b in _numbered(batches):
                x, ok = complete_rows(b, len(keep), d)
                x = x[ok]
                if not len(x):
                    continue
                cols = binned_columns(cuts, x)
                out = [_with_head(block, b.select(range(len(keep))).filter(pa.array(ok)))]
                size = 0
                for i in range(len(t.which)):
                    for r in _routed(t, still, 0, i, block, cols, np.arange(len(x))):
                        out.append(r)
                        size += len(r[4])
                        if size > PART_BYTES:
                            yield _batch(out)
                            out, size = [], 0
                if out:
                    yield _batch(out)

        def ended(kept: pa.RecordBatch, share: np.ndarray, rest: np.ndarray, _: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*kept.columns, pa.array(share / (rest + share)), pa.array((share > rest).astype(np.int32))],
                                              names=[*keep, "score", "prediction"])

        own = df.select(*[q(c) for c in keep], *[q(f).cast("double").alias(f"_x{i}") for i, f in enumerate(feats)])
        rows = df.count() * len(t.which)
        sent = own.mapInArrow(run, PARTS).unionByName(self.parts.filter(F.col("kind") == SUBTREE))
        voted = _by_node(sent, _tasks(df, rows, d + 4)).mapInArrow(_grown(t, d, self.bins, self.g), PARTS)
        return _by_block(voted, _tasks(df, rows, 12)).mapInArrow(
            _summed(ended), T.StructType([*own.schema.fields[:len(keep)], T.StructField("score", T.DoubleType()), T.StructField("prediction", T.IntegerType())]))

    def unpersist(self) -> None:
        """Let go of the subtrees."""
        delete_path(self.parts.sparkSession, self.path)

    def collected(self) -> Forest:
        """All nodes on the driver: for forests of few rows."""
        if self._collected is None:
            self._collected = as_forest(joined_trees(self.top, self.parts), self.cuts)
        return self._collected

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in (*Forest._fields, "score", "columns", "tree", "raw", "link", "uses"):
            raise AttributeError(name)
        return getattr(self.collected(), name)


def joined_trees(top: Trees, parts: DataFrame) -> Trees:
    """``top`` with its subtrees, on the driver; paths and depths of the subtrees' nodes are left out."""
    cols = {c: [getattr(top, c).copy()] for c in ("tree", "path", "feature", "bin", "left", "right", "depth", "n", "pos", "gain")}
    size = len(top.tree)
    for r in parts.filter(F.col("kind") == SUBTREE).orderBy("node").collect():
        s, node = _read_sub(r["data"]), r["node"]
        inner = s.feature >= 0
        more = {"tree": np.full(len(s.n), r["tree"]), "feature": s.feature, "bin": s.bin, "left": np.where(inner, s.left + size - 1, 0),
                "right": np.where(inner, s.right + size - 1, 0), "n": s.n, "pos": s.pos, "gain": s.gain}
        for c, parts_ in cols.items():
            v = np.asarray(more.get(c, np.zeros(len(s.n)))).astype(parts_[0].dtype)
            if c in more:
                parts_[0][node] = v[0]
            parts_.append(v[1:])
        size += len(s.n) - 1
    return Trees(top.which, *[np.concatenate(v) for v in cols.values()])


def forest(df: DataFrame, key: str, features, g: Growth, label: str = "label", local: int = 0) -> tuple[GrownForest, dict, np.ndarray]:
    """A bagged forest: (forest, out-of-bag accuracy, AUC and rows, importance of every feature).

    Nodes above ``local`` rows (0: a share of the rows within bounds) grow in common passes, smaller ones in the
    tasks that their rows are sent to.
    """
    feats, d = list(features), len(list(features))
    cuts = collected_cuts(df, feats, g.max_bins)
    rows, path = binned_table(df, key, feats, cuts, label)
    bins = max(2, *[len(c) for c in cuts])
    count = rows.select(F.sum(F.octet_length("row"))).first()[0] or 0
    count //= 8
    local = local or min(max(count // LOCAL_SHARE, LOCAL_LEAST), LOCAL_MOST)
    which = [(0, i) for i in range(g.trees)]
    t = grow(rows, d, bins, which, g, local) if count > local else roots(which)
    parts, kept = grown_parts(rows, count, t, d, bins, g, local)
    counts = _by_block(parts, _tasks(rows, count * len(which), 12)).mapInArrow(_summed(_oob_counts), "score double, n_pos bigint, n_neg bigint")
    counts = counts.groupBy("score").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg")).persist()
    right = F.when(F.col("score") > 0.5, F.col("n_pos")).otherwise(F.col("n_neg"))
    r = counts.agg(F.sum(right).alias("right"), F.sum(F.col("n_pos") + F.col("n_neg")).alias("rows")).first()
    auc = ev.auc_of_counts(counts.withColumn("_g", F.lit(1)), ["_g"]).first()
    counts.unpersist()
    delete_path(df.sparkSession, path)
    rows_seen = r["rows"] or 0
    return (GrownForest(t, cuts, bins, parts, kept, g, local),
            {"accuracy": r["right"] / rows_seen if rows_seen else None, "auc": auc["auc"] if auc else None, "rows": rows_seen},
            _shares(part_gains(parts, t, d) / WHOLE_GAIN))


def grid_accuracy(df: DataFrame, key: str, features, fold_col: str, folds: int, grid: dict, g: Growth = Growth(), label: str = "label",
                  workers: int = 3, local: int = 0) -> DataFrame:
    """Mean accuracy over folds of every combination of ``grid``: criterion, min_leaf, max_depth (0: none), min_split, trees.

    Criterion and least leaf change the cuts, so each pair is a growth of its own (all folds
    together, with the most trees); the other axes are read off it. Nodes above ``local`` rows
    (0: as many as a task may hold) grow in common passes, smaller ones in the tasks that their rows are sent to.
    """
    feats, d = list(features), len(list(features))
    cuts = collected_cuts(df, feats, g.max_bins)
    bins = max(2, *[len(c) for c in cuts])
    rows, path = binned_table(df, key, feats, cuts, label, fold_col)
    most = max(grid["trees"])
    stops = [(depth, split) for depth in grid["max_depth"] for split in grid["min_split"]]
    deepest = 0 if 0 in grid["max_depth"] else max(grid["max_depth"])

    count = (rows.select(F.sum(F.octet_length("row"))).first()[0] or 0) // 8
    which = [(m, i) for m in range(folds) for i in range(most)]
    # there are many trees: a task grows one alone, as long as its rows are no more than a task may hold
    local = local or LOCAL_MOST

    def one(pair: tuple[str, int]) -> list[tuple]:
        criterion, leaf = pair
        own = Growth(most, deepest, leaf, min(grid["min_split"]), criterion, g.subset, g.max_bins, g.seed)
        t = grow(rows, d, bins, which, own, local) if count > local else roots(which)
        right = _grid_votes(rows, count, t, d, bins, own, local, folds, Stops(stops), sorted(grid["trees"]))
        return [(criterion, leaf, *stops[r["stop"]], r["trees"], r["accuracy"]) for r in right]

    pairs = [(c, leaf) for c in grid["criterion"] for leaf in grid["min_leaf"]]
    with ThreadPoolExecutor(max_workers=workers) as ex:  # growths are jobs of their own
        out = [row for part in ex.map(one, pairs) for row in part]
    delete_path(df.sparkSession, path)
    kind = "criterion string, min_samples_leaf int, max_depth int, min_samples_split int, n_estimators int, avg_metric double"
    return df.sparkSession.createDataFrame(out, kind)


def _grid_votes(rows: DataFrame, count: int, t: Trees, d: int, bins: int, g: Growth, local: int, folds: int, stops: Stops, sizes: list[int]) -> list:
    """Accuracy of every stopping rule and number of trees: trees are grown and asked where their rows lie, votes are summed by block."""
    rules = len(stops.rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros((folds, rules, len(sizes)), dtype=np.int64)
        seen = np.zeros(folds, dtype=np.int64)
        label = fold = votes = last = None

        def ended() -> None:
            """A tree's votes are in: the forest that ends with it is measured."""
            if last is not None and t.which[last][1] + 1 in sizes:
                m, size = t.which[last][0], t.which[last][1] + 1
                mine = fold == m
                right[m, :, sizes.index(size)] += ((votes[:, mine] > 0.5 * size) == (label[mine] == 1)).sum(axis=1)

        for b in batches:
            trees, kinds = b.column(0).to_pylist(), b.column(2).to_pylist()
            for i, (tree, kind) in enumerate(zip(trees, kinds, strict=True)):
                data = b.column(4)[i].as_py()
                if kind == HEAD:
                    ended()
                    kept = pa.ipc.open_stream(data).read_next_batch()
                    label, fold = (kept.column(c).to_numpy() for c in (0, 1))
                    votes, last = np.zeros((rules, len(label))), None
                    seen += np.bincount(fold, minlength=folds)[:folds]
                    continue
                if tree != last:
                    ended()
                    last = tree
                sets = np.frombuffer(data, dtype=np.uint8, count=rules)
                kinds_of = int(sets.max()) + 1
                n = (len(data) - rules) // (4 + 8 * kinds_of)
                number = np.frombuffer(data, dtype=np.int32, count=n, offset=rules)
                shares = np.frombuffer(data, dtype=float, count=n * kinds_of, offset=rules + 4 * n).reshape(kinds_of, n)
                for rule, own in enumerate(sets):
                    votes[rule, number] += shares[own]  # a tree has one vote a row
        ended()
        some = np.indices(right.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in some], pa.array(right.ravel()), pa.array(seen[some[0]])],
                                         names=["fold", "stop", "size", "right", "n"])

    sent = rows.mapInArrow(_train_parts(t, open_nodes(t, g, local), d, g.seed, stops), PARTS)
    grown = _by_node(sent, _tasks(rows, count * len(t.which), d + 6)).mapInArrow(_grown(t, d, bins, g, stops), PARTS)
    voted = _by_block(grown, _tasks(rows, count * len(t.which) // folds, 20))
    per = voted.mapInArrow(run, "fold int, stop int, size int, right bigint, n bigint").groupBy("fold", "stop", "size").agg(
        (F.sum("right") / F.sum("n")).alias("a"))
    trees = F.get(F.array(*[F.lit(s) for s in sizes]), F.col("size"))
    return per.groupBy("stop", trees.alias("trees")).agg(F.avg("a").alias("accuracy")).orderBy("stop", "trees").collect()  # one row a combination
