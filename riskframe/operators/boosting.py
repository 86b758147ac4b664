"""Histogram boosting on Spark: second-order gains with L1/L2, leaf-wise growth, GOSS, DART, symmetric trees.

The rows are binned once and written: one byte a feature. A pass over them puts
every row at its open node and sums gradients and curvatures per (node,
feature, bin) inside the task; Spark adds the cells of all tasks up, running
sums over the bins give both sides of every cut, and one row a node comes back.
Sums are whole numbers (2^-30 of a unit), so a fit does not depend on how the
rows are dealt. Draws (row sampling, GOSS) are functions of the row's key and
the round, column draws of round and node.

Several models grow in the same passes: with a fold column, model ``m`` learns
from the rows of all other folds and is measured on fold ``m`` after every
round, so cross-validated rounds are added in place and stopped in flight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.columns import q
from riskframe.functions.rand import b, b60
from riskframe.operators import evaluate as ev
from riskframe.operators.flat_trees import Forest, complete_rows
from riskframe.plans.prefix import prefix_sums
from riskframe.plans.reshape import to_long
from riskframe.session import delete_path, shuffle_partitions, written_table

UNIT = 1 << 30
CELLS = "slot int, feature int, bin int, g bigint, h bigint, n bigint"


@dataclass(frozen=True)
class Params:
    """What a fit depends on. ``grow`` is depth, leaf or symmetric; ``boosting`` gbdt, dart or goss."""

    rounds: int = 100
    learning_rate: float = 0.1
    max_depth: int = 6
    num_leaves: int = 31  # of leaf-wise growth
    grow: str = "depth"
    boosting: str = "gbdt"
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    gamma: float = 0.0  # least gain of a split
    min_child_weight: float = 1.0  # least curvature of a child
    min_data_in_leaf: int = 1
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    colsample_bylevel: float = 1.0
    scale_pos_weight: float = 1.0
    drop_rate: float = 0.1  # dart
    skip_drop: float = 0.5
    top_rate: float = 0.2  # goss
    other_rate: float = 0.1
    max_bins: int = 64
    seed: int = 42
    pin_every: int = 4  # rounds after which margins are written again


def hashed(rows: np.ndarray, *salt: int | np.ndarray) -> np.ndarray:
    """A uniform draw in [0, 1) for every row key and salt; a salt may be an array beside the keys."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64)
        for s in (0, *salt):
            x = x + np.uint64(0x9E3779B97F4A7C15) * np.uint64(s + 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(float) / 2.0 ** 53


# ---------------------------------------------------------------- bins
def bin_cuts(df: DataFrame, features, max_bins: int) -> DataFrame:
    """(feature, bin, cut): upper ends of at most ``max_bins`` bins of about equal numbers of rows.

    A value falls into group floor(rows below it · max_bins / rows); a group's largest value is its cut.
    """
    counts = to_long(df, [], features).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    run = prefix_sums(counts, ["feature"], ["value"], ["n"], totals={"n": "rows"})
    group = F.floor((F.col("cum_n") - F.col("n")) * max_bins / F.col("rows"))
    cuts = run.groupBy("feature", group.alias("part")).agg(F.max("value").alias("cut"))
    return cuts.select("feature", (F.row_number().over(Window.partitionBy("feature").orderBy("part")) - 1).alias("bin"), "cut")


def collected_cuts(df: DataFrame, features, max_bins: int) -> list[np.ndarray]:
    rows = bin_cuts(df, features, max_bins).collect()  # features × max_bins at most
    return [np.array(sorted(r["cut"] for r in rows if r["feature"] == f)) for f in features]


BINNED = "row binary, fold binary, label binary, bins binary, margins binary"


def _block(row: np.ndarray, fold: np.ndarray, label: np.ndarray, cols: np.ndarray, margins: np.ndarray) -> pa.RecordBatch:
    """A batch of one block: arrays of all its rows; bins by feature, margins by model."""
    kinds = (np.int64, np.int32, float, np.uint8, float)
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, dtype=k).tobytes()], pa.binary())
                                       for x, k in zip((row, fold, label, cols, margins), kinds, strict=True)],
                                      names=["row", "fold", "label", "bins", "margins"])


def binned_columns(cuts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Rows × features to the features' bins × rows; a value above the last cut falls into the last bin."""
    bins = np.empty(x.shape[::-1], dtype=np.uint8)
    for i, c in enumerate(cuts):
        bins[i] = np.minimum(np.searchsorted(c, x[:, i], side="left"), max(len(c) - 1, 0))
    return bins


def _binned(cuts: list[np.ndarray], models: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = complete_rows(batch, 3, len(cuts))
            x = x[ok]
            if len(x):
                yield _block(*(batch.column(i).to_numpy(zero_copy_only=False)[ok] for i in range(3)), binned_columns(cuts, x), np.zeros((models, len(x))))
    return run


def binned_table(df: DataFrame, key: str, features, cuts: list[np.ndarray], label: str = "label", fold_col: str | None = None,
                 models: int = 1) -> tuple[DataFrame, str]:
    """The rows by bins, written, and where they lie: a draw of the key, fold, label, a byte a feature, a margin a model.

    A written row is a block of rows (a batch of the task that bins them), so a pass reads arrays and no single values.
    """
    fold = F.col(fold_col).cast("int") if fold_col else F.lit(-1)
    own = df.select(b60("row", q(key)).alias("row"), fold.alias("fold"), q(label).cast("double").alias("label"),
                    *[q(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    # dealt evenly once: a few bytes a row are read by every pass, and a pass is work more than bytes
    own = own.repartition(shuffle_partitions(df.sparkSession), "row")
    return written_table(own.mapInArrow(_binned(cuts, models), BINNED), "binned")


def _cells(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[np.ndarray, ...]]:
    """row, fold, label, bins (features × rows) and margins (models × rows) of every block of the binned table.

    Also of a table of single rows, where bins are bytes and margins an array: a batch is a block.
    """
    kinds = (np.int64, np.int32, float, np.uint8, float)
    for batch in batches:
        if not pa.types.is_binary(batch.schema.field(0).type):
            row, fold, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, features)
            yield row, fold, label, np.ascontiguousarray(raw.T), batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(row), -1).T
            continue
        for i in range(batch.num_rows):
            row, fold, label, bins, margins = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=k) for c, k in enumerate(kinds))
            yield row, fold, label, bins.reshape(features, len(row)), margins.reshape(-1, len(row))


# ---------------------------------------------------------------- trees in the making
@dataclass
class Tree:
    """Nodes of one tree by bins: children of splits, sums of the rows seen, and the best split found."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    sums: list[tuple[float, float, int]] = field(default_factory=list)  # gradient, curvature, rows
    best: list[dict | None] = field(default_factory=list)  # None: not looked at yet

    def add(self, depth: int, sums: tuple[float, float, int]) -> int:
        for column, value in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.depth, depth), (self.sums, sums),
                              (self.best, None)):
            column.append(value)
        return len(self.feature) - 1

    def split(self, node: int, s: dict) -> None:
        g, h, n = self.sums[node]
        self.feature[node], self.bin[node] = s["feature"], s["bin"]
        self.left[node] = self.add(self.depth[node] + 1, (s["gl"], s["hl"], s["nl"]))
        self.right[node] = self.add(self.depth[node] + 1, (g - s["gl"], h - s["hl"], n - s["nl"]))

    def place(self) -> Forest:
        """The tree on bins, giving the number of the node that a row ends in."""
        return Forest(np.array(self.feature), np.array(self.bin, dtype=float), np.array(self.left), np.array(self.right),
                      np.arange(len(self.feature), dtype=float)[:, None], np.zeros(len(self.feature)), np.array([0]), np.ones(1))

    def pruned(self, leaves: set[int]) -> Tree:
        """The part above ``leaves``."""
        out = Tree()

        def copy(node: int) -> int:
            at = out.add(self.depth[node], self.sums[node])
            if node not in leaves:
                out.feature[at], out.bin[at] = self.feature[node], self.bin[node]
                out.left[at] = copy(self.left[node])
                out.right[at] = copy(self.right[node])
            return at

        copy(0)
        return out

    def leaf_values(self, p: Params) -> np.ndarray:
        g, h = np.array([s[0] for s in self.sums]), np.array([s[1] for s in self.sums])
        return -np.sign(g) * np.maximum(np.abs(g) - p.reg_alpha, 0.0) / np.maximum(h + p.reg_lambda, 1e-12)


def joined(trees: list[tuple[Tree, np.ndarray]], weights: list[float], base: float, cuts: list[np.ndarray] | None = None) -> Forest:
    """Trees and leaf values as one forest: on bins, or on the features' own values with ``cuts``."""
    heads = np.cumsum([0, *[len(t.feature) for t, _ in trees]])
    cat = lambda parts, kind=float: np.concatenate([np.asarray(x, dtype=kind) for x in parts]) if parts else np.empty(0, dtype=kind)
    feature, bins = cat([t.feature for t, _ in trees], np.int64), cat([t.bin for t, _ in trees], np.int64)
    threshold = bins.astype(float) if cuts is None else np.array([cuts[f][c] if f >= 0 else 0.0 for f, c in zip(feature, bins, strict=True)])
    return Forest(feature, threshold, cat([np.array(t.left) + h for (t, _), h in zip(trees, heads, strict=False)], np.int64),
                  cat([np.array(t.right) + h for (t, _), h in zip(trees, heads, strict=False)], np.int64), cat([v for _, v in trees])[:, None],
                  cat([[s[2] for s in t.sums] for t, _ in trees]), heads[:-1], np.array(weights, dtype=float), base=base)


# ---------------------------------------------------------------- passes over the rows
class Round(NamedTuple):
    """What every pass of a round needs to know of the models."""

    number: int
    changes: list[Forest | None]  # what has come to the written margins since, for the gradients of this round
    goss: list[int] | None  # the cut of |gradient| of every model


def gradients(margin: np.ndarray, label: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    prob = 1.0 / (1.0 + np.exp(-margin))
    w = np.where(label == 1, p.scale_pos_weight, 1.0)
    return (prob - label) * w, prob * (1 - prob) * w


def row_weights(row: np.ndarray, g: np.ndarray, model: int, r: Round, p: Params) -> np.ndarray:
    """0 for rows left out of this round, more than 1 for those that stand for others."""
    if r.goss is not None:
        top = np.rint(np.abs(g) * UNIT) >= r.goss[model]
        share = p.other_rate / (1 - p.top_rate)
        return np.where(top, 1.0, np.where(hashed(row, p.seed, r.number, 2) < share, 1 / share, 0.0))
    if p.subsample < 1:
        return (hashed(row, p.seed, r.number, 1) < p.subsample).astype(float)
    return np.ones(len(row))


def histogram(rows: DataFrame, p: Params, r: Round, open_nodes: list[tuple[int, Tree, int]], allowed: np.ndarray, bins: int,
              dense: bool = False) -> DataFrame:
    """(slot, feature, bin, g, h, n) of the open nodes (model, tree, node), added up over all tasks.

    ``allowed`` says which features a slot may be split on. ``dense`` keeps empty cells.
    """
    slots, d = allowed.shape
    tried = np.flatnonzero(allowed.any(axis=0))
    places: dict[int, tuple[Forest, np.ndarray]] = {}
    for slot, (m, tree, node) in enumerate(open_nodes):
        if m not in places:
            places[m] = (tree.place(), np.full(len(tree.feature), -1))
        places[m][1][node] = slot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, slots, d, bins), dtype=np.int64)
        for row, fold, label, cols, margins in _cells(batches, d):
            for m, (place, slot_of) in places.items():
                margin = margins[m] + (r.changes[m].raw(cols)[0] if r.changes[m] is not None else 0.0)
                g, h = gradients(margin, label, p)
                w = row_weights(row, g, m, r, p)
                slot = slot_of[place.tree(0, cols)[0].astype(np.int64)]
                use = np.flatnonzero((fold != m) & (w > 0) & (slot >= 0))
                at = slot[use] * bins
                parts = [np.rint(g[use] * w[use] * UNIT), np.rint(h[use] * w[use] * UNIT), None]
                for f in tried:
                    key = at + cols[f][use]
                    for s, part in zip(sums, parts, strict=True):
                        s[:, f] += np.bincount(key, weights=part, minlength=slots * bins).reshape(slots, bins).astype(np.int64)
        sums *= allowed[None, :, :, None]
        some = np.nonzero(np.broadcast_to(allowed[:, :, None], sums.shape[1:]) if dense else sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)) for i in some] + [pa.array(s[some]) for s in sums],
                                         names=["slot", "feature", "bin", "g", "h", "n"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    # tasks have added up their own rows: one exchange serves the sums, the running sums over bins and the choice of a slot's cut
    return rows.mapInArrow(run, CELLS).repartition("slot").groupBy("slot", "feature", "bin").agg(whole("g"), whole("h"), F.sum("n").alias("n"))


def sides(hist: DataFrame) -> DataFrame:
    """Both sides of every cut: gl, hl, nl up to the bin; g, h, n of the node, in units of 1."""
    node, upto = "OVER (PARTITION BY slot, feature)", "OVER (PARTITION BY slot, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)"
    return hist.selectExpr("slot", "feature", "bin", *[f"cast(sum({c}) {upto} AS double) / {UNIT} AS {c}l" for c in "gh"], f"sum(n) {upto} AS nl",
                           *[f"cast(sum({c}) {node} AS double) / {UNIT} AS {c}" for c in "gh"], f"sum(n) {node} AS n")


def with_gain(cuts: DataFrame, p: Params) -> DataFrame:
    """``gain`` of every cut: what the penalised loss falls by. Null where a side is too light, 0 in a symmetric tree."""
    def worth(g: str, h: str) -> str:
        return f"pow(greatest(abs({g}) - {float(p.reg_alpha)!r}D, 0D), 2) / greatest({h} + {float(p.reg_lambda)!r}D, 1e-12D)"
    gain = f"{worth('gl', 'hl')} + {worth('(g - gl)', '(h - hl)')} - {worth('g', 'h')}"
    heavy = f"least(hl, h - hl) >= {float(p.min_child_weight)!r}D AND least(nl, n - nl) >= {max(1, p.min_data_in_leaf)}"
    return cuts.selectExpr("*", f"CASE WHEN {heavy} THEN {gain} {'ELSE 0D' if p.grow == 'symmetric' else ''} END AS gain")


def best_splits(hist: DataFrame, p: Params) -> list[dict]:
    """The best cut of every slot (lowest feature and bin among equals) and the slot's sums; ``gain`` is null without a cut."""
    best = F.expr("max_by(struct(feature, bin, gl, hl, nl, gain), CASE WHEN gain IS NOT NULL THEN struct(gain, -feature, -bin) END) AS s")
    out = with_gain(sides(hist), p).groupBy("slot").agg(best, F.expr("max(g) AS g"), F.expr("max(h) AS h"), F.expr("max(n) AS n")).collect()  # one row a node
    return [{"slot": r["slot"], "g": r["g"], "h": r["h"], "n": r["n"], **(r["s"].asDict() if r["s"] else {"gain": None})} for r in out]


def best_symmetric(hist: DataFrame, p: Params, per_model: int) -> dict[int, dict]:
    """For every model the one cut that all its open nodes take: the largest sum of gains. Each slot's sides come along."""
    per = with_gain(sides(hist), p)
    group = per.groupBy(F.expr(f"slot div {per_model}").alias("model"), "feature", "bin").agg(
        F.sum("gain").alias("gain"), F.collect_list(F.struct("slot", "gl", "hl", "nl", "g", "h", "n")).alias("slots"))  # a level's nodes
    first = F.struct(F.round("gain", 9), -F.col("feature"), -F.col("bin"))
    best = group.groupBy("model").agg(F.max_by(F.struct("feature", "bin", "gain", "slots"), first).alias("s"))
    return {r["model"]: r["s"].asDict(recursive=True) for r in best.collect()}


def goss_cut(rows: DataFrame, p: Params, changes: list[Forest | None], models: int, features: int) -> list[int]:
    """The exact |gradient| (in units) that the ``top_rate`` largest of each model reach: counted by leading, then by trailing digits."""
    def counts(lead: list[int] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, fold, label, cols, margins in _cells(batches, features):
                for m in range(models):
                    margin = margins[m] + (changes[m].raw(cols)[0] if changes[m] is not None else 0.0)
                    v = np.rint(np.abs(gradients(margin, label, p)[0]) * UNIT).astype(np.int64)[fold != m]
                    v = v >> 15 if lead is None else v[v >> 15 == lead[m]]
                    keys, n = np.unique(v, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), m, dtype=np.int32)), pa.array(keys), pa.array(n)], names=["m", "v", "n"])
        got = rows.mapInArrow(run, "m int, v bigint, n bigint").groupBy("m", "v").agg(F.sum("n").alias("n")).collect()  # 2^15 values a unit of weight
        return [sorted(((r["v"], r["n"]) for r in got if r["m"] == m), reverse=True) for m in range(models)]

    def reach(table: list[tuple[int, int]], k: int) -> tuple[int, int]:
        for v, n in table:
            if k <= n:
                return v, k
            k -= n
        return 0, 0

    first = counts(None)
    at = [reach(t, max(1, math.ceil(p.top_rate * sum(n for _, n in t)))) for t in first]
    second = counts([v for v, _ in at])
    return [reach(t, k)[0] for t, (_, k) in zip(second, at, strict=True)]


# ---------------------------------------------------------------- growing
def _columns(p: Params, d: int, number: int, level: int, node: int = 0) -> np.ndarray:
    """Features that a node may be split on: a draw of the round's, cut again by level."""
    out = np.arange(d)
    for share, key in ((p.colsample_bytree, (number,)), (p.colsample_bylevel, (number, 1000 + level))):
        if share < 1:
            out = np.sort(np.random.default_rng([p.seed, *key]).choice(out, max(1, int(round(share * len(out)))), replace=False))
    return np.isin(np.arange(d), out)


def grow_trees(rows: DataFrame, p: Params, r: Round, models: list[int], d: int, bins: int) -> dict[int, Tree]:
    """One tree for each of ``models``, grown in common passes."""
    trees = {m: Tree() for m in models}
    for t in trees.values():
        t.add(0, (0.0, 0.0, 0))
    if p.grow == "symmetric":
        _grow_symmetric(rows, p, r, trees, d, bins)
        return trees

    def look(todo: list[tuple[int, Tree, int]]) -> None:
        allowed = np.stack([_columns(p, d, r.number, t.depth[node], node) for _, t, node in todo])
        for _, t, node in todo:
            t.best[node] = {"gain": None}
        for s in best_splits(histogram(rows, p, r, todo, allowed, bins), p):
            _, t, node = todo[s["slot"]]
            t.best[node] = s
            if node == 0:
                t.sums[0] = (s["g"], s["h"], s["n"])

    def worthy(t: Tree, node: int) -> bool:
        s = t.best[node]
        return bool(s) and s["gain"] is not None and s["gain"] > max(p.gamma, 1e-12)

    if p.grow == "depth":
        live = [(m, t, 0) for m, t in trees.items()]
        for level in range(p.max_depth):
            look(live)
            split = [(m, t, node) for m, t, node in live if worthy(t, node)]
            for _, t, node in split:
                t.split(node, t.best[node])
            live = [(m, t, child) for m, t, node in split for child in (t.left[node], t.right[node])]
            if not live:
                break
        return trees

    # leaf-wise: splits of the highest gain first; a pass also looks below the leaves that are likely to be taken next
    taken = {m: {0} for m in models}
    deep = lambda t, node: 0 < p.max_depth <= t.depth[node]
    while True:
        todo = []
        for m, t in trees.items():
            while len(taken[m]) < p.num_leaves:
                if any(t.best[node] is None and not deep(t, node) for node in taken[m]):
                    break
                ready = [node for node in taken[m] if not deep(t, node) and worthy(t, node)]
                if not ready:
                    break
                node = max(ready, key=lambda x: (t.best[x]["gain"], -x))
                if t.feature[node] < 0:
                    t.split(node, t.best[node])
                taken[m] = taken[m] - {node} | {t.left[node], t.right[node]}
            if len(taken[m]) < p.num_leaves:
                wait = [node for node in range(len(t.feature)) if t.best[node] is None and not deep(t, node)]
                if any(node in taken[m] for node in wait):
                    todo += [(m, t, node) for node in wait]
        if not todo:
            break
        look(todo)
        for m, t in trees.items():
            room = p.num_leaves - len(taken[m])
            tips = [x for x in range(len(t.feature)) if t.feature[x] < 0 and worthy(t, x) and not deep(t, x)]
            for node in sorted(tips, key=lambda x: -t.best[x]["gain"])[:max(room, 0)]:
                t.split(node, t.best[node])
    return {m: t.pruned(taken[m]) for m, t in trees.items()}


def _grow_symmetric(rows: DataFrame, p: Params, r: Round, trees: dict[int, Tree], d: int, bins: int) -> None:
    live = {m: [0] for m in trees}
    for level in range(p.max_depth):
        width = 1 << level  # a level is whole in every model that still grows
        todo = [(m, trees[m], node) for m, nodes in live.items() for node in nodes]
        allowed = np.stack([_columns(p, d, r.number, level)] * len(todo))
        found = best_symmetric(histogram(rows, p, r, todo, allowed, bins, dense=True), p, width)
        after = {}
        for i, m in enumerate(live):
            t, s = trees[m], found[i]
            per = {x["slot"]: x for x in s["slots"]}
            if level == 0:
                t.sums[0] = tuple(per[i][c] for c in "ghn")
            if s["gain"] <= max(p.gamma, 1e-12):
                continue
            for j, node in enumerate(live[m]):
                t.split(node, {"feature": s["feature"], "bin": s["bin"], **{c: per[i * width + j][c] for c in ("gl", "hl", "nl")}})
            after[m] = [child for node in live[m] for child in (t.left[node], t.right[node])]
        live = after
        if not live:
            break


# ---------------------------------------------------------------- fits
class Fitted(NamedTuple):
    """A forest on the features' own values for each model, and (round, mean AUC, best, stopped) rows."""

    forests: list[Forest]
    history: list[tuple[int, float, bool, bool]]
    trees: list[list[Tree]]
    weights: list[list[float]]


def _dropped(p: Params, number: int, model: int, count: int) -> list[int]:
    if p.boosting != "dart" or not count:
        return []
    rng = np.random.default_rng([p.seed, number, 77, model])
    if rng.random() < p.skip_drop:
        return []
    out = np.flatnonzero(rng.random(count) < p.drop_rate).tolist()
    return out or [int(rng.integers(count))]


def round_auc(rows: DataFrame, changes: list[Forest | None], models: int, features: int) -> list[float]:
    """AUC of every model on its own fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, fold, label, cols, margins in _cells(batches, features):
            for m in range(models):
                mine = fold == m
                margin = (margins[m] + (changes[m].raw(cols)[0] if changes[m] is not None else 0.0))[mine]
                keys, inv = np.unique(margin, return_inverse=True)
                pos = np.bincount(inv, weights=label[mine], minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), m, dtype=np.int32)), pa.array(keys), pa.array(pos),
                                                  pa.array(np.bincount(inv, minlength=len(keys)) - pos)], names=["m", "score", "n_pos", "n_neg"])
    counts = rows.mapInArrow(run, "m int, score double, n_pos bigint, n_neg bigint").groupBy("m", "score").agg(
        F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    got = {r["m"]: r["auc"] for r in ev.auc_of_counts(counts, ["m"]).collect()}
    return [got.get(m) if got.get(m) is not None else math.nan for m in range(models)]


def fit(df: DataFrame, key: str, features, p: Params, label: str = "label", fold_col: str | None = None, models: int = 1,
        patience: int | None = None, cuts: list[np.ndarray] | None = None) -> Fitted:
    """Boost ``models`` models in common passes; with ``fold_col`` model m leaves out the rows of fold m.

    With ``patience`` AUC on the left-out rows is taken after every round and rounds end that many after the best.
    """
    feats, d = list(features), len(list(features))
    if not 2 <= p.max_bins <= 256:
        raise ValueError("2 to 256 bins")
    if p.boosting == "goss" and not 0 < p.other_rate <= 1 - p.top_rate:
        raise ValueError("other_rate lies in (0, 1 - top_rate]")
    cuts = cuts if cuts is not None else collected_cuts(df, feats, p.max_bins)
    bins = max(2, *[len(c) for c in cuts])
    rows, path = binned_table(df, key, feats, cuts, label, fold_col, models)
    trees: list[list[tuple[Tree, np.ndarray]]] = [[] for _ in range(models)]
    weights: list[list[float]] = [[] for _ in range(models)]
    pinned: list[list[float]] = [[] for _ in range(models)]  # what the written margins hold of every tree

    def change(m: int, now: list[float]) -> Forest | None:
        parts = [(trees[m][i], w - old) for i, (w, old) in enumerate(zip(now, pinned[m], strict=True)) if w != old]
        return joined([t for t, _ in parts], [w for _, w in parts], 0.0) if parts else None

    history: list[tuple[int, float]] = []
    best = 0
    for number in range(p.rounds):
        gone = [_dropped(p, number, m, len(trees[m])) for m in range(models)]
        seen = [[0.0 if i in g else w for i, w in enumerate(weights[m])] for m, g in enumerate(gone)]
        changes = [change(m, s) for m, s in enumerate(seen)]
        r = Round(number, changes, goss_cut(rows, p, changes, models, d) if p.boosting == "goss" else None)
        grown = grow_trees(rows, p, r, list(range(models)), d, bins)
        for m in range(models):
            k = len(gone[m])
            for i in gone[m]:
                weights[m][i] *= k / (k + p.learning_rate)
            trees[m].append((grown[m], grown[m].leaf_values(p)))
            weights[m].append(p.learning_rate / (k + p.learning_rate) if k else p.learning_rate)
            pinned[m].append(0.0)
        now = [change(m, weights[m]) for m in range(models)]
        if patience:
            history.append((number + 1, float(np.mean(round_auc(rows, now, models, d)))))
            best = number if history[-1][1] > history[best][1] else best
            if number - best >= patience:
                break
        if (number + 1) % p.pin_every == 0 and number + 1 < p.rounds:
            old, (rows, path) = path, written_table(_with_margins(rows, now, models, d), "binned")
            delete_path(df.sparkSession, old)
            pinned = [list(w) for w in weights]
    delete_path(df.sparkSession, path)
    last = len(history) - 1
    told = [(i, auc, n == best, n == last and last - best >= (patience or 0)) for n, (i, auc) in enumerate(history)]
    keep = best + 1 if patience else None
    return Fitted([joined(trees[m][:keep], weights[m][:keep], 0.0, cuts) for m in range(models)], told,
                  [[t for t, _ in trees[m]] for m in range(models)], weights)


def _with_margins(rows: DataFrame, changes: list[Forest | None], models: int, features: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, fold, label, cols, margins in _cells(batches, features):
            new = np.stack([margins[m] + (changes[m].raw(cols)[0] if changes[m] is not None else 0.0) for m in range(models)])
            yield _block(row, fold, label, cols, new)
    return rows.mapInArrow(run, BINNED)


# ---------------------------------------------------------------- ordered target statistics
def ordered_statistics(df: DataFrame, key: str, columns, label: str = "label", prior: float = 0.5, weight: float = 1.0,
                       salt: str = "ts") -> DataFrame:
    """(key, one column a level column): (labels of earlier rows of the level + weight · prior) / (earlier rows + weight).

    Earlier is by a seeded order of all rows, so no row sees its own label. A null level is a level.
    """
    cols = list(columns)
    long = df.select(key, F.col(label).cast("bigint").alias("_y"), F.lit(1).cast("bigint").alias("_one"), b(salt, q(key)).alias("_h"),
                     F.explode(F.array(*[F.struct(F.lit(i).alias("i"), q(c).cast("string").alias("level")) for i, c in enumerate(cols)])).alias("s"))
    long = long.select(key, "_y", "_one", "_h", F.col("s.i").alias("_i"), F.col("s.level").alias("_level"))
    run = prefix_sums(long, ["_i", "_level"], ["_h", key], ["_y", "_one"])
    value = (F.col("cum__y") - F.col("_y") + F.lit(weight * prior)) / (F.col("cum__one") - F.col("_one") + F.lit(float(weight)))
    return run.groupBy(key).agg(*[F.max(F.when(F.col("_i") == i, value)).alias(c) for i, c in enumerate(cols)])


def level_statistics(df: DataFrame, column: str, label: str = "label", prior: float = 0.5, weight: float = 1.0) -> DataFrame:
    """(level, value): the statistic of all training rows, for rows that were not in training."""
    return df.groupBy(q(column).cast("string").alias("level")).agg(
        ((F.sum(label) + F.lit(weight * prior)) / (F.count(F.lit(1)) + F.lit(float(weight)))).alias("value"))


def encode_levels(train: DataFrame, other: DataFrame, key: str, columns, one_hot_max_size: int = 2, label: str = "label",
                  prior: float = 0.5) -> tuple[DataFrame, DataFrame, list[str]]:
    """Level columns to numbers: 0/1 columns up to ``one_hot_max_size`` levels, ordered statistics beyond; (train, other, new names)."""
    names: list[str] = []
    ordered = []
    for c in columns:
        levels = [r[0] for r in train.select(q(c)).distinct().limit(one_hot_max_size + 1).collect()]
        if len(levels) > one_hot_max_size:
            ordered.append(c)
            continue
        for n, v in enumerate(sorted((x for x in levels if x is not None), key=str)[1:]):
            names.append(f"{c}_is_{n + 1}")
            train, other = (t.withColumn(names[-1], F.coalesce((q(c) == F.lit(v)).cast("double"), F.lit(0.0))) for t in (train, other))
    if ordered:
        ts = ordered_statistics(train, key, ordered, label, prior).withColumnsRenamed({c: f"{c}_rate" for c in ordered})
        for c in ordered:
            per = level_statistics(train, c, label, prior).withColumnsRenamed({"level": "_level", "value": f"{c}_rate"})
            other = other.join(per, q(c).cast("string").eqNullSafe(F.col("_level")), "left").drop("_level").withColumn(
                f"{c}_rate", F.coalesce(F.col(f"{c}_rate"), F.lit(prior)))
            names.append(f"{c}_rate")
        train = train.join(ts, key)
    return train.drop(*columns), other.drop(*columns), names
