"""Tree models as flat node arrays, evaluated on Arrow batches inside a task.

A fitted Spark tree model (one tree, forest, boosted trees) or one of the
library's own boosters becomes a handful of arrays: the feature, threshold and
children of every node, the values of the leaves and the rows each node saw in
training. Perturbed copies of a row are then made, scored and summed up where
the row lies, so explanations need neither exploded copies nor a ``transform``
for each of them.

Rows with a null or NaN feature are left out, as by the assembler.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (DecisionTreeClassificationModel, GBTClassificationModel, LogisticRegressionModel,
                                       RandomForestClassificationModel)
from pyspark.ml.feature import MinMaxScalerModel, StandardScalerModel, VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.columns import q
from riskframe.session import delete_path, ensure_checkpoint_dir

SMALL_TREE = 64  # splits up to which comparing all of them beats walking down
CODED_PATH = 12  # conditions of a leaf up to which their patterns are looked up in a table
TABLED_CUTS = 12  # different cuts up to which a tree is looked up in a table of what holds


class Forest(NamedTuple):
    """Nodes of all trees in one numbering; ``feature`` is -1 at a leaf, ``x <= threshold`` goes left.

    ``values`` holds a column per output: the margin of boosted trees, or the share of each class.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    values: np.ndarray
    cover: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    base: float = 0.0
    slope: float = 1.0  # of the logistic link; 0: the outputs are class shares
    shift: np.ndarray | None = None  # the trees see (x - shift) * factor + add
    factor: np.ndarray | None = None
    add: np.ndarray | None = None

    def columns(self, x: np.ndarray) -> np.ndarray:
        """Rows × features to contiguous features × rows, scaled like the model's own pipeline."""
        return np.ascontiguousarray((x if self.shift is None else (x - self.shift) * self.factor + self.add).T, dtype=float)

    def tree(self, t: int, cols: np.ndarray) -> np.ndarray:
        """Outputs × rows of one tree."""
        end = self.roots[t + 1] if t + 1 < len(self.roots) else len(self.feature)
        if (self.feature[self.roots[t]:end] >= 0).sum() <= SMALL_TREE:
            return np.stack([self._nested(self.roots[t], cols, self.values[:, k]) for k in range(self.values.shape[1])])
        at = np.full(cols.shape[1], self.roots[t])
        every = np.arange(cols.shape[1])
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.values[at].T
            below = cols[np.maximum(f, 0), every] <= self.threshold[at]
            at = np.where(inner, np.where(below, self.left[at], self.right[at]), at)

    def _nested(self, node: int, cols: np.ndarray, value: np.ndarray) -> np.ndarray:
        f = self.feature[node]
        if f < 0:
            return np.broadcast_to(value[node], cols.shape[1:])
        return np.where(cols[f] <= self.threshold[node], self._nested(self.left[node], cols, value),
                        self._nested(self.right[node], cols, value))

    def raw(self, cols: np.ndarray) -> np.ndarray:
        """Weighted sum over trees, outputs × rows."""
        return self.base + sum(w * self.tree(t, cols) for t, w in enumerate(self.weights))

    def link(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(label = 1) and prediction of ``raw`` outputs."""
        if self.slope:
            return 1.0 / (1.0 + np.exp(-self.slope * raw[0])), (raw[0] > 0).astype(np.int32)
        return raw[1] / raw.sum(axis=0), (raw[1] > raw[0]).astype(np.int32)

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.link(self.raw(self.columns(x)))

    def uses(self, t: int) -> set[int]:
        end = self.roots[t + 1] if t + 1 < len(self.roots) else len(self.feature)
        return set(self.feature[self.roots[t]:end].tolist()) - {-1}


class Linear(NamedTuple):
    """A logistic regression on scaled features."""

    coefficients: np.ndarray
    intercept: float
    shift: np.ndarray
    factor: np.ndarray
    add: np.ndarray

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margin = ((x - self.shift) * self.factor + self.add) @ self.coefficients + self.intercept
        return 1.0 / (1.0 + np.exp(-margin)), (margin > 0).astype(np.int32)


def scaling(model: PipelineModel, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(shift, factor, add) of the pipeline's scaler, None without one."""
    out = None
    for s in model.stages[:-1]:
        if isinstance(s, MinMaxScalerModel):
            lo, width = s.originalMin.toArray(), s.originalMax.toArray() - s.originalMin.toArray()
            known = width != 0  # a constant feature lies in the middle of the range
            out = (lo, np.where(known, (s.getMax() - s.getMin()) / np.where(known, width, 1), 0.0),
                   np.where(known, s.getMin(), (s.getMax() + s.getMin()) / 2))
        elif isinstance(s, StandardScalerModel):
            if s.getWithMean():
                raise ValueError("centred scaling has no flat form")
            std = s.std.toArray()
            out = (np.zeros(features), np.where(std != 0, 1 / np.where(std != 0, std, 1), 0.0), np.zeros(features))
        elif not isinstance(s, VectorAssembler):
            raise TypeError(f"no flat form of {type(s).__name__}")
    return out


def scorer(model, spark: SparkSession | None = None):
    """What scores rows inside a task: a ``Forest`` or ``Linear`` of a fitted pipeline, or ``model`` if it is one already."""
    if isinstance(model, Forest | Linear):
        return model
    if is_tree_model(model):
        return flatten(model, spark)
    last = model.stages[-1]
    if not isinstance(last, LogisticRegressionModel):
        raise TypeError(f"no flat form of {type(last).__name__}")
    coef = last.coefficients.toArray()
    none = (np.zeros(len(coef)), np.ones(len(coef)), np.zeros(len(coef)))
    return Linear(coef, float(last.intercept), *(scaling(model, len(coef)) or none))


def _node_rows(spark: SparkSession, model) -> list:
    """The model's nodes as Spark saves them: a table of the model's size."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/nodes-{uuid.uuid4().hex}"  # a save of Spark's own
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
    else:
        nodes = nodes.withColumn("treeID", F.lit(0))
    rows = nodes.orderBy("treeID", "id").collect()
    delete_path(spark, path)
    return rows


def is_tree_model(model) -> bool:
    return isinstance(model, PipelineModel) and isinstance(
        model.stages[-1], (DecisionTreeClassificationModel, GBTClassificationModel, RandomForestClassificationModel, RandomForestRegressionModel))


def flatten(model: PipelineModel, spark: SparkSession | None = None) -> Forest:
    """The flat form of a fitted pipeline of assembler, optional scaler and tree model."""
    last = model.stages[-1]
    if not is_tree_model(model):
        raise TypeError(f"not a tree model: {type(last).__name__}")
    spark = spark or SparkSession.getActiveSession()
    rows = _node_rows(spark, last)
    heads, tree = [], None
    for i, r in enumerate(rows):
        if r["treeID"] != tree:
            heads.append(i)
            tree = r["treeID"]
    start = {rows[h]["treeID"]: h for h in heads}
    feature, threshold = np.full(len(rows), -1), np.zeros(len(rows))
    left, right = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    boosted = isinstance(last, GBTClassificationModel)
    one = boosted or isinstance(last, RandomForestRegressionModel)  # a number a leaf
    values = np.zeros((len(rows), 1 if one else 2))
    for i, r in enumerate(rows):
        if r["leftChild"] >= 0:
            split = r["split"]
            if split["numCategories"] != -1:
                raise ValueError("splits on category sets have no flat form")
            feature[i], threshold[i] = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            left[i], right[i] = start[r["treeID"]] + r["leftChild"], start[r["treeID"]] + r["rightChild"]
        if one:
            values[i, 0] = r["prediction"]
        else:
            stats = np.array(r["impurityStats"], dtype=float)
            values[i, :len(stats)] = stats / max(stats.sum(), 1e-300)
    weights = np.array(last.treeWeights, dtype=float) if boosted else np.ones(len(heads))
    out = Forest(feature, threshold, left, right, values, np.array([float(r["rawCount"]) for r in rows]), np.array(heads), weights,
                 slope=2.0 if boosted else 0.0)
    scaled = scaling(model, last.numFeatures)
    return out._replace(shift=scaled[0], factor=scaled[1], add=scaled[2]) if scaled else out


def complete_rows(b: pa.RecordBatch, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns ``first`` .. ``first + count`` as rows × features, and which rows hold no null or NaN."""
    x = np.column_stack([b.column(first + i).to_numpy(zero_copy_only=False) for i in range(count)]).astype(float)
    return x, ~np.isnan(x).any(axis=1)


def score_rows(forest: Forest | Linear, df: DataFrame, features, keep) -> DataFrame:
    """Columns ``keep``, P(label = 1) as ``score`` and the prediction of every complete row."""
    feats, keep = list(features), list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ok = complete_rows(b, len(keep), len(feats))
            p, hard = forest.score(x[ok])
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok)) for i in range(len(keep))] + [pa.array(p), pa.array(hard)],
                                             names=[*keep, "score", "prediction"])

    own = df.select(*[q(c) for c in keep], *[q(f).cast("double").alias(f"_x{i}") for i, f in enumerate(feats)])
    return own.mapInArrow(run, T.StructType([*own.schema.fields[:len(keep)], T.StructField("score", T.DoubleType()),
                                             T.StructField("prediction", T.IntegerType())]))


# ---------------------------------------------------------------- permutation sums
def permuted_sums(forest: Forest, features: int, repeats: int, by_score: bool):
    """Task body of the permutation importance. Columns: label, the row's features, then the donors' of every repeat.

    Emits (i, repeat, score, n_pos, n_neg) of the shuffled copies, with feature -1 for the rows as they
    are; without ``by_score`` the score is the prediction, so a batch gives two rows a copy.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = [forest.uses(t) for t in range(len(forest.roots))]
        for b in batches:
            label = b.column(0).to_numpy(zero_copy_only=False).astype(float)
            x, ok = complete_rows(b, 1, features * (1 + repeats))
            label, cols = label[ok], forest.columns(x[ok, :features])
            given = [forest.columns(x[ok, (1 + r) * features:(2 + r) * features]) for r in range(repeats)]
            each = [w * forest.tree(t, cols) for t, w in enumerate(forest.weights)]
            raw = forest.base + sum(each)
            out: list[tuple] = []

            def put(i: int, r: int, raw: np.ndarray, label: np.ndarray = label, out: list = out) -> None:
                score, hard = forest.link(raw)
                keys, inv = np.unique(score if by_score else hard.astype(float), return_inverse=True)
                pos = np.bincount(inv, weights=label, minlength=len(keys)).astype(np.int64)
                every = np.bincount(inv, minlength=len(keys))
                out += [(i, r, float(k), int(p), int(n - p)) for k, p, n in zip(keys, pos, every, strict=True)]

            if len(label):
                put(-1, 0, raw)
                for r, donor in enumerate(given):
                    for i in range(features):
                        mine = [t for t, u in enumerate(use) if i in u]
                        if not mine:
                            put(i, r, raw)
                            continue
                        kept, cols[i] = cols[i].copy(), donor[i]
                        put(i, r, forest.base + sum(forest.weights[t] * forest.tree(t, cols) if t in mine else e for t, e in enumerate(each)))
                        cols[i] = kept
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[c] for o in out], k) for c, k in enumerate([pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()])],
                names=["i", "repeat", "score", "n_pos", "n_neg"])
    return run


# ---------------------------------------------------------------- local surrogates
class _Cuts(NamedTuple):
    """A forest of small trees for many points around one row: every cut is compared once, and a tree is a table over its own cuts."""

    cuts: list[tuple[int, float]]  # feature, threshold
    trees: list[tuple[list[int], np.ndarray]]  # a tree's cuts, and its weighted outputs by which of them hold


def _tabled(forest: Forest | Linear) -> _Cuts | None:
    """The tabled form; None where a tree has too many cuts for a table."""
    if isinstance(forest, Linear):
        return None
    cuts: dict[tuple[int, float], int] = {}
    trees = []
    for t, w in enumerate(forest.weights):
        end = forest.roots[t + 1] if t + 1 < len(forest.roots) else len(forest.feature)
        nodes = range(int(forest.roots[t]), int(end))
        own = {n: cuts.setdefault((int(forest.feature[n]), float(forest.threshold[n])), len(cuts)) for n in nodes if forest.feature[n] >= 0}
        used = sorted(set(own.values()))
        if len(used) > TABLED_CUTS:
            return None
        codes = np.arange(1 << len(used))
        at = np.full(len(codes), forest.roots[t])
        place = np.zeros(len(forest.feature), dtype=np.int64)
        for n, c in own.items():
            place[n] = used.index(c)
        while (inner := forest.feature[at] >= 0).any():
            at = np.where(inner, np.where(codes >> place[at] & 1, forest.left[at], forest.right[at]), at)
        trees.append((used, w * forest.values[at].T))
    return _Cuts(list(cuts), trees)


def scores_around(forest: Forest | Linear, tabled: _Cuts | None, x: np.ndarray, z: np.ndarray, sds: np.ndarray) -> np.ndarray:
    """P(label = 1) at the points ``x + z · sds``."""
    if tabled is None:
        return forest.score(x + z * sds)[0]
    cols = {}
    for f in {f for f, _ in tabled.cuts}:
        c = x[f] + z[:, f] * sds[f]
        cols[f] = c if forest.shift is None else (c - forest.shift[f]) * forest.factor[f] + forest.add[f]
    holds = [(cols[f] <= t).view(np.uint8) for f, t in tabled.cuts]
    raw = np.zeros((forest.values.shape[1], len(z)))
    for used, table in tabled.trees:
        code = np.zeros(len(z), dtype=np.uint8 if len(used) <= 8 else np.uint16)
        bit = np.empty_like(code)
        for place, c in enumerate(used):
            code |= np.left_shift(holds[c], place, out=bit, dtype=code.dtype)
        for out, values in zip(raw, table, strict=True):
            out += values.take(code)
    return forest.link(forest.base + raw)[0]


def surrogate_weights(forest: Forest | Linear, sds: np.ndarray, n_samples: int, top: int, alpha: float, width: float, salt: int):
    """Task body of the local surrogate. Columns: key, seed, features; emits (key, i, weight, rank).

    A row's draws come from its own seed: ``n_samples`` points x + sd·N(0,1), the first the row itself.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(sds)
        ridge = alpha * np.diag([1.0] * d + [0.0])
        tabled = _tabled(forest)
        z, zw, gram = np.empty((n_samples, d)), np.empty((n_samples, d + 1)), np.empty((d + 1, d + 1))
        for b in batches:
            x, ok = complete_rows(b, 2, d)
            seeds = b.column(1).to_numpy()
            rows, which, weight, rank = [], [], [], []
            for row in np.flatnonzero(ok):
                np.random.Generator(np.random.SFC64([int(seeds[row]) & (2 ** 64 - 1), salt])).standard_normal(out=z)
                z[0] = 0.0
                y = scores_around(forest, tabled, x[row], z, sds)
                root = np.exp(-0.5 / width ** 2 * np.einsum("ij,ij->i", z, z))  # of the kernel's weight
                np.multiply(z, root[:, None], out=zw[:, :-1])
                zw[:, -1] = root
                np.matmul(zw.T, zw, out=gram)
                coef = np.linalg.solve(gram + ridge, zw.T @ (root * y))[:-1]
                best = np.argsort(-np.abs(coef), kind="stable")[:top]
                rows += [row] * len(best)
                which += best.tolist()
                weight += coef[best].tolist()
                rank += range(1, len(best) + 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(which, pa.int32()),
                                              pa.array(weight, pa.float64()), pa.array(rank, pa.int32())], names=["key", "i", "weight", "rank"])
    return run


# ---------------------------------------------------------------- exact Shapley values
class Leaf(NamedTuple):
    """A leaf by the features on its path: the interval each must lie in and the share of training rows that went that way."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float


def leaves(forest: Forest, output: int) -> list[Leaf]:
    out = []

    def walk(node: int, path: dict[int, tuple[float, float, float]], scale: float) -> None:
        f = int(forest.feature[node])
        if f < 0:
            v = scale * forest.values[node, output]
            out.append(Leaf(np.array(list(path), dtype=np.int64), *(np.array([p[i] for p in path.values()]) for i in range(3)), v))
            return
        lo, hi, share = path.get(f, (-np.inf, np.inf, 1.0))
        t, cover = forest.threshold[node], max(forest.cover[node], 1e-300)
        for child, a, b in ((forest.left[node], lo, min(hi, t)), (forest.right[node], max(lo, t), hi)):
            walk(child, {**path, f: (a, b, share * forest.cover[child] / cover)}, scale)

    for t, root in enumerate(forest.roots):
        walk(int(root), {}, float(forest.weights[t]))
    return out


def path_credits(inside: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values (rows × k) of the game with worth Π over members of ``inside`` times Π over the others of ``share``.

    The coefficient of degree s in Π (share_i + inside_i·y) sums the worth of all coalitions of s; leaving
    out one feature at a time and weighting degrees by s!(k-1-s)!/k! gives its value.
    """
    n, k = inside.shape
    weight = np.empty(k)
    weight[0] = 1.0 / k
    for s in range(1, k):
        weight[s] = weight[s - 1] * s / (k - s)
    out = np.empty((n, k))
    for j in range(k):
        poly = np.zeros((n, k))
        poly[:, 0] = 1.0
        for m, i in enumerate(i for i in range(k) if i != j):
            poly[:, 1:m + 2] = poly[:, 1:m + 2] * share[i] + poly[:, :m + 1] * inside[:, i:i + 1]
            poly[:, 0] *= share[i]
        out[:, j] = (poly @ weight) * (inside[:, j] - share[j])
    return out


def expected_value(forest: Forest, output: int = 0) -> float:
    """Mean output over the training rows, as their numbers in the nodes tell it."""
    return (forest.base if output == 0 else 0.0) + sum(leaf.value * float(np.prod(leaf.share)) for leaf in leaves(forest, output))


def shapley_values(forest: Forest, x: np.ndarray, parts: list[Leaf], memo: dict | None = None) -> np.ndarray:
    """Rows × features of exact Shapley values of the summed leaf outputs.

    A leaf's credits depend on a row only through which of its path's conditions hold: each pattern is
    worked out once (``memo`` keeps them between batches).
    """
    cols = forest.columns(x)
    out = np.zeros(x.shape[::-1])
    memo = {} if memo is None else memo
    for number, leaf in enumerate(parts):
        k = len(leaf.features)
        if not k:
            continue
        z = cols[leaf.features]
        inside = (z > leaf.low[:, None]) & (z <= leaf.high[:, None])
        if k <= CODED_PATH:  # patterns are numbers, and credits a table of them
            inv = inside[0].astype(np.int64)
            for row in inside[1:]:
                inv = 2 * inv + row
            places = np.flatnonzero(np.bincount(inv, minlength=1 << k))
            held = (places[:, None] >> np.arange(k - 1, -1, -1)) & 1
            credit = np.zeros((k, 1 << k))
        else:
            held, inv = np.unique(inside.T, axis=0, return_inverse=True)
            inv = inv.ravel()
            places = np.arange(len(held))
            credit = np.empty((k, len(held)))
        for pattern, place in zip(held.astype(bool), places.tolist(), strict=True):
            key = (number, pattern.tobytes())
            if key not in memo:
                memo[key] = leaf.value * path_credits(pattern[None, :].astype(float), leaf.share)[0]
            credit[:, place] = memo[key]
        for f, c in zip(leaf.features.tolist(), credit, strict=True):
            out[f] += c[inv]
    return np.ascontiguousarray(out.T)


def shapley_rows(forest: Forest, features: int, output: int):
    """Task body. Columns: key, features; emits (key, phi array)."""
    parts = leaves(forest, output)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            x, ok = complete_rows(b, 1, features)
            phi = shapley_values(forest, x[ok], parts, memo)
            at = pa.array(np.arange(len(phi) + 1, dtype=np.int32) * features)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.ListArray.from_arrays(at, pa.array(phi.ravel()))], names=["key", "phi"])
    return run
