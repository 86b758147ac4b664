"""Hyperparameter search.

The search space sampler (H4) is a column expression over a table of
trial ids, so proposals for thousands of trials are one projection.
Model fits inside a search are Spark ML jobs; independent fits of one
round run concurrently from a driver thread pool (each is its own set
of Spark jobs over the whole training table).
"""

from __future__ import annotations

import math
import random
import time
from decimal import Decimal
from fractions import Fraction
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.rand import b


def _pick(idx: Column, values) -> Column:
    e = None
    for i, v in enumerate(values):
        e = F.when(idx == i, F.lit(v)) if e is None else e.when(idx == i, F.lit(v))
    return e


def sample_expr(name: str, spec: tuple, key: Column, salt: str | None = None) -> Column:
    """H4: one typed draw. Kinds: quniform/uniform_step (lo, hi, step), randint (lo, hi),
    uniform (lo, hi), loguniform (lo, hi), loguniform_q (lo, hi, step), choice (values)."""
    h = b(salt or name, key)
    kind = spec[0]
    if kind in ("quniform", "uniform_step"):
        lo, hi, step = spec[1:]
        steps = math.floor(Fraction(str(hi - lo)) / Fraction(str(step)) + Fraction(1, 10 ** 9))
        return F.round(F.lit(float(lo)) + (h % (steps + 1)).cast("double") * F.lit(float(step)), _digits(lo, step))
    if kind == "randint":
        lo, hi = spec[1:]
        return (F.lit(lo) + h % (hi - lo + 1)).cast("int")
    if kind == "uniform":
        lo, hi = spec[1:]
        return F.lit(float(lo)) + (h / F.lit(2.0 ** 32)) * F.lit(float(hi - lo))
    if kind in ("loguniform", "loguniform_q"):
        lo, hi = spec[1], spec[2]
        a, w = math.log(lo), math.log(hi) - math.log(lo)
        x = F.exp(F.lit(a) + (h / F.lit(2.0 ** 32)) * F.lit(w))
        if kind == "loguniform":
            return x
        return F.round(F.round(x / F.lit(float(spec[3]))) * F.lit(float(spec[3])), _digits(spec[3]))
    if kind == "choice":
        return _pick(h % len(spec[1]), spec[1])
    raise ValueError(kind)


def sample_space(df: DataFrame, key: str, space: dict, salt_prefix: str = "") -> DataFrame:
    """H4: add one column per parameter, drawn from ``md5(name, trial key)``."""
    k = F.col(key)
    cols = {}
    for n, s in space.items():
        if s[0] != "choice_of":
            cols[n] = sample_expr(n, s, k, salt_prefix + n)
            continue
        # nested choice: the branch, and each branch's own parameters (null outside it)
        branches = list(s[1])
        pick = b(salt_prefix + n, k) % len(branches)
        cols[n] = _pick(pick, branches)
        for i, (name, sub) in enumerate(s[1].items()):
            for m, spec in sub.items():
                drawn = F.when(pick == i, sample_expr(m, spec, k, f"{salt_prefix}{n}.{name}.{m}"))
                cols[m] = F.coalesce(cols[m], drawn) if m in cols else drawn
    return df.withColumns(cols)


def _digits(*numbers) -> int:
    """Decimals that write the numbers exactly."""
    return max(0, *[-Decimal(str(x)).normalize().as_tuple().exponent for x in numbers])


# ---------------------------------------------------------------- objectives
def holdout_metrics(scored: DataFrame) -> dict:
    """H7: AUROC, weighted F1, recall, precision and hard-label ROC of one scored table, which is read once."""
    from riskframe.operators import evaluate as ev
    m = ev.matrix_in_one_pass(scored.withColumn("_g", F.lit(1)), ["_g"]).first()
    counts = ["tp", "tn", "fp", "fn", "total"]
    cm = scored.sparkSession.createDataFrame([(1, *[m[c] for c in counts])], ", ".join(["_g int", *[f"{c} bigint" for c in counts]]))
    row = ev.weighted_f1(cm, ["_g"]).join(ev.hard_label_auc(cm, ["_g"]), "_g").first()
    return {"auroc": m["auc"], "f1_weighted": row["f1_weighted"], "recall": m["recall"],
            "precision": m["precision"], "roc_weighted": row["roc_weighted"]}


def kfold_auc(df: DataFrame, features, make_estimator, folds: int = 3, fold_col: str = "fold",
              scaler: str | None = None, rebalance=None) -> list[float]:
    """H6: AUC of each fold (fit on the other folds); the loss of a trial is 1 - mean.

    ``rebalance`` is applied to the training rows of each fold, after the folds are cut."""
    from riskframe.operators import evaluate as ev
    from riskframe.operators import models
    out = []
    for f in range(folds):
        tr = df.filter(F.col(fold_col) != f)
        te = df.filter(F.col(fold_col) == f)
        tr = (rebalance(tr) if rebalance else tr).persist()
        m = models.fit(tr, features, make_estimator(), scaler=scaler)
        tr.unpersist()
        out.append(ev.auc(models.score(m, te, features)).first()["auc"])
    return out


def staged_auc(model, rows: DataFrame, features) -> list[float]:
    """AUC of a boosted-tree model after each of its rounds, from one pass of scoring.

    The margin after round i is the weighted sum of the first i trees.
    """
    from riskframe.operators import evaluate as ev
    from riskframe.operators import models
    d, _ = models.safe_features(rows, features)
    d = models.PipelineModel(stages=model.stages[:-1]).transform(d)
    last = model.stages[-1]
    margin = F.lit(0.0)
    for i, (tree, w) in enumerate(zip(last.trees, last.treeWeights)):
        tree.setFeaturesCol(last.getFeaturesCol()).setPredictionCol(f"_t{i}")
        d = tree.transform(d)
        margin = margin + F.lit(float(w)) * F.col(f"_t{i}")
        d = d.withColumn(f"_m{i}", margin)
        margin = F.col(f"_m{i}")
    n = len(last.treeWeights)
    long = d.select("label", F.posexplode(F.array(*[F.col(f"_m{i}") for i in range(n)])).alias("round", "score"))
    got = {r["round"]: r["auc"] for r in ev.auc(long, ["round"]).collect()}  # one row a round
    return [got[i] for i in range(n)]


def boosting_rounds(df: DataFrame, features, depth: int, step: float, max_rounds: int = 100, patience: int = 10,
                    folds: int = 3, fold_col: str = "fold") -> list[tuple[int, float, bool, bool]]:
    """H8: mean AUC over folds after every round, stopped ``patience`` rounds after the best.

    Boosting cannot be resumed, so the number of rounds doubles until the stop
    falls inside it: no more than about twice the rounds that are needed.
    """
    from riskframe.operators import models
    parts = [(df.filter(F.col(fold_col) != f).persist(), df.filter(F.col(fold_col) == f).persist()) for f in range(folds)]
    n, stop = min(max_rounds, 2 * patience), None
    while True:
        each = [staged_auc(models.fit(tr, features, models.gbt(n, depth, step), scaler=None), te, features) for tr, te in parts]
        mean = [sum(a) / folds for a in zip(*each)]
        best = 0
        for i, v in enumerate(mean):
            best = i if v > mean[best] else best
            if i - best >= patience:
                stop = i
                break
        if stop is not None or n >= max_rounds:
            break
        n = min(max_rounds, 2 * n)
    for pair in parts:
        for p in pair:
            p.unpersist()
    last = stop if stop is not None else len(mean) - 1
    best = max(range(last + 1), key=lambda i: (mean[i], -i))
    return [(i + 1, float(mean[i]), i == best, stop is not None and i == last) for i in range(last + 1)]


def cross_validate(df: DataFrame, features, estimator, grid: dict, folds: int = 3, fold_col: str = "fold",
                   metric: str = "areaUnderROC", parallelism: int = 8, scaler: str | None = "minmax"):
    """H1 + H2: grid search with k-fold CV (folds from an md5 fold column, R5).

    Returns (best_model, table of (params, avg_metric)). The scaler is a
    pipeline stage, so every fold refits it on its own training rows. A fit that
    converges before a smaller ``maxIter`` of the grid is that combination's fit too.
    """
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
    from pyspark.ml.tuning import ParamGridBuilder
    from riskframe.operators import models
    d, legal = models.safe_features(df, features)
    pipe = models.pipeline(legal, estimator, scaler)
    pg = ParamGridBuilder()
    for name, values in grid.items():
        pg = pg.addGrid(estimator.getParam(name), values)
    maps = pg.build()
    if metric == "areaUnderROC":
        # numBins=0: the exact curve, not a thousand bins of it
        evaluator = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC", numBins=0)
    else:
        evaluator = MulticlassClassificationEvaluator(labelCol="label", metricName=metric)
    # combinations that differ in maxIter only, the largest first
    alike: dict[tuple, list[int]] = {}
    for i, pm in enumerate(maps):
        alike.setdefault(tuple(sorted((p.name, str(v)) for p, v in pm.items() if p.name != "maxIter")), []).append(i)
    cap = [next((v for p, v in pm.items() if p.name == "maxIter"), 0) for pm in maps]
    groups = [sorted(g, key=lambda i: -cap[i]) for g in alike.values()]
    metrics = np.zeros((folds, len(maps)))
    fold = F.col(fold_col).cast("int")
    for f in range(folds):
        train, held = d.filter(fold != f).persist(), d.filter(fold == f).persist()

        def measure(group: list[int], f: int = f, train: DataFrame = train, held: DataFrame = held) -> None:
            steps, value = None, math.nan
            for i in group:
                if steps is None or steps >= cap[i]:
                    model = pipe.fit(train, maps[i])
                    value = evaluator.evaluate(model.transform(held))
                    last = model.stages[-1]
                    steps = last.summary.totalIterations if getattr(last, "hasSummary", False) else math.inf
                metrics[f, i] = value

        with ThreadPoolExecutor(max_workers=parallelism) as ex:
            list(ex.map(measure, groups))
        train.unpersist()
        held.unpersist()
    average = metrics.mean(axis=0)
    best = pipe.fit(d, maps[int(np.argmax(average) if evaluator.isLargerBetter() else np.argmin(average))])
    rows = [({p.name: str(v) for p, v in pm.items()}, float(m)) for pm, m in zip(maps, average, strict=True)]
    spark = df.sparkSession
    table = spark.createDataFrame([(str(sorted(p.items())), m, i) for i, (p, m) in enumerate(rows)],
                                  "params string, avg_metric double, combo int")
    return best, table


# ---------------------------------------------------------------- model-based search (H5)
STEPPED = ("quniform", "uniform_step", "randint")
CELLS = 256  # a parameter's trials are told apart by so many parts of its range
BELOW = 25   # trials that count as good, at most


def _steps(spec: tuple) -> tuple[float, float, int]:
    """(first value, step, number of values) of a stepped kind, as ``sample_expr`` draws them."""
    lo, hi, step = spec[1], spec[2], (spec[3] if len(spec) > 3 else 1)
    return lo, step, math.floor(Fraction(str(hi - lo)) / Fraction(str(step)) + Fraction(1, 10 ** 9)) + 1


def from_unit(x: float, spec: tuple):
    """The value of ``spec`` at place ``x`` in [0, 1): always one that ``sample_expr`` can draw."""
    kind = spec[0]
    x = min(max(x, 0.0), 1.0)
    if kind in STEPPED:
        lo, step, n = _steps(spec)
        v = lo + min(n - 1, int(x * n)) * step
        return int(v) if kind == "randint" else round(v, _digits(lo, step))
    if kind == "uniform":
        return spec[1] + x * (spec[2] - spec[1])
    v = math.exp(math.log(spec[1]) + x * (math.log(spec[2]) - math.log(spec[1])))
    if kind == "loguniform_q":
        step = Fraction(str(spec[3]))
        k = min(max(round(v / float(step)), round(spec[1] / float(step))), round(spec[2] / float(step)))
        return round(float(k * step), _digits(spec[3]))
    return min(max(v, spec[1]), spec[2])


def to_unit(v: float, spec: tuple) -> float:
    """The place of a value in [0, 1]; the middle of its step for stepped kinds."""
    kind = spec[0]
    if kind in STEPPED:
        lo, step, n = _steps(spec)
        return (min(max(round((v - lo) / step), 0), n - 1) + 0.5) / n
    if kind == "uniform":
        return (v - spec[1]) / (spec[2] - spec[1])
    return min(max((math.log(max(v, 1e-300)) - math.log(spec[1])) / (math.log(spec[2]) - math.log(spec[1])), 0.0), 1.0)


def _leaves(space: dict, path: tuple = ()):
    """(path, name, spec) of every parameter; a path lists the (choice, branch) pairs that make it exist."""
    for name, spec in space.items():
        if spec[0] == "choice_of":
            yield path, name, ("choice", list(spec[1]))
            for branch, sub in spec[1].items():
                yield from _leaves(sub, (*path, (name, branch)))
        else:
            yield path, name, spec


def _cell(v, spec: tuple):
    return v if spec[0] == "choice" else min(CELLS - 1, int(to_unit(v, spec) * CELLS))


def _counts(trials: list[dict], space: dict) -> dict:
    """How often each cell of each parameter was tried, over the trials in which it exists."""
    out: dict = {}
    for path, name, spec in _leaves(space):
        per = out.setdefault((path, name), {})
        for t in trials:
            if all(t.get(c) == branch for c, branch in path) and t.get(name) is not None:
                cell = _cell(t[name], spec)
                per[cell] = per.get(cell, 0) + 1
    return out


def _log_counts(log: DataFrame, space: dict) -> dict:
    """``_counts`` of a trial table of any length: one grouped sum a parameter over at most CELLS cells."""
    out = {}
    for path, name, spec in _leaves(space):
        rows = log
        for c, branch in path:
            rows = rows.filter(F.col(c) == F.lit(branch))
        v = F.col(name)
        if spec[0] == "choice":
            cell = v
        else:
            if spec[0] in STEPPED:
                lo, step, n = _steps(spec)
                place = (F.greatest(F.least(F.round((v - F.lit(lo)) / F.lit(step)), F.lit(n - 1)), F.lit(0)) + F.lit(0.5)) / F.lit(float(n))
            elif spec[0] == "uniform":
                place = (v - F.lit(spec[1])) / F.lit(spec[2] - spec[1])
            else:
                width = math.log(spec[2]) - math.log(spec[1])
                place = F.greatest(F.least((F.log(v) - F.lit(math.log(spec[1]))) / F.lit(width), F.lit(1.0)), F.lit(0.0))
            cell = F.least(F.floor(place * CELLS), F.lit(CELLS - 1)).cast("int")
        out[(path, name)] = {r["cell"]: r["n"] for r in rows.filter(v.isNotNull()).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return out


class Mixture:
    """Density of one numeric parameter on [0, 1]: a flat prior and a bell at every tried cell, as wide as its distance to the next."""

    def __init__(self, cells: dict) -> None:
        at = sorted(cells)
        centre = [(c + 0.5) / CELLS for c in at]
        total = sum(cells.values())
        least = 1.0 / min(100.0, 1.0 + total)
        self.bells = []
        for i, m in enumerate(centre):
            left = m - (centre[i - 1] if i else 0.0)
            right = (centre[i + 1] if i + 1 < len(centre) else 1.0) - m
            self.bells.append((m, min(1.0, max(left, right, least)), cells[at[i]]))
        self.total = total + 1.0

    @staticmethod
    def _mass(m: float, s: float) -> float:
        return 0.5 * (math.erf((1 - m) / (s * math.sqrt(2))) - math.erf(-m / (s * math.sqrt(2))))

    def density(self, x: float) -> float:
        bells = sum(n * math.exp(-0.5 * ((x - m) / s) ** 2) / (s * math.sqrt(2 * math.pi) * self._mass(m, s)) for m, s, n in self.bells)
        return (1.0 + bells) / self.total

    def draw(self, rng: random.Random) -> float:
        pick = rng.random() * self.total
        for m, s, n in self.bells:
            pick -= n
            if pick < 0:
                while True:
                    x = rng.gauss(m, s)
                    if 0 <= x < 1:
                        return x
        return rng.random()


class TrialLog:
    """What a search has seen: the best trials as rows, all others as counts. Starts from a table of any length or a list."""

    def __init__(self, space: dict, history: list[dict] | DataFrame | None = None) -> None:
        self.space = space
        self.best: list[dict] = []
        self.n = 0
        self.counts: dict = {(p, name): {} for p, name, _ in _leaves(space)}
        if isinstance(history, DataFrame):
            done = history.filter(F.col("loss").isNotNull())
            self.n = done.count()
            self.counts = _log_counts(done, space)
            self.best = [r.asDict() for r in done.orderBy("loss", *(["iteration"] if "iteration" in done.columns else [])).limit(BELOW).collect()]
        else:
            self.add(history or [])

    def add(self, trials: list[dict]) -> None:
        done = [t for t in trials if t.get("loss") is not None]
        for key, cells in _counts(done, self.space).items():
            for c, n in cells.items():
                self.counts[key][c] = self.counts[key].get(c, 0) + n
        self.n += len(done)
        self.best = sorted([*self.best, *done], key=lambda t: (t["loss"], t.get("iteration", 0)))[:BELOW]

    def split(self, gamma: float) -> tuple[dict, dict]:
        """Counts of the good trials and of the others."""
        good = _counts(self.best[:min(BELOW, max(1, math.ceil(gamma * math.sqrt(self.n))))], self.space)
        rest = {k: {c: n - good[k].get(c, 0) for c, n in cells.items() if n > good[k].get(c, 0)} for k, cells in self.counts.items()}
        return good, rest


def propose(trials: list[dict] | TrialLog, space: dict, n: int, seed: int, gamma: float = 1.0, candidates: int = 24, start: int = 12) -> list[dict]:
    """H5: next ``n`` proposals of a tree-structured Parzen search.

    Good trials (the ``gamma``·√n best) and all others give each parameter two densities; of
    ``candidates`` draws from the good one, that of the highest ratio is proposed. A nested choice is
    settled first and then the parameters of its branch, from the trials that took it. Before ``start``
    finished trials proposals are blind draws.
    """
    log = trials if isinstance(trials, TrialLog) else TrialLog(space, trials)
    rng = random.Random(seed)
    good, rest = log.split(gamma)
    blind = log.n < start

    def one(sub: dict, path: tuple, out: dict) -> dict:
        for name, spec in sub.items():
            values = list(spec[1]) if spec[0] in ("choice", "choice_of") else None
            if blind:
                out[name] = rng.choice(values) if values else from_unit(rng.random(), spec)
            elif values:
                a, b = good[(path, name)], rest[(path, name)]
                weight = [a.get(v, 0) + 1 for v in values]  # one trial of each value stands for the prior
                ratio = [w / (b.get(v, 0) + 1) for w, v in zip(weight, values)]
                drawn = rng.choices(range(len(values)), weights=weight, k=max(1, candidates // 4))
                out[name] = values[max(drawn, key=lambda i: ratio[i])]
            else:
                a, b = Mixture(good[(path, name)]), Mixture(rest[(path, name)])
                out[name] = from_unit(max((a.draw(rng) for _ in range(candidates)), key=lambda x: a.density(x) / b.density(x)), spec)
            if spec[0] == "choice_of":
                one(spec[1][out[name]], (*path, (name, out[name])), out)
        return out

    found: list[dict] = []
    for _ in range(20 * n):
        p = one(space, (), {})
        if p not in found:
            found.append(p)
        if len(found) == n:
            break
    return found


def run_search(objective, space: dict, rounds: int, per_round: int, seed: int = 42,
               start_iteration: int = 0, history: list[dict] | DataFrame | None = None, workers: int = 4) -> list[dict]:
    """H5 + H9 + H12: rounds of proposals; the fits of one round run concurrently
    (each is its own set of Spark jobs). ``history`` (rows or a trial table) resumes a study.
    Returns the history's rows, if it came as rows, and the new trials."""
    trials = list(history or []) if not isinstance(history, DataFrame) else []
    log = TrialLog(space, history)
    it = start_iteration
    for r in range(rounds):
        props = propose(log, space, per_round, seed + r)

        def run_one(args):
            i, p = args
            t0 = time.time()
            loss = objective(p)
            t1 = time.time()
            return {"iteration": i, "round": r, **p, "loss": loss, "start_s": t0, "end_s": t1,
                    "train_time": t1 - t0}

        with ThreadPoolExecutor(max_workers=workers) as ex:
            res = list(ex.map(run_one, [(it + j, p) for j, p in enumerate(props)]))
        it += len(props)
        trials.extend(res)
        log.add(res)
    return trials
