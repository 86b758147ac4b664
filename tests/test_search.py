"""The search space and the tree-structured Parzen search."""

import math
import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskframe.operators import search, trials

SPACE = {
    "lr": ("loguniform", 1e-3, 1.0), "leaves": ("quniform", 3, 18, 5), "depth": ("randint", 2, 9), "share": ("uniform", 0.5, 1.0),
    "reg": ("loguniform_q", 0.001, 100.0, 0.0001), "metric": ("choice", ["a", "b", "c"]),
    "boosting": ("choice_of", {"gbdt": {"subsample": ("uniform_step", 0.5, 1.0, 0.05)},
                               "dart": {"subsample": ("uniform_step", 0.5, 1.0, 0.05), "drop": ("uniform", 0.0, 0.5)}, "goss": {}}),
}


def legal(p):
    assert 1e-3 <= p["lr"] <= 1.0 and p["leaves"] in (3, 8, 13, 18) and p["depth"] in range(2, 10) and 0.5 <= p["share"] <= 1.0
    assert 0.001 <= p["reg"] <= 100 and p["reg"] == pytest.approx(round(p["reg"], 4), abs=1e-12) and p["metric"] in "abc"
    assert ("subsample" in p) == (p["boosting"] != "goss") and ("drop" in p) == (p["boosting"] == "dart")
    if "subsample" in p:
        assert any(p["subsample"] == pytest.approx(0.5 + 0.05 * k) for k in range(11))


def loss(p):
    own = {"gbdt": 0.4, "goss": 0.3, "dart": abs(p.get("drop", 0.5) - 0.2)}[p["boosting"]]
    return abs(math.log10(p["lr"]) + 2) / 3 + abs(p["depth"] - 6) / 8 + abs(p["share"] - 0.9) + own + (p["metric"] != "b") * 0.3


@settings(max_examples=200, deadline=None)
@given(st.integers(-20, 20), st.integers(1, 40), st.sampled_from([1, 2, 5, 0.5, 0.25, 0.1, 16]), st.floats(0, 1))
def test_stepped_values_lie_on_the_grid_and_in_range(lo, width, step, x):
    for spec in (("quniform", lo, lo + width, step), ("uniform_step", lo, lo + width, step), ("randint", lo, lo + width)):
        v = search.from_unit(x, spec)
        k = (v - lo) / (1 if spec[0] == "randint" else step)
        assert lo <= v <= lo + width and abs(k - round(k)) < 1e-9
        assert search.from_unit(search.to_unit(v, spec), spec) == v


def test_proposals_can_be_drawn_by_the_sampler(spark):
    drawn = search.sample_space(spark.range(4000), "id", {k: v for k, v in SPACE.items() if k in ("leaves", "depth")})
    for name in ("leaves", "depth"):
        values = {r[0] for r in drawn.select(name).distinct().collect()}
        assert {search.from_unit(i / 999, SPACE[name]) for i in range(1000)} == values


def test_nested_proposals_are_legal():
    log: list[dict] = []
    for r in range(12):
        for p in search.propose(log, SPACE, 5, seed=r):
            legal(p)
            log.append({**p, "loss": loss(p), "iteration": len(log)})
    assert len(log) == 60


def test_search_beats_blind_draws():
    gains = []
    for seed in range(20):
        model = search.run_search(loss, SPACE, 25, 4, seed=1000 * seed, workers=1)
        rng = random.Random(seed)
        blind = min(loss(search.propose([], SPACE, 1, seed=rng.randrange(10 ** 9))[0]) for _ in range(100))
        gains.append(blind - min(t["loss"] for t in model))
    assert statistics.mean(gains) > 2 * statistics.stdev(gains) / math.sqrt(20)  # over all seeds, beyond chance


def test_a_table_and_a_list_give_the_same_proposals(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        p = search.propose([], SPACE, 1, seed=rng.randrange(10 ** 9))[0]
        rows.append({**{k: None for k in ("subsample", "drop")}, **p, "loss": loss(p) if i % 17 else None, "iteration": i})
    kind = ("lr double, leaves int, depth int, share double, reg double, metric string, boosting string, subsample double, drop double, "
            "loss double, iteration int")
    names = [c.split()[0] for c in kind.split(", ")]
    table = spark.createDataFrame([tuple(int(r[n]) if n == "leaves" else r[n] for n in names) for r in rows], kind)
    a, b = search.TrialLog(SPACE, rows), search.TrialLog(SPACE, table)
    assert a.n == b.n and a.split(1.0) == b.split(1.0)
    assert search.propose(a, SPACE, 8, seed=1) == search.propose(b, SPACE, 8, seed=1)


def test_dict_texts_with_quotes(spark):
    texts = ["""{'a': 1, 'b': "it's"}""", """{'a': 2, 'b': 'say "hi"'}""", r"""{'a': 3, 'b': 'it\'s'}""", """{'a': 4, 'b': 'True'}""",
             """{'a': True, 'b': None}""", """{"a": 5, 'b': "x, 'y': 2"}""", "{'a': 6, 'b': 'open", "", None, """{'a': {'c': "d'e"}, 'b': 'TrueFalse None'}""",
             r"""{'a': 7, 'b': 'tab\tq\x41 \\'}""", "{'a': 8, 'b': '" + "long " * 20_000 + "'}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, params string")
    got = {r["i"]: (r["a"], r["b"]) for r in trials.parse_params(df, keys=["a", "b", "a.c"]).select("i", "a", "b", F.col("`a.c`")).collect()}
    assert got[0] == ("1", "it's") and got[1] == ("2", 'say "hi"') and got[2] == ("3", "it's") and got[3] == ("4", "True")
    assert got[4] == ("true", None) and got[5] == ("5", "x, 'y': 2") and got[6] == got[7] == got[8] == (None, None)
    assert got[9][1] == "TrueFalse None" and got[10] == ("7", "tab\tqA \\") and got[11][1] == "long " * 20_000
    nested = trials.parse_params(df.filter("i = 9"), keys=["a.c"]).first()
    assert nested["a.c"] == "d'e"


def test_grid_equals_crossvalidator_and_reuses_converged_fits(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    from riskframe.operators import models, search
    df = spark.createDataFrame([(i, float(i % 17), float(i * 7 % 23), int(i % 17 + i * 5 % 11 > 12), i % 3) for i in range(300)],
                               "loan_id long, a double, b double, label int, fold int")
    fits = []
    own = Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, *a: fits.append(1) or own(self, *a))
    lr = models.logistic()
    _, table = search.cross_validate(df, ["a", "b"], lr, {"regParam": [0.01, 0.1], "maxIter": [3, 200, 400]}, folds=3)
    assert len(fits) == 3 * 2 * 2 + 1  # 400 is 200 as well; 3 steps are too few; the best is fitted on all rows
    pg = ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1]).addGrid(lr.maxIter, [3, 200, 400]).build()
    cv = CrossValidator(estimator=models.pipeline(["a", "b"], lr, "minmax"), estimatorParamMaps=pg, foldCol="fold", numFolds=3,
                        evaluator=BinaryClassificationEvaluator(labelCol="label", numBins=0)).fit(df)
    assert [r["avg_metric"] for r in table.orderBy("combo").collect()] == cv.avgMetrics
