import hashlib
from collections import Counter, defaultdict

import pytest

from riskframe.checks.compare import compare, duck_connect
from riskframe.llm import mixing as M
from riskframe.llm.oracle import ORACLE_SQL
from riskframe.llm.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck_connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_registered_queries_match_sql(spark, con, name):
    r = compare(QUERIES[name](spark, "/root/testdata/sf0.001"), ORACLE_SQL[name], con)
    assert r["cols_match"] and r["hash_match"] and r["rows_spark"] == r["rows_oracle"], r


def fill(caps, weights, budget):
    """Shares by repeated rounds: fill who is short, share out the rest again."""
    own = dict.fromkeys(caps, None)
    open_ = set(caps)
    while open_:
        left = budget - sum(v for v in own.values() if v is not None)
        total = sum(weights[c] for c in open_)
        short = [c for c in open_ if caps[c] * total <= left * weights[c]]
        if not short:
            for c in open_:
                own[c] = left * weights[c] // total if total else 0
            break
        for c in short:
            own[c] = caps[c]
            open_.discard(c)
    return own


@pytest.mark.parametrize("budget", [0, 10, 57, 100, 140, 1000])
def test_water_fill_matches_rounds(spark, budget):
    caps = {"a": 5, "b": 40, "c": 40, "d": 0, "e": 60}
    weights = {"a": 3, "b": 1, "c": 2, "d": 5, "e": 1}
    df = spark.createDataFrame([("p", k, caps[k], weights[k], budget) for k in caps], "p string, name string, cap long, weight long, budget long")
    got = {r.name: r.own for r in M.water_fill(df, ["p"], "name").select("name", "own").collect()}
    assert got == fill(caps, weights, budget)


def test_shortage_goes_to_siblings_before_ancestors(spark):
    # lang "x" of domain "d" is short: its sibling "y" takes over before the other domain gets more
    leaves = spark.createDataFrame([("d", "x", "s", 10, 1), ("d", "y", "s", 100, 1), ("o", "x", "s", 100, 1)],
                                   "domain string, lang string, source string, tokens long, docs long")
    got = {(r.domain, r.lang): r.budget for r in M.leaf_budgets(leaves, {}, (1, 2), 1).collect()}
    assert got == {("d", "x"): 10, ("d", "y"): 42, ("o", "x"): 52}


def test_prefixes_of_seeded_epochs(spark, small_docs):
    rows = small_docs.selectExpr("doc_id", "lang", "source", "text").collect()
    out = M.mix(small_docs, {"lang": {"en": 5}}, share=(1, 1), max_epochs=2, seed=3).collect()
    leaf = defaultdict(list)
    for r in out:
        leaf[r.domain, r.lang, r.source].append(r)
    tokens = {r.doc_id: len((r.text or "").encode().split()) for r in rows}
    assert all(r.n_tokens == tokens[r.doc_id] for r in out)
    for (_, lang, source), own in leaf.items():
        budget, size = own[0].leaf_budget, own[0].leaf_tokens
        members = [r.doc_id for r in rows if (r.lang, r.source) == (lang, source)]
        assert size == sum(tokens[d] for d in members)
        whole, rest = divmod(budget, size) if size else (0, 0)
        whole = min(whole, 2)
        want = Counter({d: whole for d in members})
        at = 0
        for d in sorted(members, key=lambda d: hashlib.md5(f"3:{whole}:{d}".encode()).hexdigest()):
            at += tokens[d]
            if whole == 2 or at > budget - whole * size:
                break
            want[d] += 1
        assert Counter(r.doc_id for r in own) == +want
        assert sum(r.n_tokens for r in own) <= budget


def test_awkward_rows(awkward, empty):
    out = M.mix(awkward, share=(1, 1), max_epochs=1).collect()
    assert {r.lang for r in out} >= {"(none)", "en"} and len(out) <= awkward.count()
    rows = M.mix_rows(awkward, share=(1, 1), max_epochs=2)
    assert rows.columns == awkward.columns
    assert rows.count() == M.mix(awkward, share=(1, 1), max_epochs=2).count()
    assert M.mix(empty).collect() == []


def test_plan_has_no_python(small_docs):
    plan = M.mix(small_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_rows_without_an_id_spread_over_the_ranges(spark):
    from pyspark.sql import functions as F
    from riskframe.llm.common import row_keys
    df = spark.createDataFrame([(None, f"text number {i}", "en", "s1") for i in range(4000)] + [(1, "one", "en", "s1")],
                               "doc_id long, text string, lang string, source string")
    draws = df.select("doc_id", *row_keys("doc_id", "text")).select(M._draw(7, F.lit(0)).alias("d")).distinct().count()
    assert draws == 4001
    out = M.mix(df, share=(1, 2), max_epochs=1)
    assert out.agg(F.sum("n_tokens")).first()[0] in (5999, 6000) and out.select("__k1").distinct().count() == out.count()
