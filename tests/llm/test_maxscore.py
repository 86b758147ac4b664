import numpy as np
import pytest

from riskframe.llm import maxscore as M

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20, every=20):
    """rows: (vec_id, vector); identical ids are separate rows."""
    out = []
    for qi, (q, v) in enumerate(rows):
        if q % every:
            continue
        scored = [(-int(np.dot(v, w)), i) for j, (i, w) in enumerate(rows) if j != qi]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def quantised(rows):
    return [(i, np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(object)) for i, v in rows]


@pytest.mark.parametrize(("scale", "shard_rows", "query_rows"), [(1.0, 8192, 2048), (0.05, 100, 7)])
def test_matches_brute_force(spark, scale, shard_rows, query_rows):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(0, scale, 16)).tolist()) for i in range(600)]  # small scale: many ties
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], KIND).repartition(5)
    out = M.top_k(df, shard_rows=shard_rows, query_rows=query_rows).collect()
    assert sorted(tuple(r) for r in out) == brute(quantised(rows))


def test_pruning_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.integers(-9, 9, (500, 12))
    full = M.Shard(v, np.arange(500), np.arange(500), np.float64)
    for block in (16, 4096):
        monkeypatch.setattr(M, "BLOCK", block)
        for q in range(0, 500, 50):
            scores, at = full.search(v[q].astype(float), q, 20)
            want = sorted(((-int(v[q] @ v[j]), j) for j in range(500) if j != q))[:20]
            assert sorted(zip((-scores).astype(int).tolist(), at.tolist(), strict=True)) == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.5, 0.1]), (20, [0.5, -0.5, 0.1]), (20, [0.5, -0.5, 0.1]), (3, [1.0]), (4, []), (5, [0.0, 0.0, 0.0]), (40, [0.0, 0.0, 0.0])]
    bad = [(60, None), (80, [0.1, None, 0.2]), (100, [nan, 0.0, 0.0]), (120, [inf, 0.0, 0.0]), (None, [0.1, 0.1, 0.1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + bad], KIND).selectExpr("*", "1 as uid", "2 as v", "3 as shard", "4 as score")
    padded = [(i, [*v, *[0.0] * (3 - len(v))]) for i, v in rows]
    assert sorted(tuple(r) for r in M.top_k(df).collect()) == brute(quantised(padded))
    assert M.top_k(df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [1e6, 7e6])
def test_large_components_stay_exact(spark, size):
    rows = [(i, [float(size * 1.1 * (i % 7 - 3)), float(size * (i % 5)), 1.0]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], KIND)
    assert sorted(tuple(r) for r in M.top_k(df).collect()) == brute(quantised(rows))
