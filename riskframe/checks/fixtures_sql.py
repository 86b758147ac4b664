"""The fixtures of ``riskframe.sources.fixtures`` as DuckDB SQL (CTE text).

Oracle queries are ``WITH <fixtures> SELECT ...`` over the pre-registered
TESTDATA views. The definitions mirror the Spark builders rule by rule.
"""

from __future__ import annotations

from riskframe.functions.rand import duck_b
from riskframe.sources.fixtures import BAD_STATUS, GOOD_STATUS, GRADES, HOME_OWNERSHIP


def _case(idx_sql: str, values) -> str:
    parts = " ".join(f"WHEN {idx_sql} = {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {parts} END"


def B(salt: str, key: str = "o_orderkey") -> str:
    return duck_b(salt, key)


LOANS_BASE = f"""
loans_base AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
         li.n_items, li.avg_disc, c.c_acctbal, c.c_mktsegment,
         CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) - 1 AS g,
         CASE WHEN {B('term')} % 4 = 0 THEN 1 ELSE 0 END AS t60
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, count(*) AS n_items, avg(l_discount) AS avg_disc
             FROM lineitem GROUP BY l_orderkey) li ON o.o_orderkey = li.l_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
)"""

_HOME = "CASE c_mktsegment " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in sorted(HOME_OWNERSHIP.items())) + " END"

LOANS_RAW = f"""
loans_raw_b AS (
  SELECT o_orderkey AS loan_id,
         o_totalprice AS loan_amnt,
         o_totalprice AS funded_amnt,
         o_totalprice / 36.0::DOUBLE + CAST({B('ins')} % 100 AS DOUBLE) / 10.0::DOUBLE AS installment,
         5.0::DOUBLE + 3 * g + CAST({B('rate')} % 200 AS DOUBLE) / 100.0::DOUBLE AS int_rate,
         CASE WHEN {B('inc')} % 100 < 2 THEN NULL ELSE c_acctbal * 10.0::DOUBLE END AS annual_inc,
         CASE WHEN {B('msd')} % 100 < 40 THEN NULL ELSE CAST({B('msv')} % 120 AS DOUBLE) END AS mths_since,
         n_items, avg_disc,
         1 AS policy_code,
         CASE WHEN t60 = 1 THEN ' 60 months' ELSE ' 36 months' END AS term,
         {_case('g', GRADES)} AS grade,
         {_HOME} AS home_ownership,
         CASE WHEN o_orderkey % 2 = 0 THEN 'f' ELSE 'w' END AS initial_list_status,
         CASE WHEN {B('hs')} % 50 = 0 THEN 'Y' ELSE 'N' END AS hardship_flag,
         CASE WHEN {B('tt')} % 2 = 0 THEN '   ' ELSE c_mktsegment END AS title,
         o_orderdate AS issue_d,
         CASE WHEN {B('bad')} % 1000 < 30 + 40 * g + 60 * t60
              THEN {_case(B('st') + ' % 6', BAD_STATUS)}
              ELSE {_case(B('st') + ' % 3', GOOD_STATUS)} END AS loan_status,
         CASE WHEN {B('bad')} % 1000 < 30 + 40 * g + 60 * t60 THEN 1 ELSE 0 END AS bad
  FROM loans_base
),
loans_raw AS (SELECT * EXCLUDE (bad) FROM loans_raw_b)"""

_STATUS_CASE = ("CASE loan_status " + " ".join(f"WHEN '{s}' THEN 0" for s in GOOD_STATUS) + " "
                + " ".join(f"WHEN '{s}' THEN 1" for s in BAD_STATUS) + " END")

# loans_model: P1, P2 (drops mths_since and title), P5, P6, P8, P9, P10.
ONEHOT_SQL = (
    "CAST(term = ' 60 months' AS INTEGER) AS \"term_ 60 months\", "
    + ", ".join(f"CAST(grade = '{g}' AS INTEGER) AS \"grade_{g}\"" for g in GRADES[1:]) + ", "
    + ", ".join(f"CAST(home_ownership = '{h}' AS INTEGER) AS \"home_ownership_{h}\""
                for h in sorted(HOME_OWNERSHIP.values())[1:]))
LOANS_MODEL = f"""
loans_model AS (
  SELECT loan_id, loan_amnt, funded_amnt, installment, int_rate, annual_inc, n_items, avg_disc,
         policy_code,
         CASE initial_list_status WHEN 'f' THEN 0 WHEN 'w' THEN 1 END AS initial_list_status,
         CASE hardship_flag WHEN 'N' THEN 0 WHEN 'Y' THEN 1 END AS hardship_flag,
         {ONEHOT_SQL},
         CAST({_STATUS_CASE} AS INTEGER) AS label
  FROM loans_raw
  WHERE annual_inc IS NOT NULL AND n_items IS NOT NULL AND avg_disc IS NOT NULL
)"""

MODEL_FEATURES = ["loan_amnt", "funded_amnt", "installment", "int_rate", "annual_inc", "n_items",
                  "avg_disc", "policy_code", "initial_list_status", "hardship_flag",
                  "term_ 60 months"] + [f"grade_{g}" for g in GRADES[1:]] + \
                 [f"home_ownership_{h}" for h in sorted(HOME_OWNERSHIP.values())[1:]]


def _score(salt):
    n = f"(30 + 40 * g + 60 * t60 + {B(salt)} % 100)"
    return f"floor(({n} + 2) / 4.0::DOUBLE) / 100.0::DOUBLE"


SCORES = f"""
scores AS (
  SELECT model, split, loan_id, label, score, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS prediction
  FROM (
    SELECT 'm1' AS model, CASE WHEN {B('split')} < 0.8 * 4294967296 THEN 'train' ELSE 'test' END AS split,
           o_orderkey AS loan_id,
           CASE WHEN {B('bad')} % 1000 < 30 + 40 * g + 60 * t60 THEN 1 ELSE 0 END AS label,
           {_score('noise')} AS score
    FROM loans_base
    UNION ALL
    SELECT 'm2', CASE WHEN {B('split')} < 0.8 * 4294967296 THEN 'train' ELSE 'test' END,
           o_orderkey,
           CASE WHEN {B('bad')} % 1000 < 30 + 40 * g + 60 * t60 THEN 1 ELSE 0 END,
           {_score('noise2')}
    FROM loans_base)
)"""


def minority_points(dims: int = 64) -> str:
    xs = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i + 1}" for i in range(dims))
    return f"""
minority_points AS (
  SELECT vec_id, {xs}, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label FROM embeddings
)"""


def rank_matrix(n_vars: int = 40, true_set=(1, 5, 9)) -> str:
    key = "CAST(replication AS VARCHAR) || ':' || CAST(variable AS VARCHAR)"
    ts = ", ".join(str(t) for t in true_set)
    return f"""
rank_matrix AS (
  SELECT replication, variable,
         row_number() OVER (PARTITION BY replication ORDER BY score, variable) AS rank
  FROM (SELECT replication, variable,
               {duck_b('r', key)} % 1000 - CASE WHEN variable IN ({ts}) THEN 600 ELSE 0 END AS score
        FROM (SELECT c_custkey AS replication, unnest(range(1, {n_vars + 1})) AS variable FROM customer))
)"""


def _sample_sql(name, spec, key="iteration", salt=None):
    kind = spec[0]
    h = duck_b(salt or name, key)
    if kind in ("quniform", "uniform_step"):
        # the q-grid from lo: floor((hi - lo) / q) + 1 points
        lo, hi, step = spec[1:]
        return (f"CAST({lo}::DECIMAL(18,6) + ({h} % CAST(floor(({hi}::DECIMAL(18,6) - {lo}::DECIMAL(18,6)) / "
                f"{step}::DECIMAL(18,6) + 1e-9) + 1 AS BIGINT)) * {step}::DECIMAL(18,6) AS DOUBLE)")
    if kind == "randint":
        lo, hi = spec[1:]
        return f"CAST({lo} + {h} % {hi - lo + 1} AS INTEGER)"
    if kind == "loguniform_q":
        import math
        lo, hi, step = spec[1:]
        a, w = math.log(lo), math.log(hi) - math.log(lo)
        return f"round(round(exp({a!r} + ({h} / 4294967296.0) * {w!r}) / {step}::DOUBLE) * {step}::DOUBLE, 4)"
    if kind == "choice":
        return _case(f"{h} % {len(spec[1])}", spec[1])
    raise ValueError(kind)


def trial_params() -> str:
    from riskframe.sources.fixtures import TRIAL_SPACE
    out = {}
    for n, s in TRIAL_SPACE.items():
        if s[0] != "choice_of":
            out[n] = _sample_sql(n, s)
            continue
        out[n] = _case(f"{duck_b(n, 'iteration')} % {len(s[1])}", list(s[1]))
        own: dict[str, list[str]] = {}
        for i, (branch, params) in enumerate(s[1].items()):
            for m, spec in params.items():
                own.setdefault(m, []).append(f"WHEN {duck_b(n, 'iteration')} % {len(s[1])} = {i} "
                                             f"THEN {_sample_sql(m, spec, salt=f'{n}.{branch}.{m}')}")
        out |= {m: f"CASE {' '.join(w)} END" for m, w in own.items()}
    cols = ", ".join(f"{e} AS {n}" for n, e in out.items())
    return f"""
trial_params AS (
  SELECT iteration, ts, {cols}
  FROM (SELECT event_id AS iteration, ts FROM events)
)"""


def trials_c() -> str:
    k = "iteration"
    run = f"{duck_b('run', k)} % 25 = 0"
    dur = f"(1000000 * (5 + {duck_b('dur', k)} % 600) + {duck_b('dus', k)} % 1000000)"
    return trial_params() + f""",
trials_c AS (
  SELECT iteration,
         CASE WHEN {run} THEN NULL ELSE round(0.5 + learning_rate - max_depth / 100.0::DOUBLE
              + subsample / 5.0::DOUBLE + CAST({duck_b('tn', k)} % 1000 AS DOUBLE) / 10000.0::DOUBLE, 4) END AS value,
         ts AS datetime_start,
         CASE WHEN {run} THEN NULL ELSE ts + to_microseconds({dur}) END AS datetime_complete,
         CASE WHEN {run} THEN NULL ELSE
           '0 days 00:' || lpad(CAST(({dur} // 1000000) // 60 AS VARCHAR), 2, '0') || ':'
           || lpad(CAST(({dur} // 1000000) % 60 AS VARCHAR), 2, '0') || '.'
           || lpad(CAST({dur} % 1000000 AS VARCHAR), 6, '0') END AS duration,
         learning_rate, max_depth, n_neighbors, subsample, reg_lambda, boosting_type, metric,
         CASE WHEN {run} THEN 'RUNNING' ELSE 'COMPLETE' END AS state
  FROM trial_params
)"""


def _dec3(x):
    m = f"CAST(round({x} * 1000) AS BIGINT)"
    return f"CAST({m} // 1000 AS VARCHAR) || '.' || lpad(CAST({m} % 1000 AS VARCHAR), 3, '0')"


def trials_a() -> str:
    k = "iteration"
    return trial_params() + f""",
trials_a AS (
  SELECT round(1.0 - (0.6 + learning_rate / 2.0::DOUBLE
               + CAST({duck_b('la', k)} % 1000 AS DOUBLE) / 10000.0::DOUBLE), 6) AS loss,
         '{{''boosting_type'': ''' || boosting_type || ''', ''learning_rate'': ' || {_dec3('learning_rate')}
           || ', ''max_depth'': ' || CAST(max_depth AS VARCHAR)
           || ', ''subsample'': ' || {_dec3('subsample')} || '}}' AS params,
         iteration,
         CAST({duck_b('tt', k)} % 100000 AS DOUBLE) / 1000.0::DOUBLE AS train_time
  FROM trial_params
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


LOANS = (LOANS_BASE, LOANS_RAW)
MODEL = (LOANS_BASE, LOANS_RAW, LOANS_MODEL)
SCORE = (LOANS_BASE, SCORES)
