"""DuckDB oracle SQL for the registered queries (same parquet views).

Written independently of the Spark plans: plain SQL with window
functions, ``quantile_cont`` and joins, as one would check the results
by hand. Doubles are rounded to 6 dp (``+ 0.0`` folds -0.0).
"""

from __future__ import annotations

from riskframe.checks import fixtures_sql as fs
from riskframe.checks.fixtures_sql import MODEL_FEATURES, duck_b
from riskframe.functions.rand import duck_b60
from riskframe.functions.columns import legal_names, ml_names

CONT = ["loan_amnt", "funded_amnt", "installment", "int_rate", "annual_inc", "n_items", "avg_disc"]
RAW_TYPES = [("loan_id", "bigint"), ("loan_amnt", "double"), ("funded_amnt", "double"),
             ("installment", "double"), ("int_rate", "double"), ("annual_inc", "double"),
             ("mths_since", "double"), ("n_items", "bigint"), ("avg_disc", "double"),
             ("policy_code", "int"), ("term", "string"), ("grade", "string"),
             ("home_ownership", "string"), ("initial_list_status", "string"),
             ("hardship_flag", "string"), ("title", "string"), ("issue_d", "timestamp_ntz"),
             ("loan_status", "string")]
MODEL_TYPES = ([("loan_id", "bigint")] + [(c, "double") for c in CONT[:5]] + [("n_items", "bigint"),
               ("avg_disc", "double"), ("policy_code", "int"), ("term_ 60 months", "int")]
               + [(f"grade_{g}", "int") for g in "BCDE"]
               + [(f"home_ownership_{h}", "int") for h in ("NONE", "OTHER", "OWN", "RENT")]
               + [("initial_list_status", "int"), ("hardship_flag", "int"), ("label", "int")])
STRING_RAW = ["term", "grade", "home_ownership", "initial_list_status", "hardship_flag", "title",
              "loan_status"]
TRIAL_PARAMS = ["learning_rate", "max_depth", "n_neighbors", "subsample", "reg_lambda"]
KEYS = "model, split"


def qi(c: str) -> str:
    return '"' + c.replace('"', '""') + '"'


def R(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0::DOUBLE)"


def rnd(sql: str, cols) -> str:
    """Round the named double columns of a query."""
    if not cols:
        return sql
    rep = ", ".join(f"{R(qi(c))} AS {qi(c)}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _r"


W_RAW = fs.with_(*fs.LOANS[:-1], fs.LOANS_RAW)
W_MODEL = fs.with_(*fs.MODEL)
W_SCORE = fs.with_(*fs.SCORE)
BLANK = ", ".join(
    f"CASE WHEN regexp_full_match({c}, '\\s*') THEN NULL ELSE {c} END AS {c}" for c in STRING_RAW)
RAW_P1 = f"SELECT * REPLACE ({BLANK}) FROM loans_raw"
MODEL_DOUBLES = [c for c, t in MODEL_TYPES if t == "double"]
RAW_DOUBLES = [c for c, t in RAW_TYPES if t == "double"]
FEATS = [c for c, _ in MODEL_TYPES if c not in ("loan_id", "label")]


def long_sql(src: str, ids, cols, name="feature", value="value", cast="DOUBLE") -> str:
    idl = "".join(f"{i}, " for i in ids)
    return " UNION ALL ".join(
        f"SELECT {idl}'{c}' AS {name}, CAST({qi(c)} AS {cast}) AS {value} FROM {src} WHERE {qi(c)} IS NOT NULL"
        for c in cols)


def binned_density(long: str, keys: str) -> str:
    """Kernel density over 4,096 linearly weighted cells a group at 64 even points, and the bound of its error."""
    edge = "_lo + (_hi - _lo) * {e} / 4096.0::DOUBLE"
    point = "_lo + (_hi - _lo) * (i / 63.0::DOUBLE)"
    bell = f"exp(-0.5 * pow((({point}) - ({edge})) / _h, 2))"
    return f"""SELECT {keys}, CAST(i AS INTEGER) AS grid_i, {point} AS x,
        sum(w0 * {bell.format(e='k')} + w1 * {bell.format(e='(k + 1)')}) / (_n * _h * sqrt(2 * pi())) AS density,
        pow((_hi - _lo) / 4096, 2) / (8 * pow(_h, 3) * sqrt(2 * pi())) AS bound
      FROM (SELECT {keys}, _n, _h, _lo, _hi, k, sum(1 - (a - k)) AS w0, sum(a - k) AS w1
            FROM (SELECT *, least(floor(a), 4095) AS k FROM (
              SELECT *, (value - _lo) / (_hi - _lo) * 4096.0::DOUBLE AS a FROM ({long}) JOIN (
                SELECT {keys}, count(*) AS _n, min(value) AS _lo, max(value) AS _hi, stddev_samp(value) * pow(count(*), -0.2) AS _h
                FROM ({long}) GROUP BY {keys} HAVING stddev_samp(value) > 0) USING ({keys})))
            GROUP BY {keys}, _n, _h, _lo, _hi, k), range(64) AS g(i) GROUP BY {keys}, i, _lo, _hi, _n, _h"""


def _p():
    out = {}
    out["P1"] = W_RAW + f"SELECT loan_id, {', '.join(STRING_RAW)} FROM ({RAW_P1})"
    keep = [c for c, _ in RAW_TYPES if c not in ("mths_since", "title")]
    out["P2"] = rnd(W_RAW + f"SELECT {', '.join(keep)} FROM ({RAW_P1})", [c for c in RAW_DOUBLES if c in keep])
    shares = " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS share "
        f"FROM ({RAW_P1})" for i, (c, _) in enumerate(RAW_TYPES))
    out["P3"] = W_RAW + (f"SELECT CAST(position AS INTEGER) AS position, column_name, "
                         f"CAST(count(*) OVER () AS BIGINT) AS n_dropped FROM ({shares}) WHERE share >= 0.05")
    nums = [c for c, t in RAW_TYPES if t in ("bigint", "double", "int")]
    out["P4"] = rnd(W_RAW + f"SELECT {', '.join(nums)} FROM loans_raw", [c for c in RAW_DOUBLES])
    out["P5"] = rnd(W_RAW + "SELECT * EXCLUDE (issue_d, title) FROM loans_raw", RAW_DOUBLES)
    out["P6"] = rnd(W_RAW + f"SELECT loan_id, {', '.join(CONT)} FROM loans_raw "
                            "WHERE annual_inc IS NOT NULL AND n_items IS NOT NULL AND avg_disc IS NOT NULL",
                    [c for c in CONT if c != "n_items"])
    anynull = " OR ".join(f"{c} IS NULL" for c, _ in RAW_TYPES)
    out["P7"] = W_RAW + (f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE {anynull}) AS n_incomplete, "
                         f"count(*) - count(*) FILTER (WHERE {anynull}) AS n_complete FROM ({RAW_P1})")
    out["P8"] = W_RAW + f"SELECT loan_id, CAST({fs._STATUS_CASE} AS INTEGER) AS label FROM loans_raw"
    out["P8_unmatched"] = W_RAW + ("SELECT loan_status AS value, count(*) AS n FROM loans_raw WHERE loan_status IN "
                                   "('Does not meet the credit policy. Status:Charged Off', 'Default') GROUP BY loan_status")
    out["P9"] = W_RAW + ("SELECT loan_id, CASE initial_list_status WHEN 'f' THEN 0 WHEN 'w' THEN 1 END "
                         "AS initial_list_status, CASE hardship_flag WHEN 'N' THEN 0 WHEN 'Y' THEN 1 END "
                         "AS hardship_flag FROM loans_raw")
    out["P10"] = W_RAW + f"SELECT loan_id, {fs.ONEHOT_SQL} FROM loans_raw"
    homes = sorted(fs.HOME_OWNERSHIP.values())
    out["P11"] = W_RAW + "SELECT loan_id, " + ", ".join(
        f"CAST(home_ownership = '{h}' AS INTEGER) AS {qi('home_ownership_' + h)}" for h in homes) + " FROM loans_raw"
    out["P12"] = W_RAW + "SELECT DISTINCT grade, term, home_ownership, hardship_flag FROM loans_raw"
    out["P13"] = rnd(W_RAW + f"SELECT loan_id, loan_amnt FROM loans_raw ORDER BY {duck_b('sample', 'loan_id')}, "
                             "loan_id LIMIT 500", ["loan_amnt"])
    out["P14"] = rnd(W_MODEL + f"SELECT loan_id, {', '.join(CONT)}, label FROM loans_model",
                     [c for c in CONT if c != "n_items"])
    out["P15"] = W_MODEL + ("SELECT loan_id, label, 'zero' AS part FROM loans_model WHERE label = 0 "
                            "UNION ALL SELECT loan_id, label, 'one' FROM loans_model WHERE label = 1")
    out["P16"] = W_MODEL + "SELECT loan_id, label FROM loans_model WHERE label = 1"
    cols = [c for c, _ in MODEL_TYPES]
    legal = legal_names(cols)
    out["P17"] = rnd(W_MODEL + "SELECT " + ", ".join(f"{qi(a)} AS {qi(b)}" for a, b in zip(cols, legal))
                     + " FROM loans_model", [b for (a, t), b in zip(MODEL_TYPES, legal) if t == "double"])
    out["P18"] = rnd(W_MODEL + "SELECT label, * EXCLUDE (label) FROM loans_model", MODEL_DOUBLES)
    out["P19"] = rnd(W_RAW + f"SELECT loan_id, {', '.join(CONT)} FROM loans_raw ORDER BY loan_id LIMIT 5",
                     [c for c in CONT if c != "n_items"])
    out["P20"] = W_RAW + (f"SELECT loan_id, CAST(row_number() OVER (ORDER BY {duck_b('perm', 'loan_id')}, loan_id) - 1 "
                          "AS BIGINT) AS pos FROM loans_raw")
    out["P21"] = rnd(W_SCORE + "SELECT model, split, loan_id, label, score, "
                               "CASE WHEN round(score, 2) > 0.5 THEN 1 ELSE 0 END AS prediction FROM scores",
                     ["score"])
    out["P22"] = rnd(fs.with_(fs.trials_c()) + "SELECT iteration AS number, value AS f1_weighted, "
                                                "datetime_start AS start, state FROM trials_c", ["f1_weighted"])
    return out


def _quantile_cols(val, probs, names):
    return ", ".join(f"quantile_cont({val}, {p}) AS {n}" for p, n in zip(probs, names))


def _a():
    out = {}
    q = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, "
        f"round(100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / count(*), 1) + 0.0::DOUBLE AS pct_missing, "
        f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique FROM loans_p1" for c, t in RAW_TYPES)
    out["A1"] = W_RAW.rstrip() + ", loans_p1 AS (" + RAW_P1 + ")\n" + q
    out["A2"] = rnd(W_RAW + "SELECT loan_status AS value, count(*) AS n, "
                            "round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct "
                            "FROM loans_raw GROUP BY loan_status", ["pct"])
    out["A3"] = W_RAW + f"SELECT count(*) AS n_rows, CAST({len(RAW_TYPES)} AS INTEGER) AS n_cols FROM loans_raw"
    lg = long_sql("loans_model", [], FEATS)
    out["A4"] = rnd(W_MODEL + f"SELECT feature, min(value) AS min, "
                              f"{_quantile_cols('value', [0.25, 0.5, 0.75], ['q1', 'median', 'q3'])}, "
                              f"avg(value) AS mean, max(value) AS max, CAST(0 AS BIGINT) AS n_na "
                              f"FROM ({lg}) GROUP BY feature",
                    ["min", "q1", "median", "mean", "q3", "max"])
    for key, by in (("A5", None), ("A6", "label")):
        ids = [by] if by else []
        lgc = long_sql("loans_model", ids, CONT)
        byc = f"{by}, " if by else ""
        out[key] = rnd(W_MODEL + f"""SELECT feature, {byc}bin, _lo + bin * ((_hi - _lo) / 10.0::DOUBLE) AS bin_lo,
              _lo + (bin + 1) * ((_hi - _lo) / 10.0::DOUBLE) AS bin_hi, count(*) AS n
            FROM (SELECT l.*, r._lo, r._hi,
                   CAST(CASE WHEN r._hi = r._lo THEN 0
                        ELSE least(floor((l.value - r._lo) / (r._hi - r._lo) * 10.0::DOUBLE), 9) END AS INTEGER) AS bin
                  FROM ({lgc}) l JOIN (SELECT feature, min(value) AS _lo, max(value) AS _hi FROM ({lgc})
                                       GROUP BY feature) r USING (feature))
            GROUP BY feature, {byc}bin, _lo, _hi""", ["bin_lo", "bin_hi"])
    def density(c):
        return f"""SELECT '{c}' AS feature, label, i AS grid_i, _lo + (_hi - _lo) * (i / 63.0::DOUBLE) AS x,
              sum(exp(-0.5 * pow(((_lo + (_hi - _lo) * (i / 63.0::DOUBLE)) - x) / _h, 2)))
                / (_n * _h * sqrt(2 * pi())) AS density
            FROM (SELECT m.label, m.{c}::DOUBLE AS x, s._n, s._lo, s._hi, s._sd * pow(s._n, -0.2) AS _h
                  FROM loans_model m JOIN (SELECT label, count({c}) AS _n, stddev_samp({c}) AS _sd,
                                                  min({c})::DOUBLE AS _lo, max({c})::DOUBLE AS _hi
                                           FROM loans_model GROUP BY label) s USING (label)) d,
                 range(64) AS g(i)
            GROUP BY label, i, _lo, _hi, _n, _h"""
    out["A7"] = rnd(W_MODEL + " UNION ALL ".join(map(density, CONT)), ["x", "density"])
    lgl = long_sql("loans_model", ["label"], CONT)
    out["A7_binned"] = rnd(W_MODEL + binned_density(lgl, "feature, label"), ["x", "density", "bound"])
    out["A8"] = rnd(W_MODEL + f"""SELECT l.feature, l.label, q.q1, q.median, q.q3,
              min(CASE WHEN l.value BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) THEN l.value END) AS whisker_lo,
              max(CASE WHEN l.value BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) THEN l.value END) AS whisker_hi,
              count(*) FILTER (WHERE NOT (l.value BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1))) AS n_outliers
            FROM ({lgl}) l JOIN (SELECT feature, label, {_quantile_cols('value', [0.25, 0.5, 0.75], ['q1', 'median', 'q3'])}
                                  FROM ({lgl}) GROUP BY feature, label) q USING (feature, label)
            GROUP BY l.feature, l.label, q.q1, q.median, q.q3""",
                    ["q1", "median", "q3", "whisker_lo", "whisker_hi"])
    onehot = [c for c in FEATS if "_" in c and c not in CONT and c != "policy_code"]
    out["A9"] = W_MODEL + ("SELECT feature, value, count(*) AS n FROM ("
                           + long_sql("loans_model", [], onehot, cast="INTEGER") + ") GROUP BY feature, value")
    qtab = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, "
        f"round(100.0::DOUBLE * count(*) FILTER (WHERE {qi(c)} IS NULL) / count(*), 1) AS pct_missing, "
        f"CAST(count(DISTINCT {qi(c)}) AS BIGINT) AS n_unique FROM loans_model"
        for c, t in MODEL_TYPES if c not in ("loan_id", "label"))
    out["A10"] = rnd(W_MODEL + f"""SELECT a.*, s.min, s.q1, s.median, s.mean, s.q3, s.max, s.n_na FROM ({qtab}) a
            LEFT JOIN (SELECT feature AS column_name, min(value) AS min,
                         {_quantile_cols('value', [0.25, 0.5, 0.75], ['q1', 'median', 'q3'])},
                         avg(value) AS mean, max(value) AS max, CAST(0 AS BIGINT) AS n_na
                       FROM ({lg}) GROUP BY feature) s USING (column_name)""",
                     ["pct_missing", "min", "q1", "median", "mean", "q3", "max"])
    out["A12"] = rnd(W_MODEL + "SELECT * EXCLUDE (policy_code) FROM loans_model", MODEL_DOUBLES)
    lv = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS level FROM loans_raw"
                            for c in ["term", "grade", "home_ownership", "loan_status"])
    out["A13"] = W_RAW + f"""SELECT feature, level, n,
              CAST(row_number() OVER (PARTITION BY feature ORDER BY n DESC, level) AS BIGINT) AS rank
            FROM (SELECT feature, level, count(*) AS n FROM ({lv}) WHERE level IS NOT NULL GROUP BY feature, level)"""
    rep = " UNION ALL ".join(
        [f"SELECT 'loans_raw' AS dataset, '{c}' AS column_name, '{t}' AS data_type, count({qi(c)}) AS n_non_null "
         f"FROM loans_raw" for c, t in RAW_TYPES]
        + [f"SELECT 'loans_model', '{c}', '{t}', count({qi(c)}) FROM loans_model" for c, t in MODEL_TYPES])
    out["A14"] = W_MODEL + rep
    model_types = dict(MODEL_TYPES)
    gone = [c for c, t in RAW_TYPES if model_types.get(c) != t]
    out["A14_diff"] = W_RAW + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type FROM (SELECT count(*) FROM loans_raw)" for c, t in RAW_TYPES if c in gone)
    lev = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS level FROM loans_raw" for c in STRING_RAW)
    out["A4_levels"] = W_RAW + f"SELECT feature, level, count(*) AS n FROM ({lev}) GROUP BY feature, level"
    out["A10_full"] = _full_profile()
    return out


def _full_profile():
    """Per column of the raw loans (blank texts null): the items, each from its definition."""
    nums = [c for c, t in RAW_TYPES if t in ("bigint", "double", "int") and c != "loan_id"]
    texts = [c for c, t in RAW_TYPES if t == "string"]
    src = "p1"
    head = W_RAW.rstrip() + ", p1 AS (" + RAW_P1 + ")"
    parts = []
    for c in [*nums, *texts]:
        parts.append(f"SELECT '{c}', 'pct_missing', NULL, round(100.0::DOUBLE * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END), 1) FROM {src}")
        parts.append(f"SELECT '{c}', 'n_unique', NULL, count(DISTINCT {c})::DOUBLE FROM {src}")
    for c in nums:
        for item, e in (("min", f"min({c})"), ("q1", f"quantile_cont({c}::DOUBLE, 0.25)"), ("median", f"median({c}::DOUBLE)"), ("mean", f"avg({c})"),
                        ("q3", f"quantile_cont({c}::DOUBLE, 0.75)"), ("max", f"max({c})"), ("n_na", f"count(*) - count({c})")):
            parts.append(f"SELECT '{c}', '{item}', NULL, ({e})::DOUBLE FROM {src}")
    for c in texts:
        parts.append(f"SELECT '{c}', 'top', {c}, n::DOUBLE FROM (SELECT {c}, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} "
                     f"ORDER BY n DESC, {c} LIMIT 5)")
    # a column's ranks are among its own values; a pair's correlation is over the rows that have both
    ranked = ", ".join(f"CASE WHEN {c} IS NULL THEN NULL ELSE rank() OVER (ORDER BY {c}) "
                       f"+ (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 END AS r_{c}" for c in nums)
    for i, a in enumerate(nums):
        for b in nums[i + 1:]:
            parts.append(f"SELECT '{a}', 'spearman', '{b}', CASE WHEN isnan(corr(r_{a}, r_{b})) THEN NULL ELSE corr(r_{a}, r_{b}) END FROM rk")
    body = " UNION ALL ".join(parts)
    return rnd(head + f", rk AS (SELECT {ranked} FROM p1) SELECT * FROM ({body}) t(column_name, item, label, value)", ["value"])


def _ranks_sql():
    lg = " UNION ALL ".join(
        f"SELECT loan_id, {i} AS fi, '{c}' AS feature, CAST({qi(c)} AS DOUBLE) AS value FROM loans_model"
        for i, c in enumerate(FEATS))
    return (f"ranks AS (SELECT loan_id, fi, feature, rank() OVER (PARTITION BY feature ORDER BY value) "
            f"+ (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM ({lg})), "
            "rho AS (SELECT a.feature AS feature_a, b.feature AS feature_b, "
            "CASE WHEN isnan(corr(a.r, b.r)) THEN NULL ELSE corr(a.r, b.r) END AS rho "
            "FROM ranks a JOIN ranks b ON a.loan_id = b.loan_id AND a.fi < b.fi GROUP BY a.feature, b.feature) ")


def _c():
    base = W_MODEL.rstrip() + ", " + _ranks_sql()
    return {
        "C1": rnd(base + "SELECT * FROM rho", ["rho"]),
        "C2": rnd(base + "SELECT feature_a, feature_b, rho, abs(rho) AS abs_rho FROM rho WHERE rho IS NOT NULL "
                         "ORDER BY abs(rho) DESC, feature_a, feature_b LIMIT 10", ["rho", "abs_rho"]),
        "C3": rnd(base + "SELECT * FROM rho WHERE abs(rho) >= 0.7", ["rho"]),
    }


def _safe(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE CAST({a} AS DOUBLE) / ({b}) END"


CM = (f"cm AS (SELECT {KEYS}, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, "
      "count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, "
      "count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, "
      "count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) AS total FROM scores GROUP BY ALL)")
RATES = (f"rt AS (SELECT *, {_safe('tp + tn', 'total')} AS accuracy, {_safe('tp', 'tp + fp')} AS precision, "
         f"{_safe('tp', 'tp + fn')} AS recall FROM cm), "
         "rt2 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / "
         "(precision + recall) END AS f1 FROM rt)")
AUC = (f"sc AS (SELECT {KEYS}, score, count(*) FILTER (WHERE label = 1) AS n_pos, "
       "count(*) FILTER (WHERE label = 0) AS n_neg FROM scores GROUP BY ALL), "
       f"scc AS (SELECT *, sum(n_neg) OVER (PARTITION BY {KEYS} ORDER BY score) AS cum_neg, "
       f"sum(n_pos) OVER (PARTITION BY {KEYS} ORDER BY score DESC) AS dpos, "
       f"sum(n_neg) OVER (PARTITION BY {KEYS} ORDER BY score DESC) AS dneg FROM sc), "
       f"au AS (SELECT {KEYS}, sum(n_pos * (cum_neg - 0.5 * n_neg)) / (sum(n_pos) * sum(n_neg))::DOUBLE AS auc "
       "FROM scc GROUP BY ALL)")


def _report_sql():
    p1, r1 = _safe("tp", "tp + fp"), _safe("tp", "tp + fn")
    p0, r0 = _safe("tn", "tn + fn"), _safe("tn", "tn + fp")

    def f1(p, r):
        return f"CASE WHEN ({p}) + ({r}) = 0 THEN 0.0 ELSE 2 * ({p}) * ({r}) / (({p}) + ({r})) END"

    s1, s0 = "CAST(tp + fn AS DOUBLE)", "CAST(tn + fp AS DOUBLE)"
    return (f"rep AS ("
            f"SELECT {KEYS}, '0' AS class, {p0} AS precision, {r0} AS recall, {f1(p0, r0)} AS f1, {s0} AS support FROM cm "
            f"UNION ALL SELECT {KEYS}, '1', {p1}, {r1}, {f1(p1, r1)}, {s1} FROM cm "
            f"UNION ALL SELECT {KEYS}, 'accuracy', NULL, NULL, {_safe('tp + tn', 'total')}, CAST(total AS DOUBLE) FROM cm "
            f"UNION ALL SELECT {KEYS}, 'macro avg', (({p0}) + ({p1})) / 2, (({r0}) + ({r1})) / 2, "
            f"(({f1(p0, r0)}) + ({f1(p1, r1)})) / 2, CAST(total AS DOUBLE) FROM cm "
            f"UNION ALL SELECT {KEYS}, 'weighted avg', {_safe(f'({p0}) * {s0} + ({p1}) * {s1}', 'total')}, "
            f"{_safe(f'({r0}) * {s0} + ({r1}) * {s1}', 'total')}, "
            f"{_safe(f'({f1(p0, r0)}) * {s0} + ({f1(p1, r1)}) * {s1}', 'total')}, CAST(total AS DOUBLE) FROM cm)")


def _e():
    w = W_SCORE.rstrip() + ", "
    rates = ["accuracy", "precision", "recall", "f1"]
    out = {
        "E1": w + CM + " SELECT * FROM cm",
        "E2": rnd(w + CM + ", " + RATES + " SELECT * FROM rt2", rates),
        "E3": rnd(w + CM + ", " + _report_sql() + " SELECT * FROM rep", ["precision", "recall", "f1", "support"]),
        "E4": rnd(w + AUC + " SELECT * FROM au", ["auc"]),
        "E5": rnd(w + CM + ", " + _report_sql() + f" SELECT {KEYS}, f1 AS f1_weighted FROM rep "
                                                   "WHERE class = 'weighted avg'", ["f1_weighted"]),
        "E6": rnd(w + CM + f" SELECT {KEYS}, ({_safe('tp', 'tp + fn')} + {_safe('tn', 'tn + fp')}) / 2 AS roc_weighted "
                           "FROM cm", ["roc_weighted"]),
        "E7": rnd(w + AUC + f", tot AS (SELECT {KEYS}, sum(n_pos) AS P, sum(n_neg) AS N FROM sc GROUP BY ALL) "
                            f"SELECT {KEYS}, score AS threshold, {_safe('dneg', 'N')} AS fpr, {_safe('dpos', 'P')} AS tpr "
                            f"FROM scc JOIN tot USING ({KEYS})", ["threshold", "fpr", "tpr"]),
        "E8": rnd(w + AUC + f", tot AS (SELECT {KEYS}, sum(n_pos) AS P, sum(n_neg) AS N FROM sc GROUP BY ALL) "
                            f"SELECT {KEYS}, score AS threshold, {_safe('dpos', 'P')} AS recall, "
                            f"{_safe('dpos', 'dpos + dneg')} AS precision FROM scc JOIN tot USING ({KEYS})",
                  ["threshold", "recall", "precision"]),
        "E9": rnd(w + AUC + f" SELECT {KEYS}, 1.0 - auc AS test_error FROM au", ["test_error"]),
        "E10": rnd(w + CM + ", " + RATES + ", " + AUC + f" SELECT * FROM rt2 LEFT JOIN au USING ({KEYS})",
                   rates + ["auc"]),
        "E11": rnd(w + CM + f" SELECT {KEYS}, {_safe('tp', 'tp + fn')} AS sensitivity, "
                            f"{_safe('tn', 'tn + fp')} AS specificity FROM cm", ["sensitivity", "specificity"]),
    }
    long = " UNION ALL ".join(f"SELECT model, split, '{m}' AS metric, {m} AS v FROM rt2" for m in rates)
    out["E12"] = rnd(w + CM + ", " + RATES + f" SELECT model, metric, max(CASE WHEN split = 'train' THEN v END) AS train, "
                                             f"max(CASE WHEN split = 'test' THEN v END) AS test FROM ({long}) "
                                             "GROUP BY model, metric", ["train", "test"])
    n = "CAST(total AS DOUBLE)"
    acc = _safe("tp + tn", n)
    prev = _safe("tp + fn", n)
    pe = _safe("CAST(tp + fp AS DOUBLE) * (tp + fn) + CAST(tn + fn AS DOUBLE) * (tn + fp)", f"{n} * {n}")
    out["E13"] = rnd(w + CM + f""" SELECT {KEYS}, {acc} AS accuracy, greatest({prev}, 1.0 - {prev}) AS nir,
            CASE WHEN {pe} = 1 THEN 0.0 ELSE ({acc} - {pe}) / (1.0 - {pe}) END AS kappa,
            ({_safe('tp', 'tp + fn')} + {_safe('tn', 'tn + fp')}) / 2 AS balanced_accuracy,
            {prev} AS prevalence, {_safe('tp', 'tp + fp')} AS ppv, {_safe('tn', 'tn + fn')} AS npv,
            {_safe('tp', n)} AS detection_rate, {_safe('tp + fp', n)} AS detection_prevalence FROM cm""",
                     ["accuracy", "nir", "kappa", "balanced_accuracy", "prevalence", "ppv", "npv",
                      "detection_rate", "detection_prevalence"])
    # the exact interval and the p-values have no closed SQL form here: the registered query with
    # them is E13_tests, held against direct binomial sums in the tests
    return out


MV_SQL = f"""mvlong AS ({long_sql('loans_model', ['label'], FEATS)}),
cnt AS (SELECT feature, value, count(*) FILTER (WHERE label = 0) AS c0, count(*) FILTER (WHERE label = 1) AS c1
        FROM mvlong GROUP BY feature, value),
cum AS (SELECT *, sum(c0) OVER (PARTITION BY feature ORDER BY value) AS k0,
               sum(c1) OVER (PARTITION BY feature ORDER BY value) AS k1,
               sum(c0) OVER (PARTITION BY feature) AS n0, sum(c1) OVER (PARTITION BY feature) AS n1 FROM cnt),
mv AS (SELECT feature,
         (n0 / (n0 + n1)) * sum((c0 + c1) * pow(k0 / n0 - (k0 + k1) / (n0 + n1), 2)) / (n0 + n1)
         + (n1 / (n0 + n1)) * sum((c0 + c1) * pow(k1 / n1 - (k0 + k1) / (n0 + n1), 2)) / (n0 + n1) AS mv,
         max(abs(k1 / n1 - k0 / n0)) AS kf
       FROM cum GROUP BY feature, n0, n1)"""


def _cut(score, p, method=None):
    sel = f"'{method}' AS method, feature" if method else (
        f"feature, {score} AS score, cut AS cutoff, "
        f"CAST(row_number() OVER (ORDER BY {score} DESC, feature) AS BIGINT) AS rank")
    return (f"SELECT {sel} FROM mv, (SELECT quantile_cont({score}, {p}) AS cut FROM mv) c "
            f"WHERE {score} > cut")


def _f():
    w = W_MODEL.rstrip() + ", " + MV_SQL
    out = {
        "F7": rnd(w + " SELECT feature, mv FROM mv", ["mv"]),
        "F8": rnd(w + " SELECT feature, kf FROM mv", ["kf"]),
        "F9": rnd(w + " " + _cut("mv", 0.7), ["score", "cutoff"]),
    }
    sel = (f"sel AS ({_cut('mv', 0.7, 'mvsis')} UNION ALL {_cut('kf', 0.7, 'kolmogorov')} "
           f"UNION ALL {_cut('kf', 0.5, 'kolmogorov_median')})")
    out["F13"] = w + ", " + sel + """, diff AS (
        SELECT a.method AS method_a, b.method AS method_b, a.feature
        FROM sel a, (SELECT DISTINCT method FROM sel) b
        WHERE a.method <> b.method AND NOT EXISTS (SELECT 1 FROM sel s WHERE s.method = b.method AND s.feature = a.feature))
      SELECT method_a, method_b, feature, count(*) OVER (PARTITION BY method_a, method_b) AS n_diff FROM diff"""
    cols = ["int_rate", "term_ 60 months", "grade_B", "grade_C", "grade_D", "grade_E", "hardship_flag",
            "home_ownership_RENT", "label"]
    out["F14"] = rnd(W_MODEL + "SELECT DISTINCT " + ", ".join(qi(c) for c in cols) + " FROM loans_model",
                     ["int_rate"])
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    base = 12  # floor(50 / ln 50)
    stats = " UNION ALL ".join(
        [f"SELECT 'q{int(round(p * 100)):02d}' AS stat, quantile_cont(min_size, {p}) AS value FROM per"
         for p in probs]
        + [f"SELECT 'p_all_c{c}', avg(CASE WHEN min_size <= {c * base} THEN 1.0 ELSE 0.0 END) FROM per"
           for c in (1, 2, 3)])
    out["F10"] = rnd(fs.with_(fs.rank_matrix()).rstrip() + """, per AS (
        SELECT replication, CAST(max(rank) AS DOUBLE) AS min_size FROM rank_matrix WHERE variable IN (1, 5, 9)
        GROUP BY replication HAVING count(*) = 3) """ + stats, ["value"])
    rates = ", ".join(f"avg(CASE WHEN rank <= {c * base} THEN 1.0::DOUBLE ELSE 0 END) AS rate_c{c}" for c in (1, 2, 3))
    out["F10_rates"] = rnd(fs.with_(fs.rank_matrix()) + f"SELECT variable, count(*) AS replications, {rates} FROM rank_matrix "
                           "WHERE variable IN (1, 5, 9) GROUP BY variable", [f"rate_c{c}" for c in (1, 2, 3)])
    return out


def _r():
    split = f"CASE WHEN {duck_b('split', 'loan_id')} < 0.8 * 4294967296 THEN 'train' ELSE 'test' END"
    out = {
        "R1": W_MODEL + f"SELECT loan_id, label, {split} AS split FROM loans_model",
        "R5": W_MODEL + f"SELECT loan_id, label, CAST({duck_b('fold', 'loan_id')} % 5 AS INTEGER) AS fold "
                        "FROM loans_model",
    }
    out["R2"] = W_MODEL + f"""SELECT loan_id, label, CASE WHEN label IS NULL THEN NULL WHEN rn <= ceil(0.9 * cnt) THEN 'a' ELSE 'b' END AS part
        FROM (SELECT loan_id, label,
                     row_number() OVER (PARTITION BY label ORDER BY {duck_b('strat', 'loan_id')}, loan_id) AS rn,
                     count(*) OVER (PARTITION BY label) AS cnt FROM loans_model)"""
    out["R3"] = W_MODEL.rstrip() + f""", tr AS (SELECT loan_id, label FROM loans_model WHERE {split} = 'train'),
        minor AS (SELECT loan_id, label, row_number() OVER (ORDER BY {duck_b('upi', 'loan_id')}, loan_id) - 1 AS idx
                  FROM tr WHERE label = 1),
        cnt AS (SELECT count(*) FILTER (WHERE label <> 1) AS nmaj, count(*) FILTER (WHERE label = 1) AS m FROM tr),
        draws AS (SELECT d, {duck_b60('up', 'd')} % m AS idx FROM (SELECT unnest(range(nmaj)) AS d, m FROM cnt))
        SELECT loan_id, label, CAST(NULL AS BIGINT) AS draw FROM tr WHERE label <> 1
        UNION ALL SELECT minor.loan_id, minor.label, draws.d FROM draws JOIN minor USING (idx)"""
    out["R6"] = W_MODEL + f"""SELECT loan_id, pos, CASE WHEN pos < k1 THEN 'first' ELSE 'second' END AS part
        FROM (SELECT loan_id, CAST(row_number() OVER (ORDER BY {duck_b('perm', 'loan_id')}, loan_id) - 1 AS BIGINT) AS pos,
                     CAST(floor(count(*) OVER () * 0.5) AS BIGINT) AS k1,
                     CAST(floor(count(*) OVER () * 0.25) AS BIGINT) AS k2 FROM loans_model)
        WHERE pos < k1 + k2"""
    return out


def _dist_sql(a, b, cols, metric="euclidean", p=3):
    diffs = [f"abs({a}.{qi(c)}::DOUBLE - {b}.{qi(c)}::DOUBLE)" for c in cols]
    if metric == "chebyshev":
        return f"greatest({', '.join(diffs)})"
    if metric == "manhattan":
        return " + ".join(diffs)
    if metric == "minkowski":
        return f"pow({' + '.join(f'pow({x}, {p})' for x in diffs)}, 1.0::DOUBLE / {p})"
    return f"sqrt({' + '.join(f'{x} * {x}' for x in diffs)})"


def _smote_sql(src: str, key: str, cols, rounded=()) -> str:
    """``src`` is a relation with key, cols and label."""
    def new(c):
        v = f"i.{qi(c)}::DOUBLE + d.u * (p.{qi(c)}::DOUBLE - i.{qi(c)}::DOUBLE)"
        return f"floor({v} + 0.5)" if c in rounded else v
    names = ", ".join(f"{qi(c)}::DOUBLE AS {qi(c)}" for c in cols)
    return f"""minor AS (SELECT * FROM {src} WHERE label = 1),
        cnt AS (SELECT count(*) FILTER (WHERE label <> 1) AS nmaj, count(*) FILTER (WHERE label = 1) AS m FROM {src}),
        nn AS (SELECT {key}, nb, row_number() OVER (PARTITION BY {key} ORDER BY dist, nb) AS nn_rank
               FROM (SELECT a.{key}, b.{key} AS nb, {_dist_sql('a', 'b', cols)} AS dist
                     FROM minor a JOIN minor b ON a.{key} <> b.{key})),
        idx AS (SELECT *, row_number() OVER (ORDER BY {duck_b('smotei', key)}, {key}) - 1 AS _idx FROM minor),
        draws AS (SELECT d, {duck_b60('smote', 'd')} % m AS _idx,
                         CAST({duck_b('smoten', 'd')} % least(5, m - 1) + 1 AS BIGINT) AS nn_rank,
                         {duck_b('smoteu', 'd')} / 4294967296.0 AS u
                  FROM (SELECT unnest(range(nmaj - m)) AS d, m FROM cnt))
        SELECT {key}, {names}, label, CAST(NULL AS BIGINT) AS draw, CAST(NULL AS BIGINT) AS neighbor_{key} FROM {src}
        UNION ALL
        SELECT i.{key}, {', '.join(new(c) for c in cols)}, 1, d.d, nn.nb
        FROM draws d JOIN idx i USING (_idx) JOIN nn ON nn.{key} = i.{key} AND nn.nn_rank = d.nn_rank
             JOIN minor p ON p.{key} = nn.nb"""


def _knn():
    point = [f"x{i}" for i in range(1, 65)]
    split = f"CASE WHEN {duck_b('split', 'loan_id')} < 0.8 * 4294967296 THEN 'train' ELSE 'test' END"
    onehot = [c for c, t in MODEL_TYPES if t == "int" and c != "label"]
    r4 = W_MODEL.rstrip() + f", tr AS (SELECT * FROM loans_model WHERE {split} = 'train'), " + _smote_sql("tr", "loan_id", FEATS, onehot)
    r4p = fs.with_(fs.minority_points()).rstrip() + ", " + _smote_sql("minority_points", "vec_id", point)
    pts = f"""pts AS (SELECT vec_id, {', '.join(f'CAST(embedding[{i}] AS DOUBLE) AS x{i}' for i in range(1, 65))},
                  label, CASE WHEN {duck_b('knn', 'vec_id')} % 100 < 80 THEN 'train' ELSE 'test' END AS split
           FROM embeddings)"""

    def voted(metric, k):
        return f"""SELECT vec_id, label AS prediction FROM (
          SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, label) AS r FROM (
            SELECT vec_id, label, count(*) AS v FROM nn_{metric} WHERE rk <= {k} GROUP BY vec_id, label)) WHERE r = 1"""

    def near(metric):
        return f"""nn_{metric} AS (SELECT q.vec_id, r.label,
                 row_number() OVER (PARTITION BY q.vec_id ORDER BY {_dist_sql('q', 'r', point, metric)}, r.vec_id) AS rk
               FROM pts q JOIN pts r ON q.split = 'test' AND r.split = 'train')"""
    metrics = ("euclidean", "manhattan", "chebyshev", "minkowski")
    grid = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST({k} AS INTEGER) AS k, avg(CASE WHEN prediction = label THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, "
        f"count(*) AS n FROM ({voted(m, k)}) JOIN pts USING (vec_id)" for m in metrics for k in (3, 5, 10, 25, 50))
    m14 = f"WITH {pts}, {near('euclidean')} {voted('euclidean', 5)}"
    return {"R4": rnd(r4, FEATS), "R4_pivot": rnd(r4, FEATS), "R4_points": rnd(r4p, point), "M14": m14, "M14_pivot": m14,
            "M14_grid": rnd(f"WITH {pts}, {', '.join(map(near, metrics))} {grid}", ["accuracy"])}


def _t():
    wc = fs.with_(fs.trials_c()).rstrip() + ", done AS (SELECT * FROM trials_c WHERE state = 'COMPLETE') "
    wa = fs.with_(fs.trials_a())
    js = "replace(params, '''', '\"')"
    parsed = (f"SELECT iteration, loss, json_extract_string({js}, '$.boosting_type') AS boosting_type, "
              f"CAST(json_extract_string({js}, '$.learning_rate') AS DOUBLE) AS learning_rate, "
              f"CAST(json_extract_string({js}, '$.max_depth') AS INTEGER) AS max_depth, "
              f"CAST(json_extract_string({js}, '$.subsample') AS DOUBLE) AS subsample FROM trials_a")
    lg = long_sql("done", ["iteration", "value"], TRIAL_PARAMS, name="param", value="param_value")
    out = {
        "T1": rnd(wa + parsed, ["loss", "learning_rate", "subsample"]),
        "T2": rnd(wc + "SELECT iteration, value FROM done ORDER BY value DESC, iteration LIMIT 2", ["value"]),
        "T3": rnd(wa + f"SELECT * REPLACE (CAST(max_depth AS DOUBLE) AS max_depth) FROM ({parsed})",
                  ["loss", "learning_rate", "subsample", "max_depth"]),
        "T4": rnd(wc + "SELECT iteration, value, max(value) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING "
                       "AND CURRENT ROW) AS best_so_far FROM done", ["value", "best_so_far"]),
        "T5": rnd(wc + "SELECT DISTINCT value, cume_dist() OVER (ORDER BY value) AS ecdf FROM done",
                  ["value", "ecdf"]),
        "T6": rnd(wc + f"""SELECT iteration, param, value, CASE WHEN hi = lo THEN 0.0 ELSE (param_value - lo) / (hi - lo) END AS scaled
              FROM ({lg}) l JOIN (SELECT param, min(param_value) AS lo, max(param_value) AS hi FROM ({lg}) GROUP BY param)
              USING (param)""", ["value", "scaled"]),
        "T7": rnd(wc + lg, ["value", "param_value"]),
        "T10": rnd(wc + " UNION ALL ".join(f"""SELECT '{c}' AS param, i AS grid_i, _lo + (_hi - _lo) * (i / 63.0::DOUBLE) AS x,
              sum(exp(-0.5 * pow(((_lo + (_hi - _lo) * (i / 63.0::DOUBLE)) - x) / _h, 2))) / (_n * _h * sqrt(2 * pi())) AS density
            FROM (SELECT {c}::DOUBLE AS x, s.* FROM done, (SELECT count(*) AS _n, min({c})::DOUBLE AS _lo,
                  max({c})::DOUBLE AS _hi, stddev_samp({c}) * pow(count(*), -0.2) AS _h FROM done) s) d,
                 range(64) AS g(i) GROUP BY i, _lo, _hi, _n, _h""" for c in TRIAL_PARAMS), ["x", "density"]),
        "T10_binned": rnd(wc + binned_density(long_sql('done', [], TRIAL_PARAMS, name='param'), "param"), ["x", "density", "bound"]),
        "T11": rnd(wc + f"""SELECT param, regr_slope(param_value, CAST(iteration AS DOUBLE)) AS slope,
              regr_intercept(param_value, CAST(iteration AS DOUBLE)) AS intercept,
              regr_r2(param_value, CAST(iteration AS DOUBLE)) AS r2
            FROM ({long_sql('done', ['iteration'], TRIAL_PARAMS, name='param', value='param_value')}) GROUP BY param""",
                   ["slope", "intercept", "r2"]),
        "T12": wc + ("SELECT boosting_type AS level, count(*) AS n, CAST(CASE boosting_type WHEN 'gbdt' THEN 0 "
                     "WHEN 'dart' THEN 1 WHEN 'goss' THEN 2 END AS INTEGER) AS code FROM done GROUP BY boosting_type"),
        "T14": rnd(wc + "SELECT * FROM done", ["value", "learning_rate", "subsample", "reg_lambda"]),
        "S8": rnd(wc + """SELECT iteration, value AS f1_weighted, learning_rate, max_depth, state,
              CAST(row_number() OVER (ORDER BY value DESC, iteration) AS BIGINT) AS position FROM done""",
                  ["f1_weighted", "learning_rate"]),
        "H4": rnd(fs.with_(fs.trial_params()) + "SELECT * EXCLUDE (ts) FROM trial_params",
                  ["learning_rate", "subsample", "reg_lambda", "num_leaves", "max_bins", "drop_rate"]),
    }
    out["T8"] = rnd(wc + """SELECT x_bin, y_bin, count(*) AS n, avg(value) AS mean_metric, max(value) AS best_metric FROM (
          SELECT value,
            CAST(CASE WHEN xhi = xlo THEN 0 ELSE least(floor((learning_rate - xlo) / (xhi - xlo) * 5), 4) END AS INTEGER) AS x_bin,
            CAST(CASE WHEN yhi = ylo THEN 0 ELSE least(floor((max_depth - ylo) / (yhi - ylo) * 5), 4) END AS INTEGER) AS y_bin
          FROM done, (SELECT min(learning_rate) AS xlo, max(learning_rate) AS xhi, min(max_depth) AS ylo,
                             max(max_depth) AS yhi FROM done)) GROUP BY x_bin, y_bin""",
                    ["mean_metric", "best_metric"])
    pat = r"^(\d+) days (\d+):(\d+):(\d+(?:\.\d+)?)$"
    dur = " + ".join(f"CAST(NULLIF(regexp_extract(duration, '{pat}', {g}), '') AS DOUBLE) * {m}"
                     for g, m in ((1, 86400), (2, 3600), (3, 60), (4, 1)))
    out["T13"] = rnd(fs.with_(fs.trials_c()) + f"""SELECT a.iteration, {dur.replace('duration', 'a.duration')} AS duration_s,
          (epoch_us(a.datetime_start) - epoch_us(b.datetime_complete)) / 1e6 AS gap_s
        FROM trials_c a LEFT JOIN trials_c b ON b.iteration + 1 = a.iteration""", ["duration_s", "gap_s"])
    return out


def _m():
    cols = ["loan_amnt", "installment", "int_rate", "annual_inc", "n_items", "avg_disc"]
    nn = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    out = {"M1": rnd(W_RAW + "SELECT loan_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
                     + f" FROM loans_raw WHERE {nn}", cols)}
    legal = ml_names(FEATS)
    split = f"CASE WHEN {duck_b('split', 'loan_id')} < 0.8 * 4294967296 THEN 'train' ELSE 'test' END"
    w = W_MODEL.rstrip() + f", sp AS (SELECT *, {split} AS _split FROM loans_model) "
    mm = ", ".join(f"CAST(min({qi(c)}) AS DOUBLE) AS mn{i}, CAST(max({qi(c)}) AS DOUBLE) AS mx{i}, "
                   f"stddev_samp({qi(c)}) AS sd{i}" for i, c in enumerate(FEATS))
    scaled = ", ".join(
        f"CASE WHEN mx{i} = mn{i} THEN 0.5 ELSE (CAST({qi(c)} AS DOUBLE) - mn{i}) * (1.0 / (mx{i} - mn{i})) + 0.0 END "
        f"AS {qi(l)}" for i, (c, l) in enumerate(zip(FEATS, legal)))
    stdd = ", ".join(
        f"CASE WHEN sd{i} = 0 THEN 0.0 ELSE CAST({qi(c)} AS DOUBLE) * (1.0 / sd{i}) END AS {qi(l)}"
        for i, (c, l) in enumerate(zip(FEATS, legal)))
    st = f"(SELECT {mm} FROM sp WHERE _split = 'train') st"
    out["M2"] = rnd(w + f"SELECT loan_id, {scaled} FROM sp, {st} WHERE _split = 'test'", legal)
    out["M3"] = rnd(w + f"SELECT loan_id, {stdd} FROM sp, {st} WHERE _split = 'test'", legal)
    out["S2"] = rnd(W_MODEL + "SELECT * FROM loans_model", MODEL_DOUBLES)
    out["S5"] = W_MODEL + f"SELECT count(*) AS n_rows, CAST({len(MODEL_TYPES)} AS INTEGER) AS n_cols FROM loans_model"
    return out


def _s():
    return {
        "S1": rnd(W_RAW + "SELECT * FROM loans_raw", RAW_DOUBLES),
        "S3": rnd(W_MODEL + "SELECT " + ", ".join(f"CAST({qi(c)} AS DOUBLE) AS {qi(c)}" for c, _ in MODEL_TYPES)
                  + " FROM loans_model", [c for c, _ in MODEL_TYPES]),
        "S4": W_MODEL + "SELECT loan_id, CAST(trunc(int_rate) AS INTEGER) AS int_rate, "
                        "CAST(trunc(installment) AS INTEGER) AS installment FROM loans_model",
        "S7": rnd(fs.with_(fs.trials_a()) + "SELECT * FROM trials_a", ["loss", "train_time"]),
    }


def _models():
    """Explanations of a fixed linear score, and decisions over a history table, from their definitions."""
    split = f"CASE WHEN {duck_b('split', 'loan_id')} < 0.8 * 4294967296 THEN 'train' ELSE 'test' END"
    lin = {"int_rate": 0.04, "term_ 60 months": 0.1, "grade_E": 0.15, "n_items": -0.01}
    w = W_MODEL.rstrip() + f", sp AS (SELECT *, {split} AS _split FROM loans_model), te AS (SELECT * FROM sp WHERE _split = 'test'), tr AS (SELECT * FROM sp WHERE _split = 'train')"

    def score(of):
        return " + ".join(f"{of[c]}::DOUBLE * {v}::DOUBLE" for c, v in lin.items())

    own = {c: f"a.{qi(c)}" for c in lin}
    copies = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r} AS rep, avg(CASE WHEN (CASE WHEN {score(own | {c: f'p.{qi(c)}'})} > 0.5 THEN 1 ELSE 0 END) = a.label "
        f"THEN 1.0::DOUBLE ELSE 0 END) AS acc FROM base a JOIN perm{r} p ON a.i = p.i" for r in range(3) for c in lin)
    perms = ", ".join(f"perm{r} AS (SELECT *, row_number() OVER (ORDER BY {duck_b(f'perm:{r}', 'loan_id')}, loan_id) AS i FROM te)" for r in range(3))
    f3 = w + (f", base AS (SELECT *, row_number() OVER (ORDER BY {duck_b('perm:base', 'loan_id')}, loan_id) AS i FROM te), {perms}, "
              f"b0 AS (SELECT avg(CASE WHEN (CASE WHEN {score(own)} > 0.5 THEN 1 ELSE 0 END) = a.label THEN 1.0::DOUBLE ELSE 0 END) AS acc FROM te a), "
              f"cp AS ({copies}) SELECT feature, avg(b0.acc - cp.acc) AS weight, stddev_pop(b0.acc - cp.acc) AS std FROM cp, b0 GROUP BY feature")
    # a linear score has no interactions: every order credits a feature with coefficient · (x - background)
    pick = duck_b60("shappick", "loan_id || ':' || m")
    phi = " UNION ALL ".join(f"SELECT e.loan_id, '{c}' AS feature, avg({v}::DOUBLE * (e.{qi(c)}::DOUBLE - g.{qi(c)}::DOUBLE)) AS phi "
                             f"FROM picks e JOIN bg g ON g.i = e.i GROUP BY e.loan_id" for c, v in lin.items())
    shap = w + (f", bg AS (SELECT *, row_number() OVER (ORDER BY {duck_b('shapbg', 'loan_id')}, loan_id) - 1 AS i FROM tr), "
                f"picks AS (SELECT t.*, {pick} % (SELECT count(*) FROM tr) AS i FROM (SELECT te.*, unnest(range(4)) AS m FROM te) t), phi AS ({phi}) ")
    hist = (f"hist AS (SELECT CAST(c_custkey // 12 AS INTEGER) AS round, 'f' || (c_custkey % 12) AS feature, "
            f"({duck_b('hist', 'c_custkey')} % 1000)::DOUBLE / 1000 + (c_custkey % 12) / 24.0::DOUBLE AS importance FROM customer), "
            "per AS (SELECT feature, count(*) AS rounds, count(*) FILTER (WHERE importance > 0.75) AS hits, median(importance) AS med_imp "
            "FROM hist GROUP BY feature), "
            "tails AS (SELECT *, (SELECT sum(exp(lgamma(rounds + 1) - lgamma(i + 1) - lgamma(rounds - i + 1) - rounds * ln(2))) "
            "FROM range(0, 100000) t(i) WHERE i BETWEEN hits AND rounds) AS up, "
            "(SELECT sum(exp(lgamma(rounds + 1) - lgamma(i + 1) - lgamma(rounds - i + 1) - rounds * ln(2))) "
            "FROM range(0, 100000) t(i) WHERE i BETWEEN rounds - hits AND rounds) AS down FROM per), "
            "dec AS (SELECT feature, rounds, hits, med_imp, CASE WHEN up < 0.05 / 12 THEN 'Confirmed' WHEN down < 0.05 / 12 THEN 'Rejected' "
            "ELSE 'Tentative' END AS decision FROM tails)")
    # the first round of boosting: every margin is 0, positives weigh 3
    feats = [c for c, _ in MODEL_TYPES if c not in ("loan_id", "label")]
    cells = w + f""", long AS ({long_sql('tr', ['loan_id', 'label'], feats)}),
      part AS (SELECT *, floor((rank() OVER (PARTITION BY feature ORDER BY value) - 1) * 32 / count(*) OVER (PARTITION BY feature)) AS part FROM long),
      cuts AS (SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY part) - 1 AS INTEGER) AS bin, part, max(value) AS cut
               FROM part GROUP BY feature, part),
      cells AS (SELECT p.feature, bin, sum((0.5::DOUBLE - label) * CASE WHEN label = 1 THEN 3 ELSE 1 END) AS g,
                  sum(0.25::DOUBLE * CASE WHEN label = 1 THEN 3 ELSE 1 END) AS h, count(*) AS n
                FROM part p JOIN cuts USING (feature, part) GROUP BY p.feature, bin),
      sides AS (SELECT feature, bin, sum(g) OVER u AS gl, sum(h) OVER u AS hl, CAST(sum(n) OVER u AS BIGINT) AS nl, sum(g) OVER t AS g, sum(h) OVER t AS h, sum(n) OVER t AS n
                FROM cells WINDOW u AS (PARTITION BY feature ORDER BY bin), t AS (PARTITION BY feature)) """

    def worth(g, h):
        return f"pow(greatest(abs({g}) - 2, 0), 2) / ({h} + 1.5)"
    lvl = " JOIN ".join(
        f"(SELECT loan_id, (coalesce(sum(label) OVER (PARTITION BY {c} ORDER BY h, loan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5) / "
        f"(row_number() OVER (PARTITION BY {c} ORDER BY h, loan_id)) AS {c} FROM lv) AS _{c}" + ("" if i == 0 else " USING (loan_id)")
        for i, c in enumerate(["term", "grade", "home_ownership"]))
    levels = w + f""", lv AS (SELECT t.loan_id, t.label, trim(r.term) AS term, r.grade, r.home_ownership, {duck_b('ts', 't.loan_id')} AS h
      FROM tr t JOIN loans_raw r USING (loan_id)) SELECT loan_id, term, grade, home_ownership FROM {lvl}"""
    pairs = [(a, b) for i, a in enumerate(CONT) for b in CONT[i + 1:] if {a, b} != {"loan_amnt", "funded_amnt"} and "installment" not in (a, b)]
    srt = sorted(CONT)
    done = fs.with_(fs.trials_c()).rstrip() + ", done AS (SELECT * FROM trials_c WHERE state = 'COMPLETE') "

    def mid(c):
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    ranked = ", ".join(f"{mid(c)} AS {c}" for c in ["value", *TRIAL_PARAMS])
    return {
        "M11_cuts": rnd(cells + "SELECT feature, bin, cut FROM cuts", ["cut"]),
        "M11_histogram": rnd(cells + "SELECT feature, bin, g, h, n FROM cells", ["g", "h"]),
        "M11_gains": rnd(cells + f"SELECT feature, bin, gl, hl, nl, {worth('gl', 'hl')} + {worth('(g - gl)', '(h - hl)')} - {worth('g', 'h')} AS gain FROM sides "
                                 "WHERE least(hl, h - hl) >= 5 AND least(nl, n - nl) >= 1", ["gl", "hl", "gain"]),
        "M13_levels": rnd(levels, ["term", "grade", "home_ownership"]),
        "F3_linear": rnd(f3, ["weight", "std"]),
        "X4_linear": rnd(shap + "SELECT * FROM phi", ["phi"]),
        "F4_linear": rnd(shap + "SELECT feature, avg(abs(phi)) AS mean_abs_phi FROM phi GROUP BY feature", ["mean_abs_phi"]),
        "F11_decisions": f"WITH {hist} SELECT feature, rounds, hits, decision FROM dec",
        "F12_decisions": rnd(f"WITH {hist} SELECT feature, hits, decision, med_imp, 0.75::DOUBLE AS med_shadow, "
                             "CASE WHEN decision <> 'Tentative' THEN decision WHEN med_imp > 0.75 THEN 'Confirmed' ELSE 'Rejected' END AS final FROM dec",
                             ["med_imp", "med_shadow"]),
        "C4_pairs": rnd(W_MODEL + " UNION ALL ".join(
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, 1 / (1 - pow(corr({a}, {b}), 2)) AS vif FROM loans_model" for a, b in pairs), ["vif"]),
        "C6_products": rnd(W_MODEL + " UNION ALL ".join(
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS rho FROM loans_model"
            for i, a in enumerate(srt) for b in srt[i + 1:]), ["rho"]),
        "A11_sample": rnd(W_MODEL + f"SELECT CAST(row_number() OVER (ORDER BY x, loan_id) AS BIGINT) AS i, x AS sample_q FROM ("
                          f"SELECT loan_id, int_rate AS x FROM loans_model ORDER BY {duck_b('qq', 'loan_id')}, loan_id LIMIT 1000)", ["sample_q"]),
        "T9_spearman": rnd(done + f", rk AS (SELECT {ranked} FROM done) " + " UNION ALL ".join(
            f"SELECT '{c}' AS param, corr(value, {c}) AS rho FROM rk" for c in TRIAL_PARAMS), ["rho"]),
    }


def oracle_sql() -> dict[str, str]:
    out = {}
    for part in (_p, _a, _c, _e, _f, _r, _knn, _t, _s, _m, _models):
        out.update(part())
    return out
