"""Trial analytics: queries over hyperparameter-trial logs.

Trial tables are ordinary DataFrames, so the same plans serve a log of
100 trials and a log of millions: running bests and ECDFs use the
distributed running aggregates, gaps between trials are a key join on
the next iteration, never a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import q
from riskframe.plans.prefix import prefix_sums
from riskframe.plans.reshape import to_long, with_scalar_totals


# a text in either kind of quotes, or what stands between texts
_TOKEN = r"""'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|[^'"]++"""


def python_to_json(text: Column) -> Column:
    """A Python literal's text as JSON; null where a quote is left open.

    Quotes are turned around their own text only, so it may hold the other kind, escaped quotes or
    words like True; the words become JSON's where they stand as values.
    """
    def one(t: Column) -> Column:
        inner = F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
        plain = F.regexp_replace(inner, r"\\'", "'")
        single = F.concat(F.lit('"'), F.regexp_replace(plain, r'(?<!\\)((?:\\\\)*)"', r'$1\\"'), F.lit('"'))
        double = F.concat(F.lit('"'), plain, F.lit('"'))
        words = t
        for word, json_word in (("True", "true"), ("False", "false"), ("None", "null")):
            words = F.regexp_replace(words, rf"\b{word}\b", json_word)
        return F.when(t.startswith("'"), single).when(t.startswith('"'), double).otherwise(words)

    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    whole = F.aggregate(tokens, F.lit(0), lambda n, t: n + F.length(t)) == F.length(text)
    return F.when(whole, F.array_join(F.transform(tokens, one), ""))


def parse_params(df: DataFrame, col: str = "params", keys=None, types=None) -> DataFrame:
    """T1 (+T3): a Python dict literal ``{'a': 1, 'b': 'x'}`` -> typed columns."""
    d = df.withColumn("_js", python_to_json(q(col)))
    d = d.withColumn("_pm", F.from_json("_js", "map<string,string>")).drop("_js")
    keys = keys or []
    types = types or {}

    def value(k: str):
        # "outer.inner" is a key of a nested dict, one level down
        outer, _, inner = k.partition(".")
        return F.get_json_object(F.col("_pm")[outer], f"$.{inner}") if inner else F.col("_pm")[outer]

    return d.withColumns({k: value(k).cast(types.get(k, "string")) for k in keys}).drop("_pm")


def completed(df: DataFrame, state: str = "state") -> DataFrame:
    """Drop unfinished trials."""
    return df.filter(q(state) == "COMPLETE")


def rank_trials(df: DataFrame, metric: str, n: int = 2, ascending: bool = True) -> DataFrame:
    """Best ``n`` trials by metric (ties by iteration); a top-n report."""
    o = F.col(metric).asc() if ascending else F.col(metric).desc()
    return df.filter(F.col(metric).isNotNull()).orderBy(o, "iteration").limit(n)


def history(df: DataFrame, metric: str = "value", maximize: bool = True) -> DataFrame:
    """T4: value and best so far by iteration (distributed running max/min)."""
    d = df.filter(F.col(metric).isNotNull()).select("iteration", metric)
    d = d.withColumn("_v", F.col(metric) if maximize else -F.col(metric))
    c = prefix_sums(d, [], ["iteration"], ["_v"], agg="max", prefix="_best")
    best = F.col("_best_v") if maximize else -F.col("_best_v")
    return c.select("iteration", metric, best.alias("best_so_far"))


def metric_ecdf(df: DataFrame, metric: str = "value") -> DataFrame:
    """T5: share of trials with metric <= v, per distinct v."""
    d = df.filter(F.col(metric).isNotNull()).groupBy(F.col(metric).alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    c = prefix_sums(d, [], ["v"], ["n"], prefix="cum_", totals={"n": "_tot"})
    return c.select(F.col("v").alias(metric), (F.col("cum_n") / F.col("_tot")).alias("ecdf"))


def parallel_coordinates(df: DataFrame, params, metric: str = "value") -> DataFrame:
    """Each parameter scaled to [0, 1] per trial, long form, with the metric."""
    long = to_long(df.filter(F.col(metric).isNotNull()), ["iteration", metric], params, name="param",
                   value="param_value")
    mm = long.groupBy("param").agg(F.min("param_value").alias("_lo"), F.max("param_value").alias("_hi"))
    j = long.join(mm, "param")
    rng = F.col("_hi") - F.col("_lo")
    return j.select("iteration", "param", metric,
                    F.when(rng == 0, F.lit(0.0)).otherwise((F.col("param_value") - F.col("_lo")) / rng).alias("scaled"))


def slices(df: DataFrame, params, metric: str = "value") -> DataFrame:
    """(iteration, parameter, value, metric) long table."""
    return to_long(df.filter(F.col(metric).isNotNull()), ["iteration", metric], params, name="param",
                   value="param_value")


def contour(df: DataFrame, x: str, y: str, metric: str = "value", bins: int = 5) -> DataFrame:
    """Mean and best metric on a bins × bins grid of two parameters."""
    d = df.filter(F.col(metric).isNotNull())
    mm = d.agg(F.min(x).alias("_xlo"), F.max(x).alias("_xhi"), F.min(y).alias("_ylo"), F.max(y).alias("_yhi"))
    j = with_scalar_totals(d, mm)

    def bucket(c, lo, hi):
        w = F.col(hi) - F.col(lo)
        return F.when(w == 0, F.lit(0)).otherwise(
            F.least(F.floor((F.col(c) - F.col(lo)) / w * F.lit(bins)), F.lit(bins - 1))).cast("int")

    return j.groupBy(bucket(x, "_xlo", "_xhi").alias("x_bin"), bucket(y, "_ylo", "_yhi").alias("y_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean_metric"), F.max(metric).alias("best_metric"))


def trends(df: DataFrame, params, x: str = "iteration") -> DataFrame:
    """Linear trend of each parameter over iterations (slope, intercept, R²)."""
    long = to_long(df, [x], params, name="param", value="param_value")
    xv = F.col(x).cast("double")
    return long.groupBy("param").agg(
        F.regr_slope("param_value", xv).alias("slope"),
        F.regr_intercept("param_value", xv).alias("intercept"),
        F.regr_r2("param_value", xv).alias("r2"))


def categorical_counts(df: DataFrame, col: str, codes: dict) -> DataFrame:
    """Counts per category and its numeric code."""
    m = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return df.groupBy(q(col).alias("level")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "code", m[F.col("level")].cast("int"))


def duration_seconds(c) -> "F.Column":
    """Parse ``'D days HH:MM:SS.ffffff'`` to seconds."""
    pat = r"^(\d+) days (\d+):(\d+):(\d+(?:\.\d+)?)$"
    return (F.regexp_extract(c, pat, 1).cast("double") * 86400
            + F.regexp_extract(c, pat, 2).cast("double") * 3600
            + F.regexp_extract(c, pat, 3).cast("double") * 60
            + F.regexp_extract(c, pat, 4).cast("double"))


def duration_stats(df: DataFrame) -> DataFrame:
    """Per trial duration seconds and the gap between its start and the
    previous trial's completion (key join on iteration - 1)."""
    d = df.select("iteration", "datetime_start", "datetime_complete",
                  duration_seconds(F.col("duration")).alias("duration_s"))
    prev = d.select((F.col("iteration") + 1).alias("iteration"),
                    F.col("datetime_complete").alias("_prev_complete"))
    j = d.join(prev, "iteration", "left")
    gap = (F.unix_micros(F.col("datetime_start").cast("timestamp"))
           - F.unix_micros(F.col("_prev_complete").cast("timestamp"))) / F.lit(1e6)
    return j.select("iteration", "duration_s", gap.alias("gap_s"))


def study_export(df: DataFrame, metric: str, rename: dict | None = None, ascending: bool = False) -> DataFrame:
    """Trials sorted by metric (with its position), renamed columns."""
    from riskframe.plans.prefix import rank_within
    d = df.withColumnsRenamed(rename or {})
    d = d.filter(F.col(metric).isNotNull()).withColumn("_o", F.col(metric) if ascending else -F.col(metric))
    return rank_within(d, [], ["_o", "iteration"], out="position").drop("_o")
