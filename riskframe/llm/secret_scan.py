"""Secret scans (5): base patterns and a randomness test battery, DataFrame functions only.

Base kinds are fixed patterns. The battery looks at every run of at least
``min_length`` characters that an encoded key could have:

* The encoding is the smallest alphabet that holds all its characters (hex,
  letters, letters and digits, base64 in either form). Runs without small
  letters are folded first; runs of digits alone are numbers, not keys.
* A key is uniform over its alphabet and has no memory. Three tests must not
  object: chi-squared uniformity of the symbol counts (Wilson-Hilferty), runs
  above and below the middle of the alphabet, and lag-one serial correlation.
* Against ordinary writing stands an e-value: how much likelier the run is as
  uniform draws than by the character frequencies of all words of the corpus
  too short to be candidates. It is a product over characters, so evidence
  grows with length.
* False discoveries are controlled by the step-up rule for e-values within each
  octave of length, over all candidates of all documents: of m candidates those
  are kept whose e-value is at least m / (q * number kept).

A random span that overlaps a base span adds nothing and is left out.

Spans are in code points, end exclusive. Defined results: null text counts as
empty (no spans, the checksum of the empty text); repeated rows count each on
its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import pin

# The base patterns, in the order in which spans of one start are listed.
BASE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
# the same matches that are long enough, found without listing the short ones
LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
KINDS = [*BASE, "random"]
RANDOM = len(BASE)

RUN = r"[A-Za-z0-9+/_-]"
MIN_LENGTH = 20
Q = 0.01
Z_LIMIT = 3.3  # two-sided one in a thousand
STEP = 0.25  # width of the e-value bins, in natural logarithms
ALPHABETS = {
    "hex": "0123456789abcdef",
    "alpha": "abcdefghijklmnopqrstuvwxyz",
    "alnum": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
# base64 has 64 symbols; its two last ones are written in two ways
SIZES = {"hex": 16, "alpha": 26, "alnum": 36, "base64": 64}


def _found(text: Column, pattern: str) -> Column:
    """(gap before, match) of every match, in order; null where there is none."""
    gaps = F.split(text, pattern, -1)
    pairs = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                        lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), m.alias("match")))
    return F.when(text.rlike(pattern), pairs)


def _spread(hits: DataFrame, kind: int) -> DataFrame:
    return hits.select("uid", F.lit(kind).alias("kind"), F.posexplode(KINDS[kind]).alias("nth", "hit")).select(
        "uid", "kind", "nth", "hit.gap", "hit.match")


def writing_frequencies(docs: DataFrame, text_col: str, min_length: int) -> dict[str, float]:
    """Share of every run character in the words too short to be candidates (case kept)."""
    run_words = F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(RUN + "+"), F.lit(0)))
    chars = (docs.select(run_words.alias("w")).filter(F.length("w").between(4, min_length - 1))
             .select(F.explode(F.split("w", "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")))
    seen = {r["c"]: r["n"] for r in chars.collect()}  # at most one row a character of RUN
    symbols = ALPHABETS["base64"]
    total = sum(seen.values()) + 0.5 * len(symbols)
    return {c: (seen.get(c, 0) + 0.5) / total for c in symbols}


def _battery(c: DataFrame, writing: dict[str, float]) -> DataFrame:
    """Adds encoding, n, ln_e and random_like (no test objects) to rows with ``match``."""
    fold = ~F.col("match").rlike("[a-z]")
    c = c.withColumn("key", F.regexp_replace(F.when(fold, F.lower("match")).otherwise(F.col("match")), "=+$", ""))
    encoding = (F.when(F.col("key").rlike("^[0-9]*$"), F.lit(None)).when(F.col("key").rlike("^[0-9a-f]*$"), "hex")
                .when(F.col("key").rlike("^[a-z]*$"), "alpha").when(F.col("key").rlike("^[0-9a-z]*$"), "alnum").otherwise("base64"))
    c = c.withColumn("encoding", encoding).filter("encoding is not null").withColumn("n", F.length("key").cast("double"))
    pick = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("encoding"))
    c = c.withColumn("k", pick(SIZES).cast("double")).withColumn("alphabet", pick(ALPHABETS))
    c = c.withColumn("chars", F.split("key", ""))
    # positions in the alphabet; both forms of the last two base64 symbols are one
    c = c.withColumn("v", F.transform("chars", _place))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    squares = total(F.transform(F.array_distinct("v"), lambda s: F.pow(F.size(F.filter("v", lambda x: x == s)).cast("double"), F.lit(2.0))))
    c = c.withColumn("chi2", F.col("k") / F.col("n") * squares - F.col("n"))
    df = F.col("k") - 1
    c = c.withColumn("z_chi", (F.cbrt(F.greatest("chi2", F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    # runs above and below the middle
    c = c.withColumn("up", F.transform("v", lambda x: x >= F.col("k") / 2)).withColumn("n_up", F.size(F.filter("up", lambda x: x)).cast("double"))
    pairs = F.slice(F.col("v"), 2, F.size("v"))
    changes = F.size(F.filter(F.zip_with(F.slice("up", 2, F.size("up")), F.slice("up", 1, F.size("up") - 1), lambda a, b: a != b), lambda x: x))
    m = 2 * F.col("n_up") * (F.col("n") - F.col("n_up"))
    spread = m * (m - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    c = c.withColumn("z_runs", F.when(spread > 0, (changes + 1 - (m / F.col("n") + 1)) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(F.lit(99.0)))
    mean = total(F.col("v")) / F.col("n")
    c = c.withColumn("mean", mean)
    dev = total(F.transform("v", lambda x: (x - F.col("mean")) * (x - F.col("mean"))))
    lag = total(F.zip_with(pairs, F.slice("v", 1, F.size("v") - 1), lambda a, b: (a - F.col("mean")) * (b - F.col("mean"))))
    c = c.withColumn("z_serial", F.when(dev > 0, (lag / F.greatest(dev, F.lit(1e-9)) + 1 / F.col("n")) * F.sqrt("n")).otherwise(F.lit(99.0)))
    like = (F.col("z_chi") < Z_LIMIT) & (F.abs("z_runs") < Z_LIMIT) & (F.abs("z_serial") < Z_LIMIT)
    weight = F.create_map(*[F.lit(x) for ch, p in writing.items() for x in (ch, -math.log(p))])
    ln_e = total(F.transform("chars", lambda x: F.element_at(weight, x))) - F.col("n") * F.log("k")
    return c.withColumn("random_like", like).withColumn("ln_e", ln_e)


def _place(x: Column) -> Column:
    at = F.instr(F.col("alphabet"), x).cast("double") - 1
    return F.when(at >= 64, at - 2).otherwise(at)


def _limits(tested: DataFrame, q: float) -> dict[int, float]:
    """Least ln(e) that is kept, for each octave of length that keeps any."""
    bins = (tested.groupBy("octave", F.when(F.col("random_like"), F.floor(F.col("ln_e") / STEP)).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))
    # a row for each octave and bin; candidates that a test rejects count in m only
    m = F.sum("n").over(Window.partitionBy("octave"))
    kept = F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))).over(Window.partitionBy("octave").orderBy(F.desc_nulls_last("bin")))
    ok = bins.withColumn("m", m).withColumn("kept", kept).filter(F.col("bin").isNotNull() & (F.col("bin") * STEP >= F.log(F.col("m") / (F.lit(q) * F.col("kept")))))
    return {r["octave"]: r["bin"] * STEP for r in ok.groupBy("octave").agg(F.min("bin").alias("bin")).collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, q: float = Q) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans (kind:start:end)."""
    text = F.col("text")
    src = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    hits = pin(src.select("doc_id", F.monotonically_increasing_id().alias("uid"),
                          _found(text, BASE["assign"]).alias("assign"), _found(text, LONG["access"]).alias("access"),
                          _found(text, LONG["hex"]).alias("hex"), _found(text, f"{RUN}{{{min_length},}}={{0,2}}").alias("random")), "hits")
    rows = _spread(hits, 0)
    for kind in range(1, len(KINDS)):
        rows = rows.union(_spread(hits, kind))
    own = Window.partitionBy("uid", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.col("gap") + F.length("match")).over(own) - F.length("match")
    located = rows.withColumn("start", start).withColumn("end", F.col("start") + F.length("match"))
    short = (F.col("kind") == 0) & (F.length(F.regexp_extract("match", BASE["assign"], 2)) < LEAST["assign"])
    located = pin(located.filter(~short).select("uid", "kind", "start", "end", "match"), "located")

    tested = (_battery(located.filter(F.col("kind") == RANDOM), writing_frequencies(docs, text_col, min_length))
              .select("uid", "kind", "start", "end", "random_like", "ln_e", F.floor(F.log2("n")).cast("int").alias("octave")))
    tested = pin(tested, "tested")
    keep = F.lit(False)
    for octave, least in _limits(tested, q).items():
        keep = keep | ((F.col("octave") == octave) & (F.col("ln_e") >= least))
    spans = located.filter(F.col("kind") < RANDOM).select("uid", "kind", "start", "end").union(
        tested.filter(F.col("random_like") & keep).select("uid", "kind", "start", "end"))

    turn = Window.partitionBy("uid").orderBy("start", "kind", "end")
    is_base = F.col("kind") < RANDOM
    met = (F.coalesce(F.max(F.when(is_base, F.col("end"))).over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) > F.col("start")) | (
        F.coalesce(F.min(F.when(is_base, F.col("start"))).over(turn.rowsBetween(1, Window.unboundedFollowing)), F.col("end")) < F.col("end"))
    spans = spans.withColumn("met", met).filter(is_base | ~F.col("met"))
    listed = F.sort_array(F.collect_list(F.struct("start", "kind", "end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    write = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
    per_row = spans.groupBy("uid").agg(listed.alias("all"), *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS)])
    out = hits.select("doc_id", "uid").join(per_row, "uid", "left")
    none = lambda c: F.coalesce(c, F.lit(""))
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS],
                      none(write(F.filter("all", lambda s: s["kind"] < RANDOM))).alias("base_spans"), none(write(F.col("all"))).alias("spans"))
