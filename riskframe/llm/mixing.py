"""Mixing sources to target weights (10): hierarchical budgeting, DataFrame functions only.

Documents sit on the leaves of a tree domain -> language -> source. A leaf can
give at most ``max_epochs`` times its tokens. The token target goes down the
tree by weight; a child that cannot take its share is filled and the shortage is
shared out among its siblings by weight (water-filling). Only what the siblings
together cannot take goes up: a parent's own limit is the sum of its children's,
so the next siblings in line are the parent's. All of it is integer arithmetic
on one row per tree node.

A leaf then reads its documents in seeded epochs: epoch ``e`` orders them by
``md5(seed:e:doc_id)``. Whole epochs take every document; of the last one the
longest prefix that stays within the rest of the budget is taken. The prefix is
found without ordering a leaf in one task: its documents fall into about
``sqrt(n)`` ranges of the hash, the ranges' totals give each range its start,
and rows are ordered inside a range only.

Defined results: null text counts as empty (0 tokens); null lang or source is
the leaf ``(none)``; a null doc_id orders as the empty text; repeated rows count
each on its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import pin, row_keys

LEVELS = ["domain", "lang", "source"]
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"


def default_domain(source: Column) -> Column:
    """Four domains of sources, from the source's name (a table of sources would give its own)."""
    return F.concat(F.lit("d"), F.pmod(F.conv(F.substring(F.md5(source), 1, 2), 16, 10).cast("int"), F.lit(4)).cast("string"))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    given = weights.get(level) or {}
    w = F.lit(1)
    for name, value in given.items():
        if int(value) != value or value < 0:
            raise ValueError("weights are whole numbers of at least 0")
        w = F.when(F.col(level) == name, F.lit(int(value))).otherwise(w)
    return w.cast("bigint")


def water_fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share ``budget`` (one value per parent) among siblings by ``weight`` up to ``cap``: adds ``own``.

    Siblings stand in order of cap / weight. As long as the first of them cannot
    take its share of what is left, it is filled; the rest share by weight.
    """
    sib = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    # order only; the filling itself is in whole numbers
    ratio = F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight").cast("double")).otherwise(F.lit(1e300))
    turn = sib.orderBy("ratio", name)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    n = (nodes.withColumn("ratio", ratio)
         .withColumn("filled", F.coalesce(F.sum("cap").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("left", F.greatest(F.col("budget") - F.col("filled"), F.lit(0)))
         .withColumn("ahead", F.sum("weight").over(turn.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
         .withColumn("full", big("cap") * F.col("ahead").cast("decimal(18,0)") <= big("left") * F.col("weight").cast("decimal(18,0)"))
         .withColumn("at", F.row_number().over(turn))
         .withColumn("open", F.min(F.when(~F.col("full"), F.struct("at", "left", "ahead"))).over(sib)))
    n = n.withColumn("open_left", F.col("open.left").cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)")) \
         .withColumn("open_ahead", F.greatest(F.col("open.ahead"), F.lit(1)).cast("decimal(20,0)"))
    own = F.when(F.col("open").isNull() | (F.col("at") < F.col("open.at")), F.col("cap")).otherwise(F.expr("open_left div open_ahead"))
    return n.withColumn("own", own.cast("bigint")).drop("ratio", "filled", "left", "ahead", "full", "at", "open", "open_left", "open_ahead")


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens, docs) with ``budget`` added.

    The target is ``share[0] / share[1]`` of all tokens, rounded down.
    """
    leaves = leaves.withColumn("cap", F.col("tokens") * F.lit(max_epochs))
    above: DataFrame | None = None
    for depth in range(1, len(LEVELS) + 1):
        path, parent, name = LEVELS[:depth], LEVELS[:depth - 1], LEVELS[depth - 1]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(name, weights))
        if above is None:
            total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("budget", F.floor(total / F.lit(share[1])).cast("bigint") * F.lit(share[0])
                                     + F.floor(F.pmod(total, F.lit(share[1])) * F.lit(share[0]) / F.lit(share[1])).cast("bigint"))
        else:
            nodes = nodes.join(above, parent)
        above = water_fill(nodes, parent, name).select(*path, F.col("own").alias("budget"))
    return leaves.join(above, LEVELS)


def _draw(seed: int, epoch: Column) -> Column:
    # a row without an id is drawn by its text, so that such rows spread over the ranges
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("__k2").cast("string")))
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), own))


def mix(docs: DataFrame, weights: Mapping[str, Mapping[str, int]] | None = None, share: tuple[int, int] = (1, 2),
        max_epochs: int = 3, seed: int = 7, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per selected (document, epoch): doc_id, its row keys, domain, lang, source, epoch,
    n_tokens, leaf_tokens, leaf_budget."""
    src = F.col(f"`{source_col}`")
    slim = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), *row_keys(id_col, text_col),
        F.coalesce(default_domain(src) if domain is None else domain, F.lit(NONE)).alias("domain"),
        F.coalesce(F.col(f"`{lang_col}`"), F.lit(NONE)).alias("lang"), F.coalesce(src, F.lit(NONE)).alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_tokens"))
    rows = pin(slim.withColumn("uid", F.monotonically_increasing_id()), "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    plan = leaf_budgets(leaves, weights or {}, share, max_epochs)
    # whole epochs, and the budget left for the epoch after them
    plan = pin(plan.withColumn("whole", F.expr("if(tokens > 0, least(budget div tokens, cap div tokens), 0)").cast("bigint"))
               .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
               .withColumn("ranges", F.ceil(F.sqrt("docs")).cast("bigint"))
               .select(*LEVELS, F.col("tokens").alias("leaf_tokens"), F.col("budget").alias("leaf_budget"), "whole", "rest", "ranges"),
               "mix-leaves")
    keyed = (rows.join(plan, LEVELS).withColumn("draw", _draw(seed, F.col("whole")))
             .withColumn("range", F.expr("(cast(conv(substring(draw, 1, 8), 16, 10) as bigint) * ranges) div 4294967296")))
    place = [*LEVELS, "range"]
    totals = keyed.groupBy(*place).agg(F.sum("n_tokens").alias("in_range"))
    before = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*place, F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*place).orderBy("draw", "doc_id", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = (keyed.withColumn("upto", F.sum("n_tokens").over(inside)).join(starts, place)
             .withColumn("copies", F.col("whole") + F.when((F.col("start") + F.col("upto") <= F.col("rest")) & (F.col("rest") > 0), 1).otherwise(0))
             .filter("copies > 0"))
    return taken.select("doc_id", "__k1", "__k2", *LEVELS, F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("epoch"),
                        "n_tokens", "leaf_tokens", "leaf_budget")


def mix_rows(docs: DataFrame, *args, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` with their own columns, each as often as it is selected.

    What is selected of rows that repeat id and text is shared out among them.
    """
    picked = mix(docs, *args, id_col=id_col, text_col=text_col, **params)
    times = picked.groupBy("__k1", "__k2").agg(F.count(F.lit(1)).alias("__times"))
    same = Window.partitionBy("__k1", "__k2")
    hit = (docs.select("*", *row_keys(id_col, text_col)).join(times, ["__k1", "__k2"])
           .withColumn("__there", F.count(F.lit(1)).over(same)).withColumn("__nth", F.row_number().over(same.orderBy(F.lit(1))))
           .withColumn("__own", F.expr("__times div __there + if(__nth <= __times % __there, 1, 0)")).filter("__own > 0"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return hit.select(*own, F.explode(F.sequence(F.lit(1), F.col("__own").cast("int"))).alias("__copy")).select(*own)
