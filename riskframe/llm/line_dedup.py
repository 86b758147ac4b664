"""Line dedup (12): levelled sorted runs of line hashes, compacted periodically. DataFrame functions only.

A run is a table of (h1, h2, n, keep), one entry per line hash: in how many
documents it was found and the largest identifier among them. It is bucketed
and sorted by hash, so a batch that is dealt the same way meets it in a merge
join and only the batch moves. Batches come in falling order of identifier:
each aggregates its lines, merge-anti-joins the settled entries of every run
(found in ``min_docs`` documents already; a smaller identifier changes nothing
about them) and adds what is left as a run of level 0. ``fan`` runs of a level
are compacted into one of the next. In the end all runs are merged, and a
frequent line goes from every document but the one with its largest identifier.

A line found in a third of the documents is one entry per task before it is
shuffled; where its places meet the frequent lines, AQE splits the join. Texts
are read twice and moved once.

Defined results: null text is one empty line; every row is a document of its
own, so repeated rows count each; rows that share the largest identifier all
keep the line; a null identifier is smaller than any other, and a line that
only such rows hold stays in all of them; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import delete_path, pin, row_keys, scratch_path
from riskframe.session import shuffle_partitions

HASH = ["h1", "h2"]
EDGES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def ascii_lower(text: Column) -> Column:
    """Only A-Z lower-cased; text of one byte a character takes the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(__k1, __k2, doc_id, cells): the sorted (h1, h2, pos) of every line of ``min_chars`` or more; documents without one are left out."""
    text = F.col(f"`{text_col}`")
    keys = F.transform(lines(ascii_lower(text)), lambda x, i: F.struct(F.btrim(x, F.lit(EDGES)).alias("key"), i.alias("pos")))
    long = F.filter(keys, lambda c: F.length(c["key"]) >= min_chars)
    hashed = F.transform(long, lambda c: F.struct(F.xxhash64(c["key"]).alias("h1"), F.xxhash64(F.lit(1), c["key"]).alias("h2"), c["pos"].alias("pos")))
    return docs.select(*row_keys(id_col, text_col), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                       F.sort_array(hashed).alias("cells")).filter(F.size("cells") > 0)


def documents_of_lines(cells: DataFrame) -> DataFrame:
    """(h1, h2, n, keep): the documents of every line hash, each counted once, and the largest identifier."""
    fresh = lambda i: (i == 0) | (F.get("cells", i - 1)["h1"] != F.get("cells", i)["h1"]) | (F.get("cells", i - 1)["h2"] != F.get("cells", i)["h2"])
    once = F.filter("cells", lambda c, i: fresh(i))
    return (cells.select("doc_id", F.explode(once).alias("c")).groupBy(F.col("c.h1").alias("h1"), F.col("c.h2").alias("h2"))
            .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")))


class LineRuns:
    """Levels of sorted runs; batches are added in falling order of identifier."""

    def __init__(self, spark: SparkSession, min_docs: int, fan: int) -> None:
        self.spark, self.min_docs, self.fan = spark, min_docs, fan
        self.buckets = shuffle_partitions(spark)  # as a shuffle of the batch deals, so that runs stay in place
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, entries: DataFrame, level: int) -> None:
        name, path = f"line_run_{uuid.uuid4().hex}", scratch_path(self.spark, f"line-run-{level}")
        entries.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).format("parquet").saveAsTable(name)
        self.paths[name] = path
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_path(self.spark, self.paths.pop(name))

    def _merged(self, names: list[str]) -> DataFrame:
        # read as plain files: Spark 4.1 takes a union of bucketed tables for bucketed, yet reads its parts one after the other
        runs = [self.spark.read.schema("h1 bigint, h2 bigint, n bigint, keep bigint").parquet(self.paths[x]) for x in names]
        both = runs[0]
        for r in runs[1:]:
            both = both.unionByName(r)
        return both.groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("keep").alias("keep"))

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join a batch's entries with the settled ones of every run and add the rest."""
        for name in (x for level in self.levels for x in level):
            settled = self.spark.table(name).filter(F.col("n") >= self.min_docs).select(*HASH)
            batch = batch.join(settled.hint("merge"), HASH, "left_anti")
        self._write(batch, 0)
        level = 0
        while len(self.levels[level]) >= self.fan:
            old = self.levels[level]
            self._write(self._merged(old), level + 1)
            self.levels[level] = []
            self._drop(old)
            level += 1

    def frequent(self) -> DataFrame:
        """(h1, h2, keep) of the lines found in ``min_docs`` documents or more, written; the runs are deleted."""
        names = [x for level in self.levels for x in level]
        found = pin(self._merged(names).filter(F.col("n") >= self.min_docs).select(*HASH, "keep"), "frequent-lines")
        self._drop(names)
        self.levels = []
        return found


def _batch_number(docs: DataFrame, id_col: str, batches: int) -> Column:
    """0 for the largest identifiers; equal identifiers share a batch and unknown ones are in the last."""
    i = F.col(f"`{id_col}`").cast("bigint")
    cuts = docs.agg(F.percentile_approx(i, [k / batches for k in range(1, batches)], 1000).alias("cuts")).first()["cuts"] if batches > 1 else []
    number = F.lit(0)
    for c in sorted(set(cuts or [])):
        number = number + (F.col("doc_id") <= F.lit(c)).cast("int")
    return F.coalesce(number, F.lit(len(set(cuts or []))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3,
                batches: int = 6, fan: int = 3) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_text."""
    spark = docs.sparkSession
    cells = line_hashes(docs, id_col, text_col, min_chars).withColumn("batch", _batch_number(docs, id_col, batches))
    cells = pin(cells, "line-cells", by="batch")
    runs = LineRuns(spark, min_docs, fan)
    for b in range(batches):
        runs.add(documents_of_lines(cells.filter(F.col("batch") == b)))
    frequent = runs.frequent()

    places = cells.select("__k1", "__k2", "doc_id", F.inline("cells"))
    gone = (places.join(frequent, HASH).filter(~F.col("doc_id").eqNullSafe(F.col("keep")))
            .groupBy("__k1", "__k2").agg(F.collect_set("pos").alias("gone")))  # at most the lines of one document
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("whole"), *row_keys(id_col, text_col)).join(gone, ["__k1", "__k2"], "left")
    out = out.withColumn("parts", lines(F.col("whole")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n"))
    return out.select("doc_id", F.size("parts").cast("bigint").alias("n_lines"),
                      F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept_text"))
