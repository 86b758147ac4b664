"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, source mixing, best-fit packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``docs``.

``ORACLE_SQL`` is None: fingerprints, character models and byte-pair ids have no
SQL form; the tests hold every stage against a brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import exact_dedup, language_id, mixing, packing, simhash_dedup
from riskframe.llm.common import pin, table
from riskframe.llm.queries import MIX_WEIGHTS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays."""
    return exact_dedup.keep_one_of_each(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a component of fingerprints within 3 bits the row with the smallest doc_id stays."""
    return simhash_dedup.keep_one_of_each(docs, shingle=3, radius=3, seed=42)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as come in, dealt by the target weights; a document read in k epochs has k rows."""
    return mixing.mix_rows(docs, MIX_WEIGHTS, share=(1, 1), max_epochs=2, seed=7)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece."""
    return packing.best_fit_pack(docs, capacity=1024, end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
