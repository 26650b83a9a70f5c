"""A corpus cleaning pipeline: toxicity, near duplicates, benchmark leaks, personal data, packing.

Each stage takes all that its predecessor kept and returns it as Parquet-ready rows; all but the last return the
columns of ``documents``.  Null and empty texts pass every filter; see the operators for each case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sensorframe.llm import minhash, packing, pseudonyms, tiling, toxicity
from sensorframe.llm.common import materialize, table
from sensorframe.runtime import ship


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones among them, scores below one half."""
    ship(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies (five words, 0.8)."""
    ship(spark)
    return minhash.keep_first(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, in order or not."""
    ship(spark)
    return tiling.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses replaced within their formats; ``n_chars`` follows the text."""
    ship(spark)
    return pseudonyms.pseudonymise(docs, length="n_chars" if "n_chars" in docs.columns else None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("pii", with_pseudonyms),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
