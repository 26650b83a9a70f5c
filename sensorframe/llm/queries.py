"""Registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm import chat, hosts, lattice, minhash, negatives, packing, pseudonyms, rollups, secrets, spelling, tiling, toxicity, zipwarc
from sensorframe.llm.common import table


def op1_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, count="n_values")


def op3_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return hosts.judge(table(spark, sf_dir, "pages"), outcomes)


def op4_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.corpus_history(spark, table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op6_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op8_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zipwarc.round_trip(table(spark, sf_dir, "pages"))


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op11_reduced_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.windows(chat.with_control(table(spark, sf_dir, "conversations"))))


def op13_hilbert_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("vec_id") % 100 == 0)


OPERATORS = (
    op1_bm25_packing, op2_feistel, op3_reputation, op4_rollups, op5_minhash, op6_factorization, op7_novelty, op8_tiling, op9_zip_warc, op10_lattice,
    op11_reduced_alphabet, op12_budgeted_windows, op13_hilbert_negatives,
)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLES = {
    "op3_reputation": hosts.judge_sql(),
    "op4_rollups": rollups.HISTORY_SQL,
    "op9_zip_warc": zipwarc.ROUND_TRIP_SQL,
    "op11_reduced_alphabet": spelling.SPELLING_SQL,
    "op12_budgeted_windows": chat.DIGESTS_SQL,
    "op13_hilbert_negatives": negatives.HARD_NEGATIVES_SQL,
}
