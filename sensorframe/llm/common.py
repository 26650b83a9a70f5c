"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.runtime import materialize

__all__ = ["WordHashes", "components", "materialize", "mix", "ordered", "table", "texts_of", "unclashed", "words_of"]

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
WORDS_KEPT = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for the words met lately."""

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def texts_of(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased words between ASCII white space; none for a null text."""
    return text.lower().split() if text else []


def ordered(a: str, b: str) -> list:
    """Two columns of a pair as (larger ``a``, smaller ``b``)."""
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def unclashed(df: DataFrame, wanted: list[str]) -> str:
    """A column name that ``df`` and ``wanted`` don't hold, for a temporary column."""
    taken = {c.lower() for c in [*df.columns, *wanted]}
    name = "_tmp"
    while name in taken:
        name += "_"
    return name


def _stored_edges(df: DataFrame) -> DataFrame:
    return materialize(df.distinct(), "edges")


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components: columns ``node`` and ``component`` (the smallest node) from links ``a``, ``b``.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): every node is linked to the smallest
    neighbour it knows until only stars are left.  Each step is an aggregate with map-side combine and a join whose
    hot keys adaptive execution can split; edges live in the shared folder, so lost executors cost a file read.
    Nodes without a link to another node are absent.
    """
    spark = edges.sparkSession
    now = _stored_edges(edges.where("a <> b").select(*ordered("a", "b")))
    seen = _fingerprint(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = _stored_edges(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = _stored_edges(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b")))
        )
        before, seen = seen, _fingerprint(now)
        if before == seen:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct()) if seen[0] else spark.createDataFrame([], stars.schema)
