"""Token counts kept up to date by signed deltas.

A store is a folder with two additive tables, one sub-folder per batch in each: ``ledger`` has, for each document and
version, the signed tokens and characters a batch added or took; ``totals`` has the batch's sums by source, language
and tokenizer version.  Current totals are the sum over all batches, so texts are never counted again; a commit reads
the ledgers of all earlier batches to look up what it deletes or revises.

``commit`` takes changes (``op`` of insert, delete or revise, and the document's fields).  Deletes and revisions look
up what the ledger holds of the document, and take exactly that away.  A batch is committed by the success mark that
Spark writes last into its ``totals`` folder; committing a batch id again does nothing, and a half-written batch is
written again from the start, so a retry after any crash is safe.

Defined results: deleting an unknown document changes nothing; inserting a known one revises it; within one batch the
last change of a document in the order of ``step`` holds, ties by the larger count.  Rows with a null id are always
counted anew and can't be taken back.  Null source or language is a
group of its own.  Empty changes commit an empty batch.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm.common import materialize
from sensorframe.runtime import scratch_path

ENTRY = "doc_id long, source string, lang string, version string, documents long, tokens long, chars long"
GROUP = ["source", "lang", "version"]
SUMS = ["documents", "tokens", "chars"]


def space_tokens(text: Column) -> Column:
    """Version ``space-1``: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def class_tokens(text: Column) -> Column:
    """Version ``class-2``: runs of letters, runs of digits, and every other visible character by itself."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{M}]+|\p{Nd}+|[^\p{L}\p{M}\p{Nd}\x00-\x20]")), F.lit(0)).cast("long")


class Store:
    """Ledger and totals of one corpus, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or scratch_path(spark, "token-counts")

    def _path(self, name: str, batch: str) -> str:
        return f"{self.folder}/{name}/batch={batch}"

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._files().exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))

    def committed(self) -> list[str]:
        """Ids of the committed batches."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/totals")
        if not self._files().exists(path):
            return []
        names = [s.getPath().getName() for s in self._files().listStatus(path)]
        return sorted(n.removeprefix("batch=") for n in names if self._exists(f"{self.folder}/totals/{n}/_SUCCESS"))

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = [self._path(name, b) for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """What is held of each document now."""
        held = self._read("ledger", ENTRY).groupBy("doc_id", *GROUP).agg(*(F.sum(c).alias(c) for c in SUMS))
        return held.where("documents <> 0 or tokens <> 0 or chars <> 0")

    def totals(self) -> DataFrame:
        """``source, lang, version, documents, tokens, chars`` now; groups without documents are absent."""
        rows = self._read("totals", ENTRY.partition(", ")[2])
        return rows.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS)).where("documents <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (``op, step, doc_id, source, lang, version, tokens, chars``) once; False if done before."""
        if batch in self.committed():
            return False
        order = F.struct("step", "tokens", "chars", "op", "source", "lang", "version")
        known = changes.where("doc_id is not null").groupBy("doc_id").agg(F.max(order).alias("c")).select("doc_id", "c.*")
        loose = changes.where("doc_id is null and op <> 'delete'").select("doc_id", *order_columns())
        last = materialize(known.select("doc_id", *order_columns()).union(loose), "changes")
        added = last.where("op <> 'delete'").select("doc_id", *GROUP, F.lit(1).cast("long").alias("documents"), "tokens", "chars")
        taken = self.ledger().join(last.where("doc_id is not null").select("doc_id"), "doc_id", "left_semi")
        taken = taken.select("doc_id", *GROUP, *((-F.col(c)).alias(c) for c in SUMS))
        self._write(added.union(taken), "ledger", batch)
        written = self.spark.read.schema(ENTRY).parquet(self._path("ledger", batch))
        self._write(written.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS)), "totals", batch)
        return True

    def _write(self, df: DataFrame, name: str, batch: str) -> None:
        df.write.mode("overwrite").parquet(self._path(name, batch))


def order_columns() -> list[str]:
    return ["step", "op", *GROUP, "tokens", "chars"]


def counted(docs: DataFrame, version: str, tokens: Column, op: str = "insert", step: int = 0) -> DataFrame:
    """Changes that count each row of ``docs`` (``doc_id, text, source, lang``) by a tokenizer version."""
    return docs.select(F.lit(op).alias("op"), F.lit(step).alias("step"), F.col("doc_id").cast("long"), "source", "lang", F.lit(version).alias("version"),
                       tokens.alias("tokens"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))


def corpus_history(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Totals after four batches over a corpus: a load by ``space-1``, a recount of all but English by ``class-2``,
    the removal of documents under 200 characters, and the recount sent again (which must change nothing)."""
    store = Store(spark)
    recount = counted(docs.where("lang is null or lang <> 'en'"), "class-2", class_tokens(F.col("text")), "revise")
    store.commit("1-load", counted(docs, "space-1", space_tokens(F.col("text"))))
    store.commit("2-recount", recount)
    store.commit("3-short", counted(docs.where("coalesce(length(text), 0) < 200"), "", F.lit(0).cast("long"), "delete"))
    store.commit("2-recount", recount)
    return store.totals()


HISTORY_SQL = r"""
    WITH counted AS (SELECT source, lang, CASE WHEN lang IS NULL OR lang <> 'en' THEN 'class-2' ELSE 'space-1' END AS version,
      CASE WHEN lang IS NULL OR lang <> 'en' THEN len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}]+|\p{Nd}+|[^\p{L}\p{M}\p{Nd}\x00-\x20]'))
        ELSE len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) END AS tokens, length(coalesce(text, '')) AS chars
      FROM documents WHERE length(coalesce(text, '')) >= 200)
    SELECT source, lang, version, count(*) AS documents, sum(tokens)::BIGINT AS tokens, sum(chars)::BIGINT AS chars FROM counted GROUP BY ALL"""
