"""Exact parallel evaluation of an order-dependent scan.

A greedy scan (tracker, fuser) carries state from row to row, so one key looks
like one serial task.  Here each key is cut into chunks of bounded extent and
all chunks run at once:

1. every chunk starts cold, first replaying a short warm-up copied from the
   chunk before it, which usually reproduces the true state at its boundary;
2. each chunk reports the state it *used* at its start and the state it left at
   its *end*; the two are compared along the chain of chunks;
3. chunks that used a wrong state are run again from the reported one.  Every
   run is kept as one entry of the chunk's map from entry to exit state, and the
   maps are composed along the chain by pointer doubling.

The first chunk of a key has nothing before it and is right; a chunk whose
predecessor is right and whose used state equals that predecessor's end is
right.  Each round therefore settles at least one more chunk of every key that
still disagrees, and the result equals the serial scan whatever the data.
Where a boundary has few possible states, as in steady data that never falls
back into step, two or three rounds run them all.

Rows of a round are written to the shared folder, so a lost executor costs a
file read and the comparison reads only the small summary partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import few, materialize, task_count

SUMMARY = "summary"
STATE_BYTES = 16 << 20  # of entry states of one round; more are not sent to every task
SUMMARY_FIELDS = [
    T.StructField("used_state", T.StringType()),
    T.StructField("end_state", T.StringType()),
    T.StructField("order_mattered", T.BooleanType()),
]


def nullable(schema: T.StructType) -> list[T.StructField]:
    """Kernel outputs mix row kinds, so every payload field may be null."""
    return [T.StructField(f.name, f.dataType) for f in schema]


def changes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """True where a row's key differs (null-safe) from the row above; True for row 0."""
    flags = np.zeros(table.num_rows, dtype=bool)
    flags[:1] = True
    for k in keys:
        col = table.column(k).combine_chunks()
        a, b = col.slice(1), col.slice(0, len(col) - 1)
        differs = pc.or_(
            pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b))
        )
        flags[1:] |= differs.to_numpy(zero_copy_only=False)
    return flags


def run_chunks(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: T.StructType,
    name: str,
    grouped: bool = False,
) -> DataFrame:
    """One pass of ``kernel`` over ``rows`` (with ``_chunk``/``_own``/``_init``), written by ``kind``.

    ``grouped``: chunks come one after another, in any order, each with its rows in theirs and numbered from 1 by
    ``_place``; rows bucketed by chunk then don't shuffle.
    """
    chunk_keys = [*keys, "_chunk"]
    if grouped:
        return materialize(_placed(rows, chunk_keys, order).mapInArrow(kernel, schema), name, partition_by=["kind"])
    # a fixed number: a kernel's work doesn't follow the bytes by which adaptive execution would join partitions
    parts = task_count(rows.sparkSession)
    laid_out = rows.repartition(parts, *[F.col(k) for k in chunk_keys]).sortWithinPartitions(*chunk_keys, *order)
    return materialize(laid_out.mapInArrow(kernel, schema), name, partition_by=["kind"])


def _placed(rows: DataFrame, chunk_keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*chunk_keys).orderBy(*order)))


def _match(a: DataFrame, b: DataFrame, keys: Sequence[str]):
    cond = None
    for k in keys:
        c = a[k].eqNullSafe(b[k])
        cond = c if cond is None else cond & c
    return cond


def replace_chunks(done: DataFrame, again: DataFrame, redo: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``done`` without the chunks in ``redo``, plus their new rows ``again``."""
    stale = redo.select(*keys, "_chunk").distinct()
    kept = done.join(stale, _match(done, stale, [*keys, "_chunk"]), "left_anti")
    return kept.unionByName(again)


def _sorted_state(c):
    return F.array_join(F.array_sort(F.split(c, ";")), ";")


def _digest(c):
    """What tells states apart (as sets) in 64 letters: a state may name thousands of rows, and Parquet files of states are
    so much smaller than the states that Spark would send them to every task."""
    return F.sha2(_sorted_state(c), 256)


def _disagree(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks whose used state differs (as a set) from their predecessor's end state, without states."""
    summary = results.filter(F.col("kind") == SUMMARY)
    mine = summary.select(*keys, "_chunk", _digest(F.col("used_state")).alias("_used")).alias("mine")
    before = summary.select(
        *[F.col(k).alias(f"_p_{k}") for k in keys], (F.col("_chunk") + 1).alias("_next"), _digest(F.col("end_state")).alias("_end")
    )
    cond = mine["_chunk"] == before["_next"]
    for k in keys:
        cond = cond & mine[k].eqNullSafe(before[f"_p_{k}"])
    expected = F.coalesce(F.col("_end"), _digest(F.lit("")))
    return mine.join(before, cond, "left").filter(F.col("_used") != expected).select(*keys, "_chunk")


def disagreeing(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks whose used state differs (as a set) from their predecessor's end state, with that state as ``_init``."""
    todo = _disagree(results, keys)
    before = results.filter(F.col("kind") == SUMMARY).select(
        *[F.col(k).alias(f"_p_{k}") for k in keys], (F.col("_chunk") + 1).alias("_next"), "end_state"
    )
    cond = todo["_chunk"] == before["_next"]
    for k in keys:
        cond = cond & todo[k].eqNullSafe(before[f"_p_{k}"])
    return todo.join(before.hint("merge"), cond, "left").select(*[todo[k] for k in keys], todo["_chunk"], F.coalesce("end_state", F.lit("")).alias("_init"))


def rerun(
    rows: DataFrame, redo: DataFrame, keys: Sequence[str], order, kernel, schema, name: str, grouped: bool = False
) -> DataFrame:
    """Run the chunks in ``redo`` again from the state in its ``_init``."""
    todo = redo.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_chunk").alias("_r_chunk"), "_init")
    cond = rows["_chunk"] == todo["_r_chunk"]
    for k in keys:
        cond = cond & rows[k].eqNullSafe(todo[f"_r_{k}"])
    if grouped:
        # a state may name thousands of rows: only the first row of a chunk carries it
        again = _placed(rows.drop("_init").join(few(todo.drop("_init")), cond, "left_semi"), [*keys, "_chunk"], order)
        told = todo.withColumn("_r_place", F.lit(1))
        size = todo.agg(F.sum(F.octet_length("_init"))).first()[0] or 0
        on = reduce(lambda a, b: a & b, [again[k].eqNullSafe(told[f"_r_{k}"]) for k in keys])
        on = on & (again["_chunk"] == told["_r_chunk"]) & (again["_place"] == told["_r_place"])
        fed = again.join(F.broadcast(told) if size <= STATE_BYTES else told.hint("merge"), on, "left").select(*again.columns, "_init")
        if size > STATE_BYTES:
            fed = fed.repartition(task_count(rows.sparkSession), *keys, "_chunk").sortWithinPartitions(*keys, "_chunk", "_place")
        return materialize(fed.mapInArrow(kernel, schema), name, partition_by=["kind"])
    fed = rows.drop("_init").join(todo, cond, "inner").select(*rows.drop("_init").columns, "_init")
    return run_chunks(fed, keys, order, kernel, schema, name, grouped)


def outcome(results: DataFrame, keys: Sequence[str], also: dict[str, DataFrame] | None = None) -> set[str]:
    """Which of the named follow-ups have work, found in one small job.

    ``disagree`` is always checked; ``also`` names further tables to test for rows.
    """
    checks = {"disagree": _disagree(results, keys), **(also or {})}
    parts = [df.select(F.lit(name).alias("name")) for name, df in checks.items()]
    found = reduce(DataFrame.unionAll, parts).groupBy("name").agg(F.count("*").alias("n"))
    return {r["name"] for r in found.collect()}  # one row per check


def _runs(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per run of a chunk (``_run``), with digests of its entry and exit state."""
    summary = results.filter(F.col("kind") == SUMMARY)
    return summary.select(
        *keys, F.to_json(F.struct(*keys)).alias("_key"), "_chunk", "_run",
        _digest(F.coalesce("used_state", F.lit(""))).alias("_in"), _digest(F.coalesce("end_state", F.lit(""))).alias("_out"),
    )


def _chained(runs: DataFrame, name: str) -> DataFrame:
    """Adds ``_next`` (the run of the next chunk that this one leads to) and ``_true`` (reached from a key's start).

    Runs of a chunk are its map from entry state to exit state; the maps of all chunks are composed by pointer
    doubling, so a chain of n chunks takes log2(n) joins of these small tables.
    """
    after = runs.groupBy("_key", (F.col("_chunk") - 1).alias("_chunk"), F.col("_in").alias("_out")).agg(F.min("_run").alias("_next"))
    chunks = runs.select("_key", "_chunk").distinct()
    begun = chunks.select("_key", (F.col("_chunk") + 1).alias("_chunk"), F.lit(True).alias("_has_before"))
    now = runs.join(after, ["_key", "_chunk", "_out"], "left").join(begun, ["_key", "_chunk"], "left")
    now = now.withColumn("_true", F.col("_has_before").isNull()).withColumns({"_jump": F.col("_next"), "_far": F.col("_chunk") + 1})
    now = materialize(now.drop("_has_before"), f"{name}-chain")
    longest = chunks.groupBy("_key").agg((F.max("_chunk") - F.min("_chunk") + 1).alias("n")).agg(F.max("n")).first()[0]
    for _ in range(int(longest).bit_length()):
        hit = now.filter("_true AND _jump IS NOT NULL").select("_key", F.col("_far").alias("_chunk"), F.col("_jump").alias("_run"), F.lit(True).alias("_hit")).distinct()
        onward = now.select("_key", F.col("_chunk").alias("_far"), F.col("_run").alias("_jump"), F.col("_jump").alias("_jump2"), F.col("_far").alias("_far2"))
        now = now.join(hit, ["_key", "_chunk", "_run"], "left").join(onward, ["_key", "_far", "_jump"], "left")
        now = now.withColumns({"_true": F.col("_true") | F.col("_hit").isNotNull(), "_jump": F.col("_jump2"), "_far": F.coalesce("_far2", "_far")})
        now = materialize(now.drop("_hit", "_jump2", "_far2"), f"{name}-chain")
    return now


def _unreached(chain: DataFrame, keys: Sequence[str], init: str) -> DataFrame:
    settled = chain.groupBy("_key", "_chunk").agg(F.max("_true").alias("_settled"), F.first(F.struct(*keys)).alias("_k")).filter("NOT _settled")
    return settled.select(*[F.col("_k")[k].alias(k) for k in keys], "_chunk", F.lit(init).alias("_init"))


def _to_run(chain: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks not reached yet whose predecessor has a run that leads to none of theirs: one entry state for each."""
    unreached = chain.groupBy("_key", "_chunk").agg(F.max("_true").alias("_settled")).filter("NOT _settled").select("_key", "_chunk")
    leading = chain.filter("_next IS NULL").groupBy("_key", (F.col("_chunk") + 1).alias("_chunk")).agg(
        F.max_by("_run", F.struct("_true", "_run")).alias("_run"), F.first(F.struct(*keys)).alias("_k"))
    todo = leading.join(unreached, ["_key", "_chunk"], "left_semi")
    summary = runs.filter(F.col("kind") == SUMMARY)
    states = summary.select(F.to_json(F.struct(*keys)).alias("_key"), (F.col("_chunk") + 1).alias("_chunk"), "_run", F.coalesce("end_state", F.lit("")).alias("_init"))
    found = todo.join(states.hint("merge"), ["_key", "_chunk", "_run"])
    return found.select(*[F.col("_k")[k].alias(k) for k in keys], "_chunk", "_init")


def settle(
    rows: DataFrame, results: DataFrame, keys: Sequence[str], order, kernel, schema, name: str,
    also: Callable[[DataFrame], dict[str, DataFrame]] | None = None, variant: str | None = None, grouped: bool = False,
) -> tuple[DataFrame, set[str]]:
    """Re-run disagreeing chunks until every chunk used its predecessor's end state.

    All runs of a chunk are kept, each with the entry state it used, until they can be chained.  So a chunk that two
    rounds have run from two states is done with both, whichever turns out to be the true one.  ``variant`` is an
    ``_init`` with which the kernel warms up in another way; where one round doesn't settle all, it gives every chunk
    not reached a second entry state at once.
    Returns the settled results and which of the ``also`` tables have rows.
    """
    found = outcome(results, keys, also(results) if also else None)
    if "disagree" not in found:
        return results, found
    runs, todo, round_no = results.withColumn("_run", F.lit(0)), disagreeing(results, keys), 0
    while True:
        redo = materialize(todo, f"{name}-redo")
        if round_no and redo.isEmpty():
            break
        round_no += 1
        again = rerun(rows, redo, keys, order, kernel, schema, f"{name}-round{round_no}", grouped)
        runs = runs.unionByName(again.withColumn("_run", F.lit(round_no)))
        chain = _chained(_runs(runs, keys), name)
        todo = _to_run(chain, runs, keys)
        if round_no == 1 and variant is not None:
            todo = _unreached(chain, keys, variant)
    # the runs stay where they are: which of them don't count is a short list, so nothing is written or moved again
    other = few(chain.filter("NOT _true").select(*keys, "_chunk", "_run"))
    settled = runs.join(other, _match(runs, other, [*keys, "_chunk", "_run"]), "left_anti").drop("_run")
    return settled, outcome(settled, keys, also(settled) if also else None)
