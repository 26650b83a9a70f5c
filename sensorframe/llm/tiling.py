"""Benchmark decontamination by greedy string tiling.

Seeds are the hashed windows of ``least`` words of every benchmark item (the whole item where it is shorter).  They
are dealt out in blocks of bounded size, one pass over the documents for each block, and every word window of every
document is looked up in the block's seeds.  A document and an item that share a seed are tiled: the longest match that
overlaps no earlier one is marked, again and again, by running Karp-Rabin hashes of shrinking window lengths, until no
match of ``least`` words is left.  Tiles may come in any order, so a passage with its sentences reordered is caught.
A pair is reported where the tiles cover at least ``coverage`` of the item's words.

The corpus is never shuffled; what a task holds is one block of seeds (``BLOCK_WORDS``), and one text.

Words are runs of letters and digits, case folded, so punctuation and layout don't hide a copy.  Defined results: null
or empty texts and items match nothing; items with equal words are all reported; repeated rows of a document are
reported once; null ids are reported as null.  Extra columns are ignored by ``leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.llm.common import GOLDEN, WordHashes, mix, unclashed

WORD = re.compile(r"[^\W_]+")
LEAST, COVERAGE = 6, 0.6
BLOCK_WORDS = 2_000_000
FOUND = "item_id long, item_words long, n_tiles long, covered long, coverage double, longest long"


def word_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    return np.array([hashes[w] for w in WORD.findall((text or "").casefold())], np.uint64)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``n`` words, by prefix sums modulo 2**64, then mixed.

    A window's sum of word * base**position is brought to position 0 by the inverse power (the base is odd).
    """
    if len(words) < n or n == 0:
        return np.empty(0, np.uint64)
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    ups, downs = _powers(base, len(words)), _powers(inverse, len(words))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + GOLDEN) * ups, dtype=np.uint64)])
    return mix((total[n:] - total[:-n]) * downs[: len(words) - n + 1] + np.uint64(n))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _matches(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Unmarked matches of at least ``length`` words as (-words, begin in a, begin in b), each extended to the right."""
    places = defaultdict(list)
    for j, key in enumerate(window_hashes(b, length).tolist()):
        if free_b[j : j + length].all():
            places[key].append(j)
    keys = window_hashes(a, length)
    hits = np.flatnonzero(np.isin(keys, np.fromiter(places, np.uint64, len(places))))
    out = []
    for i in hits.tolist():
        for j in places[int(keys[i])]:
            k = length
            if not (free_a[i : i + k].all() and (a[i : i + k] == b[j : j + k]).all()):
                continue
            while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                k += 1
            out.append((-k, i, j))
    return out


def tile(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiles (begin in ``a``, begin in ``b``, words) of a text and a pattern.

    The window is halved from the pattern's length down to ``least``.  At each length matches are taken longest first;
    one that an earlier tile has cut is looked up anew at the same length, until none is left there.
    """
    free_a, free_b, tiles = np.ones(len(a), bool), np.ones(len(b), bool), []
    least = min(least, len(b))
    length = len(b)
    while length:
        for k, i, j in sorted(_matches(a, b, free_a, free_b, length)):
            if free_a[i : i - k].all() and free_b[j : j - k].all():
                free_a[i : i - k] = free_b[j : j - k] = False
                tiles.append((i, j, -k))
            elif free_a[i : i + length].all() and free_b[j : j + length].all():
                break  # what is left of it is long enough, but no longer the next longest
        else:
            length = max(least, length // 2) if length > least else 0
    return sorted(tiles)


class Block:
    """Seeds of some items, and the items' words."""

    def __init__(self, items: list[tuple[int, np.ndarray]], least: int):
        self.items = items
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        grouped = defaultdict(lambda: ([], []))
        for k, (_, words) in enumerate(items):
            n = min(least, len(words))
            keys = np.unique(window_hashes(words, n))
            grouped[n][0].append(keys)
            grouped[n][1].append(np.full(len(keys), k))
        for n, (keys, owner) in grouped.items():
            keys, owner = np.concatenate(keys), np.concatenate(owner)
            order = np.argsort(keys, kind="stable")
            self.by_length[n] = keys[order], owner[order]

    def candidates(self, words: np.ndarray) -> set[int]:
        """Items that share a seed with a text."""
        out: set[int] = set()
        for n, (keys, owner) in self.by_length.items():
            windows = window_hashes(words, n)
            low = np.searchsorted(keys, windows)
            hit = windows[keys[np.minimum(low, len(keys) - 1)] == windows] if len(keys) else windows[:0]
            for key in np.unique(hit):
                out.update(owner[np.searchsorted(keys, key) : np.searchsorted(keys, key, "right")].tolist())
        return out


def judge(words: np.ndarray, block: Block, least: int, coverage: float) -> list[dict]:
    out = []
    for k in sorted(block.candidates(words)):
        item, pattern = block.items[k]
        tiles = tile(words, pattern, least)
        covered = sum(t[2] for t in tiles)
        if covered >= coverage * len(pattern):
            out.append({"item_id": item, "item_words": len(pattern), "n_tiles": len(tiles), "covered": covered,
                        "coverage": round(covered / len(pattern), 6), "longest": max(t[2] for t in tiles)})
    return out


def _blocks(benchmark: DataFrame, least: int, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, read partition by partition."""
    hashes, held, size = WordHashes(), [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().toLocalIterator():
        words = word_hashes(row[1], hashes)
        if not len(words):
            continue
        held.append((row[0], words))
        size += len(words)
        if size >= block_words:
            yield Block(held, least)
            held, size = [], 0
    if held:
        yield Block(held, least)


def _leaks(block, least: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                rows += [{"doc_id": doc, **r} for r in judge(word_hashes(text, hashes), block.value, least, coverage)]
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return run


SCHEMA = pa.schema([(n, pa.float64() if n == "coverage" else pa.int64()) for n in ("doc_id", "item_id", "item_words", "n_tiles", "covered", "coverage", "longest")])


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pairs ``doc_id``, ``item_id`` whose tiles cover enough of the item, with the number of tiles and words covered."""
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for block in _blocks(benchmark, least, block_words):
        sent = spark.sparkContext.broadcast(block)  # of bounded size
        found = rows.mapInArrow(_leaks(sent, least, coverage), f"doc_id long, {FOUND}")
        out = found if out is None else out.union(found)
    return out.distinct() if out is not None else spark.createDataFrame([], f"doc_id long, {FOUND}")


def _clean(block, least: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            last = batch.num_columns - 1
            keep = [not judge(word_hashes(t, hashes), block.value, least, coverage) for t in batch.column(last).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_())).select(list(range(last)))

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, columns as they came."""
    out = docs
    name = unclashed(docs, [])
    for block in _blocks(benchmark, least, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        out = out.withColumn(name, F.col("text").cast("string")).mapInArrow(_clean(sent, least, coverage), T.StructType(docs.schema.fields))
    return out
