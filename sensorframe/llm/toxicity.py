"""Toxicity by a factorization machine over hashed terms.

``score = sigmoid(bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)`` over the terms of a text: its words and, as
insults are inflected, the first letters of longer words, once more where two and where three of its words share them.
The pairwise part, in its linear-time form, learns what an additive model can't, such as an insult together with the
mention of a group.

Learning takes two passes over a bounded sample of labelled rows (``sample`` is the bound; rows are taken in the order
of a hash, so the choice doesn't depend on ids or on how the table is stored).  Terms are hashed to ``2**bits``
buckets.  A first pass with L1 shrinkage leaves the buckets that tell anything alone; a second one looks for pairs of
buckets that tell something together which neither of them does (exclusive or), among the ``PAIRED`` buckets that divide
the sample best; the machine is then trained on all of those by AdaGrad.  The model is of fixed size and travels to the tasks in their code.  Scoring reads every whole text once.

Defined results: an empty or null text has only the bias.  Without labels of both kinds every score is the share of
toxic labels in the sample (0 without labels).  Repeated labels of one document count once (toxic if any says so).
Repeated or null ids each return their row.  Labels, language, source and id are no inputs.  Extra columns are ignored
by ``score_documents`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import WORDS_KEPT, materialize, unclashed

WORD = re.compile(r"\w+")
STEM, FORMS = 4, (2, 3)
#: Buckets tried in pairs, and standard errors by which a pair's mean residual leaves that of its two buckets.
PAIRED, PAIR_ERRORS = 2048, 6.0


@dataclass
class Machine:
    """A trained model: the active buckets and, for each, its weight and factors."""

    bits: int
    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def score(self, active: np.ndarray) -> float:
        """Probability for a text whose active terms have these positions in ``buckets``."""
        v = self.factors[active]
        total = v.sum(0)
        z = self.bias + self.weights[active].sum() + 0.5 * (total @ total - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def stem_terms(stem: str) -> list[str]:
    """Terms of a stem that one, two and three words of a text share."""
    return [stem + "\x00" * n for n in (1, *FORMS)]


def stems_of(words: set[str]) -> Counter[str]:
    """How many of the words begin with each stem."""
    return Counter([w[:STEM] for w in words if len(w) > STEM])


def reached(n: int) -> int:
    """How many of ``stem_terms`` hold for ``n`` words."""
    return 1 + sum(n >= k for k in FORMS)


def bucket(term: str, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(term) >> (64 - bits)


def features(text: str | None, bits: int) -> list[int]:
    words = set(WORD.findall((text or "").lower()))
    shared = [t for stem, n in stems_of(words).items() for t in stem_terms(stem)[: reached(n)]]
    return sorted({bucket(t, bits) for t in [*words, *shared]})


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, bits) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column("toxic")], ["found", "toxic"])

    return run


def _shrunk(rows: list[np.ndarray], y: np.ndarray, size: int, l1: float, epochs: int) -> tuple[np.ndarray, float]:
    """Linear weights and bias by follow-the-regularised-leader with L1: most are exactly zero."""
    z, n, b, nb = np.zeros(size), np.zeros(size), 0.0, 1.0
    alpha, beta = 0.3, 1.0
    for _ in range(epochs):
        for x, t in zip(rows, y, strict=True):
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) > l1, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha), 0.0)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - t
            z[x] += g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha * w
            n[x] += g * g
            nb += g * g
            b -= 0.3 * g / np.sqrt(nb)
    return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha), 0.0), b


def _paired(rows: list[np.ndarray], rest: np.ndarray, size: int) -> np.ndarray:
    """Terms of pairs whose rows have another mean residual than the two terms' own rows lead to expect.

    Works on a matrix of the sample's rows by ``PAIRED`` terms, so it is of bounded size.
    """
    n = len(rows)
    counts = np.bincount(np.concatenate(rows), minlength=size)
    tried = np.argsort(-(counts * (n - counts)), kind="stable")[:PAIRED]
    place = np.full(size, -1)
    place[tried] = np.arange(len(tried))
    x = np.zeros((n, len(tried)), np.float32)
    for i, r in enumerate(rows):
        at = place[r]
        x[i, at[at >= 0]] = 1
    rest = (rest - rest.mean()).astype(np.float32)
    own = x.T @ rest / np.maximum(x.sum(0), 1)
    both = x.T @ x
    total, square = x.T @ (x * rest[:, None]), x.T @ (x * (rest * rest)[:, None])
    error = np.sqrt(np.maximum(square, both * float(rest @ rest) / n)) + 1e-6
    tells = np.abs(total - both * (own[:, None] + own[None, :])) > PAIR_ERRORS * error
    np.fill_diagonal(tells, False)
    return tried[tells.any(1)]


def train(rows: list[np.ndarray], labels: list[int], bits: int = 20, factors: int = 8, shrink: float = 0.08, epochs: int = 15, seed: int = 7) -> Machine:
    """Fit the machine to sparse rows of bucket numbers."""
    y = np.array(labels, float)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        bias = -30.0 if share == 0 else 30.0
        return Machine(bits, bias, np.empty(0, np.int64), np.empty(0), np.empty((0, factors)))
    used, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    parts = np.split(inverse, np.cumsum([len(r) for r in rows])[:-1])
    # the gradient sum of a term that tells nothing grows as the root of the number of rows
    first, lead = _shrunk(parts, y, len(used), shrink * np.sqrt(len(y)), 3)
    linear = np.array([first[p].sum() for p in parts]) + lead
    rest = y - 1 / (1 + np.exp(-np.clip(linear, -30, 30)))
    chosen = np.union1d(np.flatnonzero(first), _paired(parts, rest, len(used)))
    place = np.full(len(used), -1)
    place[chosen] = np.arange(len(chosen))
    rng = np.random.default_rng(seed)
    w, v, b = first[chosen].copy(), rng.normal(0, 0.05, (len(chosen), factors)), float(np.log(share / (1 - share)))
    gw, gv, gb = np.ones(len(chosen)), np.ones((len(chosen), factors)), 1.0
    sparse = [x[x >= 0] for x in (place[p] for p in parts)]
    for _ in range(epochs):
        for i in rng.permutation(len(sparse)):
            x = sparse[i]
            vx = v[x]
            total = vx.sum(0)
            g = 1 / (1 + np.exp(-np.clip(b + w[x].sum() + 0.5 * (total @ total - (vx * vx).sum()), -30, 30))) - y[i]
            dw, dv = g + 1e-4 * w[x], g * (total - vx) + 1e-3 * vx
            gw[x] += dw * dw
            gv[x] += dv * dv
            gb += g * g
            w[x] -= 0.2 * dw / np.sqrt(gw[x])
            v[x] -= 0.05 * dv / np.sqrt(gv[x])
            b -= 0.2 * g / np.sqrt(gb)
    return Machine(bits, b, used[chosen], w, v)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, bits: int = 20) -> Machine:
    """Train on at most ``sample`` labelled rows whose ``crc32(doc_id) % 5`` isn't 0."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
    found = materialize(texts.select("text", "toxic").mapInArrow(_features(bits), "found array<int>, toxic int"), "terms")
    rows = found.orderBy(F.xxhash64("found"), "toxic").limit(sample).collect()  # ids may repeat among the texts
    return train([np.array(r.found, np.int64) for r in rows], [r.toxic for r in rows], bits)


class _Places:
    """Positions of a text's active buckets; those of words and stems met lately are kept."""

    def __init__(self, machine: Machine):
        self.bits, self.place = machine.bits, {int(b): i for i, b in enumerate(machine.buckets)}
        self.words: dict[str, int] = {}
        self.stems: dict[str, list[int]] = {}

    def _of(self, held: dict, key: str, value):
        if len(held) >= WORDS_KEPT:
            held.clear()
        held[key] = value
        return value

    def active(self, text: str | None) -> np.ndarray:
        words = set(WORD.findall((text or "").lower()))
        found = set()
        for w in words:
            p = self.words.get(w)
            found.add(self._of(self.words, w, self.place.get(bucket(w, self.bits), -1)) if p is None else p)
        for stem, n in stems_of(words).items():
            at = self.stems.get(stem)
            if at is None:
                at = self._of(self.stems, stem, [self.place.get(bucket(t, self.bits), -1) for t in stem_terms(stem)])
            found.update(at[: reached(n)])
        found.discard(-1)
        return np.array(sorted(found), np.int64)


def _scorer(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(machine)
        for batch in batches:
            out = [machine.score(places.active(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for c in batch.columns[:-1]), pa.array(out, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = rows.mapInArrow(_scorer(machine), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _clean(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(machine)
        for batch in batches:
            keep = [machine.score(places.active(text)) < 0.5 for text in batch.column(batch.num_columns - 1).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_())).select(list(range(batch.num_columns - 1)))

    return run


def drop_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` with a score below one half, columns as they came."""
    name = unclashed(docs, [])
    return docs.withColumn(name, F.col("text").cast("string")).mapInArrow(_clean(machine), docs.schema)
