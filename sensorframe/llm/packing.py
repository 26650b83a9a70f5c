"""Lexical retrieval packing: documents into sequences of one window, each filled with lexically near pieces.

A document's ids end with a separator.  Whole windows of a long document are sequences of their own; what is left of
it (or a short document) is its tail.  Tails are dealt by their largest token ids into shards of bounded size, and each
shard has an inverted index with BM25 weights, whose document frequencies and mean length are those of the corpus.
The longest unused tail of a shard seeds a window; the index ranks the unused others by BM25 against it, and they fill
the window in that order where they fit.  Room that none fits is filled by the head of the best one, whose rest stays
in the pool.  The last window of a shard is dealt out to sequences whose lengths are powers of two, so it needs no
padding.

A task holds one shard, and a seed retrieves from its own shard only.  Equal tokens (a hot group) are told apart by the
id's hash, so they are many shards.  Statistics are an array over the vocabulary, which is of fixed size.  The distinct
words of a batch are encoded once; texts with unusual white space are encoded as a whole.

Defined results: a null or empty text is its separator alone.  Equal texts are packed each by itself.  Ids may be null
or repeat: every row is packed once.  An empty table gives no sequence.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import materialize, texts_of

VOCABULARY = "byte_bpe_50k.tiktoken"
WINDOW, SEPARATOR, SHARD = 1024, 0, 1024
LEAST_CUT = 8
K1, B = 1.2, 0.75
TOKENISED = "doc_id long, doc_tokens long, whole array<long>, tail binary, rare int, second int"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, role string"
#: A space that no visible character follows (more characters are taken for spaces than need be); elsewhere a space
#: begins a token, so words can be encoded apart from each other.
ODD_SPACES = r" ([\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|\z)"
END_OF_TEXT = "<|endoftext|>"


class Tokenizer:
    """Ids of texts as little-endian 16-bit numbers; the vocabulary must have fewer than 65,536."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = len(ranks) + 1
        self.coder = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})
        self.widths = np.zeros(self.size, np.int64)
        for token, rank in ranks.items():
            self.widths[rank] = len(token)

    def plain(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, disallowed_special=()).astype("<u2")

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode(text, allowed_special="all"), "<u2")

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each behind a space, in one go; and where each word's begin and the last ends."""
        if not len(words):
            return np.zeros(0, "<u2"), np.zeros(1, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = self.plain(f" {joined}")
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        return ids, np.concatenate([[0], np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1])

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a batch: every distinct word is encoded once, and its ids are gathered by offsets."""
        texts = texts.cast(pa.string()).fill_null("")
        odd = pc.or_(pc.match_substring_regex(texts, ODD_SPACES), pc.match_substring(texts, END_OF_TEXT))
        parts = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        ends, flat = parts.offsets.to_numpy().astype(np.int64), parts.flatten()
        ends -= ends[0]
        behind = np.ones(len(flat), bool)
        behind[ends[:-1]] = False
        coded = flat.filter(pa.array(behind)).dictionary_encode()
        pool, begin = self.words(coded.dictionary)
        at = coded.indices.to_numpy()
        n = (begin[1:] - begin[:-1])[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(begin[at] - upto[:-1], n) + np.arange(upto[-1])]
        cuts = upto[ends - np.arange(len(ends))]  # a text's words but its first
        firsts = flat.filter(pa.array(~behind)).to_pylist()
        return [
            self.ids(texts[k].as_py()) if apart else np.concatenate([self.plain(first), ids[cuts[k] : cuts[k + 1]]])
            for k, (first, apart) in enumerate(zip(firsts, odd.to_pylist(), strict=True))
        ]


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4"))


def _tokenised(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            n, whole, tails, rare = [], [], [], []
            for ids in coder.batch(batch.column("text")):
                ids = np.append(ids, np.uint16(SEPARATOR))
                cut = len(ids) // window * window
                n.append(len(ids))
                whole.append([crc(ids[i : i + window]) for i in range(0, cut, window)])
                tail = ids[cut:]
                tails.append(tail.astype("<u2").tobytes())
                top = int(tail.max()) if len(tail) else 0
                low = tail[tail < top]
                rare.append((top, int(low.max()) if len(low) else 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(whole, pa.list_(pa.int64())), pa.array(tails, pa.binary()),
                 pa.array([r[0] for r in rare], pa.int32()), pa.array([r[1] for r in rare], pa.int32())],
                ["doc_id", "doc_tokens", "whole", "tail", "rare", "second"],
            )

    return run


def _frequencies(size: int):
    """Per task, how many tails hold each id; term -1 counts tails and -2 their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tails, ids = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for raw in texts_of(batch.column("tail")):
                if raw:
                    terms = np.frombuffer(raw, "<u2")
                    held = np.sort(terms)
                    seen[held[:1]] += 1
                    seen[held[1:][held[1:] != held[:-1]]] += 1
                    tails, ids = tails + 1, ids + len(terms)
        terms = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *terms], pa.int32()), pa.array([tails, ids, *seen[terms]], pa.int64())], ["term", "n"])

    return run


class Index:
    """BM25 inverted index of one shard."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(tails)
        sizes = np.array([len(t) for t in tails])
        keys, counts = np.unique(np.repeat(np.arange(self.n, dtype=np.uint32), sizes) << np.uint32(16) | np.concatenate(tails), return_counts=True)
        terms, docs = (keys & np.uint32(0xFFFF)).astype(np.int64), (keys >> np.uint32(16)).astype(np.int64)
        telling = idf[terms] > 0
        terms, docs, counts = terms[telling], docs[telling], counts[telling]
        weight = idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * sizes[docs] / mean))
        self.terms, self.of = terms, np.searchsorted(docs, np.arange(self.n + 1))
        order = np.argsort(terms, kind="stable")
        self.docs, self.weight = docs[order], weight[order]
        self.begin = np.searchsorted(terms[order], np.arange(len(idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every tail of the shard for the seed's terms."""
        terms = self.terms[self.of[seed] : self.of[seed + 1]]
        begin = self.begin[terms]
        sizes = self.begin[terms + 1] - begin
        places = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(self.docs.take(places), self.weight.take(places), self.n)


def pack_shard(tails: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[list[tuple[int, int, int, str]]]:
    """Sequences of pieces (tail, begin, length, role), each tail's ids in exactly one piece."""
    index = Index(tails, idf, mean)
    left, begin = np.array([len(t) for t in tails]), np.zeros(len(tails), np.int64)
    out = []

    def take(now: list, k: int, n: int, role: str) -> None:
        now.append((k, int(begin[k]), n, role))
        begin[k] += n
        left[k] -= n

    for seed in np.argsort(-left, kind="stable").tolist():
        if not left[seed]:
            continue
        now: list = []
        take(now, seed, int(left[seed]), "seed")
        room = window - now[0][2]
        order = None
        while room:
            if order is None:
                order = np.flatnonzero(left)
                order = order[np.argsort(-index.scores(seed)[order], kind="stable")]
            fits = np.flatnonzero(left[order] <= room)
            if len(fits):
                k = int(order[fits[0]])
                room -= int(left[k])
                take(now, k, int(left[k]), "neighbour")
            elif len(order) and room >= LEAST_CUT:
                take(now, int(order[0]), room, "cut")
                room = 0
            else:
                break
            order = order[left[order] > 0]
        if room >= LEAST_CUT:  # nothing is left in the shard
            out += powers_of_two(now)
        else:
            out.append(now)
    return out


def powers_of_two(pieces: list[tuple[int, int, int, str]]) -> list[list[tuple[int, int, int, str]]]:
    """The same ids in sequences whose lengths are the powers of two that the total is the sum of."""
    total, out = sum(p[2] for p in pieces), []
    held = list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        need, now = total & 1 << bit, []
        while need:
            k, begin, n, role = held.pop()
            used = min(n, need)
            now.append((k, begin, used, role))
            if used < n:
                held.append((k, begin + used, n - used, "cut"))
            need -= used
        if now:
            out.append(now)
    return out


def _packed(idf: np.ndarray, mean: float, window: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        held: list = []

        def rows_of(shard_rows: list) -> pa.RecordBatch:
            nonlocal sequence
            rows: list = []
            for doc, total, _, whole in shard_rows:
                for i, value in enumerate(whole):
                    rows.append((doc, i * window, window, value, total, sequence, 0, "whole"))
                    sequence += 1
            ended = [(doc, total, tail) for doc, total, tail, _ in shard_rows if len(tail)]
            for pieces in pack_shard([t for _, _, t in ended], idf, mean, window) if ended else []:
                at = 0
                for k, begin, n, role in pieces:
                    doc, total, tail = ended[k]
                    rows.append((doc, total - len(tail) + begin, n, crc(tail[begin : begin + n]), total, sequence, at, role))
                    at += n
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

        for batch in batches:
            columns = (batch.column("doc_id").to_pylist(), batch.column("doc_tokens").to_pylist(), texts_of(batch.column("tail")), batch.column("whole").to_pylist())
            for doc, total, tail, whole in zip(*columns, strict=True):
                held.append((doc, total, np.frombuffer(tail, "<u2"), whole))
                if len(held) >= shard:
                    yield rows_of(held)
                    held = []
        if held:
            yield rows_of(held)

    return run


SCHEMA = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("role", pa.string())])


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """One row per piece of the rows of ``docs`` (``doc_id``, ``text``); ``vocabulary`` is a path on every machine."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    size = tokenizer(path).size
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    stored = materialize(rows.mapInArrow(_tokenised(path, window), TOKENISED), "tokens")
    counts = stored.select("tail").mapInArrow(_frequencies(size), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r[0]: r[1] for r in counts.collect()}  # at most the vocabulary
    tails, ids = found.pop(-1, 0), found.pop(-2, 0)
    idf = np.zeros(size)
    for term, n in found.items():
        idf[term] = max(0.0, np.log((tails - n + 0.5) / (n + 0.5)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = stored.withColumn("salt", F.xxhash64("doc_id", "doc_tokens")).repartitionByRange(parts, "rare", "second", "salt")
    return spread.sortWithinPartitions("rare", "second", "salt", "tail").drop("salt").mapInArrow(_packed(idf, ids / max(1, tails), window, shard), PIECE)
