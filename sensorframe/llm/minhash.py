"""Near duplicates by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): in round ``r`` every shingle is hashed to a bin and a value; the first
``t`` rounds pick bins at random, the next ``t`` visit them one by one, and a bin keeps the smallest ``(round, value)``
it has seen.  No bin stays empty, so every coordinate is defined also for tiny sets, and the share of equal
coordinates is concentrated around the Jaccard similarity.

Flow: sketch each text in one pass; merge documents with equal shingle sets; group the rest by bands; compare the
members of a band with two hubs of it on their full sets; find components; compare only those members of a band that
are still in different components, if their finer sketches of ``BITS`` bits may be similar enough; find components
again.  A band of ``m`` copies so costs ``2 m`` comparisons, and no link between components is lost but by the chances
of the sketches.  Comparisons recompute the full shingle sets of both texts.

Defined results: without text or words a document has an empty set, links with nothing and is kept.  Rows that share a
``doc_id`` are one document with several texts: a link of any of them counts, and each returns its own row.  Rows with a null ``doc_id`` link with nothing, have a null
component, and are kept.  Extra columns are ignored (``sketch``) or returned as they came (``keep_first``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import GOLDEN, WordHashes, components, materialize, mix, ordered, texts_of, unclashed, words_of

BANDS, ROWS = 20, 4
#: One-bit coordinates of the finer sketch; two sets of similarity s differ in a share (1 - s) / 2 of them.
BITS, SIGMAS = 1024, 4.0
SKETCHED = "doc_id long, n_shingles long, digest_a long, digest_b long, bands array<long>"
BLOCK = 4096


def shingle_set(text: bytes | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word ``size``-grams; a shorter text is one shingle."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    each = np.array([hashes[w] for w in words], np.uint64)
    n = min(size, len(words))
    last = len(words) - n + 1
    out = np.full(last, np.uint64(n), np.uint64)
    for k in range(n):
        out = mix(out + GOLDEN + each[k : k + last])
    return np.unique(out)


def similarity_sketch(shingles: np.ndarray, t: int) -> np.ndarray:
    """``t`` coordinates of a non-empty set, every one filled.

    Rounds run in blocks: a round after the one that filled the last bin can't lower any bin, as the round number
    is the high part of what is kept.
    """
    best = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    begin = 0
    while begin < 2 * t and best.max() >> np.uint64(40) >= np.uint64(2 * t):
        rounds = np.arange(begin, min(2 * t, begin + max(1, BLOCK // len(shingles))), dtype=np.uint64)
        hashed = mix(shingles[None, :] + mix(rounds + GOLDEN)[:, None])
        bins = ((hashed >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        late = rounds >= np.uint64(t)
        if late.any():
            bins[late] = (rounds[late] - np.uint64(t))[:, None]
        low = hashed * GOLDEN >> np.uint64(24)
        np.minimum.at(best, bins.ravel(), ((rounds << np.uint64(40))[:, None] + low).ravel())
        begin = int(rounds[-1]) + 1
    return best


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(bands, dtype=np.uint64)
    for column in sketch.reshape(bands, rows).T:
        out = mix(out * GOLDEN + column)
    return out.view(np.int64)


def _sketches(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, digests, keys, ends = [], [], [], [0]
            for text in texts_of(batch.column("text")):
                found = shingle_set(text, size, hashes)
                n.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                if len(found):
                    keys.append(band_keys(similarity_sketch(found, bands * rows), bands, rows))
                ends.append(ends[-1] + (bands if len(found) else 0))
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))],
                ["doc_id", "n_shingles", "digest_a", "digest_b", "bands"],
            )

    return run


def sketch(docs: DataFrame, size: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: set size, a 128-bit digest of the set, and the keys of its bands."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sketches(size, bands, rows), SKETCHED)


def _fine_sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            flat = []
            for text in texts_of(batch.column("text")):
                found = shingle_set(text, size, hashes)
                bits = mix(similarity_sketch(found, BITS)) & np.uint64(1) if len(found) else np.zeros(BITS, np.uint64)
                flat.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            ends = pa.array(np.arange(len(flat) + 1) * (BITS // 64), pa.int32())
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, values)], ["doc", "fine"])

    return run


def _verified(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, first = WordHashes(), None, None
        for batch in batches:
            keep = []
            for a, b in zip(texts_of(batch.column("text_a")), texts_of(batch.column("text_b")), strict=True):
                if a != last:  # a hub's pairs come together
                    last, first = a, shingle_set(a, size, hashes)
                other = shingle_set(b, size, hashes)
                both = len(np.intersect1d(first, other, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(first) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs ``a``, ``b`` whose full sets are similar enough; stored."""
    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")
    return materialize(rows.mapInArrow(_verified(size, percent), "a long, b long"), "links")


def _maybe_similar(left: DataFrame, texts: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of one band but different groups whose finer sketches don't exclude the similarity.

    In every band the members outside its largest group are held against all others; a pair is given once, in the
    first band that it shares.
    """
    docs = left.select("doc").distinct()
    fine = texts.join(docs, texts["doc_id"] == docs["doc"], "left_semi").select("doc_id", "text").mapInArrow(_fine_sketches(size), "doc long, fine array<long>")
    fine = materialize(fine, "fine-sketches").groupBy("doc").agg(F.min("fine").alias("fine"))
    bands = classes.groupBy("rep").agg(F.min("bands").alias("bands")).withColumnRenamed("rep", "doc")
    rows = materialize(left.join(materialize(fine, "fine-sketches"), "doc").join(bands, "doc"), "unsettled")
    share = (1 - percent / 100) / 2
    limit = BITS * share + SIGMAS * (BITS * share * (1 - share)) ** 0.5
    minor = rows.where("group <> main").select("key", *(F.col(c).alias(f"x_{c}") for c in ("doc", "n", "group", "fine", "bands")))
    differ = sum((F.bit_count(F.col("fine")[i].bitwiseXOR(F.col("x_fine")[i])) for i in range(BITS // 64)), F.lit(0))
    first_shared = F.element_at(F.filter(F.zip_with("bands", "x_bands", lambda a, b: F.when(a == b, a)), lambda k: k.isNotNull()), 1)
    pairs = rows.join(minor, "key").where(
        (F.col("group") != F.col("x_group")) & ((F.col("doc") < F.col("x_doc")) | (F.col("group") == F.col("main")))
        & F.expr(f"100 * least(n, x_n) >= {percent} * greatest(n, x_n)") & (differ <= limit) & (first_shared == F.col("key"))
    )
    return pairs.select(*ordered("doc", "x_doc")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs`` (``doc_id``, ``text``).

    With the default 20 bands of 4 rows a pair at the threshold 0.8 is missed with probability 3e-5.
    """
    sketched = materialize(sketch(docs, size, bands, rows), "sketches")
    known = sketched.where("doc_id is not null and n_shingles > 0")
    classes = known.groupBy("digest_a", "digest_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")

    banded = classes.select(F.col("rep").alias("doc"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    member = materialize(banded.join(shared, "key"), "members")
    weight = member.groupBy("doc").agg(F.sum("members").alias("weight"))
    member = materialize(member.join(weight, "doc"), "members")
    hubs = member.groupBy("key").agg(
        F.max(F.struct("weight", (-F.col("n")).alias("n"), "doc")).alias("hub"), F.min(F.struct("doc", "n")).alias("low"))
    hubs = hubs.select("key", F.explode(F.array(
        F.struct(F.col("hub.doc").alias("hub"), (-F.col("hub.n")).alias("hub_n")),
        F.struct(F.col("low.doc").alias("hub"), F.col("low.n").alias("hub_n")))).alias("h")).select("key", "h.hub", "h.hub_n")
    sizes_fit = f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"
    tried = member.join(materialize(hubs, "hubs"), "key").where(f"hub <> doc and {sizes_fit}").select(*ordered("hub", "doc")).distinct()
    tried = materialize(tried, "pairs")

    needed = member.select(F.col("doc").alias("doc_id")).distinct()
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    texts = materialize(plain.join(needed.hint("merge"), "doc_id"), "texts")
    links = _linked(tried, texts, size, percent)
    groups = materialize(components(links), "groups")

    labelled = member.join(groups.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "n", F.coalesce("component", "doc").alias("group"))
    per_group = labelled.groupBy("key", "group").agg(F.count("*").alias("docs"))
    main = per_group.groupBy("key").agg(F.max(F.struct("docs", "group")).alias("main"), F.count("*").alias("groups"))
    mixed = materialize(main.where("groups > 1").select("key", F.col("main.group").alias("main")), "mixed-bands")
    left = materialize(labelled.join(mixed, "key"), "unsettled")
    rest = materialize(_maybe_similar(left, texts, classes, size, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    more = _linked(rest, texts, size, percent)
    if more.limit(1).count():
        groups = materialize(components(links.union(more)), "groups")

    # from representatives to rows: documents with equal sets share their representative's component
    rep = classes.join(groups, classes["rep"] == groups["node"], "left").select(
        "digest_a", "digest_b", "n_shingles", F.coalesce("component", "rep").alias("of_class"))
    owned = sketched.join(materialize(rep, "labels"), ["digest_a", "digest_b", "n_shingles"], "left")
    own = F.coalesce("of_class", "doc_id")
    return owned.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == own).alias("kept"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that are near copies of a document with a smaller ``doc_id``.

    Rows whose ``doc_id`` is null all stay; of rows that share a ``doc_id`` one stays.  Columns are as they came.
    """
    name = unclashed(docs, [])
    found = materialize(near_duplicates(docs, size, percent), "judged")
    gone = materialize(found.where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    out = docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
    if found.where("kept").groupBy("doc_id").count().where("count > 1").limit(1).count():
        out = out.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id is null"))
    return out
