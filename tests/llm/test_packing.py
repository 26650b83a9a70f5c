import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sensorframe.llm import packing

ODD = ["", " ", "  two  spaces ", "a \n b", "tab\t x", " lead", "trail ", "nb sp x y", "end<|endoftext|>of <|endoftext|> text", "it's we'LL 12 ½ ² x_y", "日本 語 é", "\x1c \x1d x", "a" * 3000, "x\r\n\r\n  y", "emoji 😀 ok"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_public_tokenizer(reference):
    r = random.Random(3)
    texts = ODD + ["".join(r.choices("ab é.\n\t 1'_s<|>", k=60)) for _ in range(400)]
    mine = packing.tokenizer(public_tokenizers.path(packing.VOCABULARY))
    for t in texts:
        want = reference.encode(t, add_special_tokens=False).ids
        assert mine.ids(t).tolist() == want and mine.batch(pa.array(["x y", t, None]))[1].tolist() == want, repr(t)


def test_every_id_is_packed_once(spark, docs_of, reference):
    r = random.Random(5)
    words = ["the", "of", "and", "river", "stone", "ab12", "Zürich", "quantum", "löss"]
    rows = [(i, " ".join(r.choices(words, k=r.choice([1, 30, 300, 900, 2500])))) for i in range(150)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, None), (2001, "same text"), (2002, "same text"), (2003, "word " * 60000)]
    got = packing.pack(docs_of(rows), shard=40).collect()
    ids = {i: np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    covered, sequences = {i: np.zeros(len(x), int) for i, x in ids.items()}, {}
    for g in got:
        piece = ids[g.doc_id][g.start : g.start + g.length]
        assert len(piece) == g.length > 0 and zlib.crc32(piece) == g.ids_crc32 and g.doc_tokens == len(ids[g.doc_id])
        covered[g.doc_id][g.start : g.start + g.length] += 1
        sequences.setdefault(g.sequence_id, []).append((g.offset, g.length))
    assert all((c == 1).all() for c in covered.values())
    padding, total = 0, sum(map(len, ids.values()))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.005 * total


def test_null_and_repeated_ids_and_empty_table(docs_of):
    got = packing.pack(docs_of([(None, "a b"), (None, "a b"), (4, "c"), (4, "c")])).collect()
    assert sum(g.length for g in got) == 2 * 3 + 2 * 2
    assert packing.pack(docs_of([])).collect() == []


def test_index_ranks_by_bm25():
    r = np.random.default_rng(1)
    tails = [r.integers(0, 60, n).astype("<u2") for n in (50, 80, 20, 200, 100)]
    idf = r.random(100)
    idf[::7] = 0
    mean = 90.0
    got = packing.Index(tails, idf, mean).scores(1)
    for d, tail in enumerate(tails):
        want = 0.0
        for term in set(tails[1].tolist()):
            tf = int((tail == term).sum())
            want += idf[term] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tail) / mean)) if tf else 0
        assert abs(got[d] - want) < 1e-9


def test_seed_takes_its_neighbour():
    a, b = np.arange(100, 600, dtype="<u2"), np.arange(5000, 5500, dtype="<u2")
    near_a, near_b = a[10:510].copy(), b[10:510].copy()
    idf = np.full(50257, 1.0)
    pairs = [{p[0] for p in s} for s in packing.pack_shard([a, b, near_a, near_b], idf, 500.0) if len(s) > 1]
    assert {0, 2} in [p & {0, 2} for p in pairs] and {1, 3} in [p & {1, 3} for p in pairs]
