import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorframe.llm import minhash
from sensorframe.llm.common import WordHashes, components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain(rows, size, percent):
    sets = {}
    for i, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * len(sets[i] | sets[j]) and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return {i: (len(s), low[i], low[i] == i) for i, s in sets.items()}


def corpus(n=120, seed=3):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    rows = [(i, " ".join(r.choices(words, k=r.choice([1, 2, 3, 4, 5, 40, 90, 300])))) for i in range(n)]
    base = r.choices(words, k=120)
    for i in range(n, 2 * n):  # a group whose members differ from its base by more and more
        text = [r.choice(words) if r.random() < (i - n) / (12 * n) else w for w in base]
        rows.append((i, " ".join(text)))
    rows += [(2 * n + k, rows[k][1].upper() if k % 2 else rows[k][1]) for k in range(10)]
    r.shuffle(rows)
    return rows


def test_equals_all_pairs(docs_of):
    rows = corpus() + [(900, None), (901, ""), (902, " \n\t"), (903, "Ä Ö ü"), (904, "ä Ö ü"), (905, "x " * 30000)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs_of(rows), size=4).collect()}
    assert got == plain(rows, 4, 80)


def test_null_and_repeated_ids(docs_of):
    text = "one two three four five six"
    got = minhash.near_duplicates(docs_of([(None, text), (None, None), (7, text), (7, text), (8, text)])).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, None, None), (0, None, None), (7, 7, True), (7, 7, True), (8, 7, False)]
    left = minhash.keep_first(docs_of([(None, text), (None, None), (7, text), (7, text), (8, text)])).collect()
    assert sorted(r.doc_id or 0 for r in left) == [0, 0, 7]


def test_empty_table(docs_of):
    docs = docs_of([])
    assert minhash.near_duplicates(docs).collect() == [] and minhash.keep_first(docs).columns == docs.columns


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6))
def test_sketch_fills_every_coordinate(n, seed):
    items = np.unique(np.random.default_rng(seed).integers(0, 2**63, n).astype(np.uint64))
    got = minhash.similarity_sketch(items, 80)
    assert (got >> np.uint64(40) < 160).all()
    # what it is defined by: round by round, one element at a time
    best = [None] * 80
    for r in range(160):
        salt = int(minhash.mix(np.array([r], np.uint64) + minhash.GOLDEN)[0])
        for x in items.tolist():
            h = int(minhash.mix(np.array([(x + salt) % 2**64], np.uint64))[0])
            k = (h >> 32) * 80 >> 32 if r < 80 else r - 80
            v = (r << 40) + (h * int(minhash.GOLDEN) % 2**64 >> 24)
            best[k] = v if best[k] is None else min(best[k], v)
        if None not in best:
            break
    assert got.tolist() == best


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    items = r.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = minhash.similarity_sketch(items[:1000], 1024), minhash.similarity_sketch(items[200:1200], 1024)
    assert abs((a == b).mean() - 800 / 1200) < 0.06


def test_shingles_of_short_texts_differ_by_length():
    h = WordHashes()
    assert len(minhash.shingle_set(b"a b c", 4, h)) == 1 and len(minhash.shingle_set(b"a a a a a a", 4, h)) == 1
    assert minhash.shingle_set(b"a a a", 4, h)[0] != minhash.shingle_set(b"a a a a", 4, h)[0]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(200, 200), (149, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 150)}, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
