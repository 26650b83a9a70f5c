import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorframe.llm import tiling
from sensorframe.llm.common import WordHashes


def plain_tiles(a, b, least):
    """Greedy string tiling as it is defined: one longest unmarked match after the other."""
    least = min(least, len(b))
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k >= least and k and (best is None or (-k, i, j) < best):
                    best = (-k, i, j)
        if best is None:
            return sorted(out)
        k, i, j = -best[0], best[1], best[2]
        for x in range(k):
            free_a[i + x] = free_b[j + x] = False
        out.append((i, j, k))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=25), st.integers(1, 6))
def test_tiles_equal_the_definition(a, b, least):
    got = tiling.tile(np.array(a, np.uint64), np.array(b, np.uint64), least)
    assert got == plain_tiles(a, b, least)


def test_window_hashes_depend_on_words_alone():
    x = np.array([5, 6, 7, 1, 2, 5, 6, 7], np.uint64)
    h = tiling.window_hashes(x, 3)
    assert h[0] == h[5] and len(set(h.tolist())) == 5 and len(tiling.window_hashes(x, 9)) == 0


def test_leaks_equal_brute_force(spark, docs_of):
    r = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(r.choices(words, k=r.choice([3, 15, 30, 60])))) for k in range(30)] + [(90, None), (91, ""), (92, "!?")]
    rows = []
    for i in range(120):
        text = r.choices(words, k=r.choice([0, 10, 200]))
        if i % 2:
            parts = items[r.randrange(30)][1].split()
            cut = len(parts) // 2
            shape = r.randrange(4)
            parts = parts if shape == 0 else parts[cut:] + r.choices(words, k=4) + parts[:cut] if shape == 1 else parts[: len(parts) * 2 // 3] if shape == 2 else parts[::2]
            at = r.randrange(len(text) + 1)
            text = text[:at] + parts + text[at:]
        rows.append((i, ", ".join(text).upper() + "."))
    rows += [(None, items[4][1]), (None, None), (300, ""), (301, items[5][1] + " " + "z " * 40000), (301, items[5][1] + " " + "z " * 40000)]
    benchmark = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, doc_id string")
    got = {(g.doc_id, g.item_id, g.covered, g.n_tiles) for g in tiling.leaks(docs_of(rows), benchmark, block_words=200).collect()}
    want, h = set(), WordHashes()
    for i, t in rows:
        for k, b in items:
            x, y = tiling.word_hashes(t, h), tiling.word_hashes(b, h)
            tiles = plain_tiles(x.tolist(), y.tolist(), tiling.LEAST) if len(y) and set(y.tolist()) & set(x.tolist()) else []
            covered = sum(n for *_, n in tiles)
            if covered and covered >= tiling.COVERAGE * len(y):
                want.add((i, k, covered, len(tiles)))
    assert got == want and any(n > 1 for *_, n in got)
    kept = tiling.drop_leaks(docs_of(rows), benchmark, block_words=200)
    assert kept.columns == docs_of(rows).columns
    assert sorted(x.doc_id or -1 for x in kept.collect()) == sorted((i or -1) for i, t in rows if i not in {g[0] for g in got} or (i is None and t is None))


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert tiling.leaks(docs_of([(1, "a")]), none).collect() == [] and tiling.drop_leaks(docs_of([(1, "a")]), none).count() == 1
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert tiling.leaks(docs_of([]), some).collect() == [] and tiling.drop_leaks(docs_of([]), some).collect() == []
