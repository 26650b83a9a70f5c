import math

import numpy as np
from pyspark.sql import functions as F

from sensorframe.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label long"


def anchors():
    return F.col("vec_id") % 10 == 0


def brute(rows, positives=5, most=5, low=80, high=100):
    """Every anchor against every row."""
    once = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * x) for x in v]
        if i not in once or (label, len(whole)) < once[i][:2]:
            once[i] = (label, len(whole), whole)
    out = []
    for a, (label, n, v) in once.items():
        if a % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, m, w) in once.items() if i != a and m == n)
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p]
            out += [(a, i, k + 1, s[1], -p, -s[0]) for k, s in enumerate(inside[:most])]
    return sorted(out)


def answer(df):
    return sorted(tuple(r) for r in df.collect())


def clustered(n, dim, labels, seed, spread=0.3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels, dim))
    of = r.integers(0, labels, n)
    return [(i, [float(x) for x in centres[k] + spread * r.normal(size=dim)], int((k + (r.random() < 0.2)) % labels)) for i, k in enumerate(of)]


def test_equals_brute_force(spark):
    for rows in (clustered(900, 16, 4, 1), clustered(300, 3, 2, 2), [(i, [float(i % 3), 1.0], i % 2) for i in range(200)]):
        df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("block", "key", "gid", "Slot", "dim")})
        assert answer(negatives.hard_negatives(df, anchors(), size=32)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(60, 4, 2, 3) + [(100, None, 1), (110, [nan, 1.0, 1.0, 1.0], 1), (120, [1.0, inf, 0.0, 0.0], 0), (130, [1.0, None, 0.0, 0.0], 0), (140, [], 0), (150, [0.0] * 4, 0),
                                     (160, [1.0, 2.0], 1), (170, [2.0, 1.0], 1), (180, [1.5, 1.0], 0), (None, [1.0] * 4, 0), (190, [1.0] * 4, None), (20, [1.0] * 4, 5), (200, [-3.0] * 4, 7), (210, [1e5] * 4, 0),
                                     (220, [9e4] * 4, 1), (230, [0.001, -0.001, 0.0, -0.0], 0), (-10, [0.5] * 4, 0)]
    assert answer(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), anchors(), size=8)) == brute(rows)
    with_large = rows + [(240, [1e300] * 4, 0)]  # out of range: takes no part
    assert answer(negatives.hard_negatives(spark.createDataFrame(with_large, SCHEMA), anchors(), size=8)) == brute(rows)
    assert answer(negatives.hard_negatives(spark.createDataFrame([], SCHEMA), anchors())) == []


def test_long_vectors(spark):
    rows = clustered(40, 5000, 2, 4)
    assert answer(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), anchors())) == brute(rows)


def test_hilbert_is_a_walk_through_all_points():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = negatives.hilbert(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_prune(spark):
    r = np.random.default_rng(5)
    block, a = r.integers(-500, 500, (50, 6)).astype(np.int32), r.integers(-500, 500, (20, 6)).astype(np.int32)
    least, most = negatives.bounds(a, block.min(0)[None], block.max(0)[None])
    found = negatives.scores(a, block)
    assert (found >= least).all() and (found <= most).all()
    rows = clustered(2000, 4, 20, 6, 0.05)
    blocks = negatives.blocks_of(spark.createDataFrame(rows, SCHEMA), anchors(), size=16)
    groups, pages = negatives.packed(blocks, 5)
    how = (5, 5, 80, 100)
    known = negatives.with_positives(groups, pages, blocks, *how)
    n_anchors, all_blocks = 200, blocks.count()
    for stage in (groups, known):  # positives, then windows
        bits = sum(bin(int.from_bytes(r.chosen)).count("1") for r in negatives.reading_plan(stage, pages, *how).collect())
        assert 0 < bits < 0.2 * n_anchors * all_blocks
