import math

import numpy as np
import pytest

from sensorframe.llm import lattice


def test_decode_is_nearest_lattice_point():
    x = np.random.default_rng(2).normal(0, 2, (60, 8))
    got = lattice.decode(x)
    assert (((got * 2) % 2 == 0).all(1) | ((got * 2) % 2 == 1).all(1)).all() and (got.sum(1) % 2 == 0).all()
    for k in range(len(x)):  # no neighbour of the point is nearer
        assert (((got[k] + lattice.neighbours() - x[k]) ** 2).sum(1) >= ((got[k] - x[k]) ** 2).sum() - 1e-9).all()
    assert len(lattice.neighbours()) == 240 and np.allclose((lattice.neighbours() ** 2).sum(1), 2)


def near_rows(n, dim, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 8, dim))
    v = centres[r.integers(0, len(centres), n)] + r.normal(0, 0.075, (n, dim))
    return [(i, [float(x) for x in row.astype(np.float32)], int(i % 3)) for i, row in enumerate(v)]


def brute(rows):
    links = {i: set() for i, _, _ in rows}
    for i, v, p in rows:
        for j, w, q in rows:
            if i < j and p == q:
                x, y = np.array(v), np.array(w)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[i].add(j)
                    links[j].add(i)
    return links


def test_recall_and_counts(spark):
    rows = near_rows(600, 64, 5)
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(20)] + [(2000 + k, rows[0][1], rows[0][2]) for k in range(50)]
    want = brute(rows)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, rep string, cell string")
    got = {r.vec_id: r for r in lattice.near_vectors(df).collect()}
    assert set(got) == set(want) and all(got[i].n_links <= len(want[i]) for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(map(len, want.values()))
    assert got[2007].n_links >= 50 and got[2007].component_id == got[0].component_id and not got[2007].kept


def at_cosine(n, dim, cosine):
    """Unit vectors and, for each, one at this cosine in a random direction."""
    r = np.random.default_rng(dim)
    a, b = r.normal(size=(2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + math.sqrt(1 - cosine**2) * b


@pytest.mark.parametrize("least", [0.9, 0.98])
@pytest.mark.parametrize("dim", [2, 3, 4, 8, 13, 64, 768])
def test_pairs_at_the_threshold_meet(dim, least):
    x, y = (lattice.cells(v, lattice.TABLES, lattice.PROBES, lattice.scale_of(least), lattice.SEED) for v in at_cosine(600, dim, least + 1e-4))
    meet = (x == y[:, :, :1]).any((1, 2)) | (y == x[:, :, :1]).any((1, 2))
    assert meet.mean() >= 0.98


def test_links_of_short_and_long_vectors(spark):
    rows = []
    for dim in (2, 8, 768):
        for k, (a, b) in enumerate(zip(*at_cosine(60, dim, 0.9802), strict=True)):
            # one label a pair, so the pair is the only link
            rows += [(1000 * dim + 2 * k + j, v.tolist(), 100 * dim + k) for j, v in enumerate((a, b))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = lattice.near_vectors(df).collect()
    assert len(got) == len(rows) and {r.n_links for r in got} <= {0, 1}
    for dim in (2, 8, 768):
        assert sum(r.n_links for r in got if 1000 * dim <= r.vec_id < 1000 * dim + 120) >= 0.97 * 120


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1),
            (8, [1.0, 0.0], None), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1e30, 0.0], 1), (12, [1e-40, 0.0], 1), (None, [1.0, 0.0], 1), (2, [-1.0, 0.0], 1), (13, [-3.0, -0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id) for r in lattice.near_vectors(df).collect())
    linked = {i: (n, c) for i, n, c in got}
    assert len(got) == len(rows)
    assert all(linked[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10)) and linked[0] == (0, None)
    assert all(linked[i][1] == 1 for i in (1, 2, 11, 12, 13))
    assert lattice.near_vectors(df.limit(0)).collect() == []
