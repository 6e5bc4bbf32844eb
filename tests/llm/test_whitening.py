import math
from fractions import Fraction

import numpy as np
import pytest

from maskforge.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, id bigint, v string, n bigint, r string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "v", 2, "r")
                                  for i, v in zip(ids, vectors)], SCHEMA)


def exact(vectors):
    """Fixed-point rows, their deviations and the covariance, in integers and fractions."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(row[k] for row in x) for k in range(d)]
    off = [[n * c - t for c, t in zip(row, s)] for row in x]
    cov = np.array([[float(Fraction(sum(row[i] * row[j] for row in off), n ** 3)) for j in range(d)] for i in range(d)])
    return x, s, [sum(c * c for c in row) for row in off], cov


def check(spark, vectors, components=8):
    x, s, deviation, cov = exact(vectors)
    n = len(x)
    got = W.whitened_components(frame(spark, vectors).repartition(3)).collect()
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    rank = min(int((value > 1e-18 * value[0]).sum()), components, len(value))
    assert sorted((r.vec_id, r.component) for r in got) == [(i, c + 1) for i in range(n) for c in range(rank)]
    white = np.zeros((n, rank))
    for r in got:
        white[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and int(r.deviation) == deviation[r.vec_id]
        assert r.explained == pytest.approx(value[r.component - 1] / value.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
    assert np.abs(white.T @ white / n - np.eye(rank)).max() < 1e-9
    centred = np.array(x, float) - np.array(s) / n
    for c in range(rank):
        gap = min([abs(value[c] - v) for k, v in enumerate(value) if k != c], default=value[c])
        if gap > 1e-6 * value[0]:
            want = centred @ vector[:, c] / math.sqrt(value[c])
            sign = np.sign(want @ white[:, c])
            assert np.abs(sign * want - white[:, c]).max() < 1e-6
    return white


def test_whitening_matches_dense_eigenvectors(spark):
    rng = np.random.default_rng(1)
    mixed = rng.standard_normal((300, 20)) @ rng.standard_normal((20, 20)) + rng.standard_normal(20) * 5
    check(spark, mixed)
    check(spark, rng.standard_normal((40, 3)))  # fewer entries than components
    check(spark, rng.standard_normal((200, 1)))


def test_rows_fewer_than_entries_give_their_rank(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((4, 12))
    got = W.whitened_components(frame(spark, vectors)).collect()
    assert {r.component for r in got} == {1, 2, 3}
    assert max(r.identity_error for r in got) < 1e-9


def test_equal_eigenvalues_give_orthogonal_components(spark):
    corners = [[(1 if k == j else 0) * sign for k in range(10)] for j in range(10) for sign in (1, -1)]
    got = W.whitened_components(frame(spark, corners * 2)).collect()
    assert {r.component for r in got} == set(range(1, 9))
    assert max(r.identity_error for r in got) < 1e-9
    assert all(r.explained == pytest.approx(0.1) for r in got)


def test_dropped_vectors_and_awkward_rows(spark):
    rng = np.random.default_rng(3)
    good = rng.standard_normal((30, 4)).tolist()
    rows = [*good, None, [], [1, 2, 3, None], [1, 2, 3, float("nan")], [1, 2, 3, float("inf")], [1, 2, 3, 3e38], [1, 2], good[0]]
    ids = [*range(30), 90, 91, 92, 93, 94, 95, 96, 0]
    got = W.whitened_components(frame(spark, rows, ids)).collect()
    assert {r.vec_id for r in got} == set(range(30)) and len(got) == 31 * 4 and {r.n for r in got} == {31}
    again = [r.whitened for r in got if (r.vec_id, r.component) == (0, 1)]
    assert len(again) == 2 and again[0] == again[1]
    assert W.whitened_components(frame(spark, [])).count() == 0
    assert W.whitened_components(frame(spark, [[1, 2, 3]] * 5)).count() == 0  # no variance
    assert W.whitened_components(frame(spark, [[1, 2, 3]], [None])).count() == 0
    constant = [[x, 7.0, x * 2] for x in range(10)]
    assert {r.component for r in W.whitened_components(frame(spark, constant, [None] * 10)).collect()} == {1}


def test_deviations_stay_exact_beyond_64_bits():
    x = np.array([[10 ** 12, 5], [3, 10 ** 11]])
    n = 10 ** 6
    sums = [int(v) for v in x.sum(axis=0)]
    got = [int(v) for v in W._deviation(x, n, sums).to_pylist()]
    assert got == [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    assert W._deviation(x * 1000, n, sums).to_pylist()[0] is None


@pytest.mark.parametrize("seed", range(6))
def test_singular_values_and_vectors(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(2, 70))
    r = np.triu(rng.standard_normal((d, d))) * np.exp(rng.uniform(-12, 4, d))[:, None]
    if seed == 3:
        r[d // 2:] = 0
    a, b, v = W.bidiagonal(r)
    u, want, _ = np.linalg.svd(r)
    full = np.diag(a) + np.diag(b, 1)
    assert np.abs(np.linalg.svd(full, compute_uv=False) - want).max() < 1e-12 * want[0]
    got = W.dqds(a, b)
    keep = want > 1e-10 * want[0]
    assert np.sqrt(got[keep]) == pytest.approx(want[keep], rel=1e-5) and np.sqrt(got[0]) == pytest.approx(want[0], rel=1e-13)
    top = got[:min(8, int(keep.sum()))]
    z = W.leading_vectors(a, b, top) @ v.T
    assert np.abs(z @ z.T - np.eye(len(z))).max() < 1e-10
    assert np.abs(z @ (r.T @ r) - top[:, None] * z).max() < 1e-10 * got[0]


def test_tiny_singular_values_keep_their_digits():
    # a bidiagonal matrix whose smallest singular value an ordinary solver loses
    a, b = np.array([1.0, 1e-8, 1e-16]), np.array([1e-4, 1e-12])
    got = np.sqrt(W.dqds(a, b))
    assert np.prod(got) == pytest.approx(1e-24, rel=1e-12)  # the determinant
