import math
from collections import defaultdict

import numpy as np
import pytest

from driftline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component int, x string, `a.b` double"


def brute(rows, k=4):
    """n, sums, eigenvalues and vectors, and the deviation of each row, by whole numbers and a dense eigensolver."""
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in rows}
    distinct = sorted({tuple(v) for v in x.values()})
    n, d = len(distinct), len(distinct[0])
    s = [sum(v[j] for v in distinct) for j in range(d)]
    c = np.array([[n * v[j] - s[j] for j in range(d)] for v in distinct], float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:k]
    return n, s, e[order], u[:, order], float(e.sum()), {i: sum((n * a - b) ** 2 for a, b in zip(v, s)) for i, v in x.items()}, x


def check(got, rows, k=4):
    n, s, e, u, trace, deviation, x = brute(rows, k)
    by = defaultdict(dict)
    for r in got:
        by[r.component][r.vec_id] = r.whitened
        assert r.n == n and r.deviation == deviation[r.vec_id] and 0 <= r.identity_error <= 1e-10
        assert abs(r.explained - e[r.component - 1] / trace) <= 1e-11 * e[r.component - 1] / trace
    assert sorted(by) == list(range(1, k + 1)) and all(len(v) == len(x) for v in by.values())
    for j in range(k):
        want = {i: float((np.array(v) - np.array(s) / n) @ u[:, j]) / math.sqrt(e[j]) for i, v in x.items()}
        sign = 1 if sum(want[i] * by[j + 1][i] for i in x) > 0 else -1
        assert max(abs(sign * by[j + 1][i] - want[i]) for i in x) < 1e-7


@pytest.mark.parametrize("n,d", [(400, 5), (300, 24), (700, 70)])
def test_equals_a_dense_eigensolver(spark, n, d):
    rng = np.random.default_rng(d)
    v = (rng.normal(size=(n, d)) * np.linspace(1, 1.4, d)).astype(np.float32)
    v[n // 2 :] = v[0]  # half the table is one vector
    rows = [(i, v[i].tolist()) for i in range(n)]
    df = spark.createDataFrame([(i, x, 1, "x", 0.0) for i, x in rows], SCHEMA).repartition(5)
    check(whitening.whiten(df).collect(), rows)
    assert [(r.vec_id, r.component, r.whitened) for r in whitening.whiten(df).sort("vec_id", "component").limit(9).collect()] == [(r.vec_id, r.component, r.whitened) for r in whitening.whiten(df).sort("vec_id", "component").limit(9).collect()]


def test_lobpcg_on_hard_spectra():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    near = 1 + 1e-3 * rng.random(200)  # all close
    ties = np.r_[[5.0, 5.0, 5.0, 5.0, 5.0], np.ones(195)]
    low = np.r_[[3.0, 2.0], np.zeros(198)]  # rank two
    steep = 10.0 ** -np.arange(200.0).clip(0, 12)
    for e in (near, ties, low, steep):
        a = q * e @ q.T
        values, vectors, residual, _ = whitening.lobpcg(lambda b: a @ b, 200, 4, e.sum())  # noqa: B023
        want = np.sort(e)[::-1][:4]
        assert np.abs(values - want).max() < 1e-11 * want[0] and residual < 1e-10
        assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12


def test_rows_that_take_no_part(spark):
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [1.0, 2.0, 3.0]]
    good = [[0.1, 0.2], [-0.3, 0.7], [0.5, -0.5], [0.1, 0.2]]
    rows = [(i, v, 1, "x", 0.0) for i, v in enumerate(bad + good)] + [(None, [0.1, 0.2], 1, "x", 0.0)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2} and len(got) == 10 and {r.n for r in got} == {3}
    check([r for r in got if r.vec_id is not None], [(7 + i, v) for i, v in enumerate(good)], 2)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [0.5, 0.5], 1, "x", 0.0)] * 3, [(1, None, 1, "x", 0.0)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []
    flat = [(i, [i / 8.0, 0.25, 0.25], 1, "x", 0.0) for i in range(20)]  # one direction varies
    assert {r.component for r in whitening.whiten(spark.createDataFrame(flat, SCHEMA)).collect()} == {1}


def test_exact_sums_and_deviations_of_large_entries():
    x = np.array([[1 << 50, -5], [3, 1 << 40]])
    assert whitening.deviations(x, 10, (7, 9)) == [None, None]
    x = np.array([[1000, -5], [3, 70_000]])
    assert whitening.deviations(x, 40_000, (7, 9)) == [sum((40_000 * int(a) - b) ** 2 for a, b in zip(r, (7, 9))) if i == 0 else (40_000 * 3 - 7) ** 2 + (40_000 * 70_000 - 9) ** 2 for i, r in enumerate(x)]
