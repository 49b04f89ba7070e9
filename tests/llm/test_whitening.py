"""Whitened embeddings against NumPy over the same integers."""

import math

import numpy as np
import pytest

from scribelake.llm import whitening


def brute(rows, k=16):
    """By id: deviation and whitened values, up to the sign of a component; and the eigenvalues' shares."""
    whole = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for _, v in whole}
    n, sums = len(x), [sum(c) for c in zip(*x)]
    matrix = np.array(sorted(x), np.float64) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(matrix.T @ matrix / n)
    order = np.argsort(-values)[:k]
    order = order[values[order] > 1e-12 * max(values.sum(), 1e-300)]
    out = []
    for i, v in whole:
        own = [math.floor(64 * float(c)) + 1_000_000 for c in v]
        w = (np.array(own) - np.array([s / n for s in sums])) @ vectors[:, order] / np.sqrt(values[order])
        out.append((i, n, sum((n * a - s) ** 2 for a, s in zip(own, sums)), w))
    return out, values[order] / values.sum()


def compare(got, want, shares):
    by = {}
    for r in got:
        by.setdefault((r["id"], r["component"]), []).append(r)
    assert len(got) == len(want) * len(shares)
    for c, share in enumerate(shares, 1):
        a = np.array([w[c - 1] for i, _, _, w in want if i is not None])
        b = np.array([by[i, c][0]["whitened"] for i, _, _, _ in want if i is not None])
        sign = 1.0 if a @ b >= 0 else -1.0
        assert np.abs(a - sign * b).max() < 1e-6
        assert all(abs(r["explained"] - share) < 1e-9 for r in got if r["component"] == c)
    for i, n, deviation, _ in want:
        assert all(r["n"] == n for r in by[i, 1])
        if i is not None:
            assert {r["deviation"] for r in by[i, 1]} == {deviation}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("matrix", [np.eye(20), np.zeros((5, 5)), np.diag([3.0, 3, 3, 2, 2, 1]), np.ones((9, 9)), np.array([[4.0]]), 1e-200 * np.diag([2.0, 1.0, 1.0])])
def test_pairs_of_close_and_equal_eigenvalues(matrix):
    values, vectors = whitening.leading_pairs(matrix, 16)
    size = np.abs(matrix).max() or 1.0
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][:16]).max() <= 1e-14 * size
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() <= 1e-14 * size
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13


def test_pairs_of_random_and_clustered_matrices():
    r = np.random.default_rng(3)
    for n in (2, 3, 17, 64, 200):
        q = np.linalg.qr(r.standard_normal((n, n)))[0]
        for spectrum in (r.random(n), np.concatenate((np.full(n - n // 2, 5.0) + 1e-9 * r.random(n - n // 2), r.random(n // 2))), 10.0 ** -np.arange(n)):
            a = (q * spectrum) @ q.T
            a = (a + a.T) / 2
            values, vectors = whitening.leading_pairs(a, 16)
            assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:16]).max() < 1e-13 * values[0]
            assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-13 * values[0]
            assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12


def test_rows_against_numpy(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in r.standard_normal(20) * np.linspace(0.1, 2, 20)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(150)]  # a third of all rows are one vector
    rows += [(900, None), (901, [None] + [0.1] * 19), (902, [float("nan")] * 20), (903, [float("inf")] + [0.0] * 19), (904, []), (None, rows[3][1]), (5, rows[4][1])]
    rows += [(905, [0.5] * 7), (906, [0.5] * 7)]  # another length than most
    df = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id bigint, embedding array<float>, id int, x double, component string").repartition(5)
    got = whitening.whitened(df).collect()
    want, shares = brute([(i, v) for i, v in rows if v is None or len(v) in (0, 20)])
    assert len([1 for w in want if w[0] == 5]) == 2
    one_each = [w for w in want if w[0] != 5]
    compare([r_ for r_ in got if r_["id"] != 5], one_each, shares)
    assert len([r_ for r_ in got if r_["id"] == 5]) == 32 and len(shares) == 16
    assert not {r_["id"] for r_ in got} & set(range(900, 910))


def test_few_dimensions_and_no_variance(spark):
    def run(rows):
        return whitening.whitened(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()

    rows = [(1, [0.0, 0.0, 1.0]), (2, [1.0, 0.0, 1.0]), (3, [1.0, 2.0, 1.0]), (4, [1.0, 2.0, 1.0])]
    got = run(rows)
    assert {r["component"] for r in got} == {1, 2}  # the third direction has no variance
    compare(got, *brute(rows))
    assert run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == [] and run([(1, None)]) == []
    assert whitening.whitened(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []
    # Entries whose exact deviation is no long, and entries too large to be one.
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [5e8, 3.0]), (4, [1e30, 0.0])]
    got = run(rows)
    assert {r["id"] for r in got} == {1, 2, 3} and {r["deviation"] for r in got} == {None} and got[0]["identity_error"] < 1e-4


def test_query(spark):
    from scribelake.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    got = queries.op11_whitening(spark, "/root/testdata/sf0.001").withColumnRenamed("vec_id", "id").collect()
    compare(got, *brute([(r["vec_id"], r["embedding"]) for r in rows]))
