"""Embedding whitening against numpy's eigendecomposition and exact whole numbers."""

import math

import numpy as np
import pytest

from ladle.llm import queries, whitening
from ladle.llm.whitening import Spectrum, rank_one

SCHEMA = "vec_id long, embedding array<double>, x string, id string, whitened int"


def table_of(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, "x", "i", 0) for i, v in vectors], SCHEMA).repartition(parts)


def brute(vectors, k):
    """Per row: whitened up to sign, deviation; and the eigenvalue shares."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    a = np.array(x, dtype=float) - np.array(sums, dtype=float) / n
    values, basis = np.linalg.eigh(a.T @ a / n)
    values, basis = values[::-1], basis[:, ::-1]
    dev = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return a @ basis[:, :k] / np.sqrt(np.maximum(values[:k], 1e-300)), dev, values / values.sum()


def check(spark, vectors, k=8, tol=1e-9, **options):
    got = whitening.whiten(table_of(spark, vectors), components=k, **options).collect()
    white, dev, share = brute(vectors, k)
    assert len(got) == len(vectors)
    by_id = {r.vec_id: r for r in got}
    k = min(k, len(got[0].whitened))
    mine = np.array([by_id[i].whitened for i, _ in vectors])
    sign = np.sign((mine * white[:, :k]).sum(0))
    assert np.abs(mine * sign - white[:, :k]).max() < tol
    assert [int(by_id[i].deviation) for i, _ in vectors] == dev
    assert np.allclose(got[0].explained, share[:k], rtol=1e-9) and got[0].identity_error < 1e-10
    return got


def gaussian(n, p, seed=0):
    rng = np.random.default_rng(seed)
    scale = 3.0 ** -np.arange(p)[:20].repeat(max(1, -(-p // 20)))[:p] + 0.05
    return [(i, [float(c) for c in row]) for i, row in enumerate(rng.normal(size=(n, p)) * scale)]


def test_equals_numpy(spark):
    check(spark, gaussian(400, 24))
    check(spark, gaussian(300, 5, 1), k=8)


def test_repeated_rows_and_one_very_common_vector(spark):
    vectors = gaussian(60, 6, 2)
    check(spark, vectors + [(1000 + i, vectors[0][1]) for i in range(200)], k=4)


def test_fewer_rows_than_dimensions(spark):
    got = check(spark, gaussian(5, 12, 3), k=8)
    assert len(got[0].whitened) == 4


def test_rows_that_are_no_vectors_are_dropped(spark):
    good = gaussian(30, 4, 4)
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, float("nan"), 2.0, 3.0]),
           (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [1.0, 2.0, 3.0])]
    got = whitening.whiten(table_of(spark, good + bad), components=2)
    assert sorted(r.vec_id for r in got.collect()) == list(range(30))
    null_id = whitening.whiten(table_of(spark, [*good, (None, good[0][1])]), components=2).collect()
    assert len(null_id) == 31 and sum(r.vec_id is None for r in null_id) == 1


def test_no_rows_one_row_equal_rows(spark):
    for vectors in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, None)]):
        assert whitening.whiten(table_of(spark, vectors, 2)).count() == 0


def test_deviations_are_exact_for_large_entries():
    x = np.array([[2 ** 62, -5], [-(2 ** 62), 7], [100003, 99999]], dtype=np.int64)
    sums = [sum(int(v) for v in c) for c in x.T]
    model = whitening.Whitening(3, sums, None, None, None, 1.0, 1)
    assert model.deviations(x) == [sum((3 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert whitening._sums(x) == sums


@pytest.mark.parametrize("seed", range(6))
def test_rank_one_updates_and_merges(seed):
    rng = np.random.default_rng(seed)
    p = int(rng.integers(1, 12))
    rows = np.round(rng.normal(size=(40, p)) * 4)
    if seed % 2:
        rows[:, : p // 2] = 1.0  # dimensions without variance: equal eigenvalues
    parts = [Spectrum(p) for _ in range(3)]
    for i, r in enumerate(rows):
        parts[i % 3].add(r, 1 + i % 2)
    parts[0].merge(parts[1])
    parts[0].merge(Spectrum(p))
    parts[0].merge(parts[2])
    full = np.repeat(rows, [1 + i % 2 for i in range(40)], axis=0)
    c = full - full.mean(0)
    s = parts[0]
    assert s.n == len(full) and np.allclose(s.mean, full.mean(0))
    assert np.allclose((s.basis * s.d) @ s.basis.T, c.T @ c, atol=1e-9)
    assert np.allclose(s.basis.T @ s.basis, np.eye(p), atol=1e-12) and (np.diff(s.d) >= 0).all()


def test_rank_one_with_equal_eigenvalues():
    v = np.array([1.0, 2.0, 2.0, 0.0])
    d, basis = rank_one(np.array([1.0, 1.0, 1.0, 5.0]), np.eye(4), v, 0.5)
    want = np.diag([1.0, 1.0, 1.0, 5.0]) + 0.5 * np.outer(v, v)
    assert np.allclose((basis * d) @ basis.T, want) and np.allclose(d, np.linalg.eigvalsh(want))


def test_query_covers_the_table(spark):
    got = queries.op11_embedding_whitening(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    rows = got.collect()
    assert len(rows) == 8 * n and {r.component for r in rows} == set(range(1, 9)) and {r.n for r in rows} == {n}
    assert max(r.identity_error for r in rows) < 1e-9
