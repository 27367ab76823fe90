import math

import numpy as np
import pytest

from changeflow.llm import whiten

ROWS = "vec_id long, embedding array<double>, component string, n string, y int, i int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", None, 1, 2) for i, v in rows], ROWS)


@pytest.mark.parametrize("d", [1, 2, 5, 40, 90])
def test_leading_matches_a_full_decomposition(d):
    a = np.random.default_rng(d).standard_normal((d, d))
    a = a @ a.T
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    pairs = whiten.leading(a, 16)
    assert np.allclose([x for x, _ in pairs], want[: len(pairs)], rtol=1e-12, atol=1e-12 * want[0])
    assert all(np.linalg.norm(a @ v - x * v) <= 1e-12 * want[0] for x, v in pairs)


def test_equal_and_empty_eigenvalues():
    for diagonal, found in (([3, 3, 2, 2, 2, 1, 0], 6), ([0, 0], 0), ([1] * 20, 16), ([1, 1 + 1e-15, 1e-8, 0], 3)):
        pairs = whiten.leading(np.diag(np.array(diagonal, float)), 16)
        basis = np.array([v for _, v in pairs])
        assert len(pairs) == found and (not found or np.abs(basis @ basis.T - np.eye(found)).max() < 1e-12)
    turn = np.linalg.qr(np.random.default_rng(5).standard_normal((30, 30)))[0]
    close = np.array([5, 5 - 1e-13, 5 - 1e-9, *np.linspace(1, 2, 27)])
    pairs = whiten.leading(turn @ np.diag(close) @ turn.T, 16)
    basis = np.array([v for _, v in pairs])
    assert np.allclose([x for x, _ in pairs], np.sort(close)[::-1][:16], rtol=1e-13) and np.abs(basis @ basis.T - np.eye(16)).max() < 1e-12


def test_whitening_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((300, 20)) @ rng.standard_normal((20, 20)) * 0.3 + 5
    rows = [(i, v) for i, v in enumerate(vectors)] + [(400 + i, vectors[0]) for i in range(200)] + [(None, vectors[1])]
    bad = [(900, None), (901, []), (902, [None] * 20), (903, [math.nan] * 20), (904, [math.inf] + [0] * 19), (905, [1.0] * 3), (906, [-math.inf] * 20)]
    got = whiten.whitened(frame(spark, rows + bad)).collect()
    x = np.floor(64 * np.array([v for _, v in rows])).astype(int) + 1000000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = (fit - s / n).T @ (fit - s / n) / n
    values, vectors = (z[..., ::-1][..., :16] for z in np.linalg.eigh(v))
    want = ((x - s / n) @ vectors) / np.sqrt(values)
    assert len(got) == 16 * len(rows) and {row["vec_id"] for row in got} == {i for i, _ in rows}
    by = {(row["vec_id"], row["component"]): row for row in got}
    signs = np.sign([by[0, c + 1]["whitened"] * want[0, c] for c in range(16)])
    for place, (i, _) in enumerate(rows):
        for c in range(16):
            row = by[i, c + 1]
            assert abs(row["whitened"] - signs[c] * want[place, c]) < 1e-8 and abs(row["explained"] / (values[c] / np.trace(v)) - 1) < 1e-9
            assert row["n"] == n and row["deviation"] == int(((n * x[place] - s) ** 2).sum()) and row["identity_error"] < 1e-9


def test_whitening_of_little(spark):
    assert whiten.whitened(frame(spark, [])).count() == whiten.whitened(frame(spark, [(1, None)])).count() == 0
    assert whiten.whitened(frame(spark, [(1, [1, 2]), (2, [1, 2])])).count() == 0
    got = whiten.whitened(frame(spark, [(1, [1, 2]), (2, [3, 2]), (3, [0])])).collect()
    assert sorted((row["vec_id"], row["component"], row["n"], row["deviation"], abs(row["whitened"])) for row in got) == [(1, 1, 2, 128 * 128, 1.0), (2, 1, 2, 128 * 128, 1.0)]


def test_entries_beyond_doubles(spark):
    """Whole numbers too large for exact products in doubles are summed exactly all the same."""
    big = 2.0**28
    got = whiten.whitened(frame(spark, [(i, [0, big + i / 64]) for i in range(4)])).collect()
    assert sorted({(row["vec_id"], row["deviation"]) for row in got}) == [(0, 36), (1, 4), (2, 4), (3, 36)]
    assert all(abs(row["explained"] - 1) < 1e-12 and row["identity_error"] < 1e-4 for row in got)
