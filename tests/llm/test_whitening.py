"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest

from depweave.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def dense(vectors):
    """(rows that remain as integers, distinct rows, covariance of these)."""
    kept = [v for v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [tuple(math.floor(256 * c) for c in v) for v in kept]
    fit = np.array(sorted(set(x)), float)
    c = fit - fit.mean(axis=0)
    return x, fit, c.T @ c / len(fit)


def held_to(rows, ids_and_vectors, k=4):
    """Compares the rows of ``whitened`` with the dense result."""
    x, fit, v = dense([b for _, b in ids_and_vectors])
    ids = [a for a, b in ids_and_vectors if b and all(c is not None and math.isfinite(c) for c in b)]
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    sums = [sum(int(c) for c in col) for col in fit.T.tolist()]
    want = {}
    for i, row in zip(ids, x, strict=True):
        dev = sum((len(fit) * c - s) ** 2 for c, s in zip(row, sums, strict=True))
        w = (np.array(row) - fit.mean(axis=0)) @ q / np.sqrt(e)
        want.setdefault(i, []).append((dev, w))
    signs = {}
    got = {}
    for r in rows:
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
        assert r["n"] == len(fit) and r["identity_error"] < 1e-9
        assert abs(r["explained"] - e[r["component"] - 1] / np.trace(v)) < 1e-9
    assert len(rows) == len(x) * min(k, len(e))
    for (i, c), found in got.items():
        ours = sorted((int(r["deviation"]), r["whitened"]) for r in found)
        if c not in signs:
            signs[c] = 1.0 if abs(ours[0][1] - sorted((d, w[c - 1]) for d, w in want[i])[0][1]) < 1e-6 else -1.0
        theirs = sorted((d, signs[c] * w[c - 1]) for d, w in want[i])
        assert [d for d, _ in ours] == [d for d, _ in theirs]
        assert np.allclose([w for _, w in ours], [w for _, w in theirs], atol=1e-7)


def test_query_over_the_table(spark):
    rows = queries.op12_embedding_whitening(spark, SF).collect()
    assert all(r["deviation"] == r["deviation_exact"] for r in rows)
    held_to(rows, [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])


def test_nulls_bad_entries_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(60, 6)) * [5, 4, 3, 2, 1, 0.5])]
    rows += [rows[3], rows[3], (None, rows[5][1]), (7, rows[8][1]), (100, None), (101, [None, *rows[0][1][1:]]), (102, [math.nan] * 6), (103, [math.inf] * 6), (104, [-math.inf] * 6)]
    odd = [(105, []), (106, [1.0] * 5), (107, [1.0] * 7)]
    df = spark.createDataFrame([(a, b, 1, "c") for a, b in rows + odd], "vec_id long, embedding array<double>, n int, __x string").repartition(5)
    held_to(whitening.whitened(df).collect(), rows)


def test_no_rows_one_row_and_dependent_dimensions(spark):
    schema = "vec_id long, embedding array<float>"
    empty = whitening.whitened(spark.createDataFrame([], schema))
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)]
    rows = whitening.whitened(spark.createDataFrame(line, schema)).collect()
    assert {r["component"] for r in rows} == {1} and len(rows) == 9
    assert abs(sum(r["whitened"] ** 2 for r in rows) / 9 - 1) < 1e-9 and abs(rows[0]["explained"] - 1) < 1e-12


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e15, 3.0]), (2, [-1e15, 2.0]), (3, [0.0, 9.0])]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert got == {i: sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for (i, _), v in zip(rows, x, strict=True)}
    beyond = [(1, [1e300, 0.0]), (2, [-1e300, 1.0])]
    assert len(whitening.whitened(spark.createDataFrame(beyond, "vec_id long, embedding array<double>")).collect()) == 2


@pytest.mark.parametrize("decay", [1.0, 0.999, 0.9, 0.5])
def test_iteration_certifies_all_components_whatever_the_spectrum(decay):
    rng = np.random.default_rng(2)
    d, k = 96, 4
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = 1000 * decay ** np.arange(d)
    v = (basis * values) @ basis.T
    vectors, found, residuals, passes = whitening.iterate(lambda q: v @ q, d, k)
    assert np.allclose(found, values[:k], rtol=1e-12) and residuals.max() < 1e-11 * values[0]
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    assert passes < 25
    if decay < 1:
        assert np.allclose(np.abs(np.sum(vectors * basis[:, :k], axis=0)), 1, atol=1e-12)


def test_matrix_is_never_formed_for_steep_spectra():
    rng = np.random.default_rng(3)
    d = 400
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = (basis * 0.3 ** np.arange(d)) @ basis.T
    widths = []
    whitening.iterate(lambda q: widths.append(q.shape[1]) or v @ q, d, 4)
    assert max(widths) == 16
