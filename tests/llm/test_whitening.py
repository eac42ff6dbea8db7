"""Whitening against dense eigenvectors; Jacobi-Davidson and its inner solver on plain matrices."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from lustra.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def sound(rows):
    out = []
    longest = 0
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            out.append((i, tuple(math.floor(256 * c) for c in v)))
            longest = max(longest, len(v))
    return [(i, x) for i, x in out if len(x) == longest]


def check(got, rows, components=4):
    kept = sound(rows)
    fit = sorted({x for _, x in kept})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    deviation = {x: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for _, x in kept}
    a = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(a.T @ a / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, dims)
    assert sorted((r["vec_id"], r["component"], r["deviation"]) for r in got) == sorted((i, c + 1, deviation[x]) for i, x in kept for c in range(k))
    assert {r["n"] for r in got} == {n} and all(r["identity_error"] < 1e-10 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["component"], {})[r["vec_id"]] = (r["whitened"], r["explained"])
    for c in range(k):
        want = {i: float(np.dot([float(Fraction(n * p - s, n)) for p, s in zip(x, sums)], vectors[:, c]) / math.sqrt(values[c])) for i, x in kept}
        sign = np.sign(sum(want[i] * by[c + 1][i][0] for i in want))
        assert max(abs(sign * by[c + 1][i][0] - want[i]) for i in want) < 1e-9
        assert all(abs(e / (values[c] / values.sum()) - 1) < 1e-12 for _, e in by[c + 1].values())


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.QUERIES["op13_whitening"](spark, SF).collect(), rows)


def test_odd_vectors(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, (rnd.standard_normal(6) * [5, 3, 2, 1.5, 0.5, 0.2]).tolist()) for i in range(200)]
    rows += [(300, rows[0][1])] * 3 + [(301, None), (302, []), (303, [1.0] * 5), (304, [None] + [1.0] * 5), (305, [math.nan] + [1.0] * 5), (306, [math.inf] + [1.0] * 5)]
    rows += [(307, [-0.0] * 6), (308, [0.0] * 6), (309, [0.001] * 6), (310, [-0.001] * 6)]
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, N long, component string").repartition(5)
    got = whitening.whiten_embeddings(table).withColumnRenamed("id", "vec_id").collect()
    as_float = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    assert len([r for r in got if r["vec_id"] == 300]) == 12
    check([r for r in got if r["vec_id"] != 300], [r for r in as_float if r[0] != 300])


def test_null_ids_few_dimensions_and_no_rows(spark):
    kind = "vec_id long, embedding array<double>"
    two = spark.createDataFrame([(None, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.0, 7.0])], kind)
    got = whitening.whiten_embeddings(two).collect()
    assert len(got) == 6 and sum(r["id"] is None for r in got) == 2
    flat = spark.createDataFrame([(i, [float(i), 3.0, 3.0]) for i in range(5)], kind)
    assert {r["component"] for r in whitening.whiten_embeddings(flat).collect()} == {1}
    for rows in ([], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        assert whitening.whiten_embeddings(spark.createDataFrame(rows, kind)).collect() == []


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [float(i * 10**9), float(i % 3)]) for i in range(50)]
    got = whitening.whiten_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    xs = [(i, (256 * i * 10**9, 256 * (i % 3))) for i in range(50)]
    sums = [sum(x[d] for _, x in xs) for d in (0, 1)]
    assert {(r["id"], int(r["deviation"])) for r in got} == {(i, sum((50 * c - s) ** 2 for c, s in zip(x, sums))) for i, x in xs}


@pytest.mark.parametrize("spectrum", [np.linspace(1, 2, 80), np.r_[[5.0, 5.0, 5.0, 4.9999], np.linspace(0, 4.9, 90)], np.r_[[3.0], np.zeros(40)], [2.0, 1.0], np.ones(30)])
def test_eigenpairs(spectrum):
    d = len(spectrum)
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((d, d)))[0]
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    values, vectors, residuals = whitening.jacobi_davidson(lambda x: a @ x, d, 4)
    want = np.sort(spectrum)[::-1][: min(4, d)]
    assert np.abs(values - want).max() < 1e-13 * max(spectrum)
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-13
    assert (np.linalg.norm(a @ vectors - vectors * values, axis=0) < 1e-13 * max(spectrum)).all() and (residuals < 1e-13 * max(spectrum)).all()


def test_not_converging_is_an_error():
    a = np.diag(np.linspace(1, 2, 200))
    with pytest.raises(ArithmeticError):
        whitening.jacobi_davidson(lambda x: a @ x, 200, 4, rounds=2)


def test_minres_solves_indefinite_systems():
    rnd = np.random.default_rng(9)
    q = np.linalg.qr(rnd.standard_normal((25, 25)))[0]
    a = (q * np.r_[np.linspace(-3, -1, 10), np.linspace(1, 4, 15)]) @ q.T
    b = rnd.standard_normal((25, 3))
    x = whitening.minres(lambda v: a @ v, lambda v: v, b, 60, 1e-13)
    assert np.abs(a @ x - b).max() < 1e-9
    assert not whitening.minres(lambda v: a @ v, lambda v: v, np.zeros((25, 2)), 5, 1e-3).any()


def test_blocks_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 7)
    rows = [(i, np.random.default_rng(i).standard_normal(5).tolist()) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    check(whitening.whiten_embeddings(table).withColumnRenamed("id", "vec_id").collect(), rows)
