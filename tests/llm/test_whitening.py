import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meetledger.llm import whitening
from meetledger.llm.queries import op13_whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    for name in ("x", "n", "component", "whitened", "cell", "value"):
        df = df.withColumn(name, F.lit("x"))
    return df


def vectors(rng, n, d, scales=None):
    scales = np.linspace(2, 1, d) if scales is None else scales
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    return ((rng.standard_normal((n, d)) * scales) @ turn.T).astype(np.float32)


def expected(rows, components=8):
    """vec_id, deviation and whitened of each row, eigenvalues' shares; in one matrix and exact integers."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(col) for col in zip(*x)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array(x, float) - np.array(sums) / n
    values, q = np.linalg.eigh(centred.T @ centred / n)
    values, q = values[::-1][:components], q[:, ::-1][:, :components]
    return deviations, centred @ q / np.sqrt(values), values / (sum(deviations) / n**3)


def compare(got, rows, components=8, error=1e-7):
    deviations, white, shares = expected(rows, components)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by_id) == {i for i, _ in rows} and len(got) == len(rows) * white.shape[1]
    signs = np.sign([sum(by_id[i][k + 1]["whitened"] * white[at, k] for at, (i, _) in enumerate(rows)) for k in range(white.shape[1])])
    for at, (i, _) in enumerate(rows):
        for k in range(white.shape[1]):
            r = by_id[i][k + 1]
            assert r["n"] == len(rows) and r["deviation"] == deviations[at]
            assert abs(r["whitened"] - signs[k] * white[at, k]) < error
            assert abs(r["explained"] / shares[k] - 1) < 1e-9
            assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("d,n", [(64, 300), (96, 700), (5, 50), (32, 400)])
def test_as_by_one_matrix(spark, d, n):
    rng = np.random.default_rng(d)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(rng, n, d))]
    got = whitening.by_component(whitening.whiten(table(spark, rows).repartition(6))).collect()
    compare(got, rows, min(8, d))


def test_query(spark, tmp_path):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(np.random.default_rng(1), 400, 48, np.r_[10, 5, np.ones(46)]))]
    bad = [(900, None), (901, [float("nan")] * 48), (902, [1.0, None] * 24), (903, [float("inf")] * 48), (904, []), (905, [0.5] * 3), (906, [1e30] * 48)]
    table(spark, rows + bad).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_whitening(spark, str(tmp_path)).collect()
    compare(got, rows)
    again = op13_whitening(spark, str(tmp_path)).collect()
    assert sorted((r["vec_id"], r["component"], round(r["whitened"], 6)) for r in got) == sorted((r["vec_id"], r["component"], round(r["whitened"], 6)) for r in again)


def test_iteration_on_hard_spectra():
    rng = np.random.default_rng(4)
    for values in (np.linspace(1.02, 1, 200), np.r_[np.full(5, 3.0), np.linspace(2, 0, 95)], np.ones(80), np.r_[1e9, 1e3, np.ones(78)], np.logspace(0, -12, 120)):
        d = len(values)
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        v = (turn * values) @ turn.T
        found = whitening.leading(lambda q: v @ q, d, 8)
        top = np.sort(values)[::-1][:8]
        assert np.abs(found.values - top).max() <= 1e-11 * top[0]
        assert np.linalg.norm(v @ found.vectors - found.vectors * found.values) <= 1e-8 * top[0]
        assert np.abs(found.vectors.T @ found.vectors - np.eye(8)).max() < 1e-12


def test_filter_is_the_polynomial():
    values = np.linspace(0, 2, 9)
    q = np.eye(9)
    times = lambda block: values[:, None] * block
    got = np.diag(whitening.chebyshev_filter(times, q, times(q), 1.0, 2.0, 6))
    polynomial = np.polynomial.chebyshev.Chebyshev([0] * 6 + [1])
    assert np.allclose(got, polynomial(2 * values - 1) / polynomial(3))


def test_degenerate_tables(spark):
    run = lambda rows: whitening.by_component(whitening.whiten(table(spark, rows))).collect()
    assert run([]) == [] and run([(1, None), (2, [])]) == []
    one = run([(1, [0.5, 0.25])])
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, 0.0), (2, 0, None, 0.0, 0.0)]
    # One direction of variance in forty dimensions; repeated rows and a missing id.
    rows = [(None, [float(k)] + [1.0] * 39) for k in (1, 1, 2, 3, 5)]
    got = run(rows)
    first = sorted(r["whitened"] for r in got if r["component"] == 1)
    spread = np.array([1, 1, 2, 3, 5])
    white = np.sort((spread - spread.mean()) / spread.std())
    assert min(np.abs(first - white).max(), np.abs(first + white[::-1]).max()) < 1e-9
    assert all(r["whitened"] is None and r["explained"] == 0 for r in got if r["component"] > 1) and len(got) == 40


def test_exact_deviations_of_large_numbers(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1e6, 1e6) for _ in range(4)]) for i in range(60)]
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows], object)
    exact = ((x * 60 - x.sum(axis=0)) ** 2).sum(axis=1)
    got = whitening.whiten(table(spark, rows)).select("vec_id", "deviation").collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: d if d < 2**63 else None for i, d in enumerate(exact.tolist())}
