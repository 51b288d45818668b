"""Whitening against dense eigenvectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsgraph.llm import whitening


def entries(rows):
    return np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows], dtype=object)


def check(spark, data, kept, kind="float"):
    """Rows of the operator over data, beside numpy's over the rows that are to be kept."""
    df = spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>").repartition(3).withColumns({"x": F.lit(1), "Component": F.lit(2)})
    found = whitening.components(df).collect()
    x = entries(kept)
    n, s = len(x), x.sum(0)
    centred = (x - s // n).astype(float) - (s % n / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    keep = e > 1e-10 * e[0]
    e, u = e[keep], u[:, keep]
    assert len(found) == n * len(e) and {r.component for r in found} == set(range(1, len(e) + 1)) and {r.n for r in found} == {n}
    deviations = ((n * x - s) ** 2).sum(1)
    want = {}
    for (i, _), d, w in zip(kept, deviations, centred @ u / np.sqrt(e)):
        want.setdefault(i, []).append((d, w))
    trace = np.trace(centred.T @ centred / n)
    for k in range(len(e)):
        own = [r for r in found if r.component == k + 1]
        assert all(math.isclose(r.explained, e[k] / trace, rel_tol=1e-9) and r.identity_error < 1e-9 for r in own)
        pairs = []
        for i, rows in want.items():
            mine = sorted((r.deviation, abs(r.whitened)) for r in own if r.vec_id == i)
            pairs += list(zip(mine, sorted((d, abs(w[k])) for d, w in rows)))
        assert all(a[0] == b[0] and math.isclose(a[1], b[1], abs_tol=1e-8) for a, b in pairs)
        # Either sign, the same for all rows.
        lone = {i: rows[0][1][k] for i, rows in want.items() if len(rows) == 1 and abs(rows[0][1][k]) > 1e-3}
        assert len({np.sign(r.whitened) * np.sign(lone[r.vec_id]) for r in own if r.vec_id in lone}) <= 1
    return found


def gauss(n, d, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, (rng.standard_normal(d) * np.linspace(0.05, 1, d)).astype(np.float32).tolist()) for i in range(n)]


def test_equals_dense_eigenvectors(spark):
    data = gauss(300, 40)
    check(spark, data, data)


def test_what_is_left_out_and_repeated(spark):
    data = gauss(80, 12)
    kept = data + [data[3]] * 50 + [(None, data[5][1])]
    bad = [(200, None), (201, [None] + [0.0] * 11), (202, [float("nan")] + [0.0] * 11), (203, [float("inf")] * 12), (204, []), (205, [1.0]), (206, [1e30] + [0.0] * 11)]
    check(spark, kept + bad, kept)


def test_fewer_dimensions_and_rank(spark):
    data = gauss(50, 3)
    check(spark, data, data)
    flat = [(i, [v[0], v[0], 2.0, v[1]]) for i, v in gauss(50, 3)]
    check(spark, flat, flat)


def test_doubles_and_large_entries(spark):
    data = [(i, [1e9 * v[0], v[1], v[2]]) for i, v in gauss(40, 3)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = {r.vec_id: r.deviation for r in whitening.components(df).collect()}
    x = entries(data)
    want = ((len(x) * x - x.sum(0)) ** 2).sum(1)
    assert found == {i: d if d < 2**63 else None for (i, _), d in zip(data, want)} and None in found.values()


@pytest.mark.parametrize("data", [[], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, None)]])
def test_without_variance_there_are_no_components(spark, data):
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    found = whitening.components(df)
    assert found.collect() == [] and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_close_eigenvalues_converge(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.standard_normal(90).tolist()) for i in range(400)]
    check(spark, data, data, "double")
