import math
from fractions import Fraction

import numpy as np
import pytest

from scorelake.llm import queries, whitening


def brute(rows):
    """n, deviations by row, eigenvalues (falling) and eigenvectors, from exact sums."""
    fine = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in fine})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    off = [[n * x[j] - sums[j] for j in range(d)] for x in fit]
    cov = np.array([[float(Fraction(sum(o[i] * o[j] for o in off), n ** 3)) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    dev = [(i, x, sum((n * x[j] - sums[j]) ** 2 for j in range(d))) for i, x in fine]
    return n, sums, dev, values[::-1], axes[:, ::-1], float(np.trace(cov))


def result(spark, rows):
    docs = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<float>, n int, component string, whitened double")
    return queries.whitened_rows(docs.repartition(3)).collect()


def rows_of(seed, n, d, scale):
    rng = np.random.default_rng(seed)
    return [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(rng.normal(0, 1, (n, d)) @ np.diag(np.linspace(scale, 0.3, d)) @ rng.normal(0, 1, (d, d)))]


def test_against_brute_force(spark):
    rows = rows_of(1, 500, 20, 5)
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(3, rows[4][1]), (None, rows[5][1])]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 18), (2002, [float("nan")] * 20), (2003, [float("-inf")] * 20)]
    n, sums, dev, values, axes, trace = brute(rows)
    got = result(spark, rows)
    assert len(got) == len(dev) * 16 and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, 17))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == sorted((str(i), v) for i, _, v in dev)
    by = {(r["vec_id"], r["component"], r["deviation"]): r for r in got}
    sign = {}
    for i, x, v in dev:
        want = (np.array([n * a - b for a, b in zip(x, sums, strict=True)], float) / n) @ axes[:, :16] / np.sqrt(values[:16])
        for k in range(16):
            r = by[(i, k + 1, v)]
            if abs(want[k]) > 0.1:
                assert sign.setdefault(k, np.sign(want[k] * r["whitened"])) == np.sign(want[k] * r["whitened"])
            assert abs(abs(r["whitened"]) - abs(want[k])) < 1e-8
            assert abs(r["explained"] / (values[k] / trace) - 1) < 1e-9


def test_few_rows_and_dependent_dimensions(spark):
    rows = [(i, [i / 64, 2 * i / 64, 5.0, (i % 3) / 64]) for i in range(12)]
    got = result(spark, rows)
    assert {r["component"] for r in got} == {1, 2, 3, 4} and got[0]["identity_error"] < 1e-6
    n, _, _, values, _, trace = brute(rows)
    for r in got:
        assert (r["whitened"] is None) == (r["component"] > 2)
        assert abs(r["explained"] - max(0, values[r["component"] - 1]) / trace) < 1e-9
    one = result(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 4
    assert {r["component"] for r in result(spark, [(1, [1.0]), (2, []), (3, [0.5])])} == {1}
    assert result(spark, []) == [] and result(spark, [(1, None), (2, [])]) == []
    with pytest.raises(Exception, match="out of range"):
        result(spark, [(1, [1e30])])


def test_large_numbers_stay_exact():
    table = np.array([[1 << 45, 3], [5, 1 << 45]])
    n, sums = 1 << 30, [1 << 70, 1 << 60]
    assert whitening.deviations(table, n, sums) == [None, None]
    assert whitening.deviations(np.array([[(1 << 40) + 7]]), n, [n << 40]) == [(7 * n) ** 2] if (7 * n) ** 2 < 1 << 63 else [None]
    assert np.allclose(whitening.centred(table, n, sums), [[(1 << 45) - 2.0 ** 40, 3 - 2.0 ** 30], [5 - 2.0 ** 40, (1 << 45) - 2.0 ** 30]])


def test_ill_conditioned_rows(spark):
    """Ten orders of magnitude between the directions' variances: one Cholesky pass would not do."""
    rng = np.random.default_rng(3)
    x = np.column_stack([np.rint(rng.normal(0, 3e5, 400)), np.rint(rng.normal(0, 3, 400))])
    x = np.column_stack([x[:, 0], x[:, 0] + x[:, 1]]).astype(np.int64)
    model = whitening.fitted(spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>"), 2)
    fit = np.unique(x, axis=0)
    true = np.linalg.svd(fit - fit.mean(axis=0))[1] ** 2 / len(fit)
    assert np.allclose(model.variance / true, 1, rtol=1e-9) and model.identity_error < 1e-9
