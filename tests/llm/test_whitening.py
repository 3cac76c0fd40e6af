"""Whitening: compared with exact fractions and a plain eigendecomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from strandloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n long, x string, component int"


def _run(spark, rows):
    table = spark.createDataFrame([(i, v, 0, "", 1) for i, v in rows], SCHEMA)
    return [r.asDict() for r in whitening.whitened(table).collect()]


def _brute(rows):
    """Exact means, deviations and covariance of the distinct vectors; then numpy's eigh."""
    fine = [(i, [min(max(math.floor(256 * c) if math.isfinite(256 * c) else int(math.copysign(1 << 70, c)),
                         -(1 << 63)), (1 << 63) - 1) for c in v])
            for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in fine})
    n, dims = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(dims)]
    mean = [Fraction(s, n) for s in sums]
    cov = np.array([[float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in fit) / n) for j in range(dims)]
                    for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    out = {}
    for i, v in fine:
        away = np.array([float(a - m) for a, m in zip(v, mean)])
        out.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(v, sums)), away @ vectors))
    return n, values, np.trace(cov), out


def _compare(found, rows):
    n, values, trace, expected = _brute(rows)
    count = len(values)
    assert len(found) == sum(map(len, expected.values())) * count
    sign = {}
    for row in found:
        k = row["component"] - 1
        dev, projected = expected[row["vec_id"]][0]
        assert row["n"] == n
        assert row["deviation"] == (dev if dev < 1 << 63 else None)
        assert row["explained"] == pytest.approx(values[k] / trace, rel=1e-9, abs=1e-12)
        assert row["identity_error"] < 1e-6
        wanted = projected[k] / math.sqrt(values[k])
        sign.setdefault(k, 1 if abs(row["whitened"] - wanted) < abs(row["whitened"] + wanted) else -1)
        assert sign[k] * row["whitened"] == pytest.approx(wanted, rel=1e-6, abs=1e-7)


def _random(seed, size, dims, scale):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dims, dims)) * np.linspace(3, 0.3, dims)
    return (scale * (rng.normal(size=(size, dims)) @ mix.T + rng.normal(size=dims))).tolist()


@pytest.mark.parametrize("seed, size, dims, scale", [
    (1, 400, 6, 0.2), (2, 60, 3, 0.05), (3, 300, 5, 1e6), (4, 80, 4, 1e15), (5, 9, 2, 1.0)])
def test_equals_exact_arithmetic(spark, seed, size, dims, scale):
    rows = list(enumerate(_random(seed, size, dims, scale)))
    rows += [(i + 10_000, v) for i, v in rows[:7]]  # equal vectors are fitted once
    _compare(_run(spark, rows), rows)


def test_rows_that_take_no_part(spark):
    good = list(enumerate(_random(7, 50, 3, 0.3)))
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 2.0]),
           (94, [float("-inf"), 0.0, 0.0])]
    found = _run(spark, good + bad)
    assert {r["vec_id"] for r in found} == set(range(50))
    _compare(found, good)


def test_negative_zero_and_repeated_keys(spark):
    rows = [(1, [0.0, 1.0]), (1, [-0.0, 1.0]), (None, [2.0, -1.0]), (3, [-1.0, 0.5])]
    found = _run(spark, rows)
    assert {r["n"] for r in found} == {3} and len(found) == 8
    ours = [r["whitened"] for r in found if r["vec_id"] == 1 and r["component"] == 1]
    assert len(ours) == 2 and ours[0] == ours[1]


def test_values_beyond_64_bits(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e160, 2.0]), (3, [0.0, -5.0]), (4, [1e17, 3.0])]
    found = _run(spark, rows)
    n, values, trace, expected = _brute(rows)
    assert len(found) == 8 and {r["deviation"] for r in found} == {None}
    for r in found:
        if r["component"] == 1:
            assert abs(r["whitened"]) == pytest.approx(
                abs(expected[r["vec_id"]][0][1][0]) / math.sqrt(values[0]), rel=1e-9)


def test_nothing_varies(spark):
    found = _run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in found] == [
        (1, 0, None, None, None)] * 4
    line = _run(spark, [(i, [float(i), float(i)]) for i in range(5)])
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True}


def test_lengths_have_models_of_their_own(spark):
    short, long = _random(1, 40, 2, 0.5), _random(2, 40, 5, 0.5)
    rows = [(i, v) for i, v in enumerate(short)] + [(i + 100, v) for i, v in enumerate(long)]
    found = _run(spark, rows)
    _compare([r for r in found if r["vec_id"] < 100], rows[:40])
    _compare([r for r in found if r["vec_id"] >= 100], rows[40:])


def test_empty_table(spark):
    assert _run(spark, []) == []
