"""Whitening against a covariance and eigenvectors worked out in one place."""
import math

import numpy as np
import pytest

from heatline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string"


def table(spark, vectors):
    return spark.createDataFrame([(k, v, 7, "x") for k, v in enumerate(vectors)], SCHEMA)


def counted(vector):
    return vector is not None and len(vector) and all(c is not None and math.isfinite(c) for c in vector)


def plain(vectors, components):
    """(rows by id, n, deviations, |whitened|, explained) by numpy's own eigenvectors."""
    kept = {k: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) + 1_000_000
            for k, v in enumerate(vectors) if counted(v)}
    fit = np.array(sorted({tuple(x) for x in kept.values()}))
    n, sums = len(fit), fit.sum(axis=0)
    off = fit * n - sums
    covariance = (off / n).T @ (off / n) / n
    values, turn = np.linalg.eigh(covariance)
    values, turn = values[::-1], turn[:, ::-1]
    rank = int((values > 1e-10 * values[0]).sum())
    wanted = min(components, rank)
    out = {}
    for k, x in kept.items():
        w = ((x * n - sums) / n) @ turn[:, :wanted] / np.sqrt(values[:wanted])
        out[k] = (int(((x * n - sums) ** 2).sum()), w)
    return n, out, values[:wanted] / np.trace(covariance)


def compare(rows, vectors, components=16):
    n, wanted, shares = plain(vectors, components)
    found = {}
    for r in rows:
        found.setdefault(r.vec_id, {})[r.component] = r
    assert set(found) == set(wanted)
    sign = {}
    for k, (deviation, w) in wanted.items():
        assert set(found[k]) == set(range(1, len(w) + 1))
        for j, value in enumerate(w):
            r = found[k][j + 1]
            assert (r.n, r.deviation) == (n, deviation)
            assert r.explained == pytest.approx(shares[j], rel=1e-10)
            assert r.identity_error <= 1e-9
            if abs(value) > 1e-3:
                sign.setdefault(j, math.copysign(1, value * r.whitened))
            assert r.whitened == pytest.approx(value * sign.get(j, 1), rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("length, guard, degree", [(64, 24, 10), (64, 4, 6), (20, 24, 10), (5, 2, 3)])
def test_components(spark, length, guard, degree):
    random = np.random.default_rng(length + guard)
    scale = 0.93 ** np.arange(length)
    vectors = [[float(np.float32(c)) for c in v] for v in random.standard_normal((400, length)) * scale * 3 + 1]
    vectors += [vectors[0]] * 300 + [None, [], [None] * length, [float("nan")] * length,
                                     [float("inf"), *[1.0] * (length - 1)]]
    frame = table(spark, vectors)
    model = whitening.fit(frame, guard=guard, degree=degree)
    assert model.residual <= 1e-12
    compare(whitening.whitened(frame, model, keep=["vec_id"]).collect(), vectors)


def test_few_dimensions_span_less(spark):
    random = np.random.default_rng(2)
    base = random.integers(-9, 9, (60, 3))
    vectors = [[float(c) for c in (a, b, a + b, 0, c3)] for a, b, c3 in base]
    frame = table(spark, vectors)
    model = whitening.fit(frame)
    assert len(model.values) == 3
    compare(whitening.whitened(frame, model, keep=["vec_id"]).collect(), vectors)


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[1e30, 1.0]]])
def test_nothing_to_fit(spark, vectors):
    frame = table(spark, vectors)
    result = whitening.whitened(frame, whitening.fit(frame), keep=["vec_id", "n"])
    assert result.collect() == []
    assert result.columns[:3] == ["vec_id", "n", "component"] and len(set(result.columns)) == len(result.columns)


def test_other_lengths_and_large_numbers(spark):
    vectors = [[1e9, 0.0], [-1e9, 5.0], [3e9, 2.0], [1.0], [1.0, 2.0, 3.0], [1e9, 0.0]]
    frame = table(spark, vectors)
    rows = whitening.whitened(frame, whitening.fit(frame), keep=["vec_id"]).collect()
    assert {r.vec_id for r in rows} == {0, 1, 2, 5} and {r.n for r in rows} == {3}
    # The vector at the mean is near enough for 64 bits.
    assert {r.vec_id for r in rows if r.deviation is None} == {1, 2}
