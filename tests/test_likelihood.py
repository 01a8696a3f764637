"""Blocked likelihoods against a sequential Kalman filter."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.operators.likelihood import Model, arima_mle, evaluate, from_partial, log_likelihood, to_partial


def sequential(y, phi, theta, mean=0.0):
    """Log-likelihood at the best variance, row by row."""
    r = max(len(phi), len(theta) + 1)
    T = np.zeros((r, r))
    T[:len(phi), 0] = phi
    T[np.arange(r - 1), np.arange(1, r)] = 1
    R = np.zeros(r)
    R[0], R[1:1 + len(theta)] = 1, theta
    V = np.outer(R, R)
    P = V.copy()
    for _ in range(20_000):                     # the stationary covariance by iteration
        P = T @ P @ T.T + V
    a, s, log_f = np.zeros(r), 0.0, 0.0
    for x in y - mean:
        f = P[0, 0]
        k = T @ P[:, 0] / f
        v = x - a[0]
        s, log_f = s + v * v / f, log_f + math.log(f)
        a, P = T @ a + k * v, T @ P @ T.T + V - f * np.outer(k, k)
    n = len(y)
    return -0.5 * (n * (math.log(2 * math.pi) + math.log(s / n) + 1) + log_f), s / n


def arma(rng, n, phi, theta, mean=0.0):
    e = rng.normal(size=n + 200)
    y = np.zeros(n + 200)
    for t in range(5, n + 200):
        y[t] = sum(c * y[t - 1 - i] for i, c in enumerate(phi)) + e[t] + sum(c * e[t - 1 - i] for i, c in enumerate(theta))
    return y[200:] + mean


MODELS = [([0.7], []), ([], [0.6]), ([0.5, -0.3], [0.4]), ([1.2, -0.4], [0.3, 0.2]), ([0.98], [-0.5])]


def frame(spark, y):
    rows = [(i, float(v)) for i, v in enumerate(y)]
    np.random.default_rng(0).shuffle(rows)
    return spark.createDataFrame([(int(i), float(v)) for i, v in rows], "idx long, value double").repartition(5)


@pytest.mark.parametrize("size,group", [(7, 2), (300, 3), (5000, 256)])
def test_equals_a_sequential_filter(spark, size, group):
    rng = np.random.default_rng(3)
    y = arma(rng, 1100, [0.6], [0.3])
    blocks = frame(spark, y).withColumn("_blk", F.floor(F.col("idx") / size))
    models = [Model(np.array(a, float), np.array(b, float), len(y)) for a, b in MODELS]
    for (phi, theta), m, Q in zip(MODELS, models, evaluate(blocks, models, "idx", "value", group)):
        llf, sigma2, _ = log_likelihood(Q, m.log_f, len(y), False)
        want, s2 = sequential(y, phi, theta)
        assert abs(llf - want) <= 1e-8 * abs(want) and abs(sigma2 - s2) <= 1e-8 * s2


def test_partial_autocorrelations_round_trip():
    for pac in ([0.5], [0.3, -0.8], [0.9, 0.1, -0.4]):
        assert to_partial(from_partial(np.array(pac))) == pytest.approx(pac)


def test_planted_model_is_found(spark):
    rng = np.random.default_rng(5)
    y = arma(rng, 3000, [0.6, -0.2], [0.5], mean=4.0)
    got = {r.term: r.coef for r in arima_mle(frame(spark, y), 2, 0, 1, size=500).collect()}
    assert got["ar1"] == pytest.approx(0.6, abs=0.12) and got["ar2"] == pytest.approx(-0.2, abs=0.1)
    assert got["ma1"] == pytest.approx(0.5, abs=0.12) and got["mean"] == pytest.approx(4.0, abs=0.2)
    assert got["sigma2"] == pytest.approx(1.0, abs=0.08) and got["nobs"] == 3000
    # a maximum: no neighbour is better
    phi, theta = [got["ar1"], got["ar2"]], [got["ma1"]]
    assert got["llf"] == pytest.approx(sequential(y, phi, theta, got["mean"])[0], rel=1e-8)
    for k in range(2):
        for s in (-0.01, 0.01):
            near = [c + s * (i == k) for i, c in enumerate(phi)]
            assert sequential(y, near, theta, got["mean"])[0] < got["llf"]


def test_differences_and_no_terms(spark):
    rng = np.random.default_rng(6)
    y = np.cumsum(rng.normal(size=400))
    got = {r.term: r.coef for r in arima_mle(frame(spark, y), 0, 1, 0).collect()}
    s2 = float((np.diff(y) ** 2).mean())
    assert got["sigma2"] == pytest.approx(s2) and got["nobs"] == 399 and "mean" not in got
    assert got["llf"] == pytest.approx(-0.5 * 399 * (math.log(2 * math.pi) + math.log(s2) + 1))
    with pytest.raises(ValueError):
        arima_mle(frame(spark, y[:4]), 2, 0, 2)
