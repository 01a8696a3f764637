"""Global splines against a dense collocation solve."""

import numpy as np
import pytest
from fixture_paths import SF0001

from chronoframe.operators.spline import Block, spline_interpolate


def knots(x, k):
    n = len(x)
    if k % 2:
        inner = x[(k + 1) // 2:n - (k + 1) // 2]
    else:
        mid = (x[1:] + x[:-1]) / 2
        inner = mid[k // 2:len(mid) - k // 2]
    return np.concatenate([[x[0]] * (k + 1), inner, [x[-1]] * (k + 1)])


def bspline(t, i, k, x, m):
    """Cox-de Boor by its recursion; m is the interval that counts as x's own."""
    if k == 0:
        return 1.0 if i == m else 0.0
    out = 0.0
    if t[i + k] > t[i]:
        out += (x - t[i]) / (t[i + k] - t[i]) * bspline(t, i, k - 1, x, m)
    if t[i + k + 1] > t[i + 1]:
        out += (t[i + k + 1] - x) / (t[i + k + 1] - t[i + 1]) * bspline(t, i + 1, k - 1, x, m)
    return out


def dense(x, y, k, at):
    t, n = knots(x, k), len(x)

    def row(v):
        m = int(np.clip(np.searchsorted(t, v, side="right") - 1, k, n - 1))
        return [bspline(t, i, k, v, m) if m - k <= i <= m else 0.0 for i in range(n)]
    c = np.linalg.solve(np.array([row(v) for v in x]), y)
    return np.array([row(v) for v in at]).reshape(-1, n) @ c


def rows_of(rng, n, share):
    x = np.arange(n)
    y = np.sin(x / 7.0) * 3 + rng.normal(size=n) * 0.3
    return x, np.where(rng.random(n) < share, np.nan, y)


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_orders_in_small_blocks(spark, order):
    rng = np.random.default_rng(order)
    series = {name: rows_of(rng, n, 0.3) for name, n in (("a", 260), ("b", 37), ("c", 3))}
    df = spark.createDataFrame([(s, int(i), None if np.isnan(v) else float(v), 1.0, "w") for s, (x, y) in series.items()
                                for i, v in zip(x, y)], "s string, idx long, v double, w double, _x string").repartition(5)
    # tiny blocks and groups of two relations: several levels of relations
    out = spline_interpolate(df, ["v"], order, keys=["s"], size=16, group=2).collect()
    assert len(out) == len({(r.s, r.idx) for r in out}) == df.count() and out[0].__fields__ == df.columns
    for name, (x, y) in series.items():
        seen = ~np.isnan(y)
        got = {r.idx: r.v for r in out if r.s == name}
        first = x[seen][0] if seen.any() else len(x)
        gaps = x[~seen]
        if seen.sum() <= order:
            assert all(got[int(i)] is None for i in gaps)
            continue
        assert all(got[int(i)] is None for i in gaps if i < first)
        at = gaps[gaps > first].astype(float)
        want = dense(x[seen].astype(float), y[seen], order, at)
        scale = np.maximum(np.abs(want), 1)
        assert np.abs((np.array([got[int(i)] for i in at]) - want) / scale).max(initial=0) < 1e-8
        assert all(got[int(i)] == y[i] for i in x[seen])


def test_block_size_does_not_matter(spark):
    rng = np.random.default_rng(9)
    x, y = rows_of(rng, 3000, 0.2)
    df = spark.createDataFrame([(int(i), None if np.isnan(v) else float(v)) for i, v in zip(x, y)], "idx long, v double")
    a, b = ({r.idx: r.v for r in spline_interpolate(df, ["v"], 3, size=s).collect()} for s in (40, 100_000))
    assert all((a[i] is None and b[i] is None) or abs(a[i] - b[i]) < 1e-9 for i in a)


def test_polynomials_are_reproduced(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 1 else float(i ** 2 - 5 * i), None) for i in range(100)],
                               "idx long, v double, empty double")
    for r in spline_interpolate(df, ["v", "empty"], 2, size=16).collect():
        assert abs(r.v - (r.idx ** 2 - 5 * r.idx)) < 1e-6 and r.empty is None
    assert spline_interpolate(df.limit(0), ["v"], 3).collect() == []


def test_one_long_block_meets_its_observations():
    """Uneven positions, 20,000 of them in a single block."""
    rng = np.random.default_rng(1)
    x = np.sort(rng.choice(100_000, 20_000, replace=False)).astype(float)
    y = rng.normal(size=len(x))
    block = Block(3, len(x), 0, len(x), 0, x)
    c = block.coefficients(x, y, np.zeros(3), np.zeros(3))
    start, value = block.basis(x)
    assert np.abs((c[start[:, None] + np.arange(4) + 3] * value).sum(axis=1) - y).max() < 1e-9


def test_registered_queries(spark):
    import __spark_entry__ as entry
    q = entry.queries()
    for name in ("spline_hourly", "ld_spline"):
        out = q[name](spark, SF0001)
        assert out.count() > 0
