from fractions import Fraction

import numpy as np
import pytest

from barloom.llm.whitening import Scatter, decompose, whiten

KIND = "vec_id long, embedding array<float>, label int, component int, n long"


def make(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in enumerate(vectors)], KIND)


def brute(x):
    """(deviations, covariance) in exact arithmetic."""
    n, s = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    cov = [[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(len(s))] for i in range(len(s))]
    return dev, np.array(cov)


def test_rows_equal_exact_arithmetic(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 12)) * np.arange(1, 13) / 20).astype("float32").tolist()
    odd = [None, [0.1] * 11 + [None], [0.1] * 11 + [float("nan")], [float("inf")] * 12, [], vectors[0]]
    out = whiten(make(spark, vectors + odd), ["vec_id"]).toPandas()
    kept = vectors + [vectors[0]]
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in kept]
    dev, cov = brute(x)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    assert len(out) == len(kept) * 8 and set(out.n) == {len(kept)}
    assert out.vec_id.max() == len(vectors + odd) - 1 and out.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    by_id = dict(zip([*range(len(vectors)), len(vectors) + 5], dev))
    assert all(int(d) == by_id[i] for i, d in zip(out.vec_id, out.deviation))
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    mean = np.array(x, float).mean(0)
    for k in range(8):
        part = out[out.component == k + 1].sort_values("vec_id")
        want = (np.array(x) - mean) @ u[:, k] / np.sqrt(e[k])
        sign = np.sign(want @ part.whitened.to_numpy())
        assert np.allclose(part.whitened, sign * want, atol=1e-8)
        assert np.allclose(part.explained, e[k] / np.trace(cov), rtol=1e-12)


def test_large_entries_stay_exact():
    rng = np.random.default_rng(6)
    for bits in (3, 23, 24, 30, 50, 58):
        x = rng.integers(-(1 << bits), 1 << bits, (70, 3))
        s = Scatter(3)
        s.add(x[:40])
        s.add(x[40:])
        rows = [[int(c) for c in r] for r in x]
        want = [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]
        assert s.products.tolist() == want and s.sums.tolist() == [sum(c) for c in zip(*rows)]
        back = {}
        for b in s.limbs():
            for i, j, k, v in zip(*[c.to_pylist() for c in b.columns]):
                back[i, j] = back.get((i, j), 0) + (v << (30 * k))
        assert back[-1, -1] == 70 and back[0, 2] == want[0][2] and back[1, -1] == sum(r[1] for r in rows)


def test_far_offsets_do_not_cancel():
    """Rows that differ in their last bits only: float sums of squares would lose them."""
    x = np.array([[(1 << 40) + i % 3, (1 << 40) - i % 2] for i in range(30)])
    s = Scatter(2)
    s.add(x)
    scatter = 30 * s.products - np.outer(s.sums, s.sums)
    e, _, trace = decompose(30, scatter)
    assert np.isclose(trace, np.var(x[:, 0] - (1 << 40)) + np.var(x[:, 1] - (1 << 40))) and np.isclose(e.sum(), trace)


def test_odd_tables(spark):
    assert whiten(make(spark, []), ["vec_id"]).count() == 0
    assert whiten(make(spark, [None, []]), ["vec_id"]).count() == 0
    one = whiten(make(spark, [[0.5, 0.25]]), ["vec_id"]).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)]
    flat = whiten(make(spark, [[0.5, 0.1], [0.25, 0.1], [0.5, 0.1]]), ["vec_id"]).collect()
    assert [r.whitened is None for r in flat] == [False, True] * 3 and flat[0].identity_error < 1e-9
    with pytest.raises(Exception, match="vectors of"):
        whiten(make(spark, [[0.5, 0.1], [0.25]]), ["vec_id"]).collect()
    with pytest.raises(Exception, match="64 bits"):
        whiten(make(spark, [[0.5, 0.1], [1e30, 0.5]]), ["vec_id"]).collect()
