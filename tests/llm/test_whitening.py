"""Whitening against sums in Python integers and numpy's covariance."""

import math
from decimal import Decimal

import numpy as np
import pytest

from lociframe.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, component string, n string, x string, whitened string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "c", "n", "x", "w") for i, v in vectors], SCHEMA)


def expected(vectors, components=4):
    """(id, component) -> (n, deviation, whitened, explained), from the definition."""
    x = [(i, [math.floor(256 * c) for c in v]) for i, v in vectors]
    distinct = [list(t) for t in sorted({tuple(v) for _, v in x})]
    n, dims = len(distinct), len(distinct[0])
    s = [sum(v[d] for v in distinct) for d in range(dims)]
    cov = np.array([[(n * sum(v[a] * v[b] for v in distinct) - s[a] * s[b]) / n**2 for b in range(dims)] for a in range(dims)])
    values, basis = np.linalg.eigh(cov)
    out = {}
    for i, v in x:
        for k in range(min(components, dims)):
            e, u = values[-1 - k], basis[:, -1 - k]
            white = sum((c - t / n) * w for c, t, w in zip(v, s, u)) / math.sqrt(e) if e > 1e-9 * values[-1] else None
            out.setdefault((i, k + 1), []).append((n, sum((n * c - t) ** 2 for c, t in zip(v, s)), white, e / np.trace(cov)))
    return out


def check(rows, want):
    assert len(rows) == sum(map(len, want.values()))
    signs = {}
    for r in rows:
        n, deviation, white, explained = next(w for w in want[r.vec_id, r.component] if w[1] == int(r.deviation))
        assert r.n == n
        assert r.explained == pytest.approx(explained, rel=1e-9, abs=1e-12)
        if white is None:
            assert r.whitened is None
        else:
            if abs(white) > 1e-3:
                signs.setdefault(r.component, set()).add(round(r.whitened / white, 6))
            assert abs(r.whitened) == pytest.approx(abs(white), rel=1e-7, abs=1e-7)
        assert r.identity_error < 1e-6
    assert all(s in ({1.0}, {-1.0}) for s in signs.values())


@pytest.mark.parametrize("low,high,rows,dims", [(-256, 256, 700, 7), (0, 2, 65, 3), (-(2**62), 2**62, 40, 3), (7, 8, 3, 2), (-1, 1, 1, 1)])
def test_scatter_equals_integer_products(low, high, rows, dims):
    x = np.random.default_rng(3).integers(low, high, (rows, dims))
    with_ones = np.concatenate([x, np.ones((rows, 1), np.int64)], axis=1).astype(object)
    assert (whitening.scatter(x) == with_ones.T @ with_ones).all()


def test_awkward_vectors(spark):
    random = np.random.default_rng(7)
    good = [(i, [float(c) for c in v]) for i, v in enumerate(random.normal(size=(60, 5)) * [5, 4, 3, 2, 1])]
    good += [(100, good[0][1]), (100, good[1][1]), (None, good[2][1]), (101, [-0.0, 0.0, 1e5, -3.0, 2.0])]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [math.nan] * 5), (203, [math.inf, 0.0, 0.0, 0.0, 0.0]), (204, []), (205, [1.0])]
    check(whitening.whiten(frame(spark, good + bad).repartition(5)).collect(), expected(good))


def test_wide_entries_stay_exact(spark):
    good = [(i, [2.0**45 * i, float(-i * i), 2.0**44 + i]) for i in range(20)]
    rows = whitening.whiten(frame(spark, good), components=1).collect()
    want = expected(good, 1)
    assert [(r.vec_id, int(r.deviation)) for r in rows] == [(i, want[i, 1][0][1]) for i, _ in good]
    assert rows[0].deviation > Decimal(2**63)


def test_no_variance_and_no_rows(spark):
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)]
    rows = whitening.whiten(frame(spark, line)).collect()
    assert len(rows) == 18 and all((r.whitened is None) == (r.component > 1) for r in rows)
    same = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, None, None)] * 4
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []


def test_query(spark):
    data = "/root/testdata/sf0.001"
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    vectors = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    df = queries.op11_whitening(spark, data)
    assert dict(df.dtypes)["deviation"] == "bigint"
    check(df.collect(), expected(vectors))
