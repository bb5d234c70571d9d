"""Whitening against numpy, with awkward rows."""
import collections
from fractions import Fraction

import numpy as np
import pytest

from reelframe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, index string, component string, x int"


def vectors(n=300, dims=7, offset=0.0):
    r = np.random.default_rng(4)
    v = (r.normal(size=(n, dims)) * np.arange(1, dims + 1) + offset).astype(np.float32)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)] + [(5, rows[9][1]), (None, rows[0][1])]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * (dims - 2)), (2002, [float("nan")] * dims), (2003, [float("inf")] * dims), (2004, [0.0] * dims), (2005, [1.5] * (dims - 2)), (2006, [])]
    return [(i, v, "a", "b", 1) for i, v in rows]


def brute(rows, dims, most):
    kept = [(i, list(v) + [0.0] * (dims - len(v))) for i, v, *_ in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [(i, tuple(int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v)) for i, v in kept]
    fit = sorted({t for _, t in x})
    n, s = len(fit), [sum(t[k] for t in fit) for k in range(dims)]
    c = np.array([[float(Fraction(n * t[k] - s[k], n)) for k in range(dims)] for t in fit])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    out = collections.Counter()
    for i, t in x:
        y = np.array([float(Fraction(n * t[k] - s[k], n)) for k in range(dims)]) @ u / np.sqrt(e)
        out.update((i, k + 1, n, sum((n * t[j] - s[j]) ** 2 for j in range(dims)), round(abs(float(y[k])), 6), round(float(e[k] / np.trace(c.T @ c / n)), 8)) for k in range(len(e)))
    return out


@pytest.mark.parametrize("most, offset", [(16, 0.0), (3, 4000.0)])
def test_whitening_equals_numpy(spark, monkeypatch, most, offset):
    monkeypatch.setattr(whitening, "ROWS", 50)
    rows = vectors(offset=offset)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5), most).collect()
    assert collections.Counter((r["vec_id"], r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 6), round(r["explained"], 8)) for r in got) == brute(rows, 7, most)
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    signs = collections.defaultdict(set)
    for r in got:
        if r["vec_id"] == 3 or r["vec_id"] >= 1000 and r["vec_id"] < 1150:
            signs[r["component"]].add(r["whitened"])
    assert all(len(v) == 1 for v in signs.values())


def test_little_variance(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], "a", "b", 1) for i in range(5)], SCHEMA)
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], "a", "b", 1) for i in range(5)], SCHEMA)
    rows = whitening.whiten(line).collect()
    assert {r["component"] for r in rows} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in rows)
    assert abs(sum(r["whitened"] ** 2 for r in rows) / 5 - 1) < 1e-9


def test_deviation_beyond_a_long_is_null(spark):
    far = spark.createDataFrame([(0, [3.0e8, 0.0], "a", "b", 1), (1, [-3.0e8, 0.0], "a", "b", 1), (2, [0.0, 1.0], "a", "b", 1)], SCHEMA)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(far).where("component = 1").collect()}
    assert got[0] is None and got[1] is None and got[2] is not None
