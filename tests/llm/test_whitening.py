"""Whitening against numpy over the whole table, and on odd vectors."""

import numpy as np
import pytest

from factloom.llm import whitening

ROWS = "vec_id long, embedding array<float>, n long, z string, component double"


def frame(spark, rows, n=3):
    return spark.createDataFrame([(k, v, 1, "z", 0.5) for k, v in rows], ROWS).repartition(n)


def expected(rows, components=16):
    x = {tuple(int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v) for _, v in rows}
    fit = np.array(sorted(x), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return n, sums, values, vectors, np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("d,count", [(5, 300), (20, 4000)])
def test_whitened(spark, d, count):
    rng = np.random.default_rng(d)
    base = rng.normal(size=(count, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d) * 100
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)]
    rows += [(k, rows[7][1]) for k in range(count, count + 200)] + [rows[3], (None, rows[4][1])]
    odd = [(-1, None), (-2, []), (-3, [None] * d), (-4, [float("nan")] * d), (-5, [float("inf")] + [0.0] * (d - 1)), (-6, [1.0] * (d + 1)), (-7, [1e30] * d)]
    got = whitening.whitened(frame(spark, rows + odd)).collect()
    n, sums, values, vectors, trace = expected(rows)
    keep = min(16, d)
    assert len(got) == len(rows) * keep
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-9)
    signs = None
    for key, vector in rows:
        x = np.array([int(np.floor(64 * c)) + 1_000_000 for c in vector], dtype=object)
        own = sorted(by_id[key], key=lambda r: r["component"])[:: len(by_id[key]) // keep]
        assert {r["deviation"] for r in own} == {sum(int(v) ** 2 for v in x * n - sums)}
        want = ((x * n - sums) / n).astype(float) @ vectors / np.sqrt(values)
        mine = np.array([r["whitened"] for r in own])
        signs = np.sign(want * mine) if signs is None else signs
        assert mine == pytest.approx(want * signs, abs=1e-6)


def test_merge_is_the_whole():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (100, 4)) + 1_000_000

    def own(part):
        mean = part.mean(axis=0)
        return len(part), part.sum(axis=0).astype(object), (part - mean).T @ (part - mean)

    n, sums, scatter = whitening.merged(whitening.merged(own(x[:10]), own(x[10:11])), own(x[11:]))
    assert n == 100 and list(sums) == list(x.sum(axis=0))
    assert scatter == pytest.approx(np.cov(x.T, bias=True) * 100, rel=1e-12)


def test_degenerate(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [(1, None)])).count() == 0
    assert whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whitened(frame(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(10)])).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 10 and line[0]["explained"] == pytest.approx(1)


def test_large_entries(spark):
    """Deviations beyond a long are null; nothing overflows on the way."""
    rows = [(k, [float(2**33) * (-1) ** k, float(2**24) * (k * 37 % 500)]) for k in range(500)]
    got = whitening.whitened(frame(spark, rows)).collect()
    assert len(got) == 1000 and {r["deviation"] for r in got} == {None}
    assert all(r["identity_error"] < 1e-4 for r in got)
