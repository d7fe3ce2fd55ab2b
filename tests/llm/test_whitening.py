"""Whitening against numpy in one piece."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from folioscope.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string"


def by_hand(vectors, top):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    exact = n * x - sums
    centred = np.array([[float(Fraction(int(c), n)) for c in row] for row in exact])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, [int((row**2).sum()) for row in exact], centred @ axes[:, :top] / np.sqrt(values[:top]), values[:top] / values.sum()


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    mixing = np.linspace(1, 4, 12)[:, None] * np.linalg.qr(rng.normal(0, 1, (12, 12)))[0]
    return (rng.normal(0, 1, (300, 12)) @ mixing + rng.normal(0, 3, 12)).astype(np.float32).tolist()


@pytest.fixture(scope="module")
def table(spark, vectors):
    broken = [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [1.0] * 11 + [float("inf")]), (905, [1.0] * 11 + [float("-inf")])]
    rows = [(i if i != 7 else None, v, 1, "x") for i, v in enumerate(vectors)] + [(i, v, 2, "y") for i, v in broken]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize(("top", "block_rows"), [(32, 1024), (5, 7)])
def test_against_one_piece(table, vectors, top, block_rows):
    rows = whitening.whiten(table, top=top, block_rows=block_rows).collect()
    count = min(top, 12)
    n, deviation, white, explained = by_hand(vectors, count)
    assert len(rows) == 300 * count and {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1
    assert rows[0].identity_error < 1e-9
    found = np.zeros((300, count))
    for r in rows:
        k = 7 if r.vec_id is None else r.vec_id
        found[k, r.component - 1] = r.whitened
        assert int(r.deviation) == deviation[k] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found - white * signs).max() < 1e-7


def test_equal_rows_and_ids_stay_apart(spark):
    rows = [(1, [0.5, 2.0], 0, ""), (1, [0.5, 2.0], 0, ""), (1, [1.5, -2.0], 0, ""), (2, [2.5, 0.0], 0, "")]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA), keep=["vec_id", "label", "n"])
    assert found.columns == ["vec_id", "label", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.where("vec_id = 1").count() == 6 and found.where("vec_id = 2").count() == 2


def test_no_variance_no_components(spark):
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, "")] * 3, SCHEMA)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 3.0, 2.0 * i], 0, "") for i in range(6)], SCHEMA)).collect()
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12


def test_empty_and_broken(spark, table):
    assert whitening.whiten(table.limit(0)).collect() == []
    assert whitening.whiten(table.where("label = 2")).collect() == []
    with pytest.raises(ValueError, match="components"):
        whitening.whiten(spark.createDataFrame([(1, [1.0], 0, ""), (2, [1.0, 2.0], 0, "")], SCHEMA))
    with pytest.raises(ValueError, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e30], 0, ""), (2, [1.0], 0, "")], SCHEMA))


def test_large_deviations_stay_exact(spark):
    rows = [(i, [float((-1) ** i * 2**40 + i), float(i)], 0, "") for i in range(6)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n string")).collect()
    x = np.array([[int(64 * c) for c in v] for _, v, *_ in rows], dtype=object)
    exact = ((6 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert {(r.vec_id, int(r.deviation)) for r in found} == {(i, int(d)) for i, d in enumerate(exact)}
    assert max(exact) > 2**63
