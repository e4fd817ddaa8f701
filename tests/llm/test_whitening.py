"""Embedding whitening against numpy and exact fractions."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from chainage.llm import whitening as wh

SCHEMA = "vec_id bigint, embedding array<float>, n int, component string, `a.b` int"


def vectors(seed: int, n: int, width: int) -> list[list[float]]:
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        base = [rnd.gauss(0, 0.3) for _ in range(width)]
        out.append([float(np.float32(base[i] + 0.5 * base[0] * (i % 3))) for i in range(width)])
    return out


def brute(rows: list[list[float]], most: int = 8):
    """By exact fractions up to the covariance, then ``eigh``."""
    x = [[math.floor(1024 * c) + 100_000 for c in row] for row in rows]
    n, width = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(width)]
    cov = [
        [Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3) for j in range(width)]
        for i in range(width)
    ]
    values, parts = np.linalg.eigh(np.array([[float(v) for v in row] for row in cov]))
    values, parts = values[::-1], parts[:, ::-1]
    kept = int((values[:most] > 1e-10 * values[0]).sum())
    centred = np.array([[float(Fraction(n * r[i] - sums[i], n)) for i in range(width)] for r in x])
    deviation = [sum((n * r[i] - sums[i]) ** 2 for i in range(width)) for r in x]
    return deviation, centred @ parts[:, :kept] / np.sqrt(values[:kept]), values[:kept] / float(sum(cov[i][i] for i in range(width)))


def same(got, rows: list[list[float]], ids: list) -> None:
    deviation, whitened, explained = brute(rows)
    kept = len(explained)
    assert len(got) == len(rows) * kept
    assert {r.n for r in got} == {len(rows)} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-8
    signs = {}
    order = {i: k for k, i in enumerate(ids)}
    for r in got:
        k, c = order[r.vec_id], r.component - 1
        assert int(r.deviation) == deviation[k]
        assert math.isclose(r.explained, explained[c], rel_tol=1e-9)
        if abs(whitened[k, c]) > 1e-3:
            signs.setdefault(c, set()).add(math.copysign(1, r.whitened * whitened[k, c]))
        assert math.isclose(abs(r.whitened), abs(whitened[k, c]), rel_tol=1e-6, abs_tol=1e-7)
    assert all(len(s) == 1 for s in signs.values())


def test_polarisation_is_exact():
    rnd = random.Random(3)
    for most in (10, 10**6, 2**50):
        x = np.array([[rnd.randrange(-most, most) for _ in range(5)] for _ in range(40)], np.int64)
        total = wh.exact_sum(x)
        pivot = np.array([int(t) // 40 for t in total], np.int64)
        got = wh.polarised(40, _mirrored(wh.pair_squares(x - pivot)), total - 40 * pivot.astype(object))
        for i in range(5):
            for j in range(5):
                want = Fraction(sum((40 * int(r[i]) - total[i]) * (40 * int(r[j]) - total[j]) for r in x), 40)
                assert got[i, j] == want


def _mirrored(upper):
    return upper + np.triu(upper, 1).T


def test_equals_brute_force(spark):
    rows = vectors(1, 150, 12)
    rows += [rows[3], rows[3]]
    ids = list(range(len(rows)))
    data = [(i, v, None, "x", 1) for i, v in zip(ids, rows, strict=True)]
    broken = [
        (900, None, 1, None, 1),
        (901, [], 1, None, 1),
        (902, [1.0] * 11, 1, None, 1),
        (903, [None, *rows[0][1:]], 1, None, 1),
        (904, [float("nan"), *rows[0][1:]], 1, None, 1),
        (905, [float("-inf"), *rows[0][1:]], 1, None, 1),
        (906, [3e38, *rows[0][1:]], 1, None, 1),
    ]
    frame = spark.createDataFrame(data + broken, SCHEMA).repartition(5)
    got = wh.whiten(frame)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same(got.collect(), rows, ids)


def test_large_entries_stay_exact(spark):
    rows = [[float(np.float32(c * 2.0**38)) for c in v] for v in vectors(2, 30, 4)]
    got = wh.whiten(spark.createDataFrame([(i, v, 1, "", 1) for i, v in enumerate(rows)], SCHEMA).repartition(3))
    same(got.collect(), rows, list(range(30)))


def test_flat_directions_have_no_component(spark):
    rows = [[v[0], v[0], 0.25, v[1]] for v in vectors(4, 40, 3)]
    got = wh.whiten(spark.createDataFrame([(i, v, 1, "", 1) for i, v in enumerate(rows)], SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2}
    same(got, rows, list(range(40)))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.5])], [(1, [0.5, 1.0])] * 3])
def test_nothing_to_whiten(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert wh.whiten(frame).count() == 0


def test_null_ids_are_returned(spark):
    rows = vectors(5, 20, 3)
    frame = spark.createDataFrame([(None, v) for v in rows], "vec_id bigint, embedding array<double>")
    got = wh.whiten(frame, components=2).collect()
    assert len(got) == 40 and {r.vec_id for r in got} == {None}
