"""As-of and interval joins by brute force: one key with most of the rows, ties, nulls, empty sides."""

import random

import pytest

from tidemark.operators import temporal


def keys(rng):
    return rng.choice([1, 1, 1, 2, 3, None])


@pytest.mark.parametrize("strict,within", [(False, None), (True, None), (False, 5.0), (True, 3.0)])
def test_as_of(spark, strict, within):
    rng = random.Random(8)
    time = lambda: None if rng.random() < 0.05 else rng.randrange(60)
    left = [(i, keys(rng), time(), f"l{i}") for i in range(200)] + [(0, 1, 5, "l0")] * 2
    right = [(keys(rng), time(), i, None if i % 11 == 0 else f"r{i}") for i in range(80)]
    ldf = spark.createDataFrame(left, "id long, k long, t long, note string").repartition(5)
    rdf = spark.createDataFrame(right, "k long, t long, n long, name string").repartition(3)
    want = []
    for i, k, t, note in left:
        fit = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and (r[1] < t if strict else r[1] <= t)]
        best = max(fit, key=lambda r: (r[1], r[2]), default=None)
        if best and within is not None and t - best[1] > within:
            best = None
        want.append((k, t, i, note, best and best[3], best and best[2]))
    got = temporal.as_of(ldf, rdf, "k", "t", ["name", "n"], tie="n", strict=strict, within=within)
    assert got.columns == ["k", "t", "id", "note", "name", "n"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert temporal.as_of(ldf.limit(0), rdf, "k", "t", ["name"]).count() == 0
    assert {r.name for r in temporal.as_of(ldf, rdf.limit(0), "k", "t", ["name"]).collect()} == {None}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_intervals(spark, width):
    rng = random.Random(9)
    points = [(i, keys(rng), rng.choice([None, rng.randrange(-20, 60)])) for i in range(120)]
    spans = [(i, keys(rng), a, a + rng.randrange(-3, 15)) for i, a in enumerate(rng.randrange(-20, 60) for _ in range(60))] + [(60, 1, None, 3), (61, 1, 0, None)]
    p = spark.createDataFrame(points, "p long, k long, at long")
    s = spark.createDataFrame(spans, "s long, k long, a long, b long")
    got = temporal.in_intervals(p, s, "k", "at", "a", "b", width)
    want = [(i, j) for i, k, t in points for j, l, a, b in spans if None not in (k, l, t, a, b) and k == l and a <= t < b]
    assert sorted((r.p, r.s) for r in got.collect()) == sorted(want)
    other = s.selectExpr("s as s2", "k", "a as a2", "b as b2")
    both = temporal.overlapping(s, other, "k", ("a", "b", "a2", "b2"), width)
    want = [(i, j) for i, k, a, b in spans for j, l, c, d in spans if None not in (k, l, a, b, c, d) and k == l and a < b and c < d and a < d and c < b]
    assert sorted((r.s, r.s2) for r in both.collect()) == sorted(want)
