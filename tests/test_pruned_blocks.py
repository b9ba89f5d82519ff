"""Neighbours and extremes by bounded blocks, against brute force, with counts of the pairs of blocks left out."""

from collections import Counter

import numpy as np
import pytest

from orebody.operators import classify, stats


def clumps(d, n=40, seed=1):
    """Clumps far apart, with repeated rows and points on a grid, whose distances tie."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, 0.3, (n, d)) for c in rng.uniform(-40, 40, (8, d))]
    return np.concatenate([*parts, np.full((n, d), 3.0), np.round(rng.uniform(0, 4, (n, d)))])


def slow_votes(x, y, group, k):
    out = {}
    for i, v in enumerate(x):
        d = np.round(np.sqrt(((x - v) ** 2).sum(axis=1)), 9)
        near = sorted((d[j], j) for j in range(len(x)) if group[j] != group[i])[:k]
        votes = Counter(y[j] for _, j in near)
        out[i] = min(votes, key=lambda c: (-votes[c], c))
    return out


@pytest.mark.parametrize("d", [2, 12])
def test_neighbours(spark, d):
    x = clumps(d)
    y = [i % 3 for i in range(len(x))]
    group = [i * 7 % 5 for i in range(len(x))]
    rows = [(i, v.tolist(), y[i], group[i]) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (9_999, None, 0, 9)], "id long, v array<double>, y int, fold int").repartition(5)
    tally = {}
    got = {r["id"]: r["prediction"] for r in classify.nearest_neighbours(df, df, "id", "v", "y", 3, "fold", size=25, tally=tally).collect()}
    assert got == slow_votes(x, y, group, 3)
    assert tally["computed"] < tally["pairs"] / 2, tally


def test_neighbours_of_few_rows(spark):
    """Fewer training rows than k, none at all, and one crowd of equal rows: every pair of blocks is open."""
    df = spark.createDataFrame([(1, [0.0], "a"), (2, [1.0], "b")], "id long, v array<double>, y string")
    few = classify.nearest_neighbours(df, df.where("id = 2"), "id", "v", "y", 5)
    assert sorted(tuple(r) for r in few.collect()) == [(1, "b"), (2, "b")]
    assert classify.nearest_neighbours(df, df.limit(0), "id", "v", "y").count() == 0
    assert classify.nearest_neighbours(df.limit(0), df, "id", "v", "y").count() == 0
    same = spark.createDataFrame([(i, [2.0, 2.0], i % 2) for i in range(90)], "id long, v array<double>, y int").repartition(3)
    votes = classify.nearest_neighbours(same, same, "id", "v", "y", 3, size=20)
    assert {r["prediction"] for r in votes.collect()} == {0} and votes.count() == 90  # keys 0, 1, 2 for all


def slow_extremes(x, keys, digits=6):
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), digits)
    pairs = [(d[i, j], min(keys[i], keys[j]), max(keys[i], keys[j])) for i in range(len(x)) for j in range(i)]
    near, far = min(pairs), min(pairs, key=lambda p: (-p[0], *p[1:]))
    return {("closest", near[1], near[2], near[0]), ("farthest", far[1], far[2], far[0])}


@pytest.mark.parametrize("repeated", [True, False])
def test_extremes(spark, repeated):
    x = clumps(3) if repeated else np.random.default_rng(5).uniform(0, 100, (300, 3))
    keys = np.random.default_rng(2).permutation(len(x)).tolist()
    df = spark.createDataFrame([*((k, v.tolist()) for k, v in zip(keys, x)), (9_999, None)], "id long, v array<double>").repartition(5)
    tally = {}
    got = {tuple(r) for r in stats.extreme_pairs(df, "id", "v", size=15, tally=tally).collect()}
    assert got == slow_extremes(x, keys)
    assert tally["computed"] < (0.7 if repeated else 0.8) * tally["pairs"], tally


def test_extremes_of_few_rows(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [0.0]), (3, [0.0])], "id long, v array<double>")
    assert {tuple(r) for r in stats.extreme_pairs(df, "id", "v").collect()} == {("closest", 1, 2, 0.0), ("farthest", 1, 2, 0.0)}
    assert stats.extreme_pairs(df.limit(1), "id", "v").count() == 0
    assert stats.extreme_pairs(df.limit(0), "id", "v").count() == 0


def test_pairs_of_several_blocks(spark, monkeypatch):
    """Every pair once, and silhouettes from sums in both directions, with blocks of 30 rows."""
    from orebody.operators import blocks, evaluate

    whole = blocks.own_pairs
    for module in (stats, evaluate):
        monkeypatch.setattr(module, "own_pairs", lambda df, work, schema: whole(df, work, schema, 30))
    x = clumps(2, 10)
    own = [i % 3 if i else 7 for i in range(len(x))]  # a cluster of one
    df = spark.createDataFrame([(i, v.tolist(), own[i]) for i, v in enumerate(x)], "id long, v array<double>, c int").repartition(5)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {(r["i"], r["j"]): r["d"] for r in stats.pairwise(df, "id", "v").collect()}
    assert len(got) == len(x) * (len(x) - 1) // 2 and all(i < j and abs(v - d[i, j]) < 1e-9 for (i, j), v in got.items())
    for r in evaluate.silhouettes(df, "id", "v", "c").collect():
        i, groups = r["id"], np.array(own)
        if own[i] == 7:
            assert r["silhouette"] == 0
            continue
        a = d[i][(groups == own[i]) & (np.arange(len(x)) != i)].mean()
        b = min(d[i][groups == g].mean() for g in set(own) - {own[i]})
        assert abs(r["silhouette"] - (b - a) / max(a, b)) < 1e-9


def test_weather_does_not_depend_on_partitions(spark):
    from orebody.sources import readers

    one = [tuple(r) for r in readers.weather(spark, 300).collect()]
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        other = readers.weather(spark, 300)
        assert sorted(map(str, one)) == sorted(str(tuple(r)) for r in other.collect())
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert [r[0] for r in one] == sorted(r[0] for r in one)
