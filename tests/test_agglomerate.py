"""Merging in rounds against merging one pair at a time by the definition of the linkage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebody.operators import agglomerate


def by_definition(keys, x, linkage):
    """[(left, right, height, size)]: the nearest two clusters, over and over, from all distances of their rows."""
    groups, out = [[n] for n in np.argsort(keys)], []
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))

    def apart(a, b):
        if linkage == "ward":
            return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))
        return {"single": np.min, "complete": np.max, "average": np.mean}[linkage](d[np.ix_(a, b)])

    while len(groups) > 1:
        h, i, j = min((apart(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        out.append((keys[groups[i][0]], keys[groups[j][0]], h, len(groups[i]) + len(groups[j])))
        groups[i] = groups[i] + groups.pop(j)
        groups[i].sort(key=lambda n: keys[n])
    return out


def table(spark, keys, x):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in zip(keys, x)], f"k {'string' if isinstance(keys[0], str) else 'long'}, x double, y double")


def cophenetic_by_definition(keys, x, steps):
    at = {k: n for n, k in enumerate(keys)}
    members, joined = {k: [at[k]] for k in keys}, np.zeros((len(x),) * 2)
    for a, b, h, _ in steps:
        joined[np.ix_(members[a], members[b])] = h
        joined[np.ix_(members[b], members[a])] = h
        members[a] += members.pop(b)
    up = np.triu_indices(len(x), 1)
    return np.corrcoef(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))[up], joined[up])[0, 1]


@pytest.mark.parametrize("linkage", agglomerate.LINKAGES)
@pytest.mark.parametrize("last, block", [(1_024, 2_000), (14, 16)])
def test_rounds_merge_as_one_by_one(spark, linkage, last, block):
    """With blocks of 16 rows clusters of over four are split among blocks; with last = 14 most is done in rounds."""
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, (24, 2)), rng.normal(6, 0.5, (20, 2))]
    keys = [f"k{n:03d}" for n in rng.permutation(len(x))]
    steps = agglomerate.merges(table(spark, keys, x), "k", ["x", "y"], linkage, last, block)
    got = [tuple(r) for r in steps.orderBy("step").select("left_id", "right_id", "height", "size").collect()]
    want = by_definition(keys, x, linkage)
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])
    if linkage != "ward":
        assert np.isclose(agglomerate.cophenetic(table(spark, keys, x), ["x", "y"], steps).first()[0], cophenetic_by_definition(keys, x, want))


def test_copies_ties_and_missing_values(spark):
    """Copies merge at 0 first, rows of a grid at its width; null and NaN take no part; one row or none gives no merge."""
    grid = [(n, float(n % 4), float(n // 4)) for n in range(16)]
    rows = grid + [(100 + n, 9.0, 9.0) for n in range(7)] + [(200, None, 1.0), (201, float("nan"), 1.0), (202, float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    for last in (6, 1_024):
        steps = agglomerate.merges(df, "k", ["x", "y"], "single", last, 12).orderBy("step").collect()
        assert [r["height"] for r in steps] == pytest.approx([0.0] * 6 + [1.0] * 15 + [72**0.5])
        assert [(r["left_id"], r["right_id"], r["size"]) for r in steps[:6]] == [(100, 101 + n, n + 2) for n in range(6)]
        assert [(r["left_id"], r["right_id"], r["size"], r["left_size"]) for r in steps[-1:]] == [(0, 100, 23, 16)]
    assert agglomerate.merges(df.limit(1), "k", ["x", "y"]).count() == 0
    assert agglomerate.merges(df.limit(0), "k", ["x", "y"]).count() == 0
    with pytest.raises(ValueError):
        agglomerate.merges(df, "k", ["x", "y"], "median")


def test_cuts(spark):
    """Chains of any length end at their smallest key; clusters are numbered by it; k clusters are left."""
    df = spark.createDataFrame([(n, float(n + 10 * (n >= 20) + 20 * (n >= 35))) for n in range(50)], "k long, x double")
    steps = agglomerate.merges(df, "k", ["x"], "single", 20, 16)
    got = {(r["height"], r["k"]): r["cluster"] for r in agglomerate.clusters_at(df, "k", steps, [0.5, 1.0, 11.0]).collect()}
    assert len(got) == 150
    for n in range(50):
        assert (got[0.5, n], got[1.0, n], got[11.0, n]) == (n, (n >= 20) + (n >= 35), int(n >= 35))
    ward = agglomerate.into_clusters(df, "k", agglomerate.merges(df, "k", ["x"], "ward", 20, 16), 3)
    assert {r["k"]: r["cluster"] for r in ward.collect()} == {n: (n >= 20) + (n >= 35) for n in range(50)}
    lines = agglomerate.dendrogram(steps).orderBy("step").collect()
    assert len(lines) == 49 and lines[0]["line"].startswith(" 1.0000 | --------------->") and lines[-1]["line"].endswith("(50 rows)")
    assert agglomerate.comparison(df, "k", ["x"], [0.5, 1.0]).where(F.col("at_1_0").isNotNull()).count() == 3
