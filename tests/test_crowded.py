"""Density clusters with crowded cells and itemsets by bitmaps, against brute force."""

import itertools
from collections import Counter

import numpy as np
import pytest

from orebody.operators import cluster, rules


def slow_dbscan(x, eps, least):
    """Clusters numbered by their smallest core; rows are in the order of their keys."""
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= least
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        low = np.where(core, np.where(near & core, label, len(x)).min(axis=1), len(x))
        if (low == label).all():
            break
        label = low
    names = {c: k for k, c in enumerate(sorted(set(label[core].tolist())))}
    out = [names[c] if k else -1 for c, k in zip(label.tolist(), core)]
    for i in np.flatnonzero(~core):
        reach = [out[j] for j in np.flatnonzero(near[i] & core)]
        out[i] = min(reach, default=-1)
    return out


@pytest.mark.parametrize("d", [1, 2, 3, 4])
def test_density_clusters(spark, d):
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(c, 0.25, (60, d)) for c in (0, 1.2, 4)] + [rng.uniform(-3, 6, (80, d)), np.full((30, d), 0.5), np.round(rng.uniform(0, 3, (60, d)))])
    x[:5] = np.round(x[:5])
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    names = [f"x{k}" for k in range(d)]
    df = spark.createDataFrame([*rows, (10_000, *[None] * d)], ", ".join(["id long", *(f"{n} double" for n in names)])).repartition(4)
    for eps, least in ((0.5, 5), (1.0, 8))[: 2 if d == 2 else 1]:
        got = {r["id"]: r["cluster"] for r in cluster.dbscan(df, "id", names, eps, least).collect()}
        assert got.pop(10_000) == -1
        assert [got[i] for i in range(len(x))] == slow_dbscan(x, eps, least)


def test_a_crowded_cell_costs_no_pairs(spark, monkeypatch):
    """Two crowds a little over eps apart, and two a little under: boxes are halved until that shows."""
    rng = np.random.default_rng(3)
    left, right = rng.uniform(0, 0.3, (20_000, 2)), rng.uniform(0, 0.3, (20_000, 2))
    rows = []
    for base, gap in ((0, 1.001), (50, 0.999)):
        a, b = left + [base, 0], right + [base + 0.3 + gap, 0]
        a[0], b[0] = [base + 0.3, 0.1], [base + 0.3 + gap, 0.1]
        rows += [*a.tolist(), *b.tolist()]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(rows)], "id long, x double, y double").repartition(8)
    counts = Counter(r["cluster"] for r in cluster.dbscan(df, "id", ["x", "y"], 1.0, 10).collect())
    assert sorted(counts.values()) == [20_000, 20_000, 40_000] and -1 not in counts


def test_itemsets_by_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(rules, "SLICE", 70)  # several slices
    rng = np.random.default_rng(2)
    held = [{f"i{k}" for k in np.flatnonzero(rng.random(9) < 0.45)} for _ in range(400)]
    rows = [(f"t{t}", i) for t, items in enumerate(held) for i in items]
    baskets = spark.createDataFrame(rows * 2, "tid string, item string").repartition(5)
    got = {tuple(r["items"]): (r["k"], r["cnt"]) for r in rules.apriori(baskets, 40).collect()}
    names = sorted(set().union(*held))
    truth = {}
    for k in range(1, len(names) + 1):
        for c in itertools.combinations(names, k):
            n = sum(set(c) <= b for b in held)
            if n >= 40:
                truth[c] = (k, n)
    assert got == truth and max(map(len, truth)) > 2
    assert rules.basket_bitmaps(baskets.distinct()).count() <= 9 * 6
    assert rules.apriori(baskets.limit(0), 1).count() == 0
