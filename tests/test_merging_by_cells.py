"""Merging by cells and by a shortest tree, in many blocks, against merging one pair at a time by definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_agglomerate import table

from orebody.operators import agglomerate, cells, single


def one_by_one(keys, x, linkage):
    """[(left, right, height, size)]: the nearest two clusters, over and over, from tables of all clusters' distances."""
    order = np.argsort(keys)
    d = np.sqrt(((x[order][:, None] - x[order][None]) ** 2).sum(-1))
    total, size, centre, names, out = d.copy(), np.ones(len(x)), x[order].copy(), np.array(keys)[order], []
    np.fill_diagonal(d, np.inf)
    for _ in range(len(x) - 1):
        i, j = divmod(int(d.argmin()), len(d))
        out.append((int(names[i]), int(names[j]), float(d[i, j]), int(size[i] + size[j])))
        total[i], centre[i] = total[i] + total[j], (size[i] * centre[i] + size[j] * centre[j]) / (size[i] + size[j])
        total[:, i] += total[:, j]
        size[i] += size[j]
        new = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": total[i] / (size[i] * size)}.get(linkage)
        new = np.sqrt(2 * size[i] * size / (size[i] + size)) * np.linalg.norm(centre - centre[i], axis=1) if new is None else new
        new[~np.isfinite(d).any(axis=1)] = np.inf
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
    return out


def lines(n=260, seed=8):
    """Rows on five lines, as suppliers lie on those of their nations, and a clump far away; three rows have copies."""
    rng = np.random.default_rng(seed)
    x = np.r_[np.c_[rng.uniform(0, 9, n), rng.integers(0, 5, n) * 0.3], rng.normal(40, 1, (40, 2))]
    return np.r_[x, x[:3], x[:2]]


@pytest.mark.parametrize("linkage", ["single", "complete", "average"])
def test_merges_and_means_in_many_blocks(spark, monkeypatch, linkage):
    x = lines()
    keys = [int(k) for k in np.random.default_rng(1).permutation(len(x))]
    passes, whole = [], agglomerate._cluster_pairs
    monkeypatch.setattr(agglomerate, "_cluster_pairs", lambda *a, **k: (passes.append(1), whole(*a, **k))[1])
    last = {"single": 12}.get(linkage, 60)  # 144 edges at most in one task: two rounds of edges before
    got = [tuple(r) for r in agglomerate.merges(table(spark, keys, x), "k", ["x", "y"], linkage, last, 64 if linkage == "single" else 128).orderBy("step").collect()]
    want = one_by_one(keys, x, linkage)
    assert np.allclose([r[3] for r in got], [w[2] for w in want])
    assert {r[1:3] + r[4:5] for r in got if r[3] > 0} == {(a, b, n) for a, b, h, n in want if h > 0}
    # Before, average and complete linkage took 7 passes over all pairs of rows.
    assert len(passes) < 3, passes
    at, members = {k: n for n, k in enumerate(keys)}, {k: [k] for k in keys}
    for _, a, b, h, size, left, mean in got:
        d = np.sqrt(((x[[at[k] for k in members[a]]][:, None] - x[[at[k] for k in members[b]]][None]) ** 2).sum(-1))
        assert mean == pytest.approx(d.mean(), abs=1e-9) and (size, left) == (d.size // len(d) + len(d), len(d))
        members[a] += members.pop(b)


def test_ward_by_cells(spark):
    x = lines(200, 9)[:240]
    keys = list(range(len(x)))
    got = [tuple(r) for r in agglomerate.merges(table(spark, keys, x), "k", ["x", "y"], "ward", 60, 64).orderBy("step").select("left_id", "right_id", "height", "size").collect()]
    want = one_by_one(keys, x, "ward")
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_every_point_lies_within_the_walls_of_its_cell():
    x = np.r_[np.random.default_rng(2).normal(size=(500, 3)), np.ones((90, 3))]
    for turn in (1, 2):
        made = cells.boxes(x[::3], np.ones(len(x[::3])), 12, turn)
        cell = made.place(x)
        assert len(made.lo) > 8 and all((made.walls(x[cell == c], c) >= 0).all() for c in range(len(made.lo)))
    assert (cells.boxes(x[-90:], np.ones(90), 12, 1).place(x) == 0).all()


def test_shortest_tree():
    line = np.arange(20.0)[:, None]
    assert (single.spanning(line)[2] == 1).all() and (line[:, 0] == range(20)).all()
    x = np.random.default_rng(3).normal(size=(60, 2))
    i, j, v = single.spanning(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert len(v) == 59 and np.allclose(v, d[i, j])
    assert np.allclose(sorted(v), [h for _, _, h, _ in one_by_one(list(range(60)), x, "single")])
    assert [len(e) for e in single.spanning(x[:1])] == [0, 0, 0]


def test_comparison_counts_rows_without_values(spark):
    rows = spark.range(30).selectExpr("id as k", "if(id = 7, null, double(id + 10 * int(id >= 20))) as x")
    got = agglomerate.comparison(rows, "k", ["x"], [0.5, 1.0, 2.0]).collect()
    assert [(r["at_0_5"], r["at_1_0"], r["at_2_0"]) for r in got][0] == (30, 4, 3) and len(got) == 3
    assert agglomerate.comparison(rows.limit(0), "k", ["x"], [0.5]).where(F.col("at_0_5").isNull()).count() == 3
